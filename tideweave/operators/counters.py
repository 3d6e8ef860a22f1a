"""Positive-negative counters: per (counter, replica) the greatest increment and decrement totals seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideweave.functions.scalars import clamp_long
from tideweave.operators import prefix
from tideweave.operators.sets import union_all


def from_ops(ops: DataFrame) -> DataFrame:
    """State of a counter_ops log: replica, counter, inc, dec; totals are held at the greatest BIGINT."""
    total = lambda kind: clamp_long(F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("amount")).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")))
    return ops.groupBy("counter", "replica").agg(total("inc").alias("inc"), total("dec").alias("dec"))


def running(ops: DataFrame) -> DataFrame:
    """The log with each replica's totals after each operation: every delta of the counter."""
    amount = lambda kind: F.when(F.col("kind") == kind, F.col("amount")).otherwise(0)
    return prefix.running(ops, ["counter", "replica"], ["seq"], inc=("sum", amount("inc")), dec=("sum", amount("dec")))


def join(*states: DataFrame) -> DataFrame:
    return union_all(*states).groupBy("counter", "replica").agg(F.max("inc").alias("inc"), F.max("dec").alias("dec"))


def value(state: DataFrame) -> DataFrame:
    """counter, value: increments less decrements."""
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    return state.groupBy("counter").agg(clamp_long(wide("inc") - wide("dec")).alias("value"))


def own(state: DataFrame, replica: str) -> DataFrame:
    """Each counter's totals of one replica, 0 where it has none."""
    mine = state.where(F.col("replica") == replica).select("counter", "inc", "dec")
    return state.select("counter").distinct().join(mine, "counter", "left").fillna(0, ["inc", "dec"])


def breakdown(state: DataFrame) -> DataFrame:
    return state.select("counter", "replica", "inc", "dec").orderBy("counter", "replica")


def names(state: DataFrame) -> DataFrame:
    return state.select("counter").distinct().orderBy("counter")


def converged(states: DataFrame) -> DataFrame:
    """counter, converged: whether all holders have the same value. states: holder, counter, replica, inc, dec."""
    per = states.groupBy("holder", "counter").agg((F.sum("inc") - F.sum("dec")).alias("value"))
    holders = states.agg(F.countDistinct("holder").alias("holders"))
    agreed = per.groupBy("counter").agg(F.countDistinct("value").alias("values"), F.count(F.lit(1)).alias("n"))
    return agreed.join(F.broadcast(holders)).select("counter", ((F.col("values") == 1) & (F.col("n") == F.col("holders"))).alias("converged"))


def leq(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: is a at most b in every entry?"""
    other = b.select("counter", "replica", F.col("inc").alias("binc"), F.col("dec").alias("bdec"))
    worse = (F.col("inc") > F.coalesce("binc", F.lit(0))) | (F.col("dec") > F.coalesce("bdec", F.lit(0)))
    return a.join(other, ["counter", "replica"], "left").agg((F.count_if(worse) == 0).alias("leq"))
