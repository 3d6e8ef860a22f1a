"""Last-writer-wins and multi-value registers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideweave.operators.sets import union_all


def lww_join(*states: DataFrame) -> DataFrame:
    """key, ts_ms, replica, value of the greatest (timestamp, replica, value); a null value is the least."""
    order = F.struct("ts_ms", "replica", "value")
    best = union_all(*states).groupBy("key").agg(F.max(order).alias("w"))
    return best.select("key", "w.ts_ms", "w.replica", "w.value")


def lww_set(state: DataFrame, writes: DataFrame) -> DataFrame:
    """Writes are joined in: one that is not greater changes nothing."""
    return lww_join(state, writes.select("key", "ts_ms", "replica", "value"))


def lww_get(state: DataFrame) -> DataFrame:
    return state.select("key", "value")


def lww_timestamp(state: DataFrame) -> DataFrame:
    return state.select("key", "ts_ms")


def lww_clear(state: DataFrame) -> DataFrame:
    """Reset to no value at time 0; not a lattice operation, so a later join brings old writes back."""
    return state.select("key", F.lit(0).cast("long").alias("ts_ms"), "replica", F.lit(None).cast("string").alias("value"))


def mv_write(ops: DataFrame) -> DataFrame:
    """Dots after local writes: a write replaces the replica's own earlier dot of the key."""
    last = ops.groupBy("key", "replica").agg(F.max(F.struct("seq", "value")).alias("w"))
    return last.select("key", "replica", "w.seq", "w.value")


def mv_join(*states: DataFrame) -> DataFrame:
    """Union by dot (replica, seq); one dot has one value, and of two given ones the least stays."""
    return union_all(*states).groupBy("key", "replica", "seq").agg(F.min("value").alias("value"))


def mv_join_causal(*states: DataFrame) -> DataFrame:
    """As mv_join, but a dot goes when its replica has a later dot of the key: a resolved conflict stays resolved."""
    newest = Window.partitionBy("key", "replica").orderBy(F.desc("seq"))
    return mv_join(*states).withColumn("r", F.row_number().over(newest)).where("r = 1").drop("r")


def mv_read(state: DataFrame) -> DataFrame:
    """key, values: all concurrent values in dot order."""
    dots = F.array_sort(F.collect_list(F.struct("replica", "seq", "value")))
    return state.groupBy("key").agg(F.transform(dots, lambda d: d["value"]).alias("values"))


def mv_read_with_dots(state: DataFrame) -> DataFrame:
    return state.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("replica", "seq", "value"))).alias("dots"))


def mv_conflicts(state: DataFrame) -> DataFrame:
    return state.groupBy("key").agg(F.count(F.lit(1)).alias("n_values")).where("n_values > 1")


def mv_resolve(state: DataFrame, writes: DataFrame) -> DataFrame:
    """A resolving write replaces all dots of its key."""
    return state.join(writes.select("key"), "key", "left_anti").unionByName(writes.select("key", "replica", "seq", "value"))


def mv_remove_dots(state: DataFrame, dots: DataFrame) -> DataFrame:
    return state.join(dots.select("key", "replica", "seq"), ["key", "replica", "seq"], "left_anti")
