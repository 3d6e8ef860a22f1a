"""Grow-only and observed-remove sets.

A grow-only set is a relation of elements; an observed-remove set is live (element, tag) rows and
removed tags. A tag is (tag_replica, tag_seq). States of any number of replicas merge in one
distinct and one anti join, in any order and however often.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAG = ["tag_replica", "tag_seq"]


def union_all(*states: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, states)


def gset_join(*states: DataFrame) -> DataFrame:
    """Union of grow-only sets; also of causal contexts."""
    return union_all(*states).distinct()


def gset_delta(spark: SparkSession, elements: list[str]) -> DataFrame:
    return spark.createDataFrame([(e,) for e in elements], "element string").distinct()


def gset_insert(state: DataFrame, delta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new state, delta): the delta is what was joined in."""
    return gset_join(state, delta), delta


def contains(state: DataFrame, probes: DataFrame, key: str = "element") -> DataFrame:
    """The probes that are members."""
    return probes.join(state.select(key), key, "left_semi")


def cardinality(state: DataFrame, key: str = "element", by: list[str] | None = None) -> DataFrame:
    return (state.groupBy(*by) if by else state).agg(F.countDistinct(key).alias("n"))


def elements(state: DataFrame, key: str = "element") -> DataFrame:
    return state.select(key).distinct().orderBy(key)


def leq(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: is a contained in b?"""
    return a.distinct().join(b.distinct(), a.columns, "left_anti").agg((F.count(F.lit(1)) == 0).alias("leq"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: Equal, Less, Greater or None for two set-like states, from their one-sided rests."""
    rest = union_all(
        a.distinct().join(b.distinct(), a.columns, "left_anti").select(F.lit("a").alias("side")),
        b.distinct().join(a.distinct(), a.columns, "left_anti").select(F.lit("b").alias("side")),
    ).agg(F.count_if(F.col("side") == "a").alias("a"), F.count_if(F.col("side") == "b").alias("b"))
    return rest.select(F.when((F.col("a") == 0) & (F.col("b") == 0), "Equal").when(F.col("a") == 0, "Less").when(F.col("b") == 0, "Greater").otherwise("None").alias("ordering"))


def same_rows(states: DataFrame, holder: str, *content: str) -> DataFrame:
    """One row: whether all holders have the same rows, told by their number and two commutative sums of 64-bit hashes.

    Partial sums are added up per holder, so no holder's rows are gathered in one place.
    """
    h = lambda seed: F.xxhash64(F.lit(seed), *content)
    digests = states.groupBy(holder).agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum(h(1).cast("decimal(38,0)")).alias("sum"), F.bit_xor(h(2)).alias("xor")).alias("digest"))
    return digests.agg((F.countDistinct("digest") <= 1).alias("converged"))


def orset_from_ops(ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(added tags, removed tags) of a set_ops log."""
    added = ops.where("kind = 'add'").select("set_id", "element", *TAG).distinct()
    removed = ops.where("kind = 'remove'").select("set_id", *TAG).distinct()
    return added, removed


def orset_add(ops: DataFrame) -> DataFrame:
    """Add rows for new elements: replica, seq, set_id, element; the tag is the adding operation's own (replica, seq)."""
    return ops.select("set_id", "element", F.col("replica").alias("tag_replica"), F.col("seq").alias("tag_seq"))


def orset_remove(added: DataFrame, removed: DataFrame, elements: DataFrame) -> DataFrame:
    """The removal delta: all live tags of the elements, and no others."""
    return orset_live(added, removed).join(elements.select("set_id", "element"), ["set_id", "element"], "left_semi").select("set_id", *TAG)


def orset_join(*states: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Join of states or of deltas: both sides are unions."""
    return gset_join(*[s[0] for s in states]), gset_join(*[s[1] for s in states])


def orset_apply_delta(state: tuple[DataFrame, DataFrame], delta: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Applying a delta is joining it: removals evict live tags at once."""
    return orset_join(state, delta)


def orset_live(added: DataFrame, removed: DataFrame) -> DataFrame:
    """Live (element, tag) rows: added tags that nobody removed. Adding wins over a removal that did not see the tag."""
    return added.join(removed, ["set_id", *TAG], "left_anti")


def orset_elements(added: DataFrame, removed: DataFrame) -> DataFrame:
    return orset_live(added, removed).select("set_id", "element").distinct()


def orset_compact(added: DataFrame, removed: DataFrame) -> DataFrame:
    """The live rows alone, for a new checkpoint of the state."""
    return orset_live(added, removed).distinct()
