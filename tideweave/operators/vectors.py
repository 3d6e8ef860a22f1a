"""Version vectors as relations (holder, replica, seq); a missing entry is 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideweave.operators.sets import union_all


def join(*vectors: DataFrame) -> DataFrame:
    """replica, seq: the greatest seen."""
    return union_all(*[v.select("replica", "seq") for v in vectors]).groupBy("replica").agg(F.max("seq").alias("seq"))


def meet(a: DataFrame, b: DataFrame) -> DataFrame:
    """replica, seq: the least, entries of 0 dropped."""
    other = b.select("replica", F.col("seq").alias("other"))
    return a.join(other, "replica").select("replica", F.least("seq", "other").alias("seq")).where("seq > 0")


def dominance(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, a_dominates, b_dominates, strictly, concurrent for each wanted pair of holders.

    Entries of both are laid side by side by one aggregate per pair; pairs: a, b.
    """
    side = lambda s: pairs.join(vectors.withColumnRenamed("holder", s), s).select("a", "b", "replica", F.lit(s).alias("side"), "seq")
    each = side("a").unionByName(side("b")).groupBy("a", "b", "replica").agg(F.coalesce(F.max(F.when(F.col("side") == "a", F.col("seq"))), F.lit(0)).alias("sa"), F.coalesce(F.max(F.when(F.col("side") == "b", F.col("seq"))), F.lit(0)).alias("sb"))
    flags = each.groupBy("a", "b").agg(F.bool_and(F.col("sa") >= F.col("sb")).alias("a_dominates"), F.bool_and(F.col("sb") >= F.col("sa")).alias("b_dominates"))
    out = pairs.join(flags, ["a", "b"], "left").fillna(True, ["a_dominates", "b_dominates"])  # two empty vectors are equal
    return out.withColumns({"strictly": F.col("a_dominates") & ~F.col("b_dominates"), "concurrent": ~F.col("a_dominates") & ~F.col("b_dominates")})


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """replica, from_seq, to_seq: ranges that a has beyond b."""
    other = b.select("replica", F.col("seq").alias("other"))
    beyond = a.join(other, "replica", "left").withColumn("other", F.coalesce("other", F.lit(0)))
    return beyond.where(F.col("seq") > F.col("other")).select("replica", (F.col("other") + 1).alias("from_seq"), F.col("seq").alias("to_seq"))


def expand(ranges: DataFrame) -> DataFrame:
    """replica, seq: each operation of the ranges."""
    return ranges.select("replica", F.explode(F.sequence("from_seq", "to_seq")).alias("seq"))


def covered(vector: DataFrame, events: DataFrame) -> DataFrame:
    """The events (replica, seq) that the vector contains."""
    limit = vector.select("replica", F.col("seq").alias("limit"))
    return events.join(limit, "replica").where(F.col("seq") <= F.col("limit")).drop("limit")


def total_operations(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("holder").agg(F.sum("seq").alias("total"))


def from_events(events: DataFrame) -> DataFrame:
    """Sequence numbers handed out: replica, seq = number of its events."""
    return events.groupBy("replica").agg(F.count(F.lit(1)).alias("seq"))


def set_entry(vector: DataFrame, entries: DataFrame) -> DataFrame:
    """Overwrite entries; zeros are ignored."""
    new = entries.where("seq > 0")
    return vector.join(new.select("replica"), "replica", "left_anti").unionByName(new.select(*vector.columns))


def get_entry(vv: Column, replica: str) -> Column:
    """From a map column."""
    return F.coalesce(F.try_element_at(vv, F.lit(replica)), F.lit(0).cast("long"))


def to_entries(vectors: DataFrame) -> DataFrame:
    """holder, entries: sorted (replica, seq) list."""
    return vectors.groupBy("holder").agg(F.array_sort(F.collect_list(F.struct("replica", "seq"))).alias("entries"))


def from_entries(lists: DataFrame) -> DataFrame:
    return lists.select("holder", F.inline("entries"))


def stable_frontier(vectors: DataFrame) -> DataFrame:
    """replica, seq: the least that every holder is known to have; entries of 0 dropped.

    Counting who mentions a replica stands in for the zeros of those who do not, so holders and
    replicas are never multiplied out.
    """
    holders = vectors.agg(F.countDistinct("holder").alias("holders"))
    least = vectors.groupBy("replica").agg(F.min("seq").alias("seq"), F.countDistinct("holder").alias("known"))
    return least.join(F.broadcast(holders)).where((F.col("known") == F.col("holders")) & (F.col("seq") > 0)).select("replica", "seq")
