"""Maps of keys to dotted values with a causal context.

Entries are (map_id, key, replica, seq, v_kind, v_int, v_text, v_bytes), the context is the dots ever
seen: (map_id, replica, seq).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideweave.operators.sets import union_all

DOT = ["map_id", "replica", "seq"]
VALUE = ["v_kind", "v_int", "v_text", "v_bytes"]


def context(ops: DataFrame) -> DataFrame:
    return ops.where("kind = 'put'").select(*DOT).distinct()


def put(ops: DataFrame) -> DataFrame:
    """Entries after local writes: a put replaces the replica's entry of the key, a remove clears it."""
    last = ops.groupBy("map_id", "key", "replica").agg(F.max(F.struct("seq", "kind", *VALUE)).alias("w"))
    return last.where("w.kind = 'put'").select("map_id", "key", "replica", "w.seq", *[f"w.{v}" for v in VALUE])


def join(*states: DataFrame) -> DataFrame:
    """Union of entries by (key, dot); of two values of one dot the greatest stays."""
    best = union_all(*states).groupBy("map_id", "key", "replica", "seq").agg(F.max(F.struct(*VALUE)).alias("w"))
    return best.select("map_id", "key", "replica", "seq", "w.*")


def join_observed(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Join of (entries, context) that honours removals: an entry that one side has seen but does not hold is gone."""
    (ea, ca), (eb, cb) = a, b
    key = ["map_id", "key", "replica", "seq"]
    gone = lambda mine, theirs, seen: mine.join(theirs.select(*key), key, "left_anti").join(seen, DOT, "left_semi").select(*key)
    dropped = gone(ea, eb, cb).unionByName(gone(eb, ea, ca))
    return join(ea, eb).join(dropped, key, "left_anti"), union_all(ca, cb).distinct()


def get(entries: DataFrame) -> DataFrame:
    """map_id, key and the value of the least live dot."""
    best = entries.groupBy("map_id", "key").agg(F.min_by(F.struct(*VALUE), F.struct("replica", "seq")).alias("w"))
    return best.select("map_id", "key", "w.*")


def get_all(entries: DataFrame) -> DataFrame:
    dots = F.array_sort(F.collect_list(F.struct("replica", "seq", *VALUE)))
    return entries.groupBy("map_id", "key").agg(F.transform(dots, lambda d: F.struct(*[d[v].alias(v) for v in VALUE])).alias("values"))


def remove(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """Entries without those of the keys; the context keeps their dots."""
    return entries.join(keys.select("map_id", "key"), ["map_id", "key"], "left_anti")


def keys(entries: DataFrame) -> DataFrame:
    return entries.select("map_id", "key").distinct().orderBy("map_id", "key")


def contains_key(entries: DataFrame, probes: DataFrame) -> DataFrame:
    return probes.join(entries.select("map_id", "key"), ["map_id", "key"], "left_semi")


def put_with_dot(entries: DataFrame, rows: DataFrame) -> DataFrame:
    return join(entries, rows)


def context_contains(ctx: DataFrame, dots: DataFrame) -> DataFrame:
    return dots.join(ctx, DOT, "left_semi")
