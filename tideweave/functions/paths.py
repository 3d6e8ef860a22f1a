"""JSON paths as arrays of segments; a segment is a key or, if all digits, an index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def segment(text: Column) -> Column:
    is_index = text.rlike("^[0-9]{1,9}$")
    return F.struct(F.when(~is_index, text).alias("key"), F.when(is_index, text.try_cast("int")).alias("idx"))


def parse(path: Column) -> Column:
    """Segments of a dotted path; the empty path is the root."""
    return F.when(path == "", F.array().cast("array<struct<key: string, idx: int>>")).otherwise(F.transform(F.split(path, r"\."), segment))


def parent(path: Column) -> Column:
    """The path without its last segment; the root has none."""
    return F.when(F.size(path) > 0, F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))))


def last(path: Column) -> Column:
    return F.try_element_at(path, F.lit(-1))


def child_key(path: Column, key: Column) -> Column:
    return F.array_append(path, F.struct(key.cast("string").alias("key"), F.lit(None).cast("int").alias("idx")))


def child_index(path: Column, index: Column) -> Column:
    return F.array_append(path, F.struct(F.lit(None).cast("string").alias("key"), index.cast("int").alias("idx")))


def render(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda s: F.coalesce(s["key"], s["idx"].cast("string"))), ".")


def prefixes(path: Column) -> Column:
    """Proper non-empty prefixes: the objects that setting this path creates on the way."""
    return F.when(F.size(path) > 1, F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda n: F.slice(path, F.lit(1), n))).otherwise(F.array())
