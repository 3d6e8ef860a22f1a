"""A document store as an append-only change log (doc_changes) and views over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TYPES = ("Text", "RichText", "Json")


def created(rows: DataFrame, doc_type: str, replica: str, now_ms: int) -> DataFrame:
    """Create changes for new documents: rows are doc_id, title, seq."""
    null = F.lit(None).cast("string")
    return rows.select(F.lit(replica).alias("replica"), "seq", F.lit(now_ms).cast("long").alias("ts_ms"), "doc_id", F.lit("create").alias("kind"), F.lit(doc_type).alias("doc_type"), "title", null.alias("meta_key"), null.alias("meta_value"))


def replay(changes: DataFrame) -> DataFrame:
    """Documents after a change log: doc_id, title, doc_type, created_at, modified_at, metadata.

    The first create (by time, replica, seq) counts; a delete removes the document for good; updates
    of a document that is not there are dropped; metadata keys are last-writer-wins.
    """
    order = F.struct("ts_ms", "replica", "seq")
    is_ = lambda k: F.col("kind") == k
    docs = changes.groupBy("doc_id").agg(
        F.min_by(F.when(is_("create"), F.struct("title", "doc_type", "ts_ms")), F.when(is_("create"), order)).alias("c"),
        F.max(F.when(~is_("delete"), F.col("ts_ms"))).alias("modified_at"),
        F.bool_or(is_("delete")).alias("gone"),
    )
    alive = docs.where("c is not null and not gone").select("doc_id", "c.title", "c.doc_type", F.col("c.ts_ms").alias("created_at"), F.greatest("modified_at", "c.ts_ms").alias("modified_at"))
    meta = changes.where(is_("metadata")).groupBy("doc_id", "meta_key").agg(F.max_by("meta_value", order).alias("meta_value"))
    maps = meta.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("meta_key", "meta_value")))).alias("metadata"))
    return alive.join(maps, "doc_id", "left")


def document_ids(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id").orderBy("doc_id")


def count(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n"))


def get(docs: DataFrame, doc_id: str) -> DataFrame:
    return docs.where(F.col("doc_id") == doc_id)


def contains(docs: DataFrame, probes: DataFrame) -> DataFrame:
    return probes.join(docs.select("doc_id"), "doc_id", "left_semi")


def title_index(docs: DataFrame) -> DataFrame:
    """title, doc_id: one document per title, the last created."""
    return docs.groupBy("title").agg(F.max_by("doc_id", F.struct("created_at", "doc_id")).alias("doc_id"))


def find_by_title(docs: DataFrame, titles: DataFrame) -> DataFrame:
    return titles.join(title_index(docs), "title").join(docs.drop("title"), "doc_id")


def scan_prefix(docs: DataFrame, prefix: str) -> DataFrame:
    """Documents of the title index whose title begins so, by title."""
    return title_index(docs.where(F.col("title").startswith(prefix))).join(docs.drop("title"), "doc_id").orderBy("title")


def query(docs: DataFrame, doc_type: str | None = None, title_prefix: str | None = None, sort: str = "title", descending: bool = False, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Filter, sort, offset, limit; ties by doc_id, in the same direction."""
    if sort not in ("title", "created_at", "modified_at"):
        raise ValueError(f"no sort field {sort}")
    out = docs
    if doc_type is not None:
        out = out.where(F.col("doc_type") == doc_type)
    if title_prefix is not None:
        out = out.where(F.col("title").startswith(title_prefix))
    side: Column = F.desc if descending else F.asc
    out = out.orderBy(side(sort), side("doc_id"))
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit is not None else out


def set_metadata(docs: DataFrame, key: str, value: str) -> DataFrame:
    kept = F.map_filter(F.coalesce("metadata", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, v: k != key)
    return docs.withColumn("metadata", F.map_concat(kept, F.create_map(F.lit(key), F.lit(value))))


def get_metadata(docs: DataFrame, key: str) -> DataFrame:
    return docs.select("doc_id", F.try_element_at("metadata", F.lit(key)).alias("value"))


def checked_edits(docs: DataFrame, edits: DataFrame, doc_type: str) -> DataFrame:
    """Edits with ``error``: NotFound, TypeMismatch or null."""
    known = docs.select("doc_id", F.col("doc_type").alias("_type"))
    error = F.when(F.col("_type").isNull(), "NotFound").when(F.col("_type") != doc_type, "TypeMismatch")
    return edits.join(known, "doc_id", "left").withColumn("error", error).drop("_type")


def join_values(a: DataFrame, b: DataFrame) -> DataFrame:
    """Documents of two replicas; where the types differ the left one stays. Type states are joined by their own operators."""
    kept = b.join(a.select("doc_id", F.col("doc_type").alias("_type")), "doc_id", "left").where("_type is null or _type = doc_type").drop("_type")
    both = a.withColumn("_side", F.lit(0)).unionByName(kept.withColumn("_side", F.lit(1)))
    w = Window.partitionBy("doc_id").orderBy("_side")
    newest = F.max("modified_at").over(Window.partitionBy("doc_id"))
    return both.withColumn("modified_at", newest).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_side")


def pending_changes(changes: DataFrame, taken: DataFrame) -> DataFrame:
    """The change feed beyond what a consumer took: taken is replica, seq (its position)."""
    upto = taken.select("replica", F.col("seq").alias("_upto"))
    return changes.join(upto, "replica", "left").where(F.col("seq") > F.coalesce("_upto", F.lit(-1))).drop("_upto")


def validated_path(docs: DataFrame, edits: DataFrame) -> DataFrame:
    return checked_edits(docs, edits, "Json")
