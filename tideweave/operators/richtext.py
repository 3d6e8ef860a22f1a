"""Rich text: a sequence of characters and a relation of marks with anchored ends.

Marks: doc_id, mark_id, mark_kind, a1, a2, start_kind, start_id, end_kind, end_id, deleted. An anchor is
Start, End, After id or Before id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideweave.functions.scalars import mark_close_tag, mark_open_tag
from tideweave.operators.sequence import joined_pieces
from tideweave.operators.sets import union_all
from tideweave.sources.shared import shuffled

MARK = ["mark_kind", "a1", "a2", "start_kind", "start_id", "end_kind", "end_id"]
#: Positions per bucket of the range joins.
BUCKET = 4096


def marks_from_ops(ops: DataFrame) -> DataFrame:
    """Marks of a mark_ops log; a removal that comes before its mark counts too."""
    gone = F.col("kind") == "remove"
    merged = ops.groupBy("doc_id", "mark_id").agg(F.bool_or(gone).alias("deleted"), F.max(F.when(~gone, F.struct(*MARK))).alias("m"))
    return merged.where("m is not null").select("doc_id", "mark_id", "m.*", "deleted")


def join_marks(*states: DataFrame) -> DataFrame:
    merged = union_all(*states).groupBy("doc_id", "mark_id").agg(F.max(F.struct(*MARK)).alias("m"), F.bool_or("deleted").alias("deleted"))
    return merged.select("doc_id", "mark_id", "m.*", "deleted")


def active(marks: DataFrame) -> DataFrame:
    return marks.where("not deleted")


def ranges(marks: DataFrame, shown: DataFrame) -> DataFrame:
    """Active marks with start and end positions; one whose anchor character is gone is left out.

    shown: visible characters (doc_id, id, position).
    """
    where = shown.select("doc_id", "id", "position")
    size = shown.groupBy("doc_id").agg((F.max("position") + 1).alias("size"))

    def end(side: str, df: DataFrame) -> DataFrame:
        named = where.select("doc_id", F.col("id").alias(f"{side}_id"), F.col("position").alias(f"{side}_at"))
        return df.join(named, ["doc_id", f"{side}_id"], "left")

    m = end("end", end("start", active(marks))).join(size, "doc_id", "left").withColumn("size", F.coalesce("size", F.lit(0)))

    def resolve(side: str) -> Column:
        kind, at = F.col(f"{side}_kind"), F.col(f"{side}_at")
        return F.when(kind == "Start", 0).when(kind == "End", F.col("size")).when(kind == "After", at + 1).when(kind == "Before", at)

    out = m.withColumns({"start": resolve("start"), "end": resolve("end")})
    return out.where("start is not null and end is not null").select("doc_id", "mark_id", "mark_kind", "a1", "a2", "start", "end")


def _bucketed(spans: DataFrame, start: str, end: str) -> DataFrame:
    """A row for each bucket that [start, end) touches, so that range joins are equi joins on (doc_id, bucket)."""
    last = F.greatest(F.col(end) - 1, F.col(start))
    return spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(start) / BUCKET), F.floor(last / BUCKET))))


def marks_at(spans: DataFrame, probes: DataFrame) -> DataFrame:
    """Marks that cover positions: probes are doc_id, position."""
    p = probes.withColumn("bucket", F.floor(F.col("position") / BUCKET))
    return p.join(_bucketed(spans.where("start < end"), "start", "end"), ["doc_id", "bucket"]).where("start <= position and position < end").drop("bucket")


def overlapping(spans: DataFrame, probes: DataFrame) -> DataFrame:
    """Marks that overlap ranges: probes are doc_id, from_pos, to_pos."""
    left = _bucketed(spans.where("start < end"), "start", "end")
    right = _bucketed(probes.where("from_pos < to_pos"), "from_pos", "to_pos")
    hit = left.join(right, ["doc_id", "bucket"]).where("start < to_pos and end > from_pos")
    first = F.floor(F.greatest("start", "from_pos") / BUCKET)  # a pair meets in each bucket it shares; the first counts
    return hit.where(F.col("bucket") == first).drop("bucket")


def has_mark(spans: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes (doc_id, position, mark_kind, a1, a2) that a mark equal in kind and attributes covers."""
    covered = marks_at(spans.select("doc_id", "mark_id", "start", "end", F.col("mark_kind").alias("k"), F.col("a1").alias("x1"), F.col("a2").alias("x2")), probes)
    same = (F.col("k") == F.col("mark_kind")) & F.col("x1").eqNullSafe(F.col("a1")) & F.col("x2").eqNullSafe(F.col("a2"))
    return covered.where(same).select(probes.columns).distinct()


def marks_over(spans: DataFrame, probes: DataFrame) -> DataFrame:
    """marks_at() for all positions of ranges: probes are doc_id, from_pos, to_pos; a row per mark and range, with the stretch [since, until) where it stands."""
    return overlapping(spans, probes).withColumns({"since": F.greatest("start", "from_pos"), "until": F.least("end", "to_pos")})


def has_mark_every(spans: DataFrame, probes: DataFrame, step: int) -> DataFrame:
    """has_mark() at the positions of ranges that step divides: probes are doc_id, from_pos, to_pos, mark_kind, a1, a2."""
    covered = marks_over(spans.select("doc_id", "mark_id", "start", "end", F.col("mark_kind").alias("k"), F.col("a1").alias("x1"), F.col("a2").alias("x2")), probes)
    same = (F.col("k") == F.col("mark_kind")) & F.col("x1").eqNullSafe(F.col("a1")) & F.col("x2").eqNullSafe(F.col("a2"))
    first = F.ceil(F.col("since") / step) * step
    at = covered.where(same).withColumn("first", first).where("first < until")
    return at.select("doc_id", F.explode(F.sequence(F.col("first"), F.col("until").cast("long") - 1, F.lit(step).cast("long"))).alias("position"), "mark_kind", "a1", "a2").distinct()


def add_marks(shown: DataFrame, edits: DataFrame) -> DataFrame:
    """mark_ops rows for edits (doc_id, mark_id, start, end, mark_kind, a1, a2); ranges are held within the text, empty ones left out.

    A mark starts after the character before it, or at the text's start, and ends before the character
    after it, or at the text's end: what is inserted at either border belongs to it.
    """
    size = shown.groupBy("doc_id").agg((F.max("position") + 1).alias("size"))
    e = edits.join(size, "doc_id", "left").withColumns({"start": F.least("start", F.coalesce("size", F.lit(0))), "end": F.least("end", F.coalesce("size", F.lit(0)))}).where("start < end")
    first = shown.select("doc_id", (F.col("position") + 1).alias("start"), F.col("id").alias("start_id"))
    after = shown.select("doc_id", F.col("position").alias("end"), F.col("id").alias("end_id"))
    e = e.join(first, ["doc_id", "start"], "left").join(after, ["doc_id", "end"], "left")
    return e.select("doc_id", "mark_id", F.lit("add").alias("kind"), "mark_kind", "a1", "a2", F.when(F.col("start_id").isNull(), "Start").otherwise("After").alias("start_kind"), "start_id", F.when(F.col("end_id").isNull(), "End").otherwise("Before").alias("end_kind"), "end_id")


def remove_marks(marks: DataFrame, ids: DataFrame) -> DataFrame:
    """mark_ops rows that remove marks by id: ids are doc_id, mark_id."""
    return marks.join(ids, ["doc_id", "mark_id"], "left_semi").select("doc_id", "mark_id", F.lit("remove").alias("kind"), *MARK)


def remove_in_range(marks: DataFrame, spans: DataFrame, probes: DataFrame) -> DataFrame:
    """Remove marks of exactly the given type that overlap: probes are doc_id, from_pos, to_pos, p_kind, p_a1, p_a2."""
    hit = overlapping(spans, probes)
    same = (F.col("mark_kind") == F.col("p_kind")) & F.col("a1").eqNullSafe(F.col("p_a1")) & F.col("a2").eqNullSafe(F.col("p_a2"))
    return remove_marks(marks, hit.where(same).select("doc_id", "mark_id").distinct())


def to_html(spans: DataFrame, shown: DataFrame) -> DataFrame:
    """doc_id, html: tags between characters, closing before opening, ties by mark id; text is not escaped.

    Characters and tags are rows of one ordered list per document, so no range join is needed.
    """
    sized = spans.where("start < end")
    none = F.lit("").alias("mark_id")
    rows = [
        shown.select("doc_id", "position", F.lit(2).alias("rank"), none, F.col("value").alias("piece")),
        sized.select("doc_id", F.col("end").alias("position"), F.lit(0).alias("rank"), "mark_id", mark_close_tag(F.col("mark_kind")).alias("piece")),
        sized.select("doc_id", F.col("start").alias("position"), F.lit(1).alias("rank"), "mark_id", mark_open_tag(F.col("mark_kind"), F.col("a1"), F.col("a2")).alias("piece")),
    ]
    return joined_pieces(union_all(*rows).where("piece is not null"), ["position", "rank", "mark_id"], "piece", "html")


def html_of(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """to_html() of whole texts (doc_id, text): the tags of a document, few beside its characters, come to it as one array."""
    sized = spans.where("start < end")
    close = F.struct(F.col("end").alias("position"), F.lit(0).alias("rank"), "mark_id", mark_close_tag(F.col("mark_kind")).alias("piece"))
    open_ = F.struct(F.col("start").alias("position"), F.lit(1).alias("rank"), "mark_id", mark_open_tag(F.col("mark_kind"), F.col("a1"), F.col("a2")).alias("piece"))
    tags = sized.select("doc_id", F.explode(F.array(close, open_)).alias("t")).where("t.piece is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list("t")).alias("tags"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, own in zip(b.column("text").to_pylist(), b.column("tags").to_pylist()):
                pieces, at = [], 0
                for t in own or ():
                    pieces += [text[at : t["position"]], t["piece"]]
                    at = max(at, t["position"])
                out.append("".join([*pieces, text[at:]]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "html"])

    return texts.select("doc_id", "text").join(shuffled(tags), "doc_id", "left").mapInArrow(run, "doc_id string, html string")
