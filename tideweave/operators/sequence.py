"""Replicated lists and texts: nodes (doc_id, id, origin, value, deleted) in a tree of origins.

id and origin are STRUCT<seq, replica>; the origin of the first element is the genesis (0, "").
Order is the pre-order walk from the genesis with siblings by descending id. States merge with one
aggregate per id. The walk is one grouped Arrow call per document over arrays, which visits runs of
typed characters at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideweave.operators.sets import union_all

NODE = ["doc_id", "id", "origin", "value", "deleted"]


def genesis() -> Column:
    return F.struct(F.lit(0).cast("long").alias("seq"), F.lit("").alias("replica"))


def dot(seq: Column, replica: Column) -> Column:
    return F.struct(seq.cast("long").alias("seq"), replica.alias("replica"))


def from_ops(ops: DataFrame) -> DataFrame:
    """Nodes of a seq_ops log. Deletions are kept as tombstone rows, so one that comes before its insertion counts too."""
    tomb = F.col("kind") == "delete"
    merged = ops.groupBy("doc_id", "id").agg(F.bool_or(tomb).alias("deleted"), F.max(F.when(~tomb, F.struct("origin", "value"))).alias("n"))
    return merged.where("n is not null").select("doc_id", "id", "n.origin", F.when(~F.col("deleted"), F.col("n.value")).alias("value"), "deleted")


def join(*states: DataFrame) -> DataFrame:
    """Merge by id: deleted if any side says so, and then without value.

    Rows are dealt by document, as the walk needs them, so that one shuffle serves both.
    """
    merged = union_all(*states).repartition("doc_id").groupBy("doc_id", "id").agg(F.max("origin").alias("origin"), F.max("value").alias("value"), F.bool_or("deleted").alias("deleted"))
    return merged.select("doc_id", "id", "origin", F.when(~F.col("deleted"), F.col("value")).alias("value"), "deleted")


def sibling_rank(nodes: DataFrame) -> DataFrame:
    """Rank among the children of one origin: greatest id first."""
    w = Window.partitionBy("doc_id", "origin").orderBy(F.desc("id"))
    return nodes.withColumn("sibling", F.row_number().over(w))


def _walk(seq: np.ndarray, replica: np.ndarray, o_seq: np.ndarray, o_replica: np.ndarray, genesis_replica: int) -> np.ndarray:
    """Place of each node in the pre-order walk; nodes that the genesis does not reach come to -1. Replicas are numbers in order of their names.

    In order of ids most nodes of a typed text are the first child of the node before them. Such runs
    are contiguous in the walk, so only runs are walked one by one.
    """
    n = len(seq)
    order = np.lexsort((replica, seq))
    seq, replica, o_seq, o_replica = seq[order], replica[order], o_seq[order], o_replica[order]
    # position of each origin among the ids, by ranks of equal (seq, replica) pairs
    pairs = np.stack([np.concatenate([seq, o_seq]), np.concatenate([replica, o_replica])])
    both = np.lexsort((pairs[1], pairs[0]))
    fresh = np.append(True, (np.diff(pairs[:, both], axis=1) != 0).any(0)) if n else np.zeros(0, bool)
    rank = np.empty(2 * n, np.int64)
    rank[both] = np.cumsum(fresh) - 1
    at = np.full(2 * n + 1, -2)
    at[rank[:n]] = np.arange(n)
    parent = at[rank[n:]]
    parent[(parent == -2) & (o_seq == 0) & (o_replica == genesis_replica)] = -1
    last = np.full(n + 2, -1)
    np.maximum.at(last, parent, np.arange(n))  # the greatest child is visited first
    here = np.arange(n)
    run = (parent == here - 1) & (here > 0) & (last[np.maximum(here - 1, 0)] == here)
    start = np.flatnonzero(~run)
    end = np.append(start[1:], n)
    heads = start[parent[start] >= 0]
    heads = heads[np.argsort(parent[heads], kind="stable")]
    above = parent[heads]
    stack, parts = start[parent[start] == -1].tolist(), []
    while stack:
        s = stack.pop()
        e = int(end[np.searchsorted(start, s)])
        parts.append((s, e))
        stack += heads[np.searchsorted(above, s) : np.searchsorted(above, e)].tolist()  # the last one is next: deepest parent, greatest id
    place, count = np.full(n, -1, np.int64), 0
    for s, e in parts:
        place[s:e] = np.arange(count, count + e - s)
        count += e - s
    out = np.empty(n, np.int64)
    out[order] = place
    return out


def _codes(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Ids and origins of one document's rows as numbers, replicas in order of their names, and the genesis' replica; no origin is -1."""
    field = lambda c, f: pc.struct_field(t.column(c), f).combine_chunks()
    names = pa.concat_arrays([field("id", "replica"), field("origin", "replica").fill_null("")]).dictionary_encode()
    known = names.dictionary.to_pylist()
    number = {name: i for i, name in enumerate(sorted({*known, ""}))}
    code = np.array([number[x] for x in known] or [0], np.int64)[names.indices.to_numpy(zero_copy_only=False)]
    n = t.num_rows
    return field("id", "seq").to_numpy(zero_copy_only=False), code[:n], field("origin", "seq").fill_null(-1).to_numpy(zero_copy_only=False), code[n:], number[""]


def _placed(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """One document's rows with repeated ids merged as join() does, and their places."""
    seq, replica, o_seq, o_replica, genesis_replica = _codes(t)
    if len(seq):
        order = np.lexsort((t.column("value").is_valid().to_numpy(), o_replica, o_seq, replica, seq))
        first = np.append(True, (np.diff(seq[order]) != 0) | (np.diff(replica[order]) != 0))
        if not first.all():
            starts = np.flatnonzero(first)
            kept = order[np.append(starts[1:], len(order)) - 1]
            gone = np.logical_or.reduceat(t.column("deleted").to_numpy()[order], starts)
            t = t.take(pa.array(kept))
            t = t.set_column(t.schema.get_field_index("deleted"), "deleted", pa.array(gone))
            seq, replica, o_seq, o_replica = seq[kept], replica[kept], o_seq[kept], o_replica[kept]
    return t, _walk(seq, replica, o_seq, o_replica, genesis_replica)


def _nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select(*NODE).where("id is not null")


def _shown(t: pa.Table) -> pa.Table:
    """Visible nodes of one document in order."""
    t, place = _placed(t)
    live = np.flatnonzero((place >= 0) & ~t.column("deleted").to_numpy())
    return t.take(pa.array(live[np.argsort(place[live], kind="stable")]))


def ordered(nodes: DataFrame) -> DataFrame:
    """Nodes with ``place``, their position in document order with tombstones counted; unreachable nodes are left out.

    Here and in visible() and text_of() nodes may be the union of several states: rows of one id are merged in the walk.
    """

    def run(t: pa.Table) -> pa.Table:
        t, place = _placed(t)
        return t.append_column("place", pa.array(place)).filter(pa.array(place >= 0))

    rows = _nodes(nodes)
    return rows.groupBy("doc_id").applyInArrow(run, T.StructType([*rows.schema.fields, T.StructField("place", T.LongType())]))


def visible(nodes: DataFrame) -> DataFrame:
    """Visible nodes with ``position`` from 0: element_at, index_of, iterate with index and slice are filters over it."""

    def run(t: pa.Table) -> pa.Table:
        out = _shown(t).select(["doc_id", "id", "value"])
        return out.append_column("position", pa.array(np.arange(out.num_rows, dtype=np.int32)))

    rows = _nodes(nodes)
    return rows.groupBy("doc_id").applyInArrow(run, T.StructType([*(rows.schema[c] for c in ("doc_id", "id", "value")), T.StructField("position", T.IntegerType())]))


def text_of(nodes: DataFrame) -> DataFrame:
    """doc_id, text of a state, in one pass per document; documents without a visible character are left out."""

    def run(t: pa.Table) -> pa.Table:
        out = _shown(t)
        if not out.num_rows:
            return out.select(["doc_id"]).append_column("text", pa.array([], pa.string()))
        return out.slice(0, 1).select(["doc_id"]).append_column("text", pa.array(["".join(out.column("value").to_pylist())], pa.string()))

    rows = _nodes(nodes)
    return rows.groupBy("doc_id").applyInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("text", T.StringType())]))


def at(shown: DataFrame, probes: DataFrame) -> DataFrame:
    """Elements at (doc_id, position): characters, list items, or their ids."""
    return probes.join(shown, ["doc_id", "position"])


def position_of(shown: DataFrame, ids: DataFrame) -> DataFrame:
    """Positions of ids (doc_id, id); ids that are not visible are left out."""
    return ids.join(shown, ["doc_id", "id"]).select("doc_id", "id", "position")


def joined_pieces(rows: DataFrame, order: list[str], piece: str, name: str) -> DataFrame:
    """doc_id and the pieces of each document joined in order, as column name."""

    def run(t: pa.Table) -> pa.Table:
        whole = "".join(t.sort_by([(c, "ascending") for c in order]).column(piece).to_pylist())
        return t.slice(0, 1).select(["doc_id"]).append_column(name, pa.array([whole], pa.string()))

    kept = rows.select("doc_id", *order, piece)
    return kept.groupBy("doc_id").applyInArrow(run, T.StructType([kept.schema["doc_id"], T.StructField(name, T.StringType())]))


def _text(rows: DataFrame) -> DataFrame:
    return joined_pieces(rows.where("value is not null"), ["position"], "value", "text")


def render(shown: DataFrame) -> DataFrame:
    """doc_id, text."""
    return _text(shown)


def to_list(shown: DataFrame) -> DataFrame:
    """doc_id, items in order."""
    parts = F.array_sort(F.collect_list(F.struct("position", "value")))
    return shown.groupBy("doc_id").agg(F.transform(parts, lambda p: p["value"]).alias("items"))


def text_slice(shown: DataFrame, start: Column | int, end: Column | int) -> DataFrame:
    """doc_id, text of the visible characters in [start, end)."""
    return _text(shown.where((F.col("position") >= start) & (F.col("position") < end)))


def length(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("doc_id").agg(F.count_if(~F.col("deleted")).alias("n"))


def next_seq(nodes: DataFrame, replica: str) -> DataFrame:
    """doc_id, next: a number greater than any seen in the document, so that later inserts sort before older siblings."""
    return nodes.groupBy("doc_id").agg((F.max("id.seq") + 1).alias("next"))


def insert(shown: DataFrame, nodes: DataFrame, edits: DataFrame, replica: str) -> DataFrame:
    """seq_ops rows that insert texts: edits are doc_id, position, text; a position beyond the end is the end.

    The first character's origin is the visible one before the position (the genesis at 0), each
    other's the character before it.
    """
    size = shown.groupBy("doc_id").agg(F.max("position").alias("last"))
    e = edits.join(size, "doc_id", "left").join(next_seq(nodes, replica), "doc_id", "left")
    e = e.withColumns({"before": F.least(F.col("position"), F.coalesce(F.col("last") + 1, F.lit(0))) - 1, "next": F.coalesce("next", F.lit(1))})
    anchor = shown.select("doc_id", F.col("position").alias("before"), F.col("id").alias("anchor"))
    e = e.join(anchor, ["doc_id", "before"], "left")
    chars = e.select("doc_id", "next", "anchor", F.posexplode(F.split("text", "")).alias("k", "value")).where("value <> ''")
    mine = dot(F.col("next") + F.col("k"), F.lit(replica))
    before = F.when(F.col("k") > 0, dot(F.col("next") + F.col("k") - 1, F.lit(replica))).otherwise(F.coalesce("anchor", genesis()))
    return chars.select("doc_id", F.lit("insert").alias("kind"), mine.alias("id"), before.alias("origin"), "value")


def insert_values(shown: DataFrame, nodes: DataFrame, edits: DataFrame, replica: str) -> DataFrame:
    """seq_ops rows that insert one element each: edits are doc_id, position, value; one edit per sequence at a time.

    Position 0 is the front, one beyond the end is the back.
    """
    size = shown.groupBy("doc_id").agg((F.max("position") + 1).alias("size"))
    e = edits.join(size, "doc_id", "left").join(next_seq(nodes, replica), "doc_id", "left")
    e = e.withColumn("before", F.least(F.col("position"), F.coalesce("size", F.lit(0))) - 1)
    e = e.join(shown.select("doc_id", F.col("position").alias("before"), F.col("id").alias("anchor")), ["doc_id", "before"], "left")
    return e.select("doc_id", F.lit("insert").alias("kind"), dot(F.coalesce("next", F.lit(1)), F.lit(replica)).alias("id"), F.coalesce("anchor", genesis()).alias("origin"), "value")


def delete(shown: DataFrame, edits: DataFrame) -> DataFrame:
    """seq_ops rows that delete ranges: edits are doc_id, start, length."""
    hit = shown.join(edits, "doc_id").where((F.col("position") >= F.col("start")) & (F.col("position") < F.col("start") + F.col("length")))
    return hit.select("doc_id", F.lit("delete").alias("kind"), "id", F.lit(None).cast("struct<seq: bigint, replica: string>").alias("origin"), F.lit(None).cast("string").alias("value"))


def splice(shown: DataFrame, nodes: DataFrame, edits: DataFrame, replica: str) -> DataFrame:
    """Delete ``length`` characters from ``start`` and insert ``text`` there; replace is the same with a range."""
    gone = delete(shown, edits.select("doc_id", "start", "length"))
    return gone.unionByName(insert(shown, nodes, edits.select("doc_id", F.col("start").alias("position"), "text"), replica))


def clamped(shown: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (doc_id, start, length) held within the text; those that come to nothing are left out."""
    size = shown.groupBy("doc_id").agg((F.max("position") + 1).alias("size"))
    start = F.least("start", F.coalesce("size", F.lit(0)))
    out = edits.join(size, "doc_id", "left").withColumn("start", start)
    return out.withColumn("length", F.least("length", F.coalesce("size", F.lit(0)) - F.col("start"))).where("length > 0").drop("size")


def move(shown: DataFrame, nodes: DataFrame, moves: DataFrame, replica: str) -> DataFrame:
    """Move list elements: moves are doc_id, src, dst (position after the removal). The element gets a new id."""
    taken = moves.join(shown.select("doc_id", F.col("position").alias("src"), "id", "value"), ["doc_id", "src"])
    rest = shown.join(taken.select("doc_id", "id"), ["doc_id", "id"], "left_anti")
    rest = rest.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy("position")) - 1)
    anchor = rest.select("doc_id", (F.col("position") + 1).alias("dst"), F.col("id").alias("anchor"))
    placed = taken.join(anchor, ["doc_id", "dst"], "left").join(next_seq(nodes, replica), "doc_id")
    none = F.lit(None)
    gone = taken.select("doc_id", F.lit("delete").alias("kind"), "id", none.cast("struct<seq: bigint, replica: string>").alias("origin"), none.cast("string").alias("value"))
    return gone.unionByName(placed.select("doc_id", F.lit("insert").alias("kind"), dot(F.col("next"), F.lit(replica)).alias("id"), F.coalesce("anchor", genesis()).alias("origin"), "value"))


def apply_ops(nodes: DataFrame, ops: DataFrame) -> DataFrame:
    """State after a delta of seq_ops; applying it twice changes nothing."""
    as_ops = nodes.select("doc_id", F.lit("insert").alias("kind"), "id", "origin", "value").unionByName(nodes.where("deleted").select("doc_id", F.lit("delete").alias("kind"), "id", "origin", "value"))
    return from_ops(as_ops.unionByName(ops.select("doc_id", "kind", "id", "origin", "value")))


def typed_nodes(docs: DataFrame, id_col: str, text: Column, replica: str = "r0") -> DataFrame:
    """Nodes of texts typed from left to right by one replica."""
    chars = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.posexplode(F.split(text, "")).alias("k", "value")).where("value <> ''")
    mine = dot(F.col("k") + 1, F.lit(replica))
    before = F.when(F.col("k") > 0, dot(F.col("k"), F.lit(replica))).otherwise(genesis())
    return chars.select("doc_id", mine.alias("id"), before.alias("origin"), "value", F.lit(False).alias("deleted"))
