"""Replicated texts by runs: the sequence of operators/sequence.py with a row for a stretch of it, not for a character.

Runs: doc_id, id, origin, value, deleted. A run is characters with consecutive ids from ``id`` on, of which
each later one's origin is the one before. value is their text; deleted has a bit per character (least
bits first; null: none is). A run without value knows the characters only that it deletes, so a state of
tombstones is one row as well. States merge in the walk, their union is a state.

Shown: doc_id, text, spans of a document's visible characters in order. A span is characters of one
replica with growing numbers: from ``seq`` on those whose bit is set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideweave.operators import sequence
from tideweave.sources.shared import shuffled

DOT = "struct<seq: bigint, replica: string>"
RUN = f"doc_id string, id {DOT}, origin {DOT}, value string, deleted binary"
SHOWN = "doc_id string, text string, spans array<struct<seq: bigint, replica: string, bits: binary>>"
#: Numbers that a span may skip between two of its characters.
GAP = 1024


def typed_runs(docs: DataFrame, id_col: str, text: Column, replica: str = "r0") -> DataFrame:
    """Runs of texts typed from left to right by one replica; empty ones have none."""
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), sequence.dot(F.lit(1), F.lit(replica)).alias("id"), sequence.genesis().alias("origin"), text.alias("value"), F.lit(None).cast("binary").alias("deleted"))
    return rows.where("value <> ''")


def deleted_every(runs: DataFrame, n: int) -> DataFrame:
    """The state of a replica that has deleted the characters whose numbers n divides, and knows these alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, starts = b.column("size").to_numpy(), b.column("id").field("seq").to_numpy()
            bits = [np.packbits((np.arange(s, s + k) % n) == 0, bitorder="little").tobytes() for s, k in zip(starts, sizes)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("id"), b.column("origin"), pa.nulls(b.num_rows, pa.string()), pa.array(bits, pa.binary())], ["doc_id", "id", "origin", "value", "deleted"])

    return runs.select("doc_id", "id", "origin", F.char_length("value").alias("size")).mapInArrow(run, RUN)


def of_ops(ops: DataFrame) -> DataFrame:
    """Runs of a seq_ops log, a character each."""
    gone = F.col("kind") == "delete"
    return ops.select("doc_id", "id", "origin", F.when(~gone, F.col("value")).alias("value"), F.when(gone, F.lit(b"\x01")).alias("deleted"))


def last_ids(runs: DataFrame) -> DataFrame:
    """doc_id, id: a number as great as any in the document, for sequence.next_seq()."""
    size = F.greatest(F.coalesce(F.char_length("value"), F.lit(1)), F.coalesce(F.octet_length("deleted") * 8, F.lit(1)))
    return runs.groupBy("doc_id").agg(F.max(F.col("id.seq") + F.when(F.col("value").isNotNull(), F.char_length("value")).otherwise(size) - 1).alias("n")).select("doc_id", sequence.dot(F.col("n"), F.lit("")).alias("id"))


def _bits(bits: bytes | None, n: int | None = None) -> np.ndarray:
    """As many truth values as n says, or as there are."""
    out = np.unpackbits(np.frombuffer(bits or b"", np.uint8), bitorder="little").astype(bool)
    return out if n is None else np.append(out, np.zeros(max(n - len(out), 0), bool))[:n]


def _nodes(rows: list[tuple], code: dict[str, int]) -> list[np.ndarray]:
    """seq, replica, origin's seq and replica, code point (-1: unknown), deleted of every character of one document's runs."""
    parts = []
    for i, origin, value, deleted in rows:
        if value is not None:
            points = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            at, gone = np.arange(len(points)), _bits(deleted, len(points))
        else:
            at = np.flatnonzero(_bits(deleted))
            points, gone = np.full(len(at), -1), np.ones(len(at), bool)
        seq, own = i["seq"] + at, code[i["replica"]]
        o_seq, o_replica = seq - 1, np.full(len(at), own)
        if len(at) and at[0] == 0:
            o_seq[0], o_replica[0] = (origin["seq"], code[origin["replica"]]) if origin is not None else (-1, code[""])
        parts.append((seq, np.full(len(at), own), o_seq, o_replica, points, gone))
    return [np.concatenate(x) for x in zip(*parts)]


def _placed(seq, replica, o_seq, o_replica, points, gone, names: int, genesis: int) -> tuple[np.ndarray, ...]:
    """seq, replica and code point of the visible characters in order.

    Rows of one id are one: the greatest origin, a known character, deleted if any says so. Ids are single
    numbers here, and runs are in order already, so that sorting and finding origins is a pass over them.
    """
    if max(int(np.abs(seq).max()), int(np.abs(o_seq).max())) >= (1 << 62) // names:
        raise ValueError("numbers of a sequence beyond 62 bits")
    key, up = seq * names + replica, o_seq * names + o_replica
    order = np.argsort(key, kind="stable")
    key, up, points, gone = key[order], up[order], points[order], gone[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    if len(starts) < len(key):
        up, points, gone = np.maximum.reduceat(up, starts), np.maximum.reduceat(points, starts), np.logical_or.reduceat(gone, starts)
        key = key[starts]
    place = _walk(key, up, genesis)
    live = np.flatnonzero((place >= 0) & ~gone & (points >= 0))
    if (np.diff(place[live]) < 0).any():
        live = live[np.argsort(place[live], kind="stable")]
    return key[live] // names, key[live] % names, points[live]


def _walk(key: np.ndarray, up: np.ndarray, genesis: int) -> np.ndarray:
    """sequence._walk() of sorted ids: the place of each, -1 of those that the genesis does not reach."""
    n = len(key)
    parent = np.arange(-1, n - 1)
    far = np.flatnonzero(np.append(True, key[:-1] != up[1:]))
    at = np.minimum(np.searchsorted(key, up[far]), n - 1)
    parent[far] = np.where(key[at] == up[far], at, np.where(up[far] == genesis, -1, -2))
    last = np.full(n + 2, -1)
    last[parent] = np.arange(n)  # the greatest child, which is visited first, is written last
    run = np.append(False, (parent[1:] == np.arange(n - 1)) & (last[: n - 1] == np.arange(1, n)))
    start = np.flatnonzero(~run)
    end = np.append(start[1:], n)
    heads = start[parent[start] >= 0]
    heads = heads[np.argsort(parent[heads], kind="stable")]
    above = parent[heads]
    stack, place, count = start[parent[start] == -1].tolist(), np.full(n, -1, np.int64), 0
    while stack:
        s = stack.pop()
        e = int(end[np.searchsorted(start, s)])
        place[s:e] = np.arange(count, count + e - s)
        count += e - s
        stack += heads[np.searchsorted(above, s) : np.searchsorted(above, e)].tolist()
    return place


def _typed(rows: list[tuple]) -> tuple | None:
    """Shortcut of _nodes() and _placed(): one run that begins the text, and deletions in it; None for anything else."""
    whole = [r for r in rows if r[2] is not None]
    if len(whole) != 1:
        return None
    i, origin, value, _ = whole[0]
    if origin is None or origin["replica"] != "" or origin["seq"] != 0 or i["seq"] <= 0 or i["replica"] == "":
        return None
    points = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
    gone = np.zeros(len(points), bool)
    for j, o, _, deleted in rows:
        if j["replica"] != i["replica"] or (o is not None and o != origin and o != {"seq": j["seq"] - 1, "replica": i["replica"]}):
            return None
        at = np.flatnonzero(_bits(deleted, len(value) if _ is not None else None)) + j["seq"] - i["seq"]
        if len(at) and (at[0] < 0 or at[-1] >= len(gone) or (o == origin and j["seq"] != i["seq"])):
            return None
        gone[at] = True
    return i["seq"] + np.arange(len(points)), points, gone, i["replica"]


def _walked(rows: list[tuple]) -> tuple[str, list[tuple[int, str, bytes]]]:
    """text and spans of one document's visible characters."""
    quick = _typed(rows)
    if quick is not None:
        seq, points, gone, name = quick
        live = np.flatnonzero(~gone)
        seq, points, replica, names = seq[live], points[live], np.zeros(len(live), np.int64), [name]
    else:
        names = sorted({"", *(r[0]["replica"] for r in rows), *(r[1]["replica"] for r in rows if r[1] is not None)})
        code = {name: k for k, name in enumerate(names)}
        seq, replica, points = _placed(*_nodes(rows, code), len(names), code[""])
    text = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    if not len(seq):
        return text, []
    step = np.diff(seq)
    cut = np.append(0, np.flatnonzero((np.diff(replica) != 0) | (step <= 0) | (step > GAP)) + 1)
    spans = []
    for s, e in zip(cut, np.append(cut[1:], len(seq))):
        bits = np.zeros(int(seq[e - 1] - seq[s]) + 1, bool)
        bits[seq[s:e] - seq[s]] = True
        spans.append((int(seq[s]), names[replica[s]], np.packbits(bits, bitorder="little").tobytes()))
    return text, spans


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple]]]:
    """doc_id and its (id, origin, value, deleted), from rows sorted by document."""
    doc, held = None, []
    for b in batches:
        for name, *row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "id", "origin", "value", "deleted"))):
            if held and name != doc:
                yield doc, held
                held = []
            doc = name
            held.append(tuple(row))
    if held:
        yield doc, held


_SPAN = pa.list_(pa.struct([("seq", pa.int64()), ("replica", pa.string()), ("bits", pa.binary())]))


def visible(*states: DataFrame) -> DataFrame:
    """Shown characters of the merge of states, in one shuffle; documents without one are left out. A document is walked by one task."""
    from tideweave.operators.sets import union_all

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, chars = [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.string()), pa.array([[{"seq": s, "replica": n, "bits": x} for s, n, x in r[2]] for r in out], _SPAN)], ["doc_id", "text", "spans"])
        for doc, rows in _by_document(batches):
            text, spans = _walked(rows)
            if text:
                out.append((doc, text, spans))
                chars += len(text)
            if chars > 4 << 20:
                yield pack()
                out, chars = [], 0
        yield pack()

    rows = union_all(*[s.select("doc_id", "id", "origin", "value", "deleted") for s in states]).where("id is not null")
    return rows.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, SHOWN)


def sizes(shown: DataFrame) -> DataFrame:
    """doc_id, size."""
    return shown.select("doc_id", F.char_length("text").cast("long").alias("size"))


def text_of(shown: DataFrame) -> DataFrame:
    return shown.select("doc_id", "text")


def text_slice(shown: DataFrame, start: int, end: int) -> DataFrame:
    """doc_id, text of the visible characters in [start, end); documents that have none there are left out."""
    return shown.select("doc_id", F.substring("text", start + 1, end - start).alias("text")).where("text <> ''")


def chars(shown: DataFrame, positions: DataFrame | None = None, ids: DataFrame | None = None) -> DataFrame:
    """doc_id, id, value, position of the characters at positions (doc_id, position) or with ids (doc_id, id), and of every document's last.

    With the last one these rows do for operators that take all characters but look at some and at the size.
    """
    asked = shown.select("doc_id", "text", "spans")
    none = F.array()
    for df, column, kind in ((positions, "position", "array<int>"), (ids, "id", f"array<{DOT}>")):
        if df is None:
            asked = asked.withColumn(column, none.cast(kind))
        else:
            some = df.groupBy("doc_id").agg(F.collect_set(F.col(column)).cast(kind).alias(column))
            asked = asked.join(shuffled(some), "doc_id", "left").withColumn(column, F.coalesce(column, none.cast(kind)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, text, spans, at, named in zip(*(c.to_pylist() for c in b.columns)):
                parts = [(s["seq"] + np.flatnonzero(_bits(s["bits"])), s["replica"]) for s in spans]
                ends = np.cumsum([len(x) for x, _ in parts])
                hit = {len(text) - 1, *(p for p in at if 0 <= p < len(text))}
                for i in named:
                    for k, (seqs, replica) in enumerate(parts):
                        if replica == i["replica"] and seqs[0] <= i["seq"] <= seqs[-1]:
                            j = int(np.searchsorted(seqs, i["seq"]))
                            if seqs[j] == i["seq"]:
                                hit.add(int(ends[k]) - len(seqs) + j)
                for p in sorted(hit):
                    k = int(np.searchsorted(ends, p, side="right"))
                    seqs, replica = parts[k]
                    out.append((doc, {"seq": int(seqs[p - (int(ends[k]) - len(seqs))]), "replica": replica}, text[p], p))
            cols = list(zip(*out)) or [[]] * 4
            kinds = (pa.string(), pa.struct([("seq", pa.int64()), ("replica", pa.string())]), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "id", "value", "position"])

    return asked.mapInArrow(run, f"doc_id string, id {DOT}, value string, position int")
