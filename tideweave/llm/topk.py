"""Exact top-k inner-product search by the three-phase uniform threshold algorithm.

A score is the sum of partial scores over ``slices`` of the dimensions; each slice is a "node" with
its own score list. Phase 1 gathers the k best partial scores of every slice (and its least) and
turns their sums into a safe cutoff: k vectors are known to score at least that. Phase 2 sends each
block of rows the cutoff divided evenly over the slices; only entries that reach it in some slice
are collected, since a vector below it everywhere cannot reach the cutoff. Phase 3 drops those
whose upper bound stays below the cutoff and resolves the others' scores exactly.

Partial scores are taken above the slice's least one, so that the bounds hold for negative scores.
Phase 1 keeps its lists running, so a partition sends k entries per query and slice however many rows
it has. Queries are processed in blocks of at most ``query_block`` vectors, which bounds what is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideweave.llm.common import materialize, table

K, SLICES, QUERY_BLOCK = 10, 4, 8192
#: Rows and queries that are multiplied at a time.
ROWS, SUB = 4096, 128
EXACT, BIGGEST, LOWEST = 2.0**53, 2.0**62, (1 << 63) - 1


def scaled(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id, v: components as floor(scale * x); vectors that are null or hold null or non-finite components are left out."""
    x = F.col(vec_col).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull()).where(~bad).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of floats; shorter vectors are filled up with zeros, which leaves inner products as they are."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths())
    if len(sizes) and (sizes == width).all():
        return np.asarray(column.flatten()).reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    for i, row in enumerate(column):
        out[i, : min(width, len(row))] = row.values.to_numpy(zero_copy_only=False)[:width]
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows, exact below BIGGEST: in doubles where no sum can leave their exact range, else in 64-bit integers."""
    if not a.size or not b.size or np.abs(a).sum(1).max() * np.abs(b).max() < EXACT:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Best:
    """The k best partial scores, and the least, of each query and slice over all rows of a partition so far."""

    def __init__(self, queries: int, slices: int, k: int):
        self.k, self.score, self.row = k, np.full((slices, queries, 0), -LOWEST), np.zeros((slices, queries, 0), np.int64)
        self.low = np.full((slices, queries), LOWEST)

    def add(self, scores: np.ndarray, rows: np.ndarray, mine: np.ndarray) -> None:
        """scores: slices x queries x rows; mine: which rows are candidates of which query."""
        self.low = np.minimum(self.low, np.where(mine, scores, LOWEST).min(2))
        some = np.argpartition(np.where(mine, -scores, LOWEST), min(self.k, len(rows)) - 1, axis=2)[..., : self.k]
        score = np.concatenate([self.score, np.where(np.take_along_axis(np.broadcast_to(mine, scores.shape), some, 2), np.take_along_axis(scores, some, 2), -LOWEST)], 2)
        row = np.concatenate([self.row, rows[some]], 2)
        best = np.argpartition(-score, min(self.k, score.shape[2]) - 1, axis=2)[..., : self.k]
        self.score, self.row = np.take_along_axis(score, best, 2), np.take_along_axis(row, best, 2)

    def batch(self, first: int) -> pa.RecordBatch:
        """q, slice, row, partial; the rows with row null hold the least."""
        j, q, i = np.nonzero(self.score > -LOWEST)
        lj, lq = np.nonzero(self.low < LOWEST)
        low = np.arange(len(j) + len(lj)) >= len(j)
        fields = (np.concatenate([q, lq]) + first, np.concatenate([j, lj]), np.concatenate([self.row[j, q, i], np.zeros(len(lj), np.int64)]), np.concatenate([self.score[j, q, i], self.low[lj, lq]]))
        return pa.RecordBatch.from_arrays([pa.array(fields[0], pa.int32()), pa.array(fields[1], pa.int32()), pa.array(fields[2], pa.int64(), mask=low), pa.array(fields[3], pa.int64())], ["q", "slice", "row", "partial"])


def _cuts(width: int, slices: int) -> list[slice]:
    edges = np.linspace(0, width, min(slices, max(width, 1)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All rows of the partition in blocks of ROWS, so that lists are per block, not per Arrow batch."""
    ids, rows, n = [], [], 0
    for batch in batches:
        ids.append(np.asarray(batch.column(0)))
        rows.append(_matrix(batch.column(1), width))
        n += len(ids[-1])
        if n >= ROWS:
            yield np.concatenate(ids), np.concatenate(rows)
            ids, rows, n = [], [], 0
    if n:
        yield np.concatenate(ids), np.concatenate(rows)


def _search_block(rows: DataFrame, q_ids: np.ndarray, q: np.ndarray, k: int, slices: int) -> DataFrame:
    spark, width = rows.sparkSession, q.shape[1]
    cuts, n = _cuts(width, slices), len(q_ids)
    sent = spark.sparkContext.broadcast((q_ids, q))  # at most query_block vectors

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phase 1: of each slice the partition's k best partial scores, and as row null the least."""
        qi, qv = sent.value
        row = TaskContext.get().partitionId() << 40  # rows of one vec_id stay apart
        best = [Best(min(SUB, n - s), len(cuts), k) for s in range(0, n, SUB)]
        for ids, v in _chunks(batches, width):
            at = row + np.arange(len(ids))
            row += len(ids)
            for s in range(0, n, SUB):
                best[s // SUB].add(np.stack([_product(qv[s : s + SUB, c], v[:, c]) for c in cuts]), at, qi[s : s + SUB, None] != ids[None, :])
        yield from (b.batch(i * SUB) for i, b in enumerate(best))

    gathered = materialize(rows.mapInArrow(lists, "q int, slice int, row long, partial long"), "topk-lists")
    least = gathered.where("row is null").groupBy("q", "slice").agg(F.min("partial").alias("low"))
    best = Window.partitionBy("q", "slice").orderBy(F.desc("partial"), "row")
    top = gathered.where("row is not null").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    above = top.join(least, ["q", "slice"]).groupBy("q", "row").agg(F.sum(F.col("partial") - F.col("low")).alias("above"))
    kth = above.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("above"), "row"))).where(F.col("r") == k).select("q", "above")
    low, cutoff = np.zeros((n, len(cuts)), np.int64), np.zeros(n, np.int64)  # without k known vectors nothing is cut off
    for r in least.collect():  # a row for each query of the block and slice
        low[r[0], r[1]] = r[2]
    for r in kth.collect():
        cutoff[r[0]] = r[1]
    bounds = spark.sparkContext.broadcast((low, cutoff))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phases 2 and 3 over a block of rows, which holds all slices of its vectors."""
        qi, qv = sent.value
        low, cutoff = bounds.value
        for ids, v in _chunks(batches, width):
            for s in range(0, n, SUB):
                part = np.stack([_product(qv[s : s + SUB, c], v[:, c]) for c in cuts])
                above = part - low[s : s + SUB].T[:, :, None]
                least = cutoff[s : s + SUB, None]
                share = -(-least // len(cuts))  # an integer reaches cutoff / m only if it reaches this
                reach = above >= share[None]
                bound = np.where(reach, above, np.maximum(share - 1, 0)[None]).sum(0)  # what is not collected is below its share
                q, r = np.nonzero(reach.any(0) & (bound >= least) & (qi[s : s + SUB, None] != ids[None, :]))
                score = part[:, q, r].sum(0)  # exact, of the candidates alone
                order = np.lexsort((ids[r], -score, q))
                q, r, score = q[order], r[order], score[order]
                first = np.searchsorted(q, q)  # sorted by query: where its rows begin
                keep = np.arange(len(q)) - first < k
                yield pa.RecordBatch.from_arrays([pa.array(qi[q[keep] + s], pa.int64()), pa.array(ids[r[keep]], pa.int64()), pa.array(score[keep], pa.int64())], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(resolve, "query_id long, vec_id long, score long")


def search(vectors: DataFrame, is_query: F.Column, id_col: str = "vec_id", vec_col: str = "embedding", *, k: int = K, slices: int = SLICES, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products, ties to the smaller vec_id.

    is_query: a condition on vec_id. Repeated rows of one vec_id count once each as candidates, and as
    one query if they are equal. Vectors that are null, or that hold null or non-finite components, and
    rows without a vec_id take no part; shorter vectors count as filled up with zeros. Fewer candidates
    than k give fewer rows; no queries give no rows. Components so large that a score might leave 64
    bits are an error.
    """
    rows = scaled(vectors, id_col, vec_col)
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x))
    width, longest = rows.agg(F.max(F.size("v")), F.max(length)).first()
    width = width or 0
    asked = rows.where(is_query).distinct()
    if width and longest * (asked.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0.0) >= BIGGEST:
        raise ValueError("inner products of these vectors may not fit into 64 bits")
    spark, blocks = vectors.sparkSession, max(1, -(-asked.count() // query_block))
    found = []
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").toArrow()
        if own.num_rows and width:
            found.append(_search_block(rows, np.asarray(own.column(0)), _matrix(own.column(1), width), k, slices))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = reduce(DataFrame.unionAll, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
