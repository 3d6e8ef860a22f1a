"""Best-fit-decreasing packing of tokenized documents into fixed-length sequences.

Best fit decreasing looks only at lengths, and a length is an integer of at most ``seq_len``.
So the whole corpus reduces exactly to a histogram of at most ``seq_len`` lengths: the plan that
places *runs* of equal pieces is the same packing that item-by-item best fit decreasing gives,
up to which of several equally long pieces stands where. The driver plans over the histogram
with a segment tree over remaining capacities (tightest open bin in logarithmic time); its size
depends on ``seq_len`` alone, never on the data, so broadcasting the plan is bounded. Pieces get
their rank among equal lengths from per-partition counts, and the plan turns ranks into places.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideweave.llm.common import materialize, table

SEQ_LEN = 1024
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, slot long"


class ByteBpe:
    """Ids as the JSON tokenizer gives them, without special tokens added.

    Texts within Latin-1 that hold no special token's string go through the rank file of the
    same vocabulary, which is several times faster; there both libraries agree on every
    character class of the splitting pattern. All other texts go through the JSON tokenizer.
    """

    def __init__(self, json_path: str, ranks_path: str):
        self.json_path, self.slow = json_path, None
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = [x.content for x in self._json().get_added_tokens_decoder().values()]

    def _json(self):
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.json_path)
        return self.slow

    def encode(self, text: str) -> np.ndarray:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return np.array(self._json().encode(text, add_special_tokens=False).ids, "<u4")
        if any(s in text for s in self.special):
            return np.array(self._json().encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


def cut(total: int, seq_len: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than seq_len."""
    first = total % seq_len or min(total, seq_len)
    return [(0, first)] + [(s, seq_len) for s in range(first, total, seq_len)]


def tokenized_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, seq_len: int = SEQ_LEN, end_id: int = END_ID, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """One row per piece, with the scan partition and its place among that partition's pieces of this length."""
    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, seen = ByteBpe(json_path, ranks_path), TaskContext.get().partitionId(), np.zeros(seq_len + 1, np.int64)
        end = np.array([end_id], "<u4")
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([bpe.encode(text.as_py() or ""), end])
                for k, (start, length) in enumerate(cut(len(ids), seq_len)):
                    row = (doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), part, int(seen[length]))
                    seen[length] += 1
                    for column, value in zip(out, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "slot"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


class CapacityTree:
    """Segment tree over remaining capacities 0..cap; find(s) is the least open capacity of at least s."""

    def __init__(self, cap: int):
        self.n = 1 << cap.bit_length()
        self.open = [0] * (2 * self.n)

    def set(self, capacity: int, is_open: bool) -> None:
        i = capacity + self.n
        self.open[i] = int(is_open)
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] | self.open[2 * i + 1]

    def find(self, least: int) -> int:
        """-1 if no bin is that open."""
        i = least + self.n
        if self.open[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.n
            i //= 2
        return -1


def best_fit_plan(counts: Iterable[tuple[int, int]], cap: int = SEQ_LEN) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first bin, offset): piece of rank k stands in bin first_bin + k - first_rank.

    counts: how many pieces there are of each length.
    """
    tree, bins, plan, opened = CapacityTree(cap), {}, [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            bins.setdefault(room, []).append((first, n))
            tree.set(room, True)

    for size, left in sorted(counts, reverse=True):
        rank = 0
        while left:
            room = tree.find(size)
            if room < 0:
                room, first, n = cap, opened, -(-left // (cap // size))
                opened += n
            else:
                first, n = bins[room].pop()
                tree.set(room, bool(bins[room]))
            per = room // size  # a bin that takes one becomes the tightest and takes all that fit
            full = min(n, left // per)
            for k in range(per if full else 0):
                plan.append((size, rank, rank + full, first, cap - room + k * size))
                rank += full
            left -= full * per
            put(room - per * size, first, full)
            first, n = first + full, n - full
            if n and left:  # fewer are left than one bin takes
                for k in range(left):
                    plan.append((size, rank, rank + 1, first, cap - room + k * size))
                    rank += 1
                put(room - left * size, first, 1)
                first, n, left = first + 1, n - 1, 0
            put(room, first, n)
    return plan


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, seq_len: int = SEQ_LEN, **tokenizer) -> DataFrame:
    """Pack documents by best fit decreasing: a row per piece with its sequence and offset.

    Null and empty texts are the end id alone; repeated rows are packed as often as they occur;
    a null id stays null; no rows give no rows. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    pieces = materialize(tokenized_pieces(docs, id_col, text_col, seq_len=seq_len, **tokenizer), "pieces")
    by_part = pieces.groupBy("part", "length").count()
    counts = [(int(r[0]), int(r[1])) for r in by_part.groupBy("length").agg(F.sum("count")).collect()]  # seq_len rows at most
    plan = spark.createDataFrame(best_fit_plan(counts, seq_len), "length long, rank_lo long, rank_hi long, bin_lo long, offset long")
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("part", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("slot"))
    p, q = ranked.alias("p"), F.broadcast(plan).alias("q")  # the plan's size depends on seq_len alone
    placed = p.join(q, (F.col("p.length") == F.col("q.length")) & (F.col("p.rank") >= F.col("q.rank_lo")) & (F.col("p.rank") < F.col("q.rank_hi")))
    return placed.select("p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", (F.col("q.bin_lo") + F.col("p.rank") - F.col("q.rank_lo")).alias("sequence_id"), F.col("q.offset").alias("offset"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
