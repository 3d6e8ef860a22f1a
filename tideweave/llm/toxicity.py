"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are all words of a bounded sample of labelled documents. A text's vector has, for each of them,
(1 + log tf) * idf * G, of length 1; G is the G-test value of the term against the label on the sample
(supervised term weighting: plain idf gives the many rare words of long texts most of the cosine, see
README). No term is left out. The examples stand in an inverted index whose postings come in blocks of
examples, with the largest weight of each term in each block. A block's upper bound is the query's
product with those; a few blocks of the highest bounds are scored exactly first, then all whose bound
reaches the k-th score so far. Neighbours vote with their cosine as weight, each class weighed by what
it is of all labelled rows, against the share of toxic ones as prior. The vote becomes a calibrated
score by a logistic fitted on the examples' own votes, each without itself.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideweave.llm.common import annotate, crc_fold, materialize, table

#: Labelled rows in the index, at most (half of them toxic if there are so many), and bytes of their texts in sum.
EXAMPLES, SAMPLE_BYTES = 4096, 64 << 20
NEIGHBOURS, PRIOR_WEIGHT, BLOCK, FIRST_BLOCKS = 15, 1.0, 128, 2
_WORD = re.compile(r"\w+")


def words(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


def g_test(a: np.ndarray, n: np.ndarray, positive: int, total: int) -> np.ndarray:
    """2 * sum of observed * log(observed / expected) over the table of term by label: a of n with the term are positive."""
    out, n = np.zeros(len(n)), n.astype(float)
    for seen, has, share in ((a, n, positive), (n - a, n, total - positive), (positive - a, total - n, positive), (total - positive - n + a, total - n, total - positive)):
        some = seen > 0
        out[some] += seen[some] * np.log(seen[some] * total / (has[some] * share))
    return np.maximum(2 * out, 0.0)


def _keys(terms: list[str]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in terms), np.uint64, len(terms))


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of runs, one after another."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Index:
    """Inverted index in blocks of examples."""

    def __init__(self, examples: list[tuple[int, int, Counter]], share: float, k: int = NEIGHBOURS, prior_weight: float = PRIOR_WEIGHT, block: int = BLOCK):
        """examples: (id, label, words); share: of label 1 among all labelled rows."""
        self.k, self.prior_weight, self.block, self.share = k, prior_weight, block, share
        total, positive = len(examples), sum(y for _, y, _ in examples)
        df, df_positive = Counter(), Counter()
        for _, y, c in examples:
            df.update(c.keys())
            if y:
                df_positive.update(c.keys())
        every = sorted(df)
        keys = _keys(every)
        order = np.argsort(keys)
        self.keys, every = keys[order], [every[i] for i in order]  # a word's number is the place of its key: 8 bytes a word in each worker
        n = np.fromiter((df[w] for w in every), np.int64, len(df))
        a = np.fromiter((df_positive[w] for w in every), np.int64, len(df))
        self.term_weight = (np.log((total + 1) / (n + 1)) + 1) * g_test(a, n, positive, total)
        self.class_weight = np.array([(1 - share) * total / max(total - positive, 1), share * total / max(positive, 1)])
        vectors = [self.vector(c) for _, _, c in examples]
        heaviest = [int(t[np.argmax(w)]) if len(t) else -1 for t, w in vectors]
        order = sorted(range(total), key=lambda i: (examples[i][1], heaviest[i], examples[i][0]))  # like ones share blocks, which tightens the bounds
        vectors = [vectors[i] for i in order]
        self.ids = np.array([examples[i][0] for i in order], np.int64)
        self.labels = np.array([examples[i][1] for i in order], np.int64)
        self.blocks = -(-total // block)
        size = [len(t) for t, _ in vectors]
        term = np.concatenate([t for t, _ in vectors]) if vectors else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0)
        own = np.repeat(np.arange(total), size)
        by_term = np.argsort(term, kind="stable")
        term, self.weight, self.example = term[by_term], weight[by_term], own[by_term].astype(np.int32)
        del vectors, weight, own, by_term
        # an entry per term and block: where its postings are and the largest weight
        key = term * max(self.blocks, 1) + self.example // block
        fresh = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.entry_at, self.entry_size = fresh.astype(np.int32), np.diff(np.append(fresh, len(key))).astype(np.int32)
        self.entry_block = (key[fresh] % max(self.blocks, 1)).astype(np.int32)
        self.entry_most = np.maximum.reduceat(self.weight, fresh) if len(fresh) else np.zeros(0)
        ends = np.searchsorted(term[fresh], np.arange(len(df) + 1))
        self.first_entry, self.entries = ends[:-1].astype(np.int32), np.diff(ends).astype(np.int32)
        self.scale = (1.0, 0.0)
        self.scale = self.calibration(examples)

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of a text; words outside the sample have no weight."""
        keys = _keys(list(counts))
        order = np.argsort(keys)
        keys, n = keys[order], np.fromiter(counts.values(), np.int64, len(counts))[order]
        terms = np.searchsorted(self.keys, keys)
        known = np.flatnonzero(self.keys[np.minimum(terms, len(self.keys) - 1)] == keys) if len(self.keys) else np.zeros(0, np.int64)
        terms, n = terms[known], n[known]
        raw = (1 + np.log(n)) * self.term_weight[terms]
        length = math.sqrt(float(raw @ raw))
        return (terms, raw / length) if length > 0 else (terms[:0], raw[:0])

    def nearest(self, counts: Counter, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the k nearest examples with a cosine over 0; ties to the smaller id. without: an id left out."""
        terms, q = self.vector(counts)
        at = _runs(self.first_entry[terms], self.entries[terms])
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0)
        q = np.repeat(q, self.entries[terms])
        block = self.entry_block[at]
        bound = np.bincount(block, q * self.entry_most[at], self.blocks)
        score = np.zeros(self.blocks * self.block)

        def resolve(chosen: np.ndarray) -> None:
            own = chosen[block]
            size = self.entry_size[at[own]]
            where = _runs(self.entry_at[at[own]], size)
            score[:] += np.bincount(self.example[where], self.weight[where] * np.repeat(q[own], size), len(score))

        first = np.zeros(self.blocks, bool)
        first[np.argsort(-bound, kind="stable")[:FIRST_BLOCKS]] = True
        resolve(first)
        if without is not None:
            score[np.flatnonzero(self.ids == without)] = 0.0
        reached = np.partition(score, -self.k)[-self.k] if self.k < len(score) else 0.0
        more = ~first & (bound >= reached - 1e-9) & (bound > 0)
        if more.any():
            resolve(more)
            if without is not None:
                score[np.flatnonzero(self.ids == without)] = 0.0
        reached = np.partition(score, -self.k)[-self.k] if self.k < len(score) else 0.0
        hit = np.flatnonzero((score > 0) & (score >= reached))
        hit = hit[np.lexsort((self.ids[hit], -score[hit]))][: self.k]
        return hit, score[hit]

    def vote(self, at: np.ndarray, cosine: np.ndarray) -> float:
        """Log odds of the weighted vote."""
        own = cosine * self.class_weight[self.labels[at]]
        share = min(max(self.share, 1e-6), 1 - 1e-6)
        positive = float(own @ self.labels[at])
        return math.log(positive + self.prior_weight * share) - math.log(float(own.sum()) - positive + self.prior_weight * (1 - share))

    def calibration(self, examples: list[tuple[int, int, Counter]]) -> tuple[float, float]:
        """Slope and offset of a logistic from votes to labels, with the usual smoothed targets; the slope is not negative."""
        if not examples or len({y for _, y, _ in examples}) < 2:
            return 1.0, 0.0
        x = np.array([self.vote(*self.nearest(c, i)) for i, _, c in examples])
        y = np.array([y for _, y, _ in examples])
        n = np.bincount(y, minlength=2)
        target = np.where(y > 0, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
        weight = self.class_weight[y]
        a, b = 1.0, 0.0
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -500, 500)))
            g, h = weight * (p - target), weight * p * (1 - p) + 1e-9
            gradient, hessian = np.array([g @ x + 1e-3 * (a - 1), g.sum()]), np.array([[h @ (x * x) + 1e-3, h @ x], [h @ x, h.sum()]])
            step = np.linalg.solve(hessian, gradient)
            step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-9:
                break
        return max(float(a), 0.0), float(b)

    def score(self, counts: Counter) -> tuple[float, list[int], list[float]]:
        """Calibrated score, and the neighbours' ids and cosines as evidence."""
        at, cosine = self.nearest(counts)
        if not len(at):
            return self.share, [], []
        a, b = self.scale
        return 1 / (1 + math.exp(-min(max(a * self.vote(at, cosine) + b, -500.0), 500.0))), self.ids[at].tolist(), cosine.tolist()


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, examples: int = EXAMPLES, sample_bytes: int = SAMPLE_BYTES) -> tuple[list[tuple[int, int, Counter]], float]:
    """The examples, (id, label, words), in order of their ids, and the share of label 1 among all labelled ids.

    At most ``examples`` of them, half of them of label 1 if there are so many, the first by a hash of
    the id, and of these as many as have ``sample_bytes`` of text in sum. A document labelled twice
    takes the higher label, an id with several texts the least of them; null labels and ids are left
    out. Of documents with equal words and label one is enough: the one with the least id.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("example")).agg((F.max(label_col) > 0).cast("int").alias("label"))
    n = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    positive = min(n.get(1, 0), max(examples // 2, examples - n.get(0, 0)))
    first = lambda y, most: known.where(F.col("label") == y).orderBy(F.xxhash64("example"), "example").limit(most)
    chosen = first(1, positive).unionAll(first(0, examples - positive))  # ``examples`` rows at most
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("example"))
    sample = materialize(rows.groupBy("id").agg(F.max("label").alias("label"), F.min("text").alias("text")), "toxic-sample")
    sizes = sample.select("id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).orderBy(F.xxhash64("id"), "id").collect()
    within = np.cumsum([r["bytes"] for r in sizes]) <= sample_bytes
    few = [r["id"] for r, ok in zip(sizes, within) if ok]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [words(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))], ["id", "label", "words", "n"])

    if len(few) < len(sizes):
        sample = sample.join(F.broadcast(sample.sparkSession.createDataFrame([(i,) for i in few], "id long")), "id")
    got = sample.mapInArrow(counted, "id long, label int, words array<string>, n array<int>").toArrow().combine_chunks().sort_by("id")
    out: dict[tuple, tuple[int, int, Counter]] = {}
    one: dict[str, str] = {}  # each word is held once
    for i, label, own, k in zip(*(got.column(c) for c in ("id", "label", "words", "n"))):
        counts = Counter({one.setdefault(w, w): m for w, m in zip(own.as_py(), k.as_py())})
        out.setdefault((label.as_py(), xxhash.xxh3_128_digest(repr(sorted(counts.items())).encode("utf-8", "surrogatepass"))), (i.as_py(), label.as_py(), counts))
    return list(out.values()), n.get(1, 0) / max(sum(n.values()), 1)


def build_index(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, k: int = NEIGHBOURS, prior_weight: float = PRIOR_WEIGHT, block: int = BLOCK, **limits) -> Index:
    """Index of labelled_sample(), which takes the limits."""
    return Index(*labelled_sample(docs, labels, id_col, text_col, label_col, **limits), k=k, prior_weight=prior_weight, block=block)


def score(docs: DataFrame, index: Index, text_col: str = "text") -> DataFrame:
    """Columns "row" (all of docs), score, predicted, evidence, similarity for every row of docs.

    Every text is scored whole, however long. Null and empty texts, and texts without a word of the
    sample, have no neighbours and get the share of toxic rows among the labelled ones. Repeated rows get
    equal scores; without labelled examples every score is 0. No rows give no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(index)  # bounded by EXAMPLES and SAMPLE_BYTES

    def judge():
        own = sent.value

        def run(texts: pa.Array) -> list[pa.Array]:
            out = [own.score(words(t.as_py())) for t in texts]
            return [pa.array([o[0] for o in out], pa.float64()), pa.array([int(o[0] >= 0.5) for o in out], pa.int32()), pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.list_(pa.float64()))]

        return run

    return annotate(docs, text_col, judge, "score double, predicted int, evidence array<bigint>, similarity array<double>")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc_fold("doc_id") != 0)
    out = score(docs, build_index(docs, labels))
    return out.select("row.doc_id", (F.expr("pmod(crc32(cast(coalesce(cast(row.doc_id as string), '') as binary)), 5)") == 0).alias("held_out"), "score", "predicted", "evidence")
