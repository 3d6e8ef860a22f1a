"""Quality by a hashed n-gram log-likelihood ratio between trusted and raw text.

N-grams are the windows of ``GRAM`` bytes of a text, hashed into ``BUCKETS``. Two multinomials over
the buckets are compared: one of the trusted documents (all of those labelled good), one of the whole
raw corpus. A document's score is the mean of log(p_trusted / p_raw) over its
n-grams. How far junk falls below clean text depends on its share of the raw corpus, so the cut comes
from the trusted side: each trusted document is scored by a model of the other trusted ones, the
spread of these scores is fitted as a function of length, and what lies ``SLACK`` times farther below
their median than all but ``LOST`` of the trusted documents is rejected. The score compared with the
cut (``margin``) adds to a trusted count what one is of a raw count, so that an n-gram seen in neither
is worth 0 however small the trusted sample is; with one added to both (``llr``) it would speak for trust.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideweave.llm import blocks
from tideweave.llm.common import annotate, materialize, table
from tideweave.sources.shared import shuffled

GRAM, BUCKETS = 3, 1 << 14
#: Share of trusted documents that may lie below the quantile, and how much farther than the quantile the cut lies.
LOST, SLACK = 0.001, 1.5
#: Log ratios are summed as whole multiples of 1 / FIXED, so that a text's mean does not depend on what stands beside it.
FIXED = 1 << 24
#: Values that a quantile takes to the driver, at most, and the bins by which it narrows down more of them.
FEW_VALUES, BINS = 10_000, 1024
MIN_WORDS, MAX_REPEAT = 10, 20
SYMBOLS, SPACE = b"#*$%&|<>", b" \t\n\r\x0b\x0c"
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double, margin double, cut double"


def gram_buckets(text: np.ndarray, gram: int = GRAM, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of the window that starts at each byte; as many as there are whole windows."""
    n = len(text) - gram + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint32)
    for i in range(gram):
        h *= np.uint32(0x01000193)
        h ^= text[i : i + n]
    h *= np.uint32(0x9E3779B1)
    return (h >> np.uint32(33 - buckets.bit_length())).astype(np.int64)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts in a row, and where each begins (and the last ends); null is empty."""
    flat = [(t.as_buffer() if t.is_valid else b"") for t in texts]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int64)
    return np.frombuffer(b"".join(flat), np.uint8), ends


def _whole(ends: np.ndarray, n: int, gram: int) -> np.ndarray:
    """Which of n windows do not cross from one text into the next."""
    ok = np.ones(max(n, 0), bool)
    for e in range(1, gram):
        at = ends[1:-1] - e
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


def gram_counts(rows: DataFrame, gram: int = GRAM, buckets: int = BUCKETS) -> DataFrame:
    """bucket, raw, trusted: n-gram counts of column text, over all rows and over those where trusted holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, trusted = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in blocks.cut_blocks(batches, 4 << 20):
            for chosen, counts in ((b, raw), (b.filter(b.column("trusted")), trusted)):
                if chosen.num_rows:
                    text, ends = _bytes(chosen.column("text"))
                    h = gram_buckets(text, gram, buckets)
                    counts += np.bincount(h[_whole(ends, len(h), gram)], minlength=buckets)
        full = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(raw[full]), pa.array(trusted[full])], ["bucket", "raw", "trusted"])

    return rows.select("text", "trusted").mapInArrow(run, "bucket int, raw long, trusted long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))


def left_out_score(text: bytes, raw: np.ndarray, trusted: np.ndarray, gram: int = GRAM) -> float:
    """Mean log ratio of a trusted text by the other trusted ones; raw and trusted are smoothed counts."""
    h = gram_buckets(np.frombuffer(text, np.uint8), gram, len(raw))
    others = trusted - np.bincount(h, minlength=len(raw))
    return float((np.log(others[h] / others.sum()) - np.log(raw[h] / raw.sum())).mean())


def quantile(values: DataFrame, share: float) -> float:
    """The exact quantile of column x, between neighbours in proportion as numpy's; bins narrow the rows down to few before any comes to the driver."""
    bounds = values.agg(F.count("x"), F.min("x"), F.max("x")).first()
    at = (bounds[0] - 1) * share

    def nth(k: int) -> float:
        below, low, high, n = 0, bounds[1], bounds[2], bounds[0]
        while low < high:
            part = values.where((F.col("x") >= low) & (F.col("x") <= high))
            if n <= FEW_VALUES:
                return float(np.sort(np.asarray(part.select("x").toArrow().column("x")))[k - below])
            b = F.least(F.floor((F.col("x") - low) / (high - low) * BINS), F.lit(BINS - 1))
            for _, n, low, high in sorted(part.groupBy(b).agg(F.count(F.lit(1)), F.min("x"), F.max("x")).collect()):
                if below + n > k:
                    break
                below += n
        return float(low)

    first = nth(int(at))
    return first if at == int(at) else first + (at - int(at)) * (nth(int(at) + 1) - first)


def fit_cut(own: DataFrame) -> tuple[float, float, float, float]:
    """middle, a, b, z of trusted scores (score, n) of n n-grams each: their variance is a + b / n, and the cut at middle + z * sqrt(a + b / n).

    Sums are of whole multiples of 1 / FIXED, so that they do not depend on the order of rows.
    """
    if own.limit(2).count() < 2:
        return 0.0, 0.0, 0.0, -np.inf
    middle = quantile(own.select(F.col("score").alias("x")), 0.5)
    n, weight = F.col("n"), 1 / (1 / F.col("n") + 1e-3)  # long texts vary little
    far = F.pow(F.col("score") - middle, 2)
    terms = {"aa": F.lit(1.0), "ab": 1 / n, "bb": 1 / (n * n), "ay": far, "by": far / n}
    sums = own.agg(*[F.sum(F.round(weight * weight * x * float(FIXED)).cast("decimal(30,0)")).alias(k) for k, x in terms.items()]).first()
    aa, ab, bb, ay, by = (float(sums[k]) / FIXED for k in terms)
    a, b = np.maximum(np.linalg.lstsq(np.array([[aa, ab], [ab, bb]]), np.array([ay, by]), rcond=None)[0], 0)
    z = quantile(own.select(((F.col("score") - middle) / (F.sqrt(F.lit(float(a)) + float(b) / n) + 1e-12)).alias("x")), LOST)
    return middle, float(a), float(b), float(SLACK * min(z, 0.0))


def cuts(fit: tuple[float, float, float, float], n: np.ndarray) -> np.ndarray:
    middle, a, b, z = fit
    return np.full(len(n), -np.inf) if z == -np.inf else middle + z * (np.sqrt(a + b / np.maximum(n, 1)) + 1e-12)


def log_ratio(counts: pa.Table, buckets: int = BUCKETS) -> np.ndarray:
    """log(p_trusted / p_raw) of each bucket, both with one added; all zero if nothing is trusted."""
    raw, trusted = np.ones(buckets), np.ones(buckets)
    at = np.asarray(counts.column("bucket"))
    raw[at] += np.asarray(counts.column("raw"))
    trusted[at] += np.asarray(counts.column("trusted"))
    if trusted.sum() == buckets:
        return np.zeros(buckets)
    return np.log(trusted / trusted.sum()) - np.log(raw / raw.sum())


def repeated_words(ids: np.ndarray, n: int, window: int = 5) -> int:
    """Words that stand in a window found twice or more; ids below n tell words apart."""
    if len(ids) < window + 1 or n == len(ids):
        return 0
    if n**window < 1 << 63:
        key = np.zeros(len(ids) - window + 1, np.int64)
        for i in range(window):
            key = key * n + ids[i : i + len(key)]
    else:  # number the windows of two words, of three, and so on: no key leaves 64 bits
        key = ids
        for i in range(1, window):
            key = np.unique(key[:-1] * np.int64(n) + ids[i : i + len(key) - 1], return_inverse=True)[1]
    order = np.sort(key)
    if not (order[1:] == order[:-1]).any():
        return 0
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[inverse] > 1)
    cover = np.zeros(len(ids) + 1, np.int64)
    cover[at] += 1
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    index = dict.fromkeys(words)
    index = dict(zip(index, range(len(index))))
    ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    solid = text.translate(None, SPACE)
    chars = len(solid) if solid.isascii() else len(solid.decode("utf-8", "surrogatepass"))
    return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(ids, len(index))


def base_failed(n_words, n_repeat_words):
    """Of columns or of numbers."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT * n_words)


def measured(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, gram: int = GRAM, buckets: int = BUCKETS, most: int | None = None) -> DataFrame:
    """Columns "row" (all of docs) and FIELDS for every row of docs.

    trusted_ids: one column of ids, all of which count; with ``most``, more of them are an error. Trusted
    texts are written once, by a join that is shuffled however few the ids are.
    """
    spark = docs.sparkSession
    known = shuffled(trusted_ids.toDF("trusted_id").distinct())
    if most is not None and known.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} trusted ids")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = ["score", "n"]
    own_texts = materialize(rows.join(known, F.col("id") == F.col("trusted_id"), "left_semi").select("text"), "trusted")
    both = gram_counts(rows.select("text", F.lit(False).alias("trusted")), gram, buckets).select("bucket", "raw", "trusted")
    both = both.unionByName(gram_counts(own_texts.select("text", F.lit(True).alias("trusted")), gram, buckets).select("bucket", F.lit(0).cast("long").alias("raw"), "trusted"))
    counts = both.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).toArrow()  # a row per bucket
    raw, good = np.zeros(buckets), np.zeros(buckets)
    at = np.asarray(counts.column("bucket"))
    raw[at], good[at] = np.asarray(counts.column("raw")), np.asarray(counts.column("trusted"))
    raw, good = raw + 1, good + (good.sum() / raw.sum() if good.any() else 1)
    sent_counts = spark.sparkContext.broadcast((raw, good))

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """score, n: of each trusted text that the base rules keep."""
        raw, trusted = sent_counts.value
        for b in batches:
            out = []
            for t in b.column("text"):
                text = t.as_py().encode("utf-8", "surrogatepass") if t.is_valid else b""
                words, _, _, _, repeated = base_counts(text)
                if len(text) >= gram and not base_failed(words, repeated):
                    out.append((left_out_score(text, raw, trusted, gram), len(text) - gram + 1))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.float64(), pa.int64()))], names)

    fit = fit_cut(materialize(own_texts.mapInArrow(left_out, "score double, n long"), "left-out"))
    scaled = np.log(good / good.sum()) - np.log(raw / raw.sum())
    sent = spark.sparkContext.broadcast((*(np.rint(x * FIXED).astype(np.int64) for x in (log_ratio(counts, buckets), scaled)), fit))  # two numbers per bucket

    def judge():
        ratio, scaled, fit = sent.value

        def run(texts: pa.Array) -> list[pa.Array]:
            text, ends = _bytes(texts)
            h = gram_buckets(text, gram, buckets)
            whole, last = _whole(ends, len(h), gram), np.minimum(ends, len(h))
            n = np.maximum(np.diff(ends) - gram + 1, 0)

            def mean(of: np.ndarray) -> np.ndarray:
                sums = np.concatenate([[0], np.cumsum(np.where(whole, of[h], 0))]) if len(h) else np.zeros(1, np.int64)
                return (sums[last[1:]] - sums[last[:-1]]) / (FIXED * np.maximum(n, 1))

            base = np.array([base_counts(t.as_py().encode("utf-8", "surrogatepass") if t.is_valid else b"") for t in texts], np.int64).reshape(-1, 5)
            return [*(pa.array(base[:, i]) for i in range(5)), pa.array(mean(ratio)), pa.array(mean(scaled)), pa.array(cuts(fit, n))]

        return run

    return annotate(docs, text_col, judge, FIELDS)


def verdicts(docs: DataFrame, trusted_ids: DataFrame, **options) -> DataFrame:
    """measured() with base_failed and kept for every row.

    A null text counts as empty: it has no words and fails the base rules. Repeated rows get equal
    verdicts. Without trusted rows every ratio is 0 and the base rules decide alone. No rows give
    no rows.
    """
    out = measured(docs, trusted_ids, **options)
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("margin") >= F.col("cut")))


def trusted(labels: DataFrame) -> DataFrame:
    """All ids labelled good."""
    return labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


#: The former name.
trusted_sample = trusted


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = verdicts(docs, trusted(table(spark, sf_dir, "labels")))
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
