from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import no_docs, odd_docs
from tideweave.llm import quality
from tideweave.llm.common import table


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            repeated |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


@pytest.mark.parametrize("seed", range(40))
def test_base_counts(seed):
    rng = np.random.default_rng(seed)
    vocabulary = ["a", "b", "éè", "#x*", "\x0b", "<|>", " ", "🙂"][: rng.integers(1, 9)]
    text = "".join(rng.choice([*vocabulary, " ", "\n", "\t"]) + rng.choice(["", " ", "\n"]) for _ in range(rng.integers(0, 200)))
    assert quality.base_counts(text.encode()) == brute_base(text)


def test_repeated_words_with_many_distinct_words():
    ids = np.concatenate([np.arange(9000), np.arange(100, 110), np.arange(9000, 9100)])
    few = np.concatenate([np.arange(90), np.arange(10, 20)])
    assert quality.repeated_words(ids, 9100) == 20 and quality.repeated_words(few, 90) == 20


def test_ratio_against_brute_force(spark):
    docs = odd_docs(spark)
    trusted = spark.createDataFrame([(1,), (4,)], "doc_id long")
    out = quality.verdicts(docs, trusted, buckets=256)
    rows = [(r.row.text or "", r.llr, r.row.doc_id) for r in out.collect()]
    assert len(rows) == docs.count()
    raw, good = np.ones(256), np.ones(256)
    for text, _, i in rows:
        h = quality.gram_buckets(np.frombuffer(text.encode(), np.uint8), 3, 256)
        raw += np.bincount(h, minlength=256)
        if i in (1, 4):
            good += np.bincount(h, minlength=256)
    ratio = np.log(good / good.sum()) - np.log(raw / raw.sum())
    for text, llr, _ in rows:
        h = quality.gram_buckets(np.frombuffer(text.encode(), np.uint8), 3, 256)
        assert np.isclose(llr, ratio[h].mean() if len(h) else 0.0)


def test_clean_documents_stay_and_junk_goes(spark):
    d = "/root/testdata/sf0.01"
    out = quality.op5_quality_rules(spark, d).toPandas().set_index("doc_id")
    texts = table(spark, d, "documents").toPandas().set_index("doc_id").text
    labels = table(spark, d, "labels").toPandas().set_index("doc_id")
    for i in out.index:
        r = out.loc[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_base(texts[i])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    both = out[~out.base_failed].join(labels, how="inner")
    assert both[both.quality == 1].kept.mean() > 0.99
    assert both[both.quality == 0].kept.mean() < 0.2


def test_empty_and_untrusted(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert quality.verdicts(no_docs(spark), none).count() == 0
    assert {r.llr for r in quality.verdicts(odd_docs(spark), none).collect()} == {0.0}


def test_rare_junk_goes(spark):
    """One document in 500, 0.1% of the bytes, is junk; clean ones, trusted or not, long or short, stay."""
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("aeinorst"), rng.integers(2, 8))) for _ in range(400)]
    docs = [(i, " ".join(rng.choice(words, rng.integers(40, 800)))) for i in range(500)]
    docs.append((500, " ".join("".join(chr(c) for c in rng.integers(33, 127, 6)) for _ in range(180))))
    assert len(docs[-1][1]) < 0.0015 * sum(len(t) for _, t in docs)
    trusted = spark.createDataFrame([(i,) for i in range(0, 500, 4)], "doc_id long")
    out = {r.doc_id: r for r in quality.verdicts(spark.createDataFrame(docs, "doc_id long, text string"), trusted).select("row.doc_id", "kept", "base_failed").collect()}
    assert not out[500].kept and not out[500].base_failed
    assert sum(not r.kept for r in out.values()) <= 3


def test_a_text_scores_the_same_wherever_it_stands(spark):
    """Beside other texts, at any place in a block, in any partition: the same bits."""
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("aeinorst"), rng.integers(2, 8))) for _ in range(300)]
    fill = [" ".join(rng.choice(words, 3000)) for _ in range(60)]
    own = " ".join(rng.choice(words, 200))
    texts = [own, *fill[:30], own, *fill[30:], own]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    trusted = spark.createDataFrame([(i,) for i in range(1, 40)], "doc_id long")
    seen = {(r.llr, r.margin, r.cut) for parts in (1, 3) for r in quality.verdicts(docs.repartition(parts), trusted).where("row.doc_id in (0, 31, 62)").collect()}
    assert len(seen) == 1


def test_trusted_ids_are_bounded(spark):
    with pytest.raises(ValueError, match="more than 3"):
        quality.verdicts(odd_docs(spark), spark.range(9), most=3)


def test_all_trusted_documents_count(spark, monkeypatch):
    """More ids than a former sample had room for; quantiles are numpy's, whatever comes to the driver."""
    labels = spark.range(20_050).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert quality.trusted(labels).count() == 20_050
    assert quality.verdicts(odd_docs(spark), quality.trusted(labels)).count() == odd_docs(spark).count()
    rng = np.random.default_rng(2)
    for values in (rng.normal(size=999), np.round(rng.normal(size=500), 1), np.ones(5), np.append(np.zeros(90), 1e9)):
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        for few in (20, 10_000):
            monkeypatch.setattr(quality, "FEW_VALUES", few)
            for share in (0.001, 0.5, 0.77):
                assert np.isclose(quality.quantile(df, share), np.quantile(values, share), rtol=1e-12, atol=1e-12)
