from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import no_docs, odd_docs
from tideweave.llm import toxicity
from tideweave.llm.common import crc_fold, table


def term_weights(examples):
    """idf * G of every word of the sample, from the textbook formulas."""
    n, positive = len(examples), sum(y for _, y, _ in examples)
    out = {}
    for w in {w for _, _, c in examples for w in c}:
        has, a = sum(w in c for _, _, c in examples), sum(w in c for _, y, c in examples if y)
        table = ((a, has, positive), (has - a, has, n - positive), (positive - a, n - has, positive), (n - positive - has + a, n - has, n - positive))
        g = 2 * sum(o * math.log(o * n / (row * column)) for o, row, column in table if o > 0)
        out[w] = (math.log((n + 1) / (has + 1)) + 1) * max(g, 0.0)
    return out


def vector(weights, counts):
    v = {w: (1 + math.log(k)) * weights[w] for w, k in counts.items() if w in weights}
    length = math.sqrt(sum(x * x for x in v.values()))
    return {w: x / length for w, x in v.items() if x} if length else {}


def brute_cosines(weights, examples, counts):
    q = vector(weights, counts)
    found = ((sum(x * v.get(w, 0.0) for w, x in q.items()), i, y) for i, y, v in examples)
    return sorted((-round(s, 10), i, y) for s, i, y in found if s > 0)


def brute_score(index, ranked):
    """Vote of the k nearest and the logistic, from their definitions."""
    if not ranked:
        return index.share
    share, own = index.share, [(-s * index.class_weight[y], y) for s, _, y in ranked]
    odds = (sum(c for c, y in own if y) + index.prior_weight * share) / (sum(c for c, y in own if not y) + index.prior_weight * (1 - share))
    a, b = index.scale
    return 1 / (1 + math.exp(-(a * math.log(odds) + b)))


def random_examples(rng, n):
    return [(i, rng.randint(0, 1), Counter({f"w{rng.randrange(40)}": rng.randint(1, 4) for _ in range(rng.randint(0, 6))})) for i in range(n)]


@pytest.mark.parametrize("block", [4, 16, 1000])
def test_block_max_search_is_exact(block):
    rng = random.Random(5)
    examples = random_examples(rng, 500)
    index = toxicity.Index(examples, 0.5, k=15, block=block)
    weights = term_weights(examples)
    assert all(np.isclose(index.term_weight[np.searchsorted(index.keys, toxicity._keys([w])[0])], x) for w, x in weights.items())
    known = [(i, y, vector(weights, c)) for i, y, c in examples]
    for _ in range(200):
        counts = Counter({f"w{rng.randrange(45)}": rng.randint(1, 5) for _ in range(rng.randint(0, 5))})
        at, cos = index.nearest(counts)
        want = brute_cosines(weights, known, counts)
        assert np.allclose([-w[0] for w in want[:15]], cos)
        if want:
            sure = {w[1] for w in want[:15] if w[0] < want[: 15][-1][0]}  # above the last score, whose ties rounding may part
            assert sure <= set(index.ids[at].tolist())


def test_every_document_against_brute_force(spark):
    """All documents' scores from plain TF-IDF neighbours over the same sample, without index or pruning."""
    d = "/root/testdata/sf0.001"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").where(crc_fold("doc_id") != 0)
    examples, share = toxicity.labelled_sample(docs, labels)
    index = toxicity.Index(examples, share)
    weights = term_weights(examples)
    known = [(i, y, vector(weights, c)) for i, y, c in examples]
    got = {r.doc_id: r.score for r in toxicity.op4_toxicity(spark, d).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        ranked = brute_cosines(weights, known, toxicity.words(r.text))
        if len(ranked) <= 15 or ranked[14][0] < ranked[15][0]:
            assert math.isclose(got[r.doc_id], brute_score(index, ranked[:15]), rel_tol=1e-6, abs_tol=1e-9)


def test_scores_do_not_depend_on_partitions(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels")
    runs = [{(r.doc_id, r.score, tuple(r.evidence)) for r in toxicity.score(docs.repartition(n), toxicity.build_index(docs.repartition(n, "text"), labels.repartition(n))).select("row.doc_id", "score", "evidence").collect()} for n in (1, 5)]
    assert runs[0] == runs[1]


def test_held_out_accuracy_and_calibration(spark):
    d = "/root/testdata/sf0.1"
    out = toxicity.op4_toxicity(spark, d).toPandas().set_index("doc_id")
    labels = table(spark, d, "labels").toPandas().drop_duplicates("doc_id").set_index("doc_id")
    assert len(out) == table(spark, d, "documents").count()
    assert out.score.between(0, 1).all() and ((out.score >= 0.5) == (out.predicted == 1)).all()
    held = out[out.held_out].join(labels, how="inner")
    toxic, clean = held[held.toxic == 1], held[held.toxic == 0]
    assert (toxic.predicted == 1).mean() > 0.9 and (clean.predicted == 0).mean() > 0.985
    rate = held.toxic.mean()
    assert ((held.score - held.toxic) ** 2).mean() < 0.2 * rate * (1 - rate)  # Brier score against always saying the rate
    assert abs(held.score.mean() - rate) < 0.02


def test_limits_of_the_sample(spark):
    rows = [(i, f"word{i} text of it {'bad' if i % 4 == 0 else 'good'}") for i in range(100)]
    docs = spark.createDataFrame([*rows, (4, "a second text of the id"), (1000, rows[8][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(100)] + [(1000, 1)], "doc_id long, toxic int")
    got, share = toxicity.labelled_sample(docs, labels, examples=20)
    assert len(got) in (19, 20) and sum(y for _, y, _ in got) in (9, 10) and math.isclose(share, 26 / 101)
    every, _ = toxicity.labelled_sample(docs, labels)
    assert {i for i, _, _ in every} == set(range(100))  # 1000 has the words and label of 8
    assert next(c for i, _, c in every if i == 4) == toxicity.words("a second text of the id")
    few, _ = toxicity.labelled_sample(docs, labels, sample_bytes=200)
    assert 0 < len(few) < 12 and {i for i, _, _ in few} <= set(range(100))


def test_odd_inputs(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 1), (4, 1, None), (None, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    scored = toxicity.score(docs, toxicity.build_index(docs, labels))
    rows = scored.select("row.*", "score").toDF(*docs.columns, "own")
    assert rows.count() == docs.count()
    blank = {r.own for r in rows.where("text is null or trim(text) = ''").collect()}
    assert 0.5 in blank  # the share of toxic rows, for texts without a word
    nothing = toxicity.score(docs, toxicity.build_index(docs, labels.limit(0)))
    assert {r.score for r in nothing.select("score").collect()} == {0.0}
    assert toxicity.score(no_docs(spark), toxicity.build_index(no_docs(spark), labels)).count() == 0


def test_words():
    assert toxicity.words("Abc abc, x") == {"abc": 2, "x": 1} and toxicity.words(None) == {}
