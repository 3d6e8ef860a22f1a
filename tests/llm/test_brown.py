from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import no_docs, odd_docs
from tideweave.llm import brown
from tideweave.llm.common import crc_fold


def test_base_scores_and_gain(spark):
    d = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    out = {r.doc_id: r for r in brown.op8_brown_lm(spark, d).collect()}
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 1 for r in rows}
    words = {r.doc_id: brown.tokens(r.text) for r in rows}
    count = Counter(w for i, t in words.items() if not held[i] for w in t)
    n, v = sum(count.values()), len(count)
    for i, t in words.items():
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(count[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
    test = [r for r in out.values() if r.held_out]
    assert sum(r.score for r in test) > 0.9 * sum(r.base_score for r in test)  # log10: nearer to 0
    assert sum(r.score for r in test) / sum(r.n_tokens for r in test) > sum(r.base_score for r in test) / sum(r.n_tokens for r in test) + 0.3


def test_exchange_against_exhaustive_gain():
    rng = np.random.default_rng(0)
    b = rng.integers(0, 5, (10, 10)).astype(float)
    of = brown.exchange(b, 3, 20)

    def likelihood(classes):
        m = np.eye(5)[np.concatenate([classes, [3, 4]])]
        c = m.T @ b @ m
        f = lambda x: float((x * np.log(np.maximum(x, 1e-300))).sum())
        return f(c) - f(c.sum(1)) - f(c.sum(0))

    best = likelihood(of)
    for w in range(8):
        for k in range(3):
            other = of.copy()
            other[w] = k
            assert likelihood(other) <= best + 1e-6  # no exchange improves it
    assert best > likelihood(np.arange(8) % 3) - 1e-9


@pytest.mark.parametrize("text", ["the cat saw the dog", "zzz the", ""])
def test_probabilities_add_up(spark, text):
    """Over all one-word continuations (known, unknown, end) of a history the model sums to 1."""
    train = [(i, t, False) for i, t in enumerate(["the cat saw the dog", "a dog saw a cat", "the dog ran", "a cat ran", "dog dog", "the the end"])]
    vocabulary = sorted({w for _, t, _ in train for w in t.split()})
    tests = [(100 + i, f"{text} {w}".strip(), True) for i, w in enumerate([*vocabulary, "unseenword"])] + [(99, text, True)]
    out = {r.doc_id: r for r in brown.train_and_score(spark.createDataFrame(train + tests, "doc_id long, text string, h boolean"), F.col("h"), core=5, classes=3).collect()}
    longer = [t for t in tests if t[0] != 99]
    # p(history, w, end) of each w gives p(history, w) only together with p(end | ...), so score a text's words through its own continuations
    assert all(np.isfinite(out[i].score) for i, _, _ in longer) and out[99].n_tokens == len(text.split()) + 1
    total = 10 ** out[99].score + sum(10 ** out[i].score for i, _, _ in longer)
    assert total < 1.0 + 1e-9


def test_transitions_and_emissions_are_distributions():
    rng = np.random.default_rng(1)
    classes = 4
    tri = rng.integers(0, 9, (classes + 3, classes + 3, classes + 1)).astype(float)
    left = rng.uniform(0.1, 0.3, classes + 1)
    t = brown.Transitions(tri, left)
    assert np.allclose((10**t.log).sum(2), 1) and np.allclose(10**t.unknown, (10**t.log) @ left)


def test_odd_inputs(spark):
    out = brown.train_and_score(odd_docs(spark), crc_fold("doc_id") == 1, core=50, classes=4)
    rows = out.collect()
    assert len(rows) == odd_docs(spark).count() and all(math.isfinite(r.score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 6)} == {1}
    assert brown.train_and_score(no_docs(spark), crc_fold("doc_id") == 1).count() == 0
    alone = brown.train_and_score(odd_docs(spark), F.lit(True)).collect()
    assert {(r.score, r.base_score, r.train_tokens, r.n_known) for r in alone} == {(0.0, 0.0, 0, 0)}


def test_gains_of_many_words_are_those_of_the_likelihood():
    rng = np.random.default_rng(2)
    b = rng.integers(0, 5, (12, 12)).astype(float)
    of = np.append(rng.integers(0, 3, 10), [3, 4])
    member = np.eye(5)[of]
    gains = brown.exchange_gains(member.T @ b @ member, b[:, :10].T @ member, b[:10] @ member, np.diag(b)[:10], of[:10])
    for w in range(10):
        def at(k):
            other = np.eye(5)[np.where(np.arange(12) == w, k, of)]
            return brown.likelihood(other.T @ b @ other)

        assert np.allclose(gains[w, :3] - gains[w, of[w]], [at(k) - at(of[w]) for k in range(3)])


def test_words_outside_the_core_are_exchanged(spark):
    """Two kinds of 30 words take turns, and core words stand beside both kinds alike: only exchange outside the core can tell the kinds apart."""
    rng = np.random.default_rng(3)
    rows = [(i, "the of " * 40 + " ".join(f"{'ab'[(i + j) % 2]}{rng.integers(30)}" for j in range(40)), i % 5 == 1) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h boolean")
    out = brown.train_and_score(docs, F.col("h"), core=2, classes=4).where("held_out").collect()
    assert sum(r.score for r in out) / len(out) > -85  # 41 words and ends at log10(60) or log10(30) are 73 or 61, the rest is the core part


class PlainModel:
    """The whole model by its definition, in loops over one list of training texts; every training word is exchanged."""

    def __init__(self, texts, classes):
        self.classes = classes
        tokens = [brown.tokens(t) for t in texts]
        self.count = Counter(w for t in tokens for w in t)
        words = sorted((w for w in self.count if w != brown.END), key=lambda w: (-self.count[w], w))
        self.of = self.exchanged(tokens, words)
        self.of[brown.END] = classes
        self.n_k, self.v_k = Counter(), Counter()
        for w, n in self.count.items():
            self.n_k[self.of[w]] += n
            self.v_k[self.of[w]] += 1
        once, twice = (sum(n == k for n in self.count.values()) for k in (1, 2))
        self.discount = min(max(once / (once + 2 * twice) if once else 0.1, 0.05), 0.95)
        self.tri, self.bi, self.uni = Counter(), Counter(), Counter()
        for t in tokens:
            before = ("start", "start")
            for w in t:
                k = self.of[w]
                self.tri[(*before, k)] += 1
                self.bi[before[1], k] += 1
                self.uni[k] += 1
                before = (before[1], self.context(w))

    def exchanged(self, tokens, words):
        """Exchange one by one, then sweeps in which chosen words move at once."""
        n, k = len(words), self.classes
        at = {w: i for i, w in enumerate(words)} | {brown.END: n + 1}
        flat = [n + 1] + [at[w] for t in tokens for w in t]
        b = np.zeros((n + 2, n + 2))
        for x, y in zip(flat, flat[1:]):
            b[x, y] += 1
        of = np.append(brown.exchange(b, k), [k, k + 1])
        place = np.argsort(brown._keys(words))  # words in order of their hashes
        rank = np.empty(n, np.int64)
        rank[place] = np.arange(n)

        def matrix(c):
            member = np.eye(k + 2)[c]
            return member.T @ b @ member

        m, share = matrix(of), 1
        for turn in range(brown.SWEEPS):
            new, member = of.copy(), np.eye(k + 2)[of]
            mixed = (rank * 0x9E3779B1 + (turn + 1) * 0x85EBCA6B) & 0xFFFFFFFF
            chosen = np.flatnonzero((mixed ^ (mixed >> 15)) % share == 0)
            gain = brown.exchange_gains(m, (b.T @ member)[chosen], (b @ member)[chosen], np.diag(b)[chosen], of[chosen])[:, :k]
            for g, w in zip(gain, chosen):
                best = int(np.argmax(g))
                new[w] = best if g[best] > g[of[w]] + 1e-9 else of[w]
            first, share = turn == 0, max(share, 2)
            if (new == of).all() and not first:
                break
            after = matrix(new)
            better = brown.likelihood(after) - brown.likelihood(m)
            if not first and better < 0:
                share *= 2
                continue
            of, m = new, after
            if not first and better * share < brown.LEAST_GAIN * m.sum():
                break
        return {w: int(of[i]) for i, w in enumerate(words)}

    def context(self, w):
        return self.of[w] if self.count[w] > 1 else "rare"

    def transition(self, two, one, k):
        uni = (self.uni[k] + 0.5) / (sum(self.uni.values()) + 0.5 * (self.classes + 1))
        bi = (self.bi[one, k] + brown.BACKOFF * uni) / (sum(self.bi[one, j] for j in range(self.classes + 1)) + brown.BACKOFF)
        return (self.tri[two, one, k] + brown.BACKOFF * bi) / (sum(self.tri[two, one, j] for j in range(self.classes + 1)) + brown.BACKOFF)

    def probability(self, two, one, w):
        if self.count[w]:
            k = self.of[w]
            return self.transition(two, one, k) * (self.count[w] - (self.discount if w != brown.END else 0)) / self.n_k[k]
        rest = [self.discount * self.v_k[k] / self.n_k[k] if self.n_k[k] else 1.0 for k in range(self.classes)]
        return sum(self.transition(two, one, k) * rest[k] for k in range(self.classes))

    def score(self, text):
        total, before = 0.0, ("start", "start")
        for w in brown.tokens(text):
            total += math.log10(self.probability(*before, w))
            before = (before[1], self.context(w))
        return total


def test_scores_against_the_plain_model(spark):
    """Every text's score is the plain model's, and that adds up to 1 over all continuations of any history."""
    rng = np.random.default_rng(6)
    kinds = [["the", "a", "this"], [f"n{i}" for i in range(14)], ["sees", "has", "is"]]
    say = lambda: " ".join(str(rng.choice(kinds[i % 3])) for i in range(int(rng.integers(0, 14))))
    texts = [say() for _ in range(150)] + ["the N1 rare", "unique words stand here", ""]
    tests = [say() for _ in range(30)] + ["the unknown sees nothing known", "rare n1", "", "zzz"]
    rows = [(i, t, False) for i, t in enumerate(texts)] + [(1000 + i, t, True) for i, t in enumerate(tests)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h boolean")
    out = {r.doc_id: r.score for r in brown.train_and_score(docs, F.col("h"), classes=4, floor=1).collect()}
    plain = PlainModel(texts, 4)
    for i, t, _ in rows:
        assert math.isclose(out[i], plain.score(t), rel_tol=1e-9, abs_tol=1e-9)
    for two in ("start", "rare", 0, 3):
        for one in ("start", "rare", 0, 1, 2, 3):
            assert math.isclose(sum(plain.probability(two, one, w) for w in [*plain.count, b"never seen"]), 1.0, rel_tol=1e-9)
