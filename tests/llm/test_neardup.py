from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import no_docs, odd_docs
from tideweave.llm import neardup


def brute(rows):
    """{row number: (class, links)} over (id, text) rows; classes are the least ids, null last."""
    sets = []
    for _, text in rows:
        w = (text or "").split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    root, links = list(range(len(rows))), Counter()

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, s in enumerate(sets):
        for j, n in Counter(x for g in s for x in holders[g]).items():
            if i != j and 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                links[i] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append((d is None, d if d is not None else 0))
    return [(rows[i][0], None if min(least[find(i)])[0] else min(least[find(i)])[1], links[i]) for i in range(len(rows))]


def near_copies(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, base = [], [rng.choice(vocabulary) for _ in range(120)]
    for i in range(n):
        kind = rng.random()
        if kind < 0.5:  # near copies of one text, in every degree
            w = list(base)
            for _ in range(rng.randint(0, 12)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        elif kind < 0.7:
            w = base
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("tile,broadcast_rows", [(4, 1 << 20), (256, 0)])
def test_against_brute_force(spark, tile, broadcast_rows):
    rows = near_copies(7, 160) + [(None, "only five words stand here"), (None, "only five words stand here"), (200, None), (201, ""), (202, "one two"), (203, "one two"), (204, "two one")]
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tile=tile, broadcast_rows=broadcast_rows).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r.id, r.class_id, r.n_links) for r in got), key=key) == sorted(brute(rows), key=key)


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, neardup.op6_ngram_jaccard(spark, sf).collect()))
    assert got == sorted(brute([tuple(r) for r in docs]))


def test_one_row_of_each_class_stays(spark):
    docs = odd_docs(spark)
    kept = neardup.keepers(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted((i or -1) for i in ids) == [-1, 1, 2, 3, 4, 6, 7]
    assert neardup.keepers(no_docs(spark)).count() == 0
    assert sorted(map(repr, neardup.keepers(docs, broadcast_rows=0).collect())) == sorted(map(repr, kept.collect()))
    twice = spark.createDataFrame([(1, "some words of it", "b"), (1, "some words of it", "a"), (2, "some words of it", "0"), (3, "other", None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.source) for r in neardup.keepers(twice).collect()) == [(1, "a"), (3, None)]


def test_chains_do_not_grow_together(spark):
    """5,000 texts, each like the next at a similarity below the threshold: pair work stays near linear, and nothing is linked."""
    rng = random.Random(3)
    words, rows = [f"w{rng.randrange(10**9)}" for _ in range(5000 * 10 + 100)], []
    for i in range(5000):
        rows.append((i, " ".join(words[10 * i : 10 * i + 100])))  # 96 n-grams, 86 shared with the next: 0.81 if all of them were
    rows = [(i, t + f" x{i} y{i}") for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sig = neardup.signatures(docs, "doc_id", "text", 5, neardup.bands_for(0.8, 0.9995, 5), 5).groupBy("node").agg(F.first("bands").alias("bands"))
    groups = neardup.candidate_groups(sig).selectExpr("explode(groups) AS g").groupBy("g.label").count()
    sizes = [r["count"] for r in groups.collect()]
    assert sum(sizes) > 5000  # nearly all collide with a neighbour
    assert sum(n * n for n in sizes) < 100 * 5000 and max(sizes) < 60
    assert {r.n_links for r in neardup.classes(docs).collect()} == {0}


def test_bands_reach_the_recall():
    for s, recall, rows in ((0.8, 0.9995, 5), (0.5, 0.9, 2), (0.95, 0.99, 10)):
        b = neardup.bands_for(s, recall, rows)
        assert 1 - (1 - s**rows) ** b >= recall and (b == 1 or 1 - (1 - s**rows) ** (b - 1) < recall)
