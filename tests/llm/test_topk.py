from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideweave.llm import topk


def brute(rows, is_query, k):
    good = [(i, [int(np.floor(1024 * np.float64(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in good if is_query(i)}:
        s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:k]
        out += [(q, r + 1, i, -n) for r, (n, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("n,dims,slices,block", [(300, 16, 4, 8192), (40, 5, 3, 2), (7, 1, 4, 8192), (300, 8, 1, 2)])
def test_against_brute_force(spark, n, dims, slices, block):
    rng = np.random.default_rng(n + slices)
    rows = [(i, rng.normal(size=dims).astype("f4").tolist()) for i in range(n)]
    rows[3] = (3, rows[2][1])  # ties
    rows += [(n + 1, None), (n + 2, [None] + [0.5] * (dims - 1)), (n + 3, [float("inf")] * dims), (n + 4, [float("nan")] * dims)]
    df = spark.createDataFrame([(i, v, i, 0.5) for i, v in rows], "vec_id long, embedding array<float>, row long, score double").repartition(5)
    got = topk.search(df, F.col("vec_id") % 10 == 0, slices=slices, query_block=block)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 10 == 0, 10)


def test_repeated_rows_and_negative_scores(spark):
    rows = [(0, [1.0, 1.0])] + [(i, [-float(i % 4), -1.0]) for i in range(1, 30)] + [(5, [-1.0, -1.0])] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.search(df, F.col("vec_id") == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i == 0, 10)


def test_large_components_stay_exact(spark):
    rows = [(0, [2e6, 1.0]), (1, [1e6, -5.0]), (2, [1e6, 7.0]), (3, [2.5, 0.0])]  # products beyond 2^53
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.search(df, F.col("vec_id") == 0).collect())) == brute(rows, lambda i: i == 0, 10)


def test_scores_beyond_64_bits_are_an_error(spark):
    df = spark.createDataFrame([(0, [3e9]), (1, [3e9])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        topk.search(df, F.col("vec_id") == 0)


def test_lists_do_not_grow_with_the_rows():
    """Over many chunks a partition keeps k partial scores per query and slice, the best ones."""
    rng = np.random.default_rng(4)
    scores = rng.integers(-50, 50, (2, 3, 1000))
    best = topk.Best(3, 2, 10)
    mine = rng.random((3, 1000)) < 0.9
    for s in range(0, 1000, 7):
        best.add(scores[..., s : s + 7], np.arange(s, min(s + 7, 1000)), mine[:, s : s + 7])
    got = best.batch(5).to_pandas()
    assert len(got) == 2 * 3 * 11
    for j in range(2):
        for q in range(3):
            own = got[(got.q == q + 5) & (got.slice == j)]
            assert sorted(own[own.row.notna()].partial) == sorted(scores[j, q][mine[q]])[-10:] and own[own.row.isna()].partial.item() == scores[j, q][mine[q]].min()


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(none, F.col("vec_id") % 100 == 0).count() == 0
    one = spark.createDataFrame([(100, [1.0])], "vec_id long, embedding array<float>")
    assert topk.search(one, F.col("vec_id") % 100 == 0).count() == 0
