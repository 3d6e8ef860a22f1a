from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tideweave.operators import richtext, runs, sequence
from tideweave.plans import documents

OPS = "doc_id string, kind string, id struct<seq: bigint, replica: string>, origin struct<seq: bigint, replica: string>, value string"


def random_ops(seed):
    """Concurrent typing, insertions anywhere and deletions, some before their insertion, some of what never comes, one subtree that nothing reaches."""
    rng, ops = random.Random(seed), []
    for doc in "abc":
        ids = [(0, "")]
        for i in range(1, rng.randint(2, 120)):
            new = (i + rng.randint(0, 2), rng.choice("xyz"))
            if new not in ids:
                ops.append((doc, "insert", new, ids[-1] if rng.random() < 0.6 else rng.choice(ids), rng.choice("ab\u00e9\u6771\U0001f642")))
                ids.append(new)
        ops += [(doc, "delete", i, None, None) for i in rng.sample(ids[1:], len(ids) // 5)]
        ops += [(doc, "delete", (900, "x"), None, None), (doc, "insert", (901, "x"), (950, "q"), "u")]
    rng.shuffle(ops)
    return ops


@pytest.mark.parametrize("seed", range(4))
def test_runs_against_characters(spark, seed):
    ops = spark.createDataFrame(random_ops(seed), OPS)
    want = sequence.visible(sequence.from_ops(ops))
    shown = runs.visible(runs.of_ops(ops), runs.of_ops(ops.limit(20)))
    assert {tuple(r) for r in runs.text_of(shown).collect()} == {tuple(r) for r in sequence.render(want).collect()}
    rows = {(r.doc_id, r.id, r.value, r.position) for r in want.collect()}
    assert {(r.doc_id, r.id, r.value, r.position) for r in runs.chars(shown, ids=want.select("doc_id", "id")).collect()} == rows
    assert {(r.doc_id, r.id, r.value, r.position) for r in runs.chars(shown, want.select("doc_id", F.col("position"))).collect()} == rows


def test_typed_runs_and_deletions(spark):
    docs = spark.createDataFrame([(1, "abcdefghijklmnop"), (2, "\U0001f642\u6771"), (3, ""), (4, "abcdefg"), (4, "abcdefgh")], "k long, t string")
    nodes, typed = sequence.typed_nodes(docs, "k", F.col("t")), runs.typed_runs(docs, "k", F.col("t"))
    gone = nodes.where("id.seq % 7 = 0").select("doc_id", "id", "origin", F.lit(None).cast("string").alias("value"), F.lit(True).alias("deleted"))
    want = {tuple(r) for r in sequence.text_of(sequence.join(nodes, gone)).collect()}
    assert {tuple(r) for r in runs.text_of(runs.visible(typed, runs.deleted_every(typed, 7))).collect()} == want
    slices = {tuple(r) for r in sequence.text_slice(sequence.visible(sequence.join(nodes, gone)), 3, 9).collect()}
    assert {tuple(r) for r in runs.text_slice(runs.visible(typed, runs.deleted_every(typed, 7)), 3, 9).collect()} == slices


def test_a_row_per_document(spark, sf):
    """What travels is runs: no more rows than states of documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text <> ''").count()
    assert sum(s.count() for s in documents._runs(spark, sf)) == 2 * docs and documents._lines(spark, sf).count() <= docs


def test_marks_over_ranges_are_marks_at_positions(spark):
    rng = random.Random(1)
    spans = spark.createDataFrame([("d", f"m{i}", rng.choice(("Bold", "Link")), None, None, s, s + rng.randint(0, 9000)) for i in range(30) for s in [rng.randint(0, 9000)]], "doc_id string, mark_id string, mark_kind string, a1 string, a2 string, start int, end int")
    probes = spark.createDataFrame([("d", 50, 8000, "Bold", None, None)], "doc_id string, from_pos int, to_pos int, mark_kind string, a1 string, a2 string")
    at = probes.select("doc_id", F.explode(F.sequence("from_pos", F.col("to_pos") - 1)).alias("position"), "mark_kind", "a1", "a2")
    want = {(r.mark_id, r.n, r.p) for r in richtext.marks_at(spans, at.select("doc_id", "position")).groupBy("mark_id").agg(F.count(F.lit(1)).alias("n"), F.sum("position").alias("p")).collect()}
    over = richtext.marks_over(spans, probes.select("doc_id", "from_pos", "to_pos")).collect()
    assert {(r.mark_id, r.until - r.since, sum(range(r.since, r.until))) for r in over} == want
    every = {tuple(r) for r in richtext.has_mark(spans, at.where("position % 100 = 0")).select("position", "mark_kind").collect()}
    assert {tuple(r) for r in richtext.has_mark_every(spans, probes, 100).select("position", "mark_kind").collect()} == every
    text = "".join(rng.choice("ab") for _ in range(20_000))
    chars = spark.createDataFrame([("d", c, i) for i, c in enumerate(text)], "doc_id string, value string, position int")
    assert richtext.html_of(spans, spark.createDataFrame([("d", text)], "doc_id string, text string")).first().html == richtext.to_html(spans, chars).first().html
