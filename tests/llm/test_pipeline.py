from __future__ import annotations

from collections import Counter

import corpus_pipeline
from tests.llm.helpers import odd_docs
from tests.llm.test_neardup import brute
from tideweave.llm import quality, toxicity
from tideweave.llm.common import crc_fold, table


def test_stages_in_order(spark, tmp_path):
    d = "/root/testdata/sf0.01"
    docs = table(spark, d, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality rules", "n-gram Jaccard join", "best-fit packing"]
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if i < 3:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept.append(docs)
    first = table(spark, d, "documents")
    scored = toxicity.score(first, toxicity.build_index(first, table(spark, d, "labels").where(crc_fold("doc_id") != 0)))
    assert {r.doc_id for r in kept[0].collect()} == {r.doc_id for r in scored.where("predicted = 0").select("row.doc_id").collect()}
    judged = quality.verdicts(kept[0], quality.trusted_sample(table(spark, d, "labels")))
    assert {r.doc_id for r in kept[1].collect()} == {r.doc_id for r in judged.where("kept").select("row.doc_id").collect()}
    rows = [(r.doc_id, r.text) for r in kept[1].collect()]
    heads = {c for _, c, _ in brute(rows)}
    assert Counter(r.doc_id for r in kept[2].collect()) == Counter(heads)
    pieces = kept[3].toPandas()
    assert set(pieces.doc_id) == heads
    assert pieces.groupby("sequence_id").length.sum().max() <= 1024
    run = corpus_pipeline.run(spark, d).toPandas()
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, run[cols].to_numpy())) == sorted(map(tuple, pieces[cols].to_numpy()))


def test_odd_documents_pass_through(spark):
    d = "/root/testdata/sf0.001"
    docs = odd_docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, d)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = spark.createDataFrame(docs.collect(), "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.STAGES[3][1](spark, docs, d).count() >= docs.count() > 0


def test_empty_tables(spark, tmp_path):
    """No documents give no rows; without labels the base rules and the copies alone decide."""
    d = "/root/testdata/sf0.001"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    for name, some in (("none", 0), ("unlabelled", 60)):
        docs.limit(some).write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.limit(0).write.parquet(str(tmp_path / name / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    rows = [(r.doc_id, r.text) for r in table(spark, str(tmp_path / "unlabelled"), "documents").collect()]
    good = [x for x in rows if not quality.base_failed(*(lambda b: (b[0], b[4]))(quality.base_counts((x[1] or "").encode())))]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / "unlabelled")).collect()} == {c for _, c, _ in brute(good)}


def test_rows_of_equal_id_and_text(spark):
    rows = [(1, "ten words stand in this text so that it stays here", "en", s, 1) for s in ("b", "a", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.source for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()] == ["a"]
