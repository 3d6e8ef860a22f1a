from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tideweave.operators import counters
from tideweave.streaming import merges, processors


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", processors.ROCKSDB)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def stream_of(spark, rows, schema, folder, parts):
    """A file stream that gives the rows in so many batches."""
    for i in range(parts):
        spark.createDataFrame(rows[i::parts], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_counters_with_repeats_and_disorder(spark, tmp_path):
    rng = random.Random(1)
    rows = [(c, r, rng.randint(0, 50), rng.randint(0, 9)) for c in "xy" for r in "abc" for _ in range(5)] * 2
    rng.shuffle(rows)
    schema = "counter string, replica string, inc long, dec long"
    s = stream_of(spark, rows, schema, tmp_path / "in", 4)
    merges.run_available(merges.counters(s), "counters_out", "complete", checkpoint=str(tmp_path / "cp"))
    got = {tuple(r) for r in spark.table("counters_out").collect()}
    assert got == {tuple(r) for r in counters.join(spark.createDataFrame(rows, schema)).select("counter", "replica", "inc", "dec").collect()}


def test_keyed_table_is_idempotent(spark, tmp_path):
    rows = [("k", i, "r", f"v{i}") for i in (3, 9, 1)] + [("l", 2, "q", "w")]
    schema = "key string, ts_ms long, replica string, value string"
    s = stream_of(spark, rows, schema, tmp_path / "in", 2)
    from tideweave.operators.registers import lww_join

    sink = merges.keyed_table(str(tmp_path / "state"), ["key"], lww_join)

    def twice(batch, i):
        sink(batch, i)
        sink(batch, i)

    merges.run_available(s, "lww", sink=twice, checkpoint=str(tmp_path / "cp"))
    last = spark.read.parquet(str(tmp_path / "state" / "v1"))
    assert {tuple(r) for r in last.collect()} == {("k", 9, "r", "v9"), ("l", 2, "q", "w")}


def test_removed_tags_stay_removed(spark, tmp_path):
    rows = [("r", 1, 0, "s", "remove", "e", "a", 1), ("a", 1, 0, "s", "add", "e", "a", 1), ("b", 1, 0, "s", "add", "e", "b", 1)]
    s = stream_of(spark, rows, "replica string, seq long, ts_ms long, set_id string, kind string, element string, tag_replica string, tag_seq long", tmp_path / "in", 3)
    merges.run_available(merges.tags(s), "tags_out", "complete", checkpoint=str(tmp_path / "cp"))
    assert {(r.tag_replica, r.live) for r in spark.table("tags_out").collect()} == {("a", False), ("b", True)}


def test_windows(spark, tmp_path):
    ev = spark.range(20).select(F.timestamp_seconds(F.col("id") * 600).alias("ts"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("event_type"), F.lit("u").alias("user_id"))
    ev.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    merges.run_available(merges.activity(s), "activity_out", "update", checkpoint=str(tmp_path / "cp"))
    assert sum(r.n for r in spark.table("activity_out").collect()) == 20
    merges.run_available(merges.sessions(s, "5 minutes"), "sessions_out", "append", checkpoint=str(tmp_path / "cp2"))
    assert all(r.n == 1 for r in spark.table("sessions_out").collect())


def test_causal_delivery(rocks, tmp_path):
    rng = random.Random(3)
    spans = [("a", "b", i * 10, i * 10 + 10, f"p{i}") for i in range(12) if i != 9]
    rows = spans + rng.sample(spans, 5)
    rng.shuffle(rows)
    s = stream_of(rocks, rows, "from_replica string, to_replica string, from_seq long, to_seq long, payload string", tmp_path / "in", 4)
    merges.run_available(processors.causal_delivery(s), "causal_out", "append", checkpoint=str(tmp_path / "cp"))
    got = [r.payload for r in rocks.table("causal_out").orderBy("acked").collect()]
    assert got == [f"p{i}" for i in range(9)]  # up to the gap, each once


def test_delta_buffer_and_seen_set(rocks, tmp_path):
    rows = [("r", "peer", 0, "p", None, 1), ("r", "peer", 0, "q", None, 2)] + [("r", "delta", i, None, f"d{i}", 2 + i) for i in range(1, 6)] + [("r", "ack", 3, "p", None, 20), ("r", "ack", 2, "q", None, 21), ("r", "ack", 5, "stranger", None, 22)]
    s = stream_of(rocks, rows, "replica string, kind string, seq long, peer string, payload string, arrival long", tmp_path / "in", 1)
    merges.run_available(processors.delta_buffers(s), "buffer_out", "update", checkpoint=str(tmp_path / "cp"))
    assert {(r.peer, r.from_seq, r.to_seq, tuple(r.payloads)) for r in rocks.table("buffer_out").collect()} == {("p", 3, 5, ("d4", "d5")), ("q", 2, 5, ("d3", "d4", "d5"))}
    ids = [("r", f"m{i % 4}", i) for i in range(12)]
    s = stream_of(rocks, ids, "replica string, id string, arrival long", tmp_path / "in2", 3)
    merges.run_available(processors.first_seen(s), "seen_out", "append", checkpoint=str(tmp_path / "cp2"))
    assert sorted(r.id for r in rocks.table("seen_out").collect()) == ["m0", "m1", "m2", "m3"]
