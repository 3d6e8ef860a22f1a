"""Queries that run over the event log as a stream, to its end, and give what the batch form gives."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tideweave.operators import counters, lattice
from tideweave.plans import graphs, lattices, protocols
from tideweave.plans.sql import EV
from tideweave.sources import logs
from tideweave.sources.shared import shared_dir, shared_path
from tideweave.streaming import merges, processors


def _events(spark, d):
    """The event log as a stream of files."""
    path = f"{d}/events.parquet"
    return logs.derived_events(spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*"))


def _result(stream, kind):
    """The final table of a stream in complete mode; its state has a row per key."""
    name = f"{kind}_{uuid.uuid4().hex[:8]}"
    merges.run_available(stream, name, "complete", checkpoint=f"{shared_dir(stream.sparkSession)}/streams/{name}")
    return stream.sparkSession.table(name)


def stream_counters(spark, d):
    ops = logs.counter_ops(_events(spark, d))
    return _result(counters.from_ops(ops), "counters").select("counter", "replica", "inc", "dec")


def stream_registers(spark, d):
    return _result(merges.registers(logs.register_ops(_events(spark, d)).select("key", "ts_ms", "replica", "value")), "registers")


def stream_vectors(spark, d):
    return _result(merges.vectors(_events(spark, d).select("replica", F.col("event_id").alias("seq"))), "vectors")


def stream_presence(spark, d):
    return _result(merges.presence(logs.presence_events(_events(spark, d))), "presence").select("user_id", "clock", "status")


def _replayed(df, kind):
    """A log written to the shared folder and read as a stream of files."""
    path = shared_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def _stateful(stream, kind, mode):
    """The output of a stateful processor over a stream to its end; it needs the RocksDB state store."""
    spark, name = stream.sparkSession, f"{kind}_{uuid.uuid4().hex[:8]}"
    option = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(option, None)
    spark.conf.set(option, processors.ROCKSDB)
    try:
        merges.run_available(stream, name, mode, checkpoint=f"{shared_dir(spark)}/streams/{name}")
    finally:
        if before is None:
            spark.conf.unset(option)
        else:
            spark.conf.set(option, before)
    return spark.table(name)


def stream_causal_delivery(spark, d):
    """Intervals with gaps and repeats: what is delivered, in order and once, up to each sender's first gap."""
    sent = graphs._intervals(spark, d).select("from_replica", "to_replica", "from_seq", "to_seq", F.concat(F.lit("p"), F.col("to_seq").cast("string")).alias("payload"))
    return _stateful(processors.causal_delivery(_replayed(sent, "intervals")), "causal", "append")


def stream_first_seen(spark, d):
    messages = _events(spark, d).select("replica", F.concat(F.lit("m"), F.col("k").cast("string")).alias("id"), F.col("event_id").alias("arrival"))
    return _stateful(processors.first_seen(messages), "seen", "append")


def stream_delta_buffers(spark, d):
    """Deltas of every replica for two peers, of which p0 has acknowledged half."""
    log = graphs._log(spark, d)
    null = F.lit(None)
    deltas = log.select("replica", F.lit("delta").alias("kind"), "seq", null.cast("string").alias("peer"), F.col("k").cast("string").alias("payload"), (F.col("seq") + 10).alias("arrival"))
    names = log.groupBy("replica").agg(F.max("seq").alias("n")).withColumn("peer", F.explode(F.lit(["p0", "p1"])))
    peers = names.select("replica", F.lit("peer").alias("kind"), F.lit(0).cast("long").alias("seq"), "peer", null.cast("string").alias("payload"), F.lit(1).cast("long").alias("arrival"))
    acks = names.where("peer = 'p0'").select("replica", F.lit("ack").alias("kind"), F.floor(F.col("n") / 2).alias("seq"), "peer", null.cast("string").alias("payload"), (F.col("n") + 100).alias("arrival"))
    out = _stateful(processors.delta_buffers(_replayed(deltas.unionByName(peers).unionByName(acks), "deltas")), "buffers", "update")
    return out.select("replica", "peer", "from_seq", "to_seq", F.size("payloads").cast("long").alias("n"))


def stream_presence_expiry(spark, d):
    """Users whose last event the watermark (ten minutes behind the newest event) has passed by a minute."""
    events = logs.presence_events(_events(spark, d)).select("user_id", "ts_ms", F.timestamp_millis("ts_ms").alias("ts")).withWatermark("ts", "10 minutes")
    return _stateful(processors.presence_expiry(events, 60_000), "expiry", "append")


def stream_lattice(spark, d):
    """A declared lattice over the stream."""
    span = lattice.lookup("span")
    deltas = _events(spark, d).select(F.col("event_type").alias("key"), F.col("k").alias("least"), F.col("k").alias("most"), F.array("replica").alias("seen"))
    return _result(span.stream(deltas), "lattice").select("key", "least", "most", F.array_join("seen", ",").alias("seen"))


QUERIES = {f.__name__: f for f in (stream_counters, stream_registers, stream_vectors, stream_presence, stream_causal_delivery, stream_first_seen, stream_delta_buffers, stream_presence_expiry, stream_lattice)}

ORACLE_SQL = {
    "stream_counters": lattices.ORACLE_SQL["pncounter_breakdown"],
    "stream_registers": lattices.ORACLE_SQL["lww_events"],
    "stream_vectors": lattices.ORACLE_SQL["vv_merge"],
    "stream_causal_delivery": f"{graphs._INT} SELECT DISTINCT from_replica, 'p' AS to_replica, from_seq, to_seq, 'p' || to_seq AS payload, to_seq AS acked FROM a WHERE applied",
    "stream_first_seen": f"WITH {EV} SELECT replica, 'm' || k AS id, min(event_id) AS arrival FROM ev GROUP BY replica, k",
    "stream_delta_buffers": f"{graphs._LOG}, t AS (SELECT replica, max(seq) AS n FROM log GROUP BY 1) SELECT replica, 'p0' AS peer, n // 2 AS from_seq, n AS to_seq, n - n // 2 AS n FROM t UNION ALL SELECT replica, 'p1', 0, n, n FROM t",
    "stream_presence_expiry": f"WITH {EV} SELECT 'u' || user_id AS user_id, max(ts_ms) AS last_ms FROM ev GROUP BY 1 HAVING max(ts_ms) + 60000 < (SELECT max(ts_ms) FROM ev) - 600000",
    "stream_lattice": protocols.ORACLE_SQL["lattice_declared"],
    "stream_presence": f"WITH {EV} SELECT 'u' || user_id AS user_id, max(event_id) AS clock, CASE arg_max(event_type, event_id) WHEN 'error' THEN 'Offline' WHEN 'click' THEN 'Typing' ELSE 'Online' END AS status FROM ev GROUP BY 1",
}
