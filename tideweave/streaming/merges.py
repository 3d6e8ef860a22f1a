"""Streaming merges: lattice aggregates in update mode, so late, repeated and reordered rows are harmless."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tideweave.sources.shared import shared_dir


def counters(states: DataFrame) -> DataFrame:
    """Running join of counter states (counter, replica, inc, dec)."""
    return states.groupBy("counter", "replica").agg(F.max("inc").alias("inc"), F.max("dec").alias("dec"))


def registers(writes: DataFrame) -> DataFrame:
    """Running last-writer-wins join of writes (key, ts_ms, replica, value)."""
    return writes.groupBy("key").agg(F.max(F.struct("ts_ms", "replica", "value")).alias("w")).select("key", "w.*")


def tags(ops: DataFrame) -> DataFrame:
    """Observed-remove set tags with ``live``, which a removal turns off whenever it comes: ops are set_ops rows."""
    seen = ops.groupBy("set_id", "tag_replica", "tag_seq").agg(F.max(F.when(F.col("kind") == "add", F.col("element"))).alias("element"), F.bool_or(F.col("kind") == "remove").alias("removed"))
    return seen.select("set_id", "element", "tag_replica", "tag_seq", (F.col("element").isNotNull() & ~F.col("removed")).alias("live"))


def vectors(rows: DataFrame) -> DataFrame:
    return rows.groupBy("replica").agg(F.max("seq").alias("seq"))


def presence(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.max(F.struct("clock", "ts_ms", "status", "doc_id", "position", "anchor", "removed")).alias("p")).select("user_id", "p.*")


def deduplicated(messages: DataFrame, time_col: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Gossip messages once each while their state lives: id and an event time."""
    return messages.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["id"])


def alive(messages: DataFrame) -> DataFrame:
    """One hop on: expired messages go, others lose one of their time to live."""
    return messages.where("ttl > 0").withColumn("ttl", F.col("ttl") - 1)


def activity(events: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts per window and type: events have ts (timestamp) and event_type."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", delay).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", "event_type", "n")


def sessions(events: DataFrame, timeout: str = "30 seconds", delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", timeout)).agg(F.count(F.lit(1)).alias("n")).select("user_id", "session_window.start", "session_window.end", "n")


def run_available(stream: DataFrame, name: str, mode: str = "update", sink: Callable[[DataFrame, int], None] | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Run a query over what is there and stop: into a memory table, or each batch into sink (exactly once per batch id if sink is idempotent)."""
    place = checkpoint or f"{shared_dir(stream.sparkSession)}/streams/{name}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", place).trigger(availableNow=True)
    writer = writer.foreachBatch(sink) if sink else writer.format("memory").queryName(name)
    query = writer.start()
    query.awaitTermination()
    return query


def keyed_table(path: str, keys: list[str], join: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A sink that joins each batch into the state under path; versions alternate, so that a failed write harms nothing.

    Joining a batch a second time changes nothing, which makes the sink idempotent.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        done = [s.getPath().getName() for s in fs.listStatus(hadoop)] if fs.exists(hadoop) else []
        versions = sorted(int(n[1:]) for n in done if n.startswith("v") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))
        before = [v for v in versions if v < batch_id]
        state = join(spark.read.parquet(f"{path}/v{before[-1]}"), batch) if before else join(batch, batch.limit(0))
        state.write.mode("overwrite").parquet(f"{path}/v{batch_id}")
        for v in before[:-1]:
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v{v}"), True)

    return sink
