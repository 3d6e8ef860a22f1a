"""Durable replica state and document snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def persist(state: DataFrame, path: str) -> None:
    """Write durable state (replica, counter, ...) by replica; replicas not in state keep what they have.

    The write is committed when this returns.
    """
    state.sparkSession.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    state.write.mode("overwrite").partitionBy("replica").parquet(path)


def flush(spark: SparkSession, path: str) -> bool:
    """Barrier: whether everything persisted under path is committed; a write that is under way or failed leaves its staging folder."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(place)) and not any(f.getPath().getName().startswith((".spark-staging", "_temporary")) for f in fs.listStatus(place))


def load(spark: SparkSession, path: str, replica: str) -> DataFrame:
    """State of one replica (no rows if it has none); only its folder is read."""
    return spark.read.parquet(path).where(F.col("replica") == replica)


def export(state: DataFrame, path: str, version: int) -> None:
    """A versioned snapshot of any state as JSON lines."""
    state.withColumn("_version", F.lit(version)).write.mode("overwrite").option("compression", "gzip").json(path)


def restore(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, int]:
    """(state, version) of a snapshot."""
    rows = spark.read.schema(f"{schema}, _version int").json(path)
    first = rows.select("_version").first()
    return rows.drop("_version"), first[0] if first else 0


def serialized(rows: DataFrame, key: str) -> DataFrame:
    """key, json: all other columns as one JSON value."""
    return rows.select(key, F.to_json(F.struct(*[c for c in rows.columns if c != key])).alias("json"))


def deserialized(rows: DataFrame, key: str, schema: str) -> DataFrame:
    return rows.select(key, F.from_json("json", schema).alias("v")).select(key, "v.*")
