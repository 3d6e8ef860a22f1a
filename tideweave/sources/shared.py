"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, as in a local test session, a folder under the warehouse, which is shared as well."""
    place = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return place.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/tideweave/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never broadcast.

    Spark takes the size of compressed files for that of their rows, so a written table of ids, some
    bytes each, would come to the driver with millions of rows.
    """
    return df.hint("merge")


#: Rows of a written table that may be laid beside the other side of a join.
FEW_ROWS = 20_000


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """(table, rows): materialize(), for a side of a join that is broadcast if it has few rows and shuffled if not."""
    out = materialize(df, name)
    rows = out.count()
    return (out.hint("broadcast") if rows <= FEW_ROWS else shuffled(out)), rows
