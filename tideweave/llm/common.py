"""What the training-data operators share: tables, shared storage, splits and block packing."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideweave.llm import blocks
from tideweave.sources.shared import materialize, shared_path

__all__ = ["annotate", "crc_fold", "materialize", "shared_path", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(id_col: str, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def annotate(docs: DataFrame, text_col: str, judge, fields: str, text_bytes: int = 4 << 20) -> DataFrame:
    """docs with more columns from its text, without a shuffle: columns "row" (all of docs) and those of fields.

    judge: takes an Arrow array of texts and gives the arrays of fields; it gets blocks of about
    text_bytes. All columns of docs travel as one struct, so no name of theirs can clash.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    names = ["row", *[x.split()[0] for x in fields.split(", ")]]

    def run(batches):
        seen = judge()
        for b in blocks.cut_blocks(batches, text_bytes):
            yield pa.RecordBatch.from_arrays([b.column("row"), *seen(b.column("text"))], names)

    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), *T.StructType.fromDDL(fields).fields])
    return rows.mapInArrow(run, schema)
