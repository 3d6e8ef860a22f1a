"""A corpus pipeline of four stages: drop toxic documents, drop bad ones, keep one of each group of near copies, pack.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideweave.llm import neardup, packing, quality, toxicity
from tideweave.llm.common import crc_fold, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity score does not predict to be toxic; null and empty texts stay."""
    labels = table(spark, sf_dir, "labels").where(crc_fold("doc_id") != 0)
    scored = toxicity.score(docs, toxicity.build_index(docs, labels))
    return scored.where("predicted = 0").select("row.*")


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules and the likelihood ratio keep; null and empty texts go."""
    judged = quality.verdicts(docs, quality.trusted(table(spark, sf_dir, "labels")))
    return judged.where("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of documents whose five-word n-gram sets are linked at 0.8 or more.

    Texts without a word are their own classes; of rows with equal id and text one stays.
    """
    return neardup.keepers(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece with its sequence and offset; null and empty texts are one token long."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_bad),
    ("n-gram Jaccard join", drop_near_copies),
    ("best-fit packing", pack),
]

#: SQL can express neither the models nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage kept is written to the shared folder for the next.

    Null and empty texts end with the quality rules, which ask for ten words. No documents give no rows;
    without labels nothing is toxic and the base rules decide alone on quality.
    """
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
