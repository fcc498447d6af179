"""The corpus pipeline: quality, near duplicates, secrets, source mix, packing.

Each stage takes (spark, docs, sf_dir) and gets all rows that the stage before it kept, as
written to and read again from Parquet. All but the last return the columns of documents.

Null ids and repeated ids are documents of their own if their texts differ. Null and empty
texts are judged by the quality classifier like any other (the given labels reject them),
link with nothing, hold no secrets and leave in the mixing stage, which takes words. Columns
beyond those of documents pass through all stages but the last, whatever their names. An
empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sylvan.llm import jaccard, mixing, packing, quality, secrets
from sylvan.llm.common import shared_folder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; repeated rows are judged alike."""
    return quality.keep_by_quality(docs, table(spark, sf_dir, "labels"))


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays (five words, 0.8); those without words all stay."""
    return jaccard.one_of_each(docs, jaccard.Join(words=5, percent=80))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced and n_chars counted again; every row stays."""
    return secrets.redact_documents(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix doesn't take go, as do those without words; those it takes more than once repeat."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of each row."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", duplicates_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Classifiers and the dynamic programming aren't SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents table; a stage's table goes when the next is written."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        out = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = out
    return docs
