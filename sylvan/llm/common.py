"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: a run of characters other than space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    """A test table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def slices(batches, rows: int = 512):
    """Arrow batches in pieces of few rows, so that a worker holds few texts and results at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def shared_folder(spark) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir.

    Where none is configured it lies in the warehouse, which a cluster shares too; only a
    local session, whose executors are this process, gets a temporary one.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if sc.master.startswith("local"):
        return tempfile.mkdtemp(prefix="checkpoints-")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and continues from there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        # A plan made under this setting drops its shuffle files when it has run.
        return df.select("*").checkpoint(eager=True)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def text_key(doc_id: Column, text: Column) -> Column:
    """A fixed pseudo-random order of documents, 32 hex digits; only equal ids with equal texts share one."""
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))


def shuffle_key(doc_id: Column) -> Column:
    """A fixed pseudo-random order of documents: 32 hex digits."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))


def key_bin(key: Column, bins: int) -> Column:
    """Which of `bins` equal ranges of shuffle_key() a key falls in; grows with the key."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("double") * F.lit(float(bins)) / F.lit(4294967296.0)).cast("int")


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; fold 0 is held out."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5).cast("int")
