"""Bounded labelled samples for classifiers that are fitted on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.llm.common import fold, shuffle_key, slices


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(doc_id, text, label) of at most `limit` labelled documents outside the held-out fold.

    The sample is the first `limit` labelled ids in a fixed shuffled order, so reruns agree;
    a doc_id labelled more than once counts as labelled 1 if any row says so, and of texts
    that share a doc_id the least is taken, so that `limit` bounds the rows too. Null ids and
    null labels are left out. The ids, two numbers each, are the only thing broadcast.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id")) != 0))
    ids = known.groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("label")).orderBy(shuffle_key(F.col("doc_id"))).limit(limit)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


def in_order(rows) -> list:
    """Collected rows by id and content, so that fitting doesn't depend on the order of arrival."""
    return sorted(rows, key=lambda r: tuple(r))


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def scored(docs: DataFrame, score_texts) -> DataFrame:
    """doc_id, held_out and score of every row of docs(doc_id, text); null text is empty.

    score_texts takes a list of texts and returns their scores.
    """
    import pyarrow as pa

    def run(batches):
        for batch in slices(batches):
            scores = score_texts(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 0).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.mapInArrow(run, "doc_id long, held_out boolean, score double")
