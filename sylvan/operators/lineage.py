"""Cutting lineage for plans that grow with a loop."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the session's shared checkpoint folder and continues from there.

    Where spark.checkpoint.dir names none it lies in the warehouse, which a cluster shares
    too; only a local session, whose executors are this process, gets a temporary one.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named:
            local = sc.master.startswith("local")
            named = tempfile.mkdtemp(prefix="checkpoints-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        sc.setCheckpointDir(named)
    return df.checkpoint(eager=True)
