"""Rows that later stages read more than once and must find the same, partition for partition."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame


def stable(df: DataFrame) -> DataFrame:
    """``df``, checkpointed in the folder of ``spark.checkpoint.dir``, which all executors share. Only a session on this machine alone
    may be without that setting: it gets a folder of its own."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}")
    return df.checkpoint()
