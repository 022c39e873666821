"""Cutting lineage: checkpoints in the shared folder that the session names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` as files in ``spark.checkpoint.dir``; only where that is unset, as in tests, in a folder of this machine."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="stackwise-"))
    return df.checkpoint()
