"""Cutting lineage in loops: reliable checkpoints in the folder that the cluster names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(session: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one of this machine only where that is unset and there is no cluster."""
    found = session.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = session.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="millrace-")


def cut(df: DataFrame) -> DataFrame:
    """`df`, written to the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()
