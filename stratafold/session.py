"""Session helpers: settling intermediate tables where every executor can read them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a local one only where it is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    context = spark.sparkContext._jsc.sc()
    if not folder:
        if context.getCheckpointDir().isDefined():
            return context.getCheckpointDir().get()
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='stratafold-')}"
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package where its folder is shared with them."""
    environment = spark.sparkContext.environment
    if ROOT not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, environment.get("PYTHONPATH", "")]))
