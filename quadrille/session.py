"""Sessions for tests and scripts (a cluster brings its own), and where plans are cut in two."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "4g", **more: str) -> SparkSession:
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC", "spark.driver.memory": memory,
    } | more
    return SparkSession.builder.master(f"local[{cores}]").appName("quadrille").config(map=conf).getOrCreate()


def _shared(df: DataFrame) -> str:
    """A folder of ``spark.checkpoint.dir``; a temporary one is set in local mode alone, where none is."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quadrille-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows in the same partitions from files that all executors share, so that lost ones cost nothing and reruns agree."""
    _shared(df)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The same rows from Parquet files that all executors share: far smaller than those of ``cut``, but order and partitions are lost."""
    path = f"{_shared(df)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
