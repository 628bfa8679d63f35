"""Where the operators put tables that cut a plan in two."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROWS = 1 << 14  # of a few longs each, in a file

_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode with none set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = "file://" + tempfile.mkdtemp(prefix="quadrille-")
    return _local_folders[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Survives the loss of executors, and fixes what a rerun might order differently.
    """
    return materialize_at(df, name, compression)[0]


def materialize_at(df: DataFrame, name: str, compression: str = "zstd") -> tuple[DataFrame, str]:
    """The same, and the path, for tables that ``remove`` shall end once what is made of them is written."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has short rows and about so many of them, in at most one partition for each ``ROWS`` of them.

    As many files as the session has shuffle partitions, with a few rows in each, cost more calls of the file system than anything else;
    on a local disk without Hadoop's native library each file takes several processes, spawned from the executor.
    """
    return df.coalesce(1 + rows // ROWS)


def remove(spark: SparkSession, path: str) -> None:
    """Delete what an operator wrote itself and needs no more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A name like this one that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
