"""Tables written to the shared folder of the cluster, to cut lineage and to read a result more than once.

A written table survives lost executors, and Spark reads its true size when it picks join strategies.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a new temporary one only for a local master where that is unset."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _local[app]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df and returns a reader of what was written."""
    return load(df.sparkSession, write(df, name), df)


def write(df: DataFrame, name: str) -> str:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def load(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table of which no later job reads anything."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession) -> int:
    """Deletes all tables that this application has written here and still has; returns how many. For when no result is to be read any more."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        drop(spark, path)
    return len(paths)
