"""Tables in the folder that driver and executors share: they cut the lineage of what is used again and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_kept: dict[tuple[str, str, str], str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session may leave it unset and gets a temporary folder."""
    context = spark.sparkContext
    given = context.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own_dirs[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def _for_this_session(spark: SparkSession, path: str) -> None:
    """Marks what is written there to be deleted when the driver ends."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(own)


def kept(spark: SparkSession, name: str, key: str, make) -> str:
    """The path of a table that make(path) writes when an application first asks for `name` of `key` (its input's folder, say)."""
    own = spark.sparkContext.applicationId, name, key
    if own not in _kept:
        path = new_path(spark, name)
        make(path)
        _for_this_session(spark, path)
        _kept[own] = path
    return _kept[own]


def staged(df: DataFrame, name: str, **options) -> DataFrame:
    """df written to a new folder (with a writer's options) and read again."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    _for_this_session(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
