"""Written intermediate tables: lineage ends there, and the files survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir (or what setCheckpointDir was given), deleted when the interpreter ends.

    A temporary folder stands in for it only under a local master; a cluster
    without a shared folder is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _own:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not root:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            root = "file://" + tempfile.mkdtemp(prefix="ribostrand-")
        _own[app] = f"{root.rstrip('/')}/ribostrand-work-{app}"
        atexit.register(_forget, spark, _own[app])
    return _own[app]


def _forget(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:  # else the session was stopped, and with it the way to the files
        with contextlib.suppress(Exception):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
