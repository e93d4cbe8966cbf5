"""Shared folders, table access and cut lineage for the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bitmaps that spare work have 2**BITS bits, 4 MB, whatever they stand for.
BITS = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_local_roots: dict[str, str] = {}
_swept: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI: spark.checkpoint.dir of the session, or what setCheckpointDir was given.

    Only where neither is set and all tasks run in this process (a local
    master, as in tests) a temporary folder stands in for it; a cluster without
    a shared folder is an error. A path without a scheme is one of Hadoop's
    default file system.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _local_roots.get(context.applicationId)
        if root is None:
            root = _local_roots[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="ribostrand-")
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", uri).rstrip("/")


def work_root(spark: SparkSession) -> str:
    """The folder of this application below the shared one; it goes when the interpreter ends."""
    app = spark.sparkContext.applicationId
    if app not in _swept:
        _swept.add(app)
        atexit.register(_sweep_quietly, spark)
    return f"{shared_root(spark)}/ribostrand-{app}"


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, as a URI."""
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Delete all work files of this application; results that still read them can no longer be computed."""
    _delete(spark, work_root(spark))
    local = _local_roots.pop(spark.sparkContext.applicationId, None)
    if local:
        _delete(spark, local)


def _sweep_quietly(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:  # else the session was stopped, and with it the way to the files
        with contextlib.suppress(Exception):
            sweep(spark)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: lineage ends there and survives lost executors."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Python workers get so many rows at once while jobs run in here; for wide rows, of which Spark's own number would take much memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(*tables: DataFrame, shuffles: bool = False) -> None:
    """Delete the files of stored tables that nothing reads any more; shuffles: let Spark drop the shuffle files of finished jobs too."""
    for df in tables:
        _delete(df.sparkSession, df.stored_at)
    if shuffles:
        drop_shuffles(tables[0].sparkSession)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs, else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def filesystem(uri: str):
    """(pyarrow filesystem, path in it) of a URI, usable on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text alone (a null text becomes an empty one), so that extra columns cannot clash."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def with_fields(df: DataFrame, more: str) -> str:
    """The DDL of df's columns and more; (StructType.add would change df's own schema)."""
    own = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return f"{own}, {more}" if own else more


def bitmap(df: DataFrame, column: str) -> np.ndarray:
    """A bitmap of the low BITS bits of a column of well-mixed longs, of constant size.

    It only spares work: what passes is joined exactly afterwards, and a full
    bitmap lets all rows pass.
    """
    low = F.col(column).bitwiseAND((1 << BITS) - 1)
    rows = df.select(F.shiftright(low, 15).alias("block"), low.bitwiseAND(32767).alias("at")).groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits")).collect()
    out = np.zeros((1 << BITS >> 15, 4096), np.uint8)
    for r in rows:
        out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def passes(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    low = values & ((1 << BITS) - 1)
    return bits[low >> 3] >> (low & 7).astype(np.uint8) & 1 == 1


def in_bitmap(spark: SparkSession, bits: np.ndarray, mix: Column) -> Column:
    """Does a column of longs (never null) pass the bitmap? Only that column leaves the JVM."""
    sent = spark.sparkContext.broadcast(bits)  # 4 MB, a constant

    @F.pandas_udf("boolean")
    def test(values: pd.Series) -> pd.Series:
        return pd.Series(passes(sent.value, values.to_numpy()))

    return test(mix)


def split_by_ids(df: DataFrame, key: str, ids: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among ids, rows whose key is not); so that only few rows need a join.

    ids must be cheap to read again.
    """
    bits = bitmap(ids.select(F.xxhash64(F.col(column).cast("long")).alias("mix")), "mix")
    return split_by_bits(df, F.xxhash64(F.col(key).cast("long")), bits)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def split_by_bits(df: DataFrame, mix: Column, bits: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(rows whose mix passes the bitmap, the others)."""
    may = fresh(df, "_may")
    flagged = df.withColumn(may, in_bitmap(df.sparkSession, bits, mix))
    return flagged.where(F.col(may)).drop(may), flagged.where(~F.col(may)).drop(may)


def text_hash(text: str) -> Column:
    """A hash of the text of a row (a null text counts as empty)."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def without(df: DataFrame, mix: Column, gone: DataFrame, column: str) -> DataFrame:
    """The rows of df whose mix (a well-mixed long, never null) is not in a column of gone (stored)."""
    some, rest = split_by_bits(df, mix, bitmap(gone, column))
    name = fresh(df, "_without")
    return rest.unionByName(some.join(gone.select(F.col(column).alias(name)).distinct(), mix == F.col(name), "left_anti"))
