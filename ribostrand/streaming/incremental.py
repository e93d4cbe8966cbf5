"""Pairs that arrive over time: every batch is classified, results are appended, counts merged.

Counts are additive, so a stream's totals are the merge of its batches. A batch
that is delivered again overwrites its own folder, and so counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import RunConfig
from ..operators import classify as K
from ..operators import counters as C
from ..schema import PAIR


def start(spark: SparkSession, pairs_path: str, targets: DataFrame, output: str, checkpoint: str, config: RunConfig = RunConfig(), files_per_batch: int = 16, available_now: bool = True) -> StreamingQuery:
    """Parquet pairs (schema PAIR) below pairs_path -> output/results and output/registered, a folder for each batch."""
    config = config.resolve()

    def batch(pairs: DataFrame, number: int) -> None:
        results = K.classify(pairs.dropDuplicates(["pair_id"]), targets, config)
        results.write.mode("overwrite").parquet(f"{output}/results/batch={number}")
        stored = pairs.sparkSession.read.parquet(f"{output}/results/batch={number}")
        C.registered(stored).write.mode("overwrite").parquet(f"{output}/registered/batch={number}")

    stream = spark.readStream.schema(PAIR).option("maxFilesPerTrigger", files_per_batch).parquet(pairs_path)
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def totals(spark: SparkSession, output: str) -> DataFrame:
    """Registered counts of all batches so far."""
    return C.merged(spark.read.parquet(f"{output}/registered").drop("batch"))


def windowed_stops(results: DataFrame, time: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Stops by event-time window, for result streams that carry a timestamp."""
    kept = results.withWatermark(time, late).where(F.col("site").isNotNull() & F.col("failure").isNull())
    return kept.groupBy(F.window(time, width), "target_id", "mask", "end", "site").agg(F.sum("multiplicity").alias("cnt"))
