"""Pairs, unique pairs, results and tag counts that are kept between batches.

Tables of a folder, bucketed so that what is asked of them again and again needs
no shuffle: pairs and results by pair_id (their joins), unique pairs by their
reads (their merge). Each batch is a partition of every table; a batch that is
added again replaces itself, so a job that failed half-way is just repeated.

Aggregates are kept as what each batch adds: the copies of a pair and the counts
of a tag are merged when they are read, and only the new batch is ever counted.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import results as Q

PAIRS = "pair_id BIGINT, identifier STRING, r1 STRING, r2 STRING, multiplicity BIGINT"
UNIQUE = "r1 STRING, r2 STRING, pair_id BIGINT, multiplicity BIGINT"
RESULTS = "pair_id BIGINT, set_name STRING, target_id INT, mask STRING, site INT, `end` INT, muts INT, multiplicity BIGINT, failure STRING, tags ARRAY<STRING>"
TAG_COUNTS = "set_name STRING, tag STRING, cnt BIGINT"


@dataclass
class Kept:
    """The tables below a folder. The number of buckets is that of the first time; name is what the session calls them."""

    spark: SparkSession
    path: str
    name: str = "kept"
    buckets: int = 64

    def __post_init__(self):
        if not re.fullmatch(r"\w+", self.name):
            raise ValueError("a name is a word")
        for table, columns, by in (("pairs", PAIRS, "pair_id"), ("unique", UNIQUE, "r1, r2"), ("results", RESULTS, "pair_id"), ("tag_counts", TAG_COUNTS, None)):
            clustered = f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS" if by else ""
            place = f"{self.path.rstrip('/')}/{table}"
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name}_{table} ({columns}, batch STRING) USING parquet PARTITIONED BY (batch) {clustered} LOCATION '{place}'")
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(place)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(folder)
            # batches that other sessions added
            self.spark.sql(f"ALTER TABLE {self.name}_{table} RECOVER PARTITIONS")

    def _table(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{name}")

    def _put(self, name: str, rows: DataFrame, batch: str, by: list[str]) -> None:
        if not re.fullmatch(r"[\w-]+", batch):
            raise ValueError("the name of a batch is letters, digits, _ and -")
        columns = [c for c in self._table(name).columns if c != "batch"]
        # the shuffle deals rows out as the buckets do, so a task writes one file
        ready = rows.repartition(self.buckets, *by) if by else rows.coalesce(1)
        view = f"{self.name}_new_{name}"
        ready.select(*columns).createOrReplaceTempView(view)
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name}_{name} PARTITION (batch = '{batch}') SELECT * FROM {view}")
        self.spark.catalog.dropTempView(view)

    def add_pairs(self, pairs: DataFrame, batch: str) -> None:
        weight = F.coalesce(F.col("multiplicity"), F.lit(1)).cast("long") if "multiplicity" in pairs.columns else F.lit(1).cast("long")
        rows = pairs.withColumn("multiplicity", weight)
        self._put("pairs", rows, batch, ["pair_id"])
        own = self._table("pairs").where(F.col("batch") == batch)
        self._put("unique", own.groupBy("r1", "r2").agg(F.min("pair_id").alias("pair_id"), F.sum("multiplicity").alias("multiplicity")), batch, ["r1", "r2"])

    def add_results(self, results: DataFrame, batch: str) -> None:
        """results: rows of ``results.stored_view``."""
        self._put("results", results, batch, ["pair_id"])
        tags = self._table("results").where(F.col("batch") == batch).select("set_name", F.explode("tags").alias("tag"), "multiplicity")
        self._put("tag_counts", tags.groupBy("set_name", "tag").agg(F.sum("multiplicity").alias("cnt")), batch, [])

    def drop(self, batch: str) -> None:
        for table in ("pairs", "unique", "results", "tag_counts"):
            rows = self._table(table).where(F.col("batch") == batch)
            if not rows.isEmpty():
                self.spark.sql(f"ALTER TABLE {self.name}_{table} DROP PARTITION (batch = '{batch}')")

    def pairs(self) -> DataFrame:
        return self._table("pairs").drop("batch")

    def results(self, set_name: str | None = None) -> DataFrame:
        rows = self._table("results").drop("batch")
        return rows if set_name is None else rows.where(F.col("set_name") == set_name)

    def unique_pairs(self) -> DataFrame:
        """r1, r2, pair_id (the smallest), multiplicity over all batches; buckets are merged where they lie."""
        return self._table("unique").groupBy("r1", "r2").agg(F.min("pair_id").alias("pair_id"), F.sum("multiplicity").alias("multiplicity"))

    def tag_counts(self, set_name: str) -> DataFrame:
        return self._table("tag_counts").where(F.col("set_name") == set_name).groupBy("tag").agg(F.sum("cnt").alias("cnt"))

    def with_reads(self, set_name: str) -> DataFrame:
        """Results with identifier and reads of their pairs, joined bucket by bucket."""
        return self.results(set_name).join(self._table("pairs").select("pair_id", "identifier", "r1", "r2"), "pair_id")

    def matching(self, set_name: str, include: list[str] = (), exclude: list[str] = (), limit: int = 0) -> DataFrame:
        """As ``results.matching``."""
        return Q.matching(self.results(set_name), self.pairs(), include, exclude, limit)

    def matching_site(self, set_name: str, target_id: int, site: int, end: int, limit: int = 0) -> DataFrame:
        """As ``results.matching_site``."""
        return Q.matching_site(self.results(set_name), self.pairs(), target_id, site, end, limit)
