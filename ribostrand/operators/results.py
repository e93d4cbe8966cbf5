"""Stored results: sets, differences, drill-downs, tag queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stored_view(results: DataFrame, set_name: str) -> DataFrame:
    """The flat row of the result table: -1 where nothing matched, the number of mutations (-1 if none), tag list."""
    tags = F.col("tags") if "tags" in results.columns else F.array().cast("array<string>")
    return results.select(
        F.lit(set_name).alias("set_name"), "pair_id", "target_id", "mask", F.coalesce("site", F.lit(-1)).alias("site"), F.coalesce("end", F.lit(-1)).alias("end"),
        F.when(F.size("mutations") > 0, F.size("mutations")).otherwise(-1).alias("muts"), "multiplicity", "failure", tags.alias("tags"),
    )


def tag_mask(tags: Column, vocabulary: list[str]) -> Column:
    """Bit i stands for the i-th tag of a vocabulary of at most 63."""
    if len(vocabulary) > 63:
        raise ValueError("a bit mask holds 63 tags; use the list")
    return sum((F.when(F.array_contains(tags, t), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, t in enumerate(vocabulary)), F.lit(0).cast("long"))


def with_tags(results: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Rows that carry all of include and none of exclude."""
    for t in include:
        results = results.where(F.array_contains("tags", t))
    for t in exclude:
        results = results.where(~F.array_contains("tags", t))
    return results


def tag_counts(results: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """tag, cnt (weighted) of the rows that fit, largest first."""
    return with_tags(results, include, exclude).select(F.explode("tags").alias("tag"), "multiplicity").groupBy("tag").agg(F.sum("multiplicity").alias("cnt")).orderBy(F.desc("cnt"), "tag")


def count_matching(results: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    return with_tags(results, include, exclude).agg(F.coalesce(F.sum("multiplicity"), F.lit(0)).alias("cnt"))


def matching(results: DataFrame, pairs: DataFrame, include: list[str] = (), exclude: list[str] = (), limit: int = 0) -> DataFrame:
    """Pairs of the rows that fit, the most frequent first."""
    out = with_tags(results, include, exclude).join(pairs.select("pair_id", "identifier", "r1", "r2"), "pair_id").orderBy(F.desc("multiplicity"), "pair_id")
    return out.limit(limit) if limit else out


def matching_site(results: DataFrame, pairs: DataFrame, target_id: int, site: int, end: int, limit: int = 0) -> DataFrame:
    """Pairs that stopped at one site."""
    out = results.where((F.col("target_id") == target_id) & (F.col("site") == site) & (F.col("end") == end)).join(pairs.select("pair_id", "identifier", "r1", "r2"), "pair_id").orderBy(F.desc("multiplicity"), "pair_id")
    return out.limit(limit) if limit else out


def result_sites(results: DataFrame) -> DataFrame:
    """mask, end, site, cnt of matched rows, by end and site."""
    return results.where("site <> -1 and `end` <> -1").groupBy("mask", "end", "site").agg(F.sum("multiplicity").alias("cnt")).orderBy("end", "site", "mask")


def num_results(results: DataFrame, set_name: str) -> DataFrame:
    return results.where(F.col("set_name") == set_name).agg(F.count(F.lit(1)).alias("cnt"))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two sets with another site, end, target or number of mutations, of which at least one matched."""
    names = ("target_id", "site", "end", "muts", "failure", "multiplicity")
    left = a.select("pair_id", *[F.col(c).alias(f"{c}_a") for c in names])
    right = b.select("pair_id", *[F.col(c).alias(f"{c}_b") for c in names])
    changed = (F.col("site_a") != F.col("site_b")) | (F.col("end_a") != F.col("end_b")) | (F.col("target_id_a") != F.col("target_id_b")) | (F.col("muts_a") != F.col("muts_b"))
    return left.join(right, "pair_id").where(changed & ((F.col("site_a") != -1) | (F.col("site_b") != -1)))


def both_sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs on which two sets disagree, with kind: only_a (found in a alone), only_b, or different."""
    names = ("target_id", "site", "end", "muts", "failure", "multiplicity")
    left = a.select("pair_id", *[F.col(c).alias(f"{c}_a") for c in names])
    right = b.select("pair_id", *[F.col(c).alias(f"{c}_b") for c in names])
    here, there = F.coalesce(F.col("site_a"), F.lit(-1)) != -1, F.coalesce(F.col("site_b"), F.lit(-1)) != -1
    same = F.lit(True)
    for c in ("site", "end", "target_id", "muts"):
        same = same & F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))
    kind = F.when(here & ~there, "only_a").when(~here & there, "only_b").when(here & there & ~same, "different")
    return left.join(right, "pair_id", "full").withColumn("kind", kind).where("kind is not null")


def diff_summary(diff: DataFrame) -> DataFrame:
    """One row: how many pairs (weighted) were lost, are new, or moved."""
    kinds = {"lost": (F.col("site_a") != -1) & (F.col("site_b") == -1), "gained": (F.col("site_a") == -1) & (F.col("site_b") != -1), "moved_site": (F.col("site_a") != -1) & (F.col("site_b") != -1) & (F.col("site_a") != F.col("site_b")), "moved_end": (F.col("site_a") != -1) & (F.col("site_b") != -1) & (F.col("end_a") != F.col("end_b"))}
    return diff.agg(*[F.coalesce(F.sum(F.when(c, F.col("multiplicity_a"))), F.lit(0)).alias(k) for k, c in kinds.items()])


def top_failures(results: DataFrame, each: int = 10) -> DataFrame:
    """The most frequent rows of each failure."""
    from pyspark.sql import Window

    order = Window.partitionBy("failure").orderBy(F.desc("multiplicity"), "pair_id")
    return results.where("failure is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each)


def with_text(rows: DataFrame, text: str) -> DataFrame:
    """Rows whose reads contain a text."""
    return rows.where(F.contains("r1", F.lit(text)) | F.contains("r2", F.lit(text)))


def upsert_set(results: DataFrame, path: str, set_name: str, resume: bool = False) -> None:
    """Write a result set; an existing one of that name is replaced unless the run resumes it."""
    rows = results.withColumn("set_name", F.lit(set_name))
    rows.write.mode("append" if resume else "overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("set_name").parquet(path)


def delete_set(spark: SparkSession, path: str, set_name: str) -> None:
    """Remove a result set from the store below path; the others stay as they are."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path, "set_name=" + set_name)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def wipe(spark: SparkSession, path: str) -> None:
    """Remove a whole store."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Widths of bins: 2 ** (FINEST + 3 * level) places.
FINEST, LEVELS = 4, 20


def region_bins(regions: DataFrame) -> DataFrame:
    """Regions by level and bin: on the finest level on which a region lies in at most two bins, a row for each of them."""
    level = None
    for k in range(LEVELS):
        bits = FINEST + 3 * k
        near = (F.shiftright("stop", bits) - F.shiftright("start", bits)) <= 1
        level = F.when(near, k) if level is None else level.when(near, k)
    levelled = regions.where(F.col("start") <= F.col("stop")).withColumn("level", level)
    bits = FINEST + 3 * F.col("level")
    first, last = (F.call_function("shiftright", F.col(c), bits) for c in ("start", "stop"))
    return levelled.select("*", F.explode(F.array_distinct(F.array(first, last))).alias("bin"))


def in_regions(places: DataFrame, regions: DataFrame, column: str = "place") -> DataFrame:
    """The distinct places that lie in a region (start, stop, inclusive), by joins on bins: any number of regions of any length.

    A target_id that both tables have must be equal, too.
    """
    both = [c for c in ("target_id",) if c in places.columns and c in regions.columns]
    binned = region_bins(regions.select(*both, F.col("start").cast("long"), F.col("stop").cast("long")).distinct())
    levels = binned.select("level").distinct()  # at most LEVELS rows
    asked = places.select(*both, F.col(column).cast("long").alias("_place")).where("_place IS NOT NULL").distinct().join(F.broadcast(levels))
    asked = asked.withColumn("bin", F.call_function("shiftright", F.col("_place"), FINEST + 3 * F.col("level")))
    met = asked.join(binned, [*both, "level", "bin"]).where(F.col("_place").between(F.col("start"), F.col("stop")))
    return met.select(*both, F.col("_place").alias(column)).distinct()


def by_region(results: DataFrame, regions: DataFrame) -> DataFrame:
    """Rows whose site or mutations lie in a region (start, stop, inclusive; by target_id, if regions have one), each once."""
    if results.isEmpty():
        return results
    own, place = "_row", "_place_"
    spots = F.array_distinct(F.filter(F.concat(F.array(F.col("site").cast("int")), F.coalesce("mutations", F.array().cast("array<int>"))), lambda x: x.isNotNull()))
    spread = results.withColumn(own, F.monotonically_increasing_id()).withColumn(place, F.explode(spots))
    both = [c for c in ("target_id",) if c in results.columns and c in regions.columns]
    inside = in_regions(spread.select(*both, place), regions, place)
    return spread.withColumn(place, F.col(place).cast("long")).join(inside, [*both, place], "left_semi").dropDuplicates([own]).select(*[F.col(f"`{c}`") for c in results.columns])
