"""Pairs: filters, handles, duplicates, and counts over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions import sequences as S


def non_empty(pairs: DataFrame) -> DataFrame:
    return pairs.where((F.length("r1") > 0) & (F.length("r2") > 0))


def with_mask(pairs: DataFrame, config: RunConfig = RunConfig()) -> DataFrame:
    """Adds mask: the first handle that R1 starts with, a forced one, or null."""
    return pairs.withColumn("mask", F.lit(config.force_mask) if config.force_mask is not None else S.handle("r1", config.masks))


def determinate(pairs: DataFrame, allow: bool = False) -> DataFrame:
    return pairs if allow else pairs.where(S.determinate("r1", "r2"))


def unique_pairs(pairs: DataFrame) -> DataFrame:
    """r1, r2, pair_id (the smallest), multiplicity: classification is needed once for each."""
    weight = F.coalesce(F.col("multiplicity"), F.lit(1)) if "multiplicity" in pairs.columns else F.lit(1)
    return pairs.groupBy("r1", "r2").agg(F.min("pair_id").alias("pair_id"), F.sum(weight).cast("long").alias("multiplicity"))


def for_all_copies(results: DataFrame, pairs: DataFrame) -> DataFrame:
    """The results of unique pairs, a row for each of the pairs that they stand for (with that pair's own multiplicity)."""
    weight = F.coalesce(F.col("multiplicity"), F.lit(1)) if "multiplicity" in pairs.columns else F.lit(1)
    each = pairs.select("pair_id", "r1", "r2", weight.cast("long").alias("multiplicity"))
    first = each.groupBy("r1", "r2").agg(F.min("pair_id").alias("_first"))
    named = results.drop("multiplicity").withColumnRenamed("pair_id", "_first")
    return each.join(first, ["r1", "r2"]).select("pair_id", "_first", "multiplicity").join(named, "_first").select(*results.columns)


def distinct_reads(pairs: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), count("r1").alias("unique_r1"), count("r2").alias("unique_r2"))


def max_group(pairs: DataFrame) -> DataFrame:
    """Size of the largest group of equal R1s, and of equal R2s."""
    sizes = [pairs.groupBy(r).count().agg(F.max("count").alias(f"max_{r}")) for r in ("r1", "r2")]
    return sizes[0].join(sizes[1])  # one row each


def pair_length(pairs: DataFrame) -> DataFrame:
    """The common length of all reads, or -1."""
    lengths = pairs.agg(*[f(F.length(r)).alias(f"{n}_{r}") for r in ("r1", "r2") for n, f in (("least", F.min), ("most", F.max))])
    same = (F.col("least_r1") == F.col("most_r1")) & (F.col("least_r2") == F.col("most_r2")) & (F.col("least_r1") == F.col("least_r2"))
    return lengths.select(F.when(same, F.col("least_r1")).otherwise(-1).alias("pair_length"))


def has_pairs(pairs: DataFrame) -> bool:
    return not pairs.isEmpty()


def page(pairs: DataFrame, after: int = -1, size: int = 1000) -> DataFrame:
    """The next pairs by id: keyset pagination."""
    return pairs.where(F.col("pair_id") > after).orderBy("pair_id").limit(size)


#: Hex digits of the hash that one pass counts by (65,536 counters), and rows that the last cut may sort.
DIGITS, MOST_SORTED = 4, 10_000


def sample_hash(seed: int) -> Column:
    """A hash of a pair by which it is drawn: 32 hex digits."""
    return F.md5(F.concat_ws(":", "identifier", F.col("pair_id").cast("string"), F.lit(str(seed))))


def sample(pairs: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n pairs (all, if fewer), the same ones for the same seed however the table is partitioned: those of the smallest hashes, then ids.

    Counts of the hashes' first digits tell below which of them all pairs are
    drawn; the one in which the n-th lies is counted by its next digits, until
    few enough pairs are left to be sorted. No task sorts the table.
    """
    if n <= 0:
        return pairs.limit(0)
    name = "_hash"
    while name in pairs.columns:
        name = "_" + name
    keyed = pairs.withColumn(name, sample_hash(seed))
    digits = F.col(name)
    low, left = "", n  # all hashes below the prefix low are drawn, and left more of those that begin with it
    while len(low) < 32:
        inside = keyed.where(digits.startswith(low)) if low else keyed
        counts = {r["k"]: r["n"] for r in inside.groupBy(F.substring(digits, len(low) + 1, DIGITS).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
        if not low and sum(counts.values()) <= n:
            return pairs
        for k in sorted(counts):
            if counts[k] >= left:
                break
            left -= counts[k]
        low += k
        if counts[k] <= MOST_SORTED:
            break
    last = keyed.where(digits.startswith(low)).orderBy(name, "pair_id").limit(left)
    return keyed.where(digits < low).unionByName(last).drop(name)


def union(*frames: DataFrame) -> DataFrame:
    """Several inputs as one run."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def unprocessed(pairs: DataFrame, results: DataFrame, set_name: str) -> DataFrame:
    """Pairs without a result in the set: what a resumed run still has to do."""
    return pairs.join(results.where(F.col("set_name") == set_name).select("pair_id"), "pair_id", "left_anti")


def mutation_union(*lists: Column) -> Column:
    """Mutation positions of both reads, each once, in order."""
    out = lists[0]
    for x in lists[1:]:
        out = F.array_union(out, x)
    return F.array_sort(out)
