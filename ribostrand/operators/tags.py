"""Tags of reads: what each pair looks like, matched or not."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions import sequences as S
from .index import seed_hits

# The tags besides those of targets and failures.
VOCABULARY = ("match", "match_errors", "adapter", "adapter_errors", "linker", "unknown", "indeterminate", "treated", "untreated", "mask_failure", "interesting", "indels", "indels_mismatched")

#: Below the number of any reverse complement.
FIRST_EXTRA = -(1 << 31)


def tag_targets(targets: DataFrame, config: RunConfig = RunConfig()) -> DataFrame:
    """target_id, name, seq of everything that tags name: targets, their reverse complements (-target_id), adapters, linker, extras (from FIRST_EXTRA on)."""
    spark = targets.sparkSession
    extras = [("adapter_t", config.adapter_t), ("adapter_b", config.adapter_b), *config.extra_tags]
    if config.cotrans:
        extras.append(("linker_cotrans", config.cotrans_linker))
    extras += [(f"{n}_rc", _rc(s)) for n, s in list(extras)]
    named = targets.select("target_id", "name", "seq").unionByName(targets.select((-F.col("target_id")).alias("target_id"), F.concat("name", F.lit("_rc")).alias("name"), S.reverse_complement("seq").alias("seq")))
    return named.unionByName(spark.createDataFrame([(FIRST_EXTRA + i, n, s) for i, (n, s) in enumerate(extras)], "target_id int, name string, seq string"))


def _rc(s: str) -> str:
    from ..functions.reads import rc

    return rc(s)


def spans(pairs: DataFrame, tagged: DataFrame, least: int = 8) -> DataFrame:
    """pair_id, read (r1 or r2), name, start, length, index: every stretch of the tag targets in the reads."""
    reads = pairs.select("pair_id", F.explode(F.array(F.struct(F.lit("r1").alias("read"), F.col("r1").alias("seq")), F.struct(F.lit("r2").alias("read"), F.col("r2").alias("seq")))).alias("x"))
    queries = reads.select(F.concat_ws(":", "pair_id", "x.read").alias("query_id"), "pair_id", "x.read", "x.seq")
    hits = seed_hits(queries.select("query_id", "seq"), tagged, least)
    return hits.join(queries.select("query_id", "pair_id", "read"), "query_id").join(tagged.select("target_id", "name"), "target_id").select("pair_id", "read", "name", F.col("q_start").alias("start"), "length", F.col("t_start").alias("index"))


def best_spans(found: DataFrame) -> DataFrame:
    """The longest stretch of each name and read."""
    return found.groupBy("pair_id", "read", "name").agg(F.max_by(F.struct("start", "length", "index"), F.struct("length", -F.col("start"))).alias("s")).select("pair_id", "read", "name", "s.*")


def longest_unmatched(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, read, longest: the longest stretch of a read that no span covers."""
    from .profiles import gaps

    lengths = pairs.select("pair_id", F.explode(F.map_from_arrays(F.array(F.lit("r1"), F.lit("r2")), F.array(F.length("r1"), F.length("r2")))).alias("read", "n"))
    covered = found.join(lengths, ["pair_id", "read"]).select("pair_id", "read", "start", (F.col("start") + F.col("length")).alias("stop"), "n")
    free = gaps(covered, ["pair_id", "read"], F.col("n"), 0, 0)
    some = free.groupBy("pair_id", "read").agg(F.max(F.col("stop") - F.col("start")).alias("longest"))
    return lengths.join(some, ["pair_id", "read"], "left").join(covered.select("pair_id", "read", F.lit(True).alias("any")).distinct(), ["pair_id", "read"], "left").select("pair_id", "read", F.coalesce("longest", F.when(F.col("any"), 0).otherwise(F.col("n"))).alias("longest"))


def names_found(pairs: DataFrame, tagged: DataFrame, least: int = 8) -> DataFrame:
    """r1, r2, _found: the distinct pairs of reads that show stretches of tag targets, and whose, sorted. Equal reads are searched once."""
    both = pairs.select("r1", "r2").distinct()
    reads = both.select(F.explode(F.array("r1", "r2")).alias("seq")).distinct()
    hits = seed_hits(reads.select(F.col("seq").alias("query_id"), "seq"), tagged, least).select("query_id", "target_id").distinct()
    names = hits.join(tagged.select("target_id", "name"), "target_id").groupBy("query_id").agg(F.collect_set("name").alias("names"))
    for r in ("r1", "r2"):
        both = both.join(names.select(F.col("query_id").alias(r), F.col("names").alias(f"_{r}")), r, "left")
    none = F.array().cast("array<string>")
    every = F.array_sort(F.array_union(F.coalesce("_r1", none), F.coalesce("_r2", none)))
    return both.select("r1", "r2", every.alias("_found")).where(F.size("_found") > 0)


def assign(results: DataFrame, pairs: DataFrame, targets: DataFrame, config: RunConfig = RunConfig(), plugins: dict[str, Callable[[DataFrame], Column]] | None = None) -> DataFrame:
    """results with tags. A plugin gives a boolean column of the tagged rows (a pandas UDF will do)."""
    names = targets.select(F.col("target_id"), F.col("name").alias("_name"))
    rows = results.join(pairs.select("pair_id", "r1", "r2"), "pair_id").join(names, "target_id", "left")
    unmatched = pairs.join(results.where("target_id is null").select("pair_id"), "pair_id", "left_semi")
    rows = rows.join(names_found(unmatched, tag_targets(targets, config), config.minimum_tag_match_length), ["r1", "r2"], "left")
    matched = F.col("target_id").isNotNull()
    counts = F.coalesce(F.col("counters"), F.create_map().cast("map<string, bigint>"))
    # beyond the fragment both reads show the linker and dumbbell, the handle, and then adapter
    beyond = F.col("end") - F.col("site") + len(config.masks[0]) + len(config.cotrans_linker if config.cotrans else "") + len(config.dumbbell or "")
    tail = lambda r: F.substring(r, beyond + 1, F.length(r))
    wrong = F.size(S.mismatches(tail("r1"), F.lit(config.adapter_b))) + F.size(S.mismatches(tail("r2"), F.lit(_rc(config.adapter_t))))
    indels = F.size(F.map_keys("r1_indels")) + F.size(F.map_keys("r2_indels")) > 0
    own = F.array(
        F.when(matched, "match"), F.when(matched, F.col("_name")), F.when(matched & (F.size("mutations") > 0), "match_errors"), F.when(matched & F.map_contains_key(counts, "adapter_trimmed"), "adapter"),
        F.when(matched & ~indels & (wrong > 0), "adapter_errors"),
        F.when(matched & F.col("linker").isNotNull(), "linker"), F.when(~matched & F.col("_found").isNull(), "unknown"), F.col("failure"),
        F.when(~S.determinate("r1", "r2"), "indeterminate"),
        F.when(F.col("mask").isNull(), "mask_failure").when(F.col("mask") == config.masks[0], "treated").otherwise("untreated"),
        F.when(F.col("interesting"), "interesting"), F.when(indels, "indels"), F.when(indels & F.map_contains_key(counts, "mismatching_indel_pairs"), "indels_mismatched"),
    )
    rows = rows.withColumn("tags", F.array_distinct(F.array_compact(F.concat(own, F.when(~matched, F.coalesce("_found", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))))))
    for tag, handler in (plugins or {}).items():
        rows = rows.withColumn("tags", F.when(handler(rows), F.array_union("tags", F.array(F.lit(tag)))).otherwise(F.col("tags")))
    return rows.drop("r1", "r2", "_name", "_found")
