"""Counters of results: keyed counts in long form, depths, named counters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..config import RunConfig

KEYS = ("target_id", "mask", "end")


def matched(results: DataFrame) -> DataFrame:
    return results.where(F.col("site").isNotNull() & F.col("end").isNotNull() & F.col("failure").isNull())


def counted(results: DataFrame) -> DataFrame:
    """Matched results that count: a mutation at the stop takes the whole pair out unless a policy says otherwise."""
    return matched(results).where(F.coalesce(F.col("edge_mut") != "ignore", F.lit(True)))


def registered(results: DataFrame) -> DataFrame:
    """target_id, mask, kind, pos, end, cnt; kinds S (stop), M (mutation), Mq (removed mutation, by site), I and D (indels), E (mutation at the stop), Q (pair with removed mutations)."""
    events = counted(results).select(
        *KEYS,
        "multiplicity",
        F.explode(
            F.concat(
                F.array(F.struct(F.lit("S").alias("kind"), F.col("site").alias("pos"))),
                F.transform(F.filter("mutations", lambda m: (m != F.col("site") + 1) | (F.coalesce(F.col("edge_mut"), F.lit("")) == "stop_and_mut")), lambda m: F.struct(F.lit("M").alias("kind"), m.alias("pos"))),
                F.transform("removed_mutations", lambda m: F.struct(F.lit("Mq").alias("kind"), F.col("site").alias("pos"))),
                F.transform(F.slice("removed_mutations", 1, 1), lambda m: F.struct(F.lit("Q").alias("kind"), F.col("site").alias("pos"))),
                F.transform(F.filter("mutations", lambda m: m == F.col("site") + 1), lambda m: F.struct(F.lit("E").alias("kind"), m.alias("pos"))),
                F.transform(
                    F.map_entries(F.map_concat(F.map_filter("r2_indels", lambda k, v: ~F.map_contains_key("r1_indels", k)), "r1_indels")),
                    lambda x: F.struct(F.when(x["value"]["insert"], "I").otherwise("D").alias("kind"), F.when(x["value"]["insert"], x["key"]).otherwise(x["key"] + 1).alias("pos")),
                ),
            )
        ).alias("e"),
    )
    return events.groupBy("target_id", "mask", F.col("e.kind").alias("kind"), F.col("e.pos").alias("pos"), "end").agg(F.sum("multiplicity").alias("cnt"))


def merged(*frames: DataFrame) -> DataFrame:
    """Registered counts of several runs or workers as one."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.groupBy("target_id", "mask", "kind", "pos", "end").agg(F.sum("cnt").alias("cnt"))


def spine(ends: DataFrame, targets: DataFrame) -> DataFrame:
    """target_id, end, n, site from 0 to end for each (target_id, end)."""
    both = ends.select("target_id", "end").distinct().join(targets.select("target_id", F.length("seq").alias("n")), "target_id")
    return both.select("target_id", "end", "n", F.explode(F.sequence(F.lit(0), F.col("end"))).alias("site"))


def per_site(counts: DataFrame, spine_: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """Counts and depths of each mask, end and site (0 where nothing was counted).

    The depth at a site is what stopped there or before, separately for each
    end; the quality depth leaves out pairs with removed mutations.
    """
    kinds = ("S", "M", "Mq", "Q", "I", "D", "E")
    wide = counts.groupBy("target_id", "end", "mask", F.col("pos").alias("site")).agg(*[F.sum(F.when(F.col("kind") == k, F.col("cnt")).otherwise(0)).alias(k) for k in kinds])
    every = spine_.crossJoin(spine_.sparkSession.createDataFrame([(m,) for m in masks], "mask string"))  # a row a mask
    dense = every.join(wide, ["target_id", "end", "mask", "site"], "left").fillna(0, list(kinds))
    up_to = Window.partitionBy("target_id", "end", "mask").orderBy("site").rowsBetween(Window.unboundedPreceding, 0)
    return dense.withColumn("depth", F.sum("S").over(up_to)).withColumn("qdepth", F.sum("S").over(up_to) - F.sum("Q").over(up_to))


def named(results: DataFrame) -> DataFrame:
    """name, cnt of all named counters."""
    kept = counted(results)
    own = results.select(F.explode(F.map_entries("counters")).alias("e")).groupBy(F.col("e.key").alias("name")).agg(F.sum("e.value").alias("cnt"))
    total = results.select(F.lit("total_pairs").alias("name"), "multiplicity")
    more = (
        kept.select(F.lit("registered_pairs").alias("name"), "multiplicity")
        .unionByName(kept.select(F.concat("mask", F.lit("_kept")).alias("name"), "multiplicity"))
        .unionByName(kept.where("edge_indel").select(F.lit("edge_indel").alias("name"), "multiplicity"))
        .unionByName(kept.where("ambig_indel").select(F.lit("ambiguous_indels_pair").alias("name"), "multiplicity"))
        .unionByName(matched(results).where("edge_mut is not null").select(F.lit("edge_muts").alias("name"), "multiplicity"))
        .unionByName(kept.select(F.lit("r1_indels").alias("name"), (F.col("multiplicity") * F.size(F.map_keys("r1_indels"))).alias("multiplicity")))
        .unionByName(kept.select(F.lit("r2_indels").alias("name"), (F.col("multiplicity") * F.size(F.map_keys("r2_indels"))).alias("multiplicity")))
    )
    spots = F.map_values(F.map_concat(F.map_filter("r2_indels", lambda k, v: ~F.map_contains_key("r1_indels", k)), "r1_indels"))
    lengths = kept.select("mask", "multiplicity", F.explode(spots).alias("x"))
    more = more.unionByName(lengths.select(F.concat(F.lit("mapped_indel_len_"), F.length("x.seq")).alias("name"), "multiplicity")).unionByName(lengths.select(F.concat("mask", F.lit("_indels")).alias("name"), "multiplicity")).unionByName(lengths.select(F.lit("indels").alias("name"), "multiplicity"))
    muts = kept.select("mask", "multiplicity", F.explode(F.filter("mutations", lambda m: (m != F.col("site") + 1) | (F.col("edge_mut") == "stop_and_mut"))).alias("m"))
    more = more.unionByName(muts.select(F.lit("mutations").alias("name"), "multiplicity")).unionByName(muts.select(F.concat("mask", F.lit("_mut")).alias("name"), "multiplicity"))
    return own.unionByName(total.unionByName(more).groupBy("name").agg(F.sum("multiplicity").alias("cnt"))).where("cnt > 0")


def counter_names(config: RunConfig) -> list[str]:
    """Names that ``named`` can give under these options, all but those that hold a prefix or a length of indels."""
    errors = range(2 * (config.allowed_target_errors + 1) + 1)
    return [
        "indeterminate", "mask_failure", "dumbbell_failures", "adapter_trimmed", "multiple_R1_match", "dna_residual_pairs", "unmatched", "adapter_trim_failure", "left_of_target", "low_quality_prefixes",
        "left_of_zero", "match_errors", "r1_not_on_right_edge", "r1_r2_overlap", "mismatching_indel_pairs", "no_rt_primer", "interesting_pairs", "low_quality_muts",
        *(f"{m}_total" for m in config.masks), *(f"rt_primer_{p}" for p in config.rt_primers), *(f"{x}mut_count_{k}" for x in ("", "mapped_") for k in errors),
    ]


def write_counted(results: DataFrame, path: str, config: RunConfig) -> dict[str, int]:
    """Writes results as Parquet and returns what ``named`` would say of them, counted on the pass that writes.

    The counters are observed metrics: sums of the rows that go by. Those whose
    names are not known beforehand (prefixes, lengths of indels) are told to be
    there by one more metric, and only then counted in what was written.
    """
    config = config.resolve()
    counts = F.coalesce("counters", F.create_map().cast("map<string, bigint>"))
    known, n = counter_names(config), F.col("multiplicity")
    fits = F.col("site").isNotNull() & F.col("end").isNotNull() & F.col("failure").isNull()
    kept = fits & F.coalesce(F.col("edge_mut") != "ignore", F.lit(True))
    spots = F.map_concat(F.map_filter("r2_indels", lambda k, v: ~F.map_contains_key("r1_indels", k)), "r1_indels")
    muts = F.size(F.filter("mutations", lambda m: (m != F.col("site") + 1) | (F.coalesce(F.col("edge_mut"), F.lit("")) == "stop_and_mut")))
    sums = {name: F.coalesce(F.try_element_at(counts, F.lit(name)), F.lit(0)) for name in known}
    sums |= {
        "total_pairs": n, "registered_pairs": F.when(kept, n), "edge_indel": F.when(kept & F.col("edge_indel"), n), "ambiguous_indels_pair": F.when(kept & F.col("ambig_indel"), n),
        "edge_muts": F.when(fits & F.col("edge_mut").isNotNull(), n), "r1_indels": F.when(kept, n * F.size(F.map_keys("r1_indels"))), "r2_indels": F.when(kept, n * F.size(F.map_keys("r2_indels"))),
        "indels": F.when(kept, n * F.size(F.map_keys(spots))), "mutations": F.when(kept, n * muts),
    }
    for m in config.masks:
        own = kept & (F.col("mask") == m)
        sums |= {f"{m}_kept": F.when(own, n), f"{m}_mut": F.when(own, n * muts), f"{m}_indels": F.when(own, n * F.size(F.map_keys(spots)))}
    others = F.size(F.array_except(F.map_keys(counts), F.array(*map(F.lit, known))))
    seen = Observation(f"counters-{uuid.uuid4().hex}")
    watched = results.observe(seen, *[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in sums.items()], F.coalesce(F.sum(others), F.lit(0)).alias("_others"))
    watched.write.mode("overwrite").parquet(path)
    out = dict(seen.get)
    if out.pop("_others") or out["indels"]:
        rest = named(results.sparkSession.read.schema(results.schema).parquet(path)).where(~F.col("name").isin(list(sums)))
        out |= {r["name"]: r["cnt"] for r in rest.collect()}
    return {name: cnt for name, cnt in out.items() if cnt > 0}


def failures(results: DataFrame) -> DataFrame:
    return results.groupBy("failure").agg(F.sum("multiplicity").alias("cnt"))


def prefixes(results: DataFrame, mapped: bool = False) -> DataFrame:
    """mask, prefix, cnt and the share of the mask's total; NONE where a read has no prefix."""
    rows = (counted(results) if mapped else results.where("mask is not null")).groupBy("mask", F.coalesce("prefix", F.lit("NONE")).alias("prefix")).agg(F.sum("multiplicity").alias("cnt"))
    return rows.withColumn("share", F.col("cnt") / F.sum("cnt").over(Window.partitionBy("mask")))


def mutation_histogram(results: DataFrame) -> DataFrame:
    return counted(results).groupBy(F.size("mutations").alias("mutations")).agg(F.sum("multiplicity").alias("cnt"))


def mask_totals(results: DataFrame) -> DataFrame:
    kept = F.when(F.col("site").isNotNull() & F.col("failure").isNull() & F.coalesce(F.col("edge_mut") != "ignore", F.lit(True)), F.col("multiplicity")).otherwise(0)
    return results.where("mask is not null").groupBy("mask").agg(F.sum("multiplicity").alias("total"), F.sum(kept).alias("kept"))


def target_totals(counts: DataFrame) -> DataFrame:
    return counts.where("kind = 'S'").groupBy("target_id").agg(F.sum("cnt").alias("cnt"))


def site_count(counts: DataFrame, target_id: int, mask: str, end: int, site: int, kind: str = "S") -> int:
    """One count; 0 if nothing was counted."""
    row = counts.where((F.col("target_id") == target_id) & (F.col("mask") == mask) & (F.col("end") == end) & (F.col("pos") == site) & (F.col("kind") == kind)).agg(F.sum("cnt").alias("n")).first()
    return row["n"] or 0


def differing(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Keys whose counts differ between two runs, on either side."""
    keys = ["target_id", "mask", "kind", "pos", "end"]
    both = ours.withColumnRenamed("cnt", "ours").join(theirs.withColumnRenamed("cnt", "theirs"), keys, "full_outer").fillna(0, ["ours", "theirs"])
    return both.where("ours <> theirs")


def summary(named_counts: DataFrame) -> DataFrame:
    """Named counters, largest first, with their per cent of all pairs."""
    total = named_counts.where("name = 'total_pairs'").select(F.col("cnt").alias("total"))
    return named_counts.join(F.broadcast(total)).select("name", "cnt", (100 * F.col("cnt") / F.col("total")).alias("percent")).orderBy(F.desc("cnt"), "name")  # one row
