"""Exports: SAM, FASTQ by channel, reactivity tables, run dumps, matrices."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions import sequences as S
from ..operators import counters as C
from .shards import shard_files, write_shards


def sam_records(results: DataFrame, pairs: DataFrame, targets: DataFrame) -> DataFrame:
    """pair_id, line: two SAM lines for each pair."""
    rows = results.select("pair_id", "target_id", "site", "end", "failure").join(pairs.select("pair_id", "identifier", "r1", "r2", *[c for c in ("r1_qual", "r2_qual") if c in pairs.columns]), "pair_id")
    rows = rows.join(targets.select("target_id", "name", F.length("seq").alias("n")), "target_id", "left")
    q1, q2 = (F.coalesce(F.col(c), F.lit("*")) if c in pairs.columns else F.lit("*") for c in ("r1_qual", "r2_qual"))
    good = F.col("failure").isNull() & F.col("site").isNotNull()
    span = F.col("end") - F.col("site")
    len1, len2 = F.least(F.length("r1"), span), F.least(F.length("r2"), span)

    def line(flag: int, bad: int, pos: Column, size: Column, mate: Column, tlen: Column, seq: Column, qual: Column) -> Column:
        mapped = F.concat_ws("\t", "identifier", F.lit(str(flag)), "name", (pos + 1).cast("string"), F.lit("255"), F.concat(size.cast("string"), F.lit("M")), F.lit("="), (mate + 1).cast("string"), tlen.cast("string"), F.substring(seq, F.lit(1), size), F.substring(qual, F.lit(1), size), F.lit("NM:i:0"))
        failed = F.concat_ws("\t", "identifier", F.lit(str(bad)), F.lit("*"), F.lit("0"), F.lit("255"), F.lit("*"), F.lit("*"), F.lit("0"), F.lit("0"), seq, qual)
        return F.when(good, mapped).otherwise(failed)

    right = F.col("end") - len1
    both = F.array(line(83, 77, right, len1, F.col("site"), -span, S.reverse_complement("r1"), F.reverse(q1)), line(163, 141, F.col("site"), len2, right, span, F.col("r2"), q2))
    return rows.select("pair_id", F.posexplode(both).alias("mate", "line"))


def write_sam(results: DataFrame, pairs: DataFrame, targets: DataFrame, path: str, gzip: bool = False) -> list[dict]:
    """Shards in the order of ids, the header before the first line of the first one; returns the manifest."""
    named = targets.orderBy("target_id").select(F.concat(F.lit("@SQ\tSN:"), "name", F.lit("\tLN:"), F.length("seq").cast("string")).alias("line"))
    head = ["@HD\tVN:1.0\tSO:unsorted", *(r["line"] for r in named.toLocalIterator()), "@PG\tID:ribostrand"]
    header = results.sparkSession.createDataFrame([(-1 - len(head) + i, 0, x) for i, x in enumerate(head)], "pair_id long, mate int, line string")
    lines = header.unionByName(sam_records(results, pairs, targets)).repartitionByRange("pair_id").sortWithinPartitions("pair_id", "mate")
    return write_shards(lines, path, {"sam": F.col("line")}, suffix="sam", gzip=gzip)


def fastq_lines(identifier: Column, seq: Column, qual: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("@"), identifier), seq, F.lit("+"), F.coalesce(qual, F.regexp_replace(seq, ".", "I")))


def channel_fastq(pairs: DataFrame, config: RunConfig = RunConfig(), strip: bool = True, only: DataFrame | None = None) -> DataFrame:
    """mask, read, record (four lines) of each pair with a handle, which is cut from R1; only: results whose matched pairs to keep."""
    rows = pairs.withColumn("mask", S.handle("r1", config.masks)).where("mask is not null")
    if only is not None:
        rows = rows.join(C.matched(only).select("pair_id"), "pair_id", "left_semi")
    cut = F.length("mask") if strip else F.lit(0)
    qual = [F.col(q) if q in pairs.columns else F.lit(None).cast("string") for q in ("r1_qual", "r2_qual")]
    first = fastq_lines(F.col("identifier"), F.substring("r1", cut + 1, F.length("r1")), F.substring(qual[0], cut + 1, F.length("r1")))
    return rows.select("pair_id", "mask", F.explode(F.array(F.struct(F.lit("R1").alias("read"), first.alias("record")), F.struct(F.lit("R2").alias("read"), fastq_lines(F.col("identifier"), F.col("r2"), qual[1]).alias("record")))).alias("x")).select("pair_id", "mask", "x.read", "x.record")


def write_fastq(pairs: DataFrame, path: str, group: Column | None = None, gzip: bool = False, mode: str = "overwrite") -> list[dict]:
    """Shards of pairs, by group: R1 and R2 in files of their own, in step; returns the manifest."""
    qual = [F.col(q) if q in pairs.columns else F.lit(None).cast("string") for q in ("r1_qual", "r2_qual")]
    streams = {"R1": fastq_lines(F.col("identifier"), F.col("r1"), qual[0]), "R2": fastq_lines(F.col("identifier"), F.col("r2"), qual[1])}
    return write_shards(pairs, path, streams, group, "fastq", gzip, mode)


def write_channels(pairs: DataFrame, path: str, config: RunConfig = RunConfig(), strip: bool = True, only: DataFrame | None = None, compress: bool = False) -> list[dict]:
    """Shards of the pairs of each mask, in the order of ids; the handle is cut from R1 with strip."""
    rows = pairs.withColumn("mask", S.handle("r1", config.masks)).where("mask is not null")
    if only is not None:
        rows = rows.join(C.matched(only).select("pair_id"), "pair_id", "left_semi")
    if strip:
        n = F.length("mask")
        rows = rows.withColumns({c: F.substring(c, n + 1, F.length(c)) for c in ("r1", "r1_qual") if c in rows.columns})
    return write_fastq(rows.repartitionByRange("pair_id").sortWithinPartitions("pair_id"), path, F.col("mask"), compress)


def input_sheet(spark, masks: tuple[str, ...], folder: str) -> DataFrame:
    """The sheet that says which files hold which channel: comma-separated, R1's and R2's in the same order."""
    rows = [("treated" if i == 0 else "untreated", *(",".join(shard_files(folder, r, m)) for r in ("R1", "R2"))) for i, m in enumerate(masks)]
    return spark.createDataFrame(rows, "channel string, r1 string, r2 string")


def number(value: float | None) -> str:
    """As text: integers without a fraction if they are counts, infinity as inf."""
    if value is None:
        return ""
    if isinstance(value, float) and math.isinf(value):
        return "inf"
    return str(value)


def reactivities(profile: DataFrame) -> DataFrame:
    """sequence, rt_start, five_prime_offset, nucleotide, treated_mods, untreated_mods, beta, theta, c; '-' at offset 0."""
    text = lambda c: F.when(F.col("site") == 0, "-").otherwise(F.col(c).cast("string"))
    return profile.select(
        F.col("name").alias("sequence"), F.col("end").alias("rt_start"), F.col("site").alias("five_prime_offset"), F.col("nt").alias("nucleotide"), F.col("S_t").alias("treated_mods"), F.col("S_u").alias("untreated_mods"),
        text("beta").alias("beta"), text("theta").alias("theta"), F.format_string("%.5f", F.col("c_thresh")).alias("c"),
    ).orderBy("sequence", "rt_start", "five_prime_offset")


def write_reactivities(profile: DataFrame, path: str) -> None:
    """Tab-separated files in order, each with the header."""
    reactivities(profile).write.mode("overwrite").csv(path, sep="\t", header=True)


def run_columns(config: RunConfig) -> list[tuple[str, str]]:
    """(header, profile column) of a run dump."""
    out = [("L", "end"), ("site", "site"), ("nt", "nt"), ("f+", "S_t"), ("f-", "S_u")]
    if config.handle_indels:
        out += [("ins+", "I_t"), ("ins-", "I_u"), ("del+", "D_t"), ("del-", "D_u")]
    if config.count_mutations:
        out += [("mut+", "M_t"), ("mut-", "M_u"), ("beta", "beta"), ("mu", "mu"), ("r", "r")]
    else:
        out += [("beta", "beta"), ("theta", "theta"), ("rho", "rho")]
    if config.compute_z_reactivity:
        out.append(("z", "z_mut" if config.count_mutations else "z"))
    return [*out, ("c thresh", "c_thresh_mut" if config.count_mutations else "c_thresh"), ("c", "c_mut" if config.count_mutations else "c")]


def run_dump(profile: DataFrame, config: RunConfig) -> DataFrame:
    return profile.orderBy("name", "end", "site").select("name", *[F.col(c).alias(h) for h, c in run_columns(config)])


def reads_dump(results: DataFrame) -> DataFrame:
    """Tag, Percentage of all rows, Count."""
    total = results.agg(F.count(F.lit(1)).alias("total"))
    tags = results.select(F.explode("tags").alias("Tag"), "multiplicity").groupBy("Tag").agg(F.sum("multiplicity").alias("Count"))
    return tags.join(F.broadcast(total)).select("Tag", (100 * F.col("Count") / F.col("total")).alias("Percentage"), "Count").orderBy(F.desc("Count"), "Tag")  # one row


def indel_lengths(results: DataFrame) -> DataFrame:
    spots = F.map_values(F.map_concat(F.map_filter("r2_indels", lambda k, v: ~F.map_contains_key("r1_indels", k)), "r1_indels"))
    return C.counted(results).select("multiplicity", F.explode(spots).alias("x")).groupBy(F.length("x.seq").alias("length")).agg(F.sum("multiplicity").alias("cnt")).orderBy("length")


def old_text(profile: DataFrame, config: RunConfig) -> DataFrame:
    """The older layout: single targets stop before the last row; cotranscriptional ones get rows of zeros for the linker."""
    base = profile.select("name", F.col("end").alias("rt_start"), F.col("site").alias("five_prime_offset"), F.col("nt").alias("nucleotide"), F.col("S_t").alias("treated_mods"), F.col("S_u").alias("untreated_mods"), "beta", "theta", F.col("c_thresh").alias("c"))
    if not config.cotrans:
        return base.where("five_prime_offset < rt_start").withColumn("rt_start", F.col("rt_start") - 1)
    linker = config.cotrans_linker[:-2]
    heads = profile.select("name", "end", F.col("c_thresh").alias("c")).distinct()
    tail = heads.select("name", F.col("end").alias("_end"), "c", F.posexplode(F.split(F.lit(linker), "")).alias("i", "nucleotide")).where("nucleotide <> ''")
    zeros = tail.select("name", F.col("_end").alias("rt_start"), (F.col("_end") + 1 + F.col("i")).alias("five_prime_offset"), "nucleotide", F.lit(0).cast("long").alias("treated_mods"), F.lit(0).cast("long").alias("untreated_mods"), F.lit(0.0).alias("beta"), F.lit(0.0).alias("theta"), "c")
    return base.unionByName(zeros).withColumn("rt_start", F.col("rt_start") + len(linker) + 1).orderBy("name", "rt_start", "five_prime_offset")


def matrix_rows(profile: DataFrame, value: str) -> DataFrame:
    """A comma-joined line for each end, padded to the longest."""
    from ..operators.profiles import matrix

    longest = profile.agg(F.max("end").alias("n"))
    rows = matrix(profile, value).join(F.broadcast(longest))  # one row
    cells = F.transform("cells", lambda v: v.cast("string"))
    return rows.select("target_id", "end", F.array_join(F.concat(cells, F.array_repeat(F.lit(""), (F.col("n") - F.col("end")).cast("int"))), ",").alias("line")).orderBy("target_id", "end")


def matrix_html(rows: list[list[float]], title: str = "") -> str:
    """A plain table, shaded by value; for small collected matrices."""
    most = max((v for r in rows for v in r), default=0) or 1
    body = "".join("<tr>" + "".join(f'<td style="background:rgba(200,0,0,{min(1, max(0, v / most)):.2f})">{v:g}</td>' for v in r) + "</tr>" for r in rows)
    return f"<!doctype html><title>{title}</title><table>{body}</table>"


def diagram(r1: str, r2: str, target: str, site: int | None, end: int | None) -> str:
    """Both reads under the target, one collected pair; lower case where they differ."""
    if site is None:
        return f"R1  {r1}\nR2  {r2}\n(no site)"
    from ..functions.reads import rc

    first, start = rc(r1), max(0, end - len(r1))
    show = lambda s, d: " " * d + "".join(c if d + i < len(target) and target[d + i] == c else c.lower() for i, c in enumerate(s))
    return f"T   {target}\nR2  {show(r2, site)}\nR1' {show(first[len(first) - (end - start):], start)}\n    {' ' * site}^{site}"
