"""The driver's tables as domain tables, and the same in DuckDB SQL.

Targets are the first 120 nucleotides of benchmark texts, pairs are cut from
them as a sequencer would show them (with substitutions and Ns at fixed event
numbers), stop events come from events, result sets from lineitem.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ADAPTER_B, ADAPTER_T, RunConfig
from ..functions import sequences as S

LENGTH = 36
CONFIG = RunConfig(algorithm="lookup", pair_length=LENGTH)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "benchmark")
    return rows.select((F.col("item_id") + 1).cast("int").alias("target_id"), F.concat(F.lit("T"), F.col("item_id").cast("string")).alias("name"), F.substring(S.from_text("text"), 1, 120).alias("seq")).withColumn("n", F.length("seq"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, identifier, r1, r2, multiplicity and what they were made from: target_id, made_site."""
    items = load(spark, sf_dir, "benchmark").agg(F.count(F.lit(1)).alias("items"))  # a row; items are numbered from 0
    e = load(spark, sf_dir, "events").crossJoin(F.broadcast(items)).select("event_id", "user_id", (F.col("user_id") % F.col("items") + 1).cast("int").alias("target_id"), (F.col("event_id") % 60).cast("int").alias("made_site"))
    e = e.join(targets(spark, sf_dir).select("target_id", "seq"), "target_id").withColumn("frag", F.substring("seq", F.col("made_site") + 1, F.length("seq")))
    e = e.withColumn("handle", F.when(F.col("event_id") % 3 == 0, "AAAT").when(F.col("event_id") % 3 == 1, "CCCG").otherwise("ACGT"))
    r1 = F.substring(F.concat("handle", S.reverse_complement("frag"), F.lit(ADAPTER_B)), 1, LENGTH)
    r2 = F.substring(F.concat("frag", S.reverse_complement("handle"), S.reverse_complement(F.lit(ADAPTER_T))), 1, LENGTH)
    at = (F.col("event_id") % 20).cast("int")
    swapped = F.concat(F.substring(r2, F.lit(1), at), F.translate(F.substring(r2, at + 1, F.lit(1)), "ACGT", "CGTA"), F.substring(r2, at + 2, F.lit(LENGTH)))
    unclear = F.concat(F.substring(r1, 1, 9), F.lit("N"), F.substring(r1, 11, LENGTH))
    return e.select(
        F.col("event_id").alias("pair_id"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("identifier"), F.when(F.col("event_id") % 11 == 0, unclear).otherwise(r1).alias("r1"),
        F.when(F.col("event_id") % 7 == 0, swapped).otherwise(r2).alias("r2"), F.lit(1).cast("long").alias("multiplicity"), "target_id", "made_site",
    )


#: What is in the middle of a read with an indel, by pair_id % 3: a base less, a base more, nothing.
INDEL_AT = 18


def indel_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, r1, r2: fragments of at least 70 bases, of which R2 shows one with a base less or more after INDEL_AT bases; R1 does not reach that far."""
    e = pairs(spark, sf_dir).select("pair_id", "target_id", "made_site").join(targets(spark, sf_dir).select("target_id", "seq"), "target_id")
    e = e.withColumn("frag", F.substring("seq", F.col("made_site") + 1, F.length("seq"))).where(F.length("frag") >= 70)
    kind, at = F.col("pair_id") % 3, INDEL_AT
    other = F.translate(F.substring("frag", at + 1, 1), "ACGT", "CGTA")
    shown = F.when(kind == 0, F.concat(F.substring("frag", 1, at), F.substring("frag", at + 2, LENGTH))).when(kind == 1, F.concat(F.substring("frag", 1, at), other, F.substring("frag", at + 1, LENGTH))).otherwise(F.col("frag"))
    return e.select("pair_id", F.substring(F.concat(F.lit("AAAT"), S.reverse_complement("frag")), 1, LENGTH).alias("r1"), F.substring(shown, 1, LENGTH).alias("r2"))


def prefixed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, r1, r2 of whole targets before which R2 shows nothing, one or two bases, by pair_id % 3."""
    e = pairs(spark, sf_dir).select("pair_id", "target_id").join(targets(spark, sf_dir).select("target_id", "seq"), "target_id")
    handle = F.when(F.col("pair_id") % 2 == 0, "AAAT").otherwise("CCCG")
    prefix = F.when(F.col("pair_id") % 3 == 0, "").when(F.col("pair_id") % 3 == 1, "G").otherwise("CA")
    return e.select("pair_id", F.substring(F.concat(handle, S.reverse_complement("seq")), 1, LENGTH).alias("r1"), F.substring(F.concat(prefix, "seq"), 1, LENGTH).alias("r2"))


def graded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs with base qualities: the changed base of R2 is a poor one where pair_id is even."""
    at = (F.col("pair_id") % 20).cast("int")
    good = F.repeat(F.lit("I"), LENGTH)
    poor = F.concat(F.substring(good, F.lit(1), at), F.lit("!"), F.substring(good, at + 2, F.lit(LENGTH)))
    return pairs(spark, sf_dir).withColumn("r1_qual", F.substring(good, F.lit(1), F.length("r1"))).withColumn("r2_qual", F.substring(F.when(F.col("pair_id") % 2 == 0, poor).otherwise(good), F.lit(1), F.length("r2")))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, r1, r2 of transcripts from base pair_id % 20 of a target to base 40 + pair_id % 60 (or its last one), with the linker behind them."""
    e = pairs(spark, sf_dir).select("pair_id", "target_id").join(targets(spark, sf_dir).select("target_id", "seq"), "target_id")
    start, end = (F.col("pair_id") % 20).cast("int"), F.least(40 + F.col("pair_id") % 60, F.length("seq")).cast("int")
    whole = F.concat(F.substring("seq", start + 1, end - start), F.lit(RunConfig().cotrans_linker))
    handle = F.when(F.col("pair_id") % 2 == 0, "AAAT").otherwise("CCCG")
    return e.select("pair_id", F.substring(F.concat(handle, S.reverse_complement(whole)), 1, LENGTH).alias("r1"), F.substring(F.concat(whole, S.reverse_complement(handle), S.reverse_complement(F.lit(ADAPTER_T))), 1, LENGTH).alias("r2"))


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered stops and mutations of three targets with ends from 20 to 24."""
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    end = (F.lit(20) + F.col("user_id") % 5).cast("int")
    base = e.select((F.col("user_id") % 3 + 1).cast("int").alias("target_id"), F.when(F.col("event_id") % 2 == 0, "RRRY").otherwise("YYYR").alias("mask"), (F.col("event_id") % (end + 1)).cast("int").alias("pos"), end.alias("end"), "event_id")
    stop = base.select("target_id", "mask", F.lit("S").alias("kind"), "pos", "end")
    mutation = base.where("event_id % 4 = 0 and pos + 2 < `end`").select("target_id", "mask", F.lit("M").alias("kind"), (F.col("pos") + 2).alias("pos"), "end")
    removed = base.where("event_id % 9 = 0").select("target_id", "mask", F.explode(F.array(F.lit("Mq"), F.lit("Q"))).alias("kind"), "pos", "end")
    return stop.unionByName(mutation).unionByName(removed).groupBy("target_id", "mask", "kind", "pos", "end").agg(F.count(F.lit(1)).alias("cnt"))


def stop_targets(spark: SparkSession) -> DataFrame:
    """Three targets of 24 bases."""
    return spark.createDataFrame([(i, f"S{i}", ("ACGTTGCA" * 3)[i - 1 :] + "ACGTTGCA"[: i - 1]) for i in (1, 2, 3)], "target_id int, name string, seq string")


def result_set(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """Two result sets over the same pairs, by lineitem: set b moves, loses and finds some sites."""
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus")
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long")
    site = (F.col("l_partkey") % 50).cast("int")
    lost = (F.col("l_orderkey") % 7 == 0) if which == "a" else (F.col("l_orderkey") % 5 == 0)
    if which == "b":
        site = F.when(F.col("l_orderkey") % 11 == 0, site + 1).otherwise(site)
    tags = F.array_compact(F.array(F.when(F.col("l_returnflag") == "R", "treated").otherwise("untreated"), F.when(F.col("l_linestatus") == "O", "match"), F.when(F.col("l_quantity") > 40, "adapter"), F.when(F.col("l_quantity") < 5, "indels")))
    return li.select(
        F.lit(which).alias("set_name"), key.alias("pair_id"), F.when(~lost, (F.col("l_orderkey") % 3 + 1).cast("int")).alias("target_id"), F.when(F.col("l_returnflag") == "R", "RRRY").otherwise("YYYR").alias("mask"),
        F.when(lost, -1).otherwise(site).cast("int").alias("site"), F.when(lost, -1).otherwise(site + 30).cast("int").alias("end"), F.when(F.col("l_quantity") > 45, 2).otherwise(-1).cast("int").alias("muts"),
        F.col("l_quantity").cast("long").alias("multiplicity"), F.when(lost, "no match").alias("failure"), tags.alias("tags"),
    )


_RC = "reverse(translate({0}, 'ATCGatcg', 'TAGCtagc'))"
SQL = f"""
tgt AS MATERIALIZED (SELECT CAST(item_id + 1 AS INTEGER) AS target_id, 'T' || item_id AS name, left(translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC'), 120) AS seq FROM benchmark),
pr0 AS (SELECT event_id, t.target_id, CAST(event_id % 60 AS INTEGER) AS made_site, substring(seq, CAST(event_id % 60 AS INTEGER) + 1) AS frag, CASE event_id % 3 WHEN 0 THEN 'AAAT' WHEN 1 THEN 'CCCG' ELSE 'ACGT' END AS handle
  FROM events e JOIN tgt t ON t.target_id = e.user_id % (SELECT count(*) FROM benchmark) + 1),
pr1 AS (SELECT *, left(handle || {_RC.format('frag')} || '{ADAPTER_B}', {LENGTH}) AS x1, left(frag || {_RC.format('handle')} || {_RC.format("'" + ADAPTER_T + "'")}, {LENGTH}) AS x2, CAST(event_id % 20 AS INTEGER) AS k FROM pr0),
pr AS MATERIALIZED (SELECT event_id AS pair_id, 'p' || event_id AS identifier, CASE WHEN event_id % 11 = 0 THEN left(x1, 9) || 'N' || substring(x1, 11) ELSE x1 END AS r1,
  CASE WHEN event_id % 7 = 0 THEN left(x2, k) || translate(substring(x2, k + 1, 1), 'ACGT', 'CGTA') || substring(x2, k + 2) ELSE x2 END AS r2, target_id, made_site FROM pr1),
st0 AS (SELECT event_id, CAST(user_id % 3 + 1 AS INTEGER) AS target_id, CASE WHEN event_id % 2 = 0 THEN 'RRRY' ELSE 'YYYR' END AS mask, CAST(20 + user_id % 5 AS INTEGER) AS "end", CAST(event_id % (21 + user_id % 5) AS INTEGER) AS pos FROM events),
reg AS (SELECT target_id, mask, kind, pos, "end", count(*) AS cnt FROM (
  SELECT target_id, mask, 'S' AS kind, pos, "end" FROM st0 UNION ALL SELECT target_id, mask, 'M', pos + 2, "end" FROM st0 WHERE event_id % 4 = 0 AND pos + 2 < "end"
  UNION ALL SELECT target_id, mask, 'Mq', pos, "end" FROM st0 WHERE event_id % 9 = 0 UNION ALL SELECT target_id, mask, 'Q', pos, "end" FROM st0 WHERE event_id % 9 = 0) GROUP BY ALL),
li AS (SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS pair_id, l_orderkey AS o, CAST(l_partkey % 50 AS INTEGER) AS s, CAST(l_quantity AS BIGINT) AS multiplicity, l_quantity AS q, CASE WHEN l_returnflag = 'R' THEN 'RRRY' ELSE 'YYYR' END AS mask,
  list_filter([CASE WHEN l_returnflag = 'R' THEN 'treated' ELSE 'untreated' END, CASE WHEN l_linestatus = 'O' THEN 'match' END, CASE WHEN l_quantity > 40 THEN 'adapter' END, CASE WHEN l_quantity < 5 THEN 'indels' END], lambda x: x IS NOT NULL) AS tags FROM lineitem),
ra AS (SELECT pair_id, CASE WHEN o % 7 <> 0 THEN CAST(o % 3 + 1 AS INTEGER) END AS target_id, mask, CASE WHEN o % 7 = 0 THEN -1 ELSE s END AS site, CASE WHEN o % 7 = 0 THEN -1 ELSE s + 30 END AS "end", CASE WHEN q > 45 THEN 2 ELSE -1 END AS muts, multiplicity, CASE WHEN o % 7 = 0 THEN 'no match' END AS failure, tags FROM li),
rb0 AS (SELECT *, CASE WHEN o % 11 = 0 THEN s + 1 ELSE s END AS s2 FROM li),
rb AS (SELECT pair_id, CASE WHEN o % 5 <> 0 THEN CAST(o % 3 + 1 AS INTEGER) END AS target_id, mask, CASE WHEN o % 5 = 0 THEN -1 ELSE s2 END AS site, CASE WHEN o % 5 = 0 THEN -1 ELSE s2 + 30 END AS "end", CASE WHEN q > 45 THEN 2 ELSE -1 END AS muts, multiplicity, CASE WHEN o % 5 = 0 THEN 'no match' END AS failure, tags FROM rb0)"""


def sql(body: str, more: str = "") -> str:
    """A query over the domain tables tgt, pr, reg, ra, rb (and more of them)."""
    return f"WITH {SQL.strip()}{', ' + more if more else ''}\n{body}"
