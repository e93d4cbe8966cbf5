"""One query for each family of operators, over the driver's tables, with DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions import sequences as S
from ..operators import classify as K
from ..operators import counters as C
from ..operators import index as I
from ..operators import pairs as P
from ..operators import profiles as R
from ..operators import results as Q
from . import testbed as B

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
LOOKUP = B.CONFIG
PLAIN = RunConfig(allow_multiple_rt_starts=True)
COTRANS = RunConfig(cotrans=True)


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


_rc = B._RC.format

# --- pairs ---------------------------------------------------------------


@query(B.sql("SELECT min(pair_id) AS pair_id, r1, r2, count(*) AS multiplicity FROM pr GROUP BY r1, r2"))
def unique_pairs(spark, d):
    return P.unique_pairs(B.pairs(spark, d)).select("pair_id", "r1", "r2", "multiplicity")


@query(B.sql("SELECT count(*) AS pairs, count(DISTINCT r1) AS unique_r1, count(DISTINCT r2) AS unique_r2 FROM pr"))
def distinct_reads(spark, d):
    return P.distinct_reads(B.pairs(spark, d))


@query(B.sql("SELECT (SELECT max(n) FROM (SELECT count(*) AS n FROM pr GROUP BY r1)) AS max_r1, (SELECT max(n) FROM (SELECT count(*) AS n FROM pr GROUP BY r2)) AS max_r2"))
def max_group(spark, d):
    return P.max_group(B.pairs(spark, d))


@query(B.sql("SELECT CASE WHEN min(length(r1)) = max(length(r1)) AND min(length(r2)) = max(length(r2)) AND min(length(r1)) = min(length(r2)) THEN CAST(min(length(r1)) AS INTEGER) ELSE -1 END AS pair_length FROM pr"))
def pair_length(spark, d):
    return P.pair_length(B.pairs(spark, d))


@query(B.sql("SELECT CASE WHEN regexp_matches(r1, '^[AG][AG][AG][CT]') THEN 'RRRY' WHEN regexp_matches(r1, '^[CT][CT][CT][AG]') THEN 'YYYR' END AS mask, count(*) AS pairs FROM pr GROUP BY 1"))
def handle_match(spark, d):
    return P.with_mask(B.pairs(spark, d)).groupBy("mask").agg(F.count(F.lit(1)).alias("pairs"))


@query(B.sql("SELECT pair_id FROM pr WHERE NOT regexp_matches(r1 || r2, '[^ACGT]')"))
def determinate_filter(spark, d):
    return P.determinate(B.pairs(spark, d)).select("pair_id")


@query(B.sql("SELECT pair_id, identifier FROM pr WHERE pair_id > 100 ORDER BY pair_id LIMIT 50"))
def page(spark, d):
    return P.page(B.pairs(spark, d), 100, 50).select("pair_id", "identifier")


@query(B.sql("SELECT p.pair_id FROM pr p WHERE NOT EXISTS (SELECT 1 FROM ra WHERE ra.pair_id = p.pair_id)"))
def resume_antijoin(spark, d):
    return P.unprocessed(B.pairs(spark, d), B.result_set(spark, d, "a"), "a").select("pair_id")


@query(B.sql("SELECT count(*) AS pairs, count(DISTINCT pair_id) AS ids FROM (SELECT pair_id FROM pr UNION ALL SELECT pair_id + 1000000 FROM pr)"))
def union_inputs(spark, d):
    p = B.pairs(spark, d).select("pair_id")
    return P.union(p, p.select((F.col("pair_id") + 1000000).alias("pair_id"))).agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("pair_id").alias("ids"))


@query(B.sql("SELECT pair_id, r1, r2 FROM pr ORDER BY md5(concat_ws(':', identifier, pair_id, 0)), pair_id LIMIT 100"))
def sample(spark, d):
    return P.sample(B.pairs(spark, d), 100).select("pair_id", "r1", "r2")


# --- sequence functions ---------------------------------------------------


@query(B.sql(f"SELECT pair_id, {_rc('r1')} AS r1_rc FROM pr"))
def revcomp(spark, d):
    return B.pairs(spark, d).select("pair_id", S.reverse_complement("r1").alias("r1_rc"))


_MISMATCH = "list_filter(range(0, least(length(r2), length(seq) - made_site)), lambda i: substring(r2, i + 1, 1) <> substring(seq, made_site + i + 1, 1))"


@query(B.sql(f"SELECT pair_id, array_to_string({_MISMATCH}, ',') AS errors, CAST(len({_MISMATCH}) AS INTEGER) AS distance FROM pr JOIN tgt USING (target_id)"))
def mismatch_list(spark, d):
    both = B.pairs(spark, d).join(B.targets(spark, d).select("target_id", "seq"), "target_id")
    part = F.substring("seq", F.col("made_site") + 1, F.length("seq"))
    return both.select("pair_id", F.array_join(S.mismatches("r2", part), ",").alias("errors"), S.hamming("r2", part).alias("distance"))


@query(B.sql("""SELECT pair_id, CAST(CASE WHEN contains(r1, 'AGATCGGAAG') THEN instr(r1, 'AGATCGGAAG') - 1
  ELSE coalesce((SELECT min(h) FROM range(27, 36) t(h) WHERE starts_with('AGATCGGAAG', substring(r1, CAST(h AS INTEGER) + 1))), -1) END AS INTEGER) AS at FROM pr"""))
def find_with_overlap(spark, d):
    return B.pairs(spark, d).select("pair_id", S.find_with_overlap(F.lit("AGATCGGAAG"), "r1").alias("at"))


@query(B.sql("SELECT pair_id, array_to_string(list_filter(range(0, length(r2) - 11), lambda t: hamming(substring(r2, t + 1, 12), substring(seq, made_site + 1, 12)) <= 1)[1:2], ',') AS places FROM pr JOIN tgt USING (target_id)"))
def near_places(spark, d):
    both = B.pairs(spark, d).join(B.targets(spark, d).select("target_id", "seq"), "target_id")
    return both.select("pair_id", F.array_join(S.find_with_errors(F.substring("seq", F.col("made_site") + 1, F.lit(12)), "r2", 1), ",").alias("places"))


@query(B.sql("SELECT identifier, r1, r2, repeat('I', CAST(length(r1) AS INTEGER)) AS r1_qual, repeat('I', CAST(length(r2) AS INTEGER)) AS r2_qual FROM pr"))
def fastq_round_trip(spark, d):
    """Pairs written as block gzip shards and read back, large shards by record ranges."""
    from ..sinks.exports import write_fastq
    from ..sinks.shards import shard_files
    from ..sources.reads import read_fastq
    from ..sources.work import new_folder

    path = new_folder(spark, "fastq")
    write_fastq(B.pairs(spark, d).repartition("pair_id"), path, gzip=True)
    files = [shard_files(path, r) for r in ("R1", "R2")]
    return read_fastq(spark, *files, split_bytes=64 << 10).select("identifier", "r1", "r2", "r1_qual", "r2_qual")


# every item's bases from item_id % 60 on, with the 6th and the 16th changed, sought in all items
_CHANGED = "substring(seq, {0}, 5) || translate(substring(seq, {0} + 5, 1), 'ACGT', 'CGTA') || substring(seq, {0} + 6, 9) || translate(substring(seq, {0} + 15, 1), 'ACGT', 'GTAC') || substring(seq, {0} + 16, 8)"


@query(B.sql("""SELECT CAST(e AS INTEGER) AS errors, query_id, target_id, CAST(pos AS INTEGER) AS pos, CAST(distance AS INTEGER) AS distance FROM (
  SELECT e, q.target_id AS query_id, t.target_id, p AS pos, hamming(q.part, substring(t.seq, p + 1, length(q.part))) AS distance
  FROM prt q, (SELECT target_id, seq, CAST(unnest(range(0, length(seq))) AS INTEGER) AS p FROM tgt) t, (SELECT unnest(range(0, 5)) AS e) WHERE length(q.part) > e AND p + length(q.part) <= length(t.seq)) WHERE distance <= errors""",
  f"prt AS (SELECT target_id, {_CHANGED.format('CAST(target_id % 60 + 1 AS INTEGER)')} AS part FROM tgt)"))
def approximate_places(spark, d):
    from ..operators.edits import places_with_errors

    t = B.targets(spark, d)
    parts = t.select(F.col("target_id").alias("query_id"), F.expr(_CHANGED.format("(target_id % 60 + 1)")).alias("seq"))
    out = None
    for errors in range(5):
        found = places_with_errors(parts, t, errors).select(F.lit(errors).alias("errors"), "query_id", "target_id", "pos", "distance")
        out = found if out is None else out.unionByName(found)
    return out


# --- target index ---------------------------------------------------------

_KMERS = "km AS (SELECT target_id, CAST(pos AS INTEGER) AS pos, substring(seq, pos + 1, 8) AS word FROM (SELECT target_id, seq, unnest(range(0, length(seq) - 7)) AS pos FROM tgt))"


@query(B.sql("SELECT * FROM km", _KMERS))
def kmer_index(spark, d):
    return I.kmer_index(B.targets(spark, d))


@query(B.sql("SELECT word, count(DISTINCT target_id) AS targets, count(*) AS places FROM km GROUP BY word HAVING count(DISTINCT target_id) > 1", _KMERS))
def shared_words(spark, d):
    return I.kmer_index(B.targets(spark, d)).groupBy("word").agg(F.count_distinct("target_id").alias("targets"), F.count(F.lit(1)).alias("places")).where("targets > 1")


def _queries(spark, d):
    return B.pairs(spark, d).select(F.col("pair_id").alias("query_id"), F.col("r2").alias("seq"))


# R2 reads of 36 bases: check sites for 20 and for 10 bases, seeds of 8, extension to both sides
def _seed_sql(need: int) -> str:
    step = max(need - 8, 1)
    last = 36 - max(step, 8)
    sites = sorted({*range(0, last, step), last})
    return f"""SELECT query_id, target_id, site - a AS q_start, a + b + 8 AS length, pos - a AS t_start, min(site) AS site, min(pos) AS pos FROM (
  SELECT query_id, target_id, site, pos,
    coalesce((SELECT min(i) FROM range(0, 36) t(i) WHERE i >= least(site, pos) OR substring(q, site - CAST(i AS INTEGER), 1) <> substring(seq, pos - CAST(i AS INTEGER), 1)), 0) AS a,
    coalesce((SELECT min(i) FROM range(0, 36) t(i) WHERE i >= least(36 - site - 8, length(seq) - pos - 8) OR substring(q, site + 9 + CAST(i AS INTEGER), 1) <> substring(seq, pos + 9 + CAST(i AS INTEGER), 1)), 0) AS b
  FROM (SELECT pair_id AS query_id, r2 AS q, unnest({sites}) AS site FROM pr) s JOIN km ON km.word = substring(q, site + 1, 8) JOIN tgt USING (target_id)) WHERE a + b + 8 >= {need} GROUP BY ALL"""


def _best_sql(hits: str) -> str:
    return f"""SELECT query_id, target_id, q_start, length, t_start, n_targets FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY site, target_id, pos) AS rn, len(list_distinct(list(target_id) OVER (PARTITION BY query_id))) AS n_targets
  FROM (SELECT *, max(length) OVER (PARTITION BY query_id) AS most FROM {hits}) WHERE length = most) WHERE rn = 1"""


@query(B.sql(f"SELECT query_id, target_id, CAST(q_start AS INTEGER) AS q_start, CAST(length AS INTEGER) AS length, CAST(t_start AS INTEGER) AS t_start FROM ({_seed_sql(20)})", _KMERS))
def kmer_seed_join(spark, d):
    return I.seed_hits(_queries(spark, d), B.targets(spark, d), 20).select("query_id", "target_id", "q_start", "length", "t_start")


@query(B.sql(f"""SELECT query_id, CAST(max(length) AS INTEGER) AS length, CAST(count(DISTINCT target_id) FILTER (WHERE length = most) AS INTEGER) AS n_targets FROM (SELECT *, max(length) OVER (PARTITION BY query_id) AS most FROM ({_seed_sql(20)})) GROUP BY query_id""", _KMERS))
def best_match(spark, d):
    return I.best_match(I.seed_hits(_queries(spark, d), B.targets(spark, d), 20)).select("query_id", "length", "n_targets")


@query(B.sql(f"""SELECT query_id, target_id, CAST(q_start AS INTEGER) AS q_start, CAST(length AS INTEGER) AS length, CAST(t_start AS INTEGER) AS t_start, CAST(n_targets AS INTEGER) AS n_targets FROM (
  SELECT * FROM b20 UNION ALL SELECT * FROM b10 WHERE query_id NOT IN (SELECT query_id FROM b20))""", f"{_KMERS}, h20 AS ({_seed_sql(20)}), b20 AS ({_best_sql('h20')}), h10 AS ({_seed_sql(10)}), b10 AS ({_best_sql('h10')})"))
def find_partial_matches(spark, d):
    return I.find_partial(_queries(spark, d), B.targets(spark, d))


@query(B.sql("""SELECT query_id, CAST(t AS INTEGER) AS target_id, CAST(p AS INTEGER) AS pos FROM (SELECT query_id, min(target_id * 1000 + pos) AS at, min(target_id * 1000 + pos) // 1000 AS t, min(target_id * 1000 + pos) % 1000 AS p
  FROM (SELECT pair_id AS query_id, left(r2, 24) AS q FROM pr) JOIN km ON word = left(q, 8) JOIN tgt USING (target_id) WHERE substring(seq, pos + 1, 24) = q GROUP BY query_id)""", _KMERS))
def find_exact(spark, d):
    """The first place of the first 24 bases of each R2."""
    return I.find_exact(_queries(spark, d).withColumn("seq", F.left("seq", F.lit(24))), B.targets(spark, d))


@query(B.sql("""SELECT query_id, CAST(max(length) AS INTEGER) AS length, CAST(count(DISTINCT target_id) FILTER (WHERE length = most) AS INTEGER) AS n_targets FROM (SELECT *, max(length) OVER (PARTITION BY query_id) AS most FROM (
  SELECT query_id, target_id, 8 + coalesce((SELECT min(i) FROM range(0, 36) t(i) WHERE i >= least(28, length(seq) - pos - 8) OR substring(q, 9 + CAST(i AS INTEGER), 1) <> substring(seq, pos + 9 + CAST(i AS INTEGER), 1)), 0) AS length
  FROM (SELECT pair_id AS query_id, r2 AS q FROM pr) JOIN km ON word = left(q, 8) JOIN tgt USING (target_id)) WHERE length >= 10) GROUP BY query_id""", _KMERS))
def find_prefix(spark, d):
    """Matches seeded at the first word of R2 only."""
    return I.find_prefix(_queries(spark, d), B.targets(spark, d)).select("query_id", "length", "n_targets")


@query(B.sql("""SELECT t.target_id, CAST(greatest(8, coalesce(max(n), 8)) AS INTEGER) AS length FROM tgt t LEFT JOIN (
  SELECT x.target_id, 8 + (SELECT min(i) FROM range(0, 121) r(i) WHERE i >= least(length(s.seq) - x.pos - 8, length(o.seq) - y.pos - 8) OR substring(s.seq, x.pos + 9 + CAST(i AS INTEGER), 1) <> substring(o.seq, y.pos + 9 + CAST(i AS INTEGER), 1)) AS n
  FROM km x JOIN km y ON x.word = y.word AND (x.target_id <> y.target_id OR x.pos <> y.pos) JOIN tgt s ON s.target_id = x.target_id JOIN tgt o ON o.target_id = y.target_id) USING (target_id) GROUP BY 1""", _KMERS))
def self_match(spark, d):
    return I.self_matches(B.targets(spark, d))


# --- lookup ---------------------------------------------------------------

_TABLE = f"""r1l AS MATERIALIZED (SELECT target_id, seq, i, left(left({_rc('seq')}, i) || '{B.ADAPTER_B}', 32) AS key, CASE WHEN i < 32 THEN length(seq) - i END AS site, 32 - i AS trim FROM tgt, (SELECT unnest(range(1, 33)) AS i))"""


@query(B.sql("SELECT key, target_id, CAST(site AS INTEGER) AS site, CAST(trim AS INTEGER) AS trim FROM r1l", _TABLE))
def r1_lookup_build(spark, d):
    from ..operators.lookup import r1_table

    return r1_table(B.targets(spark, d), LOOKUP, B.LENGTH).select("key", "target_id", "site", "trim")


# what follows the handle in R1, by pair_id % 3 as it is, with a base less, or with a base more
_EDITED = "CASE pair_id % 3 WHEN 0 THEN substring(r1, 5, 32) WHEN 1 THEN substring(r1, 5, k) || substring(r1, k + 6, 32) || 'A' ELSE substring(substring(r1, 5, k) || 'C' || substring(r1, k + 5, 32), 1, 32) END"


# the twin lists every variant of every key
@query(B.sql("""SELECT pair_id, key AS table_key, edit, place FROM (
  SELECT DISTINCT pair_id, key, 'none' AS edit, NULL::INTEGER AS place FROM ask JOIN (SELECT DISTINCT key FROM r1l) ON seq = key UNION ALL
  SELECT pair_id, key, CASE min(kind) WHEN 0 THEN 'substitution' WHEN 1 THEN 'insertion' ELSE 'deletion' END, CAST(any_value((SELECT min(i) FROM range(0, 32) t(i) WHERE substring(key, CAST(i AS INTEGER) + 1, 1) <> substring(seq, CAST(i AS INTEGER) + 1, 1))) AS INTEGER)
  FROM (SELECT * FROM ask WHERE seq NOT IN (SELECT key FROM r1l)) a JOIN var v ON v.shown = a.seq GROUP BY pair_id, key, seq)""",
  f"""{_TABLE}, ask AS (SELECT pair_id, {_EDITED} AS seq FROM (SELECT *, CAST(pair_id % 20 AS INTEGER) AS k FROM pr)),
  keys AS (SELECT DISTINCT key, j, b FROM r1l, (SELECT CAST(unnest(range(0, 32)) AS INTEGER) AS j), (SELECT unnest(['A', 'C', 'G', 'T', 'N']) AS b)),
  var AS (SELECT key, 0 AS kind, left(key, j) || b || substring(key, j + 2) AS shown FROM keys UNION ALL SELECT key, 1, left(left(key, j) || b || substring(key, j + 1), 32) FROM keys UNION ALL SELECT key, 2, left(key, j) || substring(key, j + 2) || b FROM keys)"""))
def one_edit_keys(spark, d):
    from ..operators.edits import one_edit_hits
    from ..operators.lookup import r1_table

    reads = B.pairs(spark, d).withColumn("k", (F.col("pair_id") % 20).cast("int")).select("pair_id", F.expr(_EDITED).alias("seq"))
    return one_edit_hits(reads, r1_table(B.targets(spark, d), LOOKUP, B.LENGTH))


_CLASSIFY = f"""{_KMERS}, {_TABLE},
sm AS MATERIALIZED (SELECT t.target_id, greatest(10, coalesce(max(n), 10)) + 1 AS r2_len FROM tgt t LEFT JOIN (
  SELECT x.target_id, 8 + (SELECT min(i) FROM range(0, 121) r(i) WHERE i >= least(length(s.seq) - x.pos - 8, length(s.seq) - y.pos - 8) OR substring(s.seq, x.pos + 9 + CAST(i AS INTEGER), 1) <> substring(s.seq, y.pos + 9 + CAST(i AS INTEGER), 1)) AS n
  FROM km x JOIN km y ON x.word = y.word AND x.target_id = y.target_id AND x.pos <> y.pos JOIN tgt s ON s.target_id = x.target_id) USING (target_id) GROUP BY 1),
msk AS MATERIALIZED (SELECT *, CASE WHEN regexp_matches(r1, '^[AG][AG][AG][CT]') THEN 'RRRY' WHEN regexp_matches(r1, '^[CT][CT][CT][AG]') THEN 'YYYR' END AS mask FROM (SELECT pair_id, r1, r2 FROM pr)),
hit AS MATERIALIZED (SELECT m.*, l.target_id, l.seq, l.trim, l.i, l.site AS r1_site, r2_len,
  CASE WHEN l.site IS NOT NULL THEN l.site WHEN contains(l.seq, left(r2, CAST(r2_len AS INTEGER))) THEN instr(l.seq, left(r2, CAST(r2_len AS INTEGER))) - 1 END AS s FROM msk m JOIN r1l l ON substring(r1, 5) = l.key JOIN sm USING (target_id) WHERE mask IS NOT NULL),
prt AS (SELECT *, CAST(s AS INTEGER) AS s0, CAST(least(36, length(seq) - s) AS INTEGER) AS m, {_rc('left(substring(r1, 5), CAST(32 - trim AS INTEGER))')} AS read1 FROM hit),
jdg AS (SELECT *, CAST(length(seq) - length(read1) AS INTEGER) AS d1,
  CASE WHEN s IS NULL THEN 'no match'
  WHEN hamming(left(r2, m), substring(seq, s0 + 1, m)) > 0 THEN 'match errors failure'
  WHEN 36 - m - 4 > 0 AND hamming(right(r2, 36 - m - 4), left({_rc("'" + B.ADAPTER_T + "'")}, 36 - m - 4)) > 0 THEN 'adapter trim failure'
  WHEN regexp_matches(r1 || r2, '[^ACGT]') THEN 'indeterminate sequence failure' END AS f0,
  count(*) OVER (PARTITION BY pair_id, trim) AS same FROM prt),
ovl AS (SELECT *, CASE WHEN max(same) OVER (PARTITION BY pair_id) > 1 THEN 'multiple R1 match' WHEN f0 IS NOT NULL THEN f0
  WHEN s0 + m > greatest(d1, s0) AND substring(read1, greatest(d1, s0) - d1 + 1, s0 + m - greatest(d1, s0)) <> substring(r2, greatest(d1, s0) - s0 + 1, s0 + m - greatest(d1, s0)) THEN 'R1/R2 disagree on overlap' END AS failure FROM jdg),
one AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY (failure IS NULL) DESC, CASE WHEN failure IS NULL THEN target_id END, CASE WHEN failure IS NULL THEN i END, target_id DESC, i DESC) AS rn FROM ovl) WHERE rn = 1),
cls AS (SELECT m.pair_id, m.mask, CASE WHEN o.failure IS NULL THEN o.target_id END AS target_id, CASE WHEN o.failure IS NULL THEN o.s0 END AS site, CASE WHEN o.failure IS NULL THEN CAST(length(o.seq) AS INTEGER) END AS "end",
  CASE WHEN m.mask IS NULL THEN 'mask failure' WHEN o.pair_id IS NULL THEN 'no match' ELSE o.failure END AS failure FROM msk m LEFT JOIN one o USING (pair_id))"""


@query(B.sql('SELECT pair_id, mask, target_id, site, "end", failure FROM cls', _CLASSIFY))
def lookup_classify(spark, d):
    return K.classify(B.pairs(spark, d), B.targets(spark, d), LOOKUP).select("pair_id", "mask", "target_id", "site", "end", "failure")


@query(B.sql("SELECT failure, count(*) AS cnt FROM cls GROUP BY failure", _CLASSIFY))
def failure_counts(spark, d):
    return C.failures(K.classify(B.pairs(spark, d), B.targets(spark, d), LOOKUP))


@query(B.sql("SELECT mask, count(*) AS total, CAST(count(site) AS BIGINT) AS kept FROM cls WHERE mask IS NOT NULL GROUP BY mask", _CLASSIFY))
def mask_totals(spark, d):
    return C.mask_totals(K.classify(B.pairs(spark, d), B.targets(spark, d), LOOKUP))


@query(B.sql('SELECT target_id, mask, \'S\' AS kind, site AS pos, "end", count(*) AS cnt FROM cls WHERE site IS NOT NULL GROUP BY ALL', _CLASSIFY))
def registered_stops(spark, d):
    return C.registered(K.classify(B.pairs(spark, d), B.targets(spark, d), LOOKUP))


# What the default strategy has to find follows from how a pair was made: it shows its target from made_site to the end; one base of R2
# is changed in every seventh, which is a mutation unless R1 (its 32 last bases of the target) shows the same base unchanged.
_MADE = """mde AS (SELECT pair_id, CASE WHEN unclear THEN NULL ELSE mask END AS mask, t AS target_id, s AS site, n AS "end", c, n - s AS frag,
  CASE WHEN unclear THEN 'indeterminate sequence failure' WHEN mask IS NULL THEN 'mask failure' WHEN c >= n - 32 THEN 'R1/R2 disagree on overlap' END AS failure
  FROM (SELECT pair_id, contains(r1, 'N') OR contains(r2, 'N') AS unclear, CASE WHEN regexp_matches(r1, '^[AG][AG][AG][CT]') THEN 'RRRY' WHEN regexp_matches(r1, '^[CT][CT][CT][AG]') THEN 'YYYR' END AS mask,
    target_id AS t, made_site AS s, length(seq) AS n, CASE WHEN pair_id % 7 = 0 AND pair_id % 20 < length(seq) - made_site THEN made_site + pair_id % 20 END AS c FROM pr JOIN tgt USING (target_id))),
good AS (SELECT * FROM mde WHERE failure IS NULL), kept AS (SELECT * FROM good WHERE c IS NULL OR c > site)"""


@query(B.sql("""SELECT pair_id, mask, CASE WHEN failure IS NULL THEN target_id END AS target_id, CASE WHEN failure IS NULL THEN CAST(site AS INTEGER) END AS site, CASE WHEN failure IS NULL THEN CAST("end" AS INTEGER) END AS "end",
  CASE WHEN failure IS NULL AND c IS NOT NULL THEN CAST(c + 1 AS VARCHAR) ELSE '' END AS mutations, failure FROM mde""", _MADE))
def classify_partial(spark, d):
    return K.classify(B.pairs(spark, d), B.targets(spark, d), RunConfig(count_mutations=True)).select("pair_id", "mask", "target_id", "site", "end", F.array_join("mutations", ",").alias("mutations"), "failure")


@query()
def align_indels(spark, d):
    config = RunConfig(count_mutations=True, handle_indels=True, allowed_target_errors=2)
    return K.classify(B.pairs(spark, d), B.targets(spark, d), config).select("pair_id", "target_id", "site", "end", F.size(F.map_keys("r1_indels")).alias("r1_indels"), F.size(F.map_keys("r2_indels")).alias("r2_indels"), "failure")


@query(B.sql("""SELECT * FROM (
  SELECT 'total_pairs' AS name, count(*) AS cnt FROM mde UNION ALL SELECT 'indeterminate', count(*) FROM mde WHERE failure LIKE 'indeterminate%' UNION ALL SELECT 'mask_failure', count(*) FROM mde WHERE failure = 'mask failure'
  UNION ALL SELECT mask || '_total', count(*) FROM mde WHERE mask IS NOT NULL GROUP BY mask UNION ALL SELECT 'adapter_trimmed', count(*) FROM mde WHERE mask IS NOT NULL AND frag < 32
  UNION ALL SELECT 'r1_r2_overlap', count(*) FROM mde WHERE failure LIKE 'R1/R2%' UNION ALL SELECT x || CASE WHEN c IS NULL THEN '0' ELSE '1' END, count(*) FROM good, (SELECT unnest(['mut_count_', 'mapped_mut_count_']) AS x) GROUP BY 1
  UNION ALL SELECT 'edge_muts', count(*) FROM good WHERE c = site UNION ALL SELECT 'registered_pairs', count(*) FROM kept UNION ALL SELECT mask || '_kept', count(*) FROM kept GROUP BY mask
  UNION ALL SELECT 'mutations', count(c) FROM kept UNION ALL SELECT mask || '_mut', count(c) FROM kept GROUP BY mask) WHERE cnt > 0""", _MADE))
def named_counters(spark, d):
    return C.named(K.classify(B.pairs(spark, d), B.targets(spark, d), RunConfig(count_mutations=True)))


@query(B.sql("""SELECT m.pair_id, a.target_id AS target_id_a, a.site AS site_a, a."end" AS end_a, a.failure AS failure_a,
  CASE WHEN m.failure IS NULL THEN m.target_id END AS target_id_b, CASE WHEN m.failure IS NULL THEN CAST(m.site AS INTEGER) END AS site_b, CASE WHEN m.failure IS NULL THEN CAST(m."end" AS INTEGER) END AS end_b, m.failure AS failure_b
  FROM cls a JOIN mde m USING (pair_id) WHERE (a.site IS NULL) <> (m.failure IS NOT NULL) OR (a.site IS NOT NULL AND m.failure IS NULL AND (a.target_id <> m.target_id OR a.site <> m.site OR a."end" <> m."end"))""", f"{_CLASSIFY}, {_MADE}"))
def compare_strategies(spark, d):
    """The table-driven strategy without mutations against the default one with them: pairs with a mutation differ."""
    return K.compare_runs(B.pairs(spark, d), B.targets(spark, d), LOOKUP, RunConfig(count_mutations=True))


@query()
def tag_reads(spark, d):
    from ..operators.tags import assign

    p, t = B.pairs(spark, d), B.targets(spark, d)
    return assign(K.classify(p, t, RunConfig(allow_indeterminate=True, allowed_target_errors=2, allowed_adapter_errors=2)), p, t).select("pair_id", F.array_join("tags", ",").alias("tags"))


# without mutations a pair matches if none of its bases was changed; what the others show is found by words of 8 bases
_TAGGED = f"""tgn AS (SELECT 'T' || (target_id - 1) AS name, seq FROM tgt UNION ALL SELECT 'T' || (target_id - 1) || '_rc', {_rc('seq')} FROM tgt UNION ALL SELECT * FROM (VALUES
    ('adapter_t', '{B.ADAPTER_T}'), ('adapter_b', '{B.ADAPTER_B}'), ('adapter_t_rc', {_rc("'" + B.ADAPTER_T + "'")}), ('adapter_b_rc', {_rc("'" + B.ADAPTER_B + "'")})) v(name, seq)),
tgw AS (SELECT DISTINCT name, substring(seq, pos + 1, 8) AS word FROM (SELECT name, seq, unnest(range(0, length(seq) - 7)) AS pos FROM tgn)),
off AS (SELECT m.pair_id, m.mask, p.r1, p.r2, contains(p.r1 || p.r2, 'N') AS unclear, CASE WHEN m.failure LIKE 'R1/R2%' OR m.failure IS NULL THEN 'match errors failure' ELSE m.failure END AS failure,
    CASE WHEN regexp_matches(p.r1, '^[AG][AG][AG][CT]') THEN 'RRRY' WHEN regexp_matches(p.r1, '^[CT][CT][CT][AG]') THEN 'YYYR' END AS handle FROM mde m JOIN pr p USING (pair_id) WHERE m.failure IS NOT NULL OR m.c IS NOT NULL),
fnd AS (SELECT pair_id, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT pair_id, substring(s, i + 1, 8) AS word FROM (SELECT pair_id, s, unnest(range(0, length(s) - 7)) AS i FROM (SELECT pair_id, unnest([r1, r2]) AS s FROM off))) JOIN tgw USING (word) GROUP BY pair_id)"""


@query(B.sql("""SELECT pair_id, concat_ws(',', 'match', 'T' || (target_id - 1), CASE WHEN frag < 32 THEN 'adapter' END, CASE mask WHEN 'RRRY' THEN 'treated' ELSE 'untreated' END) AS tags FROM mde WHERE failure IS NULL AND c IS NULL
  UNION ALL SELECT pair_id, concat_ws(',', CASE WHEN names IS NULL THEN 'unknown' END, failure, CASE WHEN unclear THEN 'indeterminate' END, CASE WHEN mask IS NULL THEN 'mask_failure' WHEN mask = 'RRRY' THEN 'treated' ELSE 'untreated' END, names) FROM off LEFT JOIN fnd USING (pair_id)""", f"{_MADE}, {_TAGGED}"))
def tag_pairs(spark, d):
    """Tags of matched and unmatched pairs under the plain options."""
    from ..operators.tags import assign

    p, t = B.pairs(spark, d), B.targets(spark, d)
    return assign(K.classify(p, t, RunConfig()), p, t).select("pair_id", F.array_join("tags", ",").alias("tags"))


@query(B.sql("SELECT mask, 'NONE' AS prefix, count(*) AS cnt, CAST(1 AS DOUBLE) AS share FROM mde WHERE mask IS NOT NULL GROUP BY mask", _MADE))
def prefix_hist(spark, d):
    return C.prefixes(K.classify(B.pairs(spark, d), B.targets(spark, d), RunConfig(count_left_prefixes=True, collapse_left_prefixes=True)))


@query(B.sql("""SELECT pair_id, target_id, CAST(made_site AS INTEGER) AS site, CAST(length(seq) AS INTEGER) AS "end", 0 AS r1_indels, CASE WHEN pair_id % 3 < 2 THEN 1 ELSE 0 END AS r2_indels,
  CASE WHEN pair_id % 3 = 2 THEN '' ELSE (CASE WHEN pair_id % 3 = 1 THEN 'insert' ELSE 'delete' END) END AS kind FROM pr JOIN tgt USING (target_id) WHERE length(seq) - made_site >= 70"""))
def planted_indels(spark, d):
    """Sites, ends and indels of pairs of which R2 has a base less or more."""
    config = RunConfig(count_mutations=True, handle_indels=True, allowed_target_errors=2)
    kind = F.array_join(F.transform(F.map_values("r2_indels"), lambda x: F.when(x["insert"], "insert").otherwise("delete")), ",")
    return K.classify(B.indel_pairs(spark, d), B.targets(spark, d), config).select("pair_id", "target_id", "site", "end", F.size(F.map_keys("r1_indels")).alias("r1_indels"), F.size(F.map_keys("r2_indels")).alias("r2_indels"), kind.alias("kind"))


@query(B.sql("""SELECT CASE pair_id % 2 WHEN 0 THEN 'RRRY' ELSE 'YYYR' END AS mask, CASE pair_id % 3 WHEN 0 THEN 'NONE' WHEN 1 THEN 'G' ELSE 'CA' END AS prefix, count(*) AS cnt FROM pr GROUP BY ALL"""))
def planted_prefixes(spark, d):
    return C.prefixes(K.classify(B.prefixed_pairs(spark, d), B.targets(spark, d), RunConfig(count_left_prefixes=True, collapse_left_prefixes=True)), mapped=True).select("mask", "prefix", "cnt")


@query(B.sql("SELECT CAST(c IS NOT NULL AS INTEGER) AS mutations, count(*) AS cnt FROM kept GROUP BY 1", _MADE))
def mut_hist(spark, d):
    return C.mutation_histogram(K.classify(B.pairs(spark, d), B.targets(spark, d), RunConfig(count_mutations=True)))


def _sam_line(flag: int, bad: int, pos: str, size: str, mate: str, span: str, seq: str) -> str:
    tab = "chr(9)"
    mapped = f" || {tab} || ".join(["identifier", f"'{flag}'", "'T' || (target_id - 1)", f"({pos} + 1)", "'255'", f"{size} || 'M'", "'='", f"({mate} + 1)", span, f"left({seq}, CAST({size} AS INTEGER))", "'*'", "'NM:i:0'"])
    failed = f" || {tab} || ".join(["identifier", f"'{bad}'", "'*'", "'0'", "'255'", "'*'", "'*'", "'0'", "'0'", seq, "'*'"])
    return f"CASE WHEN ok THEN {mapped} ELSE {failed} END"


# without mutations a pair is mapped if none of its bases was changed
_SAM = f"""sam AS (SELECT m.pair_id, p.identifier, p.r1, p.r2, m.target_id, site, "end", least(36, frag) AS size, frag, failure IS NULL AND c IS NULL AS ok FROM mde m JOIN pr p USING (pair_id)),
lns AS (SELECT pair_id, 0 AS mate, {_sam_line(83, 77, '"end" - size', 'size', 'site', '(-frag)', _rc('r1'))} AS line FROM sam
  UNION ALL SELECT pair_id, 1, {_sam_line(163, 141, 'site', 'size', '"end" - size', 'frag', 'r2')} FROM sam)"""


@query(B.sql("SELECT pair_id, CAST(mate AS INTEGER) AS mate, line FROM lns", f"{_MADE}, {_SAM}"))
def sam_rows(spark, d):
    from ..sinks.exports import sam_records

    p, t = B.pairs(spark, d), B.targets(spark, d)
    return sam_records(K.classify(p, t, RunConfig()), p, t)


@query(B.sql("""SELECT identifier AS qname, 'T' || (target_id - 1) AS target, CAST(site AS INTEGER) AS site, CAST("end" AS INTEGER) AS "end" FROM sam WHERE ok""", f"{_MADE}, {_SAM}"))
def sam_round_trip(spark, d):
    """Mapped pairs as they are read back from written SAM shards."""
    from ..sinks.exports import write_sam
    from ..sinks.shards import shard_files
    from ..sources.reads import read_sam, sam_pairs
    from ..sources.work import new_folder

    p, t, path = B.pairs(spark, d), B.targets(spark, d), new_folder(spark, "sam")
    write_sam(K.classify(p, t, RunConfig()), p, t, path)
    return sam_pairs(read_sam(spark, shard_files(path, "sam")), t)


@query(B.sql("""SELECT pair_id, CAST(site AS INTEGER) AS site, CASE WHEN c IS NOT NULL AND pair_id % 2 = 1 THEN CAST(c + 1 AS VARCHAR) ELSE '' END AS mutations, CASE WHEN c IS NOT NULL AND pair_id % 2 = 0 THEN CAST(c + 1 AS VARCHAR) ELSE '' END AS removed FROM good""", _MADE))
def planted_qualities(spark, d):
    """Mutations that stay and go by the quality of their base, of pairs that match."""
    config = RunConfig(count_mutations=True, mutations_require_quality_score=30)
    done = C.matched(K.classify(B.graded_pairs(spark, d), B.targets(spark, d), config))
    return done.select("pair_id", "site", F.array_join("mutations", ",").alias("mutations"), F.array_join("removed_mutations", ",").alias("removed"))


# R1 shows the last 12 bases of a transcript; where another target has them, too, it names no target
@query(B.sql("""SELECT pair_id, CASE WHEN n = 1 THEN target_id END AS target_id, CASE WHEN n = 1 THEN CAST(s AS INTEGER) END AS site, CASE WHEN n = 1 THEN CAST(e AS INTEGER) END AS "end", CASE WHEN n > 1 THEN 'multiple R1 match' END AS failure
  FROM cut JOIN (SELECT part, count(*) AS n FROM (SELECT DISTINCT part FROM cut) JOIN tgt ON contains(seq, part) GROUP BY part) USING (part)""",
  "trs AS (SELECT pair_id, target_id, seq, pair_id % 20 AS s, least(40 + pair_id % 60, length(seq)) AS e FROM pr JOIN tgt USING (target_id)), cut AS (SELECT *, substring(seq, CAST(e - 11 AS INTEGER), 12) AS part FROM trs)"))
def planted_transcripts(spark, d):
    return K.classify(B.transcripts(spark, d), B.targets(spark, d), RunConfig(cotrans=True)).select("pair_id", "target_id", "site", "end", "failure")


@query(SQL["named_counters"])
def observed_counters(spark, d):
    """The named counters as the pass that writes the results observes them."""
    from ..sources.work import new_folder

    config = RunConfig(count_mutations=True)
    counts = C.write_counted(K.classify(B.pairs(spark, d), B.targets(spark, d), config), new_folder(spark, "results"), config)
    return spark.createDataFrame(sorted(counts.items()), "name string, cnt long")


@query(SQL["unique_pairs"])
def kept_unique_pairs(spark, d):
    """Unique pairs of three batches, merged from what each added."""
    from ..operators.kept import Kept
    from ..sources.work import new_folder

    folder = new_folder(spark, "kept")
    kept = Kept(spark, folder, "kept_" + folder[-32:], 8)
    for k in range(3):
        kept.add_pairs(B.pairs(spark, d).where(F.col("pair_id") % 3 == k), f"batch-{k}")
    return kept.unique_pairs().select("pair_id", "r1", "r2", "multiplicity")


# places and regions of millions of bases
@query(B.sql("""SELECT pair_id FROM (SELECT DISTINCT n, pair_id FROM (SELECT n, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS pair_id, unnest([CAST(l_partkey * 997 % 3000017 AS INTEGER), CAST(l_suppkey * 7919 % 3000017 AS INTEGER)]) AS place FROM (SELECT *, row_number() OVER () AS n FROM lineitem))
  JOIN (SELECT CAST(o_orderkey * 31 % 3000017 AS INTEGER) AS "start", CAST(o_orderkey * 31 % 3000017 + o_custkey % 40 AS INTEGER) AS stop FROM orders) r ON place BETWEEN r."start" AND r.stop)"""))
def region_results(spark, d):
    li, o = B.load(spark, d, "lineitem"), B.load(spark, d, "orders")
    place = lambda c, k: (F.col(c) * k % 3000017).cast("int")
    results = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("pair_id"), place("l_partkey", 997).alias("site"), F.array(place("l_suppkey", 7919)).alias("mutations"))
    regions = o.select(place("o_orderkey", 31).alias("start"), (place("o_orderkey", 31) + F.col("o_custkey") % 40).cast("int").alias("stop"))
    return Q.by_region(results, regions).select("pair_id")


# --- counters and profiles ------------------------------------------------

_SPINE = """ends AS (SELECT DISTINCT target_id, "end" FROM reg UNION SELECT unnest([1, 2, 3]), 24),
spn AS (SELECT target_id, "end", mask, CAST(unnest(range(0, "end" + 1)) AS INTEGER) AS site FROM ends, (SELECT unnest(['RRRY', 'YYYR']) AS mask)),
den AS (SELECT s.target_id, s."end", s.mask, s.site, coalesce(sum(cnt) FILTER (WHERE kind = 'S'), 0) AS n, coalesce(sum(cnt) FILTER (WHERE kind = 'M'), 0) AS m, coalesce(sum(cnt) FILTER (WHERE kind = 'Q'), 0) AS k
  FROM spn s LEFT JOIN reg r ON r.target_id = s.target_id AND r."end" = s."end" AND r.mask = s.mask AND r.pos = s.site GROUP BY ALL),
dep AS (SELECT *, sum(n) OVER w AS depth, sum(n - k) OVER w AS qdepth FROM den WINDOW w AS (PARTITION BY target_id, "end", mask ORDER BY site))"""
_SIDES = """sid AS (SELECT target_id, "end", site, sum(n) FILTER (WHERE mask = 'RRRY') AS nt_, sum(n) FILTER (WHERE mask = 'YYYR') AS nu, sum(m) FILTER (WHERE mask = 'RRRY') AS mt, sum(m) FILTER (WHERE mask = 'YYYR') AS mu_,
  sum(depth) FILTER (WHERE mask = 'RRRY') AS dt, sum(depth) FILTER (WHERE mask = 'YYYR') AS du, sum(qdepth) FILTER (WHERE mask = 'RRRY') AS qt, sum(qdepth) FILTER (WHERE mask = 'YYYR') AS qu FROM dep GROUP BY ALL),
whl AS (SELECT target_id, 24 AS "end", site, sum(nt_) AS nt_, sum(nu) AS nu, sum(mt) AS mt, sum(mu_) AS mu_, sum(dt) AS dt, sum(du) AS du, sum(qt) AS qt, sum(qu) AS qu FROM sid GROUP BY ALL)"""


def _profile_sql(source: str, clamp: bool = True) -> str:
    c = (lambda x: f"greatest({x}, 0.0)") if clamp else (lambda x: x)
    return f"""p0 AS (SELECT *, CASE WHEN dt > 0 THEN CAST(nt_ AS DOUBLE) / dt END AS x, CASE WHEN du > 0 THEN CAST(nu AS DOUBLE) / du END AS y, CASE WHEN qt <> 0 THEN CAST(mt AS DOUBLE) / qt END AS tt, CASE WHEN qu <> 0 THEN CAST(mu_ AS DOUBLE) / qu END AS uu FROM {source}),
p1 AS (SELECT *, site < "end" AND x < 1 AND y < 1 AS ok, site < "end" AND tt IS NOT NULL AND uu IS NOT NULL AND uu <> 1 AS fine FROM p0),
p2 AS (SELECT *, CASE WHEN ok THEN (x - y) / (1 - y) END AS raw, coalesce({c("CASE WHEN ok THEN ln(1 - y) - ln(1 - x) END")}, 0.0) AS th, CASE WHEN fine THEN (tt - uu) / (1 - uu) END AS mraw,
  CASE WHEN ok AND sqrt(((nt_ + nu) / (dt + du)) * (1 - (nt_ + nu) / (dt + du)) * (1.0 / dt + 1.0 / du)) > 0 THEN (x - y) / sqrt(((nt_ + nu) / (dt + du)) * (1 - (nt_ + nu) / (dt + du)) * (1.0 / dt + 1.0 / du)) WHEN ok THEN x - y END AS zr FROM p1),
p3 AS (SELECT *, coalesce({c("raw") if clamp else "raw"}, 0.0) AS beta, coalesce({c("mraw")}, 0.0) AS mu, coalesce({c("zr")}, 0.0) AS z FROM p2),
p4 AS (SELECT *, coalesce(sum(CASE WHEN raw < 1 THEN -ln(1 - raw) END) OVER w, 0) AS c, coalesce(sum(CASE WHEN ok AND beta < 1 THEN -ln(1 - beta) END) OVER w, 0) AS ct,
  CASE WHEN max(CASE WHEN fine AND mu >= 1 THEN 1 ELSE 0 END) OVER w = 1 THEN CAST('Infinity' AS DOUBLE) ELSE coalesce(sum(CASE WHEN fine AND mu < 1 THEN -ln(1 - mu) END) OVER w, 0) END AS cm FROM p3 WINDOW w AS (PARTITION BY target_id, "end"))"""


def _stops(spark, d):
    return B.stops(spark, d), B.stop_targets(spark)


@query(B.sql('SELECT target_id, "end", mask, site, CAST(n AS BIGINT) AS stops, CAST(depth AS BIGINT) AS depth, CAST(qdepth AS BIGINT) AS qdepth FROM dep', _SPINE))
def depth_coverage(spark, d):
    counts, t = _stops(spark, d)
    ends = counts.select("target_id", "end").unionByName(t.select("target_id", F.length("seq").alias("end")))
    return C.per_site(counts, C.spine(ends, t), ("RRRY", "YYYR")).select("target_id", "end", "mask", "site", F.col("S").alias("stops"), "depth", "qdepth")


_THETA = 'SELECT target_id, "end", site, round(beta, 9) AS beta, round(greatest(th / CASE WHEN ct <> 0 THEN ct ELSE 1 END, 0.0), 9) AS theta, round("end" * greatest(th / CASE WHEN ct <> 0 THEN ct ELSE 1 END, 0.0), 9) AS rho, round(z, 9) AS z, round(c, 9) AS c, round(ct, 9) AS c_thresh FROM p4'


def _theta(p: DataFrame) -> DataFrame:
    return _rounded(p.select("target_id", "end", "site", "beta", "theta", "rho", "z", "c", "c_thresh"), "beta", "theta", "rho", "z", "c", "c_thresh")


@query(B.sql(_THETA, f"{_SPINE}, {_SIDES}, {_profile_sql('whl')}"))
def profile_theta(spark, d):
    return _theta(R.compute(*_stops(spark, d), PLAIN))


@query(B.sql(_THETA, f"{_SPINE}, {_SIDES}, {_profile_sql('(SELECT * FROM sid WHERE ' + chr(34) + 'end' + chr(34) + ' >= 20)')}"))
def profile_cotrans(spark, d):
    counts, t = _stops(spark, d)
    return _theta(R.compute(counts, t, COTRANS).join(counts.select("target_id", "end").distinct().unionByName(t.select("target_id", F.length("seq").alias("end"))).distinct(), ["target_id", "end"], "left_semi"))


@query(B.sql('SELECT target_id, site, round(beta, 9) AS beta, round(mu, 9) AS mu, round(beta + mu, 9) AS r, round(ct + cm, 9) AS c_thresh FROM p4', f"{_SPINE}, {_SIDES}, {_profile_sql('whl')}"))
def profile_mut(spark, d):
    return _rounded(R.compute(*_stops(spark, d), PLAIN).select("target_id", "site", "beta", "mu", "r", F.col("c_thresh_mut").alias("c_thresh")), "beta", "mu", "r", "c_thresh")


@query(B.sql("SELECT target_id, CAST(sum(cnt) AS BIGINT) AS cnt FROM reg WHERE kind = 'S' GROUP BY target_id"))
def target_totals(spark, d):
    return C.target_totals(B.stops(spark, d))


@query(B.sql('SELECT target_id, mask, kind, pos, "end", CAST(sum(cnt) AS BIGINT) AS cnt FROM (SELECT * FROM reg UNION ALL SELECT * FROM reg WHERE target_id = 1) GROUP BY ALL'))
def merge_runs(spark, d):
    counts = B.stops(spark, d)
    return C.merged(counts, counts.where("target_id = 1"))


@query(B.sql("SELECT target_id, \"end\", CAST(sum(nt_) AS BIGINT) AS total FROM sid GROUP BY ALL", f"{_SPINE}, {_SIDES}"))
def end_totals(spark, d):
    counts, t = _stops(spark, d)
    ends = counts.select("target_id", "end").unionByName(t.select("target_id", F.length("seq").alias("end")))
    return R.totals(R.channels(C.per_site(counts, C.spine(ends, t), ("RRRY", "YYYR"))), "S_t")


@query(B.sql('SELECT target_id, "end", round(CAST(sum((site + 1) * nt_) AS DOUBLE) / nullif(sum(nt_), 0), 9) AS moment FROM whl GROUP BY ALL', f"{_SPINE}, {_SIDES}"))
def first_moment(spark, d):
    return _rounded(R.first_moment(R.compute(*_stops(spark, d), PLAIN), "S_t"), "moment")


@query(B.sql('SELECT target_id, site, CAST(nt_ AS BIGINT) AS treated, CAST(nu AS BIGINT) AS untreated FROM whl WHERE site = 5', f"{_SPINE}, {_SIDES}"))
def column_slice(spark, d):
    return R.column(R.compute(*_stops(spark, d), PLAIN), 5).select("target_id", "site", F.col("S_t").alias("treated"), F.col("S_u").alias("untreated"))


@query(B.sql('SELECT target_id, site, round(nt_ / sum(nt_) OVER (PARTITION BY target_id), 9) AS share, (SELECT CAST(min(nt_) AS BIGINT) FROM whl) AS least, (SELECT CAST(max(nt_) AS BIGINT) FROM whl) AS most FROM whl', f"{_SPINE}, {_SIDES}"))
def profile_shares(spark, d):
    """Each site's share of its profile, beside the least and the greatest count of all."""
    profile = R.compute(*_stops(spark, d), PLAIN)
    shares = _rounded(R.normalised(profile.withColumn("share", F.col("S_t")), "share").select("target_id", "site", "share"), "share")
    return shares.crossJoin(F.broadcast(R.data_range(profile, "S_t")))  # one row


@query(B.sql('SELECT target_id, CAST("end" AS INTEGER) AS "end", array_to_string(list(CAST(least(nt_, 50) AS BIGINT) ORDER BY site), \',\') AS cells FROM whl WHERE site BETWEEN 3 AND 12 GROUP BY ALL', f"{_SPINE}, {_SIDES}"))
def matrix_cells(spark, d):
    """The matrix of counts, cut to ten sites and capped."""
    cells = R.matrix(R.compute(*_stops(spark, d), PLAIN), "S_t", 50, (3, 12))
    return cells.select("target_id", "end", F.array_join(F.transform("cells", lambda x: x.cast("long")), ",").alias("cells"))


@query(B.sql('SELECT target_id, "end", ' + ", ".join(f'CAST(sum(nt_) FILTER (WHERE site = {i}) AS BIGINT) AS "s{i}"' for i in range(25)) + ' FROM sid GROUP BY ALL', f"{_SPINE}, {_SIDES}"))
def matrix_pivot(spark, d):
    counts, t = _stops(spark, d)
    ends = counts.select("target_id", "end").unionByName(t.select("target_id", F.length("seq").alias("end")))
    wide = R.pivot(R.channels(C.per_site(counts, C.spine(ends, t), ("RRRY", "YYYR"))), "S_t", list(range(25)))
    return wide.select("target_id", "end", *[F.col(str(i)).alias(f"s{i}") for i in range(25)])


@query(B.sql('SELECT target_id, "end", array_to_string(list(site ORDER BY site), \',\') AS sites FROM whl WHERE (nt_ + nu = 0 OR site % 6 = 3) AND "end" - site > 4 GROUP BY ALL', f"{_SPINE}, {_SIDES}"))
def missing_sites(spark, d):
    """All sites have stops in these tables: every sixth loses them, so that there is something to find."""
    counts, t = _stops(spark, d)
    return R.missing_sites(R.compute(counts.where("pos % 6 <> 3"), t, PLAIN), 2).select("target_id", "end", F.array_join("sites", ",").alias("sites"))


# --- result sets ----------------------------------------------------------


def _sets(spark, d):
    return B.result_set(spark, d, "a"), B.result_set(spark, d, "b")


@query(B.sql('SELECT mask, "end", site, CAST(sum(multiplicity) AS BIGINT) AS cnt FROM ra WHERE site <> -1 AND "end" <> -1 GROUP BY ALL'))
def result_sites(spark, d):
    return Q.result_sites(_sets(spark, d)[0])


_DIFF = """dff AS (SELECT a.pair_id, a.site AS site_a, b.site AS site_b, a."end" AS end_a, b."end" AS end_b, a.multiplicity AS multiplicity_a FROM ra a JOIN rb b USING (pair_id)
  WHERE (a.site <> b.site OR a."end" <> b."end" OR a.target_id <> b.target_id OR a.muts <> b.muts) AND (a.site <> -1 OR b.site <> -1))"""


@query(B.sql("SELECT pair_id, site_a, site_b FROM dff", _DIFF))
def result_diff(spark, d):
    return Q.differing(*_sets(spark, d)).select("pair_id", "site_a", "site_b")


@query(B.sql("""SELECT * FROM (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, CASE WHEN coalesce(a.site, -1) <> -1 AND coalesce(b.site, -1) = -1 THEN 'only_a' WHEN coalesce(a.site, -1) = -1 AND coalesce(b.site, -1) <> -1 THEN 'only_b'
  WHEN a.site <> -1 AND b.site <> -1 AND (a.site <> b.site OR a."end" <> b."end" OR a.target_id <> b.target_id OR a.muts <> b.muts) THEN 'different' END AS kind
  FROM (SELECT pair_id, max(site) AS site, max("end") AS "end", max(target_id) AS target_id, max(muts) AS muts FROM ra WHERE pair_id % 3 <> 0 GROUP BY 1) a FULL JOIN (SELECT pair_id, max(site) AS site, max("end") AS "end", max(target_id) AS target_id, max(muts) AS muts FROM rb WHERE pair_id % 3 <> 1 GROUP BY 1) b USING (pair_id)) WHERE kind IS NOT NULL"""))
def two_sided_diff(spark, d):
    """Sets of which each lacks some pairs of the other; a row for each pair."""
    def one(set_, k):
        return set_.where(F.col("pair_id") % 3 != k).groupBy("pair_id").agg(*[F.max(c).alias(c) for c in ("site", "end", "target_id", "muts", "failure", "multiplicity")])

    a, b = _sets(spark, d)
    return Q.both_sides(one(a, 0), one(b, 1)).select("pair_id", "kind")


@query(B.sql("""SELECT CAST(coalesce(sum(multiplicity_a) FILTER (WHERE site_a <> -1 AND site_b = -1), 0) AS BIGINT) AS lost, CAST(coalesce(sum(multiplicity_a) FILTER (WHERE site_a = -1 AND site_b <> -1), 0) AS BIGINT) AS gained,
  CAST(coalesce(sum(multiplicity_a) FILTER (WHERE site_a <> -1 AND site_b <> -1 AND site_a <> site_b), 0) AS BIGINT) AS moved_site, CAST(coalesce(sum(multiplicity_a) FILTER (WHERE site_a <> -1 AND site_b <> -1 AND end_a <> end_b), 0) AS BIGINT) AS moved_end FROM dff""", _DIFF))
def diff_summary(spark, d):
    return Q.diff_summary(Q.differing(*_sets(spark, d)))


@query(B.sql("SELECT tag, CAST(sum(multiplicity) AS BIGINT) AS cnt FROM (SELECT unnest(tags) AS tag, multiplicity FROM ra) GROUP BY tag"))
def tag_counts(spark, d):
    return Q.tag_counts(_sets(spark, d)[0])


@query(B.sql("SELECT tag, CAST(sum(multiplicity) AS BIGINT) AS cnt FROM (SELECT unnest(tags) AS tag, multiplicity FROM ra WHERE list_contains(tags, 'match') AND NOT list_contains(tags, 'adapter')) GROUP BY tag"))
def tag_query(spark, d):
    return Q.tag_counts(_sets(spark, d)[0], ["match"], ["adapter"])


@query(B.sql("SELECT CAST(coalesce(sum(multiplicity), 0) AS BIGINT) AS cnt FROM ra WHERE list_contains(tags, 'treated') AND NOT list_contains(tags, 'indels')"))
def count_matches(spark, d):
    return Q.count_matching(_sets(spark, d)[0], ["treated"], ["indels"])


@query(B.sql("SELECT pair_id, CAST((CASE WHEN list_contains(tags, 'match') THEN 1 ELSE 0 END) + (CASE WHEN list_contains(tags, 'adapter') THEN 2 ELSE 0 END) + (CASE WHEN list_contains(tags, 'treated') THEN 4 ELSE 0 END) AS BIGINT) AS tag_mask FROM ra"))
def tag_bitmask(spark, d):
    return _sets(spark, d)[0].select("pair_id", Q.tag_mask(F.col("tags"), ["match", "adapter", "treated"]).alias("tag_mask"))


@query(B.sql('SELECT ra.pair_id, identifier, multiplicity FROM ra JOIN pr USING (pair_id) WHERE ra.target_id = 2 AND site = 7 AND "end" = 37 ORDER BY multiplicity DESC, ra.pair_id LIMIT 20'))
def topk_site(spark, d):
    return Q.matching_site(_sets(spark, d)[0], B.pairs(spark, d), 2, 7, 37, 20).select("pair_id", "identifier", "multiplicity")


@query(B.sql("SELECT ra.pair_id, identifier, multiplicity FROM ra JOIN pr USING (pair_id) WHERE list_contains(tags, 'adapter') ORDER BY multiplicity DESC, ra.pair_id LIMIT 25"))
def topk_tag(spark, d):
    return Q.matching(_sets(spark, d)[0], B.pairs(spark, d), ["adapter"], [], 25).select("pair_id", "identifier", "multiplicity")


@query(B.sql("SELECT count(*) AS cnt FROM ra"))
def num_results(spark, d):
    return Q.num_results(_sets(spark, d)[0], "a")


@query(B.sql("SELECT failure, pair_id, CAST(rank AS INTEGER) AS rank FROM (SELECT failure, pair_id, row_number() OVER (PARTITION BY failure ORDER BY multiplicity DESC, pair_id) AS rank FROM ra WHERE failure IS NOT NULL) WHERE rank <= 10"))
def top_failures(spark, d):
    return Q.top_failures(_sets(spark, d)[0]).select("failure", "pair_id", "rank")


@query(B.sql("SELECT pair_id FROM pr WHERE contains(r1, 'ACGTA') OR contains(r2, 'ACGTA')"))
def text_filter(spark, d):
    return Q.with_text(B.pairs(spark, d), "ACGTA").select("pair_id")


@query(B.sql("SELECT CAST(count(*) AS BIGINT) AS targets FROM (SELECT DISTINCT name, seq FROM tgt)"))
def merge_targets(spark, d):
    t = B.targets(spark, d)
    return I.merge_targets(t, t).agg(F.count(F.lit(1)).alias("targets"))


# SELECT over intervals of events: uncovered stretches of each target
_GAPS = """iv AS (SELECT CAST(user_id % 7 AS INTEGER) AS target_id, CAST(event_id % 97 * 10 AS INTEGER) AS start, CAST(event_id % 97 * 10 + 5 AS INTEGER) AS stop FROM events WHERE event_id % 97 > 20),
gp AS (SELECT target_id, coalesce(max(stop) OVER (PARTITION BY target_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, start AS b FROM iv UNION ALL SELECT target_id, max(stop), 1200 FROM iv GROUP BY target_id)"""


@query(B.sql("SELECT target_id, CAST(a + 4 AS INTEGER) AS start, CAST(b - 4 AS INTEGER) AS stop FROM gp WHERE b - a > 20", _GAPS))
def uncovered_gaps(spark, d):
    e = B.load(spark, d, "events").where("event_id % 97 > 20")
    at = (F.col("event_id") % 97 * 10).cast("int")
    return R.gaps(e.select((F.col("user_id") % 7).cast("int").alias("target_id"), at.alias("start"), (at + 5).alias("stop")), ["target_id"], F.lit(1200))
