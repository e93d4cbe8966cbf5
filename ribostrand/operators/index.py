"""Words of targets and what is found by them, as joins.

The kernel of the classifier holds its own index; these operators do the same
searches for any number of targets, as equi-joins on words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as S

WORD = 8


def kmer_index(targets: DataFrame, k: int = WORD) -> DataFrame:
    """target_id, pos, word of every place of every target."""
    places = targets.where(F.length("seq") >= k).select("target_id", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - k)).alias("pos"))
    return places.select("target_id", "pos", F.substring("seq", F.col("pos") + 1, F.lit(k)).alias("word"))


def check_sites(length: Column, need: int | Column, k: int = WORD) -> Column:
    """The query places at which a stretch of so many bases must show a word."""
    step = F.greatest((F.lit(need) if isinstance(need, int) else need) - k, F.lit(1))
    last = length - F.greatest(step, F.lit(k))
    return F.when(length < k, F.array().cast("array<int>")).when(last <= 0, F.array(F.greatest(last, F.lit(0)))).otherwise(F.array_distinct(F.concat(F.sequence(F.lit(0), last - 1, step), F.array(last))))


def _common(a: Column, b: Column, last: bool = False) -> Column:
    """Length of the common prefix (last: suffix) of two texts, by halving: a few comparisons of whole parts."""
    n, part = F.least(F.length(a), F.length(b)), F.right if last else F.left
    powers = F.transform(F.sequence(F.length(F.bin(n)) - 1, F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k))
    longer = lambda m, p: F.when((m + p <= n) & (part(a, m + p) == part(b, m + p)), m + p).otherwise(m)
    return F.when(part(a, n) == part(b, n), n).otherwise(F.aggregate(powers, F.lit(0), longer))


def spread(df: DataFrame, *key: Column | str) -> DataFrame:
    """Rows dealt out by key, as many partitions as shuffles have: small inputs and single files come as one partition, and what follows is much work for each row."""
    return df.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *key)


def _extended(seeds: DataFrame, keep: list[str], k: int) -> DataFrame:
    """keep, left and right: by how much each seed (q, site, t, pos) goes on to both sides.

    The parts to compare are one struct of a generator, so that the optimiser
    neither copies the comparison into a join's condition nor runs it twice.
    """
    parts = F.struct(
        F.substring("q", F.lit(1), F.col("site")).alias("qa"), F.substring("t", F.lit(1), F.col("pos")).alias("ta"),
        F.substring("q", F.col("site") + k + 1, F.length("q")).alias("qb"), F.substring("t", F.col("pos") + k + 1, F.length("t")).alias("tb"),
    )
    sides = F.transform(F.array(parts), lambda s: F.struct(_common(s["qa"], s["ta"], True).alias("left"), _common(s["qb"], s["tb"]).alias("right")))
    return seeds.select(*keep, F.inline(sides))


def seed_hits(queries: DataFrame, targets: DataFrame, need: int | None, key: str = "query_id", k: int = WORD) -> DataFrame:
    """All distinct exact stretches of at least need bases: key, target_id, q_start, length, t_start.

    queries: key and seq; also need where the number is None (each query's own),
    and only, the one target to search (null: all), if there is such a column.
    Words at the check sites are joined with the target words, then each seed is
    extended to both sides.
    """
    least = F.col("need") if need is None else F.lit(need)
    restricted = "only" in queries.columns
    ready = spread(queries, key).select(key, F.col("seq").alias("q"), least.cast("int").alias("need"), *(["only"] if restricted else []))
    sites = ready.select("*", F.explode(check_sites(F.length("q"), F.col("need"), k)).alias("site")).withColumn("word", F.substring("q", F.col("site") + 1, F.lit(k)))
    words = kmer_index(targets, k)
    if restricted:
        named, free = sites.where("only IS NOT NULL"), sites.where("only IS NULL")
        seeds = free.join(words, "word").unionByName(named.join(words.withColumn("only", F.col("target_id")), ["word", "only"]))
    else:
        seeds = sites.join(words, "word")
    placed = seeds.join(targets.select("target_id", F.col("seq").alias("t")), "target_id")
    found = _extended(placed, [key, "target_id", "need", "site", "pos"], k)
    out = found.select(key, "target_id", (F.col("site") - F.col("left")).alias("q_start"), (F.col("left") + F.col("right") + k).alias("length"), (F.col("pos") - F.col("left")).alias("t_start"), "need", "site", "pos")
    return out.where("length >= need").groupBy(key, "target_id", "q_start", "length", "t_start").agg(F.min("site").alias("site"), F.min("pos").alias("pos"))


def best_match(hits: DataFrame, key: str = "query_id") -> DataFrame:
    """The longest stretch of each query, the first found among equals, and how many targets share that length."""
    by = Window.partitionBy(key)
    longest = hits.withColumn("most", F.max("length").over(by)).where(F.col("length") == F.col("most"))
    order = by.orderBy("site", "target_id", "pos")
    ranked = longest.withColumn("n", F.row_number().over(order)).withColumn("n_targets", F.size(F.collect_set("target_id").over(by)))
    return ranked.where("n = 1").select(key, "target_id", "q_start", "length", "t_start", "n_targets")


def find_partial(queries: DataFrame, targets: DataFrame, minimum: int = 10, key: str = "query_id") -> DataFrame:
    """Best matches with twice the minimum length; of the other queries, with the minimum."""
    long = best_match(seed_hits(queries, targets, 2 * minimum, key), key)
    rest = best_match(seed_hits(queries.join(long.select(key), key, "left_anti"), targets, minimum, key), key)
    return long.unionByName(rest)


def find_prefix(queries: DataFrame, targets: DataFrame, minimum: int = 10, key: str = "query_id", k: int = WORD) -> DataFrame:
    """Best matches seeded at the first word only."""
    starts = queries.where(F.length("seq") >= k).select(key, F.col("seq").alias("q"), F.substring("seq", 1, k).alias("word"))
    seeds = starts.join(kmer_index(targets, k), "word").join(targets.select("target_id", F.col("seq").alias("t")), "target_id")
    length = k + _common(F.substring("q", F.lit(k + 1), F.length("q")), F.substring("t", F.col("pos") + k + 1, F.length("t")))
    hits = seeds.select(key, "target_id", F.lit(0).alias("q_start"), length.alias("length"), F.col("pos").alias("t_start"), F.lit(0).alias("site"), "pos").where(F.col("length") >= minimum)
    return best_match(hits, key)


def find_exact(queries: DataFrame, targets: DataFrame, key: str = "query_id", k: int = WORD) -> DataFrame:
    """The first place of each whole query: key, target_id, pos. A query row may name a place of its own (own_target, own_pos) to leave out."""
    own = (F.col("target_id") == F.col("own_target")) & (F.col("pos") == F.col("own_pos")) if "own_target" in queries.columns else F.lit(False)
    seeds = queries.withColumnRenamed("seq", "q").withColumn("word", F.substring("q", 1, k)).join(kmer_index(targets, k), "word").join(targets.select("target_id", F.col("seq").alias("t")), "target_id")
    hits = seeds.where((F.substring("t", F.col("pos") + 1, F.length("q")) == F.col("q")) & ~F.coalesce(own, F.lit(False)))
    return hits.groupBy(key).agg(F.min(F.struct("target_id", "pos")).alias("h")).select(key, "h.target_id", "h.pos")


def self_matches(targets: DataFrame, k: int = WORD, minimum: int = WORD, within: bool = False) -> DataFrame:
    """target_id, length: the longest stretch of each target, of at least minimum bases, that occurs elsewhere; minimum if none does.

    Elsewhere is any place of any target, or with ``within`` of the same one.
    """
    index = kmer_index(targets, k)
    a = index.select("word", "target_id", "pos")
    b = index.select("word", F.col("target_id").alias("other_id"), F.col("pos").alias("other"))
    # a repeat is named by its first word, the one whose bases before differ
    pairs = a.join(b, "word").where((F.col("target_id") != F.col("other_id")) | (F.col("pos") != F.col("other")))
    if within:
        pairs = pairs.where("target_id = other_id")
    texts = targets.select("target_id", F.col("seq").alias("s")), targets.select(F.col("target_id").alias("other_id"), F.col("seq").alias("o"))
    placed = pairs.join(texts[0], "target_id").join(texts[1], "other_id")
    starts = placed.where((F.col("pos") == 0) | (F.col("other") == 0) | (S.at(F.col("s"), F.col("pos") - 1) != S.at(F.col("o"), F.col("other") - 1)))
    length = k + _common(F.substring("s", F.col("pos") + k + 1, F.length("s")), F.substring("o", F.col("other") + k + 1, F.length("o")))
    longest = starts.groupBy("target_id").agg(F.max(length).alias("length"))
    return targets.select("target_id").join(longest, "target_id", "left").select("target_id", F.greatest(F.coalesce("length", F.lit(minimum)), F.lit(minimum)).alias("length"))


def merge_targets(targets: DataFrame, more: DataFrame) -> DataFrame:
    """Both, without second copies of the same name and sequence; numbered from 1 in the order they came."""
    both = targets.select(F.lit(0).alias("batch"), "target_id", "name", "seq").unionByName(more.select(F.lit(1).alias("batch"), "target_id", "name", "seq"))
    first = both.groupBy("name", "seq").agg(F.min(F.struct("batch", "target_id")).alias("first"))
    order = Window.orderBy("first")  # a row for each target
    return first.select(F.row_number().over(order).cast("int").alias("target_id"), "name", "seq", F.length("seq").alias("n"))
