"""Table-driven classification: every R1 that a target can give is a row of a table.

Keys hold what follows the handle in R1. Hits are joined, judged as columns, and
the first hit that passes wins; ambiguous keys of equal trim reject the pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions import sequences as S
from ..functions.reads import ADAPTER, COTRANS_MIN, DUMBBELL, ERRORS, INDETERMINATE, LINKER, MASK, MULTIPLE, NO_MATCH, NOT_FULL, OVERLAP, rc
from .index import self_matches, spread

HANDLE = 4
BASES = "ACGT"


def toggled(table: DataFrame, text: str, bits: Column, mutation) -> DataFrame:
    """The rows, and a row for each other base at each of the first bits places; mutation gives the target position of a place."""
    each = table.select("*", F.explode(S.places(bits)).alias("_i")).select("*", F.explode(F.array(*[F.lit(b) for b in BASES])).alias("_b")).where(S.at(F.col(text), F.col("_i")) != F.col("_b"))
    changed = F.concat(F.substring(text, F.lit(1), F.col("_i")), F.col("_b"), F.substring(text, F.col("_i") + 2, F.length(text)))
    mutants = each.withColumn("mutations", F.array(mutation(F.col("_i")).cast("int"))).withColumn(text, changed).drop("_i", "_b")
    return table.unionByName(mutants.select(*table.columns))


def r1_table(targets: DataFrame, config: RunConfig, pair_length: int) -> DataFrame:
    """key, target_id, site (null: R2 decides), trim, ord, mutations; for single targets."""
    length = pair_length - HANDLE
    dumb = rc(config.dumbbell or "")
    tail = F.lit(dumb + config.adapter_b)
    n = F.length("seq")
    rows = targets.select("target_id", "seq", F.explode(F.sequence(F.lit(1), F.lit(length))).alias("i"))
    rows = rows.select("target_id", (n - F.col("i")).alias("_left"), n.alias("_n"), "i", F.substring(F.concat(F.substring(S.reverse_complement("seq"), F.lit(1), F.col("i")), tail), F.lit(1), F.least(F.lit(length), F.least(F.col("i"), n) + len(dumb) + len(config.adapter_b))).alias("key"))
    table = rows.select("key", "target_id", "_n", F.when(F.col("i") < length, F.col("_left")).alias("site"), (F.lit(length) - F.col("i")).alias("trim"), F.col("i").alias("ord"), F.array().cast("array<int>").alias("mutations"))
    if config.count_mutations:
        table = toggled(table, "key", F.least(F.col("ord"), F.length("key")), lambda i: F.col("_n") - i)
    return table.drop("_n")


def cotrans_table(targets: DataFrame, config: RunConfig, pair_length: int, least: int = 3) -> DataFrame:
    """key, target_id, site (here: the end of the transcript), trim, ord, mutations; for cotranscriptional runs."""
    linker, length = config.cotrans_linker, pair_length - HANDLE
    rows = targets.select("target_id", "seq", F.explode(F.sequence(F.lit(least), F.length("seq"))).alias("stop"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(length - len(linker) - least))).alias("trim"))
    size = F.lit(length - len(linker)) - F.col("trim")
    rows = rows.where(F.col("stop") >= size).withColumn("part", F.substring("seq", F.col("stop") - size + 1, size))
    table = rows.select("part", "target_id", F.col("stop").alias("site"), "trim", (F.col("stop") * 1000 + F.col("trim")).alias("ord"), F.array().cast("array<int>").alias("mutations"))
    if config.count_mutations:
        table = toggled(table, "part", F.length("part"), lambda i: F.col("site") - F.length("part") + i + 1)
    key = F.concat(S.reverse_complement(F.concat("part", F.lit(linker))), F.substring(F.lit(config.adapter_b), F.lit(1), F.col("trim")))
    return table.withColumn("key", key).drop("part")


def r2_table(targets: DataFrame, config: RunConfig, length: int) -> DataFrame:
    """target_id, key2, r2_site, r2_len: the starts of R2 that a target can give, as long as needed to tell its places apart."""
    dumb = config.dumbbell or ""
    if config.count_mutations:
        sized = targets.withColumn("r2_len", F.lit(length))
    else:
        sized = targets.join(self_matches(targets, minimum=config.minimum_target_match_length, within=True).select("target_id", (F.col("length") + 1).alias("r2_len")), "target_id")
    rows = sized.where(F.length("seq") >= F.col("r2_len")).select("target_id", "seq", "r2_len", F.explode(F.sequence(F.lit(0), F.length("seq") - F.col("r2_len"))).alias("r2_site"))
    part = F.substring("seq", F.col("r2_site") + 1, F.col("r2_len"))
    table = rows.select("target_id", (F.col("r2_len") + len(dumb)).alias("r2_len"), "r2_site", part.alias("part"), F.array().cast("array<int>").alias("mutations"))
    if config.count_mutations:
        table = toggled(table, "part", F.length("part"), lambda i: F.col("r2_site") + i + 1)
    return table.withColumn("key2", F.concat(F.lit(dumb), "part")).drop("part", "mutations")


def ambiguous(table: DataFrame, keys: list[str], place: str) -> DataFrame:
    """Keys that name more than one place."""
    return table.groupBy(*keys).agg(F.count_distinct(place).alias("places")).where("places > 1")


def require_plain_keys(targets: DataFrame, config: RunConfig, pair_length: int) -> None:
    """An error if R2 cannot tell the places of a target apart: its reads are too short for that, or one key stands for two places."""
    second = pair_length - HANDLE - (len(config.cotrans_linker) if config.cotrans else 0)
    table = r2_table(targets, config, second)
    longest = table.agg(F.max("r2_len")).first()[0] or 0
    if longest > second:
        raise ValueError(f"R2 shows {second} bases, but {longest} are needed to tell places of a target apart")
    some = ambiguous(table, ["target_id", "key2"], "r2_site").limit(3).collect()
    if some:
        raise ValueError("the same R2 stands for several places: " + ", ".join(f"{r['key2']} (target {r['target_id']})" for r in some))


#: Tables of at most so many rows (short strings and numbers) are broadcast; larger ones are joined by their keys.
MOST_BROADCAST = 500_000


def _short_keys(config: RunConfig, length: int) -> bool:
    """Can a key be shorter than what follows the handle? Only if the adapter ends before the read does."""
    if config.cotrans:
        return length - len(config.cotrans_linker) - 3 > len(config.adapter_b)
    return 1 + len(config.dumbbell or "") + len(config.adapter_b) < length


def _by_start(pairs: DataFrame, table: DataFrame, length: int) -> DataFrame:
    """pair rows (all of them) with their table rows where keys may be short: a short key matches as the start of a read, the first such key alone."""
    body = F.substring("r1", F.lit(HANDLE + 1), F.length("r1"))
    known = pairs.where("mask is not null")
    whole = known.join(table, body == F.col("key"))
    short = table.where(F.length("key") < length)
    shortest = short.agg(F.min(F.length("key")).alias("n"))
    prefix = short.join(F.broadcast(shortest)).withColumn("head", F.substring("key", F.lit(1), F.col("n")))  # one row
    rest = known.join(whole.select("pair_id").distinct(), "pair_id", "left_anti").join(F.broadcast(shortest))  # one row
    partly = rest.withColumn("head", F.substring(body, F.lit(1), F.col("n"))).drop("n").join(prefix.drop("n"), "head").where(F.startswith(body, F.col("key"))).drop("head")
    first = Window.partitionBy("pair_id").orderBy("ord", "target_id", "key")
    partly = partly.withColumn("_first", F.first("key").over(first)).where(F.col("key") == F.col("_first")).drop("_first")
    found = whole.unionByName(partly)
    return found.unionByName(pairs.join(found.select("pair_id").distinct(), "pair_id", "left_anti"), allowMissingColumns=True)


def _chosen(judged: DataFrame, config: RunConfig) -> DataFrame:
    """One row for a pair: the first hit that passes, else what the last one failed on; hits that cannot be told apart reject the pair."""
    every = Window.partitionBy("pair_id")
    judged = judged.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("pair_id", "trim"))).withColumn("_multi", F.max("_n").over(every))
    failure = F.when(F.col("_multi") > 1, MULTIPLE).otherwise(F.col("failure"))
    if config.cotrans:
        least = F.first("site").over(every.orderBy("ord", "target_id"))
        failure = F.when(least < config.cotrans_minimum_length, COTRANS_MIN).otherwise(failure)
    judged = judged.withColumn("failure", failure)
    order = every.orderBy(F.col("failure").isNull().desc(), F.when(F.col("failure").isNull(), F.col("target_id")), F.when(F.col("failure").isNull(), F.col("ord")), F.col("target_id").desc(), F.col("ord").desc())
    return judged.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k", "_n", "_multi")


def classify(pairs: DataFrame, targets: DataFrame, config: RunConfig) -> DataFrame:
    """Results of the lookup strategy, a row for each pair.

    Pairs are read once and dealt out by pair_id, joined with the keys that R1
    can show and with those that R2 can show, judged, and one hit of each is
    chosen. Where the tables are small enough to broadcast, the rows of a pair
    stay where they were dealt to, so there is no other shuffle.
    """
    have = set(pairs.columns)
    weight = F.coalesce(F.col("multiplicity"), F.lit(1)).cast("long") if "multiplicity" in have else F.lit(1).cast("long")
    quality = [F.col(q) if q in have else F.lit(None).cast("string").alias(q) for q in ("r1_qual", "r2_qual")]
    pairs = pairs.where((F.length("r1") > 0) & (F.length("r2") > 0)).select("pair_id", F.upper("r1").alias("r1"), F.upper("r2").alias("r2"), *quality, weight.alias("multiplicity"))
    size = config.pair_length or (pairs.agg(F.max(F.length("r1")).alias("n")).first()["n"] or 36)
    masked = spread(pairs, "pair_id").withColumn("mask", S.handle("r1", config.masks))
    length = size - HANDLE
    second_length = length - (len(config.cotrans_linker) if config.cotrans else 0)
    bases = targets.agg(F.sum(F.length("seq").cast("long")).alias("n"), F.count(F.lit(1)).alias("rows")).first()  # one row
    each = 1 + (3 * length if config.count_mutations else 0)
    places = (bases["n"] or 0) * length if config.cotrans else bases["rows"] * length
    sized = lambda df, rows: F.broadcast(df) if rows <= MOST_BROADCAST else df
    first = (cotrans_table if config.cotrans else r1_table)(targets, config, size)
    first = first.join(sized(targets.select("target_id", "seq"), (bases["n"] or 0) // 100), "target_id")
    second = r2_table(targets, config, second_length)
    lengths = second.select("target_id", "r2_len").distinct()
    first = first.join(sized(lengths, bases["rows"]), "target_id", "left")
    second = second.select("target_id", "key2", "r2_site").distinct()
    if _short_keys(config, length):
        hits = _by_start(masked, first, length)
    else:
        body = F.when(F.col("mask").isNotNull(), F.substring("r1", F.lit(HANDLE + 1), F.length("r1")))
        hits = masked.join(sized(first, places * each), body == F.col("key"), "left")
    asks = F.col("trim") == 0 if config.cotrans else F.col("site").isNull()
    hits = hits.withColumn("key2", F.when(asks, F.substring("r2", F.lit(1), F.col("r2_len")))).drop("r2_len")
    hits = hits.join(sized(second, (bases["n"] or 0) * each), ["target_id", "key2"], "left")
    hit = F.col("target_id").isNotNull()
    judged = (_cotrans if config.cotrans else _single)(hits, config)
    out = _chosen(judged, config)
    good = hit & F.col("failure").isNull()
    failure = F.when(F.col("mask").isNull(), MASK).when(~hit, NO_MATCH).otherwise(F.col("failure"))
    none = F.array().cast("array<int>")
    empty = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<struct<insert: boolean, seq: string, src_index: int, ambiguous: boolean>>"))
    out = out.select("pair_id", F.when(good, F.col("target_id")).alias("target_id"), "mask", F.when(good, F.col("_site")).alias("site"), F.when(good, F.col("_end")).alias("end"), F.when(good, F.col("_mutations")).otherwise(none).alias("mutations"), F.when(good, F.col("_removed")).otherwise(none).alias("removed_mutations"), failure.alias("failure"), "multiplicity")
    edge = F.when(F.array_contains("mutations", F.col("site") + 1), F.lit(config.count_edge_mutations or "ignore"))
    return out.select(
        "pair_id", "target_id", "mask", "site", "end", "mutations", "removed_mutations",
        empty.alias("r1_indels"), empty.alias("r2_indels"), "failure", edge.alias("edge_mut"), F.lit(False).alias("edge_indel"), F.lit(False).alias("ambig_indel"), F.lit(False).alias("interesting"),
        F.lit(None).cast("string").alias("prefix"), F.when(F.lit(config.cotrans), F.col("end")).alias("linker"), F.when(F.lit(bool(config.dumbbell)), F.col("site") - len(config.dumbbell or "")).alias("dumbbell"), "multiplicity",
        F.when(F.col("mask").isNotNull(), F.create_map(F.concat("mask", F.lit("_total")), "multiplicity")).otherwise(F.create_map(F.lit("mask_failure"), "multiplicity")).alias("counters"),
    )


def _kept(mutations: Column, config: RunConfig, view1: Column, view2: Column) -> Column:
    """Mutations whose base qualities carry them; view: (place, quality, base) of a read as a function of the mutation."""
    least = config.mutations_require_quality_score
    if least is None:
        return mutations

    def keep(m: Column) -> Column:
        q1, b1 = view1(m)
        q2, b2 = view2(m)
        reference = S.at(F.col("seq"), m - 1)
        good1, good2 = F.coalesce(q1 >= least, F.lit(False)), F.coalesce(q2 >= least, F.lit(False))
        both = q1.isNotNull() & q2.isNotNull() & (b1 != b2)
        one = (good1 & ~good2 & (b1 != reference)) | (good2 & ~good1 & (b2 != reference))
        return F.when(both, one).otherwise(good1 | good2)

    return F.when(F.col("r1_qual").isNull() & F.col("r2_qual").isNull(), mutations).otherwise(F.filter(mutations, keep))


def _view(text: Column, quality: Column, d: Column):
    def at(m: Column) -> tuple[Column, Column]:
        i = m - 1 - d
        inside = (i >= 0) & (i < F.length(text)) & quality.isNotNull()
        return F.when(inside, S.phred(quality, i)), F.when(inside, S.at(text, i))

    return at


def _finish(d: DataFrame, config: RunConfig, failures: list[tuple[Column, str]], site: Column, end: Column, found: Column, text1: Column, qual1: Column, d1: Column, trim1: Column) -> DataFrame:
    """Adds _site, _end, _mutations, _removed and the first failure."""
    mutations = F.when(F.lit(config.count_mutations), F.array_sort(F.array_union(found, F.col("mutations")))).otherwise(F.array().cast("array<int>"))
    every = F.array_sort(F.array_union(found, F.col("mutations")))
    d = d.withColumn("_every", every).withColumn("_all", mutations)
    failures = [*failures, (F.size("_every") > config.allowed_target_errors, ERRORS)]
    if config.count_only_full_reads:
        failures.append((site != 0, NOT_FULL))
    failure = None
    for bad, name in failures:
        failure = F.when(bad, name) if failure is None else failure.when(bad, name)
    d = d.withColumn("failure", failure).withColumn("_site", site).withColumn("_end", end)
    kept = _kept(F.col("_all"), config, _view(text1, qual1, d1), _view(F.col("r2"), F.col("r2_qual"), site - len(config.dumbbell or "")))
    return d.withColumn("_mutations", kept).withColumn("_removed", F.array_except("_all", "_mutations"))


def _single(hits: DataFrame, config: RunConfig) -> DataFrame:
    n, r2, dumb = F.length("seq"), F.col("r2"), len(config.dumbbell or "")
    site = F.coalesce("site", "r2_site")
    d = hits.withColumn("_s", site).withColumn("_m", F.least(F.length(r2) - dumb, n - F.col("_s")))
    s, m = F.col("_s"), F.col("_m")
    part = F.substring("r2", F.lit(dumb + 1), m)
    found = F.transform(S.mismatches(part, F.substring("seq", s + 1, m)), lambda i: (i + s + 1).cast("int"))
    d = d.withColumn("_found", F.when(m > 0, found).otherwise(F.array().cast("array<int>")))
    adapter2 = F.greatest(F.length(r2) - m - dumb - HANDLE, F.lit(0))
    body1 = F.substring("r1", F.lit(HANDLE + 1), F.length("r1"))
    m1 = F.least(F.length(body1), n - s)
    adapter1 = F.greatest(F.length(body1) - m1 - dumb, F.lit(0))
    by_r2 = F.col("site").isNull()
    errors1 = S.mismatches(F.substring(body1, F.lit(1), m1), F.substring(S.reverse_complement("seq"), F.lit(1), m1))
    read1 = S.reverse_complement(F.substring(body1, F.lit(1), F.length(body1) - F.col("trim")))
    d1 = n - F.length(read1)
    start = F.greatest(d1, s)
    shared = s + m - start
    agree = F.when(shared > 0, F.substring(read1, start - d1 + 1, shared) == F.substring("r2", start - s + 1 + dumb, shared)).otherwise(True)
    failures = [
        (by_r2 & F.col("r2_site").isNull(), NO_MATCH),
        *([(~F.startswith(r2, F.lit(config.dumbbell)), DUMBBELL)] if dumb else []),
        ((m <= 0) | (F.size("_found") > config.allowed_target_errors), ERRORS),
        (F.size(S.mismatches(F.substring("r2", F.length(r2) - adapter2 + 1, adapter2), F.lit(rc(config.adapter_t)))) > config.allowed_adapter_errors, ADAPTER),
        (by_r2 & (F.size(errors1) > config.allowed_target_errors), ERRORS),
        (by_r2 & (F.size(S.mismatches(F.substring(body1, F.length(body1) - adapter1 + 1, adapter1), F.lit(config.adapter_b))) > config.allowed_adapter_errors), ADAPTER),
        *([] if config.allow_indeterminate else [(~S.determinate("r1", "r2"), INDETERMINATE)]),
        *([(~agree, OVERLAP)] if config.ignore_stops_with_mismatched_overlap else []),
    ]
    qual1 = F.reverse(F.substring("r1_qual", F.lit(HANDLE + 1), F.length(body1) - F.col("trim")))
    return _finish(d, config, failures, s, n, F.col("_found"), read1, qual1, d1, F.col("trim"))


def _cotrans(hits: DataFrame, config: RunConfig) -> DataFrame:
    linker, r2, stop, trim = config.cotrans_linker, F.col("r2"), F.col("site"), F.col("trim")
    size = F.length(r2)
    inner = size - len(linker) - HANDLE
    d = hits.withColumn("_s", F.when(trim == 0, F.col("r2_site")).otherwise(stop - inner + trim)).withColumn("_m", F.least(size, stop - F.col("_s")))
    s, m = F.col("_s"), F.col("_m")
    found = F.transform(S.mismatches(F.substring("r2", F.lit(1), m), F.substring("seq", s + 1, m)), lambda i: (i + s + 1).cast("int"))
    d = d.withColumn("_found", F.when(m > 0, found).otherwise(F.array().cast("array<int>")))
    linked = F.least(F.lit(len(linker)), size - m)
    body1 = F.substring("r1", F.lit(HANDLE + len(linker) + 1), F.length("r1"))
    read1 = S.reverse_complement(F.substring(body1, F.lit(1), F.length(body1) - trim))
    d1 = stop - F.length(read1)
    start = F.greatest(d1, s)
    shared = s + m - start
    agree = F.when(shared > 0, F.substring(read1, start - d1 + 1, shared) == F.substring("r2", start - s + 1, shared)).otherwise(True)
    beyond = m < size
    failures = [
        ((trim == 0) & F.col("r2_site").isNull(), NO_MATCH),
        ((m <= 0) | (F.size("_found") > config.allowed_target_errors), ERRORS),
        (beyond & (F.substring("r2", m + 1, linked) != F.substring(F.lit(linker), F.lit(1), linked)), LINKER),
        (beyond & (trim > 0) & (F.substring("r2", size - trim + 1, trim) != F.substring(F.lit(rc(config.adapter_t)), F.lit(1), trim)), ADAPTER),
        (beyond & (size - m - len(linker) - HANDLE > trim), ADAPTER),
        *([] if config.allow_indeterminate else [(~S.determinate("r1", "r2"), INDETERMINATE)]),
        *([(~agree, OVERLAP)] if config.ignore_stops_with_mismatched_overlap else []),
    ]
    qual1 = F.reverse(F.substring("r1_qual", F.lit(HANDLE + len(linker) + 1), F.length(body1) - trim))
    return _finish(d, config, failures, s, stop, F.col("_found"), read1, qual1, d1, trim)
