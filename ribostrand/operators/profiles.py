"""Reactivity profiles: beta, theta, rho, mu, r, z and c by site, as columns.

X and Y are stops of the treated and the untreated channel, D and E their
depths. A site where a ratio is undefined (a depth of 0, a share of 1) has
beta = theta = z = 0 and adds nothing to c; the last site is never computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RunConfig
from ..schema import TREATED, UNTREATED
from . import counters as C


def channels(sites: DataFrame, masks: tuple[str, str] = (TREATED, UNTREATED)) -> DataFrame:
    """Both masks side by side: target_id, end, n, site and columns with _t and _u."""
    kinds = ("S", "M", "Mq", "I", "D", "E", "depth", "qdepth")
    both = [F.sum(F.when(F.col("mask") == m, F.col(k))).alias(f"{k}_{c}") for c, m in zip("tu", masks, strict=True) for k in kinds]
    return sites.groupBy("target_id", "end", "n", "site").agg(*both)


def stitched(sides: DataFrame) -> DataFrame:
    """Several RT starts as one profile to the target's end: sums over the ends, site by site."""
    values = [c for c in sides.columns if c.endswith(("_t", "_u"))]
    whole = sides.groupBy("target_id", "n", "site").agg(*[F.sum(c).alias(c) for c in values])
    return whole.withColumn("end", F.col("n"))


def _log(x: Column) -> Column:
    return F.log(F.when(x > 0, x))


def profiles(sides: DataFrame, config: RunConfig = RunConfig()) -> DataFrame:
    """Adds beta, theta, rho, z, c, c_thresh and, of mutations, mu, r, c_mut, c_thresh_mut, z_mut."""
    clamp = (lambda x: x) if config.allow_negative_values else (lambda x: F.greatest(x, F.lit(0.0)))
    by = Window.partitionBy("target_id", "end")
    d = sides.withColumn("x", F.try_divide("S_t", "depth_t")).withColumn("y", F.try_divide("S_u", "depth_u"))
    inside = F.col("site") < F.col("end")
    ok = inside & (F.col("x") < 1) & (F.col("y") < 1)
    raw = F.when(ok, (F.col("x") - F.col("y")) / F.when(F.col("y") < 1, 1 - F.col("y")))
    d = d.withColumn("raw", raw).withColumn("beta", F.coalesce(clamp(F.col("raw")), F.lit(0.0)))
    d = d.withColumn("theta0", F.coalesce(clamp(F.when(ok, _log(1 - F.col("y")) - _log(1 - F.col("x")))), F.lit(0.0)))
    d = d.withColumn("c", F.coalesce(F.sum(-_log(1 - F.col("raw"))).over(by), F.lit(0.0))).withColumn("c_thresh", F.coalesce(F.sum(F.when(ok, -_log(1 - F.col("beta")))).over(by), F.lit(0.0)))
    d = d.withColumn("theta", F.greatest(F.col("theta0") / F.when(F.col("c_thresh") != 0, F.col("c_thresh")).otherwise(1.0), F.lit(0.0))).withColumn("rho", F.col("end") * F.col("theta"))
    d = d.withColumn("z", F.coalesce(F.when(ok, clamp(_z(F.col("S_t"), F.col("S_u"), F.col("depth_t"), F.col("depth_u"), F.col("x") - F.col("y")))), F.lit(0.0)))
    # mutations, insertions and deletions over the quality depth
    d = d.withColumn("T", F.try_divide(F.col("M_t") + F.col("I_t") + F.col("D_t"), F.col("qdepth_t"))).withColumn("U", F.try_divide(F.col("M_u") + F.col("I_u") + F.col("D_u"), F.col("qdepth_u")))
    fine = inside & F.col("T").isNotNull() & F.col("U").isNotNull() & (F.col("U") != 1)
    mu = F.when(fine, (F.col("T") - F.col("U")) / F.when(F.col("U") != 1, 1 - F.col("U")))
    d = d.withColumn("mu_raw", mu).withColumn("mu", F.coalesce(clamp(F.col("mu_raw")), F.lit(0.0))).withColumn("r", F.col("beta") + F.col("mu"))
    for name, value, base in (("c_mut", "mu_raw", "c"), ("c_thresh_mut", "mu", "c_thresh")):
        lost = F.max(F.when(fine & (F.col(value) >= 1), 1).otherwise(0)).over(by) == 1
        d = d.withColumn(name, F.when(lost, F.lit(float("inf"))).otherwise(F.col(base) + F.coalesce(F.sum(F.when(fine, -_log(1 - F.col(value)))).over(by), F.lit(0.0))))
    both_t = F.try_divide(F.col("M_t") + F.col("I_t") + F.col("D_t") + F.col("S_t"), 0.5 * (F.col("qdepth_t") + F.col("depth_t")))
    both_u = F.try_divide(F.col("M_u") + F.col("I_u") + F.col("D_u") + F.col("S_u"), 0.5 * (F.col("qdepth_u") + F.col("depth_u")))
    events = F.col("M_t") + F.col("I_t") + F.col("D_t") + F.col("M_u") + F.col("I_u") + F.col("D_u")
    z_mut = _z(events, F.col("S_t") + F.col("S_u"), F.col("qdepth_t") + F.col("qdepth_u"), F.col("depth_t") + F.col("depth_u"), both_t - both_u)
    d = d.withColumn("z_mut", F.coalesce(F.when(fine, clamp(z_mut)), F.lit(0.0)))
    return d.drop("x", "y", "raw", "theta0", "T", "U", "mu_raw")


def _z(a: Column, b: Column, n: Column, m: Column, difference: Column) -> Column:
    """A difference of shares over its pooled standard error; the plain difference where that is 0."""
    p = F.try_divide(a + b, n + m)
    square = p * (1 - p) * (F.try_divide(F.lit(1.0), n) + F.try_divide(F.lit(1.0), m))
    return F.when(F.coalesce(square, F.lit(0.0)) > 0, difference / F.sqrt(F.when(square > 0, square))).otherwise(difference)


def compute(counts: DataFrame, targets: DataFrame, config: RunConfig = RunConfig()) -> DataFrame:
    """Profiles of registered counts: of every target's full length, or of every end in cotranscriptional runs."""
    config = config.resolve()
    lengths = targets.select("target_id", F.length("seq").alias("end"))
    stops = counts.join(lengths.withColumnRenamed("end", "_n"), "target_id")
    if config.cotrans:
        ends = targets.select("target_id", F.explode(F.sequence(F.least(F.lit(config.cotrans_minimum_length), F.length("seq")), F.length("seq"))).alias("end"))
    else:
        ends = lengths.unionByName(stops.select("target_id", "end")) if config.allow_multiple_rt_starts else lengths
    sides = channels(C.per_site(counts, C.spine(ends, targets), config.masks[:2]), config.masks[:2])
    return profiles(stitched(sides) if config.allow_multiple_rt_starts and not config.cotrans else sides, config)


def with_nucleotides(profile: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds name and nt: row i shows base i - 1, row 0 an asterisk."""
    named = profile.join(targets.select("target_id", "name", "seq"), "target_id")
    return named.withColumn("nt", F.when(F.col("site") == 0, "*").otherwise(F.substring("seq", F.col("site"), F.lit(1)))).drop("seq")


def row(profile: DataFrame, end: int) -> DataFrame:
    """All sites of one length."""
    return profile.where(F.col("end") == end).orderBy("target_id", "site")


def column(profile: DataFrame, site: int) -> DataFrame:
    """One site over all lengths that reach it."""
    return profile.where((F.col("site") == site) & (F.col("end") >= site)).orderBy("target_id", "end")


def matrix(profile: DataFrame, value: str, most: float | None = None, sites: tuple[int, int] | None = None, ends: tuple[int, int] | None = None) -> DataFrame:
    """A row for each end with the values of its sites as an array, capped and cut to ranges."""
    cell = F.least(F.col(value), F.lit(most)) if most is not None else F.col(value)
    kept = profile
    if sites:
        kept = kept.where(F.col("site").between(*sites))
    if ends:
        kept = kept.where(F.col("end").between(*ends))
    rows = kept.groupBy("target_id", "end").agg(F.sort_array(F.collect_list(F.struct("site", cell.alias("v")))).alias("cells"))
    return rows.select("target_id", "end", F.transform("cells", lambda x: x["v"]).alias("cells")).orderBy("target_id", "end")


def pivot(profile: DataFrame, value: str, sites: list[int]) -> DataFrame:
    """A row for each end, a column for each site."""
    return profile.groupBy("target_id", "end").pivot("site", sites).agg(F.sum(value))


def totals(profile: DataFrame, value: str) -> DataFrame:
    return profile.groupBy("target_id", "end").agg(F.sum(value).alias("total"))


def data_range(profile: DataFrame, value: str) -> DataFrame:
    return profile.agg(F.min(value).alias("least"), F.max(value).alias("most"))


def first_moment(profile: DataFrame, value: str) -> DataFrame:
    """Mean of site + 1, weighted."""
    return profile.groupBy("target_id", "end").agg(F.try_divide(F.sum((F.col("site") + 1) * F.col(value)), F.sum(value)).alias("moment"))


def normalised(profile: DataFrame, value: str) -> DataFrame:
    return profile.withColumn(value, F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy("target_id", "end"))))


def missing_sites(profile: DataFrame, minimum: int) -> DataFrame:
    """Sites without stops in either channel that lie far enough from the end."""
    return profile.where((F.col("S_t") + F.col("S_u") == 0) & (F.col("end") - F.col("site") > 2 * minimum)).groupBy("target_id", "end").agg(F.sort_array(F.collect_list("site")).alias("sites"))


def gaps(intervals: DataFrame, keys: list[str], length: Column, least: int = 20, margin: int = 4) -> DataFrame:
    """Uncovered stretches between intervals (start, stop) of each key, longer than least, less a margin at both sides."""
    order = Window.partitionBy(*keys).orderBy("start", "stop")
    before = F.coalesce(F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = intervals.select(*keys, before.alias("a"), F.col("start").alias("b"))
    tail = intervals.withColumn("_n", length).groupBy(*keys).agg(F.max("stop").alias("a"), F.max("_n").alias("b"))
    return inner.unionByName(tail).where(F.col("b") - F.col("a") > least).select(*keys, (F.col("a") + margin).alias("start"), (F.col("b") - margin).alias("stop"))
