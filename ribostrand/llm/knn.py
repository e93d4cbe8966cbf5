"""Exact top-k search by inner product as a Voronoi join.

Vectors become integers (floor of the scaled components). Pivots, taken from a
bounded sample by a few rounds of k-means, divide the queries into groups. From
summaries (the pivot and the radius of a query group, the norm and the pivot
distances of a vector, the best scores of each query among the sample and the
lower bounds that each data group's nearest members give) follow, for each
query group, a score that its k-th neighbours reach at least, and for each
vector an upper bound of its score with any query of the group. Only vectors
whose bound reaches the group's score are sent to the group; there, in blocks
of bounded size, an exact product finds the best k, and blocks are merged.

Score bounds: for x with pivot p at distance d and a query q,
q.x >= q.p - |q| d; for q within r of its group's pivot g,
q.x <= g.x + r |x|; and for q within the angle a of g, the angle between q and x
is at least that between g and x less a. Where vectors have no clusters (random
directions in many dimensions) none of these rules much out, and groups get
nearly all vectors; the blocks then bound what a task holds.

Edge cases: vectors that are null, empty or hold null or non-finite components
take no part; vectors of different lengths are never compared; ties go to the
smaller id; a query never finds rows of its own id; with fewer candidates than
k, all are returned; a null id takes no part; repeated rows are candidates of
their own; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SAMPLE = 2048
MOST_PIVOTS = 2048
QUERIES_A_PIVOT = 64
BLOCK = 4096
SLACK = 1e-6
#: Bounds from the pivots allow for so many rows of a query's own id; where an id has more, they are not used.
MOST_COPIES = 64
OUT = "query_id long, rank int, vec_id long, score long"


def integer_vectors(df: DataFrame, scale: float = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, size, v (little-endian int64 components) of the vectors that take part."""
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("e")).where("vec_id is not null and size(e) > 0")
    sound = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ints = rows.where(sound).select("vec_id", F.size("e").alias("size"), F.transform("e", lambda x: F.floor(x * F.lit(float(scale)))).alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values, offsets = lists.flatten().to_numpy(zero_copy_only=False).astype("<i8"), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([values[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], ["vec_id", "size", "v"])

    return ints.mapInArrow(run, "vec_id long, size int, v binary")


def matrix(column, size: int) -> np.ndarray:
    raw = b"".join(x.as_buffer().to_pybytes() for x in column)
    return np.frombuffer(raw, "<i8").reshape(-1, size)


def products(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Exact integer inner products (in doubles where they cannot round)."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * queries.shape[1]
    if most < 2**53:
        return (queries.astype(np.float64) @ data.T.astype(np.float64)).astype(np.int64)
    return queries @ data.T


def pivots_of(sample: np.ndarray, count: int) -> np.ndarray:
    """k-means centres of the sample, from evenly spaced rows."""
    x = sample.astype(np.float64)
    centres = x[np.linspace(0, len(x) - 1, min(count, len(x))).astype(int)]
    for _ in range(4):
        near = nearest(x, centres)[0]
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return np.unique(centres, axis=0)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centre, distance to it)."""
    d = (x**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2 * x @ centres.T
    near = d.argmin(1)
    return near, np.sqrt(np.maximum(d[np.arange(len(x)), near], 0))


def angles(x: np.ndarray, norm: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The angle between each vector (of that norm) and each centre; a right one for vectors without direction."""
    sizes = norm[:, None] * np.sqrt((centres**2).sum(1))[None, :]
    return np.arccos(np.clip(np.divide(x @ centres.T, sizes, out=np.zeros_like(sizes), where=sizes > 0), -1, 1))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _joined(vectors: DataFrame, queries: DataFrame, size: int, k: int) -> DataFrame:
    spark = vectors.sparkSession
    n_queries = queries.count()
    copies = vectors.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    # a query's own rows may be among the nearest of a pivot, but never among its results
    kept = k + copies if copies <= MOST_COPIES else 0
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()  # a bounded sample
    sample = np.frombuffer(b"".join(bytes(r["v"]) for r in rows), "<i8").reshape(-1, size).astype(np.float64)
    sample_ids = np.array([r["vec_id"] for r in rows])
    pivots = pivots_of(sample, max(1, min(MOST_PIVOTS, math.ceil(n_queries / QUERIES_A_PIVOT))))
    shared = spark.sparkContext.broadcast((pivots, sample, sample_ids))  # SAMPLE vectors and at most as many pivots

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near_by: list[np.ndarray] = [np.zeros(0)] * len(pivots)
        for batch in batches:
            near, d = nearest(matrix(batch.column(1), size).astype(np.float64), shared.value[0])
            for g in np.unique(near):
                near_by[g] = np.sort(np.append(near_by[g], d[near == g]))[:kept]
        rows = [(g, x) for g, ds in enumerate(near_by) for x in ds.tolist()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64())], ["g", "d"])

    closest = Window.partitionBy("g").orderBy("d")
    near_rows = vectors.select("vec_id", "v").mapInArrow(summarise, "g int, d double").withColumn("n", F.row_number().over(closest)).where(F.col("n") <= kept).select("g", "d").collect()  # at most k + MOST_COPIES numbers a pivot
    near_g, near_d = np.array([r["g"] for r in near_rows], np.int64), np.array([r["d"] for r in near_rows])

    def bound_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, few, few_ids = shared.value
        for batch in (b.slice(at, 256) for b in batches for at in range(0, len(b), 256)):
            q, ids = matrix(batch.column(1), size).astype(np.float64), batch.column(0).to_numpy()
            near, d = nearest(q, centres)
            norm = np.sqrt((q**2).sum(1))
            floor = np.full(len(q), -np.inf)
            if len(near_g) >= max(kept, 1):
                low = (q @ centres.T)[:, near_g] - norm[:, None] * near_d[None, :]
                floor = np.partition(low, low.shape[1] - kept, axis=1)[:, low.shape[1] - kept]
            scores = q @ few.T
            scores[ids[:, None] == few_ids[None, :]] = -np.inf
            if scores.shape[1] >= k:
                floor = np.maximum(floor, np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k])
            angle = angles(q, norm, centres)[np.arange(len(q)), near]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.int32()), pa.array(d), pa.array(floor), pa.array(angle), pa.array(norm)], ["query_id", "q", "g", "d", "floor", "angle", "norm"])

    asked = stored(queries.select("vec_id", "v").mapInArrow(bound_queries, "query_id long, q binary, g int, d double, floor double, angle double, norm double"), "queries")
    groups = asked.groupBy("g").agg(F.max("d").alias("r"), F.min("floor").alias("floor"), F.max("angle").alias("angle"), F.min("norm").alias("least"), F.max("norm").alias("most")).orderBy("g").collect()  # a row a pivot
    if not groups:
        return spark.createDataFrame([], OUT)
    number = np.array([x["g"] for x in groups])
    radius, floors, turn, least, most = (np.array([x[c] for x in groups]) for c in ("r", "floor", "angle", "least", "most"))

    def wanted(x: np.ndarray) -> np.ndarray:
        """By row and query group: may the vector be among the best k of any of its queries?"""
        norm = np.sqrt((x**2).sum(1))
        own = shared.value[0][number]
        high = x @ own.T + norm[:, None] * radius[None, :]
        cosine = np.cos(np.maximum(angles(x, norm, own) - turn[None, :], 0))
        high = np.minimum(high, norm[:, None] * np.where(cosine > 0, most, least) * cosine)
        return high + SLACK * (1 + np.abs(high)) >= floors[None, :]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(number), np.int64)
        for batch in (b.slice(at, 2048) for b in batches for at in range(0, len(b), 2048)):
            sums += wanted(matrix(batch.column(1), size).astype(np.float64)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), pa.array(sums)], ["g", "n"])

    sums = {r["g"]: r["n"] for r in vectors.select("vec_id", "v").mapInArrow(count, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()}
    blocks = np.array([max(1, math.ceil(sums.get(int(g), 0) / BLOCK)) for g in number])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                row, g = np.nonzero(wanted(matrix(part.column(1), size).astype(np.float64)))
                take = pa.array(row)
                block = part.column(2).to_numpy()[row] % blocks[g]
                yield pa.RecordBatch.from_arrays([pa.array(number[g].astype(np.int32)), pa.array(block.astype(np.int64)), part.column(0).take(take), part.column(1).take(take)], ["g", "block", "vec_id", "v"])

    spread = F.shiftright(F.xxhash64("vec_id"), 1).bitwiseAND((1 << 62) - 1).alias("spread")
    data = vectors.select("vec_id", "v", spread).mapInArrow(send, "g int, block long, vec_id long, v binary")
    of_group = F.create_map(*[F.lit(int(x)) for g, b in zip(number, blocks, strict=True) for x in (g, b)])  # a number a pivot
    query_blocks = asked.select("g", "query_id", "q", F.explode(F.sequence(F.lit(0).cast("long"), F.element_at(of_group, F.col("g")).cast("long") - 1)).alias("block"))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            ids, x = right.column("vec_id").to_numpy(), matrix(right.column("v"), size)
            query_ids, q = left.column("query_id").to_numpy(), matrix(left.column("q"), size)
            for a in range(0, len(q), 256):
                for query, scores in zip(query_ids[a : a + 256].tolist(), products(q[a : a + 256], x), strict=True):
                    other = np.flatnonzero(ids != query)
                    at = other[best(scores[other], ids[other], k)]
                    out += [(query, int(i), int(s)) for i, s in zip(ids[at], scores[at], strict=True)]
        return pa.Table.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], ["query_id", "vec_id", "score"])

    local = query_blocks.groupBy("g", "block").cogroup(data.groupBy("g", "block")).applyInArrow(solve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(df: DataFrame, is_query: Column, k: int = 10, scale: float = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows for each row of df for which is_query (a condition on vec_id) holds."""
    vectors = stored(integer_vectors(df, scale, key, vector), "vectors")
    out = df.sparkSession.createDataFrame([], OUT)
    for r in vectors.groupBy("size").count().orderBy("size").collect():
        own = vectors.where(F.col("size") == r["size"])
        out = out.unionByName(_joined(own, own.where(is_query), r["size"], k))
    return out
