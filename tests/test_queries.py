"""Every query with a SQL twin against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from ribostrand.plans import queries as Q

SF = "/root/testdata/sf0.001"
QUICK = sorted(Q.SQL)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: round(v, 7) + 0.0 if isinstance(v, float) and not math.isinf(v) else v
    return sorted(repr([cell(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", QUICK)
def test_twin(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    got = duck.execute(Q.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    found = rows(df.columns, df.collect())
    assert found and found == rows(names, got.fetchall())


@pytest.mark.parametrize("name", ["align_indels"])
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, SF).count() == {"align_indels": 1000}[name]


def test_plans_push_down(spark):
    plan = Q.QUERIES["tag_counts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan


def test_whole_searches(spark, tmp_path):
    """All pairs against brute force, with ids beyond 3000 and multiples of 11."""
    from ribostrand.plans import testbed as B

    ids = [0, 1, 7, 11, 22, 2999, 3000, 3001, 3003, 99_990, 99_999]
    spark.createDataFrame([(i, i * 3 % 7) for i in ids], "event_id long, user_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    targets = {r["target_id"]: r["seq"] for r in B.targets(spark, str(tmp_path)).collect()}
    reads = {r["pair_id"]: r["r2"] for r in B.pairs(spark, str(tmp_path)).collect()}
    assert sorted(reads) == ids
    runs = set()
    for i, q in reads.items():
        for t, seq in targets.items():
            for a in range(len(q)):
                for p in range(len(seq)):
                    if q[a] == seq[p] and (a == 0 or p == 0 or q[a - 1] != seq[p - 1]):
                        n = next((k for k in range(min(len(q) - a, len(seq) - p)) if q[a + k] != seq[p + k]), min(len(q) - a, len(seq) - p))
                        if n >= 20:
                            runs.add((i, t, a, n, p))
    got = {tuple(r) for r in Q.QUERIES["kmer_seed_join"](spark, str(tmp_path)).collect()}
    assert got == runs
    most = {i: max(r[3] for r in runs if r[0] == i) for i in {r[0] for r in runs}}
    wanted = {(i, n, len({r[1] for r in runs if r[0] == i and r[3] == n})) for i, n in most.items()}
    assert {tuple(r) for r in Q.QUERIES["best_match"](spark, str(tmp_path)).collect()} == wanted
    found = {r["query_id"]: r["length"] for r in Q.QUERIES["find_partial_matches"](spark, str(tmp_path)).collect()}
    assert {3003, 99_990, 11} <= set(most) <= set(found) and all(found[i] == n for i, n in most.items())


def test_all_items_are_targets(spark, tmp_path):
    from pyspark.sql import functions as F

    from ribostrand.plans import testbed as B

    spark.range(57).select(F.col("id").alias("item_id"), F.concat(F.lit("some text of an item "), F.repeat(F.lit("abcdefg hij "), 10)).alias("text")).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.range(300).select(F.col("id").alias("event_id"), (F.col("id") * 5).alias("user_id")).write.parquet(f"{tmp_path}/events.parquet")
    assert {r["target_id"] for r in B.targets(spark, str(tmp_path)).collect()} == set(range(1, 58))
    pairs = B.pairs(spark, str(tmp_path)).collect()
    assert len(pairs) == 300 and all(r["target_id"] == r["pair_id"] * 5 % 57 + 1 for r in pairs)
    assert {r["target_id"] for r in Q.QUERIES["kmer_index"](spark, str(tmp_path)).collect()} == set(range(1, 58))
