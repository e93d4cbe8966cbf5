"""Shards with a manifest, SAM and channel files read back, regions, samples, filters that SQLite runs."""

import json
import os
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from ribostrand.config import RunConfig
from ribostrand.operators import classify as K
from ribostrand.operators import pairs as P
from ribostrand.operators import results as Q
from ribostrand.sinks import exports as X
from ribostrand.sinks import shards
from ribostrand.sources import reads as S
from ribostrand.sources import stored

PAIR = "pair_id long, identifier string, r1 string, r2 string, r1_qual string, r2_qual string"


def some_pairs(spark, n=200, seed=1):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice("ACGT") for _ in range(k))
    rows = [(i, f"p{i}", rng.choice(("AAAT", "CCCG", "ACGT")) + text(rng.randrange(1, 30)), text(rng.randrange(1, 50)), None, None) for i in range(n)]
    return spark.createDataFrame([(i, p, a, b, "I" * len(a), "J" * len(b)) for i, p, a, b, _, _ in rows], PAIR)


@pytest.mark.parametrize("gzip", [False, True])
def test_channels_come_back(spark, tmp_path, gzip):
    pairs, path = some_pairs(spark).repartition(5), f"{tmp_path}/channels"
    X.write_channels(pairs, path, compress=gzip)
    assert sum(s["rows"] for s in shards.read_manifest(path)) == pairs.where("r1 LIKE 'AAAT%' OR r1 LIKE 'CCCG%'").count()
    for mask, handle in (("RRRY", "AAAT"), ("YYYR", "CCCG")):
        back = S.read_fastq(spark, *(shards.shard_files(path, r, mask) for r in ("R1", "R2")), strict=True, split_bytes=300)
        wanted = pairs.where(F.col("r1").startswith(handle)).select("identifier", F.substring("r1", 5, 99), "r2", F.substring("r1_qual", 5, 99), "r2_qual")
        assert sorted(map(tuple, back.select("identifier", "r1", "r2", "r1_qual", "r2_qual").collect())) == sorted(map(tuple, wanted.collect()))
    sheet = {r["channel"]: r for r in X.input_sheet(spark, ("RRRY", "YYYR"), path).collect()}
    assert S.read_fastq(spark, sheet["treated"]["r1"], sheet["treated"]["r2"]).count() == pairs.where("r1 LIKE 'AAAT%'").count()


def test_a_task_that_fails_leaves_no_trace(spark, tmp_path):
    """A job that fails keeps what was there; a task that fails once writes its rows once."""
    path, flag = f"{tmp_path}/out", f"{tmp_path}/failed"
    pairs = some_pairs(spark, 60).repartition(3)
    X.write_fastq(pairs.limit(10), path)
    before = sorted(os.listdir(path))

    @F.udf("string")
    def broken(i, text):
        if i == 41:
            raise RuntimeError("lost")
        return text

    with pytest.raises(Exception, match="lost"):
        X.write_fastq(pairs.withColumn("r2", broken("pair_id", "r2")), path)
    # tasks that Spark killed may leave files that nothing names
    assert set(before) <= set(os.listdir(path)) and sum(s["rows"] for s in shards.read_manifest(path)) == 10
    assert S.read_fastq(spark, shards.shard_files(path, "R1"), shards.shard_files(path, "R2")).count() == 10
    open(f"{path}/left-by-a-lost-executor.R1.fastq", "w").close()

    @F.udf("string")
    def once(i, text):
        if i == 41 and not os.path.exists(flag):
            open(flag, "w").close()
        return text

    X.write_fastq(pairs.withColumn("r2", once("pair_id", "r2")), path)
    files = {f for s in shards.read_manifest(path) for f in s["files"].values()}
    assert {f for f in os.listdir(path) if not f.startswith(".")} == files | {shards.MANIFEST}
    back = S.read_fastq(spark, shards.shard_files(path, "R1"), shards.shard_files(path, "R2"))
    assert sorted(r["identifier"] for r in back.collect()) == sorted(f"p{i}" for i in range(60))
    X.write_fastq(pairs.limit(5), path, mode="append")
    assert sum(s["rows"] for s in shards.read_manifest(path)) == 65
    X.write_fastq(pairs.limit(0), path)
    assert shards.read_manifest(path) == [] and shards.read_shards(spark, path, "R1").count() == 0


def test_an_attempt_that_breaks_off_deletes_its_files(tmp_path):
    """The writer itself, without Spark: rows of a first batch are on disk when the second one fails."""
    import pyarrow as pa

    class Context:
        partitionId = staticmethod(lambda: 3)

    schema = pa.schema([("group", pa.string()), ("R1", pa.string())])

    def batches():
        yield pa.RecordBatch.from_pylist([{"group": "a", "R1": "x"}, {"group": "b", "R1": "y"}], schema=schema)
        assert len(os.listdir(tmp_path)) == 2
        raise OSError("disk")

    writer = shards.ShardWriter({"path": str(tmp_path)}, ["R1"], True)
    before = shards.TaskContext
    shards.TaskContext = type("T", (), {"get": staticmethod(lambda: Context)})
    try:
        with pytest.raises(OSError, match="disk"):
            writer.write(batches())
        assert os.listdir(tmp_path) == []
        kept = writer.write(iter([pa.RecordBatch.from_pylist([{"group": None, "R1": "x"}], schema=schema)]))
        writer.abort([kept, None])
        assert os.listdir(tmp_path) == []
    finally:
        shards.TaskContext = before


def test_sam_comes_back(spark, tmp_path):
    target = "ACGTTGCAACGATCGATTGCATGCCATGCAATCGGCTAATCGTTACGCA"
    targets = spark.createDataFrame([(1, "five", target)], "target_id int, name string, seq string")
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rows = [(i, f"p{i}", "AAAT" + rc(target[i % 20 :])[:24], (target[i % 20 :] + "ATTT")[:28] if i % 7 else "GGGG", None, None) for i in range(90)]
    pairs = spark.createDataFrame(rows, PAIR)
    results = K.classify(pairs, targets, RunConfig())
    X.write_sam(results, pairs, targets, f"{tmp_path}/sam", gzip=True)
    lines = [r["value"] for r in shards.read_shards(spark, f"{tmp_path}/sam", "sam").collect()]
    assert sorted(x for x in lines if x.startswith("@")) == ["@HD\tVN:1.0\tSO:unsorted", "@PG\tID:ribostrand", "@SQ\tSN:five\tLN:49"] and len(lines) == 183
    sam = S.read_sam(spark, shards.shard_files(f"{tmp_path}/sam", "sam"))
    back = {r["qname"]: (r["target"], r["site"], r["end"]) for r in S.sam_pairs(sam, targets).collect()}
    assert back == {f"p{r['pair_id']}": ("five", r["site"], r["end"]) for r in results.where("site IS NOT NULL").collect()} and len(back) > 60


def test_regions(spark):
    """Regions of a few to a million places; rows once each, however many regions hold them."""
    rng = random.Random(3)
    regions = [(a, a + rng.choice((0, 3, 30, 5000, 900_000))) for a in (rng.randrange(2_000_000) for _ in range(300))] + [(5, 5), (5, 5), (9, 2)]
    rows = [(i, 1 + i % 3, rng.choice((None, rng.randrange(3_000_000))), [rng.randrange(3_000_000) for _ in range(rng.randrange(3))]) for i in range(400)] + [(7, 1, 5, [5]), (7, 1, 5, [5]), (8, 1, 4, None)]
    results = spark.createDataFrame(rows, "pair_id long, target_id int, site int, mutations array<int>")
    inside = lambda x, rs: x is not None and any(a <= x <= b for a, b in rs)
    wanted = sorted(str(r) for r in rows if inside(r[2], regions) or any(inside(m, regions) for m in r[3] or []))
    found = Q.by_region(results, spark.createDataFrame(regions, "start int, stop int"))
    assert sorted(str(tuple(r)) for r in found.collect()) == wanted and found.columns == results.columns
    assert "NestedLoop" not in str(Q.in_regions(results.withColumn("place", F.col("site")), spark.createDataFrame(regions * 2, "start int, stop int").hint("merge"))._jdf.queryExecution().executedPlan()).replace("BroadcastNestedLoopJoin BuildRight, Cross", "").replace("BroadcastNestedLoopJoin BuildRight, Inner", "")
    own = spark.createDataFrame([(t, a, b) for t, (a, b) in zip([1, 2, 3] * 101, regions, strict=False)], "target_id int, start int, stop int")
    by = {t: [tuple(r)[1:] for r in own.collect() if r["target_id"] == t] for t in (1, 2, 3)}
    wanted = sorted(str(r) for r in rows if inside(r[2], by[r[1]]) or any(inside(m, by[r[1]]) for m in r[3] or []))
    assert sorted(str(tuple(r)) for r in Q.by_region(results, own).collect()) == wanted
    assert Q.by_region(results, own.limit(0)).count() == 0 and Q.by_region(results.limit(0), own).count() == 0


@pytest.mark.parametrize("n", [0, 1, 37, 199, 500])
def test_samples_are_the_same_for_any_partitioning(spark, monkeypatch, n):
    monkeypatch.setattr(P, "DIGITS", 1)
    monkeypatch.setattr(P, "MOST_SORTED", 3)
    pairs = some_pairs(spark, 200).unionByName(some_pairs(spark, 4))  # some rows twice
    order = sorted((r["h"], r["pair_id"]) for r in pairs.withColumn("h", P.sample_hash(5)).collect())
    got = [sorted(r["pair_id"] for r in P.sample(pairs.repartition(k), n, 5).collect()) for k in (1, 7)]
    assert got[0] == got[1] == sorted(i for _, i in order[:n])
    assert P.sample(pairs, n, 5).columns == pairs.columns


def test_filters_run_in_sqlite(spark, tmp_path):
    path = f"{tmp_path}/run.sqlite"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE result (set_id, pair_id, target, mask, site, end, muts, multiplicity, failure, tag_mask)")
        db.executemany("INSERT INTO result VALUES (?, ?, 1, ?, ?, 40, -1, 1, ?, 0)", [(1 + i % 2, i, "RRRY" if i % 3 else None, i % 50, None if i % 5 else "no Match") for i in range(1000)])
    rows = stored.read_table(spark, path, "result", rows=100)
    plain = rows
    every = [r.asDict() for r in rows.collect()]
    for condition, test in {
        "set_id = 2 AND pair_id > 900": lambda r: r["set_id"] == 2 and r["pair_id"] > 900,
        "mask IS NULL AND site IN (3, 4, 5)": lambda r: r["mask"] is None and r["site"] in (3, 4, 5),
        "failure LIKE 'no%' AND NOT (site = 10)": lambda r: (r["failure"] or "").startswith("no") and r["site"] != 10,
        "contains(failure, 'match')": lambda r: "match" in (r["failure"] or ""),
        "mask <=> 'RRRY' AND row_id <= 20": lambda r: r["mask"] == "RRRY" and r["row_id"] <= 20,
        "site * 2 = 8": lambda r: r["site"] == 4,
    }.items():
        rows = stored.read_table(spark, path, "result", rows=100, pushdown=True)
        assert sorted(r["row_id"] for r in rows.where(condition).collect()) == sorted(r["row_id"] for r in every if test(r))
    # fewer tasks, and fewer rows leave SQLite
    rows = stored.read_table(spark, path, "result", rows=100, pushdown=True)
    assert plain.rdd.getNumPartitions() == 10 and rows.where("pair_id BETWEEN 400 AND 420").rdd.getNumPartitions() == 1
    a, b = (plain.where(F.col("set_id") == k).select("pair_id") for k in (1, 2))
    assert a.unionByName(b).count() == 1000 and a.join(b, "pair_id").count() == 0
    reader = stored.SqliteReader({"path": path, "table": "result", "rows": "100"})
    rest = list(reader.take_filters([stored.EqualTo(("set_id",), 2), stored.EqualTo(("site",), 7), stored.StringContains(("failure",), "x")]))
    assert rest == [] and reader.partitions() == []
    reader = stored.SqliteReader({"path": path, "table": "result", "rows": "100"})
    assert list(reader.take_filters([stored.In(("site",), (7,)), stored.EqualTo(("site", "x"), 7)])) == [stored.EqualTo(("site", "x"), 7)]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 20


def test_manifest_is_plain(spark, tmp_path):
    X.write_fastq(some_pairs(spark, 3).coalesce(1), f"{tmp_path}/f")
    with open(f"{tmp_path}/f/{shards.MANIFEST}") as f:
        (shard,) = json.load(f)
    assert shard["rows"] == 3 and set(shard["files"]) == {"R1", "R2"}
