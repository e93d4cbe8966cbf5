"""Kept tables: equal to what is computed from all batches at once, joined without a shuffle."""

import random

from pyspark.sql import functions as F

from ribostrand.operators import results as Q
from ribostrand.operators.kept import Kept


def batches(spark):
    rng = random.Random(2)
    pairs = [(i, f"p{i}", f"ACG{rng.randrange(6)}", f"T{rng.randrange(3)}", rng.choice((None, 1, 2))) for i in range(300)]
    results = [(i, s, 1 + i % 3, "RRRY", i % 7, 30, -1, rng.randrange(1, 9), None, rng.sample(["match", "treated", "x"], rng.randrange(4))) for i in range(300) for s in ("a", "b")]
    a = spark.createDataFrame(pairs, "pair_id long, identifier string, r1 string, r2 string, multiplicity long")
    b = spark.createDataFrame(results, "pair_id long, set_name string, target_id int, mask string, site int, `end` int, muts int, multiplicity long, failure string, tags array<string>")
    return a, b


def rows(df):
    return sorted(str(r) for r in df.select(*sorted(df.columns)).collect())


def shuffles(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x and "BroadcastExchange" not in x]


def test_three_batches(spark, tmp_path):
    pairs, results = batches(spark)
    kept = Kept(spark, str(tmp_path), "three", 4)
    for k in (0, 1, 2, 1):  # the second one twice
        kept.add_pairs(pairs.where(F.col("pair_id") % 3 == k), f"b{k}")
        kept.add_results(results.where(F.col("pair_id") % 3 == k), f"b{k}")
    assert rows(kept.pairs()) == rows(pairs.fillna(1, ["multiplicity"])) and rows(kept.results()) == rows(results)
    unique = pairs.groupBy("r1", "r2").agg(F.min("pair_id").alias("pair_id"), F.sum(F.coalesce("multiplicity", F.lit(1))).alias("multiplicity"))
    assert rows(kept.unique_pairs()) == rows(unique)
    assert rows(kept.tag_counts("a")) == rows(Q.tag_counts(results.where("set_name = 'a'")))
    assert rows(kept.matching("a", ["match"], ["x"], 9)) == rows(Q.matching(results.where("set_name = 'a'"), pairs, ["match"], ["x"], 9))
    assert rows(kept.matching_site("b", 2, 4, 30, 5)) == rows(Q.matching_site(results.where("set_name = 'b'"), pairs, 2, 4, 30, 5))
    assert kept.with_reads("a").count() == 300
    again = Kept(spark, str(tmp_path), "another", 4)  # as another session would open it
    assert rows(again.unique_pairs()) == rows(unique)
    again.drop("b1")
    assert again.pairs().count() == 200 and again.tag_counts("a").count() > 0


def test_no_shuffle(spark, tmp_path):
    """Neither the join with all copies, nor the merge of unique pairs, nor a top list by tag or site."""
    pairs, results = batches(spark)
    kept = Kept(spark, str(tmp_path), "plans", 4)
    kept.add_pairs(pairs, "b")
    kept.add_results(results, "b")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
    try:
        for df in (kept.with_reads("a"), kept.unique_pairs(), kept.matching("a", ["match"], limit=5), kept.matching_site("a", 1, 3, 30, 5)):
            assert shuffles(df) == [], shuffles(df)
        plain = results.where("set_name = 'a'").join(pairs.drop("multiplicity"), "pair_id")
        assert len(shuffles(plain)) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
