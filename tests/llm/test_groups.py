"""Groups of near copies, repeated keys and labels without documents, against brute force."""

import random
from collections import Counter

import helpers
import pytest
from pyspark.sql import functions as F
from test_texts import brute_components

import corpus_pipeline
from ribostrand.llm import jaccard as J
from ribostrand.llm.decontamination import decontaminate
from ribostrand.llm.line_dedup import dedup_lines
from ribostrand.llm.toxicity import toxicity


def components_of(df, n, percent):
    return Counter(tuple(r) for r in J.jaccard_components(df, n, percent).select("doc_id", "n_shingles", "component_id").collect())


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        k, how = rng.randrange(len(out)), rng.random()
        if how < 0.6:
            out[k] = f"e{rng.randrange(10**6)}"
        elif how < 0.8 and len(out) > 2:
            del out[k]
        else:
            out.insert(k, f"i{rng.randrange(40)}")
    return out


@pytest.mark.parametrize(("n", "percent", "few", "levels"), [(4, 85, 128, 2), (5, 80, 1, 2), (2, 70, 1, 1), (1, 90, 0, 0)])
def test_random_groups(spark, monkeypatch, n, percent, few, levels):
    """Sizes of several bands, a common passage, one template with many near copies (few: entries that get hubs of their own)."""
    monkeypatch.setattr(J, "FEW", few)
    monkeypatch.setattr(J, "LEVELS", levels)
    rng = random.Random(n * 100 + percent)
    passage = [f"p{i}" for i in range(25)]
    rows, ids = [], iter(rng.sample(range(100_000), 5000))
    for _ in range(12):
        template = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((3, 8, 20, 45, 90, 160)))] + passage * rng.randrange(2)
        rows += [(next(ids), " ".join(edited(rng, template, rng.randrange(6)))) for _ in range(rng.randrange(1, 9))]
    template = [f"t{i}" for i in range(110)]
    second = edited(rng, template, 6)
    rows += [(next(ids), " ".join(edited(rng, t, rng.randrange(7)))) for t in (template, template, second) for _ in range(45)]
    rows += [(next(ids), " ".join(template))] * 3 + [(next(ids), " ".join(template)) for _ in range(4)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    wanted = brute_components(rows, n, percent)
    assert components_of(df, n, percent) == wanted
    assert len({c for _, _, c in wanted}) > 20


def test_little_is_shuffled_at_once(spark, monkeypatch):
    """Entries are dealt out share by share, each a part of them; of wanted rows the texts are, once."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    docs = spark.createDataFrame([(d, " ".join(edited(rng, base, d % 7))) for d in range(30)] * 2, "doc_id long, text string")
    rows = J.indexed(docs, 4, 85)
    found = [Counter(e for r in rows.select(share).collect() for band in r[0] for e in band) for share in J.SHARES]
    every = Counter(int(e) for r in docs.collect() for s in J.shingles(J.pa.array([r.text]), 4) for _, _, own in J.keys(s, 85) for e in own.view("int64"))
    assert sum(found, Counter()) == every and max(c.total() for c in found) < every.total() / 2
    plans, real = [], J.stored

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, name)

    monkeypatch.setattr(J, "stored", seen)
    J.classes(docs)
    shared = [plan for name, plan in plans if name == "shared"]
    assert [[share for share in J.SHARES if share in plan] for plan in shared] == [[share] for share in J.SHARES]
    (sets,) = [plan for name, plan in plans if name == "sets"]
    assert "Exchange" not in sets.split("MapInArrow")[0] and "Exchange" in sets


def test_rows_are_nodes(spark):
    """Rows that share a key but not a text have components of their own."""
    a, w = helpers.prose(401, 60), helpers.prose(402, 60).split(" ")
    near = " ".join([*w[:30], "other", *w[31:]])
    rows = [(5, a), (5, " ".join(w)), (3, near), (9, a), (9, a)]
    assert components_of(spark.createDataFrame(rows, "doc_id long, text string"), 2, 85) == brute_components(rows, 2, 85)


def test_one_of_each_group_stays(spark):
    a, b = helpers.prose(411, 60), helpers.prose(412, 60)
    rows = [(3, a, "x"), (5, a, "x"), (5, b, "x"), (7, a, "x"), (7, a, "x"), (8, None, "x"), (8, None, "x"), (None, b, "x"), (1, helpers.prose(413, 60), "x"), (1, helpers.prose(413, 60), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `first` string")
    got = Counter((r["doc_id"], r["text"]) for r in J.representatives(df).collect())
    assert got == Counter([(3, a), (5, b), (8, None), (8, None), (None, b), (1, helpers.prose(413, 60))])
    assert J.representatives(df).columns == df.columns and J.representatives(df.limit(0)).count() == 0


def test_contracted_in_parts(spark, monkeypatch):
    monkeypatch.setattr(J, "LOCAL", 2)
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 3), (200, 201), (201, 202)], "x long, y long").repartition(5)
    got = {r["id"]: r["component"] for r in J.components(links).collect()}
    assert got == {**{i: 1 for i in [*range(2, 41), 100]}, 201: 200, 202: 200}


def test_rows_without_a_key_are_judged_by_their_text(spark):
    item, clean = helpers.prose(421, 30), helpers.prose(422, 60)
    docs = spark.createDataFrame([(None, "see " + item), (None, clean), (4, item), (4, clean), (6, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert Counter((r["doc_id"], r["text"]) for r in decontaminate(docs, bench).collect()) == Counter([(None, clean), (4, clean), (6, None)])


def test_labels_without_documents_teach_nothing(spark):
    rows = [(i, helpers.prose(i, 40) + (" what an idiot" if i % 5 == 0 else "")) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = spark.range(200).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), (F.col("id") % 5 == 0).cast("int").alias("toxic"))
    others = spark.range(1000, 60_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    alone = {r["doc_id"]: r["score"] for r in toxicity(docs, own).collect()}
    assert {r["doc_id"]: r["score"] for r in toxicity(docs, own.unionByName(others)).collect()} == alone
    assert all((alone[i] >= 0.3) == (i % 5 == 0) for i in alone)


def test_clashing_names(spark):
    run = helpers.prose(431, 60)
    names = ["n_lines", "n_deleted", "_may", "_doc", "_copy", "_of", "_deleted", "_score", "_text", "_without", "n_chars"]
    docs = spark.createDataFrame([(1, run), (2, "first\n" + run)], "doc_id long, text string").select("*", *(F.lit(7).cast("long").alias(c) for c in names))
    got = {r["doc_id"]: r for r in dedup_lines(docs).collect()}
    assert got[2]["text"] == "first" and got[2]["n_lines"] > 1 and got[2]["_may"] == 7
    out = corpus_pipeline.drop_repeated_lines(spark, docs, "")
    assert out.columns == docs.columns and {r["doc_id"]: (r["n_lines"], r["n_chars"]) for r in out.collect()} == {1: (7, 7), 2: (7, 5)}


def test_stages_on_nothing(spark, tmp_path):
    none = helpers.empty(spark)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, none, str(tmp_path))
        assert out.count() == 0 and (k == 4 or out.columns == none.columns)
