"""Filter audit against every order applied to every document."""

import random
import re
from collections import defaultdict
from itertools import permutations

import helpers
import pytest
from pyspark.sql import functions as F

from ribostrand.llm import filter_audit as A


def fails(text, doc, rows):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 100,
        "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        "D": re.search("[#$%&*|]", text) is not None,
        "E": doc is not None and any(t == text and d is not None and d < doc for d, t in rows),
    }


def brute(rows, labels):
    own = [(d, t or "") for d, _, t in rows]
    out = defaultdict(lambda: [0] * 7)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    for doc, lang, text in rows:
        f = fails(text or "", doc, own)
        for order in permutations("ABCDE"):
            gone = False
            for k, x in enumerate(order):
                c = out[lang or "", "".join(order), k + 1]
                here = f[x] and not gone
                c[1] += here
                c[2] += f[x] and gone
                c[3] += f[x] and sum(f.values()) == 1
                c[4] += here and doc in good
                c[5] += here and doc in toxic
                gone = gone or f[x]
                c[0] += not gone
    shapley = defaultdict(int)
    for (part, order, k), c in out.items():
        shapley[part, order[k - 1]] += c[1]
    return sorted((p, o, k, *c[:6], shapley[p, o[k - 1]]) for (p, o, k), c in out.items())


def audit(docs, labels):
    return sorted(tuple(r) for r in A.audit(docs, labels).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())


def test_against_all_orders(spark):
    rng = random.Random(3)
    texts = ["", None, "A B C", "# one", helpers.prose(1, 120), helpers.prose(2, 150) + " $", "w " * 200, "X" * 30, " ".join(f"v{i}" for i in range(130)), "Q" * 20 + " ".join(f"v{i}" for i in range(101)), "é" * 5]
    rows = [(rng.choice((None, *range(60))), rng.choice(("en", "en", "de", None, "")), rng.choice(texts)) for _ in range(90)]
    labels = [(rng.choice((None, *range(80))), rng.choice((0, 1, None)), rng.choice((0, 1, None))) for _ in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("mask", F.lit("clash")).repartition(5)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert audit(docs, table) == brute(rows, labels)


@pytest.mark.parametrize("partitions", [1, 3, 9])
def test_copies_over_many_partitions(spark, partitions):
    """One text is most of the table, without doc_id or with equal ones among them; others end or begin at borders."""
    rng = random.Random(partitions)
    rows = [(i // 2 if i < 200 else None, "common") for i in range(230)] + [(rng.randrange(40), f"t{rng.randrange(12)}") for _ in range(60)] + [(None, "only null"), (None, "only null"), (5, "null first"), (None, "null first"), (9, "null first")]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame([(d, "en", t) for d, t in rows], "doc_id long, lang string, text string").repartition(4)
        got = A.failures(docs).select("doc_id", (F.col("mask") >= A.DUPLICATE).alias("e")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    own = sorted((str(d), fails(t, d, rows)["E"]) for d, t in rows)
    assert sorted((str(r["doc_id"]), r["e"]) for r in got) == own


def test_awkward_rows(spark, docs, none):
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 1), (11, 1, 0), (None, 1, 1), (18, 0, 1)], "doc_id long, quality int, toxic int")
    rows = [(r[0], r[2], r[1]) for r in helpers.rows()]
    assert audit(docs, labels) == brute(rows, [(0, 1, 0), (0, 1, 1), (11, 1, 0), (None, 1, 1), (18, 0, 1)])
    assert audit(none, labels) == [] and len(audit(docs, labels.limit(0))) == 600
