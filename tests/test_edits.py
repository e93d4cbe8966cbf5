"""Approximate joins against brute force."""

import random

import pytest

from ribostrand.operators import edits as E


def some(rng, n, letters="ACGT"):
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.mark.parametrize("errors", [0, 1, 2, 4])
def test_places_with_errors(spark, errors):
    """Queries of 1 to 60 bases, some longer than the targets, some with as many errors as allowed or one more."""
    rng = random.Random(errors)
    targets = {i: some(rng, rng.choice((5, 40, 120))) for i in range(8)} | {8: "A" * 30, 9: ""}
    queries = {}
    for i in range(60):
        t = rng.choice([x for x in targets.values() if x])
        a = rng.randrange(len(t))
        q = list(t[a : a + rng.randrange(1, 61)])
        for _ in range(rng.randrange(errors + 2)):
            q[rng.randrange(len(q))] = rng.choice("ACGT")
        queries[i] = "".join(q)
    queries |= {100: "A" * 12, 101: "", 102: "AC"}
    wanted = {
        (i, k, p, d) for i, q in queries.items() if len(q) > errors for k, t in targets.items() for p in range(len(t) - len(q) + 1)
        if (d := sum(x != y for x, y in zip(q, t[p:], strict=False))) <= errors
    }
    a, b = spark.createDataFrame([*queries.items()], "query_id int, seq string"), spark.createDataFrame([*targets.items()], "target_id int, seq string")
    assert {tuple(r) for r in E.places_with_errors(a, b, errors).select("query_id", "target_id", "pos", "distance").collect()} == wanted
    long_ = a.where("length(seq) >= 12 * ({} + 1) and query_id < 100".format(errors))
    places = sum(max(0, len(t) - 12 * (errors + 1)) for t in targets.values()) * max(1, long_.count())
    assert E.candidates(long_, b, errors).count() <= max(40, places // 10)


def one_edit(key):
    """Every read of the key's length with one edit, and what follows a deletion."""
    out = {}
    for i in range(len(key)):
        for x in "ACGT":
            out.setdefault(key[:i] + key[i + 1 :] + x, "deletion")
            out[(key[:i] + x + key[i:])[: len(key)]] = "insertion"
    for i in range(len(key)):
        for x in "ACGT":
            out[key[:i] + x + key[i + 1 :]] = "substitution"
    out.pop(key, None)
    return out


def test_every_read_with_one_edit(spark):
    rng = random.Random(7)
    keys = [some(rng, 9) for _ in range(6)] + ["AAAAAAAAA", "ACACACACA", some(rng, 5), ""]
    keys += [keys[0][:4] + "ACGT"[("ACGT".index(keys[0][4]) + 1) % 4] + keys[0][5:]]  # one edit from another key
    reads = sorted({r for k in keys for r in one_edit(k)} | {some(rng, 9) for _ in range(300)} | {*keys, "AC"})
    variants = {k: one_edit(k) for k in keys}
    wanted = set()
    for i, r in enumerate(reads):
        if r in keys:
            wanted.add((i, r, "none", None))
            continue
        for k, v in variants.items():
            if r in v:
                wanted.add((i, k, v[r], next(p for p in range(len(k)) if k[p] != r[p])))
    a = spark.createDataFrame([*enumerate(reads)], "pair_id int, seq string").repartition(3)
    b = spark.createDataFrame([(k,) for k in [*keys, keys[0]]], "key string")
    got = [tuple(r) for r in E.one_edit_hits(a, b).select("pair_id", "table_key", "edit", "place").collect()]
    assert set(got) == wanted and len(got) == len(wanted)


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], "pair_id int, seq string")
    keys = spark.createDataFrame([("ACGT",)], "key string")
    assert E.one_edit_hits(none, keys).count() == 0 and E.one_edit_hits(none.union(spark.createDataFrame([(1, "ACGA")], none.schema)), keys.limit(0)).count() == 0
    targets = spark.createDataFrame([(1, "ACGT")], "target_id int, seq string")
    assert E.places_with_errors(none.withColumnRenamed("pair_id", "query_id"), targets, 1).count() == 0
