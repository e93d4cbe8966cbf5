"""Alignment, edit distance, options and column functions."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ribostrand.config import RunConfig
from ribostrand.functions import sequences as S
from ribostrand.functions.alignment import Scoring, align, align_many, edit_distance
from ribostrand.functions.reads import near_places, overlap_start, rc

RUN, OTHER = "CCCCCAAAAAAAAAAAAAAAAAAAAAACCCC", "TTTTAAAAAAAAAAAAAAAAAAAAAATTTTT"


def test_alignment_ends():
    a = align(RUN, OTHER, Scoring(3, 5, 5, 1))
    assert (a.score, a.target_end, a.source_end, a.longest_run, a.mismatched, a.delta) == (32, 30, 30, 22, [], 0)
    assert {k: (x.insert, x.seq, x.src) for k, x in a.indels.items()} == {0: (True, "CCCCC", 0), 3: (False, "TTTT", 5), 26: (True, "CCCC", 27), 30: (False, "TTTTT", 31)}
    b = align(RUN, OTHER, Scoring(3, 4, 5, 1, front_clip=False))
    assert (b.score, b.target_start, b.target_end, b.source_start, b.source_end, b.indels) == (34, 0, 29, 1, 30, {})


def test_alignment_insertion():
    a = align("TGXXXCTGAAAGCAGG", "TGCTGAAAGCAGG", Scoring(3, 2, 5, 1, front_clip=False))
    assert (a.score, a.target_end, a.source_end, a.longest_run, a.delta) == (32, 12, 15, 11, 3)
    assert {k: (x.insert, x.seq, x.src) for k, x in a.indels.items()} == {2: (True, "XXX", 2)}


@settings(max_examples=50, deadline=None)
@given(st.text("ACGT", min_size=1, max_size=20))
def test_identity(s):
    assert rc(rc(s)) == s
    assert align(s, s).mismatched == [] and align(s, s).indels == {}
    assert edit_distance(s, s)[0] == 0
    assert overlap_start(s, s) == 0 and near_places(s, s, 0) == [0]


SCORINGS = (Scoring(), Scoring(3, 2, 5, 1), Scoring(3, 2, 5, 1, front=False), Scoring(3, 4, 5, 1, front_clip=False), Scoring(ends=False), Scoring(3, 2, 5, 1, back_clip=True), Scoring(3, 2, 5, 1, compare=lambda a, b: 3 if a == b else 1.5 if "N" in (a, b) else -2))


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(range(len(SCORINGS))), st.lists(st.tuples(st.text("ACGN", min_size=1, max_size=14), st.text("ACGN", min_size=1, max_size=22), st.booleans()), max_size=12))
def test_many_alignments_are_single_ones(scoring, wanted):
    """Scores, ends, indels in order, mismatches and runs; strings of any sizes together, equal pairs among them."""
    s = SCORINGS[scoring]
    assert [(a, [*a.indels.items()]) for a in align_many(wanted + wanted[:2], s)] == [(a, [*a.indels.items()]) for a in (align(x, y, s, m) for x, y, m in wanted + wanted[:2])]


def test_many_long_alignments(monkeypatch):
    from ribostrand.functions import alignment

    monkeypatch.setattr(alignment, "MOST_CELLS", 20_000)
    rng = random.Random(4)
    some = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    wanted = []
    for k in range(60):
        t = some(rng.randrange(40, 90))
        a, b = sorted(rng.sample(range(len(t)), 2))
        wanted.append((t[a : a + 12] + some(rng.randrange(4)) + t[b : b + 15], t, k % 2 == 0))
    assert align_many(wanted, Scoring(3, 2, 5, 1)) == [align(x, y, Scoring(3, 2, 5, 1), m) for x, y, m in wanted]
    assert align_many([]) == []


def test_edit_distance():
    assert edit_distance("ACGT", "AGT")[0] == 1 and edit_distance("ACGT", "TCGA")[0] == 4
    assert edit_distance("AACC", "GAAC")[2] == 2


def test_columns(spark):
    df = spark.createDataFrame([("GATTNACA", "GATCACAA", "TCACAAGG")], "a string, b string, c string")
    r = df.select(
        S.reverse_complement("a").alias("rc"), S.mismatches("a", "b").alias("m"), S.mismatches("a", "b", 1).alias("one"), S.hamming("a", "b").alias("h"), S.find_with_overlap("c", "b").alias("o"),
        S.find_with_overlap(F.lit("TTT"), F.lit("ACA")).alias("none"), S.determinate("a").alias("d"), S.quality_at_least(F.lit("?<"), 28).alias("q"), S.handle(F.lit("AAAT"), ("RRRY", "YYYR")).alias("mask"),
        S.mismatches(F.lit(""), "b").alias("empty"), S.normal_target(F.lit("acgu")).alias("t"),
    ).first()
    assert (r.rc, r.m, r.one, r.h, r.o, r.none, r.d, r.q, r["mask"], r.empty, r.t) == ("TGTNAATC", [3, 4, 5, 6], [3], 4, 2, -1, False, False, "RRRY", [], "ACGT")


def test_sql_functions(spark):
    S.register(spark)
    assert spark.sql("SELECT reverse_complement('GATT') AS x").first().x == "AATC"
    assert spark.sql("SELECT match_errors('GATT', 'GACT') AS x").first().x == [2]
    assert [r.word for r in spark.sql("SELECT word FROM kmers('GATTA', 3) ORDER BY pos").collect()] == ["GAT", "ATT", "TTA"]
    assert spark.sql("SELECT align_score('GATTACA', 'GATTACA') AS x").first().x == 14


def test_options():
    assert RunConfig(count_mutations=True).resolve().allowed_target_errors == 1
    assert RunConfig(algorithm="lookup", allow_multiple_rt_starts=True).resolve().algorithm == "find_partial"
    assert RunConfig(single_target_linker="ACGTACGTAC").resolve().allow_multiple_rt_starts
    assert RunConfig.from_map(RunConfig(masks=("RRRY",), regions_of_interest=((1, 2),)).to_map()) == RunConfig(masks=("RRRY",), regions_of_interest=((1, 2),))
    for bad in ({"handle_indels": True}, {"mutations_require_quality_score": 50}, {"count_edge_mutations": "x"}, {"allowed_target_errors": 5}, {"algorithm": "x"}):
        with pytest.raises(ValueError):
            RunConfig(**bad).resolve()


def test_abif():
    import struct

    from ribostrand.sources.reads import parse_abif

    data = struct.pack(">6h", 1, 2, 3, -4, 5, 6)
    entry = struct.pack(">4sihhiii", b"DATA", 9, 4, 2, 6, 12, 128) + struct.pack(">i", 0)
    small = struct.pack(">4sihhii", b"LANE", 1, 4, 2, 1, 2) + struct.pack(">hh", 7, 0) + struct.pack(">i", 0)
    head = b"ABIF" + struct.pack(">h", 101) + struct.pack(">4sihhiii", b"tdir", 1, 1023, 28, 2, 56, 140)
    content = head.ljust(128, b"\0") + data + entry + small
    assert parse_abif(content) == {"DATA9": [1, 2, 3, -4, 5, 6], "LANE1": [7]}
    assert parse_abif(content, ["LANE1"]) == {"LANE1": [7]}


def test_places_with_errors(spark):
    """Against brute force, with nulls, empty and too long parts; compared as arrays, not by functions called for every base."""
    rng = random.Random(5)
    rows = [("".join(rng.choices("ACG", k=rng.randint(0, 6))), "".join(rng.choices("ACG", k=rng.randint(0, 30)))) for _ in range(400)] + [(None, "ACG"), ("ACG", None), ("", ""), ("", "AC"), ("ACGT", "ACG"), ("Aé", "xAéy")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, part string, whole string")
    for errors, most in ((0, 1), (1, 2), (2, 9)):
        found = df.select("id", S.find_with_errors("part", "whole", errors, most).alias("at"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "lambda" not in plan
        wanted = {i: [t for t in range(len(w) - len(p) + 1) if sum(a != b for a, b in zip(p, w[t:], strict=False)) <= errors][:most] if p is not None and w is not None else [] for i, (p, w) in enumerate(rows)}
        assert {r["id"]: r["at"] for r in found.collect()} == wanted
