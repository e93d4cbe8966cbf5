"""Tables that are written and read back, older layouts, traces, tags by plugin, reruns of a tag."""

import json
import struct

from pyspark.sql import functions as F

from ribostrand.config import RunConfig
from ribostrand.operators import classify as K
from ribostrand.operators import profiles as R
from ribostrand.operators import tags as T
from ribostrand.plans import runs
from ribostrand.plans import testbed as B
from ribostrand.sinks import exports as X
from ribostrand.sources import reads as S

SF = "/root/testdata/sf0.001"


def profile(spark):
    targets = B.stop_targets(spark)
    return R.with_nucleotides(R.compute(B.stops(spark, SF), targets, RunConfig(allow_multiple_rt_starts=True)), targets)


def test_reactivities_come_back(spark, tmp_path):
    wanted = profile(spark)
    X.write_reactivities(wanted, f"{tmp_path}/r")
    back = S.read_reactivities(spark, f"{tmp_path}/r")
    rows = {(r["sequence"], r["rt_start"], r["five_prime_offset"]): r for r in back.collect()}
    assert len(rows) == wanted.count() and back.schema["theta"].dataType.simpleString() == "double"
    for w in wanted.collect():
        r = rows[w["name"], w["end"], w["site"]]
        assert (r["nucleotide"], r["treated_mods"], r["untreated_mods"]) == (w["nt"], w["S_t"], w["S_u"])
        assert r["beta"] is None if w["site"] == 0 else abs(r["beta"] - w["beta"]) < 1e-9


def test_older_layout(spark):
    single = X.old_text(profile(spark), RunConfig()).collect()
    assert {r["rt_start"] for r in single} == {23} and max(r["five_prime_offset"] for r in single) == 23
    config = RunConfig(cotrans=True)
    rows = X.old_text(profile(spark), config).where("name = 'S1'").collect()
    linker = config.cotrans_linker[:-2]
    tail = [r["nucleotide"] for r in rows if r["five_prime_offset"] > 24]
    assert "".join(tail) == linker and {r["rt_start"] for r in rows} == {24 + len(linker) + 1}


def test_traces(spark, tmp_path):
    data = struct.pack(">3h", 4, 5, 6)
    entry = struct.pack(">4sihhiii", b"DATA", 1, 4, 2, 3, 6, 128) + struct.pack(">i", 0)
    head = b"ABIF" + struct.pack(">h", 101) + struct.pack(">4sihhiii", b"tdir", 1, 1023, 28, 1, 28, 134)
    (tmp_path / "t.ab1").write_bytes(head.ljust(128, b"\0") + data + entry)
    runs.traces_to_json(spark, f"{tmp_path}/t.ab1", f"{tmp_path}/out", "treated")
    (row,) = S.preseq(spark, f"{tmp_path}/out").collect()
    assert row["key"] == "treated" and row["traces"]["DATA1"] == [4, 5, 6]


def test_tags(spark):
    """A plugin's tag, targets of any number and their reverse complements, what no target covers."""
    seq = "ACGTTGCAACGATCGATTGCATGCCATGCAATCGGCTAATCGTTACGCA"
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    targets = spark.createDataFrame([(1, "one", "T" * 40), (1_000_001, "far", seq)], "target_id int, name string, seq string")
    pairs = spark.createDataFrame([(1, "p1", "AAAT" + rc(seq)[:30], seq[10:40]), (2, "p2", "AAAT" + seq[:30], rc(seq)[:20] + "CCCCC"), (3, "p3", "CCCGGAGAGAGAGAGAGGAGA", "GGGAGGGAGGGAGGG")], "pair_id long, identifier string, r1 string, r2 string")
    results = K.classify(pairs, targets, RunConfig())
    tagged = T.assign(results, pairs, targets, plugins={"starts_g": lambda rows: F.col("r2").startswith("G")})
    by = {r["pair_id"]: set(r["tags"]) for r in tagged.collect()}
    assert {"match", "far", "treated"} <= by[1] and {"far", "far_rc", "no match"} <= by[2] and "one" not in by[2] and {"unknown", "starts_g", "untreated"} <= by[3]
    every = T.tag_targets(targets, RunConfig(extra_tags=(("extra", "ACGTACGTAC"),)))
    ids = [r["target_id"] for r in every.collect()]
    assert len(set(ids)) == len(ids) == 4 + 6
    found = T.spans(pairs, T.tag_targets(targets))
    best = {(r["pair_id"], r["read"], r["name"]): (r["start"], r["length"]) for r in T.best_spans(found).collect()}
    assert best[1, "r2", "far"] == (0, 30) and best[2, "r2", "far_rc"] == (0, 20)
    free = {(r["pair_id"], r["read"]): r["longest"] for r in T.longest_unmatched(found.where("length >= 20"), pairs).collect()}
    assert free[2, "r2"] == 5 and free[3, "r1"] == 21 and free[1, "r2"] == 0


def test_a_tag_is_run_again(spark, tmp_path):
    """Pairs with one changed base fail under the plain options and match when errors are allowed."""
    pairs, targets = B.pairs(spark, SF), B.targets(spark, SF)
    run = runs.Run.process(pairs, targets, RunConfig())
    tagged = T.assign(run.results, pairs, targets)
    again, moved = run.rerun_tagged(pairs, tagged, "match errors failure", RunConfig(count_mutations=True))
    asked = tagged.where("failure = 'match errors failure'").count()
    good = again.where("site IS NOT NULL").count()
    assert again.count() == asked > 0 and moved.count() == good > 0


def test_diagram():
    text = X.diagram("AAATCC", "ACGA", "ACGTGG", 0, 6)
    assert "ACGa" in text and json.dumps(text)
    assert "(no site)" in X.diagram("A", "C", "G", None, None)


def test_equal_reads_are_searched_once(spark):
    """Names by distinct pair of reads, of both reads together; nothing for reads that show none."""
    targets = spark.createDataFrame([(1, "one", "ACGTTGCAACGATCG"), (2, "two", "GGATTACAGGATCCA")], "target_id int, name string, seq string")
    rows = [("ACGTTGCAA", "GGATTACAG"), ("ACGTTGCAA", "CCCCCCCCC"), ("CCCCCCCCC", "GAGAGAGAG"), ("AC", "GGATTACAG")]
    pairs = spark.createDataFrame([(i, *rows[i % 4]) for i in range(40)], "pair_id long, r1 string, r2 string")
    found = T.names_found(pairs, targets).collect()
    assert sorted((r["r1"], r["r2"], r["_found"]) for r in found) == [("AC", "GGATTACAG", ["two"]), ("ACGTTGCAA", "CCCCCCCCC", ["one"]), ("ACGTTGCAA", "GGATTACAG", ["one", "two"])]
