"""Counters that are observed while results are written, against those of the results."""

import pytest

from ribostrand.config import RunConfig
from ribostrand.operators import classify as K
from ribostrand.operators import counters as C
from ribostrand.plans import testbed as B

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("options", "make", "jobs"), [
    ({"count_mutations": True}, B.pairs, 1), ({"algorithm": "lookup", "pair_length": 36}, B.pairs, 1), ({"count_left_prefixes": True, "collapse_left_prefixes": True}, B.prefixed_pairs, None),
    ({"count_mutations": True, "handle_indels": True, "allowed_target_errors": 2}, B.indel_pairs, None),
])
def test_write_counted(spark, tmp_path, options, make, jobs):
    config, path = RunConfig(**options).resolve(), f"{tmp_path}/results"
    results = K.classify(make(spark, SF), B.targets(spark, SF), config)
    plain = f"{tmp_path}/plain"
    results.write.parquet(plain)
    stored = spark.read.schema(results.schema).parquet(plain)
    spark.sparkContext.setJobGroup(path, "write_counted")
    got = C.write_counted(stored, path, config)
    ran = len(spark.sparkContext.statusTracker().getJobIdsForGroup(path))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {r["name"]: r["cnt"] for r in C.named(stored).collect()}
    assert jobs is None or ran == jobs
    assert sorted(map(str, spark.read.parquet(path).select("pair_id", "site", "failure").collect())) == sorted(map(str, stored.select("pair_id", "site", "failure").collect()))


def test_nothing_written(spark, tmp_path):
    results = K.classify(B.pairs(spark, SF).limit(0), B.targets(spark, SF), RunConfig())
    assert C.write_counted(results, f"{tmp_path}/none", RunConfig()) == {}


def test_stored_run(spark, tmp_path):
    """One classification; counters, stops and log of what was stored."""
    from pyspark.sql import functions as F

    from ribostrand.plans.runs import Run, log_line, run_log

    path, calls = f"{tmp_path}/run", spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(n):
        calls.add(1)
        return n

    config = RunConfig(count_mutations=True)
    pairs = B.pairs(spark, SF).withColumn("multiplicity", seen("multiplicity"))
    run = Run.process(pairs, B.targets(spark, SF), config)
    run.store(path)
    assert calls.value == 1000
    again = Run.load(spark, path)
    assert {r["name"]: r["cnt"] for r in spark.read.parquet(f"{path}/counters").collect()} == {r["name"]: r["cnt"] for r in C.named(again.results).collect()}
    assert sorted(map(tuple, again.registered.collect())) == sorted(map(tuple, C.registered(again.results).collect())) and again.registered.count() > 0
    log_line(spark, path, "dump", 0.5, {"kind": "run"})
    first, second = run_log(spark, path).collect()
    assert {first["command"], second["command"]} == {"store", "dump"} and (first["facts"] | second["facts"])["total_pairs"] == "1000"


def test_command_line_run(spark, tmp_path, capsys):
    """FASTQ and FASTA in, a stored run with SAM, channels and a log out."""
    from ribostrand import cli
    from ribostrand.sinks import shards

    target = "ACGTTGCAACGATCGATTGCATGCCATGCAATCGGCTAATCG"
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    (tmp_path / "t.fa").write_text(f">five\n{target}\n")
    for name, of in (("1", lambda k: ("AAAT", "CCCG")[k % 2] + rc(target[k:])[:24]), ("2", lambda k: target[k : k + 28])):
        (tmp_path / f"{name}.fastq").write_text("".join(f"@p{k}\n{of(k)}\n+\n{'I' * len(of(k))}\n" for k in range(12)))
    (tmp_path / "run.config").write_text(f"[run]\ntarget = t.fa\nr1 = 1.fastq\nr2 = 2.fastq\noutput = {tmp_path}/run\ngenerate_sam = yes\ngenerate_channel_reads = True\n")
    config = f"{tmp_path}/run.config"
    assert cli.main(["run", config], spark) == 0
    assert "registered_pairs" in capsys.readouterr().out
    assert sum(s["rows"] for s in shards.read_manifest(f"{tmp_path}/run/channels")) == 12
    assert shards.read_shards(spark, f"{tmp_path}/run/sam", "sam").count() == 27
    assert cli.main(["dump", config, "--kind", "run"], spark) == 0
    assert cli.main(["log", config], spark) == 0
    shown = capsys.readouterr().out
    assert "store" in shown and "dump" in shown
