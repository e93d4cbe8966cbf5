"""The golden profile from reads to numbers, and identities between operators."""

import csv
import io

import pytest

from ribostrand.config import RunConfig, read_config
from ribostrand.operators import counters as C
from ribostrand.operators import pairs as P
from ribostrand.plans.runs import Run

GOLDEN = RunConfig(allow_negative_values=True, count_mutations=True, count_edge_mutations="stop_and_mut", allowed_target_errors=4, mutations_require_quality_score=30, allow_multiple_rt_starts=True)


@pytest.fixture(scope="module")
def files(tmp_path_factory, cases):
    base = tmp_path_factory.mktemp("reads")
    (base / "R1.fastq").write_text(cases["profile"]["r1"])
    (base / "R2.fastq").write_text(cases["profile"]["r2"])
    ((name, seq),) = cases["targets"]["profile"]
    (base / "target.fa").write_text(f">{name}\n{seq[:10].lower()}\n{seq[10:]}\n")
    return base


@pytest.fixture(scope="module")
def run(spark, files):
    from ribostrand.sources.reads import read_fasta, read_fastq

    return Run.process(read_fastq(spark, str(files / "R1.fastq"), str(files / "R2.fastq")), read_fasta(spark, str(files / "target.fa")), GOLDEN)


def test_golden(run, cases):
    wanted = list(csv.DictReader(io.StringIO(cases["profile"]["csv"])))
    got = [r.asDict() for r in run.dump("run").collect()]
    assert len(got) == len(wanted) == 33
    for g, w in zip(got, wanted, strict=True):
        assert [str(g[c]) for c in ("L", "site", "nt", "f+", "f-", "mut+", "mut-")] == [w[c] for c in ("L", "site", "nt", "f+", "f-", "mut+", "mut-")]
        for c in ("beta", "mu", "r", "c thresh", "c"):
            assert float(g[c]) == pytest.approx(float(w[c]), abs=1e-9)


def test_store_load_merge(spark, run, tmp_path):
    run.store(str(tmp_path / "run"))
    again = Run.load(spark, str(tmp_path / "run"))
    assert again.config == run.config
    assert C.differing(run.registered, again.registered).isEmpty()
    twice = run.merge(again)
    assert twice.targets.count() == 1
    assert C.target_totals(twice.registered).first()["cnt"] == 28


def test_totals(run):
    named = {r["name"]: r["cnt"] for r in C.named(run.results).collect()}
    assert named["total_pairs"] == named["registered_pairs"] == 14
    assert C.target_totals(run.registered).first()["cnt"] == 14
    assert named["low_quality_muts"] == 1


def test_dedupe_changes_nothing(spark, cases):
    from ribostrand.functions.reads import Target

    rows = [(i, x[1], x[2]) for i, x in enumerate(cases["pairs"]["cases"] * 2)]
    pairs = spark.createDataFrame(rows, "pair_id long, r1 string, r2 string")
    ((n, s),) = cases["targets"]["5s"]
    t = spark.createDataFrame([(1, n, s)], "target_id int, name string, seq string")
    assert isinstance(Target(1, n, s).n, int)
    plain, unique = (Run.process(pairs, t, RunConfig(skip_database=k)) for k in (True, False))
    assert P.unique_pairs(pairs).count() < pairs.count()
    assert C.differing(plain.registered, unique.registered).isEmpty()


def test_command_line(spark, files, capsys):
    from ribostrand.cli import main

    config = files / "run.config"
    config.write_text("[run]\ntarget = target.fa\nr1 = R1.fastq\nr2 = R2.fastq\noutput = out\ncount_mutations = True\nallowed_target_errors = 4\nallow_multiple_rt_starts = True\n[metadata]\nname = x\n")
    options, inputs, metadata = read_config(str(config))
    assert options.count_mutations and inputs["r1"] == "R1.fastq" and metadata == {"name": "x"}
    assert main(["run", str(config)], spark) == 0
    for kind in ("run", "prefixes", "mut_counts", "reactivities", "summary"):
        assert main(["dump", str(config), "--kind", kind], spark) == 0
    assert main(["matrix", str(config)], spark) == 0 and main(["plot", str(config), "--kind", "beta"], spark) == 0
    assert main(["reads", str(config)], spark) == 0
    assert main(["handle_filter", str(config)], spark) == 0
    assert main(["show", str(config), "--pair", "0"], spark) == 0
    assert main(["doc"]) == 0
    assert "registered_pairs" in capsys.readouterr().out


def test_stream_equals_batch(spark, run, files, tmp_path):
    from ribostrand.schema import PAIR
    from ribostrand.sources.reads import read_fastq
    from ribostrand.streaming import incremental

    pairs = read_fastq(spark, str(files / "R1.fastq"), str(files / "R2.fastq"))
    names = [f.split()[0] for f in PAIR.split(", ")]
    pairs.select(*names).repartition(3).write.parquet(str(tmp_path / "in"))
    incremental.start(spark, str(tmp_path / "in"), run.targets, str(tmp_path / "out"), str(tmp_path / "ck"), GOLDEN, 1).awaitTermination(120)
    assert C.differing(run.registered, incremental.totals(spark, str(tmp_path / "out"))).isEmpty()
