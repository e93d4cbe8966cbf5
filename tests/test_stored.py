"""Stored SQLite runs, copies of unique pairs, result sets, FASTQ text and test cases of the command line."""

import json
import random
import sqlite3

from pyspark.sql import functions as F

from ribostrand import cli
from ribostrand.operators import pairs as P
from ribostrand.operators import results as Q
from ribostrand.sources import reads as S
from ribostrand.sources import stored


def test_sqlite_run(spark, tmp_path):
    path = f"{tmp_path}/run.sqlite"
    with sqlite3.connect(path) as db:
        for table, columns in stored.TABLES.items():
            if table != "counter":
                db.execute(f'CREATE TABLE "{table}" (' + ", ".join(f'"{c.rsplit(" ", 1)[0]}"' for c in columns.split(", ")) + ")")
        db.executemany("INSERT INTO pair VALUES (?, ?, ?)", [(f"ACG{i % 3}", "TTT", f"p{i}") for i in range(25)])
        db.execute("INSERT INTO unique_pair SELECT min(rowid), count(*) FROM pair GROUP BY r1")
        db.execute("INSERT INTO target VALUES ('five', 'ACGTACGT')")
        db.executemany("INSERT INTO result_set VALUES (?)", [("a",), ("b",)])
        db.executemany("INSERT INTO result VALUES (?, ?, ?, 'RRRY', ?, ?, -1, 1, ?, 0)", [(1, 1, 1, 3, 8, None), (1, 2, -1, -1, -1, "no match"), (2, 1, 1, 4, 8, None)])
        db.executemany("INSERT INTO tag VALUES (?)", [("match",), ("treated",)])
        db.executemany("INSERT INTO result_tag VALUES (?, ?, ?)", [(1, 1, 1), (1, 1, 2), (1, 2, 2)])
    assert stored.stored_targets(spark, path).collect() == [(1, "five", "ACGTACGT", 8)]
    assert stored.stored_pairs(spark, path).count() == 25 and stored.read_table(spark, path, "pair", rows=4).count() == 25
    assert sorted((r["pair_id"], r["multiplicity"]) for r in stored.stored_pairs(spark, path, unique=True).collect()) == [(1, 9), (2, 8), (3, 8)]
    rows = stored.stored_results(spark, path)
    assert sorted((r["set_name"], r["pair_id"], r["target_id"], r["site"], tuple(r["tags"])) for r in rows.collect()) == [("a", 1, 1, 3, ("match", "treated")), ("a", 2, None, -1, ("treated",)), ("b", 1, 1, 4, ())]
    assert stored.read_table(spark, path, "counter").count() == 0
    assert [sorted(map(str, stored.stored_results(spark, path, n).collect())) for n in "abc"] == [sorted(str(r) for r in rows.collect() if r["set_name"] == n) for n in "abc"]
    one, two = (stored.stored_results(spark, path, n) for n in "ab")
    assert [(r["pair_id"], r["kind"]) for r in Q.both_sides(one, two).collect()] == [(1, "different")]
    a, b = (rows.where(F.col("set_name") == n) for n in "ab")
    assert [(r["pair_id"], r["kind"]) for r in Q.both_sides(a, b).collect()] == [(1, "different")]
    assert [(r["pair_id"], r["kind"]) for r in Q.both_sides(b.withColumn("pair_id", F.lit(7)), a).orderBy("pair_id").collect()] == [(1, "only_b"), (7, "only_a")]


def test_result_sets_go(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2), (2, 3)], "pair_id long, site int")
    for name in ("a", "b"):
        Q.upsert_set(rows, f"{tmp_path}/sets", name)
    Q.delete_set(spark, f"{tmp_path}/sets", "a")
    assert {r["set_name"] for r in spark.read.parquet(f"{tmp_path}/sets").collect()} == {"b"}
    Q.wipe(spark, f"{tmp_path}/sets")
    assert not (tmp_path / "sets").exists()


def test_for_all_copies(spark):
    pairs = spark.createDataFrame([(1, "A", "B"), (2, "A", "B"), (3, "A", "C"), (4, "A", "B")], "pair_id long, r1 string, r2 string")
    results = P.unique_pairs(pairs).select("pair_id", F.concat("r1", "r2").alias("found"), "multiplicity")
    assert sorted(tuple(r) for r in P.for_all_copies(results, pairs).collect()) == [(1, "AB", 1), (2, "AB", 1), (3, "AC", 1), (4, "AB", 1)]


def test_fastq_text_by_ranges(spark, tmp_path):
    """Ranges may begin anywhere, qualities with @ or +."""
    rng = random.Random(1)
    rows = [(f"r{i}", "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 60)))) for i in range(300)]
    rows = [(n, s, "".join(rng.choice("@+IJ#") for _ in s)) for n, s in rows]
    path = f"{tmp_path}/x.fastq"
    with open(path, "w") as f:
        f.writelines(f"@{n} extra\n{s}\n+{n}\n{q}\n" for n, s, q in rows)
    for step in (2000, 1 << 20):
        assert sorted(tuple(r) for r in S.read_text_fastq(spark, path, step).collect()) == sorted(rows)
    heads = [h for at in range(0, 1000, 37) for h in S.Records(path, at, at + 37).take(100)[0]]
    assert heads == [f"@{n} extra" for n, _, _ in rows][: len(heads)]


def test_fastq_nomask(spark, tmp_path):
    for name, seq in (("a", "ACGT"), ("b", "TTTT")):
        (tmp_path / f"{name}.fastq").write_text("".join(f"@{k}\n{seq}\n+read{k}\nIIII\n" for k in (7, 3)))
    got = S.read_fastq(spark, f"{tmp_path}/a.fastq", f"{tmp_path}/b.fastq", nomask=True)
    assert sorted((r["pair_id"], r["identifier"], r["r1"], r["r2"]) for r in got.collect()) == [(3, "read3", "ACGT", "TTTT"), (7, "read7", "ACGT", "TTTT")]


def test_cases_of_the_command_line(spark, tmp_path, capsys):
    target = "ACGTTGCAACGATCGATTGCATGCCATGCAATCGGCTAATCG"
    (tmp_path / "t.fa").write_text(f">five\n{target}\n")
    rc = target[10:][::-1].translate(str.maketrans("ACGT", "TGCA"))
    r1, r2 = "AAAT" + rc[:24], target[10:38]
    for name, seq in (("1", r1), ("2", r2)):
        (tmp_path / f"{name}.fastq").write_text(f"@p\n{seq}\n+\n{'I' * len(seq)}\n")
    (tmp_path / "run.config").write_text("[run]\ntarget = t.fa\nr1 = 1.fastq\nr2 = 2.fastq\noutput = run\n")
    args = [f"{tmp_path}/run.config", "--cases", f"{tmp_path}/cases.json"]
    assert cli.main(["extract_case", *args], spark) == 0
    assert json.loads(capsys.readouterr().out)["expect"]["site"] == 10
    for _ in range(2):
        assert cli.main(["add_case", *args], spark) == 0
    cases = json.loads((tmp_path / "cases.json").read_text())
    assert len(cases) == 1 and cases[0]["r1"] == r1
    assert cli.main(["show_test_case", *args], spark) == 0 and "expected:" in capsys.readouterr().out
    assert cli.main(["show_test_case", *args, "--pair", "5"], spark) == 1
