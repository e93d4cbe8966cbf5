"""Command line: python -m ribostrand.cli COMMAND [CONFIG] [options]. Options come from an INI file."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys
import time
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import RunConfig, read_config
from .operators import classify as K
from .operators import tags as T
from .plans.runs import PLOTS, Run, log_line, plot_data, run_log, traces_to_json
from .sinks import exports as X
from .sources import reads as S

TEMPLATE = """[run]
target = target.fa
r1 = R1.fastq
r2 = R2.fastq
output = run
cotrans = False

[metadata]
name = experiment
"""


def _inputs(spark: SparkSession, path: str) -> tuple[RunConfig, dict[str, str], DataFrame, DataFrame]:
    config, inputs, _ = read_config(path)
    base = os.path.dirname(os.path.abspath(path))
    at = lambda names: ",".join(x if "://" in x or os.path.isabs(x) else os.path.join(base, x) for x in (n.strip() for n in names.split(",")))
    if "r1_plus" in inputs:
        pairs = S.read_channels(spark, (at(inputs["r1_plus"]), at(inputs["r2_plus"])), (at(inputs["r1_minus"]), at(inputs["r2_minus"])), config.masks[:2])
    else:
        pairs = S.read_fastq(spark, at(inputs["r1"]), at(inputs["r2"]))
    return config, inputs | {"output": at(inputs.get("output", "run"))}, pairs, S.read_fasta(spark, at(inputs["target"]))


def _judged(pairs: DataFrame, targets: DataFrame, config: RunConfig):
    return K.classify(pairs, targets, config).join(pairs.select("pair_id", "r1", "r2"), "pair_id").join(targets.select("target_id", "name", "seq"), "target_id", "left").first()


def _show(pairs: DataFrame, targets: DataFrame, config: RunConfig) -> None:
    """The diagram of one pair."""
    one = _judged(pairs, targets, config)
    if one is not None:
        print(X.diagram(one["r1"], one["r2"], one["seq"] or "", one["site"], one["end"]), one["failure"] or "")


def _case(pairs: DataFrame, targets: DataFrame, config: RunConfig) -> dict | None:
    """One pair as a test case: its reads and what is found now."""
    one = _judged(pairs, targets, config)
    if one is None:
        return None
    return {"pair_id": one["pair_id"], "r1": one["r1"], "r2": one["r2"], "expect": {k: one[k] for k in ("name", "site", "end", "mutations", "failure")}}


def _csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    commands = ("init", "run", "reads", "rerun", "validate", "compare", "dump", "plot", "pre", "handle_filter", "export_channels", "show", "extract_case", "add_case", "show_test_case", "matrix", "log", "doc")
    parser = argparse.ArgumentParser(prog="ribostrand", description=__doc__)
    parser.add_argument("command", choices=commands)
    parser.add_argument("config", nargs="?", default="run.config")
    parser.add_argument("--kind", default="run", help="dump or plot kind, matrix column")
    parser.add_argument("--tag", default="match_errors")
    parser.add_argument("--pair", type=int, default=0)
    parser.add_argument("--cases", default="cases.json", help="file of test cases")
    parser.add_argument("--out")
    a = parser.parse_args(argv)
    if a.command == "doc":
        print("\n".join(f"{f.name} = {f.default!r}" for f in fields(RunConfig)))
        print("plots:", ", ".join(PLOTS["single"]), "| cotrans:", ", ".join(PLOTS["cotrans"]))
        return 0
    if a.command == "init":
        if os.path.exists(a.config):
            print(f"{a.config} exists", file=sys.stderr)
            return 1
        with open(a.config, "w", encoding="utf-8") as f:
            f.write(TEMPLATE)
        return 0
    spark = spark or SparkSession.builder.appName("ribostrand").getOrCreate()
    if a.command == "pre":
        traces_to_json(spark, a.config, a.out or "pre.json", a.kind)
        return 0
    config, inputs, pairs, targets = _inputs(spark, a.config)
    out = a.out or inputs["output"]
    if a.command == "log":
        run_log(spark, out).show(1000, False)
        return 0
    began = time.time()
    code = _on_run(a, spark, config, pairs, targets, out)
    if a.command in ("reads", "rerun", "validate", "dump", "matrix", "plot"):
        log_line(spark, out, a.command, round(time.time() - began, 3), {"kind": a.kind})
    return code


def _on_run(a: argparse.Namespace, spark: SparkSession, config: RunConfig, pairs: DataFrame, targets: DataFrame, out: str) -> int:
    """The commands that need a run's inputs."""
    if a.command == "run":
        run = Run.process(pairs, targets, config)
        run.store(out)
        run = Run.load(spark, out)
        if config.generate_sam:
            X.write_sam(run.results, pairs, targets, f"{out}/sam")
        if config.generate_channel_reads:
            X.write_channels(pairs, f"{out}/channels", config, only=run.results)
        run.dump("summary").show(50, False)
    elif a.command == "reads":
        looser = RunConfig(**{f.name: getattr(config, f.name) for f in fields(RunConfig)} | {"allow_indeterminate": True, "allowed_target_errors": max(2, config.allowed_target_errors), "allowed_adapter_errors": max(2, config.allowed_adapter_errors)})
        T.assign(K.classify(pairs, targets, looser), pairs, targets, looser).write.mode("overwrite").parquet(f"{out}/tagged")
        X.reads_dump(spark.read.parquet(f"{out}/tagged")).show(100, False)
    elif a.command == "rerun":
        again, diff = Run.load(spark, out).rerun_tagged(pairs, spark.read.parquet(f"{out}/tagged"), a.tag, config)
        again.write.mode("overwrite").parquet(f"{out}/rerun-{a.tag}")
        diff.show(100, False)
    elif a.command == "validate":
        bad = Run.load(spark, out).validate(pairs)
        bad.show(100, False)
        return int(not bad.isEmpty())
    elif a.command == "compare":
        K.compare(K.classify(pairs, targets, config), K.STRATEGIES["lookup"](pairs, targets, config)).show(100, False)
    elif a.command == "dump":
        run = Run.load(spark, out)
        if a.kind == "reads":
            run.results = spark.read.parquet(f"{out}/tagged")
        _csv(run.dump(a.kind), f"{out}/dump-{a.kind}")
    elif a.command == "matrix":
        _csv(X.matrix_rows(Run.load(spark, out).profiles(), a.kind if a.kind != "run" else "beta"), f"{out}/matrix")
    elif a.command == "plot":
        _csv(plot_data(Run.load(spark, out), a.kind if a.kind != "run" else "beta"), f"{out}/plot-{a.kind}")
    elif a.command in ("handle_filter", "export_channels"):
        shutil.rmtree(f"{out}/channels", ignore_errors=True)
        X.write_channels(pairs, f"{out}/channels", config, compress=a.command == "export_channels")
        if a.command == "export_channels":
            _csv(X.input_sheet(spark, config.masks, f"{out}/channels"), f"{out}/sheet")
    elif a.command == "show":
        _show(pairs.where(F.col("pair_id") == a.pair), targets, config)
    elif a.command in ("extract_case", "add_case"):
        case = _case(pairs.where(F.col("pair_id") == a.pair), targets, config)
        if case is None:
            print(f"no pair {a.pair}", file=sys.stderr)
            return 1
        if a.command == "extract_case":
            print(json.dumps(case, indent=1))
        else:
            with open(a.cases, "w" if not os.path.exists(a.cases) else "r+", encoding="utf-8") as f:
                cases = [c for c in (json.load(f) if f.mode == "r+" else []) if c["pair_id"] != a.pair]
                f.seek(0)
                f.truncate()
                json.dump([*cases, case], f, indent=1)
    elif a.command == "show_test_case":
        with open(a.cases, encoding="utf-8") as f:
            case = next((c for c in json.load(f) if c["pair_id"] == a.pair), None)
        if case is None:
            print(f"no case {a.pair}", file=sys.stderr)
            return 1
        _show(spark.createDataFrame([(case["pair_id"], case["r1"], case["r2"])], "pair_id long, r1 string, r2 string"), targets, config)
        print("expected:", json.dumps(case["expect"]))
    return 0


if __name__ == "__main__":
    sys.exit(main())
