"""Whole runs: from read files to stored results, counts and profiles, and what is asked of them later."""

from __future__ import annotations

import time
from dataclasses import dataclass, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RunConfig
from ..operators import classify as K
from ..operators import counters as C
from ..operators import profiles as R
from ..operators import results as Q
from ..operators.index import merge_targets
from ..operators.lookup import require_plain_keys
from ..sinks import exports as X


@dataclass
class Run:
    """One experiment: its options, targets, results and registered counts."""

    config: RunConfig
    targets: DataFrame
    results: DataFrame | None
    registered: DataFrame

    @classmethod
    def process(cls, pairs: DataFrame, targets: DataFrame, config: RunConfig) -> Run:
        config = config.resolve()
        pairs = pairs.limit(config.run_limit) if config.run_limit else pairs
        if config.algorithm == "lookup" and config.pair_length:
            require_plain_keys(targets, config, config.pair_length)
        if "forced_mask" in pairs.columns:
            # pairs without a known mask are read by their handles
            results = K.classify(pairs.where(~F.coalesce(F.col("forced_mask").isin(*config.masks), F.lit(False))), targets, config)
            for m in config.masks:
                results = results.unionByName(K.classify(pairs.where(F.col("forced_mask") == m), targets, replace(config, force_mask=m)))
        else:
            results = K.classify(pairs, targets, config)
        return cls(config, targets, results, C.registered(results))

    def profiles(self) -> DataFrame:
        return R.with_nucleotides(R.compute(self.registered, self.targets, self.config), self.targets)

    def store(self, path: str) -> None:
        """Parquet folders targets, results, registered, counters, config, and a line of the run log.

        Pairs are classified once: the pass that writes results counts them,
        and stops and mutations are registered from what was written.
        """
        spark, began = self.targets.sparkSession, time.time()
        self.targets.write.mode("overwrite").parquet(f"{path}/targets")
        registered, counts = self.registered, {}
        if self.results is not None:
            counts = C.write_counted(self.results, f"{path}/results", self.config)
            registered = C.registered(spark.read.schema(self.results.schema).parquet(f"{path}/results"))
        registered.write.mode("overwrite").parquet(f"{path}/registered")
        spark.createDataFrame(sorted(counts.items()), "name string, cnt long").coalesce(1).write.mode("overwrite").parquet(f"{path}/counters")
        spark.createDataFrame(list(self.config.to_map().items()), "param_key string, param_val string").coalesce(1).write.mode("overwrite").parquet(f"{path}/config")
        log_line(spark, path, "store", round(time.time() - began, 3), {k: counts[k] for k in ("total_pairs", "registered_pairs") if k in counts})

    @classmethod
    def load(cls, spark: SparkSession, path: str, results: bool = True) -> Run:
        config = RunConfig.from_map({r["param_key"]: r["param_val"] for r in spark.read.parquet(f"{path}/config").collect()})
        return cls(config, spark.read.parquet(f"{path}/targets"), spark.read.parquet(f"{path}/results") if results else None, spark.read.parquet(f"{path}/registered"))

    def merge(self, *others: Run) -> Run:
        """Counts of several runs together; targets without copies."""
        targets = self.targets
        for o in others:
            targets = merge_targets(targets, o.targets)
        return Run(self.config, targets, None, C.merged(self.registered, *[o.registered for o in others]))

    def validate(self, pairs: DataFrame) -> DataFrame:
        """Keys on which the other strategy counts differently."""
        other = replace(self.config, algorithm="lookup" if self.config.algorithm == "find_partial" else "find_partial")
        return C.differing(self.registered, Run.process(pairs, self.targets, other).registered)

    def rerun_tagged(self, pairs: DataFrame, tagged: DataFrame, tag: str, config: RunConfig) -> tuple[DataFrame, DataFrame]:
        """Classify the pairs of one tag again with other options: (results, their difference to the old ones)."""
        again = K.classify(pairs.join(tagged.where(F.array_contains("tags", tag)).select("pair_id"), "pair_id", "left_semi"), self.targets, config)
        return again, Q.differing(Q.stored_view(tagged, "old"), Q.stored_view(again, "new"))

    def dump(self, kind: str) -> DataFrame:
        """One of run, prefixes, mut_counts, indel_lens, reads, reactivities, old_txt, summary."""
        if kind == "run":
            return X.run_dump(self.profiles(), self.config)
        if kind == "reactivities":
            return X.reactivities(self.profiles())
        if kind == "old_txt":
            return X.old_text(self.profiles(), self.config)
        kinds = {"prefixes": lambda r: C.prefixes(r).orderBy("mask", F.desc("cnt"), "prefix"), "mut_counts": lambda r: C.mutation_histogram(r).orderBy("mutations"), "indel_lens": X.indel_lengths, "reads": X.reads_dump, "summary": lambda r: C.summary(C.named(r))}
        if kind not in kinds or self.results is None:
            raise ValueError(f"no dump {kind}")
        return kinds[kind](self.results)


def log_line(spark: SparkSession, path: str, command: str, seconds: float, facts: dict | None = None) -> None:
    """Adds a line to the log of a stored run: what was done, when, how long it took, and numbers."""
    row = (datetime.now(UTC).isoformat(timespec="seconds"), command, float(seconds), {k: str(v) for k, v in (facts or {}).items()})
    spark.createDataFrame([row], "at string, command string, seconds double, facts map<string, string>").coalesce(1).write.mode("append").json(f"{path}/log")


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """at, command, seconds, facts of everything that was done to a stored run, oldest first."""
    return spark.read.schema("at string, command string, seconds double, facts map<string, string>").json(f"{path}/log").orderBy("at")


def run_files(spark: SparkSession, targets: str, r1: str, r2: str, output: str, config: RunConfig = RunConfig()) -> Run:
    """FASTA and FASTQ in, reactivities out."""
    from ..sources.reads import read_fasta, read_fastq

    run = Run.process(read_fastq(spark, r1, r2), read_fasta(spark, targets), config)
    X.write_reactivities(run.profiles(), output)
    return run


PLOTS = {
    "single": {"counts": ["S_t", "S_u"], "rho": ["rho"], "beta": ["beta"], "theta": ["theta"], "muts": ["M_t", "M_u"], "muts_reactivity": ["beta", "mu", "r"]},
    "cotrans": {"counts": ["S_t", "S_u"], "c": ["c"], "treated": ["S_t"], "untreated": ["S_u"], "treated_muts": ["M_t"], "untreated_muts": ["M_u"], "rho": ["rho"], "beta": ["beta"], "theta": ["theta"], "r_mut": ["r"], "mu_mut": ["mu"], "beta_mut": ["beta"], "treated_mut": ["M_t"], "untreated_mut": ["M_u"]},
}


def plot_data(run: Run, kind: str) -> DataFrame:
    """The series that a plot of that kind shows: name, end, site and its columns."""
    columns = PLOTS["cotrans" if run.config.cotrans else "single"][kind]
    return run.profiles().select("name", "end", "site", *columns).orderBy("name", "end", "site")


def traces_to_json(spark: SparkSession, path: str, output: str, key: str) -> None:
    """Capillary traces as JSON, under a key."""
    from ..sources.reads import read_abif

    read_abif(spark, path).withColumn("key", F.lit(key)).write.mode("overwrite").json(output)
