"""Read files as DataFrames: FASTQ pairs, FASTA, SAM, ABIF traces, tables.

``FastqPairs`` is a Spark data source (format ``fastq_pairs``) whose tasks read R1
and R2 in step. ``read_fastq`` splits large pairs of plain or block gzip files by
record number (``ranges``); other gzip files are a task for each pair.
``FastqText`` (``fastq_text``) reads single files by byte ranges. Paths are opened
through pyarrow's file systems, so shared stores work where executors reach them.
"""

from __future__ import annotations

import gzip
import io
import json
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .ranges import BATCH, SPLIT_BYTES, Records, estimated_records, file_size, granules, is_splittable, located, lockstep

FASTQ = "pair_id long, identifier string, r1 string, r2 string, r1_qual string, r2_qual string, multiplicity long, channel string"
FASTQ_NAMES = [x.split()[0] for x in FASTQ.split(", ")]


def open_text(path: str) -> io.TextIOBase:
    system, name = located(path)
    raw = system.open_input_stream(name, compression=None)
    return io.TextIOWrapper(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw, encoding="ascii", errors="replace")


def first_words(heads: list[str]) -> list[str]:
    return [h.split()[0].removeprefix("@") for h in heads]


def paths_of(value: str) -> list[str]:
    return [x.strip() for x in value.split(",") if x.strip()]


class FilePair(InputPartition):
    """n records (None: all) of a file pair from number first on; R1 is read from start1, R2 from start2 without its next skip2 records."""

    def __init__(self, number: int, r1: str, r2: str, channel: str | None, first: int = 0, n: int | None = None, start1: int = 0, start2: int = 0, skip2: int = 0):
        self.number, self.r1, self.r2, self.channel = number, r1, r2, channel
        self.first, self.n, self.start1, self.start2, self.skip2 = first, n, start1, start2, skip2


def file_pairs(options: dict) -> list[FilePair]:
    out: list[FilePair] = []
    for suffix, channel in (("", None), ("_plus", "treated"), ("_minus", "untreated")):
        firsts, seconds = (paths_of(options.get(f"{r}{suffix}", "")) for r in ("r1", "r2"))
        if len(firsts) != len(seconds):
            raise ValueError("as many R2 files as R1 files are needed")
        out += [FilePair(len(out) + i, a, b, channel) for i, (a, b) in enumerate(zip(firsts, seconds, strict=True))]
    return out


class FastqReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[FilePair]:
        pairs, out = file_pairs(self.options), []
        plan = json.loads(self.options.get("plan", "{}"))
        for p in pairs:
            tasks = plan.get(str(p.number))
            out += [p] if tasks is None else [FilePair(p.number, p.r1, p.r2, p.channel, *t) for t in tasks]
        return out

    def read(self, part: FilePair | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no partitions
            return
        on = lambda name, default: self.options.get(name, default) == "true"
        nomask, quality = on("nomask", "false"), on("quality", "true")
        strict, done, left = on("strict", "false") or nomask, part.first, part.n
        a, b = Records(part.r1, part.start1), Records(part.r2, part.start2)
        b.skip(part.skip2)
        while left is None or left > 0:
            most = BATCH if left is None else min(BATCH, left)
            x, y = a.take(most), b.take(most)
            n = min(len(x[0]), len(y[0]))
            if not n:
                return
            names = [(first_words(heads[:n]), [p[1:] for p in plus[:n]]) for heads, _, plus, _ in (x, y)]
            for k in range(n if strict else int(not done)):
                mine, other = ((w[0][k], w[1][k]) if nomask else w[0][k] for w in names)
                if mine != other:
                    raise ValueError(f"record {done + k} of {part.r1} is {mine}, that of {part.r2} is {other}")
            ids = [int(i) for i in names[0][0]] if nomask else range((part.number << 40) + done, (part.number << 40) + done + n)
            columns = [ids, names[0][int(nomask)], x[1][:n], y[1][:n], x[3][:n] if quality else [None] * n, y[3][:n] if quality else [None] * n, [1] * n, [part.channel] * n]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string()], strict=True)], names=FASTQ_NAMES)
            done, left = done + n, None if left is None else left - n


class FastqPairs(DataSource):
    """Options: plan (see split_plan); r1, r2 (comma-separated files), or r1_plus/r2_plus and r1_minus/r2_minus by channel; strict (compare identifiers of all records, not only the first), quality; nomask (heads are numbers, which become pair_id, and the identifier stands on the + line; both must agree)."""

    @classmethod
    def name(cls) -> str:
        return "fastq_pairs"

    def schema(self) -> str:
        return FASTQ

    def reader(self, schema) -> FastqReader:
        return FastqReader(dict(self.options))


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int | None):
        self.path, self.start, self.end = path, start, end


class FastqText(DataSource):
    """Options: path (comma-separated files), split_bytes. Plain and block gzip files are read by byte ranges, other gzip files by one task each."""

    @classmethod
    def name(cls) -> str:
        return "fastq_text"

    def schema(self) -> str:
        return "identifier string, seq string, quality string"

    def reader(self, schema) -> FastqTextReader:
        return FastqTextReader(dict(self.options))


class FastqTextReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Range]:
        step, out = int(self.options.get("split_bytes", SPLIT_BYTES)), []
        for path in paths_of(self.options["path"]):
            out += [Range(path, at, at + step) for at in range(0, file_size(path), step)] if is_splittable(path) else [Range(path, 0, None)]
        return out

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no partitions
            return
        own = Records(part.path, part.start, part.end)
        while (block := own.take(BATCH))[0]:
            heads, seqs, _, qualities = block
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (first_words(heads), seqs, qualities)], names=["identifier", "seq", "quality"])


def split_plan(spark: SparkSession, options: dict, split_bytes: int = SPLIT_BYTES, granule_bytes: int | None = None) -> dict[str, list]:
    """Tasks (first, n, start1, start2, skip2) by file pair, of the pairs that can be split and are larger than a task.

    Runs the job that counts records; the driver gets a row for each task.
    """
    large = [p for p in file_pairs(options) if file_size(p.r1) > split_bytes and is_splittable(p.r1) and is_splittable(p.r2)]
    if not large:
        return {}
    size = granule_bytes or min(split_bytes, max(1 << 20, split_bytes // 16))
    counted = granules(spark, [(p.number, side, path) for p in large for side, path in ((1, p.r1), (2, p.r2))], size).persist(StorageLevel.MEMORY_AND_DISK)
    plan: dict[str, list] = {str(p.number): [] for p in large}
    for t in lockstep(counted, split_bytes).collect():
        plan[str(t["pair"])].append([t["first"], t["n"], t["start1"], t["start2"], t["skip2"]])
    counted.unpersist()
    return plan


def _load(spark: SparkSession, options: dict, split_bytes: int) -> DataFrame:
    spark.dataSource.register(FastqPairs)
    return spark.read.format("fastq_pairs").options(**options, plan=json.dumps(split_plan(spark, options, split_bytes))).load()


def read_fastq(spark: SparkSession, r1: str | list[str], r2: str | list[str], strict: bool = False, quality: bool = True, partitions: int = 0, nomask: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Pairs of one or several file pairs, a task for about split_bytes of each R1; partitions spreads what gzip files that cannot be split hold; nomask: see FastqPairs."""
    joined = [",".join(x) if isinstance(x, list) else x for x in (r1, r2)]
    out = _load(spark, {"r1": joined[0], "r2": joined[1], "strict": str(strict).lower(), "quality": str(quality).lower(), "nomask": str(nomask).lower()}, split_bytes)
    return out.repartition(partitions) if partitions else out


def read_channels(spark: SparkSession, plus: tuple[str, str], minus: tuple[str, str], masks: tuple[str, str] = ("RRRY", "YYYR"), split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Pairs whose channel is known by file: adds forced_mask."""
    out = _load(spark, {"r1_plus": plus[0], "r2_plus": plus[1], "r1_minus": minus[0], "r2_minus": minus[1]}, split_bytes)
    return out.withColumn("forced_mask", F.when(F.col("channel") == "treated", masks[0]).when(F.col("channel") == "untreated", masks[1]))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """target_id (from 1), name, seq, n; sequences may run over several lines, U becomes T."""
    rows: list[list[str]] = []
    with open_text(path) as f:
        for line in map(str.strip, f):
            if line.startswith(">"):
                rows.append([line[1:].strip(), ""])
            elif line:
                rows[-1][1] += line.upper().replace("U", "T")
    return spark.createDataFrame([(i + 1, n, s, len(s)) for i, (n, s) in enumerate(rows)], "target_id int, name string, seq string, n int")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual, length (of the first M of the CIGAR)."""
    names = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
    numbers = {"flag", "pos", "mapq", "pnext", "tlen"}
    lines = spark.read.text(path).where(~F.col("value").startswith("@") & (F.length("value") > 0)).withColumn("f", F.split("value", "\t"))
    out = lines.select(*[(F.try_element_at("f", F.lit(i + 1)).try_cast("int") if n in numbers else F.try_element_at("f", F.lit(i + 1))).alias(n) for i, n in enumerate(names)])
    return out.withColumn("length", F.regexp_extract("cigar", r"(\d+)M", 1).try_cast("int"))


def sam_pairs(sam: DataFrame, targets: DataFrame, cotrans: bool = False) -> DataFrame:
    """qname, target, site, end of properly mapped pairs; unless cotrans, only those that reach the target's end."""
    mapped = sam.where(F.col("flag").bitwiseAND(4) == 0).groupBy("qname", "rname").agg(F.min(F.col("pos") - 1).alias("site"), F.max(F.col("pos") - 1 + F.col("length")).alias("end"), F.count(F.lit(1)).alias("reads"))
    both = mapped.where("reads = 2").join(targets.select(F.col("name").alias("rname"), F.length("seq").alias("n")), "rname")
    return (both if cotrans else both.where("`end` = n")).select("qname", F.col("rname").alias("target"), "site", "end")


REACTIVITIES = "sequence string, rt_start int, five_prime_offset int, nucleotide string, treated_mods long, untreated_mods long, beta double, theta double, c double"


def read_reactivities(spark: SparkSession, path: str) -> DataFrame:
    """Typed rows of a reactivity table; beta and theta are null where it has a dash."""
    return spark.read.csv(path, schema=REACTIVITIES, sep="\t", header=True, nullValue="-")


def read_text_fastq(spark: SparkSession, path: str | list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """identifier, seq, quality of FASTQ text; a task for each split_bytes of a plain file."""
    spark.dataSource.register(FastqText)
    return spark.read.format("fastq_text").options(path=",".join(path) if isinstance(path, list) else path, split_bytes=str(split_bytes)).load()


# Element sizes of the ABIF directory's number types.
ABIF_FORMATS = {1: "B", 2: "c", 3: "H", 4: "h", 5: "i", 7: "f", 8: "d"}


def parse_abif(content: bytes, fields: list[str] | None = None) -> dict[str, list[int]]:
    """Integer arrays by tag name and number (such as DATA9) of a capillary trace file; big-endian directory of 28-byte entries."""
    if content[:4] != b"ABIF":
        raise ValueError("not an ABIF file")
    _, _, _, _, count, _, start = struct.unpack(">4sihhiii", content[6:30])
    out: dict[str, list[int]] = {}
    for k in range(count):
        entry = content[start + 28 * k : start + 28 * (k + 1)]
        tag, number, kind, width, n, size = struct.unpack(">4sihhii", entry[:20])
        name = f"{tag.decode('ascii', 'replace')}{number}"
        if (fields and name not in fields) or kind not in ABIF_FORMATS:
            continue
        raw = entry[20 : 20 + size] if size <= 4 else content[(at := struct.unpack(">i", entry[20:24])[0]) : at + size]
        values = struct.unpack(f">{n}{ABIF_FORMATS[kind]}", raw[: n * struct.calcsize(ABIF_FORMATS[kind])])
        out[name] = [v[0] if isinstance(v, bytes) else int(v) for v in values]
    return out


def read_abif(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    """path, traces (map of integer arrays)."""
    @F.pandas_udf("map<string, array<int>>")
    def parse(content: pd.Series) -> pd.Series:
        return content.map(lambda c: parse_abif(bytes(c), fields))

    return spark.read.format("binaryFile").load(path).select("path", parse("content").alias("traces"))


def preseq(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def estimated_pairs(path: str) -> int:
    """About how many records a FASTQ file has, plain or gzip."""
    return estimated_records(path)
