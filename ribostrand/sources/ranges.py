"""Records of FASTQ files by byte range, and pairs of files that many tasks read in step.

The records of R1 and R2 with one number stand at different bytes, so a file
pair is split by record number. A first job counts the records of small ranges
(granules) of both files; sums of the counts give each granule its first number.
A task is a run of R1's granules; where its first record stands in R2 is told by
R2's granules, in a window over both (an as-of join by record number). The plan
has a row for each task; a file has at most MOST_GRANULES granules, however large.

A range owns the records that begin after its first byte and up to the first
byte of the next range (the first range owns byte 0, too), so that a range of
block gzip, which cannot see the byte before it, can do the same as one of plain
text: it leaves out the line in which it begins, and reads on to the end of the
record it began. A record begins at a line with @ of which the second next
begins with +; a quality line may begin with @, but no sequence with +.

Plain files are split at any byte, block gzip (members that state their size) at
members. Other gzip files are streams that only one task can read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Records in an Arrow batch, bytes of a read, bytes of a task, and of a range whose records are counted.
BATCH = 8192
CHUNK = 1 << 20
SPLIT_BYTES = 64 << 20
GRANULE_BYTES = 4 << 20
MOST_GRANULES = 4096
MEMBER_BYTES = 1 << 16


def located(path: str):
    """(file system, name in it) of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def file_size(path: str) -> int:
    system, name = located(path)
    return system.get_file_info(name).size


def member_size(raw: bytes) -> int:
    """The size of a member of block gzip that begins here, 0 if none does: the extra field BC of its header says it."""
    if len(raw) < 18 or raw[:4] != b"\x1f\x8b\x08\x04":
        return 0
    extra = raw[12 : 12 + struct.unpack("<H", raw[10:12])[0]]
    while len(extra) >= 4:
        n = struct.unpack("<H", extra[2:4])[0]
        if extra[:2] == b"BC" and n == 2 and len(extra) >= 6:
            return struct.unpack("<H", extra[4:6])[0] + 1
        extra = extra[4 + n :]
    return 0


#: Text of a member that is written here; it never grows beyond MEMBER_BYTES.
BLOCK = 60_000


def block_member(text: bytes) -> bytes:
    """A member of block gzip; one without text marks the end."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(text) + deflate.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(text), len(text))


def is_blocked(path: str) -> bool:
    system, name = located(path)
    with system.open_input_file(name) as raw:
        return member_size(raw.read(64)) > 0


def is_splittable(path: str) -> bool:
    return not path.endswith(".gz") or is_blocked(path)


def plain_chunks(path: str, start: int, end: int | None) -> Iterator[tuple[int, bytes]]:
    system, name = located(path)
    with system.open_input_file(name) as raw:
        raw.seek(start)
        while chunk := raw.read(min(CHUNK, end - start) if end is not None and start < end else CHUNK):
            yield start, chunk
            start += len(chunk)


def member_chunks(path: str, start: int, end: int | None) -> Iterator[tuple[int, bytes]]:
    """(place in the file, content) of the members that begin at start or later."""
    system, name = located(path)
    with system.open_input_file(name) as raw:
        raw.seek(start)
        held, at = raw.read(3 * MEMBER_BYTES), 0
        # what looks like a header counts if another member, or the end, follows where it says
        while start and at < len(held):
            at = held.find(b"\x1f\x8b\x08\x04", at)
            if at < 0:
                return
            n = member_size(held[at : at + 64])
            if n and (member_size(held[at + n : at + n + 64]) or (start + at + n >= file_size(path))):
                break
            at += 1
        place, held = start + at, held[at:]
        while True:
            if len(held) < MEMBER_BYTES:
                held += raw.read(CHUNK)
            n = member_size(held[:64])
            if not held:
                return
            if not n or n > len(held):
                raise ValueError(f"{path} is cut off or no block gzip at byte {place}")
            yield place, zlib.decompress(held[:n], 31)
            place, held = place + n, held[n:]


def stream_chunks(path: str) -> Iterator[tuple[int, bytes]]:
    system, name = located(path)
    with system.open_input_stream(name, compression=None) as raw:
        inflate = zlib.decompressobj(31)
        while held := raw.read(CHUNK):
            while held:
                yield 0, inflate.decompress(held)
                held = inflate.unused_data
                if inflate.eof:
                    inflate = zlib.decompressobj(31)


def chunks(path: str, start: int, end: int | None) -> Iterator[tuple[int, bytes]]:
    if not path.endswith(".gz"):
        return plain_chunks(path, start, end)
    return member_chunks(path, start, end) if is_blocked(path) else stream_chunks(path)


def lines(path: str, start: int, end: int | None) -> Iterator[tuple[bytes, bool]]:
    """Lines from a place on, each with whether it begins no later than at the end of the range."""
    tail, inside, crossed = b"", True, False
    for place, chunk in chunks(path, start, end):
        if end is not None and place >= end and not crossed:
            crossed = True  # the line that is open here is the last that the range owns
        parts = (tail + chunk).split(b"\n")
        tail = parts.pop()
        for p in parts:
            yield p, inside
            inside = inside and not crossed
    if tail:
        yield tail, inside


class Records:
    """The records that a range owns (end None: all from there on), taken a number at a time.

    ``ended`` is set by an empty head, which ends a file. A record that the file
    cuts short has empty lines.
    """

    def __init__(self, path: str, start: int = 0, end: int | None = None):
        self.source, self.ended, self.held = lines(path, start, end), False, []
        if start:
            next(self.source, None)
            near = list(islice(self.source, 6))
            first = next((i for i in range(len(near) - 2) if near[i][0].startswith(b"@") and near[i + 2][0].startswith(b"+")), len(near))
            self.held = near[first:]

    def _line(self) -> tuple[bytes, bool] | None:
        return self.held.pop(0) if self.held else next(self.source, None)

    def take(self, most: int) -> list[list[str]]:
        """Heads, sequences, + lines and qualities of the next records."""
        out: list[list[str]] = [[], [], [], []]
        while len(out[0]) < most and not self.ended:
            head = self._line()
            if head is None or not head[1] or not head[0].strip():
                self.ended = head is not None and not head[0].strip()
                self.source = iter(())
                self.held = []
                break
            for column, line in zip(out, (head, *(self._line() or (b"", True) for _ in range(3))), strict=True):
                column.append(line[0].rstrip(b"\r").decode("ascii", "replace"))
        return out

    def skip(self, n: int) -> None:
        while n > 0 and (got := len(self.take(min(n, BATCH))[0])):
            n -= got

    def count(self) -> int:
        n = 0
        while got := len(self.take(BATCH)[0]):
            n += got
        return n


def granules(spark: SparkSession, files: list[tuple[int, int, str]], size: int = GRANULE_BYTES) -> DataFrame:
    """pair, side, path, start, end, records, ended: a row for each granule of the files, counted where Spark puts it."""
    rows = []
    for pair, side, path in files:
        total = file_size(path)
        step = max(1, size, -(-total // MOST_GRANULES))
        rows += [(pair, side, path, at, at + step) for at in range(0, total, step)]
    ddl = "pair int, side int, path string, start long, end long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [Records(g["path"], g["start"], g["end"]) for g in batch.to_pylist()]
            counts = [r.count() for r in own]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), pa.array([r.ended for r in own], pa.bool_())], [*batch.schema.names, "records", "ended"])

    if not rows:
        return spark.createDataFrame([], f"{ddl}, records long, ended boolean")
    # neighbouring granules stay together, so that a task reads one stretch of a file
    parts = min(len(rows), 4 * max(1, spark.sparkContext.defaultParallelism))
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), ddl).mapInArrow(count, f"{ddl}, records long, ended boolean")


def lockstep(counted: DataFrame, split: int = SPLIT_BYTES) -> DataFrame:
    """pair, first, n, start1, start2, skip2: a row for each task, from counted granules of both sides.

    Records first .. first + n - 1 begin at R1's start1, and skip2 records after R2's start2.
    """
    before = Window.partitionBy("pair", "side").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = counted.withColumn("over", F.coalesce(F.max("ended").over(before), F.lit(False))).where("NOT over")
    known = known.withColumn("first", F.coalesce(F.sum("records").over(before), F.lit(0).cast("long"))).where("records > 0")
    tasks = known.where("side = 1").groupBy("pair", F.floor(F.col("start") / split).alias("task")).agg(F.min("first").alias("first"), F.min("start").alias("start1"), F.sum("records").alias("n"))
    other = known.where("side = 2").select("pair", "first", F.lit(None).cast("long").alias("start1"), F.lit(None).cast("long").alias("n"), F.struct("start", "first", "records").alias("at"))
    both = tasks.select("pair", "first", "start1", "n", F.lit(None).cast(other.schema["at"].dataType).alias("at")).unionByName(other)
    # of one number, R2's granule comes before the task
    order = Window.partitionBy("pair").orderBy("first", F.col("at").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy("pair")
    placed = both.withColumn("of", F.last("at", ignorenulls=True).over(order)).withColumn("total", F.max(F.col("at.first") + F.col("at.records")).over(total)).where("at IS NULL")
    n = F.least("n", F.col("total") - F.col("first"))
    return placed.select("pair", "first", n.alias("n"), "start1", F.col("of.start").alias("start2"), (F.col("first") - F.col("of.first")).alias("skip2")).where("n > 0").orderBy("pair", "first")


def estimated_records(path: str) -> int:
    """About how many records a FASTQ file has: its size over that of the records in its first part."""
    system, name = located(path)
    with system.open_input_stream(name, compression=None) as raw:
        first = raw.read(CHUNK)
    text, used = first, len(first)
    if path.endswith(".gz"):
        inflate = zlib.decompressobj(31)
        text = inflate.decompress(first)
        used -= len(inflate.unused_data)
    ends = text.count(b"\n")
    if used == file_size(path):
        return ends // 4 + (ends % 4 == 3 and not text.endswith(b"\n"))
    return round(file_size(path) * ends / 4 / max(1, used))
