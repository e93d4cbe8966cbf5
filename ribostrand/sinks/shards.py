"""Text files of a folder that a failed job leaves as they were.

``TextShards`` (format ``text_shards``) is a data source writer. Every task writes
files of its own under fresh names and deletes them itself if it fails; the
driver then names the files of the tasks that succeeded in a manifest, which
replaces the old one as the last step. Readers go by the manifest, so files of a
lost executor or a second attempt are never read, and the next commit deletes
them.

A row is text for one or several streams (columns) of a group: the streams of a
group stand in files of their own, in step, row by row (R1 and R2 of a channel,
say). Shards are listed in the order of the partitions. One job writes to a
folder at a time.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..sources.ranges import BLOCK, block_member, located

MANIFEST = "_manifest.json"


@dataclass
class Written(WriterCommitMessage):
    """The shards of a task: group, rows, and its files by stream."""

    part: int
    shards: list[dict] = field(default_factory=list)


class Gzip:
    """Block gzip, so that readers can split what was written."""

    def __init__(self, out):
        self.out, self.held = out, bytearray()

    def write(self, data: bytes) -> None:
        self.held += data
        while len(self.held) >= BLOCK:
            self.out.write(block_member(bytes(self.held[:BLOCK])))
            del self.held[:BLOCK]

    def close(self) -> None:
        if self.held:
            self.out.write(block_member(bytes(self.held)))
        self.out.write(block_member(b""))
        self.out.close()


def read_manifest(path: str) -> list[dict]:
    """Shards (group, part, rows, files by stream) of a folder in order; none if nothing was ever committed there."""
    system, name = located(path)
    place = f"{name}/{MANIFEST}"
    if not system.get_file_info(place).is_file:
        return []
    with system.open_input_stream(place) as f:
        return json.loads(f.read())


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, streams: list[str], overwrite: bool):
        self.path, self.streams, self.overwrite = options["path"], streams, overwrite
        self.gzip, self.suffix = options.get("gzip", "false") == "true", options.get("suffix", "txt")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = located(self.path)
        system.create_dir(folder, recursive=True)
        out, opened, made = Written(TaskContext.get().partitionId()), {}, []
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    group = row["group"] or ""
                    if group not in opened:
                        stem = f"{uuid.uuid4().hex}"
                        files = {s: f"{stem}.{s}.{self.suffix}{'.gz' if self.gzip else ''}" for s in self.streams}
                        made += files.values()
                        raw = {s: system.open_output_stream(f"{folder}/{f}", compression=None) for s, f in files.items()}
                        opened[group] = {s: Gzip(r) if self.gzip else r for s, r in raw.items()}
                        out.shards.append({"group": group, "part": out.part, "rows": 0, "files": files})
                    for s, stream in opened[group].items():
                        if row[s] is not None:
                            stream.write(row[s].encode() + b"\n")
                    next(x for x in out.shards if x["group"] == group)["rows"] += 1
            for streams in opened.values():
                for stream in streams.values():
                    stream.close()
        except BaseException:
            self._delete(made)
            raise
        return out

    def commit(self, messages: list[Written | None]) -> None:
        """The manifest names what the tasks wrote (and, when appending, what it named before); anything else goes."""
        system, folder = located(self.path)
        system.create_dir(folder, recursive=True)
        new = sorted((s for m in messages if m is not None for s in m.shards), key=lambda s: (s["part"], s["group"]))
        shards = new if self.overwrite else read_manifest(self.path) + new
        with system.open_output_stream(f"{folder}/{MANIFEST}.new", compression=None) as f:
            f.write(json.dumps(shards).encode())
        system.move(f"{folder}/{MANIFEST}.new", f"{folder}/{MANIFEST}")
        from pyarrow import fs

        named = {f for s in shards for f in s["files"].values()} | {MANIFEST}
        self._delete([x.base_name for x in system.get_file_info(fs.FileSelector(folder)) if x.is_file and x.base_name not in named])

    def abort(self, messages: list[Written | None]) -> None:
        self._delete([f for m in messages if m is not None for s in m.shards for f in s["files"].values()])

    def _delete(self, names: list[str]) -> None:
        system, folder = located(self.path)
        for f in names:
            with contextlib.suppress(OSError):
                system.delete_file(f"{folder}/{f}")


class TextShards(DataSource):
    """Options: path, suffix, gzip. Columns: group, then one of text for each stream. Modes: overwrite, append."""

    @classmethod
    def name(cls) -> str:
        return "text_shards"

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(dict(self.options), [f.name for f in schema.fields if f.name != "group"], overwrite)


def write_shards(df: DataFrame, path: str, streams: dict[str, Column], group: Column | None = None, suffix: str = "txt", gzip: bool = False, mode: str = "overwrite") -> list[dict]:
    """Writes a shard for each partition and group; returns the manifest."""
    spark = df.sparkSession
    spark.dataSource.register(TextShards)
    rows = df.select((F.lit("") if group is None else group).alias("group"), *[c.alias(s) for s, c in streams.items()])
    rows.write.format("text_shards").mode(mode).options(path=path, suffix=suffix, gzip=str(gzip).lower()).save()
    return read_manifest(path)


def shard_files(path: str, stream: str, group: str = "") -> list[str]:
    """The files of a stream of a group, in order."""
    return [f"{path.rstrip('/')}/{s['files'][stream]}" for s in read_manifest(path) if s["group"] == group]


def read_shards(spark: SparkSession, path: str, stream: str, group: str = "") -> DataFrame:
    """value: the lines of a stream, as Spark reads text; no files, no lines."""
    files = shard_files(path, stream, group)
    return spark.read.text(files) if files else spark.createDataFrame([], "value string")
