"""Token-id files: independent zstandard frames, a trailing seek table, per-frame checksums.

A file follows the public zstandard seekable format: data frames, then one
skippable frame with the seek table (compressed size, decompressed size and the
low 32 bits of XXH64 of each frame's content), so any zstandard tool can read
it. Data frames hold ids as little-endian unsigned integers (2 bytes each where
the vocabulary allows it, else 4) and each covers whole documents up to about
FRAME_BYTES, or a part of a longer document. The last frames hold the document
table: doc_id and end position (in ids of this file), two little-endian int64
arrays, one behind the other. A reader opens the footer, the seek table, the
document table, and then only the frames that hold the wanted documents.

Files are in ascending doc_id order, and so are the documents in them. Each
writing task names its file by a fresh id and only the files named in the
returned manifest count, so a task that ran twice does no harm.

Edge cases: null text is an empty document (the end id alone); a null doc_id
sorts first and is kept; repeated rows are kept as documents of their own; an
empty table writes no file and reads back as no rows; extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder, flat_string, slices
from .common import filesystem, texts, work_dir

FRAME_BYTES = 1 << 18
TABLE_ROWS = 1 << 16
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
NO_ID = -(1 << 63)


class SeekableWriter:
    """Writes frames, then the seek table."""

    def __init__(self, out, level: int = 1):
        self.out, self.table, self.at = out, [], 0
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)

    def frame(self, content: bytes) -> None:
        packed = self.zstd.compress(content)
        self.out.write(packed)
        self.table.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def close(self) -> None:
        body = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0x80, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)


class SeekableReader:
    """Reads single frames of a file object that can seek."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 9)
        frames, descriptor, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC or not descriptor & 0x80:
            raise ValueError("not a seekable zstandard file with checksums")
        source.seek(size - 9 - 12 * frames)
        table = np.frombuffer(source.read(12 * frames), "<u4").reshape(frames, 3).astype(np.int64)
        self.packed, self.sizes, self.sums = table.T if frames else np.zeros((3, 0), np.int64)
        self.places = np.concatenate([[0], np.cumsum(self.packed)])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.zstd = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        self.source.seek(int(self.places[k]))
        content = self.zstd.decompress(self.source.read(int(self.packed[k])), max_output_size=max(1, int(self.sizes[k])))
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"checksum of frame {k} differs")
        return content

    def content(self, start: int, end: int) -> bytes:
        """Bytes start to end of the decompressed file, from the frames that hold them."""
        if end <= start:
            return b""
        a, b = int(np.searchsorted(self.starts, start, "right")) - 1, int(np.searchsorted(self.starts, end, "left"))
        return b"".join(self.frame(k) for k in range(a, b))[start - int(self.starts[a]) : end - int(self.starts[a])]


class TokenFileWriter:
    def __init__(self, out, width: int, level: int = 1):
        self.frames, self.dtype, self.width = SeekableWriter(out, level), f"<u{width}", width
        self.out, self.pending, self.size, self.docs, self.ends, self.total = out, [], 0, [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.size and self.size + ids.size * self.width > FRAME_BYTES:
            self._flush()
        raw = ids.astype(self.dtype).tobytes()
        for at in range(0, max(1, len(raw)), FRAME_BYTES):
            self.pending.append(raw[at : at + FRAME_BYTES])
            self.size += len(self.pending[-1])
            if self.size >= FRAME_BYTES:
                self._flush()
        self.total += ids.size
        self.docs.append(NO_ID if doc_id is None else doc_id)
        self.ends.append(self.total)

    def _flush(self) -> None:
        if self.size:
            self.frames.frame(b"".join(self.pending))
        self.pending, self.size = [], 0

    def close(self) -> None:
        self._flush()
        for values in (self.docs, self.ends):
            packed = np.array(values, "<i8").tobytes()
            for at in range(0, len(packed), TABLE_ROWS * 8):
                self.frames.frame(packed[at : at + TABLE_ROWS * 8])
        self.frames.frame(struct.pack("<qqi", len(self.docs), self.total, self.width))
        self.frames.close()


class TokenFile:
    """Random access to the documents of one file."""

    def __init__(self, source, size: int):
        self.frames = SeekableReader(source, size)
        self.n, self.total, self.width = struct.unpack("<qqi", self.frames.frame(len(self.frames.sizes) - 1))
        data = self.total * self.width
        self.doc_ids = np.frombuffer(self.frames.content(data, data + 8 * self.n), "<i8")
        self.ends = np.frombuffer(self.frames.content(data + 8 * self.n, data + 16 * self.n), "<i8")

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        start, end = int(self.ends[k - 1]) if k else 0, int(self.ends[k])
        return np.frombuffer(self.frames.content(start * self.width, end * self.width), f"<u{self.width}")

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of each document with that doc_id."""
        a, b = np.searchsorted(self.doc_ids, [doc_id, doc_id + 1])
        return [self.ids(k) for k in range(int(a), int(b))]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) of all documents, each frame decompressed once."""
        frame, held, base = -1, b"", 0
        for k in range(self.n):
            start, end = (int(self.ends[k - 1]) if k else 0) * self.width, int(self.ends[k]) * self.width
            while base + len(held) < end:
                frame += 1
                held, base = held[max(0, start - base) :] + self.frames.frame(frame), max(base, min(start, base + len(held)))
            yield (None if self.doc_ids[k] == NO_ID else int(self.doc_ids[k])), start // self.width, np.frombuffer(held[start - base : end - base], f"<u{self.width}")


def write_token_files(df: DataFrame, tokenizer: str, folder: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = 1, width: int | None = None) -> DataFrame:
    """Encode, append end_id, write files below folder; returns the manifest.

    The manifest has a row per file in ascending order: path, n_docs, n_tokens
    and start (ids in all files before it). width: bytes of an id, by default 2
    if the vocabulary allows it.
    """
    spark = df.sparkSession
    folder = folder or work_dir(spark, "tokens")
    if width is None:
        from tokenizers import Tokenizer

        width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, fs, path, first = None, None, "", None
        own = encoder(tokenizer)
        for batch in batches:
            docs, column = batch.column(0).to_pylist(), flat_string(batch.column(1))
            for a, b in slices(column):
                ids, offsets = own.ids(column.slice(a, b - a))
                if writer is None:
                    fs, root = filesystem(folder)
                    fs.create_dir(root, recursive=True)
                    path, first = f"{root}/{uuid.uuid4().hex}.tok.zst", docs[a]
                    writer = TokenFileWriter(fs.open_output_stream(path, compression=None), width)
                for i in range(b - a):
                    writer.add(docs[a + i], np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end_id)))
        if writer is not None:
            writer.close()
            writer.out.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "first": first, "last": docs[-1], "n_docs": len(writer.docs), "n_tokens": writer.total}], schema=schema)

    schema = pa.schema([("path", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    parts = texts(df, key, text).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows = parts.mapInArrow(run, "path string, first long, last long, n_docs long, n_tokens long").collect()
    rows.sort(key=lambda r: (r["first"] is not None, r["first"], r["last"] is not None, r["last"]))
    out, start = [], 0
    for r in rows:
        out.append((r["path"], r["n_docs"], r["n_tokens"], start))
        start += r["n_tokens"]
    return spark.createDataFrame(out, "path string, n_docs long, n_tokens long, start long").withColumn("folder", F.lit(folder))


def read_token_files(spark: SparkSession, manifest: DataFrame, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document of the manifest's files: key, start, n_tokens, ids_crc32 and, if asked, ids."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, _ = filesystem(row["folder"])
                with fs.open_input_file(row["path"]) as source:
                    rows = []
                    for doc, start, ids in TokenFile(source, source.size()).documents():
                        wide = ids.astype("<u4")
                        rows.append((doc, row["start"] + start, len(ids), zlib.crc32(wide.tobytes()), *([wide.astype(np.int64)] if with_ids else [])))
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = max(1, manifest.count())
    spread = manifest.repartition(files)
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids).withColumnRenamed("doc_id", key)
