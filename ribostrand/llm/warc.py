"""WARC writing with payload revisits, and the normaliser of monolithic gzip archives.

``write_archives`` writes a record per page into archives that are one gzip
stream each, as many crawlers leave them. ``normalise`` inflates each stream
once, rewrites every record as its own gzip member and writes a sidecar offset
index (tab-separated: offset, length, record type, record id, target URI), so
that any record can be read by itself. ``read_records`` reads records back
through the index and digests the payloads again.

Of pages with equal payloads of at least ``least`` bytes, the one of the
smallest page_id is a response and the others are revisits of it. The digest
join is skewed where one payload is very common; AQE splits such partitions.
Files get fresh names and only those named in the manifests count, so a task
that runs twice does no harm.

Edge cases: a null payload counts as empty; a null URL is written as an empty
one; rows that share the smallest page_id and the payload are all responses; a
page without page_id is a revisit where a page with one has its payload, and a
response otherwise; empty tables write no file; a very long payload is held
whole by one task when written, in parts when normalised; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, stored, work_dir

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
ROLL_BYTES = 256 << 20
CHUNK = 1 << 20
MANIFEST = "folder string, path string, records long"
NO_PAGE = "none"


def record_id(page: int | None) -> str:
    return f"<urn:page:{NO_PAGE if page is None else page}>"


def page_of(record: str) -> int | None:
    last = record.strip("<>").rpartition(":")[2]
    return None if last == NO_PAGE else int(last)


def record(page: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC 1.1 record; a revisit carries no payload."""
    block = HTTP_HEAD if revisit else HTTP_HEAD + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page)}",
        f"WARC-Date: {date}",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Bytes: {size}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"] if revisit else []),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


class Inflated:
    """The content of a gzip stream (of one or several members), read bit by bit."""

    def __init__(self, source):
        self.source, self.held, self.z = source, bytearray(), zlib.decompressobj(31)

    def _more(self) -> bool:
        raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        if not raw:
            raw = self.source.read(CHUNK)
            if not raw:
                if not self.z.eof:
                    raise EOFError("the gzip stream is cut off")
                return False
        if self.z.eof:
            self.z = zlib.decompressobj(31)
        self.held += self.z.decompress(raw, 4 * CHUNK)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to and without the mark; None at the end."""
        at = 0
        while (end := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                if self.held.strip():
                    raise EOFError("a record is cut off")
                return None
        out = bytes(self.held[:end])
        del self.held[: end + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self._more():
                raise EOFError("a record is cut off")
            part = bytes(self.held[:n])
            del self.held[: len(part)]
            n -= len(part)
            if part:
                yield part


def records(source) -> Iterator[tuple[bytes, Iterator[bytes]]]:
    """(head, parts of the block) of each record of an inflating source."""
    stream = Inflated(source)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        head = head.lstrip(b"\r\n")
        yield head, stream.take(int(headers(head)["content-length"]))
        if b"".join(stream.take(4)) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")


def with_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 100) -> DataFrame:
    """page_id, url, digest, payload_bytes, packed (zstandard), first (page_id that has the payload first, null if no other page has it)."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("html"))
    digests = rows.where(F.octet_length("html") >= least).select("page_id", F.sha2(F.encode("html", "utf-8"), 256).alias("digest"))
    firsts = digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", "first")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            raw = [x.encode() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([hashlib.sha256(x).hexdigest() for x in raw]), pa.array([len(x) for x in raw], pa.int64()), pa.array([zstd.compress(x) for x in raw], pa.binary())],
                ["page_id", "url", "digest", "payload_bytes", "packed"],
            )

    def packed(part: DataFrame) -> DataFrame:
        return part.mapInArrow(digest, "page_id long, url string, digest string, payload_bytes long, packed binary")

    # short payloads have no revisits: they are not joined, so the most common one (nothing) is no hot key
    long = F.octet_length("html") >= least
    return packed(rows.where(long)).join(firsts, "digest", "left").unionByName(packed(rows.where(~long)).withColumn("first", F.lit(None).cast("long")))


def write_archives(pages: DataFrame, folder: str | None = None, date: str = "1970-01-01T00:00:00Z", level: int = 1, **names) -> DataFrame:
    """Write monolithic .warc.gz files below folder; returns their manifest."""
    folder = folder or work_dir(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        unpack = zstandard.ZstdDecompressor()
        out = path = z = None
        count = size = 0

        def closed() -> pa.RecordBatch:
            out.write(z.flush())
            out.close()
            return pa.RecordBatch.from_pylist([{"folder": folder, "path": path, "records": count}], schema=pa.schema([("folder", pa.string()), ("path", pa.string()), ("records", pa.int64())]))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "packed", "payload_bytes", "digest", "first")), strict=True):
                page, url, packed, n, digest, first = row
                if out is None:
                    fs.create_dir(root, recursive=True)
                    path, z, count, size = f"{root}/{uuid.uuid4().hex}.warc.gz", zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0
                    out = fs.open_output_stream(path, compression=None)
                revisit = first is not None and page != first
                payload = b"" if revisit else unpack.decompress(packed)
                out.write(part := z.compress(record(page, url, payload, n, digest, first, revisit, date)))
                count, size = count + 1, size + len(part)
                if size >= ROLL_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return stored(with_revisits(pages, **names).mapInArrow(run, MANIFEST), "warc-manifest")


def normalise_file(source, out, index, level: int = 3) -> int:
    """Inflate source once, write each record as its own member to out and its place to index; returns the number of records."""
    offset = count = 0
    for head, block in records(source):
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        length = out.write(z.compress(head + b"\r\n\r\n")) or 0
        for part in block:
            length += out.write(z.compress(part)) or 0
        length += out.write(z.compress(b"\r\n\r\n") + z.flush()) or 0
        named = headers(head)
        index.write("\t".join([str(offset), str(length), named.get("warc-type", ""), named.get("warc-record-id", ""), named.get("warc-target-uri", "").replace("\t", "%09")]).encode() + b"\n")
        offset, count = offset + length, count + 1
    return count


def normalise(manifest: DataFrame, folder: str | None = None, level: int = 3) -> DataFrame:
    """Normalise the archives of a manifest, one task each; returns the manifest of the new ones, whose indexes stand at path + '.idx'."""
    spark = manifest.sparkSession
    folder = folder or work_dir(spark, "warc-members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, _ = filesystem(row["folder"])
                to, root = filesystem(folder)
                to.create_dir(root, recursive=True)
                path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                with fs.open_input_stream(row["path"], compression=None) as source, to.open_output_stream(path, compression=None) as out, to.open_output_stream(path + ".idx", compression=None) as index:
                    count = normalise_file(source, out, index, level)
                yield pa.RecordBatch.from_pylist([{"folder": folder, "path": path, "records": count}], schema=pa.schema([("folder", pa.string()), ("path", pa.string()), ("records", pa.int64())]))

    return stored(manifest.repartition(max(1, manifest.count())).mapInArrow(run, MANIFEST), "warc-manifest")


def parse_member(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and HTTP payload of one member."""
    head, block = next(records(io.BytesIO(raw)))
    body = b"".join(block)
    return headers(head), body.partition(b"\r\n\r\n")[2]


def read_records(spark: SparkSession, manifest: DataFrame, key: str = "page_id") -> DataFrame:
    """Read every record by its index entry: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for row in batch.to_pylist():
                fs, _ = filesystem(row["folder"])
                rows = []
                with fs.open_input_stream(row["path"] + ".idx", compression=None) as index, fs.open_input_file(row["path"]) as source:
                    for line in io.BufferedReader(index):
                        offset, length, kind, _, _ = line.decode().rstrip("\n").split("\t")
                        source.seek(int(offset))
                        named, payload = parse_member(source.read(int(length)))
                        digest = named["warc-payload-digest"].removeprefix("sha256:")
                        if kind == "response":
                            if hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"the payload of {named['warc-record-id']} differs from its digest")
                            rows.append((page_of(named["warc-record-id"]), len(payload), digest, kind, None))
                        else:
                            rows.append((page_of(named["warc-record-id"]), int(named["warc-payload-bytes"]), digest, kind, page_of(named["warc-refers-to"])))
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    out = manifest.repartition(max(1, manifest.count())).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return out.withColumnRenamed("page_id", key)


def archive_round_trip(pages: DataFrame, least: int = 100) -> DataFrame:
    """Write, normalise and read back: one row per page."""
    return read_records(pages.sparkSession, normalise(write_archives(pages, least=least)))
