"""Best-fit packing by exact-complement hashing.

Documents become token ids plus an end id; longer ones are cut into pieces of
the sequence length, the remainder first. Only the histogram of piece lengths
(at most one counter per possible length, however many documents there are)
decides the plan: for each length, longest first, the gap to the sequence
length is looked up in an index of single lengths, pair sums and triple sums
under availability counts, and a combination that fills it exactly is consumed
as often as its counts allow. What has no exact complement is packed best-fit: the largest
available length that fits, then again an exact complement of the rest.

A plan row says: copies m of the pattern (l1, l2, ...). Pieces of one length
are numbered across the partitions; number and length give sequence and offset.

Edge cases: null and empty texts are documents of one end id; repeated rows and
ties are packed as pieces of their own; an empty table gives an empty result;
extra columns are ignored; a null doc_id is packed like any other.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder, flat_string, release, slices
from .common import small_batches, stored, texts

#: Rows that a Python worker gets at once.
BATCH = 2_000


class Sums:
    """Available lengths with their counts, and an index of single, pair and triple sums.

    ``left[n]`` counts the pieces of length n. ``pair[s]`` is the larger member
    of a pair of lengths with the sum s, 0 where there is none; ``no_triple[s]``
    says that no three lengths have that sum. Counts only fall, so an entry that
    no longer holds is looked up anew once, and what is not found stays so.
    """

    def __init__(self, left: np.ndarray):
        self.left, size = left, len(left)
        self.pair, self.no_triple = np.zeros(size, np.int64), np.zeros(size, bool)
        have = np.flatnonzero(left)
        for a in have.tolist():
            other = have[(have <= a) & (have + a < size)]
            other = other[left[other] > (other == a)]
            self.pair[a + other] = a

    def largest(self, most: int) -> int:
        """The largest available length up to most, 0 if there is none."""
        have = np.flatnonzero(self.left[: most + 1])
        return int(have[-1]) if len(have) else 0

    def two(self, s: int) -> tuple[int, int] | None:
        """An available pair with the sum s."""
        a = int(self.pair[s])
        if not a:
            return None
        if not (self.left[a] and self.left[s - a] > (2 * a == s)):
            b = np.arange(s // 2 + 1)
            ok = np.flatnonzero((self.left[b] > (2 * b == s)) & (self.left[s - b] > 0))
            a = self.pair[s] = s - int(ok[0]) if len(ok) else 0
        return (a, s - a) if a else None

    def three(self, s: int) -> tuple[int, int, int] | None:
        """An available triple with the sum s."""
        if s < 3 or self.no_triple[s]:
            return None
        have = np.flatnonzero(self.left[: s - 1])
        for a in have[self.pair[s - have] > 0][::-1].tolist():
            self.left[a] -= 1
            rest = self.two_without(s - a, a)
            self.left[a] += 1
            if rest:
                return (a, *rest)
        self.no_triple[s] = True
        return None

    def two_without(self, s: int, taken: int) -> tuple[int, int] | None:
        """As ``two`` while one piece of the length taken is in hand; what only that piece prevents is not forgotten."""
        kept = int(self.pair[s])
        found = self.two(s)
        if not found and self.left[taken] == 0:
            self.pair[s] = kept
        return found

    def fill(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths whose sum is the gap."""
        return (gap,) if self.left[gap] else self.two(gap) or self.three(gap)


def packing_plan(histogram: dict[int, int], length: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with their numbers of copies, whose sums are at most length."""
    left = np.zeros(length + 1, np.int64)
    for n, c in histogram.items():
        left[n] += c
    sums = Sums(left)
    plan: list[tuple[tuple[int, ...], int]] = []

    def consume(pattern: tuple[int, ...]) -> None:
        """As often as the counts allow."""
        m = min(int(left[x]) // pattern.count(x) for x in set(pattern))
        for x in pattern:
            left[x] -= m
        plan.append((pattern, m))

    if left[length]:
        consume((length,))
    pending: list[int] = []
    for big in range(length - 1, 0, -1):
        while left[big]:
            left[big] -= 1
            fill = sums.fill(length - big)
            left[big] += 1
            if fill is None:
                pending.append(big)
                break
            consume((big, *fill))
    for big in pending:
        while left[big]:
            # the largest that fits, then again an exact complement of the rest
            pattern, gap = [big], length - big
            left[big] -= 1
            while gap:
                fill = sums.fill(gap) or (sums.largest(gap),)
                if not fill[0]:
                    break
                for x in fill:
                    left[x] -= 1
                pattern += fill
                gap -= sum(fill)
            for x in pattern:
                left[x] += 1
            consume(tuple(pattern))
    return plan


class Slots:
    """Where the n-th piece of a length goes."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]]):
        by: dict[int, list[tuple[int, int, int]]] = {}
        first = 0
        for pattern, m in plan:
            at = 0
            for x in pattern:
                by.setdefault(x, []).append((m, first, at))
                at += x
            first += m
        self.by = {}
        for x, slots in by.items():
            copies, firsts, offsets = np.array(slots, np.int64).T
            self.by[x] = (np.concatenate([[0], np.cumsum(copies)]), firsts, offsets)

    def place(self, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for x in np.unique(lengths):
            at = np.flatnonzero(lengths == x)
            starts, firsts, offsets = self.by[int(x)]
            k = np.searchsorted(starts, numbers[at], "right") - 1
            sequence[at], offset[at] = firsts[k] + numbers[at] - starts[k], offsets[k]
        return sequence, offset


def pieces(df: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents: key, piece, start, length, ids_crc32, and (part, number): the number among this part's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(tokenizer)  # what other operators' tasks left
        yield from made(batches)
        release(tokenizer)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, part = encoder(tokenizer), np.zeros(length + 1, np.int64), uuid.uuid4().hex
        for batch in batches:
            docs, column = batch.column(0), flat_string(batch.column(1))
            for a, b in slices(column):
                ids, offsets = own.ids(column.slice(a, b - a))
                ids = np.insert(ids, offsets[1:], end_id).astype("<u4")
                begins, ends = offsets[:-1] + np.arange(b - a), offsets[1:] + np.arange(1, b - a + 1)
                n = ends - begins
                count = -(-n // length)
                row = np.repeat(np.arange(b - a), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                to = ends[row] - (count[row] - 1 - piece) * length
                start = np.maximum(begins[row], to - length)
                size, raw = to - start, memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(start.tolist(), to.tolist(), strict=True)]
                order = np.argsort(size, kind="stable")
                run_start = np.concatenate([[0], np.flatnonzero(np.diff(size[order])) + 1]) if len(order) else np.zeros(0, np.int64)
                within = np.arange(len(order)) - np.repeat(run_start, np.diff(np.append(run_start, len(order))))
                number = np.empty(len(order), np.int64)
                number[order] = within + seen[size[order]]
                seen += np.bincount(size, minlength=length + 1)
                yield pa.RecordBatch.from_arrays(
                    [docs.slice(a, b - a).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start - begins[row]), pa.array(size), pa.array(crc, pa.int64()), pa.array([part] * len(row), pa.string()), pa.array(number)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "number"],
                )

    return texts(df, key, text).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part string, number long").withColumnRenamed("doc_id", key)


def pack(df: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset."""
    with small_batches(df.sparkSession, BATCH):
        cut = stored(pieces(df, tokenizer, length, end_id, key, text), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("pieces"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(counts.withColumn("before", F.coalesce(F.sum("pieces").over(earlier), F.lit(0))), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("pieces").alias("n")).collect()}
    slots = Slots(packing_plan(histogram, length))
    names = [key, "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = slots.place(batch.column("length").to_numpy(), batch.column("number").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    # a row for each task and length: too many to broadcast for a large corpus
    numbered = cut.join(counts.select("part", "length", "before").hint("merge"), ["part", "length"]).select(*names, (F.col("number") + F.col("before")).alias("number"))
    return numbered.mapInArrow(run, f"{key} long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
