"""Benchmark decontamination: shared word pairs bound the score, then Smith-Waterman alignment of words.

Words are runs of letters and digits of the lower-cased text. A document is
aligned locally with an item (match +2, mismatch and gap -1); the pair is
reported if the best score reaches ``ratio`` of the score of an exact copy.

Only alignments that cannot reach that score R are left out. An alignment of M
matches in r runs scores at most 2 M - (r - 1), so at least R - M - 1 places of
the item, with M at most its m words, begin a pair of neighbouring words that
also stand side by side in the document. Where R - m - 1 is not positive (short
items, low ratios) single words are counted instead, at least R / 2. The places
met lie on diagonals at most 2 m - R apart, as each step between diagonals costs
a gap. One pass over the corpus counts them and aligns what is left; no
frequency decides what is searched.

Items are held in memory in blocks of at most ``BLOCK_WORDS`` words; a larger
benchmark takes more passes, one per block. Nothing about documents is
gathered.

Edge cases: items without words match nothing; null texts are empty; repeated rows give a row each;
repeated items are items of their own; of alignments with equal scores the one
that ends first counts; very long texts are read in slices and aligned only near
what they share with an item; empty tables give empty results; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import flat_string, slices
from .common import stored, text_hash, texts, without

RATIO = 0.6
BLOCK_WORDS = 2_000_000
MULT = np.uint64(0x9E3779B97F4A7C15)
OUT = "doc_id long, item_id long, score int, ratio double, first_word int, last_word int, seeds int"


def words(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, number of each word in them, offsets of the texts)."""
    plain = pc.replace_substring_regex(pc.utf8_lower(column), r"[^\pL\pN]+", " ")
    split = pc.split_pattern(plain, " ")
    coded = pc.dictionary_encode(split.flatten())
    codes = coded.indices.to_numpy(zero_copy_only=False)
    real = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0, bool)
    offsets = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
    return coded.dictionary, codes[real], np.concatenate([[0], np.cumsum(real)])[offsets]


class Items:
    """A block of test items: their vocabulary, the score each has to reach, and where each of their grams (pairs or single words) stands."""

    def __init__(self, rows: list[tuple[int, str]], ratio: float):
        self.ids = [r[0] for r in rows]
        distinct, codes, offsets = words(pa.array([r[1] or "" for r in rows], pa.string()))
        names = distinct.to_pylist()
        self.vocabulary = {names[c]: int(c) for c in np.unique(codes)}
        self.words = [codes[a:b].astype(np.int32) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        size = np.array([len(w) for w in self.words], np.int64)
        self.least = np.ceil(ratio * 2 * size).astype(np.int64)
        pairs = self.least - size - 1
        self.need = np.maximum(1, np.where(pairs > 0, pairs, (self.least + 1) // 2))
        of = np.where(pairs > 0, 2, 1)
        self.sizes = sorted(set(of[size > 0].tolist()))
        own = [self.grams(w, n) for w, n in zip(self.words, of.tolist(), strict=True)]
        every = np.concatenate([np.zeros(0, np.uint64), *own])
        self.hashes, numbers, counts = np.unique(every, return_inverse=True, return_counts=True)
        #: the grams of each item in order, and the items of each gram (one entry for each place)
        self.own = np.split(numbers, np.cumsum([len(x) for x in own])[:-1])
        self.at = np.concatenate([[0], np.cumsum(counts)])
        self.items = np.repeat(np.arange(len(own)), [len(x) for x in own])[np.argsort(numbers, kind="stable")]

    @staticmethod
    def grams(codes: np.ndarray, n: int) -> np.ndarray:
        """A hash of each run of n words of the vocabulary."""
        out = np.full(max(0, len(codes) - n + 1), n, np.uint64)
        for k in range(n):
            out = (out ^ codes[k : k + len(out)].astype(np.int64).astype(np.uint64)) * MULT
            out ^= out >> np.uint64(29)
        return out

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the gram, place) of each gram of the items in a text."""
        found = []
        known = codes >= 0
        for n in self.sizes:
            if len(codes) < n:
                continue
            whole = known[: len(codes) - n + 1].copy()
            for k in range(1, n):
                whole &= known[k : k + len(whole)]
            at = np.flatnonzero(whole)
            if not len(at):
                continue
            grams = self.grams(codes, n)[at]
            k = np.searchsorted(self.hashes, grams)
            k[k == len(self.hashes)] = 0
            ok = self.hashes[k] == grams
            found.append((k[ok], at[ok]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def candidates(self, grams: np.ndarray) -> np.ndarray:
        """The items of which a text with these grams holds enough places."""
        met = np.unique(grams)
        begin, count = self.at[met], self.at[met + 1] - self.at[met]
        entries = np.arange(count.sum()) + np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        items, places = np.unique(self.items[entries], return_counts=True)
        return items[places >= self.need[items]]

    def diagonals(self, k: int, grams: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Where the item k would begin in a text, sorted: for each gram met, if enough are near enough for an alignment."""
        own = self.own[k]
        order = np.argsort(own, kind="stable")
        low, high = np.searchsorted(own[order], grams, "left"), np.searchsorted(own[order], grams, "right")
        count = high - low
        entries = np.arange(count.sum()) + np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        begins = np.sort(np.repeat(places, count) - order[entries])
        need = int(self.need[k])
        if len(begins) < need:
            return begins[:0]
        near = np.flatnonzero(begins[need - 1 :] - begins[: len(begins) - need + 1] <= self.gaps(k))
        marks = np.zeros(len(begins) + 1, np.int64)
        np.add.at(marks, near, 1)
        np.add.at(marks, near + need, -1)
        return begins[np.cumsum(marks)[:-1] > 0]

    def gaps(self, k: int) -> int:
        """The most penalties an alignment with a sufficient score can have."""
        return int(2 * len(self.words[k]) - self.least[k])


def align(text: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman over words: (best score, end in text). Match +2, mismatch and gap -1."""
    ramp = np.arange(len(text) + 1)
    above, best, end = np.zeros(len(text) + 1, np.int64), 0, 0
    for word in item:
        row = np.maximum(above - 1, 0)
        row[1:] = np.maximum(row[1:], above[:-1] + np.where(text == word, 2, -1))
        row = np.maximum.accumulate(row + ramp) - ramp
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
        above = row
    return best, end


def best_alignment(items: Items, k: int, text: np.ndarray, begins: np.ndarray) -> tuple[int, int, int]:
    """(score, first word, last word) of the best alignment of item k near the diagonals of a text."""
    item, gaps, best = items.words[k], items.gaps(k), (0, 0, 0)
    low = high = None
    for begin in [*begins.tolist(), None]:
        if low is not None and (begin is None or begin - gaps > high):
            window = text[max(0, low) : high]
            score, end = align(window, item)
            if score > best[0]:
                _, back = align(window[:end][::-1], item[::-1])
                best = (score, max(0, low) + end - back, max(0, low) + end - 1)
            low = None
        if begin is not None:
            low = begin - gaps if low is None else low
            high = begin + len(item) + gaps
    return best


def aligned(df: DataFrame, items: Items) -> DataFrame:
    """A row per row of df and item with a sufficient alignment."""
    sent = df.sparkSession.sparkContext.broadcast(items)  # at most BLOCK_WORDS words
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.int32()), ("ratio", pa.float64()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("seeds", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            column = flat_string(batch.column(1))
            for a, b in slices(column):
                distinct, codes, offsets = words(column.slice(a, b - a))
                table = np.fromiter((own.vocabulary.get(w, -1) for w in distinct.to_pylist()), np.int32, len(distinct))
                every = table[codes] if len(codes) else np.zeros(0, np.int32)
                out = []
                for i in range(b - a):
                    text = every[offsets[i] : offsets[i + 1]]
                    grams, places = own.hits(text)
                    if not len(grams):
                        continue
                    for k in own.candidates(grams).tolist():
                        begins = own.diagonals(k, grams, places)
                        score, first, last = best_alignment(own, k, text, begins)
                        if len(begins) and score >= own.least[k]:
                            out.append((batch.column(0)[a + i].as_py(), own.ids[k], score, score / (2 * len(own.words[k])), first, last, len(begins)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return texts(df).mapInArrow(run, OUT)


def contaminated(df: DataFrame, benchmark: DataFrame, ratio: float = RATIO, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row per pair of document and test item with a sufficient alignment: doc_id, item_id, score, ratio of the score of a copy, first and last aligned word of the document, seeds met (grams of the item near the alignment)."""
    rows = benchmark.select(F.col(item_key).cast("long").alias("i"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("t"))
    out, block, size = None, [], 0
    docs = texts(df, key, text)
    for r in [*rows.toLocalIterator(), None]:
        if block and (r is None or size >= BLOCK_WORDS):
            items = Items(block, ratio)
            if len(items.hashes):
                pairs = aligned(docs, items)
                out = pairs if out is None else out.unionByName(pairs)
            block, size = [], 0
        if r is not None:
            block.append((r["i"], r["t"]))
            size += len(r["t"].split()) + 1
    return df.sparkSession.createDataFrame([], OUT) if out is None else out


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of df without contaminated texts; all columns. Rows are told apart by a 64-bit hash of their texts, so keys may be null or repeated."""
    docs = df.select(text_hash(text).alias("doc_id"), F.col(text).alias("text"))
    bad = stored(contaminated(docs, benchmark, **options).select("doc_id").distinct(), "contaminated")
    return without(df, text_hash(text), bad, "doc_id")
