"""Order-preserving packing: windows over the token stream, cut where it costs least.

Documents become token ids plus an end id and follow each other as the table
gives them (sort it first for another order); a sequence is one window of that
stream, so neighbours stay neighbours and no text moves between tasks. Each
window is padded to ``length`` unless its length is a power of two. A cut after a
document costs nothing, after a sentence or line ``SENTENCE``, elsewhere
``INSIDE``, in tokens of padding; the cuts with the least sum of padding and
penalties are found by dynamic programming over all positions:

    f(j) = penalty(j) + min of f(i) + padding(j - i) over windows of h to length tokens

where h is the largest power of two below length. With padding(n) = length - n
the minimum is one of f(i) + i over a window that slides with j: a monotone
queue. It is kept in its two-stack form, in arrays: the suffix minima of the
older values and the running minima of the newer ones are monotone, and a block
of up to h positions, none of which depends on another, is read off both at once.
Full windows and windows of h tokens need no padding and are taken as such.

Where the stream of a task ends, the rest is covered by one padded window or by
windows whose lengths are powers of two, whichever is cheaper. A stream is
solved in stretches of about a million tokens: each ends at the cheapest cut
among its last ``length`` positions, where the next begins.

Edge cases: null and empty texts are documents of one end id; a text longer than
a sequence is cut like any other, however long (its ids are held at once, 4
bytes each); repeated rows and ties are documents of their own; of equally cheap
cuts the earliest is taken, so a task that runs again gives the same rows; an
empty table gives no rows; extra columns are ignored; a null doc_id is packed
like any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import encoder, flat_string, slices
from .common import texts

#: What cuts cost, in tokens of padding: after a document, after a sentence or line, elsewhere.
DOCUMENT, SENTENCE, INSIDE = 0, 8, 48
STRETCH = 1 << 20
#: More than any cost within a stretch; twice as much and any position still fit an int32.
FAR = np.int32(1 << 29)
CLOSING = "\"')]}»”’"


def half(length: int) -> int:
    """The largest power of two below the length."""
    return 1 << (length - 1).bit_length() - 1


def padding(n: int, length: int) -> int:
    return 0 if n & (n - 1) == 0 else length - n


def cheapest(penalty: np.ndarray, length: int) -> np.ndarray:
    """f(0) .. f(n): the cost of the cheapest windows that end with a cut at each position; FAR where none do. penalty[j] is that of a cut at j."""
    n, h = len(penalty) - 1, half(length)
    wide = length - h + 1
    step = min(h, wide)
    before = length  # positions before the first one, so that no slice begins below 0
    f = np.full(n + 1 + before, FAR, np.int32)
    queue = 2 * f  # f(i) + i
    f[before] = queue[before] = 0
    penalty = penalty.astype(np.int32)
    slope = np.arange(step, dtype=np.int32)
    older, newer = np.full(step + 1, 2 * FAR, np.int32), np.full(wide + 1, 2 * FAR, np.int32)
    for b in range(h, n + 1, step):
        e = min(b + step, n + 1)
        m = e - b
        v = queue[b - length + before : e - h + before]
        np.minimum.accumulate(v[m - 1 :: -1], out=older[m - 1 :: -1])
        older[m] = 2 * FAR
        np.minimum.accumulate(v[m:], out=newer[1:wide])
        block, own = np.minimum(older[:m], newer[wide - m : wide]), f[b + before : e + before]
        block -= slope[:m]
        block += length - b
        np.minimum(block, f[b - h + before : e - h + before], out=own)
        own += penalty[b:e]
        np.minimum(own, FAR, out=own)
        made = queue[b + before : e + before]
        np.add(own, slope[:m], out=made)
        made += b
        made[own == FAR] = 2 * FAR
    return f[before:]


def way_back(f: np.ndarray, penalty: np.ndarray, length: int, j: int) -> list[int]:
    """The cuts, in order, of the cheapest windows that end at j."""
    h, cuts = half(length), [j]
    while j:
        low = max(0, j - length)
        costs = f[low : j - h + 1].astype(np.int64) + (length - j + np.arange(low, j - h + 1))
        k = int(costs.argmin())
        j = j - h if f[j - h] < costs[k] else low + k
        cuts.append(j)
    return cuts[::-1]


def last_windows(penalty: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For the last positions, farthest first: the cost of covering what follows, and the length of the first window of that."""
    n = len(penalty) - 1
    span = min(n, length)
    powers = 1 << np.arange(length.bit_length())
    cost, first = np.zeros(span + 1, np.int64), np.zeros(span + 1, np.int64)  # by distance from the end
    for d in range(1, span + 1):
        p = powers[(powers <= d) & (powers <= length)]
        costs = cost[d - p] + np.where(p < d, penalty[n - d + p], 0)
        k = int(costs.argmin())
        cost[d], first[d] = costs[k], p[k]
        if padding(d, length) <= cost[d]:
            cost[d], first[d] = padding(d, length), d
    return cost[::-1], first[::-1]


def windows(penalty: np.ndarray, length: int, ends: bool = True) -> list[int]:
    """Cuts of a stream: all of it if it ends here, else up to the cheapest cut among the last positions."""
    n = len(penalty) - 1
    f = cheapest(penalty, length)
    low = n - min(n, length)
    if not ends:
        j = n - int(f[low:][::-1].argmin())
        return way_back(f, penalty, length, j)
    cost, first = last_windows(penalty, length)
    total = f[low:] + cost
    j = low + int(total.argmin())
    cuts = way_back(f, penalty, length, j)
    while cuts[-1] < n:
        cuts.append(cuts[-1] + int(first[cuts[-1] - low]))
    return cuts


class Boundaries:
    """Where sentences and lines end, by the ids of a token and the next."""

    def __init__(self, tokenizer):
        vocab = tokenizer.get_vocab()
        size = max(vocab.values(), default=0) + 2
        self.stops, self.line, self.opens = np.zeros(size, bool), np.zeros(size, bool), np.zeros(size, bool)
        for token, i in vocab.items():
            bare = token.removesuffix("</w>")
            self.line[i] = token.endswith("Ċ")
            self.stops[i] = bare.rstrip(CLOSING).endswith((".", "!", "?"))
            self.opens[i] = token.startswith(("Ġ", "▁"))
        if not self.opens.any():  # white space is dropped
            self.opens[:] = True

    def after(self, ids: np.ndarray) -> np.ndarray:
        """Does a sentence or line end after each token?"""
        known = np.minimum(ids, len(self.stops) - 1)
        out = self.line[known]
        out[:-1] |= self.stops[known[:-1]] & self.opens[known[1:]]
        return out


class Stream:
    """The documents of a task one after another; windows leave it as soon as they are settled."""

    def __init__(self, length: int, sequence: int, stretch: int = STRETCH):
        self.length, self.sequence, self.stretch = length, sequence, max(stretch, 64 * length)
        self.ids, self.penalty = np.zeros(0, np.uint32), np.zeros(0, np.int32)  # of the cut after each id
        self.docs, self.begins, self.tokens = [], np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, docs: list, ids: np.ndarray, penalty: np.ndarray, tokens: np.ndarray) -> Iterator[dict]:
        begins = len(self.ids) + np.cumsum(tokens) - tokens
        self.docs += docs
        self.begins, self.tokens = np.concatenate([self.begins, begins]), np.concatenate([self.tokens, tokens])
        self.ids, self.penalty = np.concatenate([self.ids, ids]), np.concatenate([self.penalty, penalty.astype(np.int32, copy=False)])
        while len(self.ids) >= self.stretch:
            yield self._settle(windows(self._padded(2 * self.stretch), self.length, ends=False))

    def rest(self) -> Iterator[dict]:
        if len(self.ids):
            yield self._settle(windows(self._padded(len(self.ids)), self.length))

    def _padded(self, most: int) -> np.ndarray:
        """Penalties of the cuts at 0, 1, ..."""
        return np.concatenate([np.zeros(1, np.int32), self.penalty[:most]])

    def _settle(self, cuts: list[int]) -> dict:
        cuts, end = np.array(cuts), cuts[-1]
        starts = np.union1d(cuts[:-1], self.begins[(self.begins >= 0) & (self.begins < end)])
        ends = np.append(starts[1:], end)
        doc, window = np.searchsorted(self.begins, starts, "right") - 1, np.searchsorted(cuts, starts, "right") - 1
        raw = memoryview(self.ids[:end].astype("<u4").tobytes())
        out = {
            "doc_id": [self.docs[k] for k in doc.tolist()], "start": starts - self.begins[doc], "length": ends - starts,
            "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)],
            "doc_tokens": self.tokens[doc], "sequence_id": self.sequence + window, "offset": starts - cuts[window],
        }
        self.sequence += len(cuts) - 1
        self.ids, self.penalty = self.ids[end:], self.penalty[end:]
        left = int(np.searchsorted(self.begins + self.tokens, end, "right"))
        self.docs, self.begins, self.tokens = self.docs[left:], self.begins[left:] - end, self.tokens[left:]
        return out


def pack_in_order(df: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text", sentence: int = SENTENCE, inside: int = INSIDE) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset; rows of a task in the order of its stream."""
    if length < 2:
        raise ValueError("a sequence needs at least two tokens")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        boundaries = Boundaries(own.tokenizer)
        stream = Stream(length, TaskContext.get().partitionId() << 40)
        for batch in batches:
            docs, column = batch.column(0), flat_string(batch.column(1))
            for a, b in slices(column):
                ids, offsets = own.ids(column.slice(a, b - a))
                penalty = np.where(boundaries.after(ids), np.int32(sentence), np.int32(inside))
                ids, penalty = np.insert(ids, offsets[1:], end_id), np.insert(penalty, offsets[1:], DOCUMENT)
                for made in stream.add(docs.slice(a, b - a).to_pylist(), ids, penalty, np.diff(offsets) + 1):
                    yield pa.RecordBatch.from_pydict(made, schema=schema)
        for made in stream.rest():
            yield pa.RecordBatch.from_pydict(made, schema=schema)

    out = texts(df, key, text).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("doc_id", key)
