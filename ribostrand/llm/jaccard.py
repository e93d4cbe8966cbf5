"""Exact n-gram Jaccard self-join by universe partitioning and the pigeonhole principle.

A document's set holds its distinct word n-grams as 64-bit hashes. For sets of
one size band with upper size u, linked sets differ in at most
H = floor(2 u (100 - t) / (100 + t)) elements, t being the threshold in per cent. Elements are
hashed into m = H + 1 + spare segments, so at least spare + 1 segments of two
linked sets are equal. Segments with at most ``LIGHT`` elements are cheap to
meet by chance (common passages, empty segments) and get no share of the
allocation: a pair one of whose sets has at most ``spare`` light segments meets
in a heavier one. Sets with more light segments than that also index
one-deletion neighbourhoods of further segments and their light segments, so
that no pair is lost. ``spare`` minimises the expected number of index entries
(a Poisson estimate of the light segments), the cost of an allocation.

A set is indexed in its own band and, if a larger partner may lie in the next
one, also there. Sets that are equal are one class, found by grouping on a
128-bit digest, so copies are never expanded. Sets that share fewer entries of a
band than any link needs are dropped.

Each member of an index entry is compared with one of the others, the hub,
which connects most of what is connected. Of the sets that still lie in entries
with several components no pairs are formed within entries either: linked sets
have so many elements in common that both have one among their first few in an
order of rising frequency, and only sets that meet in such prefixes are
compared. Elements in which too many meet get a hub of their own, and what each
member differs in from it is its delta. As |A d B| = |a d b| for the deltas a, b
of A and B (d: symmetric difference), two members link if and only if
e(A) + e(B) <= 2 (100 + t) |a n b| with e(A) = (100 + t) |a| - (100 - t) |A|.
Members that link with the hub are connected by it; of any other linked pair one
is far from the hub, so the deltas share an element of their prefixes too (the
far member's is the longer one). Large groups of near copies thereby meet in
what few of them share, not in what all have in common. That goes on level by
level; pairs left are verified exactly unless what follows the element in the two
deltas is too short for a link. At each level, entries whose members are
connected already go. Components are closed within tasks and, beyond what one
task holds, by distributed label propagation.

Nodes are rows: rows that share a key but not a set are nodes of their own, and
a component is named by the smallest key in it.

Edge cases: null and empty texts, and texts without words, have no elements and
link with nothing; texts with fewer words than n have the whole sequence as one
element; very long texts are handled by slices, only their sets are held whole;
repeated rows (same key, same text) are one class; ties go to the smaller key;
empty tables give empty results; extra columns are ignored (and kept, whatever
their names, by ``representatives``); a row with a null key is no node and gets
a null component.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import flat_string, release, slices
from .common import bitmap, discard, drop_shuffles, passes, small_batches, split_by_ids, stored, text_hash, texts

LIGHT = 1
#: Entries are met in 2**SHARE_BITS shares, by their first bits, one after the other: shuffle files of one share lie on disk at a time.
SHARE_BITS = 2
SHARES = [f"entries{k}" for k in range(1 << SHARE_BITS)]
#: Entries of deltas with at most FEW pairs for each member give pairs; others get hubs, for at most LEVELS levels.
FEW = 128
LEVELS = 2
#: Rows that a Python worker gets at once: texts and sets are wide.
BATCH = 512
#: So many links are contracted in one task.
LOCAL = 500_000
#: Frequencies that order elements are counted in 2**SKETCH_BITS counters, a constant.
SKETCH_BITS = 16
INDEX, PROBE = 1, 2
MULT = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words."""
    x = (x ^ (x >> np.uint64(32))) * STEP
    x = (x ^ (x >> np.uint64(32))) * STEP
    return x ^ (x >> np.uint64(32))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts in order, and the offsets of the texts. Words: [^\\x20\\x09-\\x0D]+, A-Z lower-cased."""
    lowered = pc.ascii_lower(column)
    for mark in "\t\n\x0b\x0c\r":
        lowered = pc.replace_substring(lowered, mark, " ")
    split = pc.split_pattern(lowered, " ")
    coded = pc.dictionary_encode(split.flatten())
    table = np.fromiter((xxhash.xxh64_intdigest(w) if w else 0 for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    codes, words = coded.indices.to_numpy(zero_copy_only=False), pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
    offsets = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
    real = words[codes] if len(codes) else np.zeros(0, bool)
    return table[codes[real]], np.concatenate([[0], np.cumsum(real)])[offsets]


def shingles(column: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    words, offsets = word_hashes(column)
    rolled = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        rolled = mixed(rolled * MULT + words[k : k + len(rolled)])
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= n:
            own = np.sort(rolled[a : b - n + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif b > a:
            h = np.array([b - a], np.uint64)
            for k in range(a, b):
                h = mixed(h * MULT + words[k : k + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@lru_cache(1 << 14)
def allocation(top: int, percent: int) -> tuple[int, int]:
    """(segments, spare) for sets of at most top elements."""
    need = 2 * top * (100 - percent) // (100 + percent) + 1
    if need == 1:
        return 1, 0
    best, cost = (need, 0), float("inf")
    for spare in range(need // 3 + 10):
        m = need + spare
        mean = 0.85 * top / m
        light = sum(math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1)) for k in range(LIGHT + 1))
        expected, spread = m * light, math.sqrt(m * light * (1 - light)) + 0.5
        tail = 0.5 * math.erfc((spare + 0.5 - expected) / spread / math.sqrt(2))
        now = m + tail * (2 * m + 50 * light * m)
        if now < cost:
            best, cost = (m, spare), now
    return best


def band_tops(size: int, percent: int) -> list[int]:
    """The upper sizes of the bands in which a set of that size is indexed."""
    tops, low = [], 1
    while True:
        top = max(low, low * 10000 // (percent * percent))
        if size <= top:
            tops.append(top)
            # a partner has at most size * 100 / percent elements
            if size * 100 // percent > top:
                low = top + 1
                tops.append(max(low, low * 10000 // (percent * percent)))
            return tops
        low = top + 1


_bands: dict[tuple[int, int], list[int]] = {}


def keys(elements: np.ndarray, percent: int) -> list[tuple[int, int, np.ndarray]]:
    """(band, need, index entries) of a set, for each band in which it is indexed.

    need: so many of the entries, at least, are shared with any linked set of
    the band. Of the m segments, at most as many differ as elements differ,
    and equal ones that are no entry are light ones of this set.
    """
    size, out = len(elements), []
    if not size:
        return out
    tops = _bands.get((size, percent))
    if tops is None:
        tops = _bands[size, percent] = band_tops(size, percent)
    for top in tops:
        m, spare = allocation(top, percent)
        salt = mixed(np.array([top * 2 + 1], np.uint64))[0]
        if m == 1:
            out.append((top, 1, np.array([mixed(np.array([np.bitwise_xor.reduce(mixed(elements + salt))]))[0]], np.uint64)))
            continue
        segment = ((mixed(elements ^ salt) >> np.uint64(33)) % np.uint64(m)).astype(np.int64)
        counts = np.bincount(segment, minlength=m)
        sums = np.zeros(m, np.uint64)
        values = mixed(elements + salt)
        np.add.at(sums, segment, values)
        names = mixed(np.arange(1, m + 1, dtype=np.uint64) * MULT + salt)
        heavy = counts > LIGHT
        found = [mixed(sums[heavy] + names[heavy] + counts[heavy].astype(np.uint64) * STEP)]
        light = m - int(heavy.sum())
        if light > spare:
            # no heavier segment need be equal: light ones are indexed too, with the others' one-deletion neighbourhoods
            found.append(mixed(sums[~heavy] + names[~heavy] + counts[~heavy].astype(np.uint64) * STEP))
            near = segment < min(m, 2 * light)
            less = mixed(sums[segment] - values + names[segment] + (counts[segment] - 1).astype(np.uint64) * STEP)
            found.append(less[near & (counts[segment] > LIGHT + 1)])
        largest = max(size, min(top, size * 100 // percent))
        differ = (100 - percent) * (size + largest) // (100 + percent)
        out.append((top, max(1, m - differ - light), np.unique(np.concatenate(found))))
    return out


def tidy(made: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task that gives memory back before and after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # what other operators' tasks left
        yield from made(batches)
        release()  # the next stages run in the JVM while this worker waits

    return run


def indexed(df: DataFrame, n: int, percent: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, t (hash of the text), n_shingles, h1, h2 (128-bit digest of the set, null if empty), and for its bands: band, need and, share by share, entries of the index, for each row."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(len(SHARES), dtype=np.uint64) << np.uint64(64 - SHARE_BITS)
        for batch in batches:
            column = flat_string(batch.column(1))
            for a, b in slices(column):
                sets = shingles(column.slice(a, b - a), n)
                digests = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8") if len(s) else (None, None) for s in sets]
                found = [keys(s, percent) for s in sets]
                flat = [x for bands in found for x in bands]
                outer = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32))
                # entries are sorted, so that those of a share lie together in each band
                bounds = np.array([[*np.searchsorted(x[2], edges), len(x[2])] for x in flat], np.int64).reshape(-1, len(SHARES) + 1)
                shares = []
                for k in range(len(SHARES)):
                    inner = np.concatenate([[0], np.cumsum(bounds[:, k + 1] - bounds[:, k])]).astype(np.int32)
                    own = np.concatenate([np.zeros(0, np.uint64), *(x[2][i:j] for x, i, j in zip(flat, bounds[:, k], bounds[:, k + 1], strict=True))])
                    shares.append(pa.ListArray.from_arrays(outer, pa.ListArray.from_arrays(pa.array(inner), pa.array(own.view(np.int64)))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64())]
                    + [pa.ListArray.from_arrays(outer, pa.array([x[i] for x in flat], pa.int64())) for i in (0, 1)]
                    + shares,
                    ["doc_id", "t", "n_shingles", "h1", "h2", "band", "need", *SHARES],
                )

    columns = ", ".join(f"{c} array<array<long>>" for c in SHARES)
    return texts(df, key, text).withColumn("t", F.xxhash64("text")).mapInArrow(tidy(made), f"doc_id long, t long, n_shingles long, h1 long, h2 long, band array<long>, need array<long>, {columns}")


def members(rows: DataFrame, share: str, bits: np.ndarray) -> DataFrame:
    """h1, h2, band, need, entry of a share's entries that pass the bitmap."""
    sent = rows.sparkSession.sparkContext.broadcast(bits)  # 4 MB, a constant

    def holder(lists: pa.ListArray, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(lists.offsets.to_numpy() - lists.offsets[0].as_py(), at, "right") - 1

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outer = batch.column(4)
            inner = outer.flatten()
            values = inner.flatten().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(passes(sent.value, values))
            band = holder(inner, at)
            row = pa.array(holder(outer, band))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(row) for i in (0, 1)), *(batch.column(i).flatten().take(pa.array(band)) for i in (2, 3)), pa.array(values[at])], ["h1", "h2", "band", "need", "entry"])

    return rows.select("h1", "h2", "band", "need", share).mapInArrow(tidy(made), "h1 long, h2 long, band long, need long, entry long")


def held_in(rows: DataFrame, heads: DataFrame, share: str) -> DataFrame:
    """entry, id, band, need: a share's entries with several holders; stored."""
    # hardly an entry occurs twice in a task: counts made before the shuffle would only take memory
    every = rows.select(F.explode(share).alias("e")).select(F.explode("e").alias("entry")).repartition("entry")
    # copies share all entries; they are told from others below
    shared = stored(every.groupBy("entry").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("entry"), "shared")
    drop_shuffles(rows.sparkSession)
    held = members(rows, share, bitmap(shared, "entry")).join(shared, "entry").distinct()
    out = stored(held.join(heads.select("h1", "h2", "id"), ["h1", "h2"]).select("entry", "id", "band", "need"), "held")
    discard(shared, shuffles=True)
    return out


def set_bytes(df: DataFrame, n: int, wanted: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, elements (sorted little-endian 64-bit hashes) of the rows wanted (doc_id, t, id; stored), one for each id."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = flat_string(batch.column(1))
            for a, b in slices(column):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([s.tobytes() for s in shingles(column.slice(a, b - a), n)], pa.binary())], ["id", "elements"])

    # texts are shuffled, once: hashes can't be compressed
    some = split_by_ids(texts(df, key, text), "doc_id", wanted, "doc_id")[0].withColumn("t", F.xxhash64("text"))
    once = some.repartition("doc_id", "t").dropDuplicates(["doc_id", "t"])
    return once.join(wanted, ["doc_id", "t"]).select("id", "text").mapInArrow(tidy(made), "id long, elements binary")


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Elements in both of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def sketch(sets: DataFrame) -> np.ndarray:
    """How often elements occur, summed by the low bits of their hashes: an order that puts frequent elements last, nothing more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                sums += np.bincount((np.frombuffer(raw.as_buffer(), np.uint64) & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64), minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["bucket", "n"])

    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in sets.select("elements").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[r["bucket"]] = r["n"]
    return out


def prefixes(a: np.ndarray, h: np.ndarray, percent: int, seen: np.ndarray) -> tuple[np.ndarray, int, int, int]:
    """Of a set and its hub: (its delta, rarest elements first, e, length of the prefix to be met, length of the prefix that meets).

    A set that links with the hub is only met. The delta's order is the same
    for all sets of a hub: elements that are not the hub's by rising frequency,
    then those of the hub that are missing, by falling frequency.
    """
    more, less = a[~present(a, h)], h[~present(h, a)]
    up, down = 100 + percent, 100 - percent
    e = up * (len(more) + len(less)) - down * len(a)
    bound = down * len(h)  # e beyond it: no link with the hub
    mask = np.uint64((1 << SKETCH_BITS) - 1)
    more = more[np.lexsort((more, seen[(more & mask).astype(np.int64)]))]
    less = less[np.lexsort((less, -seen[(less & mask).astype(np.int64)]))]
    delta = np.concatenate([more, less])
    both = max(1, -((-e - max(e, bound + 1)) // (2 * up)))
    met = max(0, len(delta) - both + 1)
    meets = max(0, len(delta) - max(1, -((bound - e) // 200)) + 1) if e > bound else 0
    return delta, e, met, meets


def present(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which elements of a sorted array are in another sorted one."""
    if not len(b):
        return np.zeros(len(a), bool)
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return b[at] == a


def compared(pairs: DataFrame, sets: DataFrame, percent: int, seen: np.ndarray | None = None) -> DataFrame:
    """pairs: id, hub, wide. Stored. Of each linked pair a row id, hub; with seen, of the wide ones also rows element, e, cap, role: the prefixes of their deltas. cap: a partner with a larger e has too little in common from this element on."""
    sent = None if seen is None else sets.sparkSession.sparkContext.broadcast(seen)  # a counter a bucket
    schema = pa.schema([("id", pa.int64()), ("hub", pa.int64()), ("element", pa.int64()), ("e", pa.int64()), ("cap", pa.int64()), ("role", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links, out, size = [], [], 0

            def rows() -> pa.RecordBatch:
                first = [(np.array([p[i] for p in links], np.int64)) for i in (0, 1)]
                blank = pa.nulls(len(links), pa.int64())
                columns = [pa.array(np.concatenate([f, *(c[i] for c in out)])) for i, f in enumerate(first)]
                columns += [pa.concat_arrays([blank.cast(f.type), pa.array(np.concatenate([np.zeros(0, np.int64), *(c[i] for c in out)]), f.type)]) for i, f in enumerate(schema) if i > 1]
                return pa.RecordBatch.from_arrays(columns, schema=schema)

            for x, h, wide, a, b in zip(*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)), batch.column(3), batch.column(4), strict=True):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = common(a, b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    links.append((x, h))
                if wide and sent is not None:
                    delta, e, met, meets = prefixes(a, b, percent, sent.value)
                    n = max(met, meets)
                    role = np.where(np.arange(n) < met, INDEX, 0) + np.where(np.arange(n) < meets, PROBE, 0)
                    cap = 2 * (100 + percent) * (len(delta) - np.arange(n)) - e
                    out.append((np.full(n, x), np.full(n, h), delta[:n].view(np.int64), np.full(n, e), cap, role))
                    size += n
                if size > 1 << 18:
                    yield rows()
                    links, out, size = [], [], 0
            if links or out:
                yield rows()

    # only sets that occur in pairs are shuffled
    pairs = stored(pairs, "candidates")
    left, right = (split_by_ids(sets, "id", pairs, c)[0] for c in ("id", "hub"))
    both = pairs.join(left.select("id", F.col("elements").alias("a")), "id").join(right.select(F.col("id").alias("hub"), F.col("elements").alias("b")), "hub")
    out = stored(both.select("id", "hub", "wide", "a", "b").mapInArrow(run, "id long, hub long, element long, e long, cap long, role int"), "compared")
    discard(pairs)
    return out


def contracted(links: DataFrame) -> DataFrame:
    """x, y: the nodes of each partition's links with the smallest node of their component in that partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(x), root(y)
                up[max(a, b)] = min(a, b)
        rows = [(x, y) for x in up if (y := root(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["x", "y"])

    return links.select("x", "y").mapInArrow(run, "x long, y long")


def components(links: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """id, component (the smallest id reachable) of the ids in links that are not the smallest of theirs.

    Links are contracted within tasks of about LOCAL links; as long as there
    are more than that, alternating star contraction shuffles them in between.
    """
    links = stored(contracted(links.select(F.col(x).alias("x"), F.col(y).alias("y"))), "links")
    sign = F.count(F.lit(1)), F.bit_xor(F.xxhash64("x", "y")), F.sum(F.xxhash64("y", "x") % 1000003)
    now, before = tuple(links.agg(*sign).first()), None
    while now != before and now[0] > LOCAL:
        # large star: the neighbours above a node point to the least one around it
        both = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        large, before_ = stored(large, "links"), links
        # small star: a node and its neighbours below point to the least of them
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        links = stored(small.unionByName(least.select("x", F.col("m").alias("y"))).distinct(), "links")
        discard(large, before_)
        now, before = tuple(links.agg(*sign).first()), now
    if now != before and now[0]:
        links, before_ = stored(contracted(links.coalesce(1)), "links"), links  # at most LOCAL links
        discard(before_)
    return links.select(F.col("x").alias("id"), F.col("y").alias("component"))


def open_entries(index: DataFrame, found: DataFrame) -> DataFrame:
    """The index (entry, id, band, need) with components, without entries whose members are connected, and without sets that share too few of the other entries for a link."""
    named = index.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed_ = named.groupBy("entry").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("entry")
    rest = stored(named.join(mixed_, "entry").select("entry", "id", "band", "need", "component"), "open")
    enough = rest.groupBy("id", "band").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("least")).where("n >= least").select("id", "band", "n")
    out = stored(rest.join(enough, ["id", "band"]), "open")
    discard(rest)
    return out


def hubs_of(rows: DataFrame) -> DataFrame:
    """entry, hub, hub_component: the member that comes first in rows (entry, id, order, component)."""
    best = rows.groupBy("entry").agg(F.min_by(F.struct("id", "component"), F.struct("order", "id")).alias("h"))
    return best.select("entry", F.col("h.id").alias("hub"), F.col("h.component").alias("hub_component"))


def best_hubs(rest: DataFrame) -> DataFrame:
    """id, hub, wide: each member with the one hub with which it shares most entries, if they are as many as a link needs."""
    rows = rest.withColumn("order", -F.col("n"))
    shared = rows.join(hubs_of(rows), "entry").where("component <> hub_component").groupBy("id", "hub").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need")).where("n >= need")
    return shared.groupBy("id").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("hub")).withColumn("wide", F.lit(False))


def own_prefixes(sets: DataFrame, percent: int, seen: np.ndarray) -> DataFrame:
    """entry, id, e, cap, role: the sets' own prefixes (their deltas to the empty set, whose hub nothing links with)."""
    sent = sets.sparkSession.sparkContext.broadcast(seen)  # a counter a bucket
    empty = np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for x, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                delta, e, met, meets = prefixes(np.frombuffer(raw.as_buffer(), np.uint64), empty, percent, sent.value)
                at = np.arange(max(met, meets))
                out.append((delta[at].view(np.int64), np.full(len(at), x), np.full(len(at), e), 2 * (100 + percent) * (len(delta) - at) - e, np.where(at < met, INDEX, 0) + np.where(at < meets, PROBE, 0)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.int32()], strict=True)], ["entry", "id", "e", "cap", "role"])

    return sets.select("id", "elements").mapInArrow(run, "entry long, id long, e long, cap long, role int")


def all_hubs(rows: DataFrame) -> DataFrame:
    """id, hub: each member with the hubs of all its entries."""
    return rows.join(hubs_of(rows), "entry").where("id <> hub").select("id", "hub").distinct()


def with_width(pairs: DataFrame) -> DataFrame:
    """Adds wide: does the hub have other members too?"""
    several = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).select("hub", (F.col("n") > 1).alias("wide"))
    return pairs.join(several, "hub").select("id", "hub", "wide")


def live(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Of rows (entry, id, e, cap, role) those that can have a partner in their entry, by role, cap and component; adds component and few: are there at most FEW pairs for each row of the entry?"""
    met, meets = F.col("role").bitwiseAND(INDEX) > 0, F.col("role").bitwiseAND(PROBE) > 0
    open_ = rows.groupBy("entry").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(met, F.col("cap"))).alias("of_met"), F.max(F.when(meets, F.col("cap"))).alias("of_meets")).where("n > 1 and of_met is not null and of_meets is not null")
    role = F.when(met & (F.col("e") <= F.col("of_meets")), INDEX).otherwise(0) + F.when(meets & (F.col("e") <= F.col("of_met")), PROBE).otherwise(0)
    able = rows.join(open_, "entry").withColumn("role", role).where("role > 0").select("entry", "id", "e", "cap", "role")
    named = stored(able.join(found, "id", "left").withColumn("component", F.coalesce("component", "id")), "met")
    both = named.groupBy("entry").agg(F.count(F.lit(1)).alias("n"), F.sum(met.cast("long")).alias("i"), F.sum(meets.cast("long")).alias("p"), F.min("component").alias("a"), F.max("component").alias("b"))
    several = both.where("a < b and i > 0 and p > 0").select("entry", (F.col("i") * F.col("p") <= FEW * F.col("n")).alias("few"))
    out = stored(named.join(several, "entry").select("entry", "id", "e", "cap", "role", "few", "component"), "live")
    discard(named)
    return out


def meeting(rows: DataFrame) -> DataFrame:
    """id, hub, wide: the pairs of rows (entry, id, e, cap, role, component) that may link; at most FEW for each row of the entries with few."""
    met = rows.where(F.col("role").bitwiseAND(INDEX) > 0).select("entry", F.col("id").alias("hub"), F.col("e").alias("hub_e"), F.col("cap").alias("hub_cap"), F.col("component").alias("hub_component"))
    meets = rows.where(F.col("role").bitwiseAND(PROBE) > 0).select("entry", "id", "e", "cap", "component")
    either = (F.col("component") != F.col("hub_component")) & ((F.col("e") > F.col("hub_e")) | ((F.col("e") == F.col("hub_e")) & (F.col("id") > F.col("hub"))))
    return meets.join(met, "entry").where(either & (F.col("e") <= F.col("hub_cap")) & (F.col("hub_e") <= F.col("cap"))).select("id", "hub").distinct().withColumn("wide", F.lit(False))


def connected(index: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """id, component of the linked ids of an index of open entries (entry, id, band, need, component, n); ids that name a component are left out."""

    def linked(out: DataFrame) -> DataFrame:
        return out.where("role is null").select("id", "hub")

    # first one partner for each member: it connects most of what is connected
    out = compared(best_hubs(index), sets, percent)
    found = components(linked(out), "id", "hub")
    discard(out, shuffles=True)
    rest = open_entries(index.select("entry", "id", "band", "need"), found)
    if rest.isEmpty():
        return found
    discard(rest, shuffles=True)
    seen = sketch(sets)
    rest = live(own_prefixes(sets, percent, seen), found)
    for level in range(LEVELS + 1):
        out = compared(meeting(rest if level == LEVELS else rest.where("few")), sets, percent)
        found = merged(found, linked(out))
        discard(out, shuffles=True)
        rows = rest.where("not few").select("entry", "id", "component", F.col("e").alias("order"))
        if level == LEVELS or rows.isEmpty():
            break
        pairs = stored(all_hubs(rows), "hubs")
        out = compared(with_width(pairs), sets, percent, seen)
        discard(rest, pairs)
        found = merged(found, linked(out))
        rest = live(out.where("role is not null").select(F.xxhash64("hub", "element").alias("entry"), "id", "e", "cap", "role"), found)
        discard(out, shuffles=True)
    discard(rest)
    return found


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components of what is connected already and of new links (id, hub)."""
    if links.isEmpty():
        return found
    return components(found.select("id", F.col("component").alias("hub")).unionByName(links), "id", "hub")


def classes(df: DataFrame, n: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: doc_id, t (hash of the text), n_shingles, component_id; stored."""
    with small_batches(df.sparkSession, BATCH):
        return _classes(df, n, percent, key, text)


def _classes(df: DataFrame, n: int, percent: int, key: str, text: str) -> DataFrame:
    rows = stored(indexed(df, n, percent, key, text), "indexed")
    small = stored(rows.select("doc_id", "t", "n_shingles", "h1", "h2"), "classes")
    heads = small.where("h1 is not null and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.min_by("t", "doc_id").alias("first_t"))
    heads = stored(heads.withColumn("id", F.monotonically_increasing_id()), "heads")
    held = [held_in(rows, heads, share) for share in SHARES]
    discard(rows)
    index = open_entries(reduce(DataFrame.unionByName, held), df.sparkSession.createDataFrame([], "id long, component long"))
    discard(*held)
    wanted = stored(index.select("id").distinct().join(heads, "id").select("id", F.col("first").alias("doc_id"), F.col("first_t").alias("t")), "wanted")
    drop_shuffles(df.sparkSession)
    sets = stored(set_bytes(df, n, wanted, key, text), "sets")
    discard(wanted, shuffles=True)
    found = connected(index, sets, percent)
    # components are named by the smallest key in them
    roots = found.select(F.col("component").alias("id"), "component").distinct()
    joined = found.unionByName(roots).join(heads, "id").select("h1", "h2", "first", "component")
    least = joined.groupBy("component").agg(F.min("first").alias("least"))
    named = heads.select("h1", "h2", "first").join(joined.join(least, "component").select("h1", "h2", "least"), ["h1", "h2"], "left").select("h1", "h2", F.coalesce("least", "first").alias("component"))
    full = small.where("h1 is not null and doc_id is not null").join(named, ["h1", "h2"]).select("doc_id", "t", "n_shingles", F.col("component").alias("component_id"))
    alone = small.where("h1 is null or doc_id is null").select("doc_id", "t", "n_shingles", F.col("doc_id").alias("component_id"))
    out = stored(full.unionByName(alone), "components")
    discard(small, heads, sets, index, shuffles=True)
    return out


def jaccard_components(df: DataFrame, n: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: key, n_shingles, component_id (the smallest key reachable by links)."""
    return classes(df, n, percent, key, text).select(F.col("doc_id").alias(key), "n_shingles", "component_id")


def representatives(df: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df, with all columns, without all but one of each component: a row of its smallest key stays, among several the one whose text has the smallest hash."""
    rows = classes(df, n, percent, key, text).where("n_shingles > 0 and doc_id is not null")
    others = rows.where("doc_id <> component_id").select("doc_id", "t", F.lit(False).alias("first"))
    # several rows of the key that names a component: one of them stays
    several = rows.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("least")).where("n > 1").select("doc_id", "least")
    again = rows.where("doc_id = component_id").join(several, "doc_id").select("doc_id", "t", (F.col("t") == F.col("least")).alias("first"))
    gone = stored(others.unionByName(again).distinct(), "gone")
    some, rest = split_by_ids(df, key, gone, "doc_id")
    names = df.columns
    marked = some.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(key).cast("long").alias("doc_id"), text_hash(text).alias("t")).join(gone, ["doc_id", "t"], "left")
    kept = marked.where("first is null").select("row.*")
    if not again.isEmpty():
        once = marked.where("first").withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "t").orderBy(F.lit(0))))
        kept = kept.unionByName(once.where("copy = 1").select("row.*"))
    return rest.unionByName(kept)
