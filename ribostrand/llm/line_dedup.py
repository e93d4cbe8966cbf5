"""Line dedup by a suffix array over line-ID sequences.

The corpus is one sequence of lines, in the order of doc_id. A run of whole
consecutive lines of a document with at least ``min_words`` words that also
starts at an earlier place is a later copy, and its lines are deleted; what
remains is the first copy of every repeated run.

1. Lines get a 128-bit digest; digests that occur once end every repeated run.
   Maximal stretches of repeated lines with at least ``min_words`` words form the
   sequence; no other line can be deleted.
2. Distributed prefix doubling ranks the suffixes of these stretches: round k
   ranks by the pair (rank at p, rank at p + 2**k). Equal pairs are summed
   before anything is sorted, the distinct pairs are range-partitioned, and
   offsets of the partitions (a few numbers each) complete the ranks. Suffixes
   that are alone, or equal to the end of their stretch, leave the rounds.
3. Longest common prefixes of neighbours in the suffix array follow from the
   stored ranks of all rounds, from the longest power of two down.
4. Each suffix looks up its LCP intervals: the longest prefix it shares with a
   suffix at an earlier place. Partitions of the suffix array do this by a
   stack; what reaches over a partition's border is a short list (one entry for
   each distinct prefix length at the border) that the driver chains.

No step gathers a group: hot lines are summed first, joins on hot ranks are
split by AQE.

Edge cases: null and empty texts have no words and stay as they are (null
becomes empty); rows with equal doc_id come in the order of their texts'
digests, and equal rows are copies of each other; a null doc_id sorts first;
a document whose lines are all deleted gets an empty text; empty tables give
empty results; extra columns are kept by ``dedup_lines``, whatever their names
(but for its two counts), and ignored by ``deleted_lines``; a very long text is
one row of line digests.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import flat_string
from .common import fresh, split_by_ids, stored, with_fields

MIN_WORDS = 40
WORD = re.compile(r"\S+")


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def text_key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def line_table(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, h (digest of the text), lines (16-byte digest of each line), words (of each line); a row for each row of df."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("lines", pa.list_(pa.binary())), ("words", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                all_texts = flat_string(part.column(1)).to_pylist()
                lines = [x.split("\n") for x in all_texts]
                yield _batch([part.column(0), [text_key(x) for x in all_texts], [[hashlib.md5(x.encode()).digest() for x in ls] for ls in lines], [[len(x.split()) for x in ls] for ls in lines]], schema)

    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, h long, lines array<binary>, words array<int>")


def _numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Range-partition and sort by order; adds part, the number of the partition, and place, the row's number in it."""
    fields = with_fields(df, "part int, place long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = len(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen, seen + n))], names=[*batch.schema.names, "part", "place"])
            seen += n

    return stored(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, fields), name)


def _offsets(df: DataFrame, size: str, name: str) -> DataFrame:
    """For each part, the sum of the sizes of the parts before it; a row for each partition."""
    spark = df.sparkSession
    total, rows = 0, []
    for r in sorted(df.groupBy("part").agg(F.sum(size).alias("n")).collect()):
        rows.append((r["part"], total))
        total += r["n"]
    return F.broadcast(spark.createDataFrame(rows, f"part int, {name} long"))  # a row for each partition


def stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """Maximal stretches of repeated lines with enough words: doc_id, h, copy, first (line number), ids (array of digests), words; in corpus order with p, the place of the first line."""
    lines = stored(lines, "lines")
    if lines.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        lines = lines.withColumn("copy", F.lit(0))
    else:
        own = Window.partitionBy("doc_id", "h").orderBy(F.lit(0))
        lines = stored(lines.withColumn("copy", F.row_number().over(own) - 1), "lines")
    repeated = lines.select(F.explode("lines").alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("line")
    enough = F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + w) >= min_words
    each = lines.where(enough).select("doc_id", "h", "copy", F.posexplode("lines").alias("i", "line"), "words").select("doc_id", "h", "copy", "i", "line", F.element_at("words", F.col("i") + 1).alias("w"))
    hits = each.join(repeated, "line").groupBy("doc_id", "h", "copy").agg(F.sort_array(F.collect_list(F.struct("i", "line", "w"))).alias("hits"))
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("copy", pa.int32()), ("first", pa.int32()), ("ids", pa.list_(pa.binary())), ("words", pa.list_(pa.int32())), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                at = 0
                while at < len(row["hits"]):
                    end = at + 1
                    while end < len(row["hits"]) and row["hits"][end]["i"] == row["hits"][end - 1]["i"] + 1:
                        end += 1
                    part = row["hits"][at:end]
                    if sum(x["w"] for x in part) >= min_words:
                        out.append((row["doc_id"], row["h"], row["copy"], part[0]["i"], [x["line"] for x in part], [x["w"] for x in part], len(part)))
                    at = end
            if out:
                yield _batch(list(zip(*out, strict=True)), schema)

    found = hits.mapInArrow(run, "doc_id long, h long, copy int, first int, ids array<binary>, words array<int>, n long")
    numbered = _numbered(found, ["doc_id", "h", "copy", "first"], "stretches")
    before = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return stored(numbered.withColumn("inner", F.coalesce(F.sum("n").over(before), F.lit(0))).join(_offsets(numbered, "n", "outer"), "part").withColumn("p", F.col("inner") + F.col("outer")).drop("inner", "outer", "place", "part"), "placed")


def named(pairs: DataFrame, name: str) -> DataFrame:
    """pairs: r, s, n (distinct (r, s), n suffixes each) -> r, s, n, rank = r + the number of suffixes of the same r with a smaller s."""
    fields = "r long, s long, n long, off long, part int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, size = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            r, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            if not len(r):
                continue
            sums = np.concatenate([[0], np.cumsum(n)])
            starts = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
            base = np.repeat(sums[starts], np.diff(np.append(starts, len(r))))
            off = sums[:-1] - base
            if r[0] == last:
                off[r == last] += size
            last, size = r[-1], off[-1] + n[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(off), pa.array(np.full(len(r), part, np.int32))], ["r", "s", "n", "off", "part"])

    spark = pairs.sparkSession
    sorted_ = stored(pairs.select("r", "s", "n").repartitionByRange("r", "s").sortWithinPartitions("r", "s").mapInArrow(run, fields), name)
    parts = sorted_.groupBy("part").agg(F.min("r").alias("a"), F.max("r").alias("b"), F.max_by(F.col("off") + F.col("n"), F.struct("r", "s")).alias("size")).orderBy("part").collect()
    carried, rows, last = 0, [], None
    for x in parts:
        carried = carried if x["a"] == last else 0
        rows.append((x["part"], x["a"], carried))
        carried = x["size"] + (carried if x["a"] == x["b"] else 0)
        last = x["b"]
    carries = F.broadcast(spark.createDataFrame(rows, "part int, a long, carry long"))  # a row for each partition
    return sorted_.join(carries, "part").select("r", "s", "n", (F.col("r") + F.col("off") + F.when(F.col("r") == F.col("a"), F.col("carry")).otherwise(0)).alias("rank"))


def suffix_ranks(placed: DataFrame) -> list[DataFrame]:
    """Levels 0, 1, ...: p, r (rank by the first 2**level lines, suffixes of lower rank counted), rem (lines to the end of the stretch); the last ranks whole suffixes."""
    lines = placed.select("p", "n", F.posexplode("ids").alias("i", "line")).select((F.col("p") + F.col("i")).alias("p"), (F.col("n") - F.col("i")).alias("rem"), "line")
    lines = stored(lines, "positions")
    counts = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    ids = _numbered(counts, ["line"], "line-ids")
    before = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    ids = ids.withColumn("inner", F.coalesce(F.sum("n").over(before), F.lit(0))).join(_offsets(ids, "n", "outer"), "part").select("line", "n", (F.col("inner") + F.col("outer")).alias("r"))
    level = stored(lines.join(ids, "line").select("p", "r", "rem", (F.col("n") == 1).alias("done")), "level")
    levels, k = [level], 0
    while not level.where("not done").isEmpty():
        ahead = 1 << k
        active = level.where("not done")
        following = level.select((F.col("p") - ahead).alias("p"), F.col("r").alias("following"))
        inner = active.where(F.col("rem") > ahead).join(following, "p").select("p", "r", "rem", F.col("following").alias("s"))
        paired = stored(inner.unionByName(active.where(F.col("rem") <= ahead).select("p", "r", "rem", F.lit(-1).cast("long").alias("s"))), "paired")
        ranks = named(paired.groupBy("r", "s").agg(F.count(F.lit(1)).alias("n")), "pairs")
        renamed = paired.join(ranks, ["r", "s"]).select("p", F.col("rank").alias("r"), "rem", ((F.col("n") == 1) | (F.col("s") == -1)).alias("done"))
        level = stored(level.where("done").unionByName(renamed), "level")
        levels.append(level)
        k += 1
    return levels


def neighbours(levels: list[DataFrame]) -> DataFrame:
    """Distinct suffixes in the order of the suffix array: r, p (the earliest place), lcp (lines shared with the suffix before), part and place."""
    distinct = levels[-1].groupBy("r").agg(F.min("p").alias("p"))
    ordered = _numbered(distinct, ["r"], "suffix-array")
    ends = [(r["part"] + 0, r["q"]) for r in ordered.groupBy("part").agg(F.max_by("p", "place").alias("q")).orderBy("part").collect()]
    firsts = [(part, ends[i - 1][1] if i else None) for i, (part, _) in enumerate(ends)]
    borders = F.broadcast(ordered.sparkSession.createDataFrame(firsts, "part int, border long"))  # a row for each partition
    previous = F.lag("p").over(Window.partitionBy("part").orderBy("place"))
    pairs = ordered.withColumn("before", previous).join(borders, "part").withColumn("q", F.coalesce("before", "border"))
    pairs = stored(pairs.select("part", "place", "p", "q", F.when(F.col("q").isNull(), -1).otherwise(0).cast("long").alias("o")), "neighbours")
    whole = pairs
    for k in reversed(range(len(levels) - 1 if len(levels) > 1 else 1)):
        level = levels[k].select("p", "r", "rem")
        left = level.select(F.col("p").alias("x"), F.col("r").alias("rx"), F.col("rem").alias("mx"))
        right = level.select(F.col("p").alias("y"), F.col("r").alias("ry"), F.col("rem").alias("my"))
        # o < 0: no suffix before; a stretch that has ended cannot go on
        both = whole.where("o >= 0").withColumn("x", F.col("p") + F.col("o")).withColumn("y", F.col("q") + F.col("o")).join(left, "x").join(right, "y")
        step = F.when(F.col("rx") == F.col("ry"), F.least(F.lit(1 << k).cast("long"), "mx", "my")).otherwise(0)
        ended = (F.col("rx") == F.col("ry")) & ((F.col("mx") <= (1 << k)) | (F.col("my") <= (1 << k)))
        moved = both.select("part", "place", "p", "q", F.when(ended, -2 - (F.col("o") + step)).otherwise(F.col("o") + step).alias("o"))
        whole = stored(moved.unionByName(whole.where("o < 0")), "lcp")
    return whole.select("part", "place", "p", F.when(F.col("o") == -1, 0).when(F.col("o") < -1, -2 - F.col("o")).otherwise(F.col("o")).alias("lcp"))


def earlier_lengths(places: np.ndarray, lcps: np.ndarray, context: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """One sweep in the given order. lcps[i]: lines that i shares with i - 1.

    context and the returned stack hold (place, lines shared with all up to
    here), places rising; of equal lengths only the smallest place counts.
    """
    stack, best = list(context), np.zeros(len(places), np.int64)
    for i, (p, lcp) in enumerate(zip(places.tolist(), lcps.tolist(), strict=True)):
        cut = None
        while stack and stack[-1][1] >= lcp:
            cut = stack.pop()[0]
        if lcp and cut is not None:
            stack.append((cut, lcp))
        while stack and stack[-1][0] > p:
            stack.pop()
        if stack:
            best[i] = stack[-1][1]
        stack.append((p, 1 << 60))
    return best, stack


def _sweep(part: pa.Table, context: list[tuple[int, int]], back: bool, after: int) -> tuple[np.ndarray, list, int]:
    """Lengths of a part in order of place, its final stack and its least lcp. after: the lcp of the first row of the next part."""
    places, lcps = part.column("p").to_numpy(), part.column("lcp").to_numpy()
    if back:
        places, lcps = places[::-1], np.append(lcps[1:], after)[::-1]
    best, stack = earlier_lengths(places, lcps, context)
    return best[::-1] if back else best, stack, int(lcps.min()) if len(lcps) else 1 << 60


def longest_earlier(suffixes: DataFrame) -> DataFrame:
    """p, length: the lines that the suffix at p shares with a suffix at an earlier place, as many as possible."""
    spark = suffixes.sparkSession
    firsts = {r["part"]: r["lcp"] for r in suffixes.where("place = 0").select("part", "lcp").collect()}
    order = sorted(firsts)
    after = {part: firsts[order[i + 1]] if i + 1 < len(order) else 0 for i, part in enumerate(order)}

    def summary(_, part: pa.Table) -> pa.Table:
        part = part.sort_by("place")
        own, rows = part.column("part")[0].as_py(), []
        for back in (False, True):
            _, stack, least = _sweep(part, [], back, after[own])
            rows += [(own, back, p, m, least) for p, m in stack]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["part", "back", "p", "m", "least"])

    found = suffixes.groupBy("part").applyInArrow(lambda key, t: summary(key, t), "part int, back boolean, p long, m long, least long").collect()
    stacks: dict[tuple[int, bool], list] = {}
    least: dict[tuple[int, bool], int] = {}
    for r in found:
        stacks.setdefault((r["part"], r["back"]), []).append((r["p"], r["m"]))
        least[r["part"], r["back"]] = r["least"]
    contexts: dict[tuple[int, bool], list] = {}
    for back in (False, True):
        context: list[tuple[int, int]] = []
        for part in reversed(order) if back else order:
            contexts[part, back] = context
            own = sorted(stacks[part, back])
            merged = [(p, min(m, least[part, back])) for p, m in context if p < own[0][0] and least[part, back] > 0] + own
            lowest: dict[int, int] = {}
            for p, m in merged:
                lowest[m] = min(p, lowest.get(m, p))
            context = sorted((p, m) for m, p in lowest.items())

    def solve(_, part: pa.Table) -> pa.Table:
        part = part.sort_by("place")
        own = part.column("part")[0].as_py()
        a, b = (_sweep(part, contexts[own, back], back, after[own])[0] for back in (False, True))
        return pa.table({"p": part.column("p"), "length": pa.array(np.maximum(a, b))})

    return stored(suffixes.groupBy("part").applyInArrow(lambda key, t: solve(key, t), "p long, length long"), "lengths") if order else spark.createDataFrame([], "p long, length long")


def deleted_lines(df: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, h, copy, deleted (line numbers): the rows of which lines are deleted."""
    placed = stretches(line_table(df, key, text), min_words)
    levels = suffix_ranks(placed)
    final = levels[-1]
    lengths = longest_earlier(neighbours(levels))
    firsts = final.groupBy("r").agg(F.min("p").alias("earliest"))
    # a suffix equal to one at an earlier place shares all its lines with it
    shared = final.join(firsts, "r").join(lengths, "p", "left").select("p", F.when(F.col("p") > F.col("earliest"), F.col("rem")).otherwise(F.coalesce("length", F.lit(0))).alias("length")).where("length > 0")
    each = placed.select(F.col("p").alias("start"), F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("i")).select("start", "i", (F.col("start") + F.col("i")).alias("p"))
    runs = each.join(shared, "p").groupBy("start").agg(F.collect_list(F.struct("i", "length")).alias("runs"))
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("copy", pa.int32()), ("deleted", pa.list_(pa.int32()))])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                sums = np.concatenate([[0], np.cumsum(row["words"])])
                cover = np.zeros(len(sums), np.int64)
                for x in row["runs"]:
                    a, b = x["i"], x["i"] + x["length"]
                    if sums[b] - sums[a] >= min_words:
                        cover[a] += 1
                        cover[b] -= 1
                at = np.flatnonzero(np.cumsum(cover)[:-1] > 0) + row["first"]
                if len(at):
                    out.append((row["doc_id"], row["h"], row["copy"], at))
            if out:
                yield _batch(list(zip(*out, strict=True)), schema)

    joined = placed.select(F.col("p").alias("start"), "doc_id", "h", "copy", "first", "words").join(runs, "start").select("doc_id", "h", "copy", "first", "words", "runs")
    parts = joined.mapInArrow(mark, "doc_id long, h long, copy int, deleted array<int>")
    return parts.groupBy("doc_id", "h", "copy").agg(F.flatten(F.collect_list("deleted")).alias("deleted"))


def dedup_lines(df: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text", counts: tuple[str, str] = ("n_lines", "n_deleted")) -> DataFrame:
    """All rows and columns of df, the text without its deleted lines, and the counts n_lines, n_deleted (int), which replace columns of df with their names."""
    df = df.drop(*counts)
    found = stored(deleted_lines(df, min_words, key, text), "deleted")
    of, doc, copy, gone = (fresh(df, name) for name in ("_of", "_doc", "_copy", "_deleted"))
    deleted = found.groupBy(F.col("doc_id").alias(of)).agg(F.collect_list(F.struct("h", "copy", "deleted")).alias(gone))
    # texts of which nothing is deleted are not moved
    some, rest = split_by_ids(df.withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit(""))), key, found, "doc_id")
    rows = some.withColumn(doc, F.col(key).cast("long")).withColumn(copy, F.lit(0))
    if not found.where("copy > 0").isEmpty():
        # equal rows: which of them is the first copy makes no difference
        rows = rows.withColumn(copy, F.row_number().over(Window.partitionBy(doc, F.xxhash64(text)).orderBy(F.lit(0))) - 1)
    names, at = df.columns, df.columns.index(text)
    schema = with_fields(df, f"`{counts[0]}` int, `{counts[1]}` int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, marks, copies = flat_string(batch.column(text)).to_pylist(), batch.column(gone).to_pylist(), batch.column(copy).to_pylist()
            n_lines, n_deleted = [], []
            for i, (whole, mark, number) in enumerate(zip(every, marks, copies, strict=True)):
                h = text_key(whole) if mark else 0
                off = next((set(m["deleted"]) for m in mark or () if m["h"] == h and m["copy"] == number), ())
                lines = whole.split("\n")
                if off:
                    every[i] = "\n".join(x for k, x in enumerate(lines) if k not in off)
                n_lines.append(len(lines))
                n_deleted.append(len(off))
            columns = [batch.column(c) for c in names]
            columns[at] = pa.array(every, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int32()), pa.array(n_deleted, pa.int32())], names=[*names, *counts])

    changed = rows.join(deleted, F.col(doc).eqNullSafe(F.col(of)), "left").drop(of).mapInArrow(run, schema)
    return rest.withColumn(counts[0], F.size(F.split(text, "\n"))).withColumn(counts[1], F.lit(0)).unionByName(changed)
