"""Filter interaction audit: what each filter removes, for every order of the filters.

A document fails a filter or not, whatever the order in which filters are
applied; so its failures are a mask of five bits, and everything that the audit
says of a part and an order follows from the numbers of documents by part and
mask. Those counters are additive: they are summed by Spark before anything is
ordered, and there are at most 32 for each part.

Filters A to D look at one text and are columns. E (identical to a text of a
smaller doc_id) is found by sorting: texts are range-sorted by fingerprint, full
text and doc_id, and each row is compared with its predecessor. Ranges are cut
by fingerprint (SHA-256 of the text) and doc_id, so no text travels with the
sample of the ranges, and the copies of one text, be they a third of the table,
lie in as many partitions as they fill. Within a partition full texts decide. At
the borders the last text of each partition meets the first of the next (a join
on the partition's number), and a window over one small row for each partition
carries the smallest doc_id of a text that goes on to where it ends.

Edge cases: a null text is an empty one, and all empty texts are identical; a
null doc_id is not smaller than any other and has none smaller; rows with equal
doc_id and text are no duplicates of each other; a null part is ''; of several
labels of a document one suffices; a document without label is neither good nor
toxic; rows without doc_id have no label; a very long text is one row of the
sort; an empty table gives no rows; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
SPACE = r"[\x20\x09-\x0D]+"
NO_ID = np.iinfo(np.int64).max
SORTED = "doc boolean, part int, opens boolean, doc_id long, lang string, mask int, first_text string, last_text string, last_id long, single boolean"


def text_failures(text: Column) -> Column:
    """The bits of A (under 100 words), B (distinct words under 80 %), C (capitals over 10 % of the characters) and D (one of #$%&*|)."""
    words = F.array_remove(F.split(text, SPACE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [n < 100, 100 * distinct < 80 * n, 100 * capitals > 10 * F.length(text), text.rlike("[#$%&*|]")]
    return sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a partition without their texts, marked as duplicates where the partition can tell; then one row about its borders.

    ``opens`` marks the rows of the partition's first text, which may have
    begun before; ``single`` says that there is no other.
    """
    part = TaskContext.get().partitionId()
    schema = pa.schema([("doc", pa.bool_()), ("part", pa.int32()), ("opens", pa.bool_()), ("doc_id", pa.int64()), ("lang", pa.string()), ("mask", pa.int32()), ("first_text", pa.string()), ("last_text", pa.string()), ("last_id", pa.int64()), ("single", pa.bool_())])
    first_text = last_text = None
    last_id, single, began = NO_ID, True, False
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        texts, docs = batch.column("text"), batch.column("doc_id")
        ids = pc.fill_null(docs, NO_ID).to_numpy(zero_copy_only=False)
        new = np.ones(n, bool)
        if n > 1:
            new[1:] = pc.not_equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
        goes_on = began and texts[0].as_py() == last_text
        new[0] = not goes_on
        starts = np.flatnonzero(np.concatenate([[True], new[1:]]))
        least = np.minimum.reduceat(ids, starts)
        if goes_on:
            least[0] = min(least[0], last_id)
        run = np.cumsum(np.concatenate([[0], new[1:]])).astype(np.int64)
        duplicate = (ids > least[run]) & docs.is_valid().to_numpy(zero_copy_only=False)
        opens = run == 0 if single and (goes_on or not began) else np.zeros(n, bool)
        if not began:
            first_text = texts[0].as_py()
        single = bool(opens.all())
        last_text, last_id, began = texts[n - 1].as_py(), int(least[-1]), True
        mask = batch.column("mask").to_numpy(zero_copy_only=False) | np.where(duplicate, DUPLICATE, 0)
        no = [pa.nulls(n, f.type) for f in list(schema)[6:]]
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, bool)), pa.array(np.full(n, part, np.int32)), pa.array(opens), docs, batch.column("lang"), pa.array(mask.astype(np.int32)), *no], schema=schema)
    if began:
        border = {"doc": False, "part": part, "first_text": first_text, "last_text": last_text, "last_id": None if last_id == NO_ID else last_id, "single": single}
        yield pa.RecordBatch.from_pylist([border], schema=schema)


def carried(borders: DataFrame) -> DataFrame:
    """(part, carried): the smallest doc_id, in earlier partitions, of the text with which a partition goes on.

    One row for each partition that has rows; only the join of neighbours sees texts.
    """
    follow = borders.select("part", "last_id", "single", F.row_number().over(Window.orderBy("part")).alias("k"))
    texts = borders.select("part", "first_text", "last_text").join(follow.select("part", "k"), "part")
    before = texts.select((F.col("k") + 1).alias("k"), F.col("last_text").alias("before"))
    goes_on = texts.select("k", "first_text").join(before, "k", "left").select("k", F.coalesce(F.col("first_text") == F.col("before"), F.lit(False)).alias("goes_on"))
    # a partition of one text that only goes on hands on what it was handed
    chain = follow.join(goes_on, "k").withColumn("chain", F.sum((~(F.col("single") & F.col("goes_on"))).cast("int")).over(Window.orderBy("k")))
    so_far = Window.partitionBy("chain").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    chain = chain.withColumn("least", F.min("last_id").over(so_far))
    handed = F.lag("least").over(Window.orderBy("k"))
    return chain.select("part", F.when(F.col("goes_on"), handed).alias("carried")).where("carried IS NOT NULL")


def failures(df: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """doc_id, lang (never null) and mask of every row: bit k is set if it fails the k-th filter."""
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("fingerprint", F.unhex(F.sha2("text", 256))).withColumn("tie", F.monotonically_increasing_id())  # deals out what has no doc_id
    rows = rows.repartitionByRange("fingerprint", "doc_id", "tie").sortWithinPartitions("fingerprint", "text", "doc_id")
    compared = stored(rows.select("doc_id", "lang", "text", text_failures(F.col("text")).alias("mask")).mapInArrow(_compare, SORTED), "filter-failures")
    own, borders = compared.where("doc").select("part", "opens", "doc_id", "lang", "mask"), compared.where("NOT doc")
    earlier = carried(borders)
    late = F.coalesce(F.col("opens") & (F.col("doc_id") > F.col("carried")), F.lit(False))
    return own.join(earlier, "part", "left").select("doc_id", "lang", F.when(late, F.col("mask").bitwiseOR(DUPLICATE)).otherwise(F.col("mask")).alias("mask"))


def counters(masks: DataFrame, labels: DataFrame, key: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """Documents, good and toxic documents by part and mask."""
    marks = labels.select(F.col(key).cast("long").alias("doc_id"), (F.col(quality) == 1).alias("good"), (F.col(toxic) == 1).alias("toxic")).where("doc_id IS NOT NULL AND (good OR toxic)")
    marks = marks.groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    with_id = masks.where("doc_id IS NOT NULL").join(marks, "doc_id", "left").select("lang", "mask", "good", "toxic")
    without = masks.where("doc_id IS NULL").select("lang", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    one = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long")).alias(c)
    return with_id.unionByName(without).groupBy("lang", "mask").agg(F.count(F.lit(1)).alias("n"), one("good"), one("toxic"))


def steps() -> list[tuple]:
    """For every mask, order and step: mask, filter_order, step, kept, removed, redundant, unique, share (of all orders, those in which the step's filter removes)."""
    out, orders = [], math.factorial(len(FILTERS))
    for mask in range(1 << len(FILTERS)):
        for order in permutations(range(len(FILTERS))):
            earlier = 0
            for k, f in enumerate(order):
                own = mask >> f & 1
                fails_before = mask & earlier != 0
                earlier |= 1 << f
                removed = bool(own and not fails_before)
                out.append(("".join(FILTERS[i] for i in order), k + 1, mask, not mask & earlier, removed, bool(own and fails_before), mask == 1 << f, orders // mask.bit_count() if own else 0))
    return out


def audit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley; zeros included."""
    spark = df.sparkSession
    counted = stored(counters(failures(df, key, text, part), labels, key), "filter-counters")
    # 19,200 rows, whatever the input
    table = spark.createDataFrame(steps(), "filter_order string, step int, mask int, kept boolean, removed boolean, redundant boolean, unique_fails boolean, share long")

    def total(flag: str, of: str = "n") -> Column:
        return F.sum(F.when(F.col(flag), F.col(of)).otherwise(F.lit(0).cast("long")))

    return (
        counted.join(F.broadcast(table), "mask").groupBy(F.col("lang").alias("part"), "filter_order", "step")
        .agg(
            total("kept").alias("kept"), total("removed").alias("removed"), total("redundant").alias("redundant"), total("unique_fails").alias("unique_fails"),
            total("removed", "good").alias("good_lost"), total("removed", "toxic").alias("toxic_lost"), F.sum(F.col("share") * F.col("n")).alias("shapley"),
        )
    )
