"""Approximate searches as equi-joins: texts within some mismatches of a place, or one edit away from a key.

Neither scans the offsets of a text or lists the variants of a key with letters
filled in; candidates come from parts that must be equal and are then verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as S
from .index import spread

#: Longest piece that is looked up as a word; longer ones are looked up by their first bases.
MOST_WORD = 12


def pieces(queries: DataFrame, errors: int, key: str = "query_id") -> DataFrame:
    """key, q, at, word: errors + 1 pieces of each query, of which one at least is free of errors (pigeonhole); by their first bases, as many in each piece of a query.

    Queries of at most so many bases as errors have no such piece; they fit
    everywhere and are left out.
    """
    size = F.floor(F.length("q") / (errors + 1)).cast("int")
    own = spread(queries, key).select(key, F.col("seq").alias("q")).where(F.length("q") > errors).withColumn("size", size)
    each = own.select(key, "q", "size", F.explode(F.array(*map(F.lit, range(errors + 1)))).alias("piece")).withColumn("at", F.col("piece") * F.col("size"))
    return each.select(key, "q", "at", F.substring("q", F.col("at") + 1, F.least("size", F.lit(MOST_WORD))).alias("word"))


def candidates(queries: DataFrame, targets: DataFrame, errors: int, key: str = "query_id") -> DataFrame:
    """key, q, target_id, pos: the distinct places of whole queries at which one of their pieces is found."""
    parts = pieces(queries, errors, key)
    sizes = parts.select(F.length("word").alias("k")).distinct()  # at most MOST_WORD rows
    places = targets.join(F.broadcast(sizes), F.length("seq") >= F.col("k"))
    places = places.select("target_id", "k", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - F.col("k"))).alias("p"))
    words = places.select("target_id", F.length("seq").alias("n"), "p", F.substring("seq", F.col("p") + 1, F.col("k")).alias("word"))
    met = parts.join(words, "word").withColumn("pos", F.col("p") - F.col("at")).where((F.col("pos") >= 0) & (F.col("pos") + F.length("q") <= F.col("n")))
    return met.select(key, "q", "target_id", "pos").distinct()


def places_with_errors(queries: DataFrame, targets: DataFrame, errors: int, key: str = "query_id") -> DataFrame:
    """key, target_id, pos, distance: all places of all targets at which a whole query fits with at most so many mismatches.

    queries: key (unique) and seq; targets: target_id and seq.
    """
    met = candidates(queries, targets, errors, key).join(targets.select("target_id", F.col("seq").alias("t")), "target_id")
    both = F.array(F.struct(F.col("q"), F.substring("t", F.col("pos") + 1, F.length("q")).alias("part")))
    # a generator, so that the comparison is neither copied into the join nor made twice
    told = met.select(key, "target_id", "pos", F.inline(F.transform(both, lambda x: F.struct(S.hamming(x["q"], x["part"]).alias("distance")))))
    return told.where(F.col("distance") <= errors)


def _shortened(text: Column) -> Column:
    """Hashes of what is left of a text without one of its letters."""
    less = lambda i: F.xxhash64(F.concat(F.substring(text, F.lit(1), i), F.substring(text, i + 2, F.length(text))))
    return F.array_distinct(F.transform(S.places(F.length(text)), less))


def _edit(read: Column, key: Column, place: Column) -> Column:
    """What makes the key a read of the same length, given their common prefix; null if one edit does not."""
    n = F.length(key)
    rest = lambda t, start, stop: F.substring(t, start + 1, F.greatest(stop - start, F.lit(0)))
    return (
        F.when(rest(read, place + 1, n) == rest(key, place + 1, n), "substitution")
        .when(rest(read, place + 1, n) == rest(key, place, n - 1), "insertion")
        .when(rest(read, place, n - 1) == rest(key, place + 1, n), "deletion")
    )


def one_edit_hits(reads: DataFrame, keys: DataFrame, key: str = "pair_id") -> DataFrame:
    """key, table_key, edit, place of the table keys that a read shows exactly (place null) or with one edit.

    reads: key and seq; keys: key. Reads and keys of one length meet. An
    inserted base pushes the key's last one out of the read, a deleted one lets
    in a base that the key does not tell. Where several edits make the same read
    the kind is the first of substitution, insertion, deletion, and the place
    (0-based, in the key) the first at which the two differ. A read that shows a
    key exactly is not asked for other keys.

    Both sides are joined by the hashes of themselves less one letter: a
    substitution leaves the same text without the changed letter, an insertion
    or deletion without the odd one and the last. So a read and a key have as
    many rows as letters, however many variants a key has.
    """
    from .index import _common

    own = keys.select(F.col("key").alias("table_key")).distinct()
    asked = spread(reads, key).select(key, F.col("seq").alias("read"))
    exact = asked.join(own, F.col("read") == F.col("table_key")).select(key, "table_key", F.lit("none").alias("edit"), F.lit(None).cast("int").alias("place"))
    others = asked.join(own, F.col("read") == F.col("table_key"), "left_anti")
    # equal reads ask once
    left = others.select("read").distinct().select("read", F.length("read").alias("n"), F.explode(_shortened(F.col("read"))).alias("part"))
    right = own.select("table_key", F.length("table_key").alias("n"), F.explode(_shortened(F.col("table_key"))).alias("part"))
    met = left.join(right, ["n", "part"]).select("read", "table_key").distinct()
    both = F.array(F.struct(F.col("read").alias("a"), F.col("table_key").alias("b")))
    placed = met.select("read", "table_key", F.inline(F.transform(both, lambda x: F.struct(_common(x["a"], x["b"]).alias("place")))))
    found = placed.select("read", "table_key", _edit(F.col("read"), F.col("table_key"), F.col("place")).alias("edit"), "place").where("edit IS NOT NULL")
    return exact.unionByName(others.join(found, "read").select(key, "table_key", "edit", "place"))
