"""Nucleotide text as Spark columns: all but find_with_errors stays in the JVM."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# IUPAC codes.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reverse_complement(c: Column | str) -> Column:
    """Complement of A, C, G and T in either case, reversed; other letters keep."""
    return F.reverse(F.translate(col(c), "ATCGatcg", "TAGCtagc"))


def normal_target(c: Column | str) -> Column:
    """Upper case, U as T."""
    return F.translate(F.upper(col(c)), "U", "T")


def from_text(c: Column | str) -> Column:
    """Any text as nucleotides: its letters a-z, in turn A, C, G, T."""
    return F.translate(F.regexp_replace(F.lower(col(c)), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")


def places(n: Column) -> Column:
    """0 to n - 1; empty if n is not positive."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n.cast("int") - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def at(c: Column, i: Column) -> Column:
    """The character at a 0-based place."""
    return F.substring(c, i + 1, F.lit(1))


def mismatches(a: Column | str, b: Column | str, most: int = 0) -> Column:
    """0-based places at which two texts differ, over the shorter length; at most so many if most > 0."""
    a, b = col(a), col(b)
    n = F.least(F.length(a), F.length(b))
    found = F.filter(places(n), lambda i: at(a, i) != at(b, i))
    # most texts are equal, and one comparison says so
    found = F.when(F.left(a, n) == F.left(b, n), F.array().cast("array<int>")).otherwise(found)
    return F.slice(found, 1, most) if most else found


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.size(mismatches(a, b))


def find_with_overlap(needle: Column | str, hay: Column | str) -> Column:
    """Where needle starts in hay, running over its end if need be; -1 if nowhere."""
    needle, hay = col(needle), col(hay)
    inside = F.instr(hay, needle) - 1
    tail = F.filter(places(F.length(hay)), lambda h: (F.length(hay) - h < F.length(needle)) & F.startswith(needle, F.substring(hay, h + 1, F.length(hay))))
    return F.when(inside >= 0, inside).when(F.size(tail) > 0, F.element_at(tail, 1)).otherwise(F.lit(-1))


#: So many places of texts are compared at once.
CELLS = 1 << 20


def _letters(texts: list[str], more: int = 0) -> np.ndarray:
    """A row of code points for each text, with zeros behind it (more than so many at least)."""
    width = max(map(len, texts), default=0) + more + 1
    return np.array(texts, f"<U{width}").view(np.uint32).reshape(len(texts), width)


def places_with_errors(parts: list[str], wholes: list[str], errors: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(how many places each pair of texts has, the places): the first ones of the whole at which the part fits with at most so many mismatches."""
    size, length = np.array([*map(len, wholes)]), np.array([*map(len, parts)])
    p, longest = _letters(parts), int(length.max(initial=0))
    w = _letters(wholes, longest)
    n = int((size - length).max(initial=-1)) + 1
    wrong = np.zeros((len(wholes), max(n, 0)), np.int32)
    for i in range(longest if n > 0 else 0):
        wrong += (w[:, i : i + n] != p[:, i : i + 1]) & (i < length)[:, None]
    fits = (wrong <= errors) & (np.arange(max(n, 0)) <= (size - length)[:, None])
    fits &= np.cumsum(fits, axis=1) <= most
    return fits.sum(axis=1), np.nonzero(fits)[1]


def find_with_errors(part: Column | str, whole: Column | str, errors: int, most: int = 2) -> Column:
    """The first places of whole at which part fits with at most so many mismatches; none if either is null. Compared as arrays, an Arrow batch at a time."""

    @F.arrow_udf("array<int>")
    def found(parts: pa.Array, wholes: pa.Array) -> pa.Array:
        pairs = [("\0", "") if p is None or w is None else (p, w) for p, w in zip(parts.to_pylist(), wholes.to_pylist(), strict=True)]
        step = max(1, CELLS // (max((len(w) for _, w in pairs), default=0) + 1))
        done = [places_with_errors([p for p, _ in pairs[a : a + step]], [w for _, w in pairs[a : a + step]], errors, most) for a in range(0, len(pairs), step)]
        counts, at = (np.concatenate([np.zeros(0, np.int64), *(d[i] for d in done)]) for i in (0, 1))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(at, pa.int32()))

    return found(col(part), col(whole))


def phred(quality: Column, i: Column) -> Column:
    """The base quality at a 0-based place."""
    return F.ascii(at(quality, i)) - 33


def quality_at_least(quality: Column | str, least: int) -> Column:
    """Do all bases reach that quality?"""
    q = col(quality)
    return F.forall(places(F.length(q)), lambda i: phred(q, i) >= least)


def handle_regex(mask: str) -> str:
    """A regular expression of what starts with an IUPAC pattern; the empty pattern fits all."""
    return "^" + "".join(f"[{IUPAC[c]}]" for c in mask.upper())


def handle(r1: Column | str, masks: tuple[str, ...]) -> Column:
    """The first handle that a read starts with, or null."""
    out = None
    for m in masks:
        hit = col(r1).rlike(handle_regex(m))
        out = F.when(hit, F.lit(m)) if out is None else out.when(hit, F.lit(m))
    return out if out is not None else F.lit(None).cast("string")


def determinate(*reads: Column | str) -> Column:
    """Only A, C, G and T in all reads?"""
    return ~F.concat(*[col(r) for r in reads]).rlike("[^ACGT]")


def similarity(a: Column, b: Column, match: float = 2, mismatch: float = 2) -> Column:
    return F.when(a == b, F.lit(match)).otherwise(F.lit(-mismatch))


def first_smallest(values: Column, base: int = 0) -> Column:
    """Place of the first smallest element, from base."""
    return F.array_position(values, F.array_min(values)) - 1 + base


def trimmed(seq: Column, left: Column, right: Column) -> Column:
    """Without so many characters at either end."""
    return F.substring(seq, left + 1, F.greatest(F.length(seq) - left - right, F.lit(0)))


def right_estimate(match_index: Column, match_start: Column, seq_len: Column, indels: Column) -> Column:
    """Where a read's end would lie on the target."""
    return match_index - match_start + seq_len - indels


def key(*parts: Column) -> Column:
    """Counter key: the parts joined by colons."""
    return F.concat_ws(":", *[p.cast("string") for p in parts])


def register(spark: SparkSession) -> None:
    """SQL names: reverse_complement, match_errors, align_score, kmers (a table function)."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION reverse_complement(s STRING) RETURNS STRING RETURN reverse(translate(s, 'ATCGatcg', 'TAGCtagc'))")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION match_errors(a STRING, b STRING) RETURNS ARRAY<INT> RETURN "
        "CASE WHEN least(length(a), length(b)) > 0 THEN filter(sequence(0, greatest(least(length(a), length(b)) - 1, 0)), i -> substring(a, i + 1, 1) <> substring(b, i + 1, 1)) ELSE array() END"
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION kmers(s STRING, k INT) RETURNS TABLE(pos INT, word STRING) RETURN SELECT pos, substring(s, pos + 1, k) FROM explode(sequence(0, length(s) - k)) AS t(pos)")
    from .alignment import align_udf

    spark.udf.register("align_score", align_udf())
