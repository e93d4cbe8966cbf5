"""Token counts by prefix dynamic programming.

BPE has one valid way to end: for every prefix of a pre-token there is exactly
one last token that may follow the (unique) encoding of what lies before it.
Two tokens may stand side by side if encoding their joined text gives the same
two tokens back, and an encoding is valid if all its neighbours are. So one
pass over a pre-token finds, for each prefix, its last token and its token
count; nothing is encoded again to answer how many tokens a prefix has, or
which prefix is the longest within a budget.

Results and edge cases: a null text counts as empty (0 tokens); repeated rows
each get their row; an empty table gives an empty result; columns other than
the key and the text are ignored. Texts with special strings or characters
outside the plain set of ``bpe`` are counted by the library itself, per
white-space chunk in prefix tables.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .bpe import PIECES, ChunkEncoder, flat_string, named, slices
from .common import texts

MOST_PIECES = 1_200_000
MOST_PAIRS = 1_000_000


class PrefixCounter:
    """Exact token counts of prefixes under one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab = set(model["vocab"])
        self.longest = max((len(t.removesuffix(self.suffix)) if self.suffix else len(t)) for t in self.vocab)
        self.library = ChunkEncoder(path, most=0)
        self.kind = self.library.kind
        self.pairs: dict[tuple[str, str], bool] = {}
        self.wholes: dict[str, bool] = {}
        self.totals: dict[str, int] = {}
        self.tables: dict[str, np.ndarray] = {}

    def _symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def _merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE: merge the pair of the lowest rank, leftmost first."""
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == 1 << 60:
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def _whole(self, token: str) -> bool:
        """Does the token's own text encode as that token?"""
        got = self.wholes.get(token)
        if got is None:
            got = self.wholes[token] = self._merged(self._symbols(token)) == [token]
        return got

    def _side_by_side(self, left: str, right: str) -> bool:
        got = self.pairs.get((left, right))
        if got is None:
            if len(self.pairs) > MOST_PAIRS:
                self.pairs.clear()
            got = self.pairs[left, right] = self._merged(self._symbols(left) + self._symbols(right)) == [left, right]
        return got

    def _step(self, text: str, end: int, last: list, count: list, suffix: str) -> tuple[str, int]:
        """The last token of text[:end], and how many tokens that prefix has."""
        vocab = self.vocab
        for start in range(max(0, end - self.longest), end):
            token = text[start:end] + suffix
            if token in vocab:
                if start == 0:
                    if self._whole(token):
                        return token, 1
                else:
                    before = last[start]
                    if before is not None and self._side_by_side(before, token):
                        return token, count[start] + 1
        raise ValueError(f"no valid encoding ends at {end} of {text!r}")

    def _forward(self, text: str, to: int) -> tuple[list, list]:
        last, count = [None] * (to + 1), [0] * (to + 1)
        for end in range(1, to + 1):
            last[end], count[end] = self._step(text, end, last, count, "")
        return last, count

    def piece_total(self, piece: str) -> int:
        """Tokens of a whole pre-token: the count stored at its last prefix."""
        got = self.totals.get(piece)
        if got is None:
            text = named(piece)
            if self.suffix:
                last, count = self._forward(text, len(text) - 1)
                got = self._step(text, len(text), last, count, self.suffix)[1]
            else:
                got = self._forward(text, len(text))[1][-1]
            if len(self.totals) > MOST_PIECES:
                self.totals.clear()
            self.totals[piece] = got
        return got

    def piece_table(self, piece: str) -> np.ndarray:
        """Token counts of piece[:i] for i from 0 to its length in characters."""
        got = self.tables.get(piece)
        if got is None:
            text, ends = named(piece), np.cumsum([0] + [len(c.encode()) for c in piece])
            last, count = self._forward(text, len(text))
            if self.suffix:
                count = [0] + [self._step(text, e, last, count, self.suffix)[1] for e in range(1, len(text) + 1)]
            if len(self.tables) > MOST_PIECES // 8:
                self.tables.clear()
            got = self.tables[piece] = np.array(count, np.int32)[ends]
        return got

    def chunk_total(self, chunk: str) -> int:
        if self.kind == "word":
            chunk = chunk.lower()
        return sum(map(self.piece_total, PIECES[self.kind].findall(chunk)))

    def counts(self, column: pa.Array) -> np.ndarray:
        """Tokens of each whole text."""
        plain = self.library.plain(column)
        out = np.zeros(len(column), np.int64)
        if plain.any():
            kept = column.filter(pa.array(plain))
            if self.kind == "word":
                split = pc.split_pattern(pc.replace_substring(kept, "\n", " "), " ")
            else:
                split = pc.split_pattern(pc.replace_substring(pc.replace_substring(kept, " ", "\x01 "), "\n", "\x01\n"), "\x01")
            coded = pc.dictionary_encode(split.flatten())
            totals = np.fromiter(map(self.chunk_total, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
            sums = np.concatenate([[0], np.cumsum(totals[coded.indices.to_numpy(zero_copy_only=False)])])
            offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
            out[plain] = np.diff(sums[offsets])
        for i in np.flatnonzero(~plain):
            out[i] = self._library(column[i].as_py())
        return out

    def _library(self, text: str) -> int:
        return len(self.library.tokenizer.encode(text, add_special_tokens=False).ids)

    def table(self, text: str) -> PrefixTable:
        return PrefixTable(self, text)


class PrefixTable:
    """The token count at every prefix of one text.

    ``counts[i]`` is the number of tokens of ``text[:i]`` encoded by itself, or
    -1 inside a chunk whose cuts the plain rules do not cover; such a prefix is
    answered by encoding that one chunk's part.
    """

    def __init__(self, counter: PrefixCounter, text: str):
        self.counter, self.text = counter, text
        self.counts = np.full(len(text) + 1, -1, np.int64)
        self.counts[0] = 0
        self.starts: list[int] = []
        odd = not counter.library.plain(pa.array([text]))[0]
        rule = re.compile(r"\s*\S+|\s+" if counter.kind != "word" else r"[ \n]+|[^ \n]+")
        at = 0
        for chunk in ([text] if odd and counter.kind != "word" and text else rule.findall(text)):
            base, n = int(self.counts[at]), len(chunk)
            self.starts.append(at)
            if counter.kind == "word" and chunk[0] in " \n":
                self.counts[at : at + n + 1] = base
            elif counter.kind == "other" or not counter.library.plain(pa.array([chunk]))[0] or "'" in chunk or len(chunk) - len(chunk.lstrip()) > 1:
                self.counts[at + n] = base + counter._library(chunk)
            else:
                here = at
                for piece in PIECES[counter.kind].findall(chunk.lower() if counter.kind == "word" else chunk):
                    table = counter.piece_table(piece)
                    self.counts[here : here + len(piece) + 1] = base + table
                    here, base = here + len(piece), base + int(table[-1])
            at += n

    def count(self, n_chars: int) -> int:
        """Tokens of the first n_chars characters."""
        n = max(0, min(n_chars, len(self.text)))
        if self.counts[n] >= 0:
            return int(self.counts[n])
        start = self.starts[int(np.searchsorted(self.starts, n, "left")) - 1]
        return int(self.counts[start]) + self.counter._library(self.text[start:n])

    def fits(self, budget: int) -> int:
        """The length of the longest prefix with at most so many tokens."""
        known = np.flatnonzero((self.counts >= 0) & (self.counts <= budget))
        best = int(known[-1]) if len(known) else 0
        for n in range(len(self.text), best, -1):
            if self.counts[n] < 0 and self.count(n) <= budget:
                return n
        return best


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters.clear()
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def token_counts(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """One row per row of df: key, n_bytes, n_tokens, over_limit (n_tokens > limit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        own = counter(tokenizer)
        for batch in batches:
            ids, column = batch.column(0), flat_string(batch.column(1))
            for a, b in slices(column):
                part = column.slice(a, b - a)
                n = own.counts(part)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pc.cast(pc.binary_length(part), pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(df, key, text).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("doc_id", key)


def token_budgets(df: DataFrame, tokenizer: str, budgets: list[int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row and budget, the longest prefix within it: key, budget, n_chars, n_tokens of that prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for batch in batches:
            rows = []
            for doc, text_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table = own.table(text_)
                rows += [(doc, b, n := table.fits(b), table.count(n)) for b in budgets]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else ([], [], [], []))], ["doc_id", "budget", "n_chars", "n_tokens"])

    return texts(df, key, text).mapInArrow(run, "doc_id long, budget long, n_chars long, n_tokens long").withColumnRenamed("doc_id", key)
