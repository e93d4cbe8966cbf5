"""Exact ids of whole texts, much faster than text by text: encode each distinct piece once.

A BPE tokenizer encodes pre-tokens independently of each other, so the ids of a
text are the ids of its chunks in order, as long as every cut between chunks is
also a cut between pre-tokens. Two public configurations are recognised from the
tokenizer file itself:

* ``byte``: byte-level BPE without normaliser. Cuts lie before each single white
  space that follows a visible character.
* ``word``: lower-cased BPE with word ends, white space dropped. Cuts lie at
  spaces and line ends.

Texts with characters or special strings outside the plain set below, and any
other configuration, go to the library as they are; so the ids always equal the
library's.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN_BREAK = f"[^ \\n!-~{LETTERS}]|<\\|"
WORD_RULE = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Between chunks, and between pieces; no plain text has it, and no piece.
SEPARATOR = "\x01"
PIECES = {
    "byte": re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\\s{LETTERS}0-9{SEPARATOR}]+|\\s+(?!\\S)|\\s+"),
    "word": re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\\s{LETTERS}0-9{SEPARATOR}]+"),
}
#: Slices, kept pieces and pieces encoded at once bound a Python worker's memory, long single texts aside.
SLICE_BYTES, BLOCK = 4 << 20, 1 << 14


def byte_alphabet() -> dict[int, str]:
    """The printable character by which byte-level BPE names each byte (public byte-level rule)."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, spare = {b: chr(b) for b in visible}, 256
    for b in range(256):
        if b not in names:
            names[b] = chr(spare)
            spare += 1
    return names


ALPHABET = byte_alphabet()


#: The character of each byte, a space for the separator.
NAMES = np.array([ord(ALPHABET[b]) if b != ord(SEPARATOR) else ord(" ") for b in range(256)], "<u4")


def named(piece: str) -> str:
    return piece.encode().decode("latin-1").translate(ALPHABET)


def kind_of(spec: dict) -> str:
    model, pre, norm = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or any(not t["content"].startswith("<|") for t in spec["added_tokens"]):
        return "other"
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not model.get("end_of_word_suffix"):
        return "byte"
    parts = pre.get("pretokenizers", [])
    if norm and [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and len(parts) == 2 and parts[0].get("pattern") == {"Regex": WORD_RULE} and parts[0].get("invert") and parts[1].get("type") == "ByteLevel" and not parts[1].get("use_regex") and model.get("end_of_word_suffix"):
        return "word"
    return "other"


def joined(strings: pa.Array) -> str:
    """All strings, with separators between them."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(strings)], pa.int32()), strings), SEPARATOR)[0].as_py()


def runs(flat: np.ndarray, lens: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the runs of flat that codes name, one after the other, where each begins and the last ends); lens: the length of each run of flat."""
    n = lens[codes]
    ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
    starts = np.cumsum(lens, dtype=np.int64) - lens
    at = np.repeat(starts[codes] - ends[:-1], n)
    at += np.arange(len(at))
    return flat[at], ends


class ChunkEncoder:
    """Ids of many texts at once. Holds at most ``most`` pieces between calls, in arrays."""

    def __init__(self, path: str, most: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.kind = kind_of(spec)
        self.most = most
        self.model = self.tokenizer.model
        self.words = Tokenizer(self.model)  # the same model over pieces with spaces between them
        self.words.pre_tokenizer = CharDelimiterSplit(" ")
        if self.kind != "other":
            suffix = spec["model"].get("end_of_word_suffix") or ""
            self.ends, self.size = np.zeros(len(spec["model"]["vocab"]), bool), np.zeros(len(spec["model"]["vocab"]), np.int32)
            for token, i in spec["model"]["vocab"].items():
                self.ends[i], self.size[i] = bool(suffix) and token.endswith(suffix), len(token)
        self._empty()

    def _empty(self) -> None:
        self.known = pa.array([], pa.string())
        self.lens, self.flat = np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def _encoded(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece), by the library: the pieces are the words of one text."""
        raw = np.frombuffer(joined(pieces).encode(), np.uint8)
        text = NAMES[raw].tobytes().decode("utf-32-le")
        ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        if self.kind == "word":
            ends = np.flatnonzero(self.ends[ids]) + 1
            whole = len(ends) == len(pieces) and len(ids) == ends[-1]
        else:
            done, wanted = np.cumsum(self.size[ids]), np.cumsum(pc.binary_length(pieces).to_numpy())
            ends = np.searchsorted(done, wanted) + 1
            whole = len(ids) == ends[-1] and np.array_equal(done[ends - 1], wanted)
        if whole:
            return ids, np.diff(ends, prepend=0)
        each = [[t.id for t in self.model.tokenize(named(p))] for p in pieces.to_pylist()]
        return np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each])

    def _codes(self, pieces: pa.Array) -> np.ndarray:
        """The place of each of some different pieces among the known ones."""
        if len(self.known) > self.most:
            self._empty()
        at = pc.index_in(pieces, value_set=self.known).fill_null(-1).to_numpy().copy()
        new = np.flatnonzero(at < 0)
        at[new] = np.arange(len(self.known), len(self.known) + len(new))
        added = pieces.take(pa.array(new))
        parts = [self._encoded(added.slice(i, BLOCK)) for i in range(0, len(added), BLOCK)]
        self.known = pa.concat_arrays([self.known, added])
        self.flat = np.concatenate([self.flat, *(p[0] for p in parts)])
        self.lens = np.concatenate([self.lens, *(p[1].astype(np.int32) for p in parts)])
        return at

    def _chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of different chunks, one after the other, their ends)."""
        text = joined(chunks)
        coded = pc.dictionary_encode(pa.array(PIECES[self.kind].findall(text.lower() if self.kind == "word" else text), pa.string()))
        codes = self._codes(coded.dictionary)
        # pieces cover all bytes of a chunk, so they fill it up
        filled = np.cumsum(pc.binary_length(coded.dictionary).to_numpy()[coded.indices.to_numpy()])
        last = np.searchsorted(filled, np.cumsum(pc.binary_length(chunks).to_numpy()), "right")
        ids, ends = runs(self.flat, self.lens, codes[coded.indices.to_numpy()])
        return ids, ends[np.concatenate([[0], last])]

    def plain(self, texts: pa.Array) -> np.ndarray:
        if self.kind == "other":
            return np.zeros(len(texts), bool)
        rule = PLAIN_BREAK + ("|[ \\n][ \\n]" if self.kind == "byte" else "")
        return ~pc.match_substring_regex(texts, rule).to_numpy(zero_copy_only=False)

    def _plain_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "word":
            split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        else:
            split = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", f"{SEPARATOR} "), "\n", f"{SEPARATOR}\n"), SEPARATOR)
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = pc.dictionary_encode(split.flatten())
        del split
        flat, ends = self._chunk_ids(coded.dictionary)
        ids, ends = runs(flat, np.diff(ends), coded.indices.to_numpy(zero_copy_only=False))
        return ids, ends[offsets]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids as uint32, offsets of the texts in them)."""
        plain = self.plain(texts)
        if plain.all():
            return self._plain_ids(texts)
        empty = (np.zeros(0, np.uint32), np.zeros(1, np.int64))
        ids, offsets = self._plain_ids(texts.filter(pa.array(plain))) if plain.any() else empty
        others = iter(texts.filter(pa.array(~plain)).to_pylist())
        parts, k = [], 0
        for ok in plain:
            if ok:
                parts.append(ids[offsets[k] : offsets[k + 1]])
                k += 1
            else:
                parts.append(np.array(self.tokenizer.encode(next(others), add_special_tokens=False).ids, np.uint32))
        return np.concatenate([empty[0], *parts]), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)


def slices(texts: pa.Array, most: int = SLICE_BYTES):
    """(from, to) of runs of texts of about so many bytes, so that memory stays bounded."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    at, size = 0, 0
    for i, n in enumerate(sizes):
        if size and size + n > most:
            yield at, i
            at, size = i, 0
        size += int(n)
    if at < len(sizes):
        yield at, len(sizes)


_kept: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One per Python worker and file; tasks that reuse a worker reuse its pieces."""
    if path not in _kept:
        _kept.clear()
        _kept[path] = ChunkEncoder(path)
    return _kept[path]


def release(keep: str = "") -> None:
    """Gives back what earlier tasks of this Python worker left: encoders of other files than keep, and memory that allocators hold."""
    for path in [p for p in _kept if p != keep]:
        del _kept[path]
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def flat_string(column) -> pa.Array:
    out = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return out if pa.types.is_string(out.type) or pa.types.is_large_string(out.type) else out.cast(pa.string())
