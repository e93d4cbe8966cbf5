"""Order-preserving packing: the dynamic programme against all cuts, pieces against the library."""

import zlib
from collections import Counter, defaultdict

import helpers
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_tokens import FILES, library

from ribostrand.llm.ordered_packing import FAR, Boundaries, Stream, cheapest, half, pack_in_order, padding, windows
from ribostrand.llm.queries import tokenizer_path


def brute(penalty, length, least):
    """Cost of the cheapest windows of least to length tokens (0: of any power of two, or one padded window at the end)."""
    f = [0] + [FAR] * (len(penalty) - 1)
    for j in range(1, len(f)):
        for n in range(1, min(length, j) + 1):
            if n >= least and f[j - n] < FAR:
                f[j] = min(f[j], f[j - n] + padding(n, length) + penalty[j])
    return f


@settings(max_examples=150, deadline=None)
@given(st.integers(2, 20), st.lists(st.sampled_from((0, 1, 3, 9)), max_size=70))
def test_costs_equal_those_of_all_cuts(length, penalties):
    penalty = np.array([0, *penalties], np.int64)
    assert cheapest(penalty, length).tolist() == brute(penalty.tolist(), length, half(length))


@settings(max_examples=150, deadline=None)
@given(st.integers(2, 20), st.lists(st.sampled_from((0, 2, 5)), min_size=1, max_size=60))
def test_windows_of_a_whole_stream(length, penalties):
    """As cheap as the best of: windows of half to full length, then one padded window or powers of two."""
    penalty = np.array([0, *penalties[:-1], 0], np.int64)
    n = len(penalty) - 1
    cuts = windows(penalty, length)
    sizes = np.diff(cuts)
    assert cuts[0] == 0 and cuts[-1] == n and (sizes > 0).all() and (sizes <= length).all()
    cost = sum(padding(int(s), length) for s in sizes) + int(penalty[cuts[1:]].sum())
    front = brute(penalty.tolist(), length, half(length))
    tail = [0] * (n + 1)
    for i in range(n - 1, max(-1, n - length - 1), -1):
        options = [tail[i + p] + int(penalty[i + p]) for k in range(12) if i + (p := 1 << k) <= n and p <= length]
        tail[i] = min([padding(n - i, length), *options])
    assert cost == min(front[i] + tail[i] for i in range(max(0, n - length), n + 1) if front[i] < FAR)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 90), max_size=30), max_size=6), st.sampled_from((8, 12, 16)))
def test_stream_keeps_every_id_once(batches, length):
    """Small stretches, documents of many windows, batches of any size."""
    stream, made, docs = Stream(length, 7, stretch=64), [], []
    rng = np.random.default_rng(len(batches))
    for sizes in batches:
        ids = rng.integers(0, 1000, sum(sizes)).astype(np.uint32)
        penalty = rng.choice([4, 30], len(ids))
        penalty[np.cumsum(sizes).astype(int) - 1] = 0
        at = 0
        first = len(docs)
        for n in sizes:
            docs.append(ids[at : at + n])
            at += n
        made += list(stream.add(list(range(first, len(docs))), ids, penalty, np.array(sizes, np.int64)))
    made += list(stream.rest())
    rows = [dict(zip(m, x, strict=True)) for m in made for x in zip(*m.values(), strict=True)]
    check(rows, dict(enumerate(docs)), length)
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
    assert [r["sequence_id"] for r in rows] == sorted(r["sequence_id"] for r in rows)


def check(rows, ids, length):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for doc, own in ids.items():
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(own)
            assert r["ids_crc32"] == zlib.crc32(np.asarray(own[at : at + r["length"]]).astype("<u4").tobytes())
            at += r["length"]
        assert at == len(own)
    padded = total = 0
    for s in sequences.values():
        s.sort()
        n = sum(x for _, x in s)
        assert [o for o, _ in s] == np.cumsum([0] + [x for _, x in s])[:-1].tolist() and n <= length
        padded, total = padded + padding(n, length), total + n
    return padded, total


@pytest.mark.parametrize("name", FILES)
def test_pack_in_order(docs, none, name):
    t = library(name)
    own = {r[0]: [*t.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in helpers.rows() if r[0] != 18}
    df = docs.where("doc_id IS NULL OR doc_id <> 18")
    rows = [r.asDict() for r in pack_in_order(df, tokenizer_path(name), length=64, sentence=1, inside=4).collect()]
    padded, total = check(rows, own, 64)
    assert padded < 0.1 * total
    assert pack_in_order(none, tokenizer_path(name)).count() == 0
    twice = Counter(r["start"] for r in pack_in_order(docs.where("doc_id = 18"), tokenizer_path(name)).collect())
    assert sum(twice.values()) >= 2 and twice[0] == 2
    again = [r.asDict() for r in pack_in_order(df, tokenizer_path(name), length=64, sentence=1, inside=4).collect()]
    assert sorted(map(str, again)) == sorted(map(str, rows))
    with pytest.raises(ValueError, match="two tokens"):
        pack_in_order(df, tokenizer_path(name), length=1)


def test_a_text_longer_than_a_stretch(spark):
    """More than 2**20 tokens in one document, between two short ones."""
    text = helpers.prose(77, 360_000)
    t = library(FILES[0])
    texts = {1: "Before.", 2: text, 3: "After."}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    rows = [r.asDict() for r in pack_in_order(df, tokenizer_path(FILES[0])).collect()]
    own = {k: [*t.encode(x, add_special_tokens=False).ids, 1] for k, x in texts.items()}
    assert len(own[2]) > 1 << 20
    padded, total = check(rows, own, 2048)
    assert padded < 0.01 * total


def test_cuts_prefer_sentences():
    t = library(FILES[0])
    text = "One sentence here. Another (longer) one!\nA line\nwith 3.14 inside"
    ids = np.array(t.encode(text, add_special_tokens=False).ids)
    after = Boundaries(t).after(ids)
    parts, at = [], 0
    for k in [*(np.flatnonzero(after) + 1).tolist(), len(ids)]:
        parts.append(t.decode(ids[at:k].tolist()))
        at = k
    assert parts == ["One sentence here.", " Another (longer) one!\n", "A line\n", "with 3.14 inside"]
