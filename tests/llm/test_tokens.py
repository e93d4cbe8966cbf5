"""Token counts, packing and token files against the tokenizers library."""

import io
import zlib
from collections import Counter, defaultdict

import helpers
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ribostrand.llm.bpe import ChunkEncoder
from ribostrand.llm.packing import Slots, pack, packing_plan
from ribostrand.llm.queries import tokenizer_path
from ribostrand.llm.token_counts import PrefixCounter, token_budgets, token_counts
from ribostrand.llm.token_files import TokenFile, TokenFileWriter, read_token_files, write_token_files

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


def ids_of(name):
    t = library(name)
    return [(r[0], t.encode(r[1] or "", add_special_tokens=False).ids) for r in helpers.rows()]


@pytest.mark.parametrize("name", FILES)
def test_ids_and_counts_equal_the_library(name):
    import pyarrow as pa

    texts = [r[1] or "" for r in helpers.rows()]
    wanted = [x for _, x in ids_of(name)]
    ids, offsets = ChunkEncoder(tokenizer_path(name)).ids(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == wanted
    assert PrefixCounter(tokenizer_path(name)).counts(pa.array(texts)).tolist() == [len(x) for x in wanted]


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("most", (3, 400_000))
def test_plain_texts_are_encoded_many_pieces_at_once(name, most):
    import pyarrow as pa

    texts = ["", " ", "\n", "The end", " it's 12'll ", "don't\n 'll x", "a\x01b, c", "é</w> </w>a</w>", "ÀÉ éà.", "=" * 700 + " a", "aaaa" * 300, *(f"w{i} é{i * 7919 % 5003}x, " for i in range(20_000))]
    own, t = ChunkEncoder(tokenizer_path(name), most), library(name)
    own.model = None  # it takes a call and a list of objects for each piece
    for some in (texts, texts[:9], [], [""], texts[::-3]):
        ids, offsets = own.ids(pa.array(some, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [e.ids for e in t.encode_batch_fast(some, add_special_tokens=False)]


@pytest.mark.parametrize("name", FILES)
def test_an_encoder_keeps_no_objects_for_its_pieces(name):
    import gc
    import tracemalloc

    import pyarrow as pa

    own = ChunkEncoder(tokenizer_path(name))
    texts = pa.array([" ".join(f"{chr(97 + i % 26)}x{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}q" for i in range(k, k + 100)) for k in range(0, 40_000, 100)])
    tracemalloc.start()
    own.ids(texts)
    gc.collect()
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 3 << 20  # 40,000 pieces of some ids each


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=40, deadline=None)
@given(text=st.text("abethion ABÉ.,'sl3\n!?é", max_size=24))
def test_every_prefix(name, text):
    counter, own = _counter(name)
    table = counter.table(text)
    for n in range(len(text) + 1):
        assert table.count(n) == len(own.encode(text[:n], add_special_tokens=False).ids)
    for budget in (0, 1, 3):
        assert table.fits(budget) == max(n for n in range(len(text) + 1) if table.count(n) <= budget)


_made = {}


def _counter(name):
    if name not in _made:
        _made[name] = PrefixCounter(tokenizer_path(name)), library(name)
    return _made[name]


def test_count_operator(docs, none):
    got = Counter(tuple(r) for r in token_counts(docs, tokenizer_path(FILES[1]), limit=100).collect())
    wanted = Counter((i, len((r[1] or "").encode()), len(x), len(x) > 100) for r, (i, x) in zip(helpers.rows(), ids_of(FILES[1]), strict=True))
    assert got == wanted
    assert token_counts(none, tokenizer_path(FILES[1])).count() == 0
    small = token_budgets(docs.where("doc_id in (0, 1, 12)"), tokenizer_path(FILES[1]), [5]).collect()
    assert len(small) == 3 and all(r["n_tokens"] <= 5 for r in small)


def test_packing(docs, none):
    length = 128
    rows = pack(docs, tokenizer_path(FILES[0]), length=length).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0] + [n for _, n in s])[:-1].tolist() and sum(n for _, n in s) <= length
    for doc, ids in ids_of(FILES[0]):
        if doc == 18:
            continue
        ids, at = np.array([*ids, 0], "<u4"), 0
        for k, r in enumerate(sorted(pieces[doc], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == length)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert len(pieces[18]) % 2 == 0
    assert len(sequences) <= -(-sum(r["length"] for r in rows) // length) + 2
    assert pack(none, tokenizer_path(FILES[0])).count() == 0


def test_stages_of_large_tables_hold_little_at_once(docs, spark, monkeypatch):
    from ribostrand.llm import jaccard, packing

    plans, rows = {}, {}

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().sparkPlan().toString()
        rows[name] = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        return real(df, name)

    real = packing.stored
    monkeypatch.setattr(packing, "stored", seen)
    monkeypatch.setattr(jaccard, "stored", seen)
    pack(docs, tokenizer_path(FILES[0]))
    jaccard.classes(docs)
    assert rows["pieces"] <= 2_000 < rows["piece-counts"]
    # entries, of which few occur twice in a task, are dealt out before they are counted
    assert "RepartitionByExpression" in plans["shared"] or "REPARTITION_BY_COL" in plans["shared"]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=20))
def test_plan(histogram):
    plan = packing_plan(histogram, 32)
    used = Counter()
    for pattern, m in plan:
        assert m > 0 and sum(pattern) <= 32
        for x in pattern:
            used[x] += m
    assert used == Counter(histogram)
    lengths = np.array([x for x, n in histogram.items() for _ in range(n)], np.int64)
    numbers = np.array([i for _, n in histogram.items() for i in range(n)], np.int64)
    sequence, offset = Slots(plan).place(lengths, numbers)
    taken = {(s, o + i) for s, o, n in zip(sequence, offset, lengths, strict=True) for i in range(n)}
    assert len(taken) == lengths.sum()


def test_exact_complements_come_first():
    assert sorted(packing_plan({20: 2, 12: 1, 5: 1, 7: 1}, 32)) == [((20, 7, 5), 1), ((20, 12), 1)]


def test_token_files(spark, docs, none):
    manifest = write_token_files(docs, tokenizer_path(FILES[1])).cache()
    got = read_token_files(spark, manifest, with_ids=True).orderBy("start").collect()
    wanted = sorted(((i, [*x, 1]) for i, x in ids_of(FILES[1])), key=lambda t: (t[0] is not None, t[0]))
    at = 0
    assert len(got) == len(wanted)
    for r, (doc, ids) in zip(got, wanted, strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (doc, at, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert read_token_files(spark, write_token_files(none, tokenizer_path(FILES[1]))).count() == 0


def test_random_access_and_checksums():
    out = io.BytesIO()
    writer = TokenFileWriter(out, 2)
    for k in range(300):
        writer.add(k, np.arange(k * 37 % 3000, dtype=np.uint32))
    writer.add(300, np.arange(200_000, dtype=np.uint32) % 60_000)
    writer.close()
    raw = out.getvalue()
    f = TokenFile(io.BytesIO(raw), len(raw))
    assert f.ids(299).tolist() == list(range(299 * 37 % 3000)) and len(f.ids(300)) == 200_000 and f.find(7)[0].tolist() == list(range(259)) and f.find(1000) == []
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert len(whole) == f.frames.starts[-1]
    broken = bytearray(raw)
    broken[-12] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        g = TokenFile(io.BytesIO(bytes(broken)), len(broken))
        [g.ids(k) for k in range(301)]
