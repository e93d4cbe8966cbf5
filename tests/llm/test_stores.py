"""WARC round trip, exact top-k search and the pipeline."""

import gzip
import hashlib
import io
from collections import Counter

import helpers
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ribostrand.llm import knn, warc


def test_warc(spark):
    same = "<html>" + "x" * 200
    rows = [(5, "http://a", same), (3, None, same), (9, "http://b\r\nc", same), (4, "u", "short"), (6, "u", "short"), (7, "v", None), (8, "w", ""), (None, "n", same), (2, "z", "<p>é\r\n\r\nWARC/1.1\r\n" * 40), (2, "z", "<p>é\r\n\r\nWARC/1.1\r\n" * 40)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    got = Counter(tuple(r) for r in warc.archive_round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())

    def row(page, html):
        raw = (html or "").encode()
        first = {same: 3, rows[-1][2]: 2}.get(html)
        revisit = first is not None and page != first
        return (page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None)

    assert got == Counter(row(p, h) for p, _, h in rows)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_members_stand_alone():
    parts = [warc.record(k, f"http://x/{k}", b"payload %d" % k * (k * 1000), 9, "0", None, False, "1970-01-01T00:00:00Z") for k in range(1, 6)]
    out, index = io.BytesIO(), io.BytesIO()
    assert warc.normalise_file(io.BytesIO(gzip.compress(b"".join(parts))), out, index) == 5
    assert gzip.decompress(out.getvalue()) == b"".join(parts)
    for line, part in zip(index.getvalue().decode().splitlines(), parts, strict=True):
        offset, length = map(int, line.split("\t")[:2])
        assert gzip.decompress(out.getvalue()[offset : offset + length]) == part
    with pytest.raises((EOFError, ValueError)):
        warc.normalise_file(io.BytesIO(gzip.compress(b"".join(parts)[:-50])), io.BytesIO(), io.BytesIO())


def test_knn(spark):
    rng = np.random.default_rng(3)
    vectors = [rng.normal(size=6).round(2).tolist() for _ in range(400)] + [[0.5] * 6] * 60
    rows = [(i, v, 1) for i, v in enumerate(vectors)] + [(1000, None, 1), (1001, [0.1, None, 0.2, 0.3, 0.4, 0.5], 1), (1002, [float("nan")] * 6, 1), (1003, [float("inf")] * 6, 1), (1100, [1.0, 2.0], 1), (1101, [1.0, 3.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in knn.top_k(df, F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score").collect())
    ints = {i: np.floor(1024 * np.array(v)).astype(int) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    wanted = []
    for q in sorted(i for i in ints if i % 20 == 0):
        best = sorted((-int(ints[q] @ x), i) for i, x in ints.items() if i != q and len(x) == len(ints[q]))[:10]
        wanted += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(wanted)
    assert knn.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_knn_of_clusters(spark, monkeypatch):
    """Many pivots and blocks, clusters of several lengths, repeated ids of queries, vectors of zeros."""
    monkeypatch.setattr(knn, "QUERIES_A_PIVOT", 3)
    monkeypatch.setattr(knn, "BLOCK", 60)
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(12, 8)) * 3
    rows = [(i, (centres[i % 12] * (1 + i % 3) + rng.normal(size=8) * 0.05).round(3).tolist()) for i in range(900)]
    rows += [(40, rows[41][1]), (40, rows[40][1]), (60, rows[60][1]), (2000, [0.0] * 8), (2001, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter(tuple(r) for r in knn.top_k(df, F.col("vec_id") % 20 == 0, k=7).select("query_id", "rank", "vec_id", "score").collect())
    ints = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v in rows]
    for q in {i for i, _ in ints if i % 20 == 0} - {40, 60}:
        own = next(x for i, x in ints if i == q)
        best = sorted((-int(own @ x), i) for i, x in ints if i != q)[:7]
        assert all(got[q, k + 1, i, -s] == 1 for k, (s, i) in enumerate(best))


def test_pipeline(spark, tmp_path):
    docs = helpers.documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    toxic = [(300 + i, helpers.prose(300 + i, 40) + (" what an idiot" if i % 4 == 0 else ""), "en", "s", 0) for i in range(120)]
    item = helpers.prose(900, 30)
    flat = helpers.prose(950, 200).replace("\n", " ")
    docs = docs.unionByName(spark.createDataFrame([*toxic, (800, "begin " + item, "en", "s", 0), (810, flat, "en", "s", 0), (811, flat.replace(" ", " other ", 1), "en", "s", 0)], docs.schema))
    base = str(tmp_path)
    docs.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(300 + i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{base}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, base)
        if k < 4:
            assert out.columns == docs.columns
            out.write.parquet(f"{base}/stage{k}")
            now = spark.read.parquet(f"{base}/stage{k}")
            kept.append({r["doc_id"]: r["text"] for r in now.collect()})
        else:
            assert {r["doc_id"] for r in out.collect()} == set(kept[-1])
    clean = {300 + i for i in range(120) if i % 4}
    assert clean <= set(kept[0]) and not {300 + i for i in range(0, 120, 4)} & set(kept[0])
    assert 11 in kept[0] and 11 not in kept[1] and clean <= set(kept[1])
    assert {810, 811} <= set(kept[1]) and 810 in kept[2] and 811 not in kept[2] and clean <= set(kept[2])
    assert 800 in kept[2] and 800 not in kept[3] and clean <= set(kept[3])
