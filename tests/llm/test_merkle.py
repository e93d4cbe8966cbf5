"""Merkle manifest against plain recursion, for blocks of several sizes."""

import random
import zlib

import helpers
import pytest
from pyspark.sql import functions as F

from ribostrand.llm import merkle as M

COLUMNS = M.COLUMNS


def leaf_of(row):
    text = "".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in COLUMNS)
    return M.digest(text)


def plain(rows):
    """doc_id, leaf, subroot, root, proof, folded root, verified, by recursion over whole groups."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r), r))
    for g in groups.values():
        g.sort(key=lambda x: x[:3])
    subroots, root = M.root_of({k: [x[2] for x in g] for k, g in groups.items()})
    order = sorted(subroots, key=lambda k: (k is not None, (k or "").encode()))

    def path(nodes, i):
        out = []
        while len(nodes) > 1:
            out.append((nodes[i ^ 1] if i ^ 1 < len(nodes) else None, i & 1))
            nodes = [M.digest("".join(nodes[k : k + 2])) for k in range(0, len(nodes), 2)]
            i >>= 1
        return out

    out = []
    for lang, g in groups.items():
        nodes = [x[2] for x in g]
        above = path([subroots[k] for k in order], order.index(lang))
        for i, (_, _, own, r) in enumerate(g):
            x, siblings = own, path(nodes, i) + above
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None:
                x = leaf_of({**r, "n_chars": r["n_chars"] + 1})
            for s, right in siblings:
                x = M.digest(x if s is None else s + x if right else x + s)
            out.append((r["doc_id"], own, subroots[lang], root, M.digest("".join(s for s, _ in siblings if s)), x, x == root))
    return out


def same(got, wanted):
    key = lambda t: tuple(map(str, t))
    assert sorted(map(tuple, got), key=key) == sorted(wanted, key=key)


@pytest.mark.parametrize(("block", "step"), [(1, 1), (2, 3), (3, 2), (12, 3)])
def test_manifest(spark, monkeypatch, block, step):
    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "block_height", lambda nodes: block if nodes > 1 << block else (nodes - 1).bit_length())
    rng = random.Random(block)
    langs = ["en"] * 30 + ["é", "z", "", None, "de", "de", None, "fr", "fr", "fr"]
    rows = [{"doc_id": i * 3, "source": rng.choice(("s", None)), "lang": lang, "n_chars": rng.choice((5, None, 99)), "text": rng.choice(("", None, "é" * 9, f"t{i}"))} for i, lang in enumerate(langs)]
    rows += [{**rows[0]}, {**rows[0]}, {**rows[1], "text": "other"}, {**rows[2], "doc_id": None}, {**rows[2], "doc_id": None}]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*(r[c] for c in COLUMNS), "clash", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, node string, r int").repartition(4)
    got = M.manifest(df, {"n_chars": F.col("n_chars") + 1}, M.tampered())
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    wanted = plain(rows)
    same(got.collect(), wanted)
    assert 0 < sum(not w[-1] for w in wanted) < len(wanted)
    if block == 3:
        proofs = M.proofs(df).collect()
        assert all(M.folded(p["leaf"], p["steps"]) == p["root"] for p in proofs) and len(proofs) == len(rows)
        assert sorted((p["leaf"], M.proof_digest(p["steps"])) for p in proofs) == sorted((w[1], w[4]) for w in wanted)


def test_awkward_rows(docs, none):
    rows = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=False)) for r in helpers.rows()]
    same(M.manifest(docs, {"n_chars": F.col("n_chars") + 1}, M.tampered()).collect(), plain(rows))
    assert M.manifest(none).count() == 0 and M.proofs(none).count() == 0
    one = docs.where("doc_id = 6")
    (r,) = M.manifest(one).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["verified"] and r["proof_sha256"] == M.digest("")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 21, 64, 100])
@pytest.mark.parametrize("step", [1, 2, 3, 5])
def test_traversal(n, step):
    leaves = [M.digest(str(i)) for i in range(n)]
    height = (n - 1).bit_length()
    root = M.block_root(leaves, height)
    paths = list(M.authentication_paths(leaves, height, step))
    assert len(paths) == n and M.root_of({None: leaves})[1] == root
    assert all(M.folded(x, M.as_steps(p, i)) == root for i, (x, p) in enumerate(zip(leaves, paths, strict=True)))


def test_traversal_holds_few_nodes(monkeypatch):
    """Two subtrees for each band, never a whole level of the block."""
    most = 0

    class Watched(M.Subtree):
        made = []

        def __init__(self, *args):
            super().__init__(*args)
            Watched.made.append(self)

    monkeypatch.setattr(M, "Subtree", Watched)
    leaves = [M.digest(str(i)) for i in range(4096)]
    for _ in M.authentication_paths(leaves, 12, 3):
        live = Watched.made[-8:]
        most = max(most, max(len(row) for t in live for row in t.rows))
    assert most <= 8
