"""Merkle manifest of a table, and authentication paths of all its rows by fractal traversal.

Every row is a leaf, hashed in the JVM where it is read: the digest of its
columns, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value. The
leaves of a group ascend by key; every two consecutive nodes become their
digest, a last odd one is hashed alone, until one node remains: the group's
root. The roots of the groups, ordered by group (null first, bytewise), give the
root of the table in the same way. Digests are lower-case hex SHA-256, and what
is hashed is text.

Spark deals with whole groups only in blocks of 2**BLOCK neighbouring nodes.
Leaves are range-sorted by group and key, so that one group, however large, lies
in many partitions; counts of the partitions give each leaf its rank, and rank
and group give its block. The roots of blocks are the nodes of the next round,
until each group has one. Then proofs are made from the top down: the rows of a
block meet the proof of the block's root (one row), and the block is traversed.

The traversal of a block is fractal: its levels are cut into bands of STEP
levels, for each band the subtree that holds the present leaf exists, and the
subtree to its right is built by two steps of tree hashing for each leaf that is
passed, so it is ready when it is needed. That is 2 * STEP-level subtrees a band,
whatever the size of the block.

A proof is a list of steps from the leaf up: ``L`` or ``R`` (the side on which
the other node stands) and its digest, or ``-`` where there is no other.

Edge cases: null columns, null keys (they come first) and null groups are
defined above; very long texts are hashed where they are read and never move;
rows with equal group and key are ordered by their digest (equal rows are
interchangeable, and may lie in several partitions); a group of one row has its
leaf as root, a table of one group the group's root; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BLOCK = 12
STEP = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def parent(left: str | None, right: str | None) -> str | None:
    """Of two neighbours; one without a neighbour is hashed alone, and nothing is above nothing."""
    return None if left is None else digest(left + (right or ""))


class Subtree:
    """The nodes of levels low to high - 1 below one node of level high, made from its leaves one step at a time."""

    def __init__(self, leaves: Sequence[str], low: int, high: int, first: int):
        self.leaves, self.low, self.high, self.first = leaves, low, high, first
        self.at, self.end = first, first + (1 << high)
        self.stack: list[tuple[int, str | None]] = []
        self.rows: list[list[str | None]] = [[] for _ in range(high - low)]

    def _push(self, level: int, node: str | None) -> None:
        self.stack.append((level, node))
        if self.low <= level < self.high:
            self.rows[level - self.low].append(node)

    def grow(self, steps: int) -> Subtree:
        """Tree hashing: a step takes a leaf, or joins the two topmost nodes of the stack if they are of one level."""
        stack = self.stack
        for _ in range(steps):
            if len(stack) > 1 and stack[-1][0] == stack[-2][0]:
                (level, right), (_, left) = stack.pop(), stack.pop()
                self._push(level + 1, parent(left, right))
            elif self.at < self.end:
                self._push(0, self.leaves[self.at] if self.at < len(self.leaves) else None)
                self.at += 1
            else:
                break
        return self

    def whole(self) -> Subtree:
        return self.grow(2 << self.high)

    @property
    def root(self) -> str | None:
        return self.stack[0][1]

    def node(self, level: int, index: int) -> str | None:
        return self.rows[level - self.low][index - (self.first >> level)]


def block_height(nodes: int, block: int = BLOCK) -> int:
    """Levels between the nodes of a block and its root, of so many nodes in the whole group."""
    return block if nodes > 1 << block else (nodes - 1).bit_length()


def block_root(leaves: Sequence[str], height: int) -> str:
    return Subtree(leaves, height, height, 0).whole().root


def authentication_paths(leaves: Sequence[str], height: int, step: int = STEP) -> Iterator[list[str | None]]:
    """For each leaf in turn its neighbours from the bottom up (None where there is none)."""
    bounds = [*range(0, height, step), height]
    bands = list(zip(bounds[:-1], bounds[1:], strict=True))
    existing = [Subtree(leaves, low, high, 0).whole() for low, high in bands]
    desired = [Subtree(leaves, low, high, 1 << high) for low, high in bands[:-1]]
    for i in range(len(leaves)):
        yield [t.node(level, (i >> level) ^ 1) for t in existing for level in range(t.low, t.high)]
        for k, new in enumerate(desired):
            new.grow(2)
            if (i + 1) % (1 << new.high) == 0:
                existing[k], desired[k] = new, Subtree(leaves, new.low, new.high, i + 1 + (1 << new.high))


def as_steps(path: Sequence[str | None], index: int) -> list[str]:
    return ["-" if x is None else ("L" if index >> level & 1 else "R") + x for level, x in enumerate(path)]


def folded(leaf: str, steps: Sequence[str]) -> str:
    """The root that a leaf and the steps of a proof lead to."""
    for s in steps:
        other = s[1:]
        leaf = digest(other + leaf if s[0] == "L" else leaf + other)
    return leaf


def proof_digest(steps: Sequence[str]) -> str:
    return digest("".join(s[1:] for s in steps))


def field(column: Column) -> Column:
    value = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def ranked(df: DataFrame, group: str, name: str, order: Sequence[str]) -> DataFrame:
    """df (stored) with r, the place of a row in its group, and m, the rows of the group; name is the group's name, never null, group its value.

    A range sort, a count for each partition and group, and a join with the
    sums of the counts before; no group is in one task.
    """
    tie = F.monotonically_increasing_id()  # deals equal rows out, too
    keys = [group, *order, "tie"]
    placed = df.withColumn("tie", tie).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie").withColumn("n", F.monotonically_increasing_id())
    placed = stored(placed, "merkle-order").withColumn("part", F.shiftright("n", 33))
    runs = placed.groupBy("part", name).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("first"))
    earlier, all_parts = Window.partitionBy(name).orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(name)
    runs = runs.select("part", name, (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(all_parts).alias("m"))
    return placed.join(runs, ["part", name]).withColumn("r", F.col("n") + F.col("shift")).drop("part", "n", "shift")


def _block() -> Column:
    return F.shiftright("r", BLOCK).alias("block")


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Nodes (g, r, m, node) of all rounds, and the roots of the groups (g, node)."""

    def roots(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("r")
        m = int(block["m"].iloc[0])
        return pd.DataFrame({"g": [key[0]], "r": [key[1]], "m": [-(-m >> BLOCK)], "node": [block_root(block["node"].tolist(), block_height(m))]})

    most = nodes.agg(F.max("m")).first()[0] or 1
    rounds = []
    while True:
        rounds.append(nodes)
        blocks = nodes.select("g", "r", "m", "node").groupBy("g", _block())
        nodes = stored(blocks.applyInPandas(roots, "g string, r long, m long, node string"), "merkle-roots")
        if most <= 1 << BLOCK:
            return rounds, nodes.select("g", "node")
        most = -(-most >> BLOCK)


def descend(rounds: list[DataFrame], top: DataFrame) -> DataFrame:
    """Proofs (g, r, steps, subroot, root) of the nodes of the first of these rounds; top has those of the groups' roots."""
    above = top
    for nodes in reversed(rounds):
        above = stored(_with_paths(nodes.select("g", "r", "m", "node"), above, _proved, "g string, r long, steps array<string>, subroot string, root string"), "merkle-proofs")
    return above


def _with_paths(nodes: DataFrame, above: DataFrame, make, schema: str) -> DataFrame:
    """The nodes of each block with the one proof of the block's root."""

    def run(block: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        block, upper = block.sort_values("r"), upper.iloc[0]
        m = int(block["m"].iloc[0])
        more = list(upper["steps"])
        paths = authentication_paths(block["node"].tolist(), block_height(m))
        steps = [as_steps(p, i) + more for i, p in enumerate(paths)]
        return make(block, steps, upper)

    above = above.withColumnRenamed("r", "block")
    return nodes.withColumn("block", _block()).groupBy("g", "block").cogroup(above.groupBy("g", "block")).applyInPandas(run, schema)


def _proved(block: pd.DataFrame, steps: list[list[str]], upper: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"g": block["g"], "r": block["r"], "steps": steps, "subroot": upper["subroot"], "root": upper["root"]})


def _judged(block: pd.DataFrame, steps: list[list[str]], upper: pd.Series) -> pd.DataFrame:
    root = upper["root"]
    own = [folded(c if isinstance(c, str) else x, s) for c, x, s in zip(block["changed"], block["node"], steps, strict=True)]
    return pd.DataFrame({
        "doc_id": block["doc_id"].astype("Int64"), "leaf": block["node"], "subroot": upper["subroot"], "root": root,
        "proof_sha256": [proof_digest(s) for s in steps], "folded_root": own, "verified": [x == root for x in own],
    })


def _forest(df: DataFrame, key: str, group: str, columns: Sequence[str], changes: dict[str, Column], changed: Column) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of the leaves, and proofs (g, r = 0, steps, subroot, root) of the roots of the groups."""
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    own = [F.col(f"`{c}`") for c in columns]
    other = [changes.get(c, x) for c, x in zip(columns, own, strict=True)]
    leaves = df.select(F.col(key).cast("long").alias("doc_id"), F.col(group).cast("string").alias("lang"), name.alias("g"), leaf(own).alias("node"), F.when(changed, leaf(other)).alias("changed"))
    rounds, roots = climb(stored(ranked(stored(leaves, "merkle-leaves"), "lang", "g", ["doc_id", "node"]), "merkle-ranked"))
    # the groups' roots are the leaves of one more tree
    groups = roots.select(F.lit("").alias("g"), F.when(F.col("g") != "-", F.substring("g", 2, 2**31 - 1)).alias("lang"), F.col("g").alias("of"), "node")
    groups = stored(ranked(stored(groups, "merkle-groups"), "g", "g", ["lang"]), "merkle-ranked")
    more, root = climb(groups)
    top = root.select("g", F.lit(0).cast("long").alias("r"), F.array().cast("array<string>").alias("steps"), F.lit("").alias("subroot"), F.col("node").alias("root"))
    proofs = descend(more, top)
    return rounds, proofs.select("r", "steps", "root").join(groups.select("r", F.col("of").alias("g"), F.col("node").alias("subroot")), "r").select("g", F.lit(0).cast("long").alias("r"), "steps", "subroot", "root")


def proofs(df: DataFrame, key: str = "doc_id", group: str = "lang", columns: Sequence[str] = COLUMNS) -> DataFrame:
    """doc_id, group, leaf, and the steps that lead from it by way of the subroot to the root."""
    rounds, top = _forest(df, key, group, columns, {}, F.lit(False))

    def made(block: pd.DataFrame, steps: list[list[str]], upper: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": block["doc_id"].astype("Int64"), "lang": block["lang"], "leaf": block["node"], "steps": steps, "subroot": upper["subroot"], "root": upper["root"]})

    out = _with_paths(rounds[0], descend(rounds[1:], top), made, "doc_id long, lang string, leaf string, steps array<string>, subroot string, root string")
    return out.withColumnsRenamed({"doc_id": key, "lang": group})


def tampered(key: str = "doc_id", seventh: int = 7) -> Column:
    """Rows whose key, as decimal text, has a CRC-32 that the number divides."""
    return F.coalesce(F.crc32(F.col(key).cast("long").cast("string")) % seventh == 0, F.lit(False))


def manifest(df: DataFrame, changes: dict[str, Column] | None = None, changed: Column | None = None, key: str = "doc_id", group: str = "lang", columns: Sequence[str] = COLUMNS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    changes replaces columns of the rows where changed holds; those rows are
    folded from the changed leaf along the proof of the original one.
    """
    rounds, top = _forest(df, key, group, columns, changes or {}, F.lit(False) if changed is None else changed)
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _with_paths(rounds[0].select("g", "r", "m", "node", "doc_id", "changed"), descend(rounds[1:], top), _judged, schema).withColumnRenamed("doc_id", key)


def root_of(groups: dict[str | None, list[str]]) -> tuple[dict[str | None, str], str]:
    """Subroots and root of ordered leaves by plain recursion, for small tables and tests."""

    def up(nodes: list[str]) -> str:
        while len(nodes) > 1:
            nodes = [reduce(str.__add__, nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
            nodes = [digest(x) for x in nodes]
        return nodes[0]

    subroots = {k: up(v) for k, v in groups.items()}
    order = sorted(subroots, key=lambda k: (k is not None, (k or "").encode()))
    return subroots, up([subroots[k] for k in order])
