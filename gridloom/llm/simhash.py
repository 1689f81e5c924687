"""SimHash near-duplicates by a self-join of the fingerprints' binary trie.

Two nodes of the trie are walked down together. Each step where they take different branches spends one bit of the
Hamming budget, and a pair of nodes is dropped when the budget is spent. Sorted fingerprints are the trie: a node is
a range, and its children are split where the next bit turns to one. A task walks all pairs of subtrees dealt to it
at once, level by level, in arrays.

Tasks get subtrees of four tries. If two fingerprints differ in at most three bits, one of four blocks of their bits is
equal; each trie reads another block first, so only nodes below one value of that block need be walked, and each
fingerprint is copied four times however many there are. A node that very many share is cut again, by blocks of the
bits that follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

WORDS = 3
SEED = 42
BUDGET = 3
#: Node pairs with at most this many leaf pairs are compared leaf by leaf.
LEAF_PAIRS = 16
#: Node pairs (and leaf pairs) walked at once; more wait their turn.
FRONTIER = 2_000_000
#: Fingerprints below one node that are walked in one task; a larger node is cut by the blocks of its other bits.
NODE_ROWS = 1 << 18
#: Times that a node can be cut. What is left then shares at least 43 bits, so it holds at most 2**21 fingerprints.
CUTS = 4
#: Large nodes are broadcast up to so many; there are at most ``4 / NODE_ROWS`` of them for each fingerprint.
BROADCAST_NODES = 1_000_000


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Majority of the bits of the shingles' XXH64, repeats included; no words: 0."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        hashes = [digest(b" ".join(found), SEED)]
    else:
        hashes = [digest(b" ".join(w), SEED) for w in zip(*(found[k:] for k in range(words)))]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):  # a long text needs no large matrix
        block = np.array(hashes[at : at + 65_536], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, text_hash (null text counts as empty) and fp, the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints = np.array([fingerprint(t, words) for t in batch["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text_hash": batch["text_hash"], "fp": prints})

    rows = df.select(F.col(key).cast("long").alias("doc_id"), common.text_or_empty(text).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInPandas(run, "doc_id long, text_hash long, fp long")


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the same components as a-b among n nodes: one from each node to the least of its component."""
    least = np.arange(n)
    while True:
        before = least.copy()
        np.minimum.at(least, a, least[b])
        np.minimum.at(least, b, least[a])
        least = least[least]
        if (least == before).all():
            moved = np.flatnonzero(least != np.arange(n))
            return moved, least[moved]


def walk(values: np.ndarray, pairs: np.ndarray, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between ``values`` (unsigned, ascending inside each range) as positions.

    ``pairs``: one row (start, end, start, end, budget left) for each pair of nodes, all cut at ``depth`` bits; a node
    paired with itself has equal ranges. What is returned joins the same components as all links within the budget.
    """
    found_a, found_b, held = [], [], 0
    ones: dict[int, np.ndarray] = {}
    waiting = [(depth, *pairs.T.astype(np.int64))]

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal found_a, found_b, held
        found_a.append(a)
        found_b.append(b)
        held += len(a)
        if held > FRONTIER:
            a, b = _forest(np.concatenate(found_a), np.concatenate(found_b), len(values))
            found_a, found_b, held = [a], [b], 0

    def leaves(l1, h1, l2, h2) -> None:
        size = (h1 - l1) * (h2 - l2)
        ends = np.cumsum(size)
        for first in range(0, len(size), FRONTIER // LEAF_PAIRS):
            part = slice(first, first + FRONTIER // LEAF_PAIRS)
            s, total = size[part], int(size[part].sum())
            which = np.repeat(np.arange(len(s)), s)
            k = np.arange(total) - np.repeat(ends[part] - s - (ends[part][0] - s[0]), s)
            wide = (h2 - l2)[part][which]
            a, b = l1[part][which] + k // wide, l2[part][which] + k % wide
            near = (np.bitwise_count(values[a] ^ values[b]) <= budget) & (a != b)
            keep(a[near], b[near])

    while waiting:
        depth, l1, h1, l2, h2, room = waiting.pop()
        if len(l1) > FRONTIER:
            half = len(l1) // 2
            waiting.append((depth, l1[:half], h1[:half], l2[:half], h2[:half], room[:half]))
            waiting.append((depth, l1[half:], h1[half:], l2[half:], h2[half:], room[half:]))
            continue
        small = ((h1 - l1) * (h2 - l2) <= LEAF_PAIRS) | (depth == 64)
        if small.any():
            leaves(l1[small], h1[small], l2[small], h2[small])
            l1, h1, l2, h2, room = (x[~small] for x in (l1, h1, l2, h2, room))
        if not len(l1):
            continue
        if depth not in ones:
            bit = (values >> np.uint64(63 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
        c = ones[depth]
        m1, m2 = h1 - (c[h1] - c[l1]), h2 - (c[h2] - c[l2])
        alike = (l1 == l2) & (h1 == h2)
        parts = []
        for x1, y1, x2, y2, cost, may in ((l1, m1, l2, m2, 0, True), (m1, h1, m2, h2, 0, True), (l1, m1, m2, h2, 1, True), (m1, h1, l2, m2, 1, ~alike)):
            ok = (y1 > x1) & (y2 > x2) & (room >= cost) & may
            parts.append([x[ok] for x in (x1, y1, x2, y2, room - cost)])
        waiting.append((depth + 1, *(np.concatenate(x) for x in zip(*parts))))
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _forest(np.concatenate(found_a), np.concatenate(found_b), len(values))


def _turned(fixed: int, by: int):
    """``rot`` with its bits after the first ``fixed`` turned to the left by ``by``."""
    if not by:
        return F.col("rot")
    mask = F.lit(-1 if not fixed else (1 << (64 - fixed)) - 1).cast("long")
    rest = F.col("rot").bitwiseAND(mask)
    turned = F.shiftleft(rest, by).bitwiseAND(mask).bitwiseOR(F.shiftrightunsigned(rest, 64 - fixed - by))
    return F.col("rot").bitwiseAND(F.bitwise_not(mask)).bitwiseOR(turned)


def _cut(rows: DataFrame, fixed: int, budget: int) -> tuple[DataFrame, int]:
    """Copies of ``rows`` (node, rot, fp), whose nodes share ``fixed`` bits, one for each block of the bits that follow:
    the bits are turned so that the block comes next, and rows with the same block share a node. Also: bits shared now."""
    ends = [(64 - fixed) * k // (budget + 1) for k in range(budget + 2)]
    copies = F.array(*[F.struct(F.lit(k).alias("k"), _turned(fixed, ends[k]).alias("rot"), F.lit(64 - fixed - ends[k + 1] + ends[k]).alias("free")) for k in range(budget + 1)])
    moved = rows.select("node", "fp", F.explode(copies).alias("c")).select("node", "fp", "c.*")
    shared = F.call_function("shiftrightunsigned", F.col("rot"), F.col("free"))
    return moved.select(F.xxhash64("node", "k", shared).alias("node"), "rot", "fp"), fixed + min(b - a for a, b in zip(ends, ends[1:]))


def links(distinct: DataFrame, budget: int = BUDGET, node_rows: int = NODE_ROWS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that join the same components as all pairs within
    ``budget`` bits. ``distinct`` is read once for each cut, so hand in a written table."""
    dealt, fixed = _cut(distinct.select(F.lit(0).cast("long").alias("node"), F.col("fp").alias("rot"), "fp"), 0, budget)
    ready = None
    if distinct.count() > node_rows:
        for _ in range(CUTS - 1):
            large = common.shared_table(dealt.groupBy("node").count().where(F.col("count") > node_rows).select("node"), "large")
            n = large.count()
            if not n:
                break
            dealt = common.shared_table(dealt, "nodes")
            large = F.broadcast(large) if n <= BROADCAST_NODES else large
            small = dealt.join(large, "node", "left_anti")
            ready = small if ready is None else ready.union(small)
            dealt, fixed = _cut(dealt.join(large, "node", "left_semi"), fixed, budget)
    whole = dealt if ready is None else ready.union(dealt)
    whole = whole.repartition(common.tasks(distinct) * 4, "node").sortWithinPartitions("node")

    def join(node: np.ndarray, rot: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        values = rot.view(np.uint64)
        order = np.lexsort((values, node))
        node, values, fp = node[order], values[order], fp[order]
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        ends = np.concatenate([starts[1:], [len(node)]])
        some = ends - starts > 1
        pairs = np.stack([starts[some], ends[some], starts[some], ends[some], np.full(some.sum(), budget)], axis=1)
        a, b = walk(values, pairs, 0, budget)
        return pd.DataFrame({"a": fp[a], "b": fp[b]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            last = batch["node"].iloc[-1]
            if size >= node_rows and held[0]["node"].iloc[0] != last:
                rows = pd.concat(held)
                done = rows["node"] != last  # the last node may go on in the next batch
                yield join(*(rows.loc[done, c].to_numpy("int64") for c in ("node", "rot", "fp")))
                held = [rows[~done]]
                size = len(held[0])
        if size:
            rows = pd.concat(held)
            yield join(*(rows[c].to_numpy("int64") for c in ("node", "rot", "fp")))

    return whole.mapInPandas(run, "a long, b long")


def _groups(df: DataFrame, key: str, text: str, words: int, budget: int) -> DataFrame:
    """doc_id, text_hash, fp, root (the smallest fingerprint reachable) and component_id of each row."""
    prints = common.shared_table(fingerprints(df, key, text, words), "fingerprints")
    classes = common.shared_table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes.select("fp"), budget)).withColumnRenamed("node", "fp")
    named = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(named.select("fp", "root").join(smallest, "root"), "fp")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, budget: int = BUDGET) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null and empty texts have no words and fingerprint zero, linked like any other. Rows that repeat stay. A null
    doc_id takes part but is never a component's id (null if the component has no other). Only key and text are read.
    """
    found = _groups(df, key, text, words, budget)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, budget: int = BUDGET) -> DataFrame:
    """Keeps the row with the smallest key of each component; see ``common.one_of_each`` for rows that repeat a key."""
    return common.one_of_each(df, _groups(df.where(F.col(key).isNotNull()), key, text, words, budget), key, text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))
