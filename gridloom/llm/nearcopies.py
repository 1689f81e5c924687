"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

SimHash alone cannot name them: fingerprints of two such texts differ in about ten of 64 bits, and a trie join with so
wide a budget prunes nothing. So the trie join of ``simhash`` finds the closest texts, in its budget of three bits, and
bands of MinHash values find the rest: with 32 bands of 4 values a pair at 0.8 shares none with probability
(1 - 0.8**4)**32, 5 in 10**8. Every candidate pair of two components is confirmed by the exact similarity of the texts.

Bands that many texts share (copies with other words changed, a passage that fills half of a text) would give all their
pairs. There texts meet by their rarest shingles: order all shingles by how many of these texts have them; of two
similar texts, what the first common shingle and those after it leave in each is at least what the similarity asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common, simhash
from .components import components

WORDS = 5
SEED = 42
#: Least similarity, as a fraction.
SIMILAR = (4, 5)
BANDS, ROWS = 32, 4
#: Shingles that are hashed together.
CHUNK = 8_192
#: Nodes of a band that may be paired with each other; those of a larger band meet by their rarest shingles.
CROWD = 16
#: Pairs whose sets of shingles are held together.
TOGETHER = 250
_MIX = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS), dtype=np.uint64)
_TIMES, _FLIP = _MIX[0] | np.uint64(1), _MIX[1]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Ascending XXH64 values of the text's different shingles; a shorter text is one shingle, none has no words."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(b" ".join(found), SEED)], dtype=np.uint64)
    return np.unique(np.array([digest(b" ".join(w), SEED) for w in zip(*(found[k:] for k in range(words)))], dtype=np.uint64))


def bands(values: np.ndarray) -> np.ndarray:
    """One hash for each band of the MinHash values of these shingles."""
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(values), CHUNK):
        part = values[at : at + CHUNK]
        for k in range(BANDS * ROWS):
            least[k] = min(least[k], ((part ^ _FLIP[k]) * _TIMES[k]).min())
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))], dtype=np.uint64).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def majority(values: np.ndarray) -> int:
    """SimHash fingerprint of these shingles; none: 0."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(values), CHUNK):
        ones += np.unpackbits(values[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(values)).astype(np.uint8), bitorder="little").view("<i8")[0])


def _sketches(rows: DataFrame) -> DataFrame:
    """doc_id, h (of the text), s (digest of the set of shingles), n (size of the set), fp (its fingerprint), bands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.make_room()
        for batch in batches:
            sets = [shingles(t) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"),
                "h": batch["h"],
                "s": np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], dtype=np.uint64).view(np.int64),
                "n": [len(x) for x in sets],
                "fp": [majority(x) for x in sets],
                "bands": [bands(x) for x in sets],
            })

    return rows.mapInPandas(run, "doc_id long, h long, s long, n long, fp long, bands array<long>")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), TOGETHER):
                part = batch.iloc[start : start + TOGETHER]
                known: dict[int, np.ndarray] = {}
                for side in "ab":
                    for s, text in zip(part[side], part[f"text_{side}"]):
                        if s not in known:
                            known[s] = shingles(text)
                near = [similar(known[a], known[b]) for a, b in zip(part["a"], part["b"])]
                yield part.loc[near, ["a", "b"]]

    side = lambda x: texts.select(F.col("s").alias(x), F.col("text").alias(f"text_{x}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInPandas(run, "a long, b long")


def _alike_in_size(pairs: DataFrame) -> DataFrame:
    return pairs.where(SIMILAR[1] * F.least("na", "nb") >= SIMILAR[0] * F.greatest("na", "nb")).select("a", "b").distinct()


def _rarest(texts: DataFrame) -> DataFrame:
    """s, n, shingle, rest: of each text (s, text) the rarest shingles that any text similar to it may have first in
    common with it. ``rest``: its shingles from this one on, rarest first, that another of the texts has as well."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), TOGETHER):
                part = batch.iloc[start : start + TOGETHER]
                sets = [shingles(t) for t in part["text"]]
                sizes = np.array([len(x) for x in sets])
                yield pd.DataFrame({"s": np.repeat(part["s"].to_numpy("int64"), sizes), "n": np.repeat(sizes, sizes), "shingle": np.concatenate(sets).view(np.int64)})

    every = common.shared_table(texts.select("s", "text").mapInPandas(run, "s long, n long, shingle long"), "shingles")
    shared = every.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    rest = F.row_number().over(W.partitionBy("s").orderBy(F.col("df").desc(), F.col("shingle").desc()))
    found = every.join(shared, "shingle").withColumn("rest", rest.cast("long")).where(SIMILAR[1] * F.col("rest") >= SIMILAR[0] * F.col("n"))
    return common.shared_table(found.select("s", "n", "shingle", "rest"), "rarest")


def _meet(rarest: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b, na, nb) of two components that may be similar by what their shingles leave. Nodes of one component, size
    and shingle first meet as one, so that a large component costs its sizes and not its nodes."""
    enough = lambda x, y: sum(SIMILAR) * F.least(x, y) >= SIMILAR[0] * (F.col("na") + F.col("nb"))
    lines = common.shared_table(rarest.join(roots, "s", "left").withColumn("root", F.coalesce("root", "s")), "lines")
    most = common.shared_table(lines.groupBy("shingle", "root", "n").agg(F.max("rest").alias("rest")), "most")
    one = lambda df, x, *more: df.select("shingle", *[F.col(c).alias(f"{c}{x}") for c in ("root", "n", "rest", *more)])
    # the smaller text leaves more of itself, so fewer of its shingles count
    smaller = most.where(sum(SIMILAR) * F.col("rest") >= 2 * SIMILAR[0] * F.col("n"))
    both = one(most, "a").join(one(smaller, "b"), "shingle").where((F.col("roota") != F.col("rootb")) & (F.col("nb") <= F.col("na")) & enough("resta", "restb"))
    both = common.shared_table(both.select("shingle", "roota", "na", "rootb", "nb"), "both")
    found = both.join(one(lines, "a", "s"), ["shingle", "roota", "na"]).where(enough("resta", "resta"))
    found = found.join(one(lines, "b", "s"), ["shingle", "rootb", "nb"]).where(enough("resta", "restb"))
    return found.select(F.greatest("sa", "sb").alias("a"), F.least("sa", "sb").alias("b"), "na", "nb")


def _groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """``_grouped``, with texts in small batches: all its jobs with texts are over when it returns."""
    with common.small_batches(df.sparkSession):
        return _grouped(df, key, text)


def _grouped(df: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, text_hash, root (the smallest node reachable) and component_id of each row."""
    rows = df.select(F.col(key).cast("long").alias("doc_id"), common.text_or_empty(text).alias("text")).withColumn("h", F.xxhash64("text"))
    sketches = common.shared_table(_sketches(rows), "sketches")
    nodes = sketches.groupBy("s").agg(F.min("doc_id").alias("least"), F.min("h").alias("h"), F.first("n").alias("n"), F.first("fp").alias("fp"))
    nodes = common.shared_table(nodes, "nodes")
    # a node alone in a band has no pair there
    every = sketches.select("s", "n", F.posexplode("bands").alias("place", "band")).drop("place").distinct()
    heads = every.groupBy("band").agg(F.min(F.struct("s", "n")).alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1")
    met = common.shared_table(every.join(heads, "band").select("band", "s", "n", "head", "size"), "bands")
    with_texts = lambda some: rows.join(some, "h").select("s", "text").dropDuplicates(["s"])
    crowded = met.where(F.col("size") > CROWD)
    crowd = common.shared_table(crowded.select("s").distinct().join(nodes.select("s", "h"), "s"), "crowd")
    rarest = None if crowd.isEmpty() else _rarest(with_texts(common.bounded(crowd)))
    met = met.where(F.col("size") <= CROWD)
    # nodes of one fingerprint are paired with the first of them, and so are those of two that the trie join links
    prints = common.shared_table(nodes.groupBy("fp").agg(F.min(F.struct("s", "n")).alias("head")), "prints")
    linked = simhash.links(prints.select("fp"))
    first_of = lambda side: prints.select(F.col("fp").alias(side), F.col("head").alias(f"h{side}"))
    near = linked.join(first_of("a"), "a").join(first_of("b"), "b").select("ha", "hb").union(nodes.join(prints, "fp").where("s <> head.s").select(F.struct("s", "n"), "head"))
    near = near.union(met.where("s <> head.s").select(F.struct("s", "n"), "head"))
    if rarest is not None:
        # the head of a crowded band has most in common with others; nodes without rare shingles have no link there
        inside = crowded.select("band", "s").join(rarest.groupBy("s", "n").agg(F.max("rest").alias("rest")), "s")
        inside = common.shared_table(inside.withColumn("alone", 1 - F.col("rest") / F.col("n")), "inside")
        central = inside.groupBy("band").agg(F.min(F.struct("alone", "s", "n")).alias("head"))
        near = near.union(inside.join(central, "band").where("s <> head.s").select(F.struct("s", "n"), F.struct("head.s", "head.n")))
    first = _alike_in_size(near.select(F.greatest("ha.s", "hb.s").alias("a"), F.least("ha.s", "hb.s").alias("b"), F.col("ha.n").alias("na"), F.col("hb.n").alias("nb")))
    first = common.shared_table(first, "first")
    needed = met.select("s").union(first.select("a")).union(first.select("b")).distinct()
    needed = needed if rarest is None else needed.union(rarest.select("s")).distinct()
    texts = common.shared_table(with_texts(needed.join(nodes.select("s", "h"), "s")), "texts")
    links = common.shared_table(_confirmed(first, texts), "links")
    roots = components(links).withColumnRenamed("node", "s")
    placed = common.shared_table(met.select("band", "s", "n").join(roots, "s", "left").withColumn("root", F.coalesce("root", "s")), "placed")
    apart = placed.select("band", "root").distinct()
    across = apart.alias("x").join(apart.alias("y"), "band").where("x.root < y.root").select("band", F.col("x.root").alias("ra"), F.col("y.root").alias("rb"))
    one = lambda x: placed.select("band", F.col("root").alias(f"r{x}"), F.col("s").alias(x), F.col("n").alias(f"n{x}"))
    second = across.join(one("a"), ["band", "ra"]).join(one("b"), ["band", "rb"])
    second = second.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "na", "nb")
    second = second if rarest is None else second.union(_meet(rarest, roots))
    second = _alike_in_size(second).join(first, ["a", "b"], "left_anti")
    links = links.union(common.shared_table(_confirmed(second, texts), "links"))
    named = nodes.join(components(links).withColumnRenamed("node", "s"), "s", "left").select("s", "least", F.coalesce("root", "s").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return sketches.select("doc_id", F.col("h").alias("text_hash"), "s").join(named.select("s", "root").join(smallest, "root"), "s").select("doc_id", "text_hash", "root", "component_id")


def groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, component_id (smallest doc_id reachable over similar texts).

    Null and empty texts have no words and are alike. Texts with the same shingles are one node. A first round confirms
    each node against the least node of its fingerprint and of its bands, and the pairs of fingerprints that the trie
    join links; the second confirms all pairs of nodes that share a band and are not in one component yet. In a band of
    more than ``CROWD`` nodes the first round takes the node with fewest shingles of its own, and the second those pairs
    that the rarest shingles allow, so that a large group of near copies does not cost all its pairs.
    """
    return _groups(df, key, text).select("doc_id", "component_id")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Keeps the row with the smallest key of each component; see ``common.one_of_each`` for rows that repeat a key."""
    return common.one_of_each(df, _groups(df.where(F.col(key).isNotNull()), key, text), key, text)
