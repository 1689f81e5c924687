"""Nearest neighbours by a hash-prefix forest (after Bawa, Condie and Ganesan, 2005).

Each tree hashes a vector to a long string of bits, the sides of random hyperplanes it lies on, and keeps the strings of
all vectors as one sorted array, which lies in segments of a written table. A search descends each tree to the longest
prefix that its own string shares with the array and ascends all trees together, one bit at a time, until the prefixes
have met enough vectors. It then visits, in each tree, the few segments that hold its prefix: queries and segments meet
by an equal key, and no query meets a segment it shares nothing with. Segments hold vectors as bytes (eight bits a
component) to find a short list, which is ranked by exact inner products.

How far to ascend is fitted: ``FIT_QUERIES`` queries are compared with all vectors, and the search ascends until it has
met as many vectors as these needed for a recall of ``RECALL``. Everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

NEAREST = 20
QUERY_EVERY = 20
TREES = 32
BITS = 32
SEED = 20_240_607
#: Vectors in one segment of a tree; more where a forest would have over ``MOST_SEGMENTS`` segments, whose bounds (24
#: bytes each) every task knows.
SEGMENT_ROWS = 16_384
MOST_SEGMENTS = 1_000_000
#: Queries that the ascent is fitted on, and the recall it is fitted to.
FIT_QUERIES = 256
RECALL = 0.95
#: Candidates that are ranked exactly, beside the number asked for.
SPARE = 12
#: Queries scored against a range at once.
TOGETHER = 256


@lru_cache(maxsize=8)
def planes(dims: int, trees: int = TREES) -> np.ndarray:
    return np.random.default_rng([SEED, dims]).standard_normal((trees, dims, BITS)).astype(np.float32)


def strings(vectors: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Hash string of each vector in each tree (trees x vectors), as an unsigned number whose first bit is the highest.

    ``rest`` is one more component. For indexed vectors it makes all of them equally long, for queries it is zero, so
    that the largest inner product is the nearest direction (Neyshabur and Srebro, 2015).
    """
    longer = np.hstack([vectors, rest[:, None]]).astype(np.float32)
    return np.stack([np.packbits(longer @ n > 0, axis=1, bitorder="big").view(">u4").ravel() for n in planes(longer.shape[1])]).astype(np.uint32)


def shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the prefix that two strings share."""
    x = (a ^ b).astype(np.uint64)
    return BITS - np.ceil(np.log2(x + np.uint64(1))).astype(np.int64)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v): vectors that are not null, empty or zero and hold no null or non-finite component."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list())


def _by_width(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for start in range(0, len(batch), 2_048):
        part = batch.iloc[start : start + 2_048]
        yield from (g for _, g in part.groupby(part["v"].map(len), sort=False))


def build(nodes: DataFrame, rows: int) -> DataFrame:
    """The forest's segments: segment, dims, tree, n, low and high string, and the sorted strings with their nodes and
    vectors as binary arrays. ``nodes``: node, v, dims and rest."""

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _by_width(batch):
                v = _matrix(part["v"])
                made = strings(v, part["rest"].to_numpy())
                scale = np.abs(v).max(axis=1) / 127
                codes = np.rint(v / scale[:, None]).astype(np.int8)
                yield pd.DataFrame({
                    "dims": v.shape[1], "tree": np.repeat(np.arange(TREES), len(v)), "s": made.ravel().astype(np.int64), "node": np.tile(part["node"], TREES),
                    "scale": np.tile(scale.astype(np.float32), TREES), "code": [c.tobytes() for c in codes] * TREES,
                })

    def segment(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = [b for b in batches if len(b)]
        if not whole:
            return
        part, number = TaskContext.get().partitionId(), 0
        for (dims, tree), g in pd.concat(whole).groupby(["dims", "tree"], sort=True):
            yield pd.DataFrame({
                "segment": [(part << 20) + number], "dims": [dims], "tree": [tree], "n": [len(g)], "low": [g["s"].iloc[0]], "high": [g["s"].iloc[-1]],
                "strings": [g["s"].to_numpy().astype("<u4").tobytes()], "nodes": [g["node"].to_numpy("<i8").tobytes()],
                "scales": [g["scale"].to_numpy("<f4").tobytes()], "codes": [b"".join(g["code"])],
            })
            number += 1

    parts = min(MOST_SEGMENTS, rows * TREES // SEGMENT_ROWS + 1)
    made = nodes.select("node", "v", "rest").mapInPandas(entries, "dims int, tree int, s long, node long, scale float, code binary")
    ranges = made.repartitionByRange(parts, "dims", "tree", "s", "node").sortWithinPartitions("dims", "tree", "s", "node")
    kept = ranges.mapInPandas(segment, "segment long, dims int, tree int, n long, low long, high long, strings binary, nodes binary, scales binary, codes binary")
    return common.shared_table(kept, "forest")


class Bounds:
    """Where the segments of each tree begin and end: at most ``MOST_SEGMENTS`` of them, and one more for each tree."""

    def __init__(self, segments: DataFrame):
        table = segments.select("segment", "dims", "tree", "n", "low", "high").toPandas().sort_values(["dims", "tree", "low", "segment"])
        self.of = {k: {c: g[c].to_numpy() for c in ("segment", "n", "low", "high")} for k, g in table.groupby(["dims", "tree"])}

    def home(self, dims: int, tree: int, s: np.ndarray) -> np.ndarray:
        """The segment that holds, or would hold, each string."""
        t = self.of[dims, tree]
        return t["segment"][np.maximum(np.searchsorted(t["low"], s, side="right") - 1, 0)]

    def outside(self, dims: int, tree: int, segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lowest and highest strings and sizes of a tree's other segments."""
        t = self.of[dims, tree]
        other = t["segment"] != segment
        return t["low"][other], t["high"][other], t["n"][other]

    def touched(self, dims: int, tree: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position of the range, segment) for all segments that meet each range of strings."""
        t = self.of[dims, tree]
        first, stop = np.searchsorted(t["high"], low, side="left"), np.searchsorted(t["low"], high, side="right")
        many = np.maximum(stop - first, 0)
        which = np.repeat(np.arange(len(low)), many)
        return which, t["segment"][np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + first[which]]


def prefix_range(s: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest string with the same first ``bits`` bits."""
    fill = (np.int64(1) << (BITS - bits).astype(np.int64)) - 1
    return s & ~fill, s | fill


def met_counts(asked: DataFrame, segments: DataFrame, bounds) -> DataFrame:
    """q and met: how many vectors the trees meet, repeats included, at prefixes of 0 to ``BITS`` bits. Exact inside the
    segment where a query's string lies; beyond it whole segments are counted."""

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _by_width(batch):
                v = _matrix(part["v"])
                for tree, s in enumerate(strings(v, np.zeros(len(v))).astype(np.int64)):
                    if (v.shape[1], tree) in bounds.value.of:
                        yield pd.DataFrame({"segment": bounds.value.home(v.shape[1], tree, s), "q": part["q"].to_numpy(), "s": s})

    def count(visits: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(visits) or not len(held):
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "met": pd.Series(dtype=object)})
        row = held.iloc[0]
        array = np.frombuffer(row["strings"], "<u4").astype(np.int64)
        s = visits["s"].to_numpy()
        lows, highs, sizes = bounds.value.outside(int(row["dims"]), int(row["tree"]), int(row["segment"]))
        before_low, before_high = (np.concatenate([[0], np.cumsum(sizes)]) for _ in "ab")
        out = np.empty((len(s), BITS + 1), dtype=np.int64)
        for bits in range(BITS + 1):
            low, high = prefix_range(s, np.int64(bits))
            out[:, bits] = np.searchsorted(array, high, side="right") - np.searchsorted(array, low, side="left")
            first, stop = np.searchsorted(lows, low, side="left"), np.searchsorted(highs, high, side="right")
            out[:, bits] += np.maximum(before_high[stop] - before_low[np.minimum(first, stop)], 0)
        return pd.DataFrame({"q": visits["q"].to_numpy(), "met": list(out)})

    visits = asked.select("q", "v").mapInPandas(route, "segment long, q long, s long")
    found = visits.groupBy("segment").cogroup(segments.select("segment", "dims", "tree", "strings").groupBy("segment")).applyInPandas(count, "q long, met array<long>")
    summed = found.groupBy("q").agg(*[F.sum(F.col("met")[k]).alias(f"m{k}") for k in range(BITS + 1)])
    return common.shared_table(summed.select("q", F.array(*[f"m{k}" for k in range(BITS + 1)]).alias("met")), "met")


def exact_sample(nodes: DataFrame, sample: pd.DataFrame, nearest: int) -> pd.DataFrame:
    """q, v and rest of the nearest other vectors of each sampled query, by comparing it with all vectors."""
    spark = nodes.sparkSession
    held = spark.sparkContext.broadcast({n: (g["q"].to_numpy(), _matrix(g["v"])) for n, g in sample.groupby(sample["v"].map(len))})

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _by_width(batch):
                v, node = _matrix(part["v"]), part["node"].to_numpy()
                if v.shape[1] not in held.value:
                    continue
                q, mine = held.value[v.shape[1]]
                score = mine @ v.T
                k = min(nearest + 1, len(v))
                at = np.argpartition(-score, k - 1, axis=1)[:, :k]
                yield pd.DataFrame({"q": np.repeat(q, k), "node": node[at].ravel(), "score": np.take_along_axis(score, at, 1).ravel(), "same": (v[at] == mine[:, None]).all(axis=2).ravel()})

    found = nodes.select("node", "v").mapInPandas(best, "q long, node long, score double, same boolean").where("not same")
    top = found.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.col("score").desc(), "node"))).where(F.col("r") <= nearest)
    return top.select("q", "node").join(nodes.select("node", "v", "rest"), "node").select("q", "v", "rest").toPandas()


def fit_meetings(nodes: DataFrame, asked: DataFrame, met: DataFrame, nearest: int, recall: float, fit_queries: int = FIT_QUERIES) -> int:
    """How many vectors a search has to meet before it stops ascending: the least number with which the sampled queries
    (those with the smallest hashes) reach ``recall``."""
    sample = asked.orderBy(F.xxhash64("v"), "q").limit(fit_queries).join(met, "q").toPandas()
    if not len(sample):
        return 1
    true = exact_sample(nodes, sample, nearest)
    if not len(true):
        return 1
    own = {q: (strings(v[None, :], np.zeros(1))[:, 0], np.asarray(m)) for q, v, m in zip(sample["q"], map(np.asarray, sample["v"]), sample["met"])}
    level = np.array([shared_bits(own[q][0], strings(np.asarray(v)[None, :], np.array([rest]))[:, 0]).max() for q, v, rest in zip(true["q"], true["v"], true["rest"])])
    counts = np.stack([own[q][1] for q in true["q"]])
    for meetings in np.unique(np.geomspace(nearest, max(counts.max(), nearest + 1), 200).astype(np.int64)):
        stop = np.maximum((counts >= meetings).sum(axis=1) - 1, 0)  # counts fall with the prefix's length
        if (level >= stop).mean() >= recall:
            return int(meetings)
    return int(counts.max())


def candidates(asked: DataFrame, levels: DataFrame, segments: DataFrame, bounds, keep: int) -> DataFrame:
    """q, node and the approximate score of the best ``keep`` vectors that each tree meets."""

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _by_width(batch):
                v = _matrix(part["v"])
                codes = np.array([x.tobytes() for x in v.astype("<f4")], dtype=object)
                for tree, s in enumerate(strings(v, np.zeros(len(v))).astype(np.int64)):
                    if (v.shape[1], tree) in bounds.value.of:
                        low, high = prefix_range(s, part["level"].to_numpy("int64"))
                        which, segment = bounds.value.touched(v.shape[1], tree, low, high)
                        yield pd.DataFrame({"segment": segment, "q": part["q"].to_numpy()[which], "low": low[which], "high": high[which], "code": codes[which]})

    def scan(visits: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(visits) and len(held):
            row = held.iloc[0]
            array = np.frombuffer(row["strings"], "<u4").astype(np.int64)
            nodes, dims = np.frombuffer(row["nodes"], "<i8"), int(row["dims"])
            vectors = np.frombuffer(row["codes"], np.int8).reshape(-1, dims).astype(np.float32) * np.frombuffer(row["scales"], "<f4")[:, None]
            for (low, high), same in visits.groupby(["low", "high"], sort=False):
                first, stop = np.searchsorted(array, low, side="left"), np.searchsorted(array, high, side="right")
                if first == stop:
                    continue
                k = min(keep, stop - first)
                for at in range(0, len(same), TOGETHER):
                    part = same.iloc[at : at + TOGETHER]
                    score = np.frombuffer(b"".join(part["code"]), "<f4").reshape(-1, dims) @ vectors[first:stop].T
                    best = np.argpartition(-score, k - 1, axis=1)[:, :k] if k < stop - first else np.broadcast_to(np.arange(k), (len(part), k))
                    out.append(pd.DataFrame({"q": np.repeat(part["q"].to_numpy(), k), "node": nodes[first + best].ravel(), "near": np.take_along_axis(score, best, 1).ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"q": pd.Series(dtype="int64"), "node": pd.Series(dtype="int64"), "near": pd.Series(dtype="float32")})

    visits = asked.join(levels, "q").select("q", "v", "level").mapInPandas(route, "segment long, q long, low long, high long, code binary")
    met = visits.groupBy("segment").cogroup(segments.groupBy("segment")).applyInPandas(scan, "q long, node long, near float")
    return met.groupBy("q", "node").agg(F.max("near").alias("near"))


def search(df: DataFrame, queries: DataFrame | None = None, nearest: int = NEAREST, key: str = "vec_id", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the ``nearest`` candidates with the largest inner product, ties to smaller ids.

    Queries are the rows whose id is divisible by ``QUERY_EVERY``, or those given; a query's own row is never its
    candidate, and only vectors of its width are. Null ids, and vectors that are null, zero, or hold a null or non-finite
    component, take no part. Rows that repeat both id and vector count once; rows that share an id but hold other vectors
    are candidates, and queries, each. Only key and vector are read.
    """
    rows = common.shared_table(usable(df, key, vector).where("vec_id is not null").distinct(), "vectors")
    mine = rows.where(F.col("vec_id") % QUERY_EVERY == 0) if queries is None else usable(queries, key, vector).where("vec_id is not null").distinct()
    # equal vectors are one node: nearest + 1 of their ids are all that a ranking can show. Two steps, so that no task
    # holds all rows of one vector
    keyed = rows.withColumn("salt", F.pmod("vec_id", F.lit(64)))
    some = keyed.groupBy("v", "salt").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, nearest + 1).alias("ids"))
    distinct = some.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, nearest + 1).alias("ids"))
    square = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    distinct = common.shared_table(distinct.select("v", "ids", F.size("v").alias("dims"), square.alias("square"), F.monotonically_increasing_id().alias("node")), "distinct")
    most = distinct.groupBy("dims").agg(F.max("square").alias("most"))
    nodes = distinct.join(most, "dims").select("node", "v", "ids", F.sqrt(F.greatest(F.col("most") - F.col("square"), F.lit(0.0))).alias("rest"))
    asked = common.shared_table(mine.groupBy("v").agg(F.count(F.lit(1)).alias("n")).select("v", F.monotonically_increasing_id().alias("q")), "asked")
    segments = build(nodes, distinct.count())
    bounds = df.sparkSession.sparkContext.broadcast(Bounds(segments))
    met = met_counts(asked, segments, bounds)
    meetings = fit_meetings(nodes, asked, met, nearest, recall)
    levels = met.select("q", F.greatest(F.size(F.filter("met", lambda n: n >= meetings)) - 1, F.lit(0)).alias("level"))
    near = candidates(asked, levels, segments, bounds, nearest + SPARE)
    short = near.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.col("near").desc(), "node"))).where(F.col("r") <= nearest + SPARE)
    pairs = short.select("q", "node").join(nodes.select("node", "v", "ids"), "node").join(asked.select("q", F.col("v").alias("qv")), "q")
    score = F.aggregate(F.zip_with("v", "qv", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)  # left to right
    each = pairs.select("q", score.alias("score"), (F.col("v") == F.col("qv")).alias("own"), F.explode("ids").alias("vec_id"))
    lists = each.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "vec_id", "score", "own"))).alias("found"))  # bounded by the short list
    named = mine.join(asked, "v").select(F.col("vec_id").alias("query_id"), "q").join(lists, "q")
    others = F.slice(F.filter("found", lambda x: ~(x["own"] & (x["vec_id"] == F.col("query_id")))), 1, nearest)
    ranks = named.select("query_id", F.posexplode(others).alias("at", "x"))
    return ranks.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
