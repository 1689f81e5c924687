"""Centroid clustering (Lloyd's rounds) with an annulus search for the nearest centroid (after Drake and Hamerly, 2012).

Centroids are sorted by norm. A vector's distance to the centroid whose norm is nearest to its own bounds the distance to
its nearest centroid, and no centroid whose norm differs by more than that bound can be nearer: a binary search finds where
the vector's norm belongs, and the search goes outwards from there, to whichever side is nearer in norm, while the
annulus, which each better distance narrows, still holds a centroid. Candidates are compared by exact whole numbers; a
centroid on the annulus' border is compared too, so ties go to the smaller number.

A round reads the vectors once. Tasks add up their own vectors' components by cluster, so a shuffle carries one row for each
task and cluster. Only the centroids, a number of rows that the caller sets, are known to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CENTROIDS = 16
ROUNDS = 3
WIDTH = 64
SCALE = 64
#: Whole-number components lie below this, so that the distance of two vectors and a sum of 2**35 of them fit 63 bits.
LIMIT = 1 << 27


def kept_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", width: int = WIDTH) -> DataFrame:
    """(vec_id, v): vectors of ``width`` components, none null or non-finite, as whole numbers floor(SCALE * x)."""
    made = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x")).where(F.size("x") == width)
    fine = made.where(F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    whole = F.transform("x", lambda e: F.when(F.abs(e) * SCALE < LIMIT, F.floor(e * SCALE)).otherwise(F.raise_error(F.lit(f"a component times {SCALE} lies beyond {LIMIT}")).cast("long")))
    return fine.select("vec_id", whole.alias("v"))


def starts(vectors: DataFrame, centroids: int) -> np.ndarray:
    """The vectors with the smallest sha256 of ``1:<vec_id>``, ties by their components. Rows without an id start none."""
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = vectors.where("vec_id is not null").orderBy(order, "v").limit(centroids).collect()
    return np.array([r.v for r in first], dtype=np.int64)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of each vector's nearest centroid, the squared distance, and how many distances were computed."""
    norms = np.sqrt((centroids.astype(np.float64) ** 2).sum(axis=1))
    by_norm = np.argsort(norms, kind="stable")
    ring = np.concatenate([[-np.inf], norms[by_norm], [np.inf]])
    own = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    right = np.searchsorted(ring[1:-1], own) + 1  # in ``ring``: the first centroid that is not shorter
    left = right - 1
    best, number = np.full(len(vectors), np.iinfo(np.int64).max), np.full(len(vectors), -1, dtype=np.int64)
    bound = np.full(len(vectors), np.inf)
    rows, compared = np.arange(len(vectors)), 0
    while len(rows):
        below, above = own[rows] - ring[left[rows]], ring[right[rows]] - own[rows]
        step = np.minimum(below, above)
        # square roots are rounded: the annulus is a little wider than exact, never narrower
        inside = np.isfinite(step) & (step <= bound[rows] * (1 + 1e-9) + 1e-6)
        rows, down = rows[inside], (below <= above)[inside]
        at = by_norm[np.where(down, left[rows], right[rows]) - 1]
        gap = vectors[rows] - centroids[at]
        d2 = np.einsum("ij,ij->i", gap, gap)
        compared += len(rows)
        better = (d2 < best[rows]) | ((d2 == best[rows]) & (at < number[rows]))
        hit = rows[better]
        best[hit], number[hit] = d2[better], at[better]
        bound[hit] = np.sqrt(d2[better].astype(np.float64))
        left[rows[down]] -= 1
        right[rows[~down]] += 1
    return number, best, compared


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.int64)


def sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, np.ndarray]]:
    """How many vectors each cluster holds, and the sum of their components."""
    width = centroids.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = np.zeros(len(centroids), dtype=np.int64), np.zeros(centroids.shape, dtype=np.int64)
        for batch in batches:
            if len(batch):
                v = _matrix(batch["v"])
                number, _, _ = nearest(v, centroids)
                order = np.argsort(number, kind="stable")
                has, first = np.unique(number[order], return_index=True)
                total[has] += np.add.reduceat(v[order], first, axis=0)
                n += np.bincount(number, minlength=len(n))
        has = np.flatnonzero(n)
        if len(has):
            yield pd.DataFrame({"cluster": has.astype(np.int32), "n": n[has], "total": list(total[has])})

    parts = vectors.select("v").mapInPandas(run, "cluster int, n long, total array<long>")
    summed = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[k]).alias(f"t{k}") for k in range(width)])
    return {r.cluster: (r.n, np.array([r[f"t{k}"] for k in range(width)], dtype=np.int64)) for r in summed.collect()}  # a row for each centroid


def fit(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids after ``rounds`` rounds: means rounded down; a centroid without vectors stays where it is."""
    now = starts(vectors, centroids)
    for _ in range(rounds if len(now) else 0):
        for k, (n, total) in sums(vectors, now).items():
            now[k] = total // n  # floors negative sums too
    return now


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance (squared), and how many distances its batch computed for each vector on average."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                number, d2, compared = nearest(_matrix(batch["v"]), centroids)
                yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "cluster": number.astype(np.int32), "distance": d2, "compared": compared / len(batch)})

    return vectors.mapInPandas(run, "vec_id long, cluster int, distance long, compared double")


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", centroids: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH) -> DataFrame:
    """One row for each kept row: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, compared.

    Vectors of another width, null vectors and those with a null or non-finite component are left out. Repeated rows count
    as often as they occur; a row with a null key is clustered and starts no centroid. Fewer vectors than centroids make
    fewer centroids; without a vector that has a key there are none, and no rows. A finite component beyond ``LIMIT`` / ``SCALE`` is an error.
    Only key and vector are read.
    """
    spark = df.sparkSession
    vectors = common.shared_table(kept_vectors(df, key, vector, width), "whole-vectors")
    final = fit(vectors, centroids, rounds)
    if not len(final):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, compared double")
    found = common.shared_table(assign(vectors, final), "clusters")
    by = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    named = spark.createDataFrame([(k, ",".join(map(str, c))) for k, c in enumerate(final.tolist())], "cluster int, centroid string")
    one = by.agg(F.sum("cluster_inertia").alias("inertia"))
    about = by.join(named, "cluster").crossJoin(F.broadcast(one))  # a row for each centroid, times one row
    about = about.select("cluster", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "compared")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """The same in SQL: every vector with every centroid."""
    d2 = "list_sum(list_transform(range(1, 65), lambda i: (v[i]-c[i])*(v[i]-c[i])))::BIGINT"
    steps = []
    for r in range(ROUNDS):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, v, arg_min(k, (d, k)) AS k FROM (SELECT vec_id, v, k, {d2} AS d FROM kept, c{r}) GROUP BY vec_id, v),
    s{r} AS (SELECT k, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY k, i),
    m{r} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM s{r} GROUP BY k),
    c{r + 1} AS MATERIALIZED (SELECT c{r}.k AS k, coalesce(m, c) AS c FROM c{r} LEFT JOIN m{r} ON c{r}.k = m{r}.k)""")
    return f"""WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, v AS c FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {CENTROIDS})),
    {", ".join(steps)},
    f AS MATERIALIZED (SELECT vec_id, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT vec_id, v, k, {d2} AS d FROM kept, c{ROUNDS}) GROUP BY vec_id, v)
    SELECT vec_id, f.k::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY f.k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM f JOIN c{ROUNDS} c ON f.k = c.k"""


SQL = _sql()
