"""Centroid clustering against SQL, brute force and odd rows."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import clusters


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    found = con.execute(clusters.SQL)
    names = [d[0] for d in found.description]
    got = clusters.query(spark, sf)
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == sorted(found.fetchall())


@pytest.mark.parametrize("seed", range(6))
def test_annulus_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    v = rng.integers(-4, 5, (2_000, 8)) * rng.integers(1, 40, (2_000, 1))  # many norms, many ties
    c = v[rng.integers(0, len(v), 33)]
    d2 = ((v[:, None] - c[None]) ** 2).sum(axis=2)
    number, best, compared = clusters.nearest(v, c)
    assert (number == d2.argmin(axis=1)).all() and (best == d2.min(axis=1)).all()
    assert compared < 0.8 * d2.size  # eight dimensions leave a third to prune


def brute(rows, centroids, rounds):
    v = np.floor(np.array([r[1] for r in rows]) * 64).astype(np.int64)
    from hashlib import sha256

    order = sorted((k for k in range(len(rows)) if rows[k][0] is not None), key=lambda k: (sha256(f"1:{rows[k][0]}".encode()).hexdigest(), v[k].tolist()))
    c = v[order[:centroids]].copy()
    near = lambda: ((v[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
    for _ in range(rounds):
        a = near()
        for k in range(len(c)):
            if (a == k).any():
                c[k] = v[a == k].sum(axis=0) // (a == k).sum()
    return near(), c


def test_rounds_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k) if k % 9 else None, [float(x) for x in np.float32(rng.standard_normal(4) * 3)]) for k in range(300)]
    rows += [rows[5]] * 40 + [(5, [9.0, 9.0, 9.0, 9.0])]
    odd = [(1, None), (2, []), (3, [1.0] * 3), (4, [1.0, None, 1.0, 1.0]), (6, [float("nan")] * 4), (7, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumns({"v": F.lit("clash"), "cluster": F.lit(1), "distance": F.lit(2), "x": F.lit(3)})
    got = clusters.cluster(df, centroids=7, rounds=3, width=4).collect()
    near, c = brute(rows, 7, 3)
    assert sorted(((r.vec_id is None, r.vec_id or 0), r.cluster) for r in got) == sorted(((r[0] is None, r[0] or 0), int(k)) for r, k in zip(rows, near))
    assert {r.inertia for r in got} == {sum(r.distance for r in got)}
    for k in range(7):
        assert {r.cluster_inertia for r in got if r.cluster == k} == {sum(r.distance for r in got if r.cluster == k)} or not (near == k).any()


def test_few_none_and_too_large(spark):
    schema = "vec_id long, embedding array<float>"
    assert clusters.cluster(spark.createDataFrame([], schema)).collect() == []
    assert clusters.cluster(spark.createDataFrame([(None, [1.0] * 64)], schema)).collect() == []
    got = clusters.cluster(spark.createDataFrame([(8, [0.5] * 64), (9, [0.0] * 64)], schema)).collect()
    assert len({r.cluster for r in got}) == 2 and {r.inertia for r in got} == {0}
    with pytest.raises(Exception, match="lies beyond"):
        clusters.cluster(spark.createDataFrame([(8, [3e30] * 64)], schema)).collect()
