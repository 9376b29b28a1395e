"""Nearest profiles against all pairs: ties, equal profiles, missing values, many queries."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankwright.operators.nearest import Cells, Cuts, nearest


def brute(ids, x, qids, q):
    """{query: (match, distance, percent)} over all pairs of whole rows."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd == 0] = 1
    z, zq, out = (x - mean) / sd, (q - mean) / sd, {}
    order = np.argsort(ids, kind="stable")
    for i, k in enumerate(qids):
        gap = np.round(((0.25 + np.maximum(zq[i], 0)) * (zq[i] - z) ** 2).sum(axis=1), 9)
        gap[ids == k] = np.inf
        best = order[gap[order].argmin()]
        if np.isfinite(gap[best]):
            out[k] = (ids[best], gap[best], min(max(math.floor(100.5 - round(np.abs(q[i] - x[best]).mean(), 9)), 0), 100))
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for k, (match, distance, percent) in want.items():
        assert got[k][0] == match and math.isclose(got[k][1], distance, abs_tol=3e-9) and got[k][2] == percent, (k, got[k], want[k])


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), *map(float, r)) for i, r in zip(ids, x)], "id long, " + ", ".join(f"d{k} double" for k in range(x.shape[1])))


@pytest.mark.parametrize("how", [Cells(), Cells(cell_rows=4), Cells(cell_rows=2, most_cells=16, sample_rows=40)])
def test_nearest_equals_all_pairs(spark, how):
    draw = np.random.default_rng(1)
    # whole numbers, so that ties and equal profiles are many; a third of the pool is one profile
    x = draw.integers(0, 7, (300, 3)).astype(float)
    x[::3] = x[0]
    ids = draw.permutation(300) + 10
    far = np.array([[100.0, -50.0, 3.0], [3.0, 3.0, 3.0]])
    qids, q = np.concatenate([ids[:120], [5000, 5001]]), np.concatenate([x[:120], far])
    rows = nearest(frame(spark, qids, q), frame(spark, ids, x), "id", ["d0", "d1", "d2"], how=how).collect()
    assert len(rows) == len(qids)
    same({r.query_id: (r.match, r.distance, r.percent) for r in rows}, brute(ids, x, qids, q))


def test_hard_rows(spark):
    nan = float("nan")
    pool = spark.createDataFrame([(1, 1.0, 5.0), (2, None, 5.0), (3, nan, 5.0), (None, 1.0, 5.0), (4, 2.0, 5.0)], "id long, d0 double, d1 double").withColumns({c: F.lit(0) for c in ("raw", "z", "cell", "ids", "row")})
    asked = spark.createDataFrame([(1, 1.0, 5.0), (1, 1.0, 5.0), (9, None, 5.0), (8, 9.0, 5.0)], "id long, d0 double, d1 double")
    got = [(r.query_id, r.match) for r in nearest(asked, pool, "id", ["d0", "d1"]).collect()]
    assert sorted(got) == [(1, 4), (1, 4), (8, 4)]
    assert nearest(asked.where("id = 1"), pool.where("id = 1"), "id", ["d0", "d1"]).collect() == []
    assert nearest(asked, pool.limit(0), "id", ["d0", "d1"]).collect() == []


def test_many_queries(spark):
    """100,000 queries over 20,000 profiles; every fiftieth is compared with all pairs."""
    draw = np.random.default_rng(2)
    x = np.round(draw.normal(size=(20_000, 4)) * [1, 10, 5, 1] + draw.integers(0, 4, (20_000, 1)) * 8, 3)
    pool = frame(spark, np.arange(len(x)), x)
    shift = lambda c, k: F.round(F.col(c) + (F.col("i") * k % 5 - 2) / 10, 3).alias(c)
    asked = pool.crossJoin(spark.range(5).select(F.col("id").alias("i"))).select((F.col("id") + F.col("i") * 20_000).alias("id"), *(shift(f"d{k}", k + 1) for k in range(4)))
    got = {r.query_id: (r.match, r.distance, r.percent) for r in nearest(asked, pool, "id", [f"d{k}" for k in range(4)]).collect()}
    some = asked.where("id % 50 = 0").toPandas()
    assert len(got) == 100_000
    want = brute(np.arange(len(x)), x, some["id"].tolist(), some[[f"d{k}" for k in range(4)]].to_numpy())
    same({k: got[k] for k in want}, want)


def test_cells_are_balanced():
    x = np.random.default_rng(3).normal(size=(4000, 3))
    cuts = Cuts(x[:2000], 64)
    sizes = np.bincount(cuts.cell_of(x), minlength=cuts.cells)
    assert cuts.cells == 64 and sizes.sum() == 4000 and sizes.max() < 4 * 4000 / 64
    assert Cuts(np.ones((10, 2)), 8).cells == 1 and Cuts(np.empty((0, 2)), 0).cells == 1
