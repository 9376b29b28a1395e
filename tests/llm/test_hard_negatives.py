"""Hard negatives against brute force: deep trees, split leaves, hot vectors, hard rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankwright.llm import hard_negatives
from rankwright.llm.hard_negatives import Mining, Tree, product

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, how, every):
    """By definition, over (id, label, whole vector)."""
    out = set()
    for a, label, v in rows:
        if a % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), b, m) for b, m, w in rows if b != a))
        for s, p, _ in [x for x in scored if x[2] == label][: how.positives]:
            fit = [(b, -t) for t, b, m in scored if m != label and how.low * -s <= 100 * -t <= how.high * -s]
            out |= {(a, p, k + 1, b, -s, t) for k, (b, t) in enumerate(fit[: how.negatives])}
    return out


def found(spark, rows, how, every):
    df = spark.createDataFrame([(a, m, [x / 256 for x in v]) for a, m, v in rows], SCHEMA)
    got = hard_negatives.mine(hard_negatives.rows_of(df, "vec_id", "label", "embedding"), F.col("id") % every == 0, how).collect()
    assert len(got) == len({(r.anchor_id, r.positive_id, r.rank) for r in got})
    return {(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got}


def clustered(n, dims, seed):
    draw = random.Random(seed)
    centres = [[draw.randint(-200, 200) for _ in range(dims)] for _ in range(6)]
    rows = [(i, draw.randint(0, 2), [c + draw.randint(-30, 30) for c in draw.choice(centres)]) for i in range(n)]
    # a third of all rows are one vector
    return [(i, m, rows[0][2]) if i % 3 == 0 else (i, m, v) for i, m, v in rows]


@pytest.mark.parametrize("how", [Mining(), Mining(leaf_rows=8, sample_rows=200, most_rows=16, fanout=3), Mining(leaf_rows=20, sample_rows=60, most_rows=1000, fanout=4, low=20, high=99)])
def test_mining_equals_brute_force(spark, how):
    rows = clustered(400, 6, 1)
    assert found(spark, rows, how, 10) == brute(rows, how, 10)


def test_leaves_are_left_out():
    """The ranges spare anchors most leaves of clustered rows, and no row that fits is lost."""
    draw = np.random.default_rng(2)
    centres = draw.integers(-200, 200, (12, 8))
    x = (centres[draw.integers(0, 12, 3000)] + draw.integers(-9, 10, (3000, 8))).astype(float)
    tree = Tree(x[:500], float((x * x).sum(axis=1).max()), 64, 4)
    for node, _, far, near in tree.walk(x)[0]:
        for j in np.unique(near):
            tree.low[node][:, j] = np.minimum(tree.low[node][:, j], far[near == j].min(axis=0))
            tree.high[node][:, j] = np.maximum(tree.high[node][:, j], far[near == j].max(axis=0))
    leaf = tree.walk(x)[1]
    scores = product(x[:200], x)
    best = np.sort(scores, axis=1)[:, -20].astype(float)
    top = scores.max(axis=1).astype(float)
    row, reached = tree.reached(x[:200], *hard_negatives.annuli(tree, x[:200], best[:, None], top[:, None]))
    held = set(zip(row.tolist(), reached.tolist()))
    want = {(i, int(leaf[j])) for i, j in zip(*np.nonzero(scores >= best[:, None]))}
    assert want <= held and len(held) < 0.5 * 200 * tree.leaves


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0]), (1, 1, [1.0, 2.0]), (2, 2, [1.0, 1.0]), (3, 2, [1.5]), (4, 2, [nan, 1.0]), (5, 2, [inf, 1.0]), (6, None, [9.0, 9.0]), (7, 2, None), (8, 2, [None, 1.0]), (None, 2, [1.0, 1.0]), (2, 2, [1.0, 1.0]), (9, 3, []), (10, 4, [1.0, 2.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("id", "v", "leaf", "part", "block", "found")})
    got = hard_negatives.mine(hard_negatives.rows_of(df, "vec_id", "label", "embedding"), F.col("id") % 10 == 0).collect()
    whole = [(0, 1, [256, 512]), (1, 1, [256, 512]), (2, 2, [256, 256]), (3, 2, [384, 0]), (9, 3, [0, 0]), (10, 4, [256, 512])]
    assert {tuple(r) for r in got} == {(a, p, k, n, s, t) for a, p, k, n, s, t in brute(whole, Mining(), 10)}
    assert hard_negatives.mine(hard_negatives.rows_of(df.limit(0), "vec_id", "label", "embedding"), F.col("id") % 10 == 0).collect() == []
    # far beyond what doubles hold exactly
    huge = np.array([[2.0**40 + 1, 3.0], [-(2.0**80), 1.0]])
    assert product(huge, huge)[0, 0] == np.iinfo(np.int64).max and product(huge, np.array([[1.0, 1.0]]))[0, 0] == 2**40 + 4
