"""Largest values over intervals against step-by-step expansion: hot keys, long intervals, missing values."""

import random

from pyspark.sql import functions as F

from rankwright.operators import joins
from rankwright.operators.intervals import largest_over

SCHEMA = "k string, a int, b int, v double"


def brute(rows):
    out = {}
    for k, a, b, v in rows:
        if a is not None and b is not None:
            for x in range(a, b + 1):
                old = out.get((k, x), None)
                out[k, x] = v if old is None else old if v is None else max(old, v)
    return out


def test_intervals_equal_steps(spark):
    draw = random.Random(1)
    rows = [(draw.choice(["hot"] * 6 + ["b", "c", None]), a := draw.randint(-20, 60), a + draw.randint(-2, 25), draw.choice([None, 1.0, 2.5, draw.random() * 9])) for _ in range(400)]
    rows += [("one", 5, 5, 1.0), ("none", 3, 4, None), ("gap", 1, 2, 1.0), ("gap", 9, 9, 2.0), ("x", None, 3, 1.0), ("x", 1, None, 1.0), ("same", 1, 4, 1.0), ("same", 1, 4, 3.0)]
    got = joins.expand_intervals(spark.createDataFrame(rows, SCHEMA), ["k"], "a", "b", "v").collect()
    assert len(got) == len({(r.k, r.season) for r in got}) and {(r.k, r.season): r.v for r in got} == brute(rows)
    assert joins.expand_intervals(spark.createDataFrame([], SCHEMA), ["k"], "a", "b", "v").collect() == []


def test_a_million_steps(spark):
    """Nested intervals of up to a million steps: as many segments as ends, and the dense form where it is asked for."""
    rows = [("k", i, 1_000_000 - i, float(i)) for i in range(0, 3000, 3)] + [("k", 500_000, 500_000, 5000.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    segments = {(r.a, r.b): r.v for r in largest_over(df, ["k"], "a", "b", "v").collect()}
    assert len(segments) == 2001 and segments[500_000, 500_000] == 5000.0 and segments[0, 2] == 0.0 and segments[999_998, 1_000_000] == 0.0 and segments[2997, 499_999] == 2997.0
    dense = joins.expand_intervals(df, ["k"], "a", "b", "v")
    assert tuple(dense.agg(F.count("*"), F.count_distinct("season"), F.count_if(F.col("v") == 2997.0)).first()) == (1_000_001, 1_000_001, 1_000_000 - 2 * 2997)
