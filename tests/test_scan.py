"""Prefix scans over ranges against loops: hot groups, nulls, long steps, large dimensions."""

import bisect
import random

from pyspark.sql import functions as F

from rankwright.operators import joins, sampling, scan, windows


def test_scan_equals_a_loop(spark):
    draw = random.Random(1)
    rows = [(draw.choice(["a", "b", None]), i, draw.choice([None, 1, 2, 5])) for i in range(150)] + [("hot", i, None if i % 3 else i % 7) for i in range(450)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o int, v int")
    v = F.col("v")
    want, groups = set(), {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    for g, rs in groups.items():
        rs.sort(key=lambda r: r[1])
        total = least = last = None
        for i, (_, o, x) in enumerate(rs):
            if x is not None:
                total, least, last = (total or 0) + x, x if least is None else min(least, x), x
            want.add((g, o, x, total, least, last, rs[i + 1][2] if i + 1 < len(rs) else None))
    for n in (1, 7, 40):
        got = scan.scan(df, ["g"], [F.col("o")], {"s": v}, {"m": v}, {"l": v}, {"n": v}, ranges=n).collect()
        assert len(got) == len(rows) and {tuple(r) for r in got} == want
    assert scan.scan(df.limit(0), ["g"], [F.col("o")], {"s": v}).collect() == []


def test_rows_are_numbered_across_ranges(spark):
    """Beyond what one task may number: 150,000 cells."""
    df = spark.range(150_000).select((F.col("id") * 7919 % 150_000).alias("x"))
    got = scan.numbered(df, [F.desc("x")], "at", ranges=16).agg(F.count_if(F.col("x") + F.col("at") == 149_999).alias("ok")).first()
    assert got.ok == 150_000
    cells = spark.range(120_000).select(F.format_string("c%06d", "id").alias("cell"))
    drawn = sampling.boards(spark.range(300).select(F.col("id").alias("seed")), cells)
    at = sampling.draw_index(F.lit(120_000), F.col("seed"), F.col("spin"), F.lit("cell"))
    assert drawn.count() == 1800 and drawn.where(F.format_string("c%06d", at) != F.col("cell")).isEmpty()


def test_shares_of_scores_far_apart(spark):
    """An outlier at 3,000,000 makes one row more, not three million, until every score is asked for."""
    df = spark.createDataFrame([("a", 10), ("a", 10), ("a", 12), ("a", 3_000_000), (None, 5)], "g string, s int")
    steps = {tuple(r) for r in windows.score_steps(df, "s", ["g"]).collect()}
    assert steps == {("a", 10, 11, 2, 50.0), ("a", 12, 2_999_999, 1, 75.0), ("a", 3_000_000, 3_000_000, 1, 100.0), (None, 5, 5, 1, 100.0)}
    dense = windows.score_ecdf(df, "s", ["g"])
    got = dense.where("g = 'a'").agg(F.count("*"), F.count_distinct("score"), F.count_if(F.col("pct") == 75.0), F.max("score")).first()
    assert tuple(got) == (2_999_991, 2_999_991, 2_999_988, 3_000_000)
    # one task no longer holds them all
    sizes = [r["count"] for r in dense.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2_000_000
    assert windows.score_ecdf(df.limit(0), "s").collect() == []
    assert {tuple(r) for r in windows.score_ecdf(df.where("s < 100"), "s", ceiling=14).collect()} == {(5, 25.0), (6, 25.0), (7, 25.0), (8, 25.0), (9, 25.0), (10, 75.0), (11, 75.0), (12, 100.0), (13, 100.0), (14, 100.0)}


def test_shares_that_do_not_rise(spark):
    table = spark.createDataFrame([(1, 50.0), (2, 20.0), (3, 60.0), (4, None)], "score int, pct double")
    targets = spark.createDataFrame([(10.0, "x"), (50.0, "x"), (55.0, "x"), (61.0, "x"), (None, "x")], "t double, pct string")
    assert {tuple(r) for r in windows.scores_for(table, targets, "t").collect()} == {(10.0, "x", 1), (50.0, "x", 1), (55.0, "x", 3), (61.0, "x", 4), (None, "x", 4)}


def test_lookup_beyond_a_broadcast(spark):
    ecdf = spark.range(150_000).select(F.col("id").cast("int").alias("score"), (F.col("id") / 1500).alias("pct"))
    df = spark.createDataFrame([(1, -5.0), (2, 0.5), (3, 149_998.4), (4, 1e7), (5, None)], "k int, s double")
    got = {r.k: r.pct for r in windows.ecdf_lookup(df, "s", ecdf, "pct").collect()}
    assert got == {1: 0.0, 2: 1 / 1500, 3: 149_998 / 1500, 4: 149_999 / 1500, 5: None}


def test_as_of_with_a_large_dimension(spark):
    """Eras of 200,000 ends; one code holds nearly all rows and ends; equal ends, open ends and unknown codes."""
    draw = random.Random(2)
    ends = sorted(draw.sample(range(1_000_000), 4000))
    eras = [("hot", e, f"e{e}") for e in ends] + [("b", 5, "z"), ("b", 5, "y"), (None, 7, "null"), ("b", None, "open")]
    rows = [("hot", draw.randint(0, 1_050_000), i) for i in range(3000)] + [("hot", 77, i) for i in range(3000, 6000)] + [("b", 5, 6000), ("b", 6, 6001), ("b", None, 6002), (None, 1, 6003), ("c", 1, 6004)]
    want = {}
    for code, at, i in rows:
        k = bisect.bisect_left(ends, at) if code == "hot" else None
        want[i] = f"e{ends[k]}" if k is not None and k < len(ends) else {6000: "y"}.get(i)
    got = joins.as_of(spark.createDataFrame(rows, "code string, y int, i int"), "code", F.col("y"), spark.createDataFrame(eras, "code string, until int, name string"), "until", "name", "era")
    assert got.columns == ["code", "y", "i", "era"] and {r.i: r.era for r in got.collect()} == want
    big = spark.range(200_000).select(F.lit("k").alias("code"), (F.col("id") * 10).alias("until"), F.col("id").alias("name"))
    asked = spark.range(50_000).select(F.lit("k").alias("code"), (F.col("id") * 37).alias("y"))
    assert joins.as_of(asked, "code", F.col("y"), big, "until", "name", "era").where(F.ceil(F.col("y") / 10) != F.col("era")).isEmpty()
