"""Batches of criteria against brute force, and beyond what a broadcast holds."""

import random

import pytest
from pyspark.sql import functions as F

from rankwright.operators.criteria import matching

CRITERIA = "query_id int, key string, seq int, kind string, field string, lo double, hi double, text string"
FIELDS = ("a", "b")


def meets(row, c):
    kind, field, lo, hi, text = c
    v = row.get(field) or 0.0 if field in FIELDS else None
    if kind == "range":
        return v is not None and (lo is None or v >= lo) and (hi is None or v <= hi)
    if kind == "decade":
        return v is not None and lo is not None and lo <= v <= lo + 9
    if kind == "words":
        return all(w in (row["name"] or "").lower() for w in (text or "").lower().split(" "))
    if kind == "suffix":
        return text is not None and (row["label"] or "").lower().endswith(text.lower())
    return True


def brute(rows, criteria):
    queries = {}
    for q, key, seq, *c in sorted(criteria, key=lambda x: x[2]):
        queries.setdefault(q, {}).setdefault(key, c)
    return sorted((q, r["id"]) for q, cs in queries.items() for r in rows if all(meets(r, c) for c in cs.values()))


def made(n, seed):
    draw = random.Random(seed)
    value = lambda: draw.choice([None, draw.randint(-5, 5), draw.random() * 100, 50.0])
    word = lambda: draw.choice(["Ann", "bo", "é", "leeann", "Q", "xyzzy", ""])
    rows = [{"id": i, "a": value(), "b": value(), "name": draw.choice([None, f"{word()} {word()} {word()}"]), "label": draw.choice([None, "", "Reds", "Old Reds", "x"])} for i in range(n)]
    criteria = []
    for q in range(120):
        for seq in range(draw.randint(1, 4)):
            kind = draw.choice(["range", "range", "decade", "words", "suffix", None, "odd"])
            field = draw.choice(["a", "b", "a", "none"]) if kind in ("range", "decade") else None
            text = {"words": f"{word()} {word()}".strip(), "suffix": draw.choice(["reds", "s", "D REDS", "", None])}.get(kind)
            criteria.append((q, draw.choice(["k1", "k2", "k3", None]), seq, kind, field, draw.choice([None, value()]), draw.choice([None, value()]), text))
    return rows, criteria


@pytest.mark.parametrize(("seed", "few"), [(1, 0), (2, 0), (3, 1000)])
def test_batches_equal_brute_force(spark, seed, few):
    rows, criteria = made(300, seed)
    df = spark.createDataFrame([(r["id"], None if r["a"] is None else float(r["a"]), None if r["b"] is None else float(r["b"]), r["name"], r["label"]) for r in rows], "id long, a double, b double, name string, label string")
    wanted = spark.createDataFrame([(q, k, s, kind, f, None if lo is None else float(lo), None if hi is None else float(hi), t) for q, k, s, kind, f, lo, hi, t in criteria], CRITERIA)
    got = sorted((r.query_id, r.id) for r in matching(df, "id", wanted, FIELDS, "name", "label", few=few).collect())
    assert got == brute(rows, criteria)
    assert matching(df.limit(0), "id", wanted, FIELDS, "name", "label", few=few).collect() == [] and matching(df, "id", wanted.limit(0), FIELDS, "name", "label", few=few).collect() == []


def test_a_million_criteria(spark):
    """Half a million queries of two criteria over 20,000 rows, each of which finds its own row alone."""
    n = 20_000
    rows = spark.range(n).select("id", (F.col("id") * 10).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), F.lit("x").alias("name"))
    base = spark.range(500_000).select(F.col("id").cast("int").alias("query_id"), (F.col("id") % n).alias("row"))
    null = lambda kind: F.lit(None).cast(kind)
    near = base.select("query_id", F.lit("a").alias("key"), F.lit(1).alias("seq"), F.lit("range").alias("kind"), F.lit("a").alias("field"), (F.col("row") * 10 - 3.0).alias("lo"), (F.col("row") * 10 + 3.0).alias("hi"), null("string").alias("text"))
    same = base.select("query_id", F.lit("b").alias("key"), F.lit(2).alias("seq"), F.lit("range").alias("kind"), F.lit("b").alias("field"), (F.col("row") % 7).cast("double").alias("lo"), null("double").alias("hi"), null("string").alias("text"))
    got = matching(rows, "id", near.unionByName(same), ["a", "b"]).agg(F.count("*").alias("n"), F.sum((F.col("query_id") % n == F.col("id")).cast("int")).alias("own")).first()
    assert got.n == got.own == 500_000
