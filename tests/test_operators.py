"""Operators on small tables worked out by hand."""

import math
import random
import unicodedata
from datetime import date
from pathlib import Path
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

import rankwright
from rankwright import sources
from rankwright.functions import scalars
from rankwright.functions.normal import with_inverse_normal
from rankwright.operators import criteria, filters, joins, quality, ranking, sampling, shrink, windows
from rankwright.operators.nearest import nearest


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_nothing_here_imports_the_training_data_operators():
    root = Path(rankwright.__file__).parent
    found = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and "rankwright.llm" in p.read_text()]
    assert not found


def test_inverse_normal(spark):
    ps = [i / 997 for i in range(1, 997)] + [1e-6, 1 - 1e-6, 1e-5]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    for p, x in values(with_inverse_normal(df, F.col("p"), "x"), "p", "x"):
        assert math.isclose(x, NormalDist().inv_cdf(p), abs_tol=1e-11)


def test_percentile_rank_ties_and_missing(spark):
    random.seed(1)
    xs = [random.choice([None, 1.0, 2.0, 2.0, 3.5, random.random()]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(xs)), "id int, v double")
    known = sorted(x for x in xs if x is not None)
    for i, pct in values(ranking.percentile_rank(df, "v", "pct", 7), "id", "pct"):
        if xs[i] is None:
            assert pct is None
        else:
            below, ties = sum(y < xs[i] for y in known), known.count(xs[i])
            assert math.isclose(pct, 100 * (below + (ties + 1) / 2 - 0.5) / len(known))


def test_desaturated_rank_without_positives(spark):
    df = spark.createDataFrame([(1, 0.0), (2, None)], "id int, v double")
    assert sorted(values(ranking.desaturated_rank(df, "v", "r", 35.0, 70.0), "id", "r")) == [(1, 35.0), (2, None)]


def test_shrink_and_composite(spark):
    df = spark.createDataFrame([(1.0, None, None), (None, None, 4.0)], "a double, b double, c double")
    got = values(df, shrink.shrink(F.col("a"), F.col("b"), F.lit(0.5), 10.0), shrink.weighted_composite({"a": 0.5, "c": 0.25}))
    assert got == [(0.6, 1.0), (0.5, 4.0)]


def test_smoothing_uses_real_gaps(spark):
    df = spark.createDataFrame([("a", 2000, 10.0), ("a", 2002, 1.0), ("a", 2005, 0.0)], "k string, season int, v double")
    assert sorted(values(windows.smooth_reputation(df, ["k"], "season", "v", 2, 0.5, "x"), "season", "x")) == [(2000, 10.0), (2002, 2.5), (2005, 0.0)]


@pytest.mark.parametrize(("days", "today", "want"), [((27, 28, 29), 29, (3, 3)), ((20, 21, 22, 28, 29), 29, (2, 3)), ((27, 28), 29, (2, 2)), ((20,), 29, (0, 1))])
def test_streaks(spark, days, today, want):
    df = spark.createDataFrame([("u", date(2024, 1, d)) for d in days], "u string, d date")
    assert values(windows.streaks(df, "u", "d", F.lit(date(2024, 1, today))), "current", "best") == [want]


def test_forced_rows_are_never_dropped(spark):
    df = spark.createDataFrame([("c", i, 10 - i, i in (5, 6)) for i in range(7)], "cell string, id int, v int, forced boolean")
    assert sorted(x[0] for x in values(windows.forced_top(df, ["cell"], "forced", [F.desc("v")], 3), "id")) == [0, 5, 6]


def test_scalars(spark):
    df = spark.createDataFrame([("PT11M05.50S", "José Ñandú Jr.", "x_1994_LAL", "2TM", "2024-02-30")], "clock string, name string, id string, team string, d string")
    got = values(df, scalars.clock_seconds(F.col("clock")), scalars.normal_name(F.col("name")), scalars.year_from_id(F.col("id")), scalars.is_aggregate_team(F.col("team")), scalars.strict_date(F.col("d")))
    assert got == [(665.5, "jose nandu", 1994, True, None)]
    totals = spark.createDataFrame([(588,), (594,), (470,), (0,)], "t int")
    assert [x for x, in values(totals, scalars.overall(F.col("t"), 588))] == [99, 99, 78, 40]
    assert [x for x, in values(totals, scalars.overall(F.col("t"), 0))] == [99, 99, 78, 40]


def test_names_fold_all_of_unicode(spark):
    """By the rule itself: compatibility decomposition, ASCII letters and spaces, lower-cased."""
    left = lambda s: " ".join("".join(x for x in unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower() if x == " " or x.isalpha()).split())
    signs = [c for c in map(chr, range(0x80, 0x110000)) if unicodedata.decomposition(c)] + list("ßøłđħæœĸŋ\u00d7\u4e2d")
    df = spark.createDataFrame([(i, f"Q{c}w {c}") for i, c in enumerate(signs)] + [(-1, "Nguyễn"), (-2, "ﬁn"), (-3, "Ǆ ㎏ jr"), (-4, None)], "i int, s string")
    got = dict(values(df, "i", scalars.normal_name(F.col("s"))))
    assert (got[-1], got[-2], got[-3], got[-4]) == ("nguyen", "fin", "dz kg", None)
    wrong = [(c, got[i]) for i, c in enumerate(signs) if got[i] != " ".join(t for t in left(f"Q{c}w {c}").split() if t not in scalars.SUFFIXES)]
    assert len(signs) > 2000 and not wrong, wrong[:9]


def test_as_of_boundaries(spark):
    eras = spark.createDataFrame([("OKC", 2008, "SEA"), ("CHO", 2002, "CHH"), ("CHO", 2014, "CHA")], "code string, until int, name string")
    rows = spark.createDataFrame([("OKC", 2008), ("OKC", 2009), ("CHO", 1995), ("CHO", 2010), ("CHO", 2015), ("LAL", 1985)], "code string, y int")
    got = {(c, y): n for c, y, n in values(joins.as_of(rows, "code", F.col("y"), eras, "until", "name", "n"), "code", "y", "n")}
    assert got == {("OKC", 2008): "SEA", ("OKC", 2009): None, ("CHO", 1995): "CHH", ("CHO", 2010): "CHA", ("CHO", 2015): None, ("LAL", 1985): None}


def test_resolution_tiers(spark):
    people = spark.createDataFrame([(1, "ann lee", "p1"), (1, "bob ray", "p2"), (1, "cy fox", "p3"), (1, "di fox", "p4"), (1, "nene", "p5")], "season int, name string, ident string")
    rows = spark.createDataFrame([(1, "ann lee"), (1, "robert ray"), (1, "x fox"), (1, "nene hilario"), (1, "odd one")], "season int, name string")
    given = spark.createDataFrame([(1, "odd one", "p9")], "season int, name string, ident string")
    got = joins.resolve(rows, people, "season", "name", "ident", scalars.last_token(F.col("name")), scalars.first_token(F.col("name")), given)
    assert sorted(values(got, "name", "ident", "tier")) == [("ann lee", "p1", "exact"), ("nene hilario", "p5", "first"), ("odd one", "p9", "override"), ("robert ray", "p2", "last"), ("x fox", None, None)]


def test_nearest_of_many_queries(spark):
    pool = [(i, float(i * i % 7), float(i)) for i in range(8)]
    queries = [(100 + i, float(i % 7), float(i % 8)) for i in range(10_001)]
    schema = "id long, a double, b double"
    got = {q: (m, d) for q, m, d in values(nearest(spark.createDataFrame(queries, schema), spark.createDataFrame(pool, schema), "id", ["a", "b"]), "query_id", "match", "distance")}
    mean = [sum(p[k] for p in pool) / 8 for k in (1, 2)]
    sd = [math.sqrt(sum((p[k] - mean[k - 1]) ** 2 for p in pool) / 8) for k in (1, 2)]
    z = lambda row: [(row[k] - mean[k - 1]) / sd[k - 1] for k in (1, 2)]
    gap = lambda x, y: sum((0.25 + max(a, 0.0)) * (a - b) ** 2 for a, b in zip(x, y))
    assert len(got) == len(queries)
    for q in queries:
        least = min(gap(z(q), z(p)) for p in pool)
        match, distance = got[q[0]]
        assert math.isclose(distance, least, abs_tol=2e-9) and math.isclose(gap(z(q), z(pool[match])), least, abs_tol=2e-9)


def test_match_gate(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("b", 9.0, False)], "n string, w double, ok boolean")
    with pytest.raises(ValueError, match="matched 0.1"):
        joins.match_gate(df, F.col("ok"), "w", 0.9, "n")
    # what failed is not left behind
    assert not list(Path(sources.scratch_dir(spark)).glob("gated-*"))
    out, share = joins.match_gate(df, F.col("ok"), None, 0.5, "n")
    assert share == 0.5 and sorted(out.collect()) == sorted(df.collect())
    assert joins.match_gate(df.limit(0), F.col("ok"), "w", 0.9, "n")[1] == 1.0


def test_draws_do_not_depend_on_history(spark):
    seeds = spark.createDataFrame([(s,) for s in range(50)], "seed long")
    cells = spark.createDataFrame([("c%d" % i,) for i in range(9)], "cell string")
    one, again = (sorted(values(sampling.boards(seeds, cells, n), "seed", "spin", "cell")) for n in (6, 8))
    assert one == [x for x in again if x[1] <= 6]
    assert values(spark.range(1), sampling.draw_index(F.lit(0), F.lit(1))) == [(0,)]


def test_funnel_and_criteria(spark):
    df = spark.createDataFrame([(1, 5.0, "Ann Lee"), (2, None, "Bo Lee")], "id int, v double, name string")
    assert values(filters.funnel(df, {"v": F.col("v") > 1, "id": F.col("id") > 1}), "*") == [(2, 1, 0)]
    wanted = spark.createDataFrame([(1, "v", 1, "range", "v", None, 0.0, None), (2, "n", 1, "words", None, None, None, "lee ann")], "query_id int, key string, seq int, kind string, field string, lo double, hi double, text string")
    assert sorted(values(criteria.matching(df, "id", wanted, ["v"], "name"), "*")) == [(1, 2), (2, 1)]


def test_digest_ignores_order(spark):
    a = spark.range(100)
    assert values(quality.digest(a), "*") == values(quality.digest(a.orderBy(F.desc("id"))), "*")


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    with pytest.raises(ValueError, match="missing columns"):
        sources.require_columns(df, ["a", "z"], "t")
    assert sources.save(df, str(tmp_path / "t")).collect() == df.collect()
    assert sources.optional(df, None, ["a"], ["q"]).first().q is None
    df.write.option("header", True).csv(str(tmp_path / "c"))
    assert sources.read_csv(spark, str(tmp_path / "c"), "a int, b string", ["b"]).first().b == "x"
