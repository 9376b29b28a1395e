"""Ranks, categories, curation and browsing on tables worked out by hand."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankwright import sources
from rankwright.functions import scalars
from rankwright.operators import categories, curation, filters, grid, joins, quality, ranking, shrink, signals, windows
from rankwright.operators.nearest import nearest
from rankwright.operators.ranking import Rank
from rankwright.sources import documents


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_many_ranks_equal_single_ones(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["x", "y", None]), rng.choice([None, 0.0, 1.0, 2.0, rng.random()]), float(rng.randint(-3, 3))) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, g string, a double, b double")
    many = ranking.percentile_ranks(df, [Rank("a", "r1"), Rank("a", "r2", within=("g",)), Rank("b", "r3", sparse=(35.0, 70.0))], 5)
    one = ranking.desaturated_rank(ranking.percentile_rank_within(ranking.percentile_rank(df, "a", "r1", 3), "a", ["g"], "r2", 3), "b", "r3", 35.0, 70.0, 3)
    got, want = ({r[0]: r[1:] for r in values(x, "id", "r1", "r2", "r3")} for x in (many, one))
    assert got.keys() == want.keys() and all(x == y or math.isclose(x, y) for i in got for x, y in zip(got[i], want[i]))
    for i, g, a, b in rows:
        same = sorted(r[2] for r in rows if r[1] == g and r[2] is not None)
        assert got[i][1] is None if a is None else math.isclose(got[i][1], 100 * (sum(x < a for x in same) + (same.count(a) + 1) / 2 - 0.5) / len(same))
        assert got[i][2] == 35.0 if b <= 0 else got[i][2] > 70
    off = ranking.desaturated_rank(df, "b", "r", 35.0, 70.0, enabled=False)
    assert sorted(values(off, "id", "r")) == sorted(values(ranking.percentile_rank(df, "b", "r"), "id", "r"))


def test_quantiles(spark):
    xs = [random.Random(2).gauss(0, 1) for _ in range(101)] + [0.5, 0.5]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "v double")
    got = ranking.quantiles(df, "v", {"a": 0.0, "b": 0.3, "c": 1.0}, 7).first()
    assert np.allclose(tuple(got), np.quantile(xs, [0.0, 0.3, 1.0]))
    assert ranking.quantiles(df.where("v is null"), "v", {"a": 0.5}).first().a is None


def test_no_window_leaves_the_value(spark):
    df = spark.createDataFrame([("a", 2000, None), ("a", 2001, 2.0)], "k string, season int, v double")
    assert values(windows.smooth_reputation(df, ["k"], "season", "v", 0, 0.5, "x"), "x") == [(None,), (2.0,)]


def test_missing_signals(spark):
    df = spark.createDataFrame([(1990, 0.5, None, None, None), (2000, 0.5, None, None, None), (2000, 0.5, 2.0, 1.0, 0.6)], "season int, ts_percent double, gw double, gw_po double, po_ts double")
    df = df.withColumns({c: F.lit(None).cast("double") for c in ("po_g", "po_ppg", "po_fga", "ct_g", "ct_pts")})
    got = values(categories.fill_signals(df), "po_g", "po_ts", "gw_score", "ct_pts", "gw_po")
    assert got == [(0.0, 0.5, None, None, None), (0.0, 0.5, 0.0, 0.0, None), (0.0, 0.6, 21.0, 0.0, 1.0)]


def test_band_shrink(spark):
    df = spark.createDataFrame([(2000, 10.0, 0.5, 0.4), (2000, 30.0, 0.2, 0.5), (1990, 10.0, 0.5, 0.4), (2000, 10.0, None, 0.4)], "season int, fga double, p double, s double")
    got = [x for x, in values(shrink.band_shrink(df, [("p", "s")], F.col("fga"), 100.0, "x"), "x")]
    mu = (2 + 3) / (4 + 15)
    assert sorted(got, key=str) == sorted([pytest.approx((2 + 100 * mu) / 104), pytest.approx((3 + 100 * mu) / 115), None, None], key=str)


def test_stints_and_collapse(spark):
    rows = spark.createDataFrame([("p", 2000, "TOT", 90.0), ("p", 2000, "A", 50.0), ("p", 2000, "B", 40.0), ("p", 2000, "B", 99.0), ("q", 2000, "A", None)], "player_id string, season int, team string, mp double")
    assert sorted(values(windows.collapse_to_season(rows), "player_id", "team")) == [("p", "TOT"), ("q", "A")]
    assert sorted(values(windows.keep_stints(rows), "player_id", "team", "mp"), key=str) == [("p", "A", 50.0), ("p", "B", 99.0), ("q", "A", None)]
    # equal or missing minutes: the remaining columns decide, whatever the order of the rows
    for mp in (7.0, None):
        ties = [("p", 1949, "A", mp, 2, "x"), ("p", 1949, "A", mp, 1, "y"), ("p", 1949, "A", mp, None, "z")]
        for rows in (ties, ties[::-1]):
            df = spark.createDataFrame(rows, "player_id string, season int, team string, mp double, g int, s string").repartition(3)
            assert values(windows.keep_stints(df), "s") == values(windows.collapse_to_season(df), "s") == [("z",)]


def test_ratings_follow_their_scheme(spark):
    """Another weight, credibility, gate and curve give another rating; the defaults are the fixed values."""
    rng = random.Random(6)
    rows = [(i, 2000 + i % 2, *(float(rng.randint(1, 60)) for _ in range(7))) for i in range(40)]
    df = spark.createDataFrame(rows, "player_id int, season int, g double, mp double, trb double, trb_percent double, orb_percent double, drb_percent double, ast double").withColumns({"tov": F.lit(1.0), "po_fga": F.lit(1.0)})
    of = lambda how: {r.player_id: (r.comp_rebounding, r.rebounding) for r in categories.rate(df, ["rebounding"], how).collect()}
    usual = of(categories.Scheme())
    assert usual == {r.player_id: (r.comp_rebounding, r.rebounding) for r in categories.rate(df, ["rebounding"]).collect()}
    one = of(categories.Scheme(weights={"rebounding": {"oreb_pct": 1.0}}, credibility={}, mean=70.0, usual_spread=5.0, floor=60.0, cap=80.0))
    order = sorted(rows, key=lambda r: r[6])
    comps = [one[r[0]][0] for r in order]
    assert comps == sorted(comps) and all(60 <= x[1] <= 80 for x in one.values()) and usual != one
    assert abs(sum(x[1] for x in one.values()) / 40 - 70) < 1


def test_ranks_of_rows_without_a_key(spark):
    rows = [(None, 1.0), (None, 2.0), (7, 3.0), (7, 4.0)]
    df = spark.createDataFrame(rows, "id int, v double")
    assert sorted(values(ranking.percentile_ranks(df, [Rank("v", "r")]), "v", "r")) == [(1.0, 12.5), (2.0, 37.5), (3.0, 62.5), (4.0, 87.5)]
    groups = spark.createDataFrame([("a|b", "c", 1.0), ("a", "b|c", 2.0), (None, "n", 3.0), ("n", None, 4.0)], "g string, h string, v double")
    assert {r for _, r in values(ranking.percentile_ranks(groups, [Rank("v", "r", within=("g", "h"))]), "v", "r")} == {50.0}


def test_different_rows_read_differently(spark):
    of = lambda *rows: spark.createDataFrame(list(rows), "a string, b string")
    rows = [("a|b", "c"), ("a", "b|c"), (None, "c"), ("\\N", "c"), ("n", "c"), ("", "c"), ("1:a", "c"), ("c", None), (None, None)]
    assert len({quality.digest(of(x)).first() for x in rows}) == len(rows)
    assert quality.same_content(of(*rows), of(*rows[::-1])) and not quality.same_content(of(*rows), of(*rows[1:]))


def test_forced_rows_may_fill_a_cell(spark):
    df = spark.createDataFrame([("c", i, i, i < 4) for i in range(9)] + [("d", 1, 1, False)], "cell string, id int, v int, forced boolean")
    assert sorted(values(windows.forced_top(df, ["cell"], "forced", [F.desc("v")], 3, 2), "id", "place")) == [(0, 4), (1, 3), (2, 2), (3, 1)]


def test_rosters_and_document(spark, tmp_path):
    scored = spark.createDataFrame([(i, 1990 + i % 3, "N" if i == 1 else "A", 1.0 * i, 2.0, 10.0, 30.0) for i in range(1, 7)] + [(9, 1991, "Z", 1.0, None, 1.0, 1.0)], "player_id int, season int, team string, comp_x double, comp_y double, g double, mp double")
    lineage = spark.createDataFrame([("N", "A")], "code string, franchise string")
    brands = spark.createDataFrame([("Z", "Zs", 1), ("A", "As", 2)], "franchise string, name string, ordinal int")
    entries = curation.decade_entries(scored, lineage, ["x", "y"], ["g", "mp"])
    whole, dropped = curation.complete(entries, ["x", "y"])
    assert dropped.first().dropped == 1 and whole.count() == 6
    stars = curation.starred([scored.where("player_id = 6").select("player_id", "season"), scored.where("player_id = 6").select("player_id", F.lit(None).alias("season"))])
    members = scored.select("player_id", "season", "team", (100 - F.col("player_id")).cast("double").alias("mp"))
    roster, thin = curation.rosters(members, scored, whole, lineage, brands, stars, None, 3, 2)
    assert sorted(values(roster, "place", "id")) == [(1, "1_1990s_A"), (2, "2_1990s_A"), (3, "6_1990s_A")]
    assert thin.count() == 0
    ship = curation.shipped(whole, roster, brands, ["x", "y"], {"mpg": "mp"})
    assert {(r.id, r.team_label, r.stats.mpg) for r in ship.collect()} == {(f"{i}_1990s_A", "90s As", 3.0) for i in (1, 2, 6)}
    top = curation.ceiling(whole, roster, ["x", "y"]).first()
    assert top.total == top.x + top.y
    assert curation.ceiling(whole, roster.limit(0), ["x", "y"]).first().x == whole.agg(F.max("x")).first()[0]
    used, decades = curation.axes(roster, brands)
    assert values(used, "franchise") == [("A",)] and values(decades, "decade") == [("1990s",)]
    cells = roster.groupBy(F.concat_ws("_", "decade", "franchise").alias("cell")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    documents.write_fragments(ship, cells, curation.ceiling(whole, roster, ["x", "y"]), str(tmp_path / "doc"), grain="decade")
    documents.joined(spark, str(tmp_path / "doc"), str(tmp_path / "doc.json"))
    doc = json.loads((tmp_path / "doc.json").read_text())
    assert doc["meta"] == {"grain": "decade"} and list(doc["rosters"]) == ["1990s_A"] and len(doc["players"]) == 3
    assert values(sources.manifest(roster, "cells", "decade", "franchise"), "path") == [("cells/1990s/A",)]
    checks = {r.check: (r.value, r.passed) for r in quality.roster_checks(cells.union(spark.createDataFrame([("e", []), ("s", ["nobody"])], "cell string, ids array<string>")), whole, 3).collect()}
    assert checks == {"missing_ids": (1.0, False), "empty_cells": (1.0, False), "small_cells": (1.0, False)}


def test_percentile_table(spark, tmp_path):
    ecdf = spark.createDataFrame([(10, 0.0), (12, 40.0), (13, 0.0), (15, 100.0)], "score int, pct double")
    sources.write_percentiles(ecdf, str(tmp_path / "t"), era="all")
    assert sorted(values(sources.read_percentiles(spark, str(tmp_path / "t")), "score", "pct")) == sorted(values(ecdf, "score", "pct"))
    filled = windows.filled_ecdf(ecdf)
    assert sorted(values(filled, "score", "pct")) == [(10, 0.0), (11, 0.0), (12, 40.0), (13, 40.0), (14, 40.0), (15, 100.0)]
    targets = spark.createDataFrame([(0.0,), (40.0,), (41.0,), (101.0,)], "t double")
    assert sorted(values(windows.scores_for(filled, targets, "t"), "t", "score")) == [(0.0, 10), (40.0, 12), (41.0, 15), (101.0, 15)]


def test_runs(spark):
    picks = [(1, s, 99, 0) for s in range(6)] + [(1, 0, 1, 1)] + [(2, s, 50, 0) for s in range(5)] + [(3, s, 98 + (s > 0), 0) for s in range(6)]
    df = spark.createDataFrame(picks, "run int, slot int, rating int, at int")
    assert sorted(values(windows.run_scores(df, "run", "slot", "rating", [F.col("at")]), "run", "total", "perfect")) == [(1, 594, True), (3, 593, False)]


def test_filters_and_pages(spark):
    df = spark.createDataFrame([("a", 1990, "Ann  Lee"), ("A", 2000, "Bo Ash"), (None, 2001, "Cy Lee")], "lg string, season int, name string")
    assert df.where(filters.league_in(F.col("lg"), ["A"])).count() == 1 and df.where(filters.league_in(F.col("lg"), ["A"], exact=False)).count() == 2
    assert filters.in_era(df, "season", ["1990", "2001"]).count() == 2 and filters.in_era(df, "season", None).count() == 3
    page = filters.page(df, scalars.by_last_name(F.col("name")), 2)
    assert values(page, "name", "total") == [("Bo Ash", 3), ("Ann  Lee", 3)]
    wants = spark.createDataFrame([(1, 1, "x", "great"), (1, 2, "x", None), (2, 1, "y", "Weak"), (3, 1, "y", "odd")], "query_id int, seq int, ability string, qualifier string")
    got = sorted(values(filters.qualified(wants), "query_id", "key", "lo", "hi"), key=str)
    assert got == sorted([(1, "rate:x:gte", 82.0, None), (1, "rate:x:gte", 70.0, None), (2, "rate:y:lte", None, 45.0)], key=str)


def test_lookups(spark):
    df = spark.createDataFrame([("a",), ("z",)], "k string")
    lookup = spark.createDataFrame([("a", "b")], "old string, new string")
    assert sorted(values(joins.with_fallback(df, "k", lookup, "old", "new", "now"), "k", "now")) == [("a", "b"), ("z", "z")]
    lists = spark.createDataFrame([(["a", "q"],), (["q"],)], "ids array<string>")
    assert values(joins.dangling(lists, "ids", df, "k"), "k") == [("q",)]
    facts = spark.createDataFrame([("a", 5)], "k string, n int")
    assert sorted(values(joins.with_facts(df, [(facts, ["n"])], ["k"]), "k", "n")) == [("a", 5), ("z", None)]
    assert values(signals.presence(spark.createDataFrame([("p", 1), ("p", 1), (None, 1)], "player_id string, season int")), "share") == [(1.0,)]


def test_same_content(spark):
    a = spark.createDataFrame([(1, None), (2, "")], "a int, b string")
    assert quality.same_content(a, a.orderBy(F.desc("a"))) and not quality.same_content(a, a.na.fill("")) and not quality.same_content(a, a.limit(1))


def test_match_percent(spark):
    pool = spark.createDataFrame([(1, 90.0, 80.0), (2, 10.0, 20.0)], "id int, a double, b double")
    query = spark.createDataFrame([(7, 88.0, 79.0)], "id int, a double, b double")
    assert values(nearest(query, pool, "id", ["a", "b"]), "query_id", "match", "percent") == [(7, 1, 99)]


def test_thin_cells(spark):
    members = spark.createDataFrame([(2000, "A", 1, 5.0), (2000, "A", 2, 4.0), (2000, "B", 3, 1.0)], "season int, franchise string, id int, minutes double")
    assert values(grid.thin_cells(members, members.select("id"), 2), "franchise", "n") == [("B", 1)]
