"""Signals, grids and checks on tables worked out by hand."""

from pyspark.sql import functions as F

from rankwright.operators import grid, quality, signals


def test_recognition_floors_sums_and_smooths(spark):
    spine = spark.createDataFrame([("a", 2000), ("a", 2002), ("a", 2003), ("b", 2000)], "player_id string, season int")
    votes = spark.createDataFrame([("a", 2000, 0.8), ("a", 2000, 0.3), ("b", 2000, 0.01), ("a", 2002, None)], "player_id string, season int, share double")
    award = spark.createDataFrame([("a", 2000, 0.2)], "player_id string, season int, share double")
    got = signals.recognition(spine, [signals.Source(votes, 1.0, 0.02), signals.Source(award, 0.5)], "fame", 2, 0.5)
    assert {(r.player_id, r.season): round(r.fame, 6) for r in got.collect()} == {("a", 2000): 0.9, ("a", 2002): 0.225, ("a", 2003): 0.0, ("b", 2000): 0.0}


def test_no_plays_give_no_rows(spark):
    plays = spark.createDataFrame([], "game_id long, period int, clock string, team_id long, name string, ts timestamp, made boolean, free boolean, value int, home_score int, away_score int")
    games = spark.createDataFrame([], "game_id long, game_type string, home_team long")
    people = spark.createDataFrame([], "season int, name string, player_id string")
    assert signals.game_winners(plays, games, people).collect() == []
    assert signals.late_scoring(plays, games, people).collect() == []


def test_go_ahead_and_late_weight(spark):
    rows = spark.createDataFrame([(4, 10.0, 90, 89, 2), (4, 30.0, 90, 89, 2), (3, 10.0, 90, 89, 2), (4, 10.0, 93, 90, 2), (5, 24.0, 91, 90, None)], "p int, c double, m int, t int, v int")
    c = F.col
    got = rows.select(signals.go_ahead(c("p"), c("c"), c("m"), c("t"), c("v")).alias("x"), signals.late_weight(c("p"), c("c"), c("m") - F.coalesce("v", F.lit(2)) - c("t")).alias("w")).collect()
    assert [r.x for r in got] == [True, False, False, False, True]
    assert [r.w for r in got] == [1.0, 1.0, None, 0.25, 1.0]


def test_head_to_head_and_floors(spark):
    one = spark.createDataFrame([(1, 1, 90), (1, 2, 80), (2, 1, 70), (3, 9, 1)], "board int, slot int, rating int")
    other = spark.createDataFrame([(1, 1, 85), (1, 2, 80), (2, 1, 75)], "board int, slot int, rating int")
    got = {r.board: tuple(r)[1:] for r in grid.head_to_head(one, other).collect()}
    assert got == {1: (1, 0, 1, "win"), 2: (0, 1, 0, "loss")}
    rated = spark.createDataFrame([("x", 91, 40), ("x", 60, 50), ("z", 99, 99)], "name string, shot int, pass int")
    floors = spark.createDataFrame([("x", "shot", 90), ("x", "pass", 60), ("y", "shot", 10)], "name string, ability string, floor int")
    found = {(r["name"], r.ability): (r.best, r.passed) for r in quality.signature_floors(rated, "name", ["shot", "pass"], floors).collect()}
    assert found == {("x", "shot"): (91, True), ("x", "pass"): (50, False), ("y", "shot"): (None, False)}
