"""Signals by (player, season): recognition, box scores, go-ahead shots and late scoring."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwright.functions import scalars
from rankwright.operators import filters, joins, windows
from rankwright.sources import written

KEYS = ("player_id", "season")


def presence(rows: DataFrame) -> DataFrame:
    """(player_id, season, share 1) of who is there at all."""
    counts = rows.where("player_id is not null and season is not null").groupBy(*KEYS).agg(F.count("*").alias("_n"))
    return counts.select(*KEYS, F.least("_n", F.lit(1)).cast("double").alias("share"))


@dataclass(frozen=True)
class Source:
    """Rows of (player_id, season, share); the largest share of a key counts, those under ``least`` as 0."""

    rows: DataFrame
    weight: float
    least: float = 0.0


def recognition(spine: DataFrame, sources: Sequence[Source], out: str, window: int, decay: float, recorded: DataFrame | None = None) -> DataFrame:
    """Weighted sum of shares on the spine's rows, smoothed over the seasons.

    Rows without recognition count as 0, so that they get what earlier seasons left.
    ``recorded`` (player_id, from_season, to_season, share) raises a season to at least its share.
    """
    parts = [s.rows.groupBy(*KEYS).agg((F.max(filters.floored_share(F.coalesce("share", F.lit(0.0)), s.least)) * s.weight).alias("_part")) for s in sources]
    found = reduce(DataFrame.unionByName, parts).groupBy(*KEYS).agg(F.sum("_part").alias(out))
    df = spine.drop(out).join(found, list(KEYS), "left").na.fill(0.0, [out])
    if recorded is not None:
        spans = joins.expand_intervals(recorded, ["player_id"], "from_season", "to_season", "share").withColumnRenamed("share", "_share")
        df = df.join(spans, list(KEYS), "left").withColumn(out, F.greatest(out, "_share")).drop("_share")
    return windows.smooth_reputation(df, ["player_id"], "season", out, window, decay, "_smooth").drop(out).withColumnRenamed("_smooth", out)


def scoring_titles(df: DataFrame, points: str, games: str, least_games: float = 40) -> DataFrame:
    """(player_id, season, share 1) of each season's best points per game, ties included."""
    sums = df.groupBy(*KEYS).agg(F.coalesce(F.sum(points), F.lit(0.0)).alias("_p"), F.sum(games).alias("_g")).where(F.col("_g") >= least_games)
    per = sums.select(*KEYS, F.round(F.col("_p") / F.col("_g"), 9).alias("_rate"))
    best = per.groupBy("season").agg(F.max("_rate").alias("_rate"))
    return per.join(best, ["season", "_rate"]).select(*KEYS, F.lit(1.0).alias("share"))


def _by_normal_name(counted: DataFrame, sums: Sequence[str]) -> DataFrame:
    """Sums by (season, name) again by normal names: each name is made normal once, not once a row."""
    return counted.withColumn("name", scalars.normal_name(F.col("name"))).groupBy("season", "name").agg(*(F.sum(c).alias(c) for c in sums))


def _identified(counted: DataFrame, people: DataFrame, sums: Sequence[str], weight: str, least: float | None, overrides: DataFrame | None) -> DataFrame:
    """Sums by name turned into sums by id; several names may lead to one id. ``least`` gates the matched share."""
    counted = written(counted, "counted")
    ids = joins.resolve(counted, people, "season", "name", "player_id", scalars.last_token(F.col("name")), scalars.first_token(F.col("name")), overrides)
    named = counted.join(ids, ["season", "name"], "left")
    if least is not None:
        named, _ = joins.match_gate(named, F.col("player_id").isNotNull(), weight, least, "name")
    return named.where("player_id is not null").groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in sums))


def playoff_box(box: DataFrame, people: DataFrame, least: float | None = 0.98, overrides: DataFrame | None = None) -> DataFrame:
    """Totals of playoff games by id, rates derived again from the totals.

    ``box`` has name, ts, game_type, minutes, points, attempts, free; ``people`` season, name (normal), player_id.
    """
    rows = box.where("game_type = 'Playoffs'").select("name", scalars.season_of(F.col("ts")).alias("season"), "minutes", "points", "attempts", "free")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    counted = rows.where("name is not null and season is not null").groupBy("season", "name").agg(F.count("*").alias("po_g"), zero("minutes").alias("po_mp"), zero("points").alias("po_pts"), zero("attempts").alias("po_fga"), zero("free").alias("po_fta"))
    counted = _by_normal_name(counted, ["po_g", "po_mp", "po_pts", "po_fga", "po_fta"]).withColumn("_one", F.lit(1.0))
    out = _identified(counted, people, ["po_g", "po_mp", "po_pts", "po_fga", "po_fta"], "_one", least, overrides)
    return out.withColumns({"po_ppg": F.col("po_pts") / F.greatest("po_g", F.lit(1)), "po_ts": scalars.true_shooting(F.col("po_pts"), F.col("po_fga"), F.col("po_fta"))})


def go_ahead(period: Column, clock: Column, mine: Column, theirs: Column, value: Column, seconds: float = 24) -> Column:
    """A late made shot that turned a tie or deficit into a lead; scores are those after it."""
    worth = F.coalesce(value, F.lit(2))
    return (period >= 4) & (clock <= seconds) & (mine > theirs) & (mine - worth <= theirs)


def late_weight(period: Column, clock: Column, before: Column, seconds: float = 300, margin: int = 5, behind: float = 1.0, ahead: float = 0.25) -> Column:
    """P5: weight of points scored late in a close game, missing if it was neither; ``before`` is the lead before them."""
    return F.when((period >= 4) & (clock <= seconds) & (F.abs(before) <= margin), F.when(before <= 0, behind).otherwise(ahead))


def _plays(plays: DataFrame, games: DataFrame) -> DataFrame:
    """Plays with their game's type and both scores; teams that are not the home team count as away."""
    joined = plays.join(games.select("game_id", "game_type", "home_team"), "game_id", "left")
    home = F.coalesce(F.col("team_id") == F.col("home_team"), F.lit(False))
    return joined.select(
        "game_id", "period", "made", "free", "value", scalars.clock_seconds(F.col("clock")).alias("clock"),
        "name", scalars.season_of(F.col("ts")).alias("season"), (F.col("game_type") == "Playoffs").alias("playoff"),
        F.when(home, F.col("home_score")).otherwise(F.col("away_score")).alias("mine"), F.when(home, F.col("away_score")).otherwise(F.col("home_score")).alias("theirs"),
    ).where("name is not null and season is not null")


def game_winners(plays: DataFrame, games: DataFrame, people: DataFrame, least: float | None = 0.9, overrides: DataFrame | None = None) -> DataFrame:
    """(player_id, season, gw, gw_po). No plays give no rows.

    ``plays`` has game_id, period, clock, team_id, name, ts, made, free, value, home_score, away_score.
    """
    rows = _plays(plays.where("period >= 4 and made and not coalesce(free, false)"), games)
    shots = rows.where(go_ahead(F.col("period"), F.col("clock"), F.col("mine"), F.col("theirs"), F.col("value")))
    counted = shots.groupBy("season", "name").agg(F.count("*").alias("gw"), F.count_if("playoff").alias("gw_po"))
    return _identified(_by_normal_name(counted, ["gw", "gw_po"]), people, ["gw", "gw_po"], "gw", least, overrides)


def late_scoring(plays: DataFrame, games: DataFrame, people: DataFrame, least: float | None = 0.9, overrides: DataFrame | None = None) -> DataFrame:
    """(player_id, season, ct_pts, ct_g): weighted late playoff points, and games with some. A free throw is worth 1."""
    rows = _plays(plays.where("period >= 4 and made"), games).where("playoff")
    worth = F.when(F.coalesce("free", F.lit(False)), 1).otherwise(F.coalesce("value", F.lit(2)))
    weight = late_weight(F.col("period"), F.col("clock"), F.col("mine") - worth - F.col("theirs"))
    scored = rows.select("season", "name", "game_id", (worth * weight).alias("_points")).where("_points is not null")
    scored = scored.groupBy("season", "name", "game_id").agg(F.sum("_points").alias("_points")).withColumn("name", scalars.normal_name(F.col("name")))
    counted = scored.groupBy("season", "name").agg(F.sum("_points").alias("ct_pts"), F.count_distinct("game_id").alias("ct_g"))
    return _identified(counted, people, ["ct_pts", "ct_g"], "ct_pts", least, overrides)


def winner_score(gw: Column, gw_po: Column, season: Column, playoff_weight: float = 20, first_season: int = 1997) -> Column:
    """Playoff shots weigh more; none counts as 0, and seasons before the coverage are missing."""
    zero = F.lit(0)
    return F.when(season >= first_season, F.coalesce(gw, zero) + (playoff_weight - 1) * F.coalesce(gw_po, zero))
