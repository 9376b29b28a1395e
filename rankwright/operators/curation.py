"""Curation: members and stars of teams, entries by decade, rosters, axes and the ceiling of a pool."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwright.functions import scalars
from rankwright.operators import joins, ranking, windows
from rankwright.operators.ranking import Rank
from rankwright.sources import by_size, written

#: Decade curve (mean, sd, floor, cap).
DECADE_CURVE = (75.0, 9.0, 55.0, 99.0)


def membership(totals: DataFrame, per_game: DataFrame, extra: str, keys: Sequence[str] = ("player_id", "season", "team")) -> DataFrame:
    """Rows of single teams, with ``extra`` of the per-game table as a tie-break."""
    return totals.where(~scalars.is_aggregate_team(F.col("team"))).join(per_game.select(*keys, extra), list(keys), "left")


def starred(sources: Sequence[DataFrame]) -> DataFrame:
    """Distinct (player_id, season) of all recognitions; rows without season go."""
    pairs = (s.select("player_id", F.col("season").try_cast("int").alias("season")) for s in sources)
    return reduce(DataFrame.union, pairs).where("player_id is not null and season is not null").distinct()


def with_cell(df: DataFrame, lineage: DataFrame, first: int = 1950) -> DataFrame:
    """The franchise of a team by ``lineage`` (code, franchise), itself if not listed, and the decade of a season."""
    return joins.with_fallback(df, "team", lineage, "code", "franchise", "franchise").withColumn("decade", scalars.decade(F.col("season"), first))


def entry_id() -> Column:
    return scalars.composite_id(F.col("player_id").cast("string"), F.col("decade"), F.col("franchise"))


def decade_entries(scored: DataFrame, lineage: DataFrame, abilities: Sequence[str], stats: Sequence[str], first_decade: str | None = "1960s") -> DataFrame:
    """A row per player, franchise and decade: best composite of each ability ranked again and curved, summed
    stats, and season and team of the row with the best mean composite (ties: season, then team).

    ``scored`` has player_id, season, team, comp_<ability> and the stats.
    """
    keys = ["player_id", "franchise", "decade"]
    df = with_cell(scored, lineage)
    if first_decade:
        df = df.where(F.col("decade") >= first_decade)
    known = sum((F.col(f"comp_{a}").isNotNull().cast("int") for a in abilities), F.lit(0))
    total = sum((F.coalesce(f"comp_{a}", F.lit(0.0)) for a in abilities), F.lit(0.0))
    overall = F.when(known > 0, F.round(total / known, 9))
    best = F.min(F.struct(overall.isNull().alias("none"), (-overall).alias("less"), "season", "team")).alias("_best")
    peaks = df.groupBy(*keys).agg(*(F.max(f"comp_{a}").alias(f"comp_{a}") for a in abilities), *(F.sum(F.coalesce(s, F.lit(0.0))).alias(s) for s in stats), best)
    ranked = ranking.percentile_ranks(peaks, [Rank(f"comp_{a}", f"_{a}", curve=DECADE_CURVE) for a in abilities])
    return ranked.select(entry_id().alias("id"), *keys, *(scalars.half_even(F.col(f"_{a}")).alias(a) for a in abilities), *stats, F.col("_best.season").alias("peak_season"), F.col("_best.team").alias("peak_team"))


def complete(entries: DataFrame, abilities: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Entries that have all ratings, and a row with the number of dropped ones."""
    whole = reduce(lambda a, b: a & b, (F.col(a).isNotNull() for a in abilities))
    return entries.where(whole), entries.agg(F.count_if(~whole).alias("dropped"))


def rated_stints(members: DataFrame, scored: DataFrame, lineage: DataFrame) -> DataFrame:
    """The stints of ``members`` that are in the scored universe, with franchise and decade."""
    stints = ["player_id", "season", "team"]
    return with_cell(members.join(scored.select(*stints), stints, "left_semi"), lineage)


def _minutes(held: DataFrame) -> DataFrame:
    return held.groupBy("decade", "franchise", "player_id").agg(F.sum(F.coalesce("mp", F.lit(0.0))).alias("mp"))


def cell_minutes(members: DataFrame, scored: DataFrame, lineage: DataFrame) -> DataFrame:
    """A10: minutes per decade, franchise and player over the stints that are in the scored universe."""
    return _minutes(rated_stints(members, scored, lineage))


def rosters(members: DataFrame, scored: DataFrame, entries: DataFrame, lineage: DataFrame, brands: DataFrame, stars: DataFrame, manual: DataFrame | None = None, k: int = 12, least: int = 8) -> tuple[DataFrame, DataFrame]:
    """(decade, franchise, id, place) of branded cells with ``least`` entries, and the cells that have too few.

    The ``k`` with most minutes (ties: id); who was starred in a season with the franchise, or is in ``manual`` (decade,
    franchise, player_id), is never cut. ``entries`` are those that may be listed.
    """
    # written, as minutes and stars both read it
    held = written(rated_stints(members, scored, lineage).select("decade", "franchise", "player_id", "season", "mp"), "held")
    branded = written(brands.select("franchise").distinct(), "branded")
    minutes = by_size(_minutes(held), branded, ["franchise"], "left_semi").withColumn("id", entry_id())
    listed = minutes.join(entries.select("id"), "id", "left_semi")
    cell = ["decade", "franchise", "player_id"]
    forced = held.join(stars, ["player_id", "season"], "left_semi").select(*cell)
    if manual is not None:
        forced = forced.union(manual.select(*cell))
    marked = written(listed.join(forced.distinct().withColumn("forced", F.lit(True)), cell, "left").na.fill(False, ["forced"]), "listed")
    grid = windows.forced_top(marked, ["decade", "franchise"], "forced", [F.desc("mp"), F.col("id")], k, least)
    thin = marked.groupBy("decade", "franchise").agg(F.count("*").alias("n")).where(F.col("n") < least)
    return grid.select("decade", "franchise", "id", "place"), thin


def shipped(entries: DataFrame, roster: DataFrame, brands: DataFrame, abilities: Sequence[str], stats: Mapping[str, str]) -> DataFrame:
    """Listed entries with ratings, per-game stats and a label: the peak team's name, else the franchise's, else its code.

    ``brands`` has franchise (any team code), name; ``stats`` maps an output to its total; games are ``g``.
    """
    held = entries.join(roster.select("id").distinct(), "id", "left_semi")
    names = written(brands.select("franchise", "name"), "names")
    held = by_size(by_size(held, names.toDF("peak_team", "_peak"), ["peak_team"], "left"), names.toDF("franchise", "_own"), ["franchise"], "left")
    label = F.concat_ws(" ", scalars.short_decade(F.col("decade")), F.coalesce("_peak", "_own", "franchise"))
    rated = F.struct(*(F.col(a) for a in abilities)).alias("ratings")
    per = F.struct(*(scalars.per_game(F.col(total), F.col("g")).alias(name) for name, total in stats.items())).alias("stats")
    return held.select("id", "player_id", rated, per, "peak_season", label.alias("team_label"))


def axes(roster: DataFrame, brands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The franchises that are used, in the order of ``brands`` (franchise, name, ordinal), and the sorted decades."""
    used = brands.join(roster.select("franchise").distinct(), "franchise", "left_semi").select("ordinal", "franchise", "name").orderBy("ordinal")
    return used, roster.select("decade").distinct().orderBy("decade")


def ceiling(entries: DataFrame, reachable: DataFrame | None, abilities: Sequence[str]) -> DataFrame:
    """The best of each ability over reachable entries, or over all if none is reachable, and their sum."""
    held = entries if reachable is None else entries.join(reachable.select("id").distinct().withColumn("_in", F.lit(True)), "id", "left")
    inside = F.lit(True) if reachable is None else F.col("_in")
    tops = held.agg(*(F.coalesce(F.max(F.when(inside, F.col(a))), F.when(F.count_if(inside) == 0, F.max(a))).alias(a) for a in abilities))
    return tops.withColumn("total", sum((F.col(a) for a in abilities), F.lit(0)))
