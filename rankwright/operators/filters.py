"""Predicates and funnels; batches of criteria are matched in ``criteria``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwright.sources import observed


def enough_sample(games: Column, minutes: Column, least_games: float, least_minutes: float) -> Column:
    """Enough games, and enough minutes where they are known."""
    return (games >= least_games) & ((minutes >= least_minutes) | minutes.isNull())


def floored_share(share: Column, least: float) -> Column:
    """Shares under the floor count as 0."""
    return F.when(share >= least, share).otherwise(0.0)


def league_in(league: Column, leagues: Sequence[str], exact: bool = True) -> Column:
    """Whether a league is one of those given; not ``exact``, case does not matter."""
    return league.isin(*leagues) if exact else F.upper(league).isin(*(x.upper() for x in leagues))


def since(season: Column, first) -> Column:
    """Seasons, or decade labels, from the first one on."""
    return season >= F.lit(first)


def universe(df: DataFrame, leagues: Sequence[str], first_season: int, least_games: float, least_minutes: float) -> tuple[DataFrame, DataFrame]:
    """The rows that are rated, and how many are left after each filter. Rows have lg, season, g, mp."""
    steps = {"league": league_in(F.col("lg"), leagues), "era": since(F.col("season"), first_season), "sample": enough_sample(F.col("g"), F.col("mp"), least_games, least_minutes)}
    return df.where(steps["league"] & steps["era"] & steps["sample"]), funnel(df, steps)


def in_era(df: DataFrame, token: str, tokens: Sequence[str] | None) -> DataFrame:
    """Rows of the given time tokens, compared as text; without tokens all."""
    return df if tokens is None else df.where(F.col(token).cast("string").isin(*map(str, tokens)))


def page(df: DataFrame, order: Sequence[Column], cap: int = 300) -> DataFrame:
    """The first ``cap`` rows and, on each, how many there are in all."""
    return df.orderBy(*order).limit(cap).crossJoin(F.broadcast(df.agg(F.count("*").alias("total"))))


#: What a qualifier asks of a rating: at least, or at most.
QUALIFIERS = (("elite", 90.0, None), ("great", 82.0, None), ("good", 70.0, None), ("decent", 60.0, None), ("weak", None, 45.0), ("", 70.0, None))


def qualified(wants: DataFrame) -> DataFrame:
    """Criteria of (query_id, seq, ability, qualifier); no qualifier asks for the same as a plain ability. Unknown qualifiers go."""
    known = wants.sparkSession.createDataFrame(QUALIFIERS, "qualifier string, lo double, hi double")
    named = wants.withColumn("qualifier", F.lower(F.coalesce("qualifier", F.lit(""))))
    side = F.when(F.col("lo").isNotNull(), "gte").otherwise("lte")
    return named.join(F.broadcast(known), "qualifier").select("query_id", F.concat_ws(":", F.lit("rate"), "ability", side).alias("key"), "seq", F.lit("range").alias("kind"), F.col("ability").alias("field"), "lo", "hi", F.lit(None).cast("string").alias("text"))


def kept(df: DataFrame, steps: Mapping[str, Column], name: str = "kept") -> tuple[DataFrame, dict[str, int]]:
    """The rows that pass all ``steps``, written, and how many were left after each, counted in the pass that writes them."""
    held, counts = F.lit(True), {"all": F.count(F.lit(1))}
    for step, test in steps.items():
        held = held & F.coalesce(test, F.lit(False))
        counts[step] = F.count_if(held)
    return observed(df, name, counts, lambda x: x.where(held))


def funnel(df: DataFrame, steps: Mapping[str, Column]) -> DataFrame:
    """Rows left after each of the successive filters, in one pass."""
    held, counts = F.lit(True), [F.count("*").alias("all")]
    for name, step in steps.items():
        held = held & F.coalesce(step, F.lit(False))
        counts.append(F.count_if(held).alias(name))
    return df.agg(*counts)
