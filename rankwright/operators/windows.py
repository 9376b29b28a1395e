"""Ordered and windowed operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwright.functions import scalars
from rankwright.operators.scan import first_reaching, scan
from rankwright.sources import by_size, written

#: Scores that one row is expanded into at a time.
BLOCK = 4096


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def _remaining(df: DataFrame, *named: str) -> list[Column]:
    """The columns that ``named`` leaves, in their order: what settles ties. Maps cannot be ordered and are left out."""
    return [F.col(f"`{f.name}`").asc_nulls_first() for f in df.schema if f.name not in named and f.dataType.typeName() != "map"]


def collapse_to_season(df: DataFrame, keys: Sequence[str] = ("player_id", "season"), team: str = "team", minutes: str = "mp") -> DataFrame:
    """One row per player and season: the row over all teams if there is one, else the one with most minutes.

    Ties, and seasons whose minutes are missing, go to the smallest team, then to the smallest of the remaining columns in their order.
    """
    return first_per_key(df, keys, [F.desc(scalars.is_aggregate_team(F.col(team))), F.desc_nulls_last(minutes), F.asc(team), *_remaining(df, *keys, team, minutes)])


def keep_stints(df: DataFrame, keys: Sequence[str] = ("player_id", "season", "team"), team: str = "team", minutes: str = "mp") -> DataFrame:
    """One row per player, season and team, that with most minutes; rows over all teams go.

    Ties, and rows whose minutes are missing, go to the smallest of the remaining columns in their order.
    """
    return first_per_key(df.where(~scalars.is_aggregate_team(F.col(team))), keys, [F.desc_nulls_last(minutes), *_remaining(df, *keys, minutes)])


def smooth_reputation(df: DataFrame, keys: Sequence[str], season: str, value: str, window: int, decay: float, out: str) -> DataFrame:
    """Trailing maximum of value * decay ** gap over real season gaps of 0 to ``window``; no window leaves the value."""
    if window <= 0:
        return df.withColumn(out, F.col(value))
    gaps = F.explode(F.array(*map(F.lit, range(window + 1))))
    spread = df.where(F.col(value).isNotNull()).select(*keys, F.col(season), F.col(value), gaps.alias("_gap"))
    seen = spread.groupBy(*keys, (F.col(season) + F.col("_gap")).alias(season)).agg(F.max(F.col(value) * F.pow(F.lit(decay), F.col("_gap"))).alias(out))
    return df.drop(out).join(seen, [*keys, season], "left")


def forced_top(df: DataFrame, cell: Sequence[str], forced: str, order: Sequence[Column], k: int, least: int = 0) -> DataFrame:
    """Forced rows and the best others up to ``k``; cells of under ``least`` rows go."""
    part = Window.partitionBy(*cell).orderBy(*order)
    sizes = df.groupBy(*cell).agg(F.count("*").alias("_size"), F.count_if(F.col(forced)).alias("_forced")).where(F.col("_size") >= least)
    # a constant limit, so that each task cuts its rows before they are sent
    others = df.where(~F.coalesce(F.col(forced), F.lit(False))).withColumn("_place", F.row_number().over(part)).where(F.col("_place") <= k)
    both = others.unionByName(df.where(F.col(forced)).withColumn("_place", F.lit(0)))
    kept = both.join(sizes, list(cell)).where((F.col("_place") == 0) | (F.col("_place") <= k - F.col("_forced")))
    return kept.withColumn("place", F.row_number().over(part)).drop("_size", "_forced", "_place")


def streaks(days: DataFrame, user: str, day: str, today: Column) -> DataFrame:
    """Current and best run of consecutive days, all days, and whether today was played.

    The current run ends today or yesterday; otherwise it is 0.
    """
    distinct = days.select(user, F.col(day).alias("_day")).where("_day is not null").distinct()
    island = F.date_sub("_day", F.row_number().over(Window.partitionBy(user).orderBy("_day")))
    runs = distinct.withColumn("_island", island).groupBy(user, "_island").agg(F.count("*").alias("_len"), F.max("_day").alias("_end"))
    current = F.max(F.when((F.col("_end") == today) | (F.col("_end") == F.date_sub(today, 1)), F.col("_len")).otherwise(0))
    return runs.groupBy(user).agg(current.alias("current"), F.max("_len").alias("best"), F.sum("_len").alias("total_days"), F.bool_or(F.col("_end") == today).alias("played_today"))


def running_total(value: str, keys: Sequence[str], order: Sequence[Column]) -> Column:
    """W16, W17, within keys that are many and small; sums over all rows or hot groups are ``scan``'s."""
    return F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def score_steps(df: DataFrame, score: str, groups: Sequence[str] = (), ceiling: int | None = None) -> DataFrame:
    """(score, until, n, pct) of the whole scores that occur, per group: each share holds from its score to ``until``.

    A distributed running sum over distinct scores: a row per score that occurs, however far apart they are.
    """
    keys = list(groups)
    counts = written(df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).cast("int").alias("score")).agg(F.count("*").alias("n")), "counts")
    top = F.max("score") if ceiling is None else F.greatest(F.max("score"), F.lit(ceiling))
    ends = counts.groupBy(*(F.col(k).alias(f"_g{i}") for i, k in enumerate(keys))).agg(F.sum("n").alias("_total"), top.alias("_top"))
    run = scan(counts, keys, [F.col("score")], sums={"_run": F.col("n")}, nexts={"_next": F.col("score")})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_g{i}"))
    both = run.join(ends, same) if keys else run.crossJoin(F.broadcast(ends))
    return both.select(*keys, "score", F.coalesce(F.col("_next") - 1, "_top").alias("until"), "n", F.round(100.0 * F.col("_run") / F.col("_total"), 2).alias("pct"))


def spelled_out(steps: DataFrame, kept: Sequence[str], first: str, last: str, out: str) -> DataFrame:
    """A row for every whole number from ``first`` to ``last``, with the ``kept`` columns. Long steps are dealt out in blocks before they are
    expanded; ``steps`` is a written table."""
    cut = F.col(last) - F.col(first) >= BLOCK
    starts = F.when(cut, F.sequence(first, last, F.lit(BLOCK))).otherwise(F.array(first))
    blocks = steps.select(*kept, F.col(last).alias("_until"), F.explode(starts).alias("_from"))
    blocks = blocks.select(*kept, "_from", F.least("_until", F.col("_from") + BLOCK - 1).alias("_to"))
    long = F.col("_to") - F.col("_from") == BLOCK - 1
    n = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.where(~long).unionByName(blocks.where(long).repartition(n, *kept, "_from"))
    return dealt.select(*kept, F.explode(F.sequence("_from", "_to")).alias(out))


def every_score(steps: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """(score, pct) for every whole score of (score, until, pct), a written table."""
    return spelled_out(steps, [*groups, "pct"], "score", "until", "score").select(*groups, "score", "pct")


def score_ecdf(df: DataFrame, score: str, groups: Sequence[str] = (), ceiling: int | None = None) -> DataFrame:
    """(score, pct) for every whole score from the lowest to the ceiling, per group."""
    return every_score(written(score_steps(df, score, groups, ceiling), "steps"), groups)


def ecdf_anchor(ecdf: DataFrame, pct: float, groups: Sequence[str] = ()) -> DataFrame:
    """The first score that reaches ``pct``, else the highest."""
    anchor = F.coalesce(F.min(F.when(F.col("pct") >= pct, F.col("score"))), F.max("score"))
    return ecdf.groupBy(*groups).agg(anchor.alias("anchor"))


def filled_ecdf(ecdf: DataFrame) -> DataFrame:
    """The table with a row for every whole score; a score that is not listed, or listed at 0, has the last share before it."""
    run = scan(ecdf.select("score", "pct"), [], [F.col("score")], lasts={"_pct": F.when(F.col("pct") > 0, F.col("pct"))}, nexts={"_next": F.col("score")})
    steps = run.select("score", F.coalesce(F.col("_next") - 1, "score").alias("until"), F.coalesce("_pct", F.lit(0.0)).alias("pct"))
    return every_score(written(steps, "steps"))


def scores_for(ecdf: DataFrame, targets: DataFrame, target: str, out: str = "score") -> DataFrame:
    """For each of the ``targets`` the smallest score that reaches it, else the highest of the table.

    Targets and table are merged in descending order of the share; the smallest score seen so far is the answer, as shares need not rise.
    """
    table = ecdf.select(F.col("pct").cast("double").alias("_v"), F.col("score").alias("_score"))
    kept = F.struct(*(F.col(f"`{c}`") for c in targets.columns)).alias("_row")
    typed = F.struct(*(F.lit(None).cast(t.dataType).alias(t.name) for t in targets.schema)).alias("_row")
    mine = targets.select(F.col(target).cast("double").alias("_v"), F.lit(None).cast(table.schema["_score"].dataType).alias("_score"), kept, F.lit(True).alias("_asks"), F.monotonically_increasing_id().alias("_tie"))
    theirs = table.select("_v", "_score", typed, F.lit(False).alias("_asks"), F.lit(0).cast("long").alias("_tie"))
    least = scan(theirs.unionByName(mine), [], [F.desc_nulls_first("_v"), F.asc("_asks"), F.asc("_score"), F.asc("_tie")], mins={"_least": F.col("_score")})
    found = least.where("_asks").crossJoin(F.broadcast(ecdf.agg(F.max("score").alias("_top"))))
    reached = F.when(F.col("_v").isNotNull(), F.col("_least"))
    return found.select(*(F.col("_row").getField(c).alias(c) for c in targets.columns if c != out), F.coalesce(reached, "_top").alias(out))


def run_scores(picks: DataFrame, run: str, slot: str, rating: str, order: Sequence[Column], slots: int = 6) -> DataFrame:
    """(run, total, perfect) of runs that filled all ``slots``; the first pick of a slot counts, players may repeat."""
    first = first_per_key(picks, [run, slot], order)
    out = first.groupBy(run).agg(F.sum(rating).alias("total"), scalars.perfect(F.col(rating)).alias("perfect"), F.count("*").alias("_n"))
    return out.where(F.col("_n") == slots).drop("_n")


def ecdf_lookup(df: DataFrame, score: str, ecdf: DataFrame, out: str) -> DataFrame:
    """Percentile of a score, clamped to the ends of the table, which has a row for every whole score.

    The table is broadcast only if it has few rows; beyond that it is joined by score.
    """
    ecdf = written(ecdf.select(F.col("score").alias("_at"), F.col("pct").alias(out)), "ecdf")
    ends = ecdf.agg(F.min("_at").alias("lo"), F.max("_at").alias("hi")).first()
    at = F.least(F.greatest(F.floor(F.col(score) + 0.5).cast("int"), F.lit(ends.lo)), F.lit(ends.hi))
    return by_size(df.drop(out).withColumn("_at", F.when(F.col(score).isNotNull(), at)), ecdf, ["_at"], "left").drop("_at")
