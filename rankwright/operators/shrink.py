"""Shrinkage towards group means, and composites of ranks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_rate(df: DataFrame, makes: str, attempts: str, groups: Sequence[str], out: str) -> DataFrame:
    """Ratio of sums per group, on every row; missing if nothing was attempted."""
    rates = df.groupBy(*groups).agg(F.try_divide(F.sum(makes), F.sum(attempts)).alias(out))
    return df.drop(out).join(rates, list(groups), "left")


def shrink(makes: Column, attempts: Column, mean: Column, k: float) -> Column:
    """(makes + mean * k) / (attempts + k); missing counts as 0."""
    m, a = F.coalesce(makes, F.lit(0.0)), F.coalesce(attempts, F.lit(0.0))
    return (m + mean * k) / (a + k)


def band_shrink(df: DataFrame, bands: Sequence[tuple[str, str]], attempts: Column, k: float, out: str, first_season: int = 1997, least: float = 0.0, season: str = "season") -> DataFrame:
    """Accuracy over bands of shots, shrunk to the season's mean over the rows that count.

    ``bands`` are (accuracy, share of attempts) columns. A row counts from ``first_season`` on, if some accuracy is
    known and it has attempts, ``least`` or more; the others are missing.
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    tries = [zero(attempts * F.col(share)) for _, share in bands]
    n = sum(tries, F.lit(0.0))
    makes = sum((zero(F.col(accuracy) * t) for (accuracy, _), t in zip(bands, tries)), F.lit(0.0))
    known = F.coalesce(*(F.col(a) for a, _ in bands)).isNotNull()
    made = df.withColumns({"_n": n, "_makes": makes}).withColumn("_ok", F.coalesce((F.col(season) >= first_season) & known & (F.col("_n") >= least) & (F.col("_n") > 0), F.lit(False)))
    rates = made.where("_ok").groupBy(season).agg(F.try_divide(F.sum("_makes"), F.sum("_n")).alias("_mu"))
    return made.join(rates, season, "left").withColumn(out, F.when(F.col("_ok"), shrink(F.col("_makes"), F.col("_n"), F.col("_mu"), k))).drop("_n", "_makes", "_ok", "_mu")


def credibility_shrink(df: DataFrame, value: str, volume: str, k: float, out: str, mean: float | None = None) -> DataFrame:
    """R2: mean + (value - mean) * n / (n + k); the mean is unweighted, missing volume is 0."""
    if mean is None:
        df = df.crossJoin(F.broadcast(df.agg(F.avg(value).alias("_mean"))))
    else:
        df = df.withColumn("_mean", F.lit(mean))
    n = F.greatest(F.coalesce(F.col(volume), F.lit(0)), F.lit(0)).cast("double")
    return df.withColumn(out, F.col("_mean") + (F.col(value) - F.col("_mean")) * n / (n + k)).drop("_mean")


def weighted_composite(weights: Mapping[str, float]) -> Column:
    """Weighted mean of columns, weights renormalised over those present; none gives missing."""
    total = sum((F.when(F.col(c).isNotNull(), F.lit(float(w))).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    value = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    return F.when(total > 0, value / total)


def best_of(*columns: Column | str) -> Column:
    """The largest of what is present."""
    return F.greatest(*columns)


def lift_only(value: Column, lift: Column) -> Column:
    """A second signal that can only raise the first."""
    return F.greatest(value, lift)
