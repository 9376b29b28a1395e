"""Data-quality checks; each gives rows of (check, subject, value, threshold, level, passed)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwright.functions import scalars


def _row(check: str, subject: str, value: Column, threshold: float, level: str, passed: Column) -> Column:
    return F.struct(F.lit(check).alias("check"), F.lit(subject).alias("subject"), value.cast("double").alias("value"), F.lit(float(threshold)).alias("threshold"), F.lit(level).alias("level"), F.coalesce(passed, F.lit(False)).alias("passed"))


def rating_checks(df: DataFrame, ratings: Sequence[str], mean_low: float = 45, mean_high: float = 55, most_at_top: float = 0.02, least_high: int = 3) -> DataFrame:
    """Q1, Q2, Q4, Q8: nulls, means, share at the top, fillability and range of each rating, in one pass."""
    facts = []
    for r in ratings:
        facts += [F.count_if(F.col(r).isNull()).alias(f"null_{r}"), F.avg(r).alias(f"mean_{r}"), F.avg((F.col(r) >= 100).cast("double")).alias(f"top_{r}"), F.count_if(F.col(r) >= 90).alias(f"high_{r}"), F.count_if(~F.col(r).between(0, 100)).alias(f"out_{r}")]
    one = df.agg(*facts)
    rows = []
    for r in ratings:
        c = lambda k: F.col(f"{k}_{r}")  # noqa: B023, E731
        rows += [
            _row("nulls", r, c("null"), 0, "hard", c("null") == 0),
            _row("mean", r, F.round(c("mean"), 6), mean_low, "soft", c("mean").between(mean_low, mean_high)),
            _row("share_at_top", r, F.round(c("top"), 6), most_at_top, "hard", c("top") <= most_at_top),
            _row("fillable", r, c("high"), least_high, "hard", c("high") >= least_high),
            _row("range", r, c("out"), 0, "hard", c("out") == 0),
        ]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def summary(df: DataFrame, ratings: Sequence[str], top: float) -> DataFrame:
    """(ability, n, mean, least, most, at_top) of each rating in one pass; missing ones are left out."""
    facts = lambda r: F.struct(F.lit(r).alias("ability"), F.count(r).alias("n"), F.round(F.avg(r), 9).alias("mean"), F.min(r).alias("least"), F.max(r).alias("most"), F.round(F.avg((F.col(r) >= top).cast("double")), 9).alias("at_top"))
    return df.agg(F.array(*map(facts, ratings)).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def balance(df: DataFrame, groups: str, order: str, ident: str, top: int = 200, least: int = 30) -> DataFrame:
    """Q3: how many of each group are among the top rows."""
    best = df.orderBy(F.desc(order), ident).limit(top)
    return best.groupBy(groups).agg(F.count("*").alias("value")).withColumn("passed", F.col("value") >= least)


def recall(expected: DataFrame, found: DataFrame, name: str, order: str, top: int) -> DataFrame:
    """Q6: expected names among the best ``top``; at least two thirds, and two, must be."""
    best = found.groupBy(name).agg(F.max(order).alias("_v")).orderBy(F.desc("_v"), name).limit(top)
    hit = expected.select(name).distinct().join(best, name, "left").agg(F.count("*").alias("expected"), F.count("_v").alias("value"))
    return hit.withColumn("passed", F.col("value") >= F.greatest(F.lit(2), F.floor((2 * F.col("expected") + 2) / 3)))


def scale_checks(df: DataFrame, ratings: Sequence[str], mean: float = 75, cap: float = 99, off: float = 3, most: float = 0.02) -> DataFrame:
    """Q5: distance of each mean from the curve's, and the share at its cap; both hard, in one pass."""
    one = df.agg(*(F.avg(r).alias(f"mean_{r}") for r in ratings), *(F.avg((F.col(r) >= cap).cast("double")).alias(f"cap_{r}") for r in ratings))
    rows = []
    for r in ratings:
        gap = F.round(F.abs(F.col(f"mean_{r}") - mean), 6)
        rows += [_row("scale_mean", r, gap, off, "hard", gap <= off), _row("share_at_cap", r, F.round(F.col(f"cap_{r}"), 6), most, "hard", F.col(f"cap_{r}") <= most)]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def signature_floors(df: DataFrame, name: str, ratings: Sequence[str], floors: DataFrame) -> DataFrame:
    """Q7: (name, ability, floor, best, passed) of each floor; names that are not found fail, softly.

    ``floors`` has name, ability, floor. Only rows of its names are unpivoted.
    """
    wanted = floors.select(F.col("name").alias("_name")).distinct()
    held = df.select(F.col(name).alias("_name"), *ratings).join(wanted, "_name", "left_semi")
    best = held.groupBy("_name").agg(*(F.max(r).alias(r) for r in ratings)).unpivot("_name", list(ratings), "_ability", "best")
    out = floors.join(best, (F.col("name") == F.col("_name")) & (F.col("ability") == F.col("_ability")), "left")
    return out.select("name", "ability", "floor", "best", F.coalesce(F.col("best") >= F.col("floor"), F.lit(False)).alias("passed"))


def digest(df: DataFrame) -> DataFrame:
    """Q9: row count and order-insensitive digest of the content, from the first 60 bits of each row's MD5. No two rows read alike."""
    text = scalars.row_text(*(F.col(f"`{c}`") for c in df.columns))
    h = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias("sum"))


def same_content(a: DataFrame, b: DataFrame) -> bool:
    """Q9: whether two builds have the same rows, in whatever order."""
    return a.columns == b.columns and digest(a).first() == digest(b).first()


def roster_checks(rosters: DataFrame, entries: DataFrame, least: int = 6) -> DataFrame:
    """Listed ids that no entry has, cells without ids (both hard), and cells of under ``least`` (soft).

    ``rosters`` has cell and ids (array).
    """
    missing = rosters.select(F.explode("ids").alias("id")).distinct().join(entries.select("id"), "id", "left_anti").agg(F.count("*").alias("missing"))
    size = F.coalesce(F.size("ids"), F.lit(0))
    one = rosters.agg(F.count_if(size <= 0).alias("empty"), F.count_if((size > 0) & (size < least)).alias("small")).crossJoin(missing)
    rows = [_row(f"{k}_{of}", "rosters", F.col(k), 0, level, F.col(k) == 0) for k, of, level in (("missing", "ids", "hard"), ("empty", "cells", "hard"), ("small", "cells", "soft"))]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def union_all(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)
