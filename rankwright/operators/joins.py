"""Lookups, resolution and range joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwright.operators import windows
from rankwright.operators.intervals import largest_over
from rankwright.operators.scan import first_reaching
from rankwright.sources import by_size, discard, observed, written


def with_fallback(df: DataFrame, key: str, lookup: DataFrame, source: str, target: str, out: str) -> DataFrame:
    """Dictionary lookup; keys that are not listed stay as they are. Keys may be few and their rows many, so a short dictionary is broadcast."""
    found = written(lookup.select(F.col(source).alias("_from"), F.col(target).alias("_to")), "lookup")
    return by_size(df.withColumn("_from", F.col(key)), found, ["_from"], "left").withColumn(out, F.coalesce("_to", key)).drop("_from", "_to")


def with_facts(spine: DataFrame, facts: Sequence[tuple[DataFrame, Sequence[str]]], keys: Sequence[str]) -> DataFrame:
    """Columns of each fact table on the spine's rows; a row without facts has them missing."""
    for table, columns in facts:
        spine = spine.join(table.select(*keys, *columns), list(keys), "left")
    return spine


def unique_lookup(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys that lead to one value only."""
    # one value where the least is the greatest: no row per distinct value is shuffled
    return df.groupBy(*keys).agg(F.max(value).alias("_most"), F.min(value).alias(value)).where(F.col("_most") == F.col(value)).drop("_most")


def resolve(rows: DataFrame, people: DataFrame, season: str, name: str, ident: str, last: Column, first: Column, overrides: DataFrame | None = None) -> DataFrame:
    """Ids of (season, name) rows by name, then last token, then first token, then override.

    Each tier needs a unique id on the people's side and, for tokens, a unique name among the rows
    that are still unmatched. ``last`` and ``first`` are over the column ``name``.
    """
    people = written(people.select(season, name, ident).where(f"{season} is not null and {name} is not null"), "people")
    box = rows.select(season, name).where(f"{season} is not null and {name} is not null").distinct()
    out = box.join(unique_lookup(people, [season, name], ident), [season, name], "left").withColumn("tier", F.when(F.col(ident).isNotNull(), "exact"))
    out = written(out, "resolved")
    for label, token in (("last", last), ("first", first)):
        side = unique_lookup(people.withColumn("_token", token), [season, "_token"], ident).withColumnRenamed(ident, "_id")
        alone = out.where(F.col(ident).isNull()).withColumn("_token", token).groupBy(season, "_token").agg(F.count("*").alias("_n"), F.min(name).alias(name)).where("_n = 1")
        found = alone.join(side, [season, "_token"]).select(season, name, "_id")
        out = out.join(found, [season, name], "left").withColumn("tier", F.when(F.col("_id").isNotNull(), label).otherwise(F.col("tier"))).withColumn(ident, F.coalesce(ident, "_id")).select(season, name, ident, "tier")
        out = written(out, "resolved")
    if overrides is not None:
        given = overrides.select(season, name, F.col(ident).alias("_id"))
        out = out.join(F.broadcast(given), [season, name], "left").withColumn("tier", F.when(F.col(ident).isNull() & F.col("_id").isNotNull(), "override").otherwise(F.col("tier"))).withColumn(ident, F.coalesce(ident, "_id")).drop("_id")
    return out


def expand_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, value: str, season: str = "season") -> DataFrame:
    """A row per season that intervals cover, the largest value of each.

    The values are settled over segments; seasons are only spelled out at the end.
    """
    segments = written(largest_over(df, keys, start, end, value), "segments")
    return windows.spelled_out(segments, [*keys, value], start, end, season)


def as_of(df: DataFrame, code: str, at: Column, eras: DataFrame, until: str, value: str, out: str) -> DataFrame:
    """Value of the first era that has not ended (of equal ends the smallest); missing if all have.

    Rows and eras are merged in ranges of (code, time), so both may be of any size and a hot code is split.
    """
    return first_reaching(df, at, eras, F.col(until), F.col(value), out, {code: code})


def alternates(cells: DataFrame, fixed: str, axis: str) -> DataFrame:
    """Other values of ``axis`` for the same ``fixed``."""
    other = cells.select(fixed, F.col(axis).alias("alternate")).distinct()
    return cells.select(fixed, axis).distinct().join(other, fixed).where(F.col(axis) != F.col("alternate"))


def match_gate(df: DataFrame, matched: Column, weight: str | None, least: float, report: str, top: int = 10) -> tuple[DataFrame, float]:
    """``df`` written, and its matched share of rows or of weight, taken in the pass that writes it.

    Under ``least`` it raises with the heaviest unmatched, and what was written goes. Without weight the share is 1.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    out, seen = observed(df, "gated", {"matched": F.sum(F.when(matched, w).otherwise(0.0)), "whole": F.sum(w)})
    share = seen["matched"] / seen["whole"] if seen["whole"] else 1.0
    if share < least:
        worst = out.where(~matched).groupBy(report).agg(F.sum(w).alias("weight")).orderBy(F.desc("weight"), report).limit(top).collect()
        discard(out)
        raise ValueError(f"matched {share:.4f}, under {least}: {[tuple(r) for r in worst]}")
    return out, share


def dangling(lists: DataFrame, ids: str, known: DataFrame, ident: str) -> DataFrame:
    """Listed ids that are not known."""
    return lists.select(F.explode(ids).alias(ident)).distinct().join(known.select(ident), ident, "left_anti")
