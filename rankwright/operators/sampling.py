"""Keyed draws that do not depend on what was drawn before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwright.operators.scan import numbered
from rankwright.sources import by_size, written


def draw_index(n: Column, *keys: Column) -> Column:
    """K1: an index in [0, n) from the first 60 bits of the MD5 of the keys; 0 if there is nothing to draw from."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", *(k.cast("string") for k in keys))), 1, 15), 16, 10).cast("long")
    return F.when(n > 0, F.pmod(drawn, n)).otherwise(0)


def boards(seeds: DataFrame, cells: DataFrame, spins: int = 6) -> DataFrame:
    """K1: (seed, spin, cell) for every seed; cells are numbered in their order, whatever their count."""
    listed = written(numbered(cells.select("cell").distinct(), [F.col("cell")], "_at"), "cells")
    n = listed.count()
    spun = seeds.select("seed", F.explode(F.sequence(F.lit(1), F.lit(spins))).alias("spin"))
    drawn = spun.withColumn("_at", draw_index(F.lit(n), F.col("seed"), F.col("spin"), F.lit("cell")).cast("long"))
    return by_size(drawn, listed, ["_at"]).select("seed", "spin", "cell")


def reroll(drawn: DataFrame, alternates: DataFrame) -> DataFrame:
    """K2: another value of an axis, drawn by seed, spin and the present cell; alternates are (cell, alternate)."""
    lists = alternates.groupBy("cell").agg(F.array_sort(F.collect_set("alternate")).alias("_others"))
    at = draw_index(F.size("_others"), F.col("seed"), F.col("spin"), F.lit("axis"), F.col("cell"))
    return drawn.join(lists, "cell", "left").withColumn("alternate", F.when(F.size("_others") > 0, F.get("_others", at.cast("int")))).drop("_others")
