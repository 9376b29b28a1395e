"""Season-grain grids and runs compared with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwright.operators import windows


def season_grid(members: DataFrame, rated: DataFrame, k: int = 12, least: int = 8) -> DataFrame:
    """(season, franchise, id, place): the best ``k`` by minutes of each cell with ``least`` rated members.

    ``members`` has season, franchise, id, minutes; ``rated`` the ids that have all ratings.
    """
    known = members.join(rated.select("id").distinct(), "id", "left_semi").withColumn("_named", F.lit(False))
    out = windows.forced_top(known, ["season", "franchise"], "_named", [F.desc_nulls_last("minutes"), F.col("id")], k, least)
    return out.select("season", "franchise", "id", "place")


def thin_cells(members: DataFrame, rated: DataFrame, least: int = 8) -> DataFrame:
    """(season, franchise, n) of the cells that have members, but too few."""
    known = members.join(rated.select("id").distinct(), "id", "left_semi")
    return known.groupBy("season", "franchise").agg(F.count("*").alias("n")).where(F.col("n") < least)


def head_to_head(one: DataFrame, other: DataFrame) -> DataFrame:
    """Slots won, lost and tied by the first run of each board, and its verdict by the totals.

    Both have board, slot, rating, a row per slot; slots that only one of them has do not count.
    """
    both = one.select("board", "slot", F.col("rating").alias("_a")).join(other.select("board", "slot", F.col("rating").alias("_b")), ["board", "slot"])
    gap = F.col("_a") - F.col("_b")
    out = both.groupBy("board").agg(F.count_if(gap > 0).alias("won"), F.count_if(gap < 0).alias("lost"), F.count_if(gap == 0).alias("tied"), F.sum(gap).alias("_gap"))
    verdict = F.when(F.col("_gap") > 0, "win").when(F.col("_gap") < 0, "loss").otherwise("tie")
    return out.select("board", "won", "lost", "tied", verdict.alias("verdict"))
