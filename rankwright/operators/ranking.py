"""Average-tie percentile ranks that never move all rows, or all rows of a group, into one task.

Ties are collapsed by counting distinct values. Approximate split points put the values into ordered buckets; the
running count is taken within a bucket and the counts of the buckets before it are added. The points only set
how even the buckets are, not the result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwright.functions import scalars
from rankwright.functions.normal import with_bell_curve
from rankwright.sources import written


@dataclass(frozen=True)
class Rank:
    """How a column is ranked: over all rows or within groups; ``sparse`` (zero rank, floor) puts positive values
    onto [floor, 100] and all others at the zero rank; ``curve`` (mean, sd, floor, cap) puts the rank on a bell curve."""

    column: str
    out: str
    within: tuple[str, ...] = ()
    sparse: tuple[float, float] | None = None
    curve: tuple[float, float, float, float] | None = None

    @property
    def value(self) -> Column:
        """What is ranked, missing if it is not."""
        v = F.col(self.column).cast("double")
        return F.when(v > 0, v) if self.sparse else v

    @property
    def group(self) -> Column:
        return scalars.row_text(*map(F.col, self.within)) if self.within else F.lit("")

    def scaled(self, pct: Column) -> Column:
        return self.sparse[1] + pct / 100 * (100 - self.sparse[1]) if self.sparse else pct


def positions(counts: DataFrame, buckets: int = 64) -> DataFrame:
    """(c, g, v, n, before, total) of (c, g, v, n): how many rows of a component and group are below a value, and in all.

    ``counts`` is a written table with a row per distinct component, group and value.
    """
    points = counts.groupBy("c").agg(F.percentile_approx("v", [i / buckets for i in range(1, buckets)], 1000).alias("points"))
    placed = counts.join(F.broadcast(points), "c").select("c", "g", "v", "n", F.size(F.filter("points", lambda p: p < F.col("v"))).alias("b"))
    totals = placed.groupBy("c", "g", "b").agg(F.sum("n").alias("t"))
    # a row per bucket, so at most ``buckets`` rows of a group in this window
    whole = Window.partitionBy("c", "g")
    before = F.sum("t").over(whole.orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("c", "g", "b", F.coalesce(before, F.lit(0)).alias("_lower"), F.sum("t").over(whole).alias("total"))
    running = F.sum("n").over(Window.partitionBy("c", "g", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("_run", F.coalesce(running, F.lit(0))).join(offsets, ["c", "g", "b"]).select("c", "g", "v", "n", (F.col("_lower") + F.col("_run")).alias("before"), "total")


def _pct() -> Column:
    return 100.0 * (F.col("before") + (F.col("n") + 1) / 2 - 0.5) / F.col("total")


def _of(ranks: Sequence[Rank], value) -> Column:
    """``value`` of the rank that the component number ``c`` stands for."""
    return F.element_at(F.array(*(F.lit(value(r)) for r in ranks)), F.col("c") + 1)


def percentile_ranks(df: DataFrame, ranks: Sequence[Rank], buckets: int = 64) -> DataFrame:
    """All ``ranks`` of a table in one pass over its long form. Rows are told apart by a number of their own, not by keys."""
    # the numbers hold once they are written
    base = written(df.withColumn("_row", F.monotonically_increasing_id()), "ranked")
    entries = F.array(*(F.struct(F.lit(i).alias("c"), r.group.alias("g"), r.value.alias("v")) for i, r in enumerate(ranks)))
    long = base.select("_row", F.explode(entries).alias("x")).select("_row", "x.*").where("v is not null")
    counts = written(long.groupBy("c", "g", "v").agg(F.count("*").alias("n")), "values")
    table = positions(counts, buckets).select("c", "g", "v", _pct().alias("pct"))
    if any(r.curve for r in ranks):
        of = lambda k: _of(ranks, lambda r: r.curve[k] if r.curve else 0.0)
        table = with_bell_curve(table, "pct", "_curved", of(0), of(1), of(2), of(3))
        table = table.withColumn("pct", F.when(_of(ranks, lambda r: r.curve is not None), F.col("_curved")).otherwise(F.col("pct"))).drop("_curved")
    table = written(table, "ranks")
    found = long.join(table, ["c", "g", "v"]).groupBy("_row").agg(*(F.max(F.when(F.col("c") == i, r.scaled(F.col("pct")))).alias(r.out) for i, r in enumerate(ranks)))
    out = base.drop(*(r.out for r in ranks)).join(found, "_row", "left").drop("_row")
    zeros = {r.out: F.coalesce(r.out, F.when(F.col(r.column).isNotNull(), F.lit(float(r.sparse[0])))) for r in ranks if r.sparse}
    return out.withColumns(zeros) if zeros else out


def _ranked(df: DataFrame, rank: Rank, buckets: int) -> DataFrame:
    """One rank, joined back by value. Rows that are not ranked are spread over the tasks."""
    counts = written(df.select(F.lit(0).alias("c"), rank.group.alias("g"), rank.value.alias("v")).where("v is not null").groupBy("c", "g", "v").agg(F.count("*").alias("n")), "values")
    table = positions(counts, buckets).select(F.col("g").alias("_rg"), F.col("v").alias("_rv"), F.lit(0).alias("_rs"), rank.scaled(_pct()).alias("_rx"))
    salt = F.when(rank.value.isNull(), F.pmod(F.xxhash64(*df.columns), F.lit(1024)).cast("int")).otherwise(0)
    out = df.drop(rank.out).withColumns({"_g": rank.group, "_v": rank.value, "_s": salt})
    out = out.join(table, (F.col("_g") == F.col("_rg")) & (F.col("_v") == F.col("_rv")) & (F.col("_s") == F.col("_rs")), "left")
    value = F.coalesce("_rx", F.when(F.col(rank.column).isNotNull(), F.lit(float(rank.sparse[0])))) if rank.sparse else F.col("_rx")
    return out.withColumn(rank.out, value).drop("_g", "_v", "_s", "_rg", "_rv", "_rs", "_rx")


def percentile_rank(df: DataFrame, value: str, out: str, buckets: int = 64) -> DataFrame:
    """100 * (average rank - 0.5) / N over the whole frame; missing is left out of N."""
    return _ranked(df, Rank(value, out), buckets)


def percentile_rank_within(df: DataFrame, value: str, groups: Sequence[str], out: str, buckets: int = 64) -> DataFrame:
    """The same within groups, of any size."""
    return _ranked(df, Rank(value, out, within=tuple(groups)), buckets)


def desaturated_rank(df: DataFrame, value: str, out: str, zero_rank: float, floor: float, buckets: int = 64, enabled: bool = True) -> DataFrame:
    """Positives ranked among themselves onto [floor, 100], other values get ``zero_rank``; disabled it is W1."""
    return _ranked(df, Rank(value, out, sparse=(zero_rank, floor) if enabled else None), buckets)


def quantiles(df: DataFrame, value: str, shares: Mapping[str, float], buckets: int = 64) -> DataFrame:
    """One row, the exact quantiles by linear interpolation, missing left out; null if there are no values."""
    counts = written(df.select(F.lit(0).alias("c"), F.lit("").alias("g"), F.col(value).cast("double").alias("v")).where("v is not null").groupBy("c", "g", "v").agg(F.count("*").alias("n")), "values")
    held = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col("v")))
    at = {out: F.lit(p) * (F.col("total") - 1) for out, p in shares.items()}
    found = positions(counts, buckets).agg(*(x for out, k in at.items() for x in (held(F.floor(k)).alias(f"lo_{out}"), held(F.ceil(k)).alias(f"hi_{out}"), F.max(k - F.floor(k)).alias(f"share_{out}"))))
    return found.select(*((F.col(f"lo_{out}") + (F.col(f"hi_{out}") - F.col(f"lo_{out}")) * F.col(f"share_{out}")).alias(out) for out in shares))
