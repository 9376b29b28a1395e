"""Prefix scans of any size: running sums and minima, last known values, next rows, row numbers, as-of matches.

Rows are dealt into ranges of their order, which holds groups and hot groups are split over several ranges. Each range is scanned by
itself; what a range hands on (a row per range and group) is scanned over the ranges and added. No task sees more rows of a
group than one range holds, and none sees more handed-on rows than there are ranges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwright.sources import written


def scan(df: DataFrame, groups: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column] = {}, mins: Mapping[str, Column] = {}, lasts: Mapping[str, Column] = {}, nexts: Mapping[str, Column] = {}, ranges: int | None = None) -> DataFrame:  # noqa: B006
    """``df`` with columns over the rows of a group up to each one, itself included: ``sums``, ``mins`` and ``lasts`` (the last
    that is not null); ``nexts`` is of the row after it, null at the end.

    ``order`` should tell the rows of a group apart: equal rows stay in one range. Null groups are groups. ``ranges``
    defaults to the session's shuffle partitions. An empty table stays empty.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = {f"_scan_v{i}": c for i, c in enumerate([*sums.values(), *mins.values(), *lasts.values(), *nexts.values()])}
    names = iter(named)
    of = {kind: {out: next(names) for out in asked} for kind, asked in (("sum", sums), ("min", mins), ("last", lasts), ("next", nexts))}
    placed = df.withColumns(named) if named else df
    # written, so that a row's range is settled
    placed = written(placed.repartitionByRange(n, *groups, *order).withColumn("_scan_range", F.spark_partition_id()), "ranges")

    own = Window.partitionBy(*groups, "_scan_range").orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    within = {out: F.sum(v).over(upto) for out, v in of["sum"].items()} | {out: F.min(v).over(upto) for out, v in of["min"].items()} | {out: F.last(v, ignorenulls=True).over(upto) for out, v in of["last"].items()}
    # the value after a row is kept as a struct, so that null tells the end of a range from a null value
    within |= {out: F.lead(F.struct(v)).over(own) for out, v in of["next"].items()}
    local = placed.withColumns(within | {"_scan_first": F.row_number().over(own) == 1, "_scan_last": F.lead(F.lit(1)).over(own).isNull()})

    carry = {out: F.max(F.when(F.col("_scan_last"), F.col(out))) for kind in ("sum", "min", "last") for out in of[kind]}
    carry |= {out: F.max_by(F.struct(v), F.col("_scan_first")) for out, v in of["next"].items()}
    ends = local.where("_scan_first or _scan_last").groupBy(*groups, "_scan_range").agg(*(x.alias(out) for out, x in carry.items()), F.lit(1).alias("_scan_one"))
    # a row per range and group
    across = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_scan_range")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    handed = {out: F.sum(out).over(before) for out in of["sum"]} | {out: F.min(out).over(before) for out in of["min"]} | {out: F.last(out, ignorenulls=True).over(before) for out in of["last"]} | {out: F.lead(out).over(across) for out in of["next"]}
    on = [F.col(f"_scan_g{i}") for i in range(len(groups))]
    carried = ends.select(*(F.col(g).alias(f"_scan_g{i}") for i, g in enumerate(groups)), F.col("_scan_range").alias("_scan_at"), *(x.alias(f"_scan_c_{out}") for out, x in handed.items()))

    both = lambda f: lambda out: f(F.col(out), F.col(f"_scan_c_{out}"))
    joint = {
        "sum": both(lambda a, b: F.when(b.isNull(), a).otherwise(F.coalesce(a, a - a, b - b) + b)),
        "min": both(F.least),
        "last": both(F.coalesce),
        "next": lambda out: F.coalesce(out, f"_scan_c_{out}").getField(of["next"][out]),
    }
    same = reduce(lambda a, b: a & b, [F.col("_scan_range") == F.col("_scan_at"), *(F.col(g).eqNullSafe(h) for g, h in zip(groups, on))])
    # only the last row of a range looks beyond it for the next one
    done = local.join(carried, same, "left").withColumns({out: joint[kind](out) for kind in of for out in of[kind]})
    return done.drop(*named, "_scan_range", "_scan_at", "_scan_first", "_scan_last", *(f"_scan_g{i}" for i in range(len(groups))), *(f"_scan_c_{out}" for out in handed))


def numbered(df: DataFrame, order: Sequence[Column], out: str, groups: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """``df`` with consecutive row numbers from 0 in ``order``, which tells rows apart."""
    return scan(df, groups, order, sums={out: F.lit(1).cast("long")}, ranges=ranges).withColumn(out, F.col(out) - 1)


def first_reaching(rows: DataFrame, at: Column, steps: DataFrame, upto: Column, value: Column, out: str, groups: Mapping[str, str] | None = None, ranges: int | None = None) -> DataFrame:
    """``rows`` with the value of the first of ``steps`` that reaches them: the smallest ``upto`` >= ``at``, of equals the smallest ``value``; null if none does.

    ``groups`` names equal columns of rows and steps. Both sides are merged in descending order, and each row takes the last step it has
    seen; neither side is broadcast or gathered, and a hot group is split. A null ``at`` or group finds nothing; steps with a null ``upto`` are left out.
    """
    keys = list((groups or {}).items())
    kept = F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_row")
    typed = F.struct(*(F.lit(None).cast(t.dataType).alias(t.name) for t in rows.schema)).alias("_row")
    none = steps.select(F.struct(value.alias("v")).alias("_step")).schema["_step"].dataType
    mine = rows.select(*(F.col(a).alias(f"_k{i}") for i, (a, _) in enumerate(keys)), at.cast("double").alias("_v"), kept, F.lit(None).cast(none).alias("_step"), F.monotonically_increasing_id().alias("_tie"))
    known = reduce(lambda a, b: a & b, (F.col(b).isNotNull() for _, b in keys), upto.isNotNull())
    theirs = steps.where(known).select(*(F.col(b).alias(f"_k{i}") for i, (_, b) in enumerate(keys)), upto.cast("double").alias("_v"), typed, F.struct(value.alias("v")).alias("_step"), F.lit(0).cast("long").alias("_tie"))
    both = theirs.withColumn("_is_row", F.lit(False)).unionByName(mine.withColumn("_is_row", F.lit(True)))
    # of equal ends the smallest value comes last
    order = [F.desc_nulls_first("_v"), F.asc("_is_row"), F.desc_nulls_first("_step"), F.asc("_tie")]
    found = scan(both, [f"_k{i}" for i in range(len(keys))], order, lasts={"_found": F.col("_step")}, ranges=ranges).where("_is_row")
    return found.select(*(F.col("_row").getField(c).alias(c) for c in rows.columns if c != out), F.col("_found.v").alias(out))
