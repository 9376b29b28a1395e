"""Nearest profiles through cells of a space partition, exact.

The pool's distinct profiles are dealt into cells by median cuts, fitted on a bounded sample; every profile is in one. A query first
looks into the cell whose box is nearest, which gives a distance to beat, then into those cells whose boxes are nearer than that.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwright.sources import written

#: What rounding to nine digits can hide.
SLACK = 2e-9


@dataclass(frozen=True)
class Cells:
    """Profiles per cell, most cells (their boxes are broadcast: 16 bytes a dimension each), and the sample that sets the cuts."""

    cell_rows: int = 128
    most_cells: int = 4096
    sample_rows: int = 32_768


class Cuts:
    """Nested median cuts as arrays: a node is a cut (dim, at, below, above) or, where dim is -1, the cell ``below``."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.dim, self.at, self.below, self.above, self.cells = [], [], [], [], 0
        self._grow(sample, cells)
        self.dim, self.at, self.below, self.above = (np.array(x) for x in (self.dim, self.at, self.below, self.above))

    def _grow(self, rows: np.ndarray, cells: int) -> int:
        me = len(self.dim)
        for x, v in ((self.dim, -1), (self.at, 0.0), (self.below, 0), (self.above, 0)):
            x.append(v)
        d = int(np.ptp(rows, axis=0).argmax()) if cells > 1 and len(rows) > 1 and rows.shape[1] else -1
        cut = float(np.median(rows[:, d])) if d >= 0 else 0.0
        left = rows[:, d] < cut if d >= 0 else None
        if d < 0 or not left.any() or left.all():
            self.below[me] = self.cells
            self.cells += 1
            return me
        self.dim[me], self.at[me] = d, cut
        self.below[me] = self._grow(rows[left], cells // 2)
        self.above[me] = self._grow(rows[~left], cells - cells // 2)
        return me

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while (live := np.flatnonzero(self.dim[at] >= 0)).size:
            node = at[live]
            low = x[live, self.dim[node]] < self.at[node]
            at[live] = np.where(low, self.below[node], self.above[node])
        return self.below[at]


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _gap(q: Column, p: Column) -> Column:
    return F.round(F.aggregate(F.zip_with(q, p, lambda a, b: (0.25 + F.greatest(a, F.lit(0.0))) * (a - b) * (a - b)), F.lit(0.0), lambda x, y: x + y), 9)


def nearest(queries: DataFrame, pool: DataFrame, ident: str, dims: Sequence[str], out: str = "match", how: Cells = Cells()) -> DataFrame:
    """(query_id, match, distance, percent): the pool row of another id at the least weighted distance of each query row.

    Values are z-scored over the pool (population deviation, 0 counts as 1); a dimension weighs 0.25 plus the query's z above 0; distances
    are rounded to nine digits and of equals the smallest id wins. ``percent`` is 100 less the mean distance of the values themselves,
    rounded half up, from 0 to 100. Rows without an id or with a missing value take no part; a query that nothing else can match gives no row; equal
    queries give a row each.
    """
    width, spark = len(dims), pool.sparkSession
    whole = lambda df: df.where(" and ".join(f"`{c}` is not null and not isnan(cast(`{c}` as double))" for c in dims) + f" and `{ident}` is not null").select(F.col(ident).alias("id"), F.array(*(F.col(d).cast("double") for d in dims)).alias("raw"))
    held = written(whole(pool), "pool")
    # of equal profiles only the two smallest ids can be an answer: one of them is another than the query's
    at = [F.get("raw", F.lit(i)) for i in range(width)]
    sd = lambda x: F.when(F.stddev_pop(x) == 0, 1.0).otherwise(F.stddev_pop(x))
    stats = held.agg(*(F.avg(x).alias(f"m{i}") for i, x in enumerate(at)), *(sd(x).alias(f"s{i}") for i, x in enumerate(at))).first()
    z = F.array(*((x - F.lit(stats[f"m{i}"])) / F.lit(stats[f"s{i}"]) for i, x in enumerate(at)))
    first = held.groupBy("raw").agg(F.min("id").alias("id"), F.max("id").alias("top"))
    more = first.where("top > id").select(F.col("raw").alias("_raw"), F.col("id").alias("_id"))
    second = held.join(more, (F.col("raw") == F.col("_raw")) & (F.col("id") > F.col("_id"))).groupBy("raw").agg(F.min("id").alias("id"))
    both = first.select("raw", "id").unionByName(second)
    classes = written(both.groupBy("raw").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("raw", "ids", z.alias("z")), "profiles")
    n = classes.count()
    asked = whole(queries).select("id", "raw", z.alias("z"))

    sample = classes.orderBy(F.xxhash64("raw"), "raw").limit(how.sample_rows).select("z").toArrow()
    points = _rows(sample["z"].combine_chunks(), width) if n else np.empty((0, width))
    cuts = spark.sparkContext.broadcast(Cuts(points, min(how.most_cells, -(-n // how.cell_rows))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cuts.value.cell_of(_rows(batch.column("z"), width)))], ["raw", "ids", "z", "cell"])

    id_type = classes.schema["ids"].dataType.elementType.simpleString()
    placed = written(classes.mapInArrow(place, f"raw array<double>, ids array<{id_type}>, z array<double>, cell long"), "cells")
    # a row per cell, at most ``most_cells``
    ends = placed.groupBy("cell").agg(*(f(F.get("z", F.lit(i))).alias(f"{name}{i}") for name, f in (("lo", F.min), ("hi", F.max)) for i in range(width))).orderBy("cell").toArrow()
    box = [np.stack([ends[f"{name}{i}"].to_numpy() for i in range(width)], axis=1) if n else np.empty((0, width)) for name in ("lo", "hi")]
    boxes = spark.sparkContext.broadcast((ends["cell"].to_numpy(), *box))

    def bounds(q: np.ndarray) -> np.ndarray:
        """Least distance of each query to each box."""
        _, lo, hi = boxes.value
        weight, out = 0.25 + np.maximum(q, 0.0), np.zeros((len(q), len(lo)))
        for i in range(width):
            off = np.maximum(np.maximum(lo[None, :, i] - q[:, None, i], q[:, None, i] - hi[None, :, i]), 0.0)
            out += weight[:, None, i] * off * off
        return out

    def blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 22) // max(1, len(boxes.value[0])))
        return (batch.slice(a, step) for a in range(0, batch.num_rows, step))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in blocks(batch) if len(boxes.value[0]) else ():
                cell = boxes.value[0][bounds(_rows(some.column("z"), width)).argmin(axis=1)]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cell)], ["id", "raw", "z", "row", "cell"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in blocks(batch):
                least = bounds(_rows(some.column("z"), width))
                beat = some.column("beat").to_numpy(zero_copy_only=False)
                near = ~(least > beat[:, None] + SLACK) & (boxes.value[0][None, :] != some.column("cell").to_numpy()[:, None])
                row, k = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([*(some.column(c).take(pa.array(row)) for c in ("id", "raw", "z", "row")), pa.array(boxes.value[0][k])], ["id", "raw", "z", "row", "cell"])

    p = placed.select(F.col("raw").alias("p_raw"), "ids", F.col("z").alias("p_z"), "cell")
    off = F.aggregate(F.zip_with("raw", "p_raw", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda x, y: x + y) / width
    other = F.get(F.filter("ids", lambda x: x != F.col("id")), F.lit(0))
    best = F.min(F.struct(_gap(F.col("z"), F.col("p_z")).alias("distance"), other.alias("match"), off.alias("off"))).alias("best")
    search = lambda routed: routed.join(p, "cell").where(other.isNotNull()).groupBy("row").agg(best)

    schema = f"id {id_type}, raw array<double>, z array<double>, row long, cell long"
    routed = written(asked.withColumn("row", F.monotonically_increasing_id()).select("id", "raw", "z", "row").mapInArrow(home, schema), "home")
    near = written(search(routed), "near")
    # a cell that holds the query alone beats nothing, so all are looked into
    more = routed.join(near.select("row", F.col("best.distance").alias("beat")), "row", "left")
    far = search(more.select("id", "raw", "z", "row", "cell", F.coalesce("beat", F.lit(float("inf"))).alias("beat")).mapInArrow(others, schema))
    final = near.unionByName(far).groupBy("row").agg(F.min("best").alias("best"))
    percent = F.greatest(F.least(F.floor(F.lit(100.5) - F.round("best.off", 9)), F.lit(100)), F.lit(0)).cast("int")
    return routed.join(final, "row").select(F.col("id").alias("query_id"), F.col("best.match").alias(out), F.col("best.distance").alias("distance"), percent.alias("percent"))
