"""The largest value over intervals, by the ends at which it can change and not step by step.

The ends of a key cut time into segments, numbered in their order. An interval covers a run of segments, which a few dyadic nodes make
up; a segment has one node on each level above it. The largest value of each node is kept, so that neither many intervals over one
segment nor one interval over many meets all of the other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwright.operators.scan import scan
from rankwright.sources import written


def largest_over(df: DataFrame, keys: Sequence[str], start: str, end: str, value: str) -> DataFrame:
    """(keys, start, end, value): disjoint segments that at least one interval of the key covers, and the largest value of each.

    Ends are whole numbers, both inclusive. Intervals that end before they start, or with a missing end, are left out; missing keys are
    keys; a segment whose intervals all lack a value has none. Neighbours may be of equal value.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    held = df.where(F.col(start) <= F.col(end)).select(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.col(start).cast("long").alias("_a"), (F.col(end).cast("long") + 1).alias("_b"), F.col(value).alias("_v"))
    spans = written(held.groupBy(*names, "_a", "_b").agg(F.max("_v").alias("_v")), "spans")
    cuts = spans.select(*names, F.explode(F.array("_a", "_b")).alias("_at")).distinct()
    numbered = scan(cuts, names, [F.col("_at")], sums={"_i": F.lit(1).cast("long")}, nexts={"_to": F.col("_at")})
    cuts = written(numbered.withColumn("_i", F.col("_i") - 1), "cuts")
    levels = max(0, (cuts.agg(F.max("_i")).first()[0] or 0).bit_length())

    def at(x: DataFrame, column: str, out: str) -> DataFrame:
        same = F.col(column) == F.col("_c")
        for n in names:
            same = same & F.col(n).eqNullSafe(F.col(f"_c{n}"))
        found = cuts.select(*(F.col(n).alias(f"_c{n}") for n in names), F.col("_at").alias("_c"), F.col("_i").alias(out))
        return x.join(found, same).drop("_c", *(f"_c{n}" for n in names))

    ranked = at(at(spans, "_a", "_first"), "_b", "_past")
    up = lambda x, k: F.call_function("shiftright", x, k)

    def cover(k):
        a, b = up(F.col("_first") + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k), up(F.col("_past"), k)
        node = lambda i: F.struct(k.alias("level"), i.alias("node"))
        return F.array(F.when((a < b) & (a % 2 == 1), node(a)), F.when((a < b) & (b % 2 == 1), node(b - 1)))

    every = F.sequence(F.lit(0), F.lit(levels))
    nodes = ranked.select(*names, "_v", F.explode(F.filter(F.flatten(F.transform(every, cover)), lambda x: x.isNotNull())).alias("_n"))
    tops = nodes.groupBy(*(F.col(n).alias(f"_c{n}") for n in names), F.col("_n.level").alias("_l"), F.col("_n.node").alias("_j")).agg(F.max("_v").alias("_v"))
    segments = cuts.where("_to is not null").select(*names, "_at", "_to", F.explode(F.transform(every, lambda k: F.struct(k.alias("level"), up(F.col("_i"), k).alias("node")))).alias("_n"))
    same = (F.col("_n.level") == F.col("_l")) & (F.col("_n.node") == F.col("_j"))
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"_c{n}"))
    found = segments.join(tops, same).groupBy(*names, "_at", "_to").agg(F.max("_v").alias("_v"))
    kind = df.schema[start].dataType
    return found.select(*(F.col(n).alias(k) for k, n in zip(keys, names)), F.col("_at").cast(kind).alias(start), (F.col("_to") - 1).cast(kind).alias(end), F.col("_v").alias(value))
