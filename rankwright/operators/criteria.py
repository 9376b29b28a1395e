"""Batches of criteria of any size, matched through an index of predicates.

Every query is looked up by one of its criteria, the one that is expected to let through the fewest rows; the rest are verified on
what it finds. Ranges are indexed by dyadic intervals over the quantiles of their field: a range is a few nodes, a value has one
node on each level, and they meet in one at most. Words are indexed by their rarest run of up to three letters, suffixes by their last
three letters. Queries without a criterion to look up take every row.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwright.sources import by_size, written

#: Levels of the dyadic intervals, so 2 ** LEVELS buckets of a field; letters of a run.
LEVELS, LETTERS = 12, 3
_NO_LIMIT = float("inf")


def bounds(c: Column) -> tuple[Column, Column]:
    """Lowest and highest value of a range or decade."""
    lo, hi = F.coalesce(c["lo"], F.lit(-_NO_LIMIT)), F.coalesce(c["hi"], F.lit(_NO_LIMIT))
    decade = c["kind"] == "decade"
    return F.when(decade, c["lo"]).otherwise(lo), F.when(decade, c["lo"] + 9).otherwise(hi)


def met(c: Column, values: Column, name: Column, label: Column) -> Column:
    """Whether a row meets a criterion; unknown kinds are met, a null lower end of a decade is not."""
    v = F.try_element_at(values, c["field"])
    lo, hi = bounds(c)
    words = F.forall(F.split(F.lower(F.coalesce(c["text"], F.lit(""))), " "), lambda w: F.contains(name, w))
    suffix = F.coalesce(F.endswith(label, F.lower(c["text"])), F.lit(False))
    inside = F.coalesce((v >= lo) & (v <= hi), F.lit(False))
    return F.when(c["kind"].isin("range", "decade"), inside).when(c["kind"] == "words", words).when(c["kind"] == "suffix", suffix).otherwise(True)


def _runs(text: Column, most: int) -> Column:
    """Distinct runs of one to ``most`` letters."""
    of = lambda k: F.when(F.length(text) >= k, F.transform(F.sequence(F.lit(1), F.length(text) - (k - 1)), lambda i: F.substring(text, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*map(of, range(1, most + 1))))


def _points(points: Sequence[float]) -> Column:
    return F.from_json(F.lit(json.dumps(list(points))), "array<double>")


def _bucket(v: Column, points: Column) -> Column:
    """How many of the sorted points are below a value, by halving: its bucket."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(LEVELS))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(points, at + step - 1) < v, at + step).otherwise(at))


def _node(field: str, level: Column, at: Column) -> Column:
    return F.concat_ws(":", F.lit("r"), level.cast("string"), at.cast("string"), F.lit(field))


def _levels(of) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), of)


def _halved(x: Column, times: Column) -> Column:
    return F.call_function("shiftright", x, times)


def row_keys(values: dict[str, Column], name: Column, label: Column, points: dict[str, list[float]]) -> Column:
    """All keys under which a row is found."""
    of = lambda field, ends: F.transform(F.array(_bucket(values[field], _points(ends))), lambda b: _levels(lambda k: _node(field, k, _halved(b, k))))
    nodes = [of(field, ends) for field, ends in points.items()]
    found = [F.flatten(F.flatten(F.array(*nodes)))] if nodes else []
    found.append(F.transform(_runs(name, LETTERS), lambda g: F.concat(F.lit("w:"), g)))
    ends = F.transform(F.sequence(F.lit(1), F.least(F.length(label), F.lit(LETTERS))), lambda k: F.concat(F.lit("s:"), F.right(label, k)))
    found.append(F.when(F.length(label) > 0, ends).otherwise(F.array().cast("array<string>")))
    return F.concat(*found)


def range_keys(c: Column, points: dict[str, list[float]]) -> Column:
    """(key, share) of the dyadic nodes that cover a range; disjoint, so that a row meets one at most. Empty for other fields."""
    lo, hi = bounds(c)

    def nodes(field: str, first: Column, past: Column) -> Column:
        share = ((past - first) / F.lit(float(1 << LEVELS))).cast("double").alias("share")

        def level(k: Column) -> Column:
            a, b = _halved(first + F.call_function("shiftleft", F.lit(1), k) - 1, k), _halved(past, k)
            return F.array(F.when((a < b) & (a % 2 == 1), _node(field, k, a)), F.when((a < b) & (b % 2 == 1), _node(field, k, b - 1)))

        return F.transform(F.filter(F.flatten(_levels(level)), lambda x: x.isNotNull()), lambda x: F.struct(x.alias("key"), share))

    def cover(field: str, ends: list[float]) -> Column:
        # both ends are searched once
        both = F.array(F.struct(_bucket(lo, _points(ends)).alias("first"), (_bucket(hi, _points(ends)) + 1).alias("past")))
        return F.transform(both, lambda x: nodes(field, x["first"], x["past"]))[0]

    out = F.array().cast("array<struct<key:string,share:double>>")
    for field, ends in points.items():
        out = F.when((c["field"] == field) & (lo <= hi), cover(field, ends)).otherwise(out)
    return out


def matching(rows: DataFrame, ident: str, criteria: DataFrame, fields: Sequence[str], name: str | None = None, label: str | None = None, few: int = 64) -> DataFrame:
    """P10: (query_id, id) of the rows that meet all criteria of a query.

    ``criteria`` has query_id, key, kind (``range`` of a stat, rating or season; ``decade``, which starts at lo; ``words`` of the
    name; ``suffix`` of the label), field, lo, hi, text and seq; the first of each key counts, by seq. A missing value counts as 0. A query
    whose criteria are null matches every row. Both sides may be of any size; neither is matched with all of the other. Equal ``ident`` rows
    are rows of their own. Up to ``few`` queries are compared with each row as they are; the index gives the same rows.
    """
    firsts = criteria.groupBy("query_id", "key").agg(F.min(F.struct("seq", "kind", "field", "lo", "hi", "text")).alias("c"))
    queries = written(firsts.groupBy("query_id").agg(F.collect_list("c").alias("cs")), "queries")
    number = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in fields}
    text = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))) if c else F.lit("")
    values = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*number.values())) if fields else F.lit(None).cast("map<string,double>")
    held = rows.select(F.col(ident), values.alias("_values"), text(name).alias("_name"), text(label).alias("_label"))
    all_met = F.forall("cs", lambda c: met(c, F.col("_values"), F.col("_name"), F.col("_label")))
    if queries.count() <= few:
        return held.join(F.broadcast(queries), all_met).select("query_id", ident)
    held = written(held, "rows")

    # the quantiles of the fields that ranges ask for: a bounded report
    asked = [r.field for r in queries.select(F.explode("cs.field").alias("field")).distinct().where(F.col("field").isin(*fields)).collect()] if fields else []
    at = lambda f: F.try_element_at("_values", F.lit(f))
    shares = [i / (1 << LEVELS) for i in range(1, 1 << LEVELS)]
    flat = held.select(*(at(f).alias(f"q{i}") for i, f in enumerate(asked)))
    ends = flat.approxQuantile(flat.columns, shares, 0.25 / (1 << LEVELS)) if asked else []
    points = {f: sorted({x for x in found if math.isfinite(x)}) for f, found in zip(asked, ends)}
    kinds = {r.kind for r in queries.select(F.explode("cs.kind").alias("kind")).distinct().collect()}
    looked_up = lambda kind, c: F.col(c) if kind in kinds else F.lit("")
    keyed = held.withColumn("_keys", row_keys({f: at(f) for f in asked}, looked_up("words", "_name"), looked_up("suffix", "_label"), points))
    counts = None
    if kinds & {"words", "suffix"}:
        # how many rows hold each run or suffix
        runs = F.filter("_keys", lambda k: ~k.startswith("r:"))
        counts = written(keyed.select(F.explode(runs).alias("key")).groupBy("key").agg(F.count("*").alias("n")), "runs")
    total = max(1, held.count())

    # of each query the cheapest criterion: (cost, nodes or run)
    c = F.col("c")
    each = queries.select("query_id", F.posexplode("cs").alias("at", "c"))
    ranged = range_keys(c, points)
    lowered = F.lower(F.coalesce(c["text"], F.lit("")))
    words = F.filter(_runs_of_words(lowered), lambda g: g != "")
    tail = F.when(F.length(lowered) > 0, F.array(F.concat(F.lit("s:"), F.right(lowered, F.least(F.length(lowered), F.lit(LETTERS)))))).otherwise(F.array().cast("array<string>"))
    looked = F.when(c["kind"] == "words", F.transform(words, lambda g: F.concat(F.lit("w:"), g))).when((c["kind"] == "suffix") & c["text"].isNotNull(), tail).otherwise(F.array().cast("array<string>"))
    never = c["kind"].isin("range", "decade") & (F.size(ranged) == 0)
    by_range = each.where(c["kind"].isin("range", "decade")).select("query_id", "at", ranged.alias("nodes"), never.alias("never"))
    costs = by_range.select("query_id", "at", F.when(F.col("never"), 0.0).otherwise(F.get("nodes", F.lit(0))["share"]).alias("cost"), F.when(F.col("never"), F.array().cast("array<string>")).otherwise(F.col("nodes.key")).alias("keys"))
    if counts is not None:
        runs_of = each.select("query_id", "at", F.explode(looked).alias("key"))
        rarest = by_size(runs_of, counts, ["key"], "left").select("query_id", "at", (F.coalesce("n", F.lit(0)) / F.lit(float(total))).cast("double").alias("cost"), F.array("key").alias("keys"))
        costs = costs.unionByName(rarest)
    best = written(costs.groupBy("query_id").agg(F.min(F.struct("cost", "at", "keys")).alias("x")).select("query_id", F.explode_outer("x.keys").alias("_key")), "paths")

    # a query all of whose criteria hold for every row is in no path
    entries = written(best.where("_key is not null").join(queries, "query_id"), "entries")
    spread = keyed.select(ident, "_values", "_name", "_label", F.explode("_keys").alias("_key"))
    found = by_size(spread, entries, ["_key"]).where(all_met)
    free = written(queries.join(best.select("query_id"), "query_id", "left_anti"), "free")
    every = held.crossJoin(free).where(all_met)
    return found.select("query_id", ident).unionByName(every.select("query_id", ident))


def _runs_of_words(text: Column) -> Column:
    """The runs by which a list of words can be looked up: of each word all of its longest ones up to ``LETTERS``."""
    of = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - (LETTERS - 1), F.lit(1))), lambda i: F.substring(w, i, F.lit(LETTERS)))
    return F.array_distinct(F.flatten(F.transform(F.filter(F.split(text, " "), lambda w: w != ""), of)))
