"""What grows with the tables is not dealt by keys of few values, nor summed again for each use."""

from pathlib import Path

from pyspark.sql import functions as F

from rankwright import plans, sources
from rankwright.functions import scalars
from rankwright.operators import curation, joins
from rankwright.sources.artifacts import Artifacts


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_short_dictionaries_are_broadcast(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "N").otherwise("R").alias("team"), (F.col("id") % 70 + 1945).alias("season"))
    lineage = spark.createDataFrame([("N", "A")], "code string, franchise string")
    df = curation.with_cell(rows, lineage)
    assert "BroadcastHashJoin" in plan(df) and "SortMergeJoin" not in plan(df)
    assert {r.franchise: r["count"] for r in df.groupBy("franchise").count().collect()} == {"A": 334, "R": 666}


def test_the_grid_sums_its_lines_once(spark):
    folder = Path(f"{sources.shared_dir(spark)}/artifacts")
    Artifacts(spark).sweep(0)
    df = plans.queries()["pool_ceiling"](spark, "/root/testdata/sf0.001")
    assert len([p for p in folder.iterdir() if p.name.startswith("stints-")]) == 1
    assert "lineitem" not in df._jdf.queryExecution().toString() and df.count() == 1


def test_plain_names_are_not_folded(spark):
    df = spark.createDataFrame([("Al  Bo Jr.",), ("\u00c5l B\u00f8 III",), ("\ufb01n \u212bx",), (None,)], "name string").select(scalars.normal_name(F.col("name")).alias("name"))
    # the tables of folded characters stand under a test for characters beyond ASCII
    assert "CASE WHEN RLIKE(name" in plan(df) and plan(df).index("CASE WHEN RLIKE(name") < plan(df).index("translate(")
    assert [r.name for r in df.collect()] == ["al bo", "al b", "fin ax", None]


def test_unique_ids_are_found_without_distinct_rows(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (1, "b", 1), (1, "b", 2), (1, "c", None), (1, "d", None), (1, "d", 4)], "season int, name string, id int")
    found = joins.unique_lookup(rows, ["season", "name"], "id")
    assert {(r.name, r.id) for r in found.collect()} == {("a", 1), ("d", 4)}
    assert plan(found).count("HashAggregate") == 2
