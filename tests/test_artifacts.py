"""Stage artifacts: built once, published whole or not at all, swept when unused; counts taken while writing."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rankwright import plans, sources
from rankwright.operators import filters
from rankwright.sources.artifacts import Artifacts


def folders(root):
    return sorted(p.name for p in Path(root).iterdir()) if Path(root).exists() else []


def test_artifacts_are_built_once(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    store, built = Artifacts(spark, str(tmp_path / "store")), []

    def build():
        built.append(1)
        return spark.read.parquet(str(tmp_path / "in")).withColumn("x", F.col("id") * 2)

    get = lambda **params: store.get("stage", [str(tmp_path / "in")], params, build)
    assert get(k=1).agg(F.sum("x")).first()[0] == 90 and get(k=1).count() == 10 and len(built) == 1
    get(k=2)
    assert len(built) == 2
    # another input, another artifact
    spark.range(5).write.mode("append").parquet(str(tmp_path / "in"))
    assert get(k=1).count() == 15 and len(built) == 3
    assert len(folders(store.root)) == 3 and store.sweep(3600) == []
    assert len(store.sweep(0)) == 3 and folders(store.root) == []


def test_nothing_is_published_by_a_build_that_fails(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    store = Artifacts(spark, str(tmp_path / "store"))

    def gate():
        raise ValueError("gate")

    with pytest.raises(ValueError, match="gate"):
        store.get("stage", [str(tmp_path / "in")], {}, gate)
    late = lambda: spark.range(3).select(F.raise_error(F.lit("in a task")).cast("int").alias("x"))
    with pytest.raises(Exception, match="in a task"):
        store.get("stage", [str(tmp_path / "in")], {}, late)
    assert folders(store.root) == []


def test_the_first_of_two_builders_wins(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    store = Artifacts(spark, str(tmp_path / "store"))
    inner = lambda: spark.range(1).select(F.lit("first").alias("x"))

    def outer():
        store.get("stage", [str(tmp_path / "in")], {}, inner)
        return spark.range(1).select(F.lit("second").alias("x"))

    assert store.get("stage", [str(tmp_path / "in")], {}, outer).first().x == "first"
    assert len(folders(store.root)) == 1


def test_grid_queries_share_their_entries(spark):
    sf = "/root/testdata/sf0.001"
    # the shared folder may hold those of other inputs
    here = lambda: {x for x in folders(f"{sources.shared_dir(spark)}/artifacts") if x.startswith("decade_entries-")}
    Artifacts(spark).sweep(0)
    for name in ("decade_rosters", "shipped_entries", "pool_ceiling", "grid_axes"):
        plans.queries()[name](spark, sf).count()
        assert len(here()) == 1


def test_counts_are_taken_while_writing(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i) for i in range(100)], "i int, v int")
    out, counts = filters.kept(df, {"known": F.col("v").isNotNull(), "large": F.col("v") > 50})
    assert counts == {"all": 100, "known": 80, "large": 40} and out.count() == 40
    assert filters.kept(df.limit(0), {"known": F.col("v").isNotNull()})[1] == {"all": 0, "known": 0}
