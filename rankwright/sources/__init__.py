"""Sources and sinks: checked reads, parquet artifacts, JSON documents."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def require_columns(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Fail with what is missing and what is there."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name}: missing columns {missing}; present: {df.columns}")
    return df


def read_csv(spark: SparkSession, path: str, schema: StructType | str, columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV file with header and explicit schema, only the columns asked for."""
    df = spark.read.csv(path, header=True, schema=schema, enforceSchema=False)
    return df.select(*columns) if columns else df


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """S4."""
    df = spark.read.parquet(path)
    return require_columns(df, columns, path).select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, else one of our own in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="rankwright-")
        spark.conf.set("spark.checkpoint.dir", found)
        hadoop(spark, found)[0].deleteOnExit(hadoop(spark, found)[1])
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Spark's own classes."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; it goes when the application ends, whatever is left in it."""
    path = f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}"
    fs, where = hadoop(spark, path)
    if not fs.exists(where):
        fs.mkdirs(where)
        fs.deleteOnExit(where)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors. Gone when the application ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, name: str, metrics: Mapping[str, Column], then: Callable[[DataFrame], DataFrame] = lambda x: x) -> tuple[DataFrame, dict]:
    """``then(df)`` written, and ``metrics`` of ``df`` that were taken in the pass that wrote it: nothing is read twice."""
    seen = Observation()
    out = written(then(df.observe(seen, *(c.alias(k) for k, c in metrics.items()))), name)
    return out, seen.get


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        fs, file = hadoop(spark, df.inputFiles()[0])
        folder = file.getParent()
        if not re.search("-[0-9a-f]{32}$", folder.getName()):
            raise ValueError(f"{folder} was not made by written()")
        fs.delete(folder, True)


def by_size(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", most_rows: int = 100_000) -> DataFrame:
    """Join; ``small``, a written table, is broadcast only if it has few rows.

    Beyond that both sides are shuffled, and adaptive execution splits skewed keys.
    """
    return big.join(F.broadcast(small) if small.count() <= most_rows else small, list(on), how)


def save(df: DataFrame, path: str) -> DataFrame:
    """A stage's artifact, read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def optional(df: DataFrame, extra: DataFrame | None, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Join a source if there is one, else its columns as null."""
    if extra is None:
        return df.withColumns({c: F.lit(None).cast("double") for c in columns})
    return df.join(extra.select(*keys, *columns), list(keys), "left")


def write_percentiles(ecdf: DataFrame, path: str, **meta: str) -> None:
    """A score table (score, pct) as one JSON document, sorted, with its ends and ``meta``. A row per whole score, so few."""
    table = F.array_sort(F.collect_list(F.struct("score", "pct"))).alias("table")
    doc = ecdf.agg(F.min("score").alias("min"), F.max("score").alias("max"), table)
    doc.select(*(F.lit(v).alias(k) for k, v in sorted(meta.items())), "min", "max", "table").coalesce(1).write.mode("overwrite").json(path)


def read_percentiles(spark: SparkSession, path: str) -> DataFrame:
    """(score, pct) of a document of ``write_percentiles``."""
    doc = spark.read.schema("table array<struct<score:int,pct:double>>").json(path)
    return doc.select(F.explode("table").alias("x")).select("x.*")


def manifest(df: DataFrame, folder: str, *parts: str) -> DataFrame:
    """Sorted distinct asset paths."""
    return df.select(F.concat(F.lit(folder + "/"), F.concat_ws("/", *parts)).alias("path")).distinct().orderBy("path")
