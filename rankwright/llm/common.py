"""Shared folder, table access and Arrow helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwright.sources import discard, shared_dir, written  # noqa: F401

#: Most bytes of one Arrow batch that is handed to a Python worker. A worker holds several times as much (token ids as a list: 9 times),
#: and the JVM its own copy.
BATCH_BYTES = 4 << 20


def session(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches by bytes, so that very long texts do not pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(column: str = "text"):
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def map_batches(df: DataFrame, schema: str, per_batch: Callable[[pa.RecordBatch], pa.RecordBatch | list | None]) -> DataFrame:
    """``mapInArrow`` with one function per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = per_batch(batch)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def row_key(*columns: str):
    """A digest of whole rows; equal for equal rows. Nulls differ from empty strings."""
    return F.sha2(F.concat_ws("\0", *(F.coalesce(F.col(c).cast("string"), F.lit("\1")) for c in columns)), 256)


def row_ids(df: DataFrame, doc: str = "doc_id", text: str = "text") -> tuple[DataFrame, bool]:
    """``df`` with a long ``_row`` that tells documents apart and orders them by id, and whether ids repeat or are missing.

    Where ids are distinct ``_row`` is the id. Otherwise documents are rows of distinct id and text, equal rows
    share a ``_row``, and they are ordered by id (null last), then by a digest of the text.
    """
    ids = F.col(doc).cast("long")
    again = df.groupBy(ids.alias("doc")).agg(F.count("*").alias("n")).where("n > 1 or doc is null")
    if again.isEmpty():
        return df.withColumn("_row", ids), False
    keyed = df.withColumns({"_doc": ids, "_digest": F.unhex(F.md5(text_bytes(text)))})
    order = [F.col("_doc").asc_nulls_last(), F.col("_digest")]
    n = shuffle_partitions(df.sparkSession)
    rows = keyed.select("_doc", "_digest").distinct().repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    rows = written(rows, "row_ids")
    same = keyed["_doc"].eqNullSafe(rows["_doc"]) & (keyed["_digest"] == rows["_digest"])
    return keyed.join(rows, same).drop("_doc", "_digest"), True


def bitmap(places: DataFrame, bits: int) -> np.ndarray:
    """``bits`` places (a power of two), those of the column ``place`` true, eight to a byte; put together by a grouped aggregate."""
    words = places.select((F.col("place") / 32).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 32).cast("int")).alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def in_bitmap(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


def sized_join(big: DataFrame, small: DataFrame, on: str, most_rows: int = 100_000) -> DataFrame:
    """Left join; ``small`` (a written table, one row per key) is broadcast only if it has few rows.

    Beyond that a sort-merge join is planned, whose skewed partitions adaptive execution splits.
    """
    if small.count() <= most_rows:
        small = F.broadcast(small)
    return big.join(small, on, "left")


def byte_chunks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive values of a binary column as (first row, values), cut at about ``most`` bytes."""
    first, held, size = 0, [], 0
    for i, x in enumerate(column):
        held.append(x.as_py() or b"")
        size += len(held[-1])
        if size >= most:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held
