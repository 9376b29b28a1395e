"""Nested JSON documents of any size, as fragments in order.

A document is a folder of text fragments; one after the other, by name, they are one JSON text with a line feed between rows. No task
holds more than its own rows. ``joined`` streams the fragments into one file.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rankwright.operators.scan import scan
from rankwright.sources import hadoop

HEAD, PLAYERS, BETWEEN, ROSTERS, TAIL = range(5)


def write_fragments(players: DataFrame, rosters: DataFrame, ceiling: DataFrame, path: str, **meta: str) -> None:
    """Write the document of meta, players, rosters (cell, ids) and ceiling (one row), to the folder ``path``.

    Players and cells are in the order of their texts; fields without a value are left out, as are null cells. Equal rows stay. Tables may be empty.
    """
    spark = players.sparkSession
    object_of = lambda df: F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))
    row = lambda df, section, text: df.select(F.lit(section).alias("section"), text.alias("text"))
    fixed = lambda section, text: row(spark.range(1), section, F.lit(text))
    entry = F.to_json(F.map_from_arrays(F.array(F.col("cell").cast("string")), F.array("ids")))
    end = row(ceiling.limit(1), TAIL, F.concat(F.lit('},"ceiling":'), object_of(ceiling), F.lit("}")))
    end = end.unionByName(fixed(TAIL, '},"ceiling":{}}')).limit(1) if ceiling.isEmpty() else end
    parts = [
        fixed(HEAD, '{"meta":' + json.dumps(dict(sorted(meta.items())), separators=(",", ":"), ensure_ascii=False) + ',"players":['),
        row(players, PLAYERS, object_of(players)),
        fixed(BETWEEN, '],"rosters":{'),
        row(rosters.where("cell is not null"), ROSTERS, _inside(entry)),
        end,
    ]
    rows = reduce(DataFrame.unionByName, parts).withColumn("tie", F.monotonically_increasing_id())
    order = [F.col("section"), F.col("text"), F.col("tie")]
    known = scan(rows, [], order, nexts={"after": F.col("section")})
    comma = F.when((F.col("after") == F.col("section")) & F.col("section").isin(PLAYERS, ROSTERS), ",").otherwise("")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = known.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt.select(F.concat("text", comma).alias("value")).write.mode("overwrite").text(path)


def _inside(text: Column) -> Column:
    """A JSON object without its braces."""
    return F.regexp_replace(F.regexp_replace(text, r"^\{", ""), r"\}$", "")


def read_players(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The players of a document of ``write_fragments``, in parallel: each is a line of its own."""
    lines = spark.read.text(path).where("value like '{%' and value not like '%['")
    return lines.select(F.from_json(F.regexp_replace("value", ",$", ""), schema).alias("x")).select("x.*")


def joined(spark: SparkSession, path: str, out: str) -> None:
    """The document as one file: its fragments are copied one after the other through a buffer of a megabyte."""
    fs, folder = hadoop(spark, path)
    target, file = hadoop(spark, out)
    parts = sorted((s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    stream = target.create(file, True)
    try:
        for part in parts:
            source = fs.open(part)
            try:
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, stream, 1 << 20, False)
            finally:
                source.close()
    finally:
        stream.close()
