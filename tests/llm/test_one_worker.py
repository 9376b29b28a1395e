"""A task of the pipeline, or of op2, holds one Python worker: two in a row would each load what the step broadcasts."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from rankwright.llm import bpe, decontaminate

SF = "/root/testdata/sf0.001"
ROWS = [(1, "One two, three four", 0), (2, None, 0), (3, "", 0), (4, "a b " * 8000, 0), (4, "é漢 'll one two  three\r\n", 0), (None, "no id at all", 0)]
SCHEMA = "doc_id long, text string, ids int"


def nodes(df):
    return df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("stage", [corpus_pipeline.cut_benchmark, corpus_pipeline.to_tokens])
def test_stage_has_one_python_node(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert nodes(stage(spark, docs, SF)) == 1


def test_op2_has_one_python_node(spark):
    assert nodes(bpe.op2_byte_bpe(spark, SF)) == 1


@pytest.mark.parametrize("rows", [ROWS, []])
def test_encode_decode(spark, rows):
    docs, shared = spark.createDataFrame(rows, SCHEMA), bpe.default_codec(spark)
    one, two = bpe.encode_decode(docs, shared), bpe.decode(bpe.encode(docs, shared), shared)
    assert one.dtypes == two.dtypes and sorted_rows(one) == sorted_rows(two)


@pytest.mark.parametrize("most_bytes", [8 << 20, 0])
@pytest.mark.parametrize("rows", [ROWS, []])
def test_cut_with_the_search(spark, rows, most_bytes):
    docs = spark.createDataFrame(rows, SCHEMA)
    bench = spark.createDataFrame([("x", "ONE two three"), ("y", "a b a b a b a b a b a b")], "item_id string, text string")
    one = decontaminate.find_passages(docs, bench, most_bytes=most_bytes, cut=True)
    two = decontaminate.cut_passages(decontaminate.find_passages(docs, bench, most_bytes=most_bytes))
    assert one.dtypes == two.dtypes and sorted_rows(one) == sorted_rows(two)
    if rows:
        assert {r.text for r in one.collect()} == {" four", None, "", " ", "é漢 'll \r\n", "no id at all"}


def test_decoding_holds_the_ids_of_one_row():
    codec = bpe.Codec({bytes([i]): i for i in range(256)} | {b"ab%d" % i: 256 + i for i in range(2000)}, ".")
    flat = np.arange(1 << 20, dtype=np.int32) % 2000 + 256
    ids = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, 1 << 10, dtype=np.int32), flat)
    tracemalloc.start()
    out = bpe._decoded(ids, codec)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out[0].as_py() == b"".join(b"ab%d" % i for i in range(1 << 10)) and len(out) == 1 << 10
    assert peak < 8 << 20
