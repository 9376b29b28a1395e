"""Every stage of the pipeline on hard rows and on an empty table."""

import hashlib

import duckdb
import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, kept boolean, _key string"


def rows():
    text = max((t for t, in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' WHERE lang = 'en' AND n_chars < 3000").fetchall()), key=len)
    long = " ".join(f"{w}{i}" if i % 9 == 0 else w for i, w in enumerate(text.split() * 400))
    same = (4, text, "en", "s", len(text), "w", True, "k")
    none = (None, None, None, None, None, None, None, None)
    return [same, same, (3, text, None, None, None, None, None, None), (None, text + " end", "en", "s", 1, "w", None, "k"), (4, long, "en", "s", len(long), "w", None, "k"),
            (5, None, "en", "s", None, "w", None, "k"), (6, "", "en", "s", 0, "w", None, "k"), (7, " \n", None, "s", 2, "w", None, "k"), none, none]


@pytest.mark.parametrize("hard", [True, False])
def test_stages(spark, hard):
    docs, given = spark.createDataFrame(rows() if hard else [], SCHEMA), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        given[name] = docs.select("doc_id", "text").collect()
    tokens = corpus_pipeline.to_tokens(spark, docs, SF).collect()
    want = [hashlib.sha256((r.text or "").encode()).hexdigest() for r in given["pii"]]
    assert sorted(r.decoded_sha256 for r in tokens) == sorted(want)
    if not hard:
        assert not any(given.values())
        return
    kept = [(r.doc_id, len(r.text or "")) for r in given["near_dedup"]]
    # the copies leave the one with the smallest id; the long text has an id that another text has too, and stays whole
    assert len([x for x in kept if 0 < x[1] < 5000 and x[0] is not None]) == 1 and (3, len(rows()[2][1])) in kept
    assert (4, len(rows()[4][1])) in kept
