"""Input columns named like the operators' working and output columns pass through, or are replaced where an output has the name."""

import pytest
from pyspark.sql import functions as F

from rankwright.llm import bpe, decontaminate, lm_score, pii, urls

WORKING = ["_text", "_key", "_row", "_back", "_at", "_n", "_items", "items", "spans", "at", "n", "row", "hash", "words", "found", "host_verdict", "_html", "src", "dst", "weight", "rank", "_raw", "_mark", "data", "answers", "block", "cue", "value", "seed", "score_", "kept", "key", "x", "base", "start", "end", "added"]
DOCS = [(1, "mail ab@cd.ef now " * 3, "en"), (2, None, None), (3, "", "en"), (1, "mail ab@cd.ef now " * 3, "en")]


def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, lang string").withColumns({c: F.lit(f"is {c}") for c in WORKING})


def bench(spark):
    return spark.createDataFrame([(1, "now mail ab cd"), (2, "other words")], "item_id long, text string")


APPLIED = {
    "decontaminate": (lambda s: decontaminate.find_passages(docs(s), bench(s)), decontaminate.OUTPUTS),
    "decontaminate, joined": (lambda s: decontaminate.find_passages(docs(s), bench(s), most_bytes=1), decontaminate.OUTPUTS),
    "lm_score": (lambda s: lm_score.score(docs(s), F.col("doc_id") == 1), ("n_tokens", "target_loss", "background_loss", "score")),
    "pii": (lambda s: pii.with_pii(docs(s)), ("pii",)),
    "pii, masked": (lambda s: pii.mask_pii(pii.with_pii(docs(s))), ("pii",)),
    "urls": (lambda s: urls.judge_urls(docs(s).withColumn("url", F.lit("http://a.net/x")).withColumn("page", F.lit("<a href='http://b.org'>")).withColumn("html", F.lit("is html")), html="page"), ("host", "path", "rule", "verdict", "trust", "distrust")),
}


@pytest.mark.parametrize("name", APPLIED)
def test_other_columns_pass_through(spark, name):
    apply, outputs = APPLIED[name]
    got = apply(spark)
    rows = got.collect()
    assert len(rows) == len(DOCS) and set(outputs) <= set(got.columns) and len(got.columns) == len(set(got.columns))
    for c in WORKING:
        assert c in outputs or (c in got.columns and {r[c] for r in rows} == {f"is {c}"}), c
    if name == "urls":
        assert {r.html for r in rows} == {"is html"} and "page" not in got.columns
    assert sorted((r.doc_id, r.lang or "") for r in rows) == sorted((d, lang or "") for d, _, lang in DOCS)


def test_encode_and_rules_keep_other_columns(spark):
    codec = bpe.default_codec(spark)
    got = bpe.encode(docs(spark), codec)
    assert all({r[c] for r in got.collect()} == {f"is {c}"} for c in WORKING)
