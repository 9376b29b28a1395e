"""PII beside the brute-force tests of test_llm.py: joined patterns, masking, plans."""

import random

import pytest
from pyspark.sql import functions as F

from rankwright.llm import pii

ROWS = [(i, f"é a{i}@b.co key={i:02d}abcdef{'0' * 24} and Key={'secret%d' % i} id: {'x%06d' % i}") for i in range(12)] + [(3, None), (4, ""), (None, "key=hidden77"), (None, "key=hidden77"), (0, "key=me@there.org")]


def spans(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.text or "", [tuple(s) for s in r.pii]) for r in df.collect())


def test_joined_patterns_equal_broadcast_ones(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    sent, joined = (spans(pii.with_pii(docs, how=pii.Bootstrap(most_patterns=n))) for n in (1000, 0))
    assert sent == joined and len(sent) == len(ROWS)
    found = {d: [t[a:b] for k, a, b in s if k == "secret"] for d, t, s in sent if "and Key" in t}
    assert all(x == [f"{d:02d}abcdef{'0' * 24}", f"secret{d}"] for d, x in found.items()) and len(found) == 12
    assert [s for d, _, s in sent if d == -1] == [[("secret", 4, 12)]] * 2


def test_texts_are_not_shuffled(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    plan = pii.with_pii(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan.replace("PythonRDD", "")


def masked(text, found):
    out, pos = "", 0
    for a, b, kind in sorted(found):
        if a < pos:
            pos = max(pos, b)
        else:
            out, pos = out + text[pos:a] + f"<{kind.upper()}>", b
    return out + text[pos:]


@pytest.mark.parametrize("n", [1, pii.BLOCK - 1, pii.BLOCK, pii.BLOCK + 1, 5 * pii.BLOCK])
def test_masking_of_overlapping_spans(spark, n):
    rng = random.Random(n)
    text = "".join(rng.choice("ab é漢😀") for _ in range(4 * n + 9))
    found = []
    for _ in range(n):
        a = rng.randrange(len(text) - 1)
        found.append((rng.choice(pii.KINDS), a, rng.randint(a + 1, min(len(text), a + rng.choice([2, 9, 300])))))
    rows = spark.createDataFrame([(text, found), (None, []), ("", [])], "text string, pii array<struct<kind:string,start:int,end:int>>")
    got = [r.text for r in pii.mask_pii(rows).collect()]
    assert got == [masked(text, [(a, b, k) for k, a, b in found]), None, ""]


def test_masking_grows_with_the_spans(spark):
    text = "x@y.zz " * 20000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.mask_pii(pii.with_pii(docs)).select(F.sha2("text", 256).alias("h")).first().h == spark.sql("select sha2(repeat('<EMAIL> ', 20000), 256) as h").first().h
