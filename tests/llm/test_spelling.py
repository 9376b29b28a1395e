"""Spelling variants against brute force: split lists, hard rows, very long words."""

import random
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from rankwright.llm import spelling
from rankwright.llm.spelling import Spelling


def edits(a, b):
    """Whether exactly one insertion, deletion or replacement makes them equal."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute(counts, ratio=2):
    near = {w: [v for v in counts if edits(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}


def rows_of(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def docs_of(spark, counts):
    return spark.createDataFrame([(i, " ".join([w] * n)) for i, (w, n) in enumerate(counts.items())], "doc_id long, text string")


@pytest.mark.parametrize("how", [Spelling(), Spelling(most_rows=3), Spelling(most_rows=2, most_chars=8, block_cells=1)])
def test_variants_equal_brute_force(spark, how):
    draw = random.Random(3)
    counts = {}
    while len(counts) < 250:
        w = "".join(draw.choice("abéÿ") for _ in range(draw.randint(5, 9)))
        counts[w] = draw.choice([3, 3, 4, 6, 7, 12, 30])
    # one hot list: words that share all but the middle
    for a in "abcdefgh":
        for b in "abcdefgh":
            counts[f"prefix{a}{b}suffix"] = draw.choice([3, 5, 9])
    assert rows_of(spelling.variants(docs_of(spark, counts), how)) == brute(counts)


def test_each_pair_is_met_once(spark):
    draw = random.Random(5)
    words = sorted({"".join(draw.choice("ab") for _ in range(draw.randint(5, 8))) for _ in range(300)})
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    for how in (Spelling(), Spelling(most_rows=4)):
        got = [(r.word, r.near) for r in spelling.near_words(df, how).collect()]
        assert len(got) == len(set(got)) and set(got) == {(a, b) for a in words for b in words if edits(a, b)}


def test_words_are_damaged_by_document(spark):
    texts = [(i, "Schöne WÖRTER straße naïve words Éclair") for i in range(200)]
    want = Counter()
    for i, t in texts:
        for run in ("schöne", "wÖrter", "straße", "naïve", "words", "Éclair"):
            h = crc32(f"{i}:{run}".encode())
            want[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    got = spelling.vocabulary(spark.createDataFrame(texts, "doc_id long, text string"), Spelling(damage=97, least_n=1))
    assert {r.word: r.n for r in got.collect()} == {w: n for w, n in want.items() if len(w) >= 5}


def test_hard_rows(spark):
    long = "x" * 50_000
    rows = [(1, None), (2, ""), (3, " \n 12 ab"), (4, f"{long} {long} {long}y {long}y {long}y {long}y"), (5, f"{long} {long}y {long}y"), (None, "apple apple"), (6, "apple appla"), (6, "apple appla"), (6, "appla × ÷÷÷÷÷")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("word", "n", "key", "mid", "form", "root")})
    got = rows_of(spelling.variants(df))
    assert got == brute({long: 3, long + "y": 6, "apple": 4, "appla": 3})
    assert spelling.variants(df.limit(0)).collect() == []
