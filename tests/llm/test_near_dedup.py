"""Near-duplicates in regions of similar texts, of which only some are linked."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pytest

from rankwright.llm import near_dedup

WORDS = [f"w{i}" for i in range(300)]


def template(n: int, least: int, most: int) -> list[tuple[int, str]]:
    """Texts of one template with some words of their own."""
    rng = random.Random(n)
    out = []
    for k in range(n):
        words = list(WORDS)
        for at in rng.sample(range(len(words)), rng.randint(least, most)):
            words[at] = f"z{k}-{at}"
        out.append((k, " ".join(words)))
    return out


def exact(rows: list[tuple[int, str]], how: near_dedup.Forest) -> dict[int, int]:
    """Components by comparing all pairs."""
    sets = [set(near_dedup.shingles(x.encode(), how.words).tolist()) for _, x in rows]
    linked = np.zeros((len(rows), len(rows)), bool)
    for i, p in enumerate(sets):
        for j, q in enumerate(sets):
            both = len(p & q)
            linked[i, j] = 100 * both >= how.percent * (len(p) + len(q) - both)
    label = np.arange(len(rows))
    while True:
        new = np.where(linked, label[None, :], len(rows)).min(axis=1)
        if (new == label).all():
            return {rows[i][0]: rows[x][0] for i, x in enumerate(label)}
        label = new


@pytest.mark.parametrize(("least", "most", "rows"), [(8, 8, 4000), (3, 9, 4000), (3, 9, 120)])
def test_one_template_with_and_without_links(spark, least, most, rows):
    """Many pairs agree in enough values, few or none are linked; in one block, and in many."""
    how = near_dedup.Forest(words=4, most_rows=rows)
    docs = template(300, least, most)
    want = exact(docs, how)
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), how).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) > 50


def test_values_in_common():
    rng = np.random.default_rng(5)
    # frequent, middling and rare values, values of one row, and an empty set
    pools = [np.arange(20), np.arange(100, 400), np.arange(1000, 90000)]
    sets = [np.unique(np.concatenate([rng.choice(p, n).astype(np.uint64) for p, n in zip(pools, (15, 20, 30))])) for _ in range(90)] + [np.empty(0, np.uint64)]
    got = near_dedup.Common(sets, columns=7).counts(np.arange(len(sets)))
    want = np.array([[len(np.intersect1d(p, q)) for q in sets] for p in sets])
    np.fill_diagonal(got, 0)
    np.fill_diagonal(want, 0)
    assert got.tolist() == want.tolist()


def test_pairs_count_in_their_first_tree_only(spark):
    """Over all trees every candidate is met, in one block."""
    how = near_dedup.Forest(words=4, most_rows=40)
    docs = spark.createDataFrame(template(200, 5, 9), "doc_id long, text string")
    classes = near_dedup.sign(docs, how).select(near_dedup.F.col("doc_id").alias("rep"), "sig", "n_shingles")
    found = near_dedup.written(near_dedup.regions(classes, how), "found")
    parts = spark.createDataFrame([], "node long, component long")
    more = near_dedup.across(found, classes, parts, how).collect()
    met = []
    for region in {r.region for r in more}:
        rows = [r for r in more if r.region == region]
        sigs = np.stack([np.frombuffer(r.sig, ">u4").astype(np.uint32) for r in rows])
        reps, part, side, size, homes = (np.array([r[c] for r in rows]) for c in ("rep", "part", "side", "n_shingles", "homes"))
        met += [tuple(sorted((int(reps[i]), int(reps[j])))) for x, y, _ in near_dedup._pairs(sigs, reps, part, how, side, size, homes, rows[0].whole) for i, j in zip(x, y)]
    sigs = {r.rep: np.frombuffer(r.sig, ">u4") for r in classes.collect()}
    size = {r.rep: r.n_shingles for r in classes.collect()}
    homes = {}
    for r in found.collect():
        homes.setdefault(r.whole, set()).add(r.rep)
    want = {(a, b) for h in homes.values() if len(h) > how.neighbours + 1 for a in h for b in h if a < b and (sigs[a] == sigs[b]).sum() >= how.least_agreeing * how.values and 10 * min(size[a], size[b]) >= 8 * max(size[a], size[b])}
    small = {(a, b) for h in homes.values() if len(h) <= how.neighbours + 1 for a in h for b in h}
    assert len(met) == len(set(met)) and want - small <= set(met) <= want and want


def test_candidates_of_a_block_take_little_memory():
    how, rng, n = near_dedup.Forest(), np.random.default_rng(3), 2000
    sigs = rng.integers(0, 3, (n, how.values), np.uint32)
    reps, sizes = np.arange(n), (10 * 2.0 ** (np.arange(n) % 10)).astype(np.int64)
    tracemalloc.start()
    got = {(int(a), int(b)): int(k) for i, j, agree in near_dedup._pairs(sigs, reps, reps % 500, how, None, sizes) for a, b, k in zip(i, j, agree)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    some = [(i, j) for i in range(0, n, 97) for j in range(i + 1, n) if i % 500 != j % 500 and sizes[i] == sizes[j]]
    for i, j in some:
        same = int((sigs[i] == sigs[j]).sum())
        assert ((i, j) in got or (j, i) in got) == (same >= 0.6 * how.values)
    assert peak < 30 << 20
