"""The training-data operators against brute force on small tables with hard rows."""

import collections
import glob
import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rankwright.llm import bpe, components, decontaminate, language, lm_score, near_dedup, pii, quality, queries, suffix_dedup, urls, warc

SF = "/root/testdata/sf0.001"
HARD = [(1, "one two three four five"), (2, None), (3, ""), (4, " \n\t "), (5, "x" * 20000), (6, "a b " * 8000), (7, "é漢 'll 123  \r\n"), (8, "one two three four five"), (8, "one two three four five"), (None, "no id at all")]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(HARD, SCHEMA).withColumn("_text", F.lit("clash")).withColumn("ids", F.lit(0))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS FROM '{path}'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(f"SELECT {', '.join(sorted(got.columns))} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.select(*sorted(got.columns)).collect()), key=str) == sorted(want, key=str)


def test_warc(spark, tmp_path):
    rows = [(1, "http://a", "x" * 2000), (2, "b\r\nX: y", "x" * 2000), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "v", "short"), (7, "é", "é" * 700), (7, "é", "é" * 700), (None, "é", "é" * 700)]
    back = warc.read_archive(spark, warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "a"))).collect()
    assert collections.Counter((r.id, r.refers_to) for r in back) == collections.Counter([(1, 2), (2, None), (3, None), (4, None), (5, None), (6, None), (7, None), (7, None), (None, 7)])
    assert all(bytes(r.payload).decode() == (dict((a, c) for a, _, c in rows)[r.id] or "") and r.record.startswith(b"WARC/1.1\r\n") for r in back)


def test_bpe_equals_tiktoken(spark, hard):
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine = bpe.Codec(ranks, public_tokenizers.PATTERN)
    assert all(mine.perfect.find(t) == i for t, i in ranks.items())
    assert mine.perfect.find(b"not a token at all") is None
    rng = random.Random(5)
    for _ in range(500):
        s = "".join(rng.choice(["a", "the ", " ", "\n", "é", "漢", "1", "!!", "\t", "xyz" * rng.randint(1, 9), "\x1c", "'s"]) for _ in range(rng.randint(0, 60)))
        assert mine.encode(s) == enc.encode_ordinary(s)
    shared = bpe.default_codec(spark)
    out = bpe.decode(bpe.encode(hard, shared), shared).collect()
    assert len(out) == len(HARD)
    for r in out:
        assert enc.encode_ordinary(bytes(r.decoded).decode()) == list(r.ids)
    assert sorted((bytes(r.decoded) for r in out)) == sorted((t or "").encode() for _, t in HARD)
    assert bpe.encode(empty(spark), shared).count() == 0


def test_lm_scores_held_out(spark):
    docs = spark.createDataFrame([(i, " ".join(random.Random(i).choices("red blue green".split() if i % 2 else "one two three".split(), k=30))) for i in range(200)] + [(500, None), (501, "")], SCHEMA)
    out = {r.doc_id: r for r in lm_score.score(docs, (F.col("doc_id") % 2 == 1) & (F.col("doc_id") < 100)).collect()}
    assert max(out[i].score for i in range(101, 200, 2)) < min(out[i].score for i in range(100, 200, 2))
    assert out[500].score is None and out[501].n_tokens == 0 and len(out) == 202
    assert lm_score.score(empty(spark), F.lit(True)).count() == 0


def test_lm_scores_equal_brute_force(spark, monkeypatch):
    """Against models of all words and pairs in dictionaries, each text left out of its own; over many blocks and ranges."""
    rng = random.Random(1)
    docs = [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 5000}" if rng.random() < 0.9 else "The" for _ in range(rng.randint(1, 400)))) for i in range(220)]
    docs += [(220, "The the w1"), (220, "The the w1"), (221, docs[30][1]), (None, "w1 w2"), (222, "alone")]
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 3000)
    df = spark.createDataFrame(docs, SCHEMA).withColumn("score", F.lit("clash")).withColumn("other", F.array(F.lit("x")))
    got = lm_score.score(df, F.col("doc_id") < 40).collect()
    words, pairs = ([collections.Counter(), collections.Counter()] for _ in range(2))
    parts = lambda t: (t.lower().split(), list(zip([None, *t.lower().split()], t.lower().split())))
    is_target = lambda i: i is not None and i < 40
    for i, t in docs:
        for side in (0, 1) if is_target(i) else (1,):
            words[side].update(parts(t)[0])
            pairs[side].update(parts(t)[1])
    whole, size = [sum(c.values()) for c in words], len(words[1])
    want = collections.Counter()
    for i, t in docs:
        w, p = parts(t)
        losses = []
        for side in (0, 1):
            held = side == 1 or is_target(i)
            left = lambda c, own, key: c[key] - (own.count(key) if held else 0)  # noqa: E731, B023
            total, scale = whole[side] - held * len(w), 1.0 if side == 0 else whole[0] / whole[1]
            alone = lambda y: (left(words[side], w, y) + 0.01) / (total + 0.01 * size)  # noqa: E731, B023
            seen = lambda x: total if x is None else left(words[side], w, x)  # noqa: E731, B023
            losses.append(-sum(np.log((scale * left(pairs[side], p, (x, y)) + 50 * alone(y)) / (scale * seen(x) + 50)) for x, y in p) / len(w))
        want[i, len(w), *(round(x, 6) for x in (*losses, losses[0] - losses[1]))] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, round(r.target_loss, 6), round(r.background_loss, 6), round(r.score, 6)) for r in got) == want
    assert all(r.other == ["x"] for r in got)


def test_quality_counts(spark, texts, hard):
    for r in quality.op4_quality_rules(spark, SF).collect():
        t = texts[r.doc_id]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r.kept and r.base_failed)
    out = quality.quality(hard)
    assert out.count() == len(HARD) and not out.where("kept").count()
    assert quality.quality(empty(spark)).count() == 0


def test_quality_bands_equal_brute_force(spark, texts):
    import zstandard

    bands, packer = quality.Bands(), zstandard.ZstdCompressor(level=3)
    rng = random.Random(5)
    odd = [(1, "the same words again and again in a row " * 400), (2, " ".join(f"{rng.getrandbits(60):x}" for _ in range(900))), (3, " ".join(f"word{i}" for i in range(40)))]
    odd += [(i + 10, t) for i, t in list(texts.items())[:150]]

    def outside(raw, lines):
        limits = [x for x in lines if len(raw) >= x[0]]
        return bool(limits) and not limits[-1][1] <= len(raw) / len(packer.compress(raw)) <= limits[-1][2]

    kept = {}
    for r in quality.quality(spark.createDataFrame(odd, SCHEMA).withColumn("ratio", F.lit("clash"))).collect():
        raw = dict(odd)[r.doc_id].encode()
        chunks = [raw[a : a + 4096] for a in range(0, len(raw), 4096)]
        judged = [x for x in chunks if len(x) >= 512]
        bad = sum(outside(x, bands.chunk) for x in judged)
        kept[r.doc_id] = r.kept
        assert r.kept == (not r.base_failed and not outside(raw, bands.whole) and bad <= 0.5 * len(judged))
    assert not kept[1] and len(set(kept.values())) == 2


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("lang"), "source")
    truth = dict(duckdb.sql("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    out = language.languages(docs, spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    odd = [r for r in out if r.doc_id % 2]
    assert sum(r.language == truth[r.doc_id] for r in odd) > 0.97 * len(odd)
    assert sum(r.kept for r in out) > 0.99 * len(out)
    no_labels = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language.languages(no_labels, spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).where("kept").count() == 0


def test_language_fusion_equals_brute_force(spark):
    """Each row's own posterior is taken out of the counts of its host, domain, suffix and declaration."""
    rng, how, langs = random.Random(4), language.Fusion(), ["a", "b", "c"]
    rows = []
    for i in range(60):
        host = rng.choice(["x.d.co", "y.d.co", "z.e.org", "src", None])
        domain = ".".join(host.split(".")[-2:]) if host and "." in host else None
        suffix = domain and domain.split(".")[-1]
        rows.append((i, [rng.uniform(-9, 0) for _ in langs], -5.0 if i % 9 else None, 10 if i % 9 else 0, rng.choice(["a", "b", None]), suffix, host, domain))
    rows.append(rows[3])

    def softmax(x):
        e = np.exp(np.array(x) - max(x))
        return e / e.sum()

    own = [softmax(r[1]) if r[3] else np.zeros(3) for r in rows]
    sums = lambda k, value, i: sum((p for j, (r, p) in enumerate(zip(rows, own)) if r[k] == value and j != i), np.zeros(3))
    want = []
    for i, r in enumerate(rows):
        world = sum((p for j, p in enumerate(own) if j != i), np.ones(3))
        prior = world / world.sum()
        for k in (7, 6):
            if r[k] is not None:
                c = sums(k, r[k], i)
                prior = (c + how.host_weight * prior) / (c.sum() + how.host_weight)
        logs = np.array(r[1]) + np.log(prior)
        for k in (4, 5):
            if r[k] is not None:
                values = {x[k] for x in rows if x[3] and x[k] is not None}
                total = sum((p for j, (x, p) in enumerate(zip(rows, own)) if x[k] is not None and j != i), np.zeros(3))
                logs += np.log((sums(k, r[k], i) + how.evidence_weight) / (total + how.evidence_weight * (len(values) + 1)))
        post = softmax(logs)
        want.append((i if i < 60 else 3, langs[int(post.argmax())] if r[3] else None, round(float(post.max()), 7) if r[3] else None))
    scored = spark.createDataFrame(rows, "doc_id long, loglik array<double>, fit double, n_features long, declared string, suffix string, host string, domain string")
    got = [(r.doc_id, r.language, r.posterior and round(r.posterior, 7)) for r in language.identify(scored, langs).collect()]
    close = lambda x, y: x[:2] == y[:2] and (x[2] == y[2] or abs(x[2] - y[2]) < 1e-6)
    assert len(got) == 61 and all(map(close, sorted(got, key=str), sorted(want, key=str)))
    assert language.identify(scored.limit(0), langs).count() == 0


def test_language_of_hard_tables(spark):
    """Nulls, empty and repeated rows, clashing columns, and empty tables of either kind."""
    pages = spark.createDataFrame([(1, "http://a.b.c/de/1", '<html lang="de">'), (2, None, None), (None, "http://a.b.c/1", "")], "page_id long, url string, html string")
    docs = spark.createDataFrame([(i, t, "en" if i else None, None, "x") for i, t in HARD], "doc_id long, text string, lang string, source string, host string")
    got = language.languages(docs, pages).collect()
    assert len(got) == len(HARD)
    assert {r.doc_id: r.language for r in got} == {i: "en" if t and t.strip() else None for i, t in HARD}
    assert language.languages(docs.limit(0), pages).count() == 0
    assert language.languages(docs, pages.limit(0)).count() == len(HARD)


def test_decontamination(spark, texts, hard):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
    found = collections.defaultdict(set)
    for i, t in duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall():
        w = fold(t)
        for j in range(max(0, len(w) - 9) if len(w) >= 10 else bool(w)):
            found[tuple(w[j : j + 10])].add(str(i))
    for r in decontaminate.op6_decontamination(spark, SF).collect():
        w, hit, items = fold(texts[r.doc_id]), set(), set()
        for n in {len(k) for k in found}:
            for i in range(len(w) - n + 1):
                if got := found.get(tuple(w[i : i + n])):
                    items |= got
                    hit |= set(range(i, i + n))
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
    bench = spark.createDataFrame([(1, "One two, THREE"), (2, None), (None, "four five"), (3, "a b a b a b a b a b a b")], "item_id long, text string")
    marked = decontaminate.find_passages(hard, bench)
    assert marked.where("size(hit_items) > 0").count() == 4
    joined = decontaminate.find_passages(hard, bench, most_bytes=80)
    assert sorted(map(tuple, joined.collect()), key=str) == sorted(map(tuple, marked.collect()), key=str)
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    one, many = (decontaminate.find_passages(docs, items, most_bytes=n).select("doc_id", "n_words", "hit_words", "hit_items") for n in (8 << 20, 0))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    cut = {r.doc_id: r.text for r in decontaminate.cut_passages(marked).collect()}
    assert cut[1] == " four five" and cut[2] is None and cut[6].strip() == ""
    for n in (8 << 20, 0):
        none = decontaminate.find_passages(empty(spark), bench, most_bytes=n)
        assert none.count() == 0 and decontaminate.cut_passages(none).count() == 0
        assert decontaminate.find_passages(hard, bench.limit(0), most_bytes=n - 1).where("size(hit_items) > 0").count() == 0


def test_windows_of_a_large_benchmark_are_small():
    """8 MiB of text, the most that is broadcast, take little memory."""
    rng = np.random.default_rng(1)
    items = [(str(i), b" ".join(b"w%d" % x for x in rng.integers(0, 1 << 20, 5000))) for i in range(200)]
    windows = decontaminate.Windows(items, 10)
    held = len(windows.text) + sum(x.nbytes for parts in windows.by_size.values() for x in parts)
    assert held < 5 * sum(len(t) for _, t in items)
    words = decontaminate.words_of(b"x y " + items[7][1][: 5 * 100])
    assert windows.scan(words)[1] == {"7"}


def luhn(s):
    return sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(s))) % 10 == 0


def base(t):
    digits = lambda x: re.sub("[^0-9]", "", x)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) < 256 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m.group())) <= 15]


def test_pii(spark, texts, hard):
    for r in pii.op7_pii(spark, SF).collect():
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base(texts[r.doc_id])).encode()).hexdigest()
    rows = [(1, "a@b.c_d@e.f x@y z@1.2, 1.2.3.4.5.6.7.8 001.2.3.0255 999.1.1.1 4111 1111 1111 1111 +1 (650) 555-1234. +12 ()"), (4, "é漢 a@b.co 4111-1111-1111-1111-" * 3)]
    for r in pii.with_pii(spark.createDataFrame(rows, SCHEMA)).collect():
        assert [(s.kind, s.start, s.end) for s in r.pii] == base(r.text)
    cued = [(i, f"word key={i:02d}abcdef{'0' * 24} and key={'secret%d' % i}") for i in range(12)]
    out = pii.with_pii(spark.createDataFrame(cued, SCHEMA)).collect()
    assert all([s.kind for s in r.pii] == ["secret", "secret"] for r in out)
    masked = pii.mask_pii(pii.with_pii(spark.createDataFrame(cued, SCHEMA))).first().text
    assert masked == "word key=<SECRET> and key=<SECRET>"
    assert pii.with_pii(hard).where("size(pii) > 0").count() == 0 and pii.with_pii(hard).count() == len(HARD)


def test_pii_of_many_matches_in_one_text(spark):
    """Positions over several blocks, block ends included; time in proportion to the matches."""
    sizes = [pii.BLOCK - 1, pii.BLOCK, pii.BLOCK + 1, 2 * pii.BLOCK, 30000]
    rows = [(i, "".join(f"é{k} x{k}@mail.example.com 10.0.{k % 256}.7;" for k in range(n))) for i, n in enumerate(sizes)]
    for r in pii.with_pii(spark.createDataFrame(rows, SCHEMA)).select("text", F.filter("pii", lambda s: s["kind"] != "secret").alias("pii")).collect():
        assert [(s.kind, s.start, s.end) for s in r.pii] == base(r.text)


def test_pii_bootstrap_equals_brute_force(spark):
    """Rounds of scoring over dictionaries: cues whose known instances are enough make their other tokens known."""
    rng = random.Random(9)
    hexes = [f"{rng.getrandbits(128):032x}" for _ in range(30)]
    words = [f"tok{rng.getrandbits(40):010x}" for _ in range(40)]
    rows = [(i, f"é {rng.choice(['key', 'pass', 'note', 'id'])}={rng.choice(hexes if rng.random() < 0.5 else words)} and user: {rng.choice(words)}") for i in range(120)]
    how = pii.Bootstrap()
    edges = {}
    for _, t in rows:
        for m in re.finditer(r"(?<![A-Za-z_])([A-Za-z_]{2,24} ?[=:#] ?)([A-Za-z0-9+/_.@-]{6,})", t):
            edges[m[1].lower(), m[2]] = bool(re.fullmatch("[0-9a-f]{32,}", m[2]))
    known = {v: max(float(s) for (_, w), s in edges.items() if w == v) for _, v in edges}
    trusted = before = None
    for _ in range(how.rounds):
        held = collections.defaultdict(list)
        for c, v in edges:
            held[c].append(known[v])
        trusted = {c: round(sum(x) / len(x), 9) for c, x in held.items() if round(sum(x) / len(x), 9) >= how.least_share and sum(b >= how.least_instance for b in x) >= how.least_known}
        if trusted == before:
            break
        before = trusted
        for v in known:
            doubt = np.prod([max(1 - trusted.get(c, 0.0), 1e-6) for c, w in edges if w == v])
            known[v] = max(max(float(s) for (_, w), s in edges.items() if w == v), 1 - doubt)
    got = {r.doc_id: [(s.start, s.end) for s in r.pii] for r in pii.with_pii(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {i: [m.span(2) for m in re.finditer(r"(?<![A-Za-z_])([A-Za-z_]{2,24} ?[=:#] ?)([A-Za-z0-9+/_.@-]{6,})", t) if m[1].lower() in trusted] for i, t in rows}
    assert got == want and trusted and any(want.values())
    assert pii.with_pii(empty(spark)).count() == 0


def test_suffix_dedup(spark):
    rng = random.Random(3)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randint(90, 400))) for _ in range(6)]
    rows = [(i, "".join(rng.choice([rng.choice(parts)[rng.randint(0, 50) : rng.randint(80, 300)], "é" * rng.randint(0, 70)]) for _ in range(rng.randint(0, 6)))) for i in range(80)]
    rows += [(500, "a" * 3000), (501, "a" * 300), (502, None), (503, ""), (504, "x" * 99), (505, "x" * 99), (506, "y" * 100), (507, "y" * 100)]
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - 99):
            first.setdefault(raw[p : p + 100], (i, p))
    out = {r.doc_id: r for r in suffix_dedup.cut_repeats(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if first[raw[p : p + 100]] != (i, p):
                gone[p : p + 100] = b"\1" * 100
        assert bytes(out[i].kept) == bytes(c for c, g in zip(raw, gone) if not g)
        assert out[i].n_spans == len(re.findall(b"\1+", bytes(gone)))
    assert suffix_dedup.cut_repeats(empty(spark)).count() == 0


def test_suffix_dedup_of_repeated_and_missing_ids(spark):
    rng = random.Random(8)
    x, y, z, w = ("".join(rng.choice("abcdefgh") for _ in range(300)) for _ in range(4))
    rows = [(1, x), (None, x), (None, y), (2, z), (9, z), (9, w), (9, w), (None, None)]
    got = collections.Counter((r.doc_id, r.n_removed, bytes(r.kept).decode()) for r in suffix_dedup.cut_repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == collections.Counter([(1, 0, x), (None, 300, ""), (None, 0, y), (2, 0, z), (9, 300, ""), (9, 0, w), (9, 0, w), (None, 0, "")])


def test_near_duplicates(spark, hard):
    rng = random.Random(9)
    rows = []
    for g in range(12):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(20, 200))]
        for _ in range(rng.randint(1, 12)):
            copy = list(words)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"z{rng.randint(0, 99)}"
            rows.append((len(rows), " ".join(copy)))
    sets = [{tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for _, t in rows]
    label = list(range(len(rows)))
    for _ in range(len(rows)):
        new = [min(label[j] for j in range(len(rows)) if j == i or 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])) for i in range(len(rows))]
        if new == label:
            break
        label = new
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), near_dedup.Forest(words=4)).collect()}
    assert got == dict(enumerate(label))
    out = near_dedup.near_duplicates(hard).collect()
    assert len(out) == len(HARD) and {r.component_id for r in out if r.doc_id in (1, 8)} == {1}
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_across_a_dense_region():
    """Every candidate between components is found, none within one."""
    rng = np.random.default_rng(4)
    how = near_dedup.Forest()
    centre = rng.integers(0, 1 << 32, how.values)
    sigs = np.stack([np.where(rng.random(how.values) < rng.uniform(0.5, 1), centre, rng.integers(0, 1 << 32, how.values)) for _ in range(300)]).astype(np.uint32)
    reps, parts = np.arange(300) * 3, np.where(np.arange(300) < 250, 0, np.arange(300) % 9)
    got = [(int(a), int(b)) for x, y, _ in near_dedup._across(sigs, reps, parts, how) for a, b in zip(x, y)]
    least = how.least_agreeing * how.values
    want = {(int(reps[i]), int(reps[j])) for i in range(300) for j in range(i + 1, 300) if parts[i] != parts[j] and (sigs[i] == sigs[j]).sum() >= least}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_near_duplicates_beyond_neighbours_and_hubs(spark):
    """With hardly any neighbours, the search across components alone finds the links."""
    rng = random.Random(2)
    rows = []
    for g in range(3):
        words = [f"w{rng.randint(0, 900)}" for _ in range(120)]
        for k in range(60):
            copy = list(words)
            for at in rng.sample(range(120), rng.randint(0, 5)):
                copy[at] = f"z{g}-{k}-{at}"
            rows.append((len(rows), " ".join(copy)))
    sets = [{tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for _, t in rows]
    label = list(range(len(rows)))
    while True:
        new = [min(label[j] for j in range(len(rows)) if j == i or 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])) for i in range(len(rows))]
        if new == label:
            break
        label = new
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), near_dedup.Forest(words=4, neighbours=1, pivots=1)).collect()
    assert {r.doc_id: r.component_id for r in out} == dict(enumerate(label))


def test_near_duplicates_in_a_region_of_many_parts(spark):
    """Signatures that agree throughout, as with a common template, put all classes into one large region of each tree."""
    how = near_dedup.Forest(most_rows=10)
    classes = spark.createDataFrame([(i, bytes(4 * how.values), 50) for i in range(60)], "rep long, sig binary, n_shingles long")
    sets = spark.createDataFrame([(i, np.arange(i // 2 * 1000, i // 2 * 1000 + 50, dtype=np.uint64).tobytes()) for i in range(60)], "rep long, found binary")
    parts = spark.createDataFrame([], "node long, component long")
    more = near_dedup.across(near_dedup.regions(classes, how), classes, parts, how)
    links = {tuple(r) for r in near_dedup.confirm_by_region(more, sets, how).collect()}
    assert links == {(i, i + 1) for i in range(0, 60, 2)}


def test_near_duplicate_blocks_meet_every_pair_once(spark):
    how = near_dedup.Forest(most_rows=10)
    found = spark.range(60).select((F.col("id") % 2).alias("whole"), F.col("id").alias("rep"), F.lit(1).alias("weight"))
    parts = spark.range(60).select("id", F.when(F.col("id") < 30, 0).otherwise(F.col("id")))
    met, held = collections.Counter(), collections.defaultdict(list)
    for r in near_dedup.blocks(found, parts, how).collect():
        held[r.region].append(r)
    for rows in held.values():
        sigs = np.zeros((len(rows), how.values), np.uint32)
        got = near_dedup._across(sigs, *(np.array([r[c] for r in rows]) for c in ("rep", "part")), how, np.array([r.side for r in rows]))
        met.update((int(a), int(b)) for x, y, _ in got for a, b in zip(x, y))
    assert met == {(a, b): 1 for a in range(60) for b in range(a + 1, 60) if a % 2 == b % 2 and b >= 30}
    assert max(map(len, held.values())) < 3 * how.most_rows


def test_near_duplicates_of_one_template(spark):
    """All pairs of 2,600 texts are similar, more than a region holds: one component."""
    words = " ".join(f"w{i}" for i in range(400))
    rows = [(i, f"{words} last{i}") for i in range(2600)]
    assert {r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()} == {0}


def test_near_duplicates_with_repeated_and_missing_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (1, a), (2, b), (None, a), (None, c), (None, c), (5, None), (5, "")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    kept = (1, 36, 1, True)
    assert got == sorted([kept, kept, kept, (2, 36, 1, False), (None, 36, 1, False), (None, 36, None, True), (None, 36, None, True), (5, 0, 5, True), (5, 0, 5, True)], key=str)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.keep_one_of_each(spark, docs, SF).collect()
    assert sorted(((r.doc_id, r.text) for r in left), key=str) == sorted([(1, a), (1, b), (None, c), (5, "")], key=str) or sorted(((r.doc_id, r.text or "") for r in left), key=str) == sorted([(1, a), (1, b), (None, c), (5, "")], key=str)


@pytest.mark.parametrize("edges", [[], [(3, 3)], [(i, i + 1) for i in range(60)], [(100, i) for i in range(60)], [(i, 99 - i) for i in range(50)] + [(0, 1)]])
def test_connected(spark, edges):
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()} == label


def test_url_verdicts(spark):
    rows = [(1, "https://Good.org/fr/x?q", None), (2, "http://a.example.net/en/1", ""), (3, "http://b.net/x", '<a href="//c.com/z">'), (4, "http://c.com/y", '<a href="http://b.net/">'), (5, None, None), (6, "nothing", None), (7, "http://x.example.com/de/#f", None), (8, "http://far.io/", None)]
    out = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (out[1].host, out[1].path, out[1].rule, out[1].verdict) == ("good.org", "/fr/x", "org/fr/", "allow")
    assert [out[i].rule for i in range(2, 9)] == ["example.net/en/", "net/", None, None, None, "example.com/de/", None]
    assert [out[i].verdict for i in range(2, 9)] == ["allow", "block", "block", "allow", "allow", "block", "allow"]


def test_url_ranks_equal_brute_force(spark):
    """Trust and distrust of all hosts against ten rounds over dictionaries."""
    rng = random.Random(6)
    hosts = [f"h{i}.d{i % 4}.org" for i in range(12)] + ["d1.org", "b.net", "c.net", "lone.io"]
    rows = [(i, f"http://{rng.choice(hosts)}/{rng.choice(['fr', 'de', 'x'])}/{i}", "".join(f'<a href="//{rng.choice(hosts)}/">' for _ in range(rng.randint(0, 3)))) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("trust", F.lit("clash"))
    edges, good, bad = collections.Counter(), collections.Counter(), collections.Counter()
    every = set()
    for _, url, html in rows:
        host, path = re.match(r"http://([^/]+)(.*)", url).groups()
        out = re.findall(r'href="//([^/]+)/', html)
        every |= {host, *out}
        for dst in out:
            if dst != host:
                edges[host, dst] += 1
        if host.endswith(".net"):
            bad[host] += 1
        elif host.endswith("org") and path.startswith("/fr/"):
            good[host] += 1
    for low in {x for h in every for x in ([h] if h.count(".") < 2 else [h, h.split(".", 1)[1]])}:
        if low.count(".") >= 2:
            edges[low, low.split(".", 1)[1]] += 1
            edges[low.split(".", 1)[1], low] += 1

    def ranks(links, seeds):
        total, whole = collections.Counter(), sum(seeds.values())
        for (a, _), w in links.items():
            total[a] += w
        base = {h: 0.15 * n / whole for h, n in seeds.items()}
        rank = dict(base)
        for _ in range(10):
            new = collections.Counter(base)
            for (a, b), w in links.items():
                new[b] += 0.85 * rank.get(a, 0.0) * w / total[a]
            rank = new
        return rank

    trust, distrust = ranks(edges, good), ranks({(b, a): w for (a, b), w in edges.items()}, bad)
    for r in urls.judge_urls(pages).collect():
        assert r.trust == pytest.approx(trust.get(r.host, 0.0)) and r.distrust == pytest.approx(distrust.get(r.host, 0.0))
        assert r.verdict == (dict((h + p, v) for v, h, p in urls.RULES)[r.rule] if r.rule else "block" if distrust.get(r.host, 0.0) > trust.get(r.host, 0.0) * (1 + 1e-9) else "allow")
    assert urls.judge_urls(pages.limit(0)).count() == 0 and urls.judge_urls(pages.union(pages)).count() == 120


def test_url_verdicts_of_tiny_masses(spark):
    rows = [(1, "http://b.net/x", None), (2, "http://c.com/y", '<a href="http://b.net/">'), (3, "http://d.com/", '<a href="//c.com/">'), (4, "http://far.io/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for damping in (0.85, 1e-7):
        assert {r.page_id: r.verdict for r in urls.judge_urls(pages, damping=damping).collect()} == {1: "block", 2: "block", 3: "block", 4: "allow"}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    assert 0.8 * n < docs.count() < n
    assert not near_dedup.near_duplicates(docs).where("not kept").count()
    assert not decontaminate.find_passages(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("size(hit_items) > 0").count()
    tokens = corpus_pipeline.to_tokens(spark, docs, SF)
    want = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in docs.collect()}
    assert {r.doc_id: r.decoded_sha256 for r in tokens.collect()} == want
