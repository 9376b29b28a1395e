"""Benchmark decontamination: find benchmark passages in training texts and cut them out.

A broadcast hash set of the benchmark's word windows is scanned along the words of each text.
Hash hits are verified word by word. A window is ``size`` consecutive words of an item; an item of
fewer words, but not none, is one window. Every word in an occurrence of a window is hit.

The set holds the items' words once, and for each window a hash and its place: at most about ten times the
text. It is broadcast if the benchmark's text is at most ``most_bytes``. A larger benchmark is a
table of windows instead: a broadcast bitmap of fixed size leaves out most windows of the texts, the others
are joined with the table. Either way the texts are read once.

Null and empty text has no words, no hits and no items. Items without words or id are ignored;
repeated items count once per distinct id. One row per input row, repeated rows included; other
columns pass through, output names replace input columns of the same name. An empty table gives an
empty table, an empty benchmark no hits.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from rankwright.llm.common import bitmap, fresh, in_bitmap, session, table, text_bytes, written

#: Places of the bitmap over the windows of a large benchmark.
BITMAP_BITS = 1 << 27
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(raw: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and all other characters beyond ASCII."""
    return raw.translate(_FOLD).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for j in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : len(hashes) - n + 1 + j]
    return out ^ (out >> np.uint64(31))


class Windows:
    """Windows of all items, by length: sorted hashes and, for each, item and place in the items' text."""

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        self.names, texts, held, at = [], [], defaultdict(list), 0
        for name, raw in items:
            words = words_of(raw)
            if not words:
                continue
            n = min(size, len(words))
            ends = np.cumsum([len(w) + 1 for w in words]) + at
            starts = np.concatenate([[at], ends[:-1]])
            held[n].append((window_hashes(word_hashes(words), n), np.full(len(words) - n + 1, len(self.names), np.int32), starts[: len(words) - n + 1], ends[n - 1 :] - 1))
            self.names.append(name)
            texts.append(b" ".join(words) + b" ")
            at += len(texts[-1])
        self.text = b"".join(texts)
        self.by_size = {}
        for n, parts in sorted(held.items()):
            hashes, item, start, end = map(np.concatenate, zip(*parts))
            order = np.argsort(hashes, kind="stable")
            self.by_size[n] = hashes[order], item[order], start[order].astype(np.int32), end[order].astype(np.int32)
        self._maps, self._met = None, {}

    def __getstate__(self):
        return self.__dict__ | {"_maps": None, "_met": {}}

    def _load(self) -> None:
        self._maps = {}
        for n, (hashes, *_) in self.by_size.items():
            bits = max(16, len(hashes).bit_length() + 4)
            shift = np.uint64(64 - bits)
            found = np.zeros(1 << bits, bool)
            found[hashes >> shift] = True
            self._maps[n] = found, shift

    def _items(self, n: int, h: np.uint64, key: bytes) -> list[str]:
        """The items that hold the window ``key``; each window that is hit is looked up once in a worker."""
        got = self._met.get(key)
        if got is None:
            hashes, item, start, end = self.by_size[n]
            a, b = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            got = self._met[key] = sorted({self.names[item[e]] for e in range(a, b) if self.text[start[e] : end[e]] == key})
        return got

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words (merged, end exclusive) and the items found."""
        if self._maps is None:
            self._load()
        hits: list[tuple[int, int]] = []
        items: set[str] = set()
        if not words or not self._maps:
            return hits, items
        hashes = word_hashes(words)
        for n, (found, shift) in self._maps.items():
            mixed = window_hashes(hashes, n)
            at = np.flatnonzero(found[mixed >> shift])
            if not len(at):
                continue
            known = self.by_size[n][0]
            places = np.minimum(np.searchsorted(known, mixed[at]), len(known) - 1)
            for i in at[known[places] == mixed[at]].tolist():
                if got := self._items(n, mixed[i], b" ".join(words[i : i + n])):
                    items.update(got)
                    hits.append((i, i + n))
        return merged(hits), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _cut(columns: list[pa.Array], at: int, hits: Iterable[list[tuple[int, int]]]) -> list[pa.Array]:
    """``columns`` with the spans of words cut out of the texts in column ``at``."""
    out = []
    for x, spans in zip(columns[at], hits):
        raw = x.as_py()
        if raw is not None and spans:
            raw = raw.encode()
            places = [m.span() for m in _WORD.finditer(raw)]
            kept, last = [], 0
            for a, b in spans:
                kept.append(raw[last : places[a][0]])
                last = places[b - 1][1]
            raw = b"".join([*kept, raw[last:]]).decode()
        out.append(raw)
    return [*columns[:at], pa.array(out, columns[at].type), *columns[at + 1 :]]


def _outputs(columns: list[pa.Array], names: list[str], counts: list[int], spans: list[list[tuple[int, int]]], items: list) -> pa.RecordBatch:
    made = [pa.array(counts, pa.int64()), pa.array([[y for pair in x for y in pair] for x in spans], pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays([*columns, *made], [*names, *OUTPUTS])


OUTPUTS = {"n_words": "long", "hit_words": "array<long>", "hit_items": "array<string>"}


def _scanned(df: DataFrame, items: list[tuple[str, bytes]], text: str, size: int, schema: T.StructType, cut: bool) -> DataFrame:
    """The texts against a broadcast set of all windows."""
    shared = df.sparkSession.sparkContext.broadcast(Windows(items, size))
    at, names = df.columns.index(text), df.columns

    def run(batches):
        for batch in batches:
            counts, hits, items = [], [], []
            for x in batch.column(at):
                words = words_of((x.as_py() or "").encode())
                spans, some = shared.value.scan(words)
                counts.append(len(words))
                hits.append(spans)
                items.append(some)
            columns = _cut(batch.columns, at, hits) if cut else batch.columns
            yield _outputs(columns, names, counts, hits, items)

    return df.mapInArrow(run, schema)


def _windows(items: DataFrame, size: int) -> DataFrame:
    """Distinct (n, hash, words, item) of (i, t) items."""

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(raw.as_py())
                n = min(size, len(words))
                hashes = window_hashes(word_hashes(words), n).view(np.int64) if n else []
                for a in range(0, len(hashes), 10_000):
                    some = range(a, min(len(hashes), a + 10_000))
                    yield pa.RecordBatch.from_arrays([pa.array([n] * len(some), pa.int32()), pa.array(hashes[some.start : some.stop]), pa.array([b" ".join(words[i : i + n]) for i in some], pa.binary()), pa.array([name] * len(some), pa.string())], ["n", "hash", "words", "item"])

    return items.mapInArrow(run, "n int, hash long, words binary, item string").distinct()


def _joined(df: DataFrame, items: DataFrame, text: str, size: int, schema: T.StructType, cut: bool) -> DataFrame:
    """The texts against a table of all windows."""
    spark, names = df.sparkSession, df.columns
    row, back = fresh(df, "_row"), fresh(df, "_back")
    windows = written(_windows(items, size), "windows")
    sizes = [r.n for r in windows.select("n").distinct().collect()]
    shared = spark.sparkContext.broadcast(bitmap(windows.select(F.pmod("hash", F.lit(BITMAP_BITS)).alias("place")), BITMAP_BITS))
    rows = written(df.withColumn(row, F.monotonically_increasing_id()), "rows")

    def near(batches):
        for batch in batches:
            for row, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(raw.as_py())
                hashes = word_hashes(words)
                for n in sizes:
                    mixed = window_hashes(hashes, n).view(np.int64)
                    places = np.flatnonzero(in_bitmap(shared.value, mixed & (BITMAP_BITS - 1)))
                    for a in range(0, len(places), 10_000):
                        at = places[a : a + 10_000]
                        yield pa.RecordBatch.from_arrays([pa.array([row] * len(at), pa.int64()), pa.array(at), pa.array([n] * len(at), pa.int32()), pa.array(mixed[at]), pa.array([b" ".join(words[i : i + n]) for i in at.tolist()], pa.binary())], ["row", "at", "n", "hash", "words"])

    close = written(rows.select(row, text_bytes(text)).mapInArrow(near, "row long, at long, n int, hash long, words binary"), "near")
    key = ["n", "hash", "words"]
    spans = close.join(windows.select(*key).distinct(), key, "left_semi").groupBy("row").agg(F.array_sort(F.collect_set(F.struct("at", "n"))).alias("spans"))
    found = close.select("row", *key).distinct().join(windows, key).groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = spans.join(found, "row").select(F.col("row").alias(row), F.struct("spans", "items").alias(back))
    joined = rows.join(hits, row, "left").select(*names, *(F.col(f"{back}.{c}").alias(fresh(df, f"_{k}")) for k, c in (("at", "spans.at"), ("n", "spans.n"), ("items", "items"))))
    at = names.index(text)

    def run(batches):
        for batch in batches:
            starts, sizes, items = (batch.column(len(names) + i).to_pylist() for i in range(3))
            counts = [len(words_of((x.as_py() or "").encode())) for x in batch.column(at)]
            hits = [merged([(a, a + n) for a, n in zip(x or (), y or ())]) for x, y in zip(starts, sizes)]
            columns = batch.columns[: len(names)]
            yield _outputs(_cut(columns, at, hits) if cut else columns, names, counts, hits, [x or () for x in items])

    return joined.mapInArrow(run, schema)


def find_passages(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = 10, most_bytes: int = 8 << 20, cut: bool = False) -> DataFrame:
    """Add ``n_words``, ``hit_words`` (word spans as start, end, start, ...) and ``hit_items``, all of the given text.

    With ``cut`` the text is replaced by what ``cut_passages`` would leave, in the same pass.
    """
    df = df.drop(*OUTPUTS)
    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in df.schema), *(T.StructField(k, T.DataType.fromDDL(v)) for k, v in OUTPUTS.items())])
    items = benchmark.select(F.col(item).cast("string").alias("i"), text_bytes(item_text).alias("t")).where("i is not null")
    if (items.agg(F.sum(F.length("t") + F.length("i") + 64)).first()[0] or 0) > most_bytes:
        return _joined(df, items, text, size, schema, cut)
    return _scanned(df, [(r.i, bytes(r.t)) for r in items.collect()], text, size, schema, cut)


def cut_passages(df: DataFrame, text: str = "text") -> DataFrame:
    """Remove the spans that ``find_passages`` found: from a span's first word to its last."""
    at, hits = df.columns.index(text), df.columns.index("hit_words")

    def run(batches):
        for batch in batches:
            spans = (list(zip(x[::2], x[1::2])) for x in (x.as_py() or () for x in batch.column(hits)))
            yield pa.RecordBatch.from_arrays(_cut(batch.columns, at, spans), batch.schema.names)

    return df.mapInArrow(run, df.schema)


def n_hit():
    """Hit words, from ``hit_words``."""
    return F.aggregate(F.transform("hit_words", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    docs = table(session(spark), sf_dir, "documents").select("doc_id", "text")
    found = find_passages(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("hit_items")), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


SQL_OP6 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
item_starts AS (
  SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM item_starts),
sizes AS (SELECT DISTINCT n FROM windows),
doc_starts AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n),
doc_windows AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS k FROM doc_starts),
found AS (SELECT doc_id, i, n, item FROM doc_windows JOIN windows USING (n, k)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
