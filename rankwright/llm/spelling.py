"""Spelling variants: words one edit apart, each tied to its most frequent neighbour.

Words are the maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased, of at least
``least_chars`` code points and ``least_n`` occurrences. Two words are near if one inserted, deleted or replaced
code point makes them equal. A word's form is its near word of largest n (of equals the smallest in code-point order)
where that n is at least ``ratio`` times the word's own; its root is where the chain of forms ends.

The search is dynamic programming over sorted lists. Words that are near share their first half or, from there
on, their second: every word is in the list of each, once among the words of its own length and once
among those a letter longer. Within a list what all share is left out. The rest is sorted; adjacent common
prefixes (LCPs) cut the list into ranges, and a range has one banded row of the edit matrix for each word that is
sought, which all its words reuse. Rows are taken from depth to depth, for all lists of a block at a time, and
a range whose row exceeds one edit is skipped. A list of over ``most_rows`` words, or over ``most_chars``, is
halved again, until one letter is left of the shorter words; there at most 90 + 90 * 90 words differ. No pair is met twice: lists of the
second half leave out pairs that share the first.

Null text has no words; a null id counts as an empty one. Equal rows count each. A table without words gives an empty
table. Other columns are not read. Words of any length are taken whole.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwright.llm.common import discard, session, shuffle_partitions, sized_join, table, text_bytes, written

#: Distinct words, and bytes of text, that a task counts before it sends the counts on.
HELD_WORDS, HELD_CHARS = 200_000, 64 << 20


@dataclass(frozen=True)
class Spelling:
    """``damage``: one in so many (document, word) pairs loses a code point, by crc32; 0 for none."""

    least_chars: int = 5
    least_n: int = 3
    ratio: int = 2
    damage: int = 0
    most_rows: int = 4096
    most_chars: int = 4 << 20
    block_cells: int = 1 << 18


def counted(held: Counter, doc: str, raw: bytes, runs: re.Pattern, how: Spelling) -> int:
    """Add the words of one text to ``held``; returns how many characters of runs it had."""
    # lower-casing bytes changes A-Z only; shorter runs give no words
    found = runs.findall(raw.lower().decode("utf-8", "replace"))
    held.update(found)
    if how.damage:
        start = crc32(f"{doc}:".encode())
        hit = [run for run in set(found) if crc32(run.encode(), start) % how.damage == 0]
        sizes = Counter(found) if hit else {}
        for run in hit:
            at = crc32(run.encode(), start) % len(run)
            word = run[:at] + run[at + 1 :]
            held[run] -= sizes[run]
            if len(word) >= how.least_chars:
                held[word] += sizes[run]
    return len(raw)


def vocabulary(docs: DataFrame, how: Spelling = Spelling(), text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""

    def batch_of(held):
        words = [w for w, n in held.items() if n]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], ["word", "n"])

    def run(batches):
        runs = re.compile("[a-zÀ-ÿ]{%d,}" % how.least_chars)
        held, chars = Counter(), 0
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                chars += counted(held, doc_id or "", raw.as_py(), runs, how)
                if len(held) > HELD_WORDS or chars > HELD_CHARS:
                    yield batch_of(held)
                    held, chars = Counter(), 0
        if held:
            yield batch_of(held)

    found = docs.select(F.col(doc).cast("string"), text_bytes(text)).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= how.least_n)


def _keyed(rows: DataFrame) -> DataFrame:
    """(size, lo, hi, cut, word, n, key, mid) of (size, lo, hi, cut, word, n): words of ``size`` or ``size`` + 1 letters
    that share ``lo`` first and ``hi`` last ones are one list; pairs that share the first ``cut`` are left out (0: none)."""
    length = F.length("word")
    first, last = F.substring("word", F.lit(1), F.col("lo")), F.substring("word", length - F.col("hi") + 1, F.col("hi"))
    mid = F.encode(F.substring("word", F.col("lo") + 1, length - F.col("lo") - F.col("hi")), "ISO-8859-1")
    return rows.withColumns({"key": F.concat_ws(":", "size", "cut", F.concat(first, F.lit("*"), last)), "mid": mid})


def _halved(rows: DataFrame) -> DataFrame:
    """Each list's rows in a list that shares the first half of what is left, and in one that shares the rest but not that."""
    rest = F.col("size") - F.col("lo") - F.col("hi")
    k = F.floor(rest / 2).cast("int")
    end = F.col("lo") + k
    cut = F.when(F.col("cut") == 0, end).otherwise(F.least("cut", end))
    front = F.struct(end.alias("lo"), F.col("hi"), F.col("cut"))
    back = F.struct(F.col("lo"), (F.col("hi") + rest - k).alias("hi"), cut.alias("cut"))
    # a list of the first half that goes beyond the cut holds no pair
    fit = F.filter(F.array(front, back), lambda x: (x["cut"] == 0) | (x["lo"] < x["cut"]))
    return rows.select("size", "word", "n", F.explode(fit).alias("x")).select("size", "x.*", "word", "n")


def lists(words: DataFrame, how: Spelling) -> DataFrame:
    """(key, mid, cut, rest, word, n): the lists that are searched; ``cut`` and ``rest`` (letters of the shorter words) count from ``mid``."""
    length = F.length("word")
    sizes = F.filter(F.array(length, length - 1), lambda x: x >= how.least_chars)
    whole = words.select("word", "n", F.explode(sizes).alias("size"))
    rows = _keyed(_halved(whole.select("size", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("cut"), "word", "n")))
    out = None
    while True:
        rest = F.min(F.col("size") - F.col("lo") - F.col("hi"))
        sizes = rows.groupBy("key").agg(F.count("*").alias("rows"), F.sum(F.length("mid")).alias("chars"), rest.alias("rest"))
        large = written(sizes.where(((F.col("rows") > how.most_rows) | (F.col("chars") > how.most_chars)) & (F.col("rest") > 1) & (F.col("rows") > 1)).select("key", F.lit(True).alias("large")), "large")
        none = large.isEmpty()
        marked = rows if none else written(sized_join(rows, large, "key"), "lists")
        done = marked if none else marked.where("large is null")
        done = done.select("key", "mid", F.greatest(F.col("cut") - F.col("lo"), F.lit(0)).alias("cut"), (F.col("size") - F.col("lo") - F.col("hi")).alias("rest"), "word", "n")
        out = done if out is None else out.union(done)
        if none:
            return out
        rows = _keyed(_halved(marked.where("large").drop("key", "mid", "large")))


def near_in_lists(mids: np.ndarray, sizes: np.ndarray, group: np.ndarray, cut: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows one edit apart.

    ``mids`` has a row of bytes for each word, filled up with zeros and sorted within its ``group`` (numbers of the lists, in order).
    A state is a range of the sorted list, one of the words sought, and the edits between the range's common prefix of
    ``depth`` letters and the first depth - 1, depth and depth + 1 letters of the word (2 stands for more than one).
    """
    n, width = mids.shape
    same = np.cumprod(mids[1:] == mids[:-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    lcp = np.concatenate([[-1], np.where(group[1:] == group[:-1], same, -1)])
    starts = np.flatnonzero(lcp < 0)
    ends = np.append(starts[1:], n)
    padded = np.zeros((n, width + 3), np.uint8)
    padded[:, 1 : width + 1] = mids
    # words sought: the shorter ones of each list, over the whole list
    of = np.repeat(np.arange(len(starts)), ends - starts)
    sought = np.flatnonzero((sizes == rest) & ((ends - starts)[of] > 1))
    low, high = starts[of[sought]], ends[of[sought]]
    less, even, more = np.full(len(sought), 2, np.uint8), np.zeros(len(sought), np.uint8), np.ones(len(sought), np.uint8)
    found = []
    for depth in range(width + 1):
        if not len(sought):
            break
        # the word that ends here is the first of its range
        over = sizes[low] == depth
        if over.any():
            gap = sizes[sought].astype(np.int64) - depth
            edits = np.where(gap == 0, even, np.where(gap == -1, less, np.where(gap == 1, more, 2)))
            hit = over & (edits == 1) & ((sizes[low] > rest[low]) | (low > sought))
            found.append((sought[hit], low[hit]))
        if depth == width:
            break
        # the ranges one letter deeper
        bounds = np.flatnonzero(lcp <= depth)
        a, b = np.searchsorted(bounds, low), np.searchsorted(bounds, high)
        count = b - a
        state = np.repeat(np.arange(len(sought)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + a[state]
        low2, high2 = bounds[at], np.append(bounds, n)[at + 1]
        q, c = sought[state], mids[low2, depth]
        l0, e0, m0 = less[state], even[state], more[state]
        l1 = np.minimum(l0 + (c != padded[q, depth]), e0 + 1)
        e1 = np.minimum(np.minimum(e0 + (c != padded[q, depth + 1]), m0 + 1), l1 + 1)
        m1 = np.minimum(m0 + (c != padded[q, depth + 2]), e1 + 1)
        keep = (np.minimum(np.minimum(l1, e1), m1) < 2) & (c > 0) & ~((low2 == q) & (high2 == q + 1))
        # pairs that share the first ``cut`` letters belong to another list
        keep &= (cut[q] != depth + 1) | (e1 > 0)
        sought, low, high = q[keep], low2[keep], high2[keep]
        less, even, more = (np.minimum(x[keep], 2).astype(np.uint8) for x in (l1, e1, m1))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a binary column as rows of bytes filled up with zeros, and their sizes."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    sizes = np.diff(offsets)
    width = int(sizes.max(initial=0))
    data = np.append(np.frombuffer(column.buffers()[2] or b"", np.uint8), np.zeros(width + 1, np.uint8))
    out = data[offsets[:-1, None] + np.arange(width)]
    out[np.arange(width) >= sizes[:, None]] = 0
    return out, sizes


def near_words(words: DataFrame, how: Spelling = Spelling()) -> DataFrame:
    """(word, near, near_n): each near pair of (word, n), in both directions."""
    rows = lists(words, how)
    dealt = rows.repartition(shuffle_partitions(words.sparkSession), "key").sortWithinPartitions("key", "mid")

    def pairs(block: pa.Table):
        block = block.combine_chunks()
        key = block.column("key").combine_chunks().dictionary_encode()
        mids, sizes = _matrix(block.column("mid").combine_chunks())
        i, j = near_in_lists(mids, sizes, key.indices.to_numpy(), block.column("cut").to_numpy(), block.column("rest").to_numpy())
        names, n = block.column("word").combine_chunks(), block.column("n").combine_chunks()
        left, right = pa.array(np.concatenate([i, j])), pa.array(np.concatenate([j, i]))
        return pa.RecordBatch.from_arrays([names.take(left), names.take(right), n.take(right)], ["word", "near", "near_n"])

    def run(batches):
        held, cells = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            key = part.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
            size = np.diff(np.append(np.flatnonzero(np.diff(key, prepend=-1)), len(key)))
            begins = np.flatnonzero(np.diff(key, prepend=-1))
            if held and held[-1].column("key")[-1] == part.column("key")[0]:
                begins, size = begins[1:], size[1:]
            if held and not len(begins):
                # all of it goes on with the list before
                held.append(part)
                continue
            start = 0
            for first, rows_of in zip(begins.tolist(), size.tolist()):
                if cells > how.block_cells:
                    if first > start:
                        held.append(part.slice(start, first - start))
                    if held:
                        yield pairs(pa.concat_tables(held))
                    held, cells, start = [], 0, first
                cells += rows_of * (len(part.column("mid")[first].as_py()) + 1)
            held.append(part.slice(start))
        if held:
            yield pairs(pa.concat_tables(held))

    return dealt.select("key", "mid", "cut", "rest", "word", "n").mapInArrow(run, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the chain of (word, form) ends; pointers are doubled until none moves. Chains have no cycles, as n grows."""
    up = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        over = up.select(F.col("word").alias("at"), F.col("root").alias("over"))
        jumped = written(up.join(over, F.col("root") == F.col("at"), "left").select("word", F.coalesce("over", "root").alias("root"), F.col("over").isNotNull().alias("moved")), "roots")
        discard(up)
        up = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return up


def variants(docs: DataFrame, how: Spelling = Spelling(), text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word."""
    words = written(vocabulary(docs, how, text, doc), "words")
    # of largest n, of equals the smallest
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    near = near_words(words, how).groupBy("word").agg(F.count("*").alias("n_near"), best)
    named = words.join(near, "word", "left").withColumn("far", -F.col("best.less") >= how.ratio * F.col("n"))
    formed = written(named.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("far"), F.col("best.near")).alias("form"), F.when(F.col("far"), -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(formed.where("form is not null").select("word", "form"))
    return formed.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every word, one in 97 (document, word) pairs damaged."""
    docs = table(session(spark), sf_dir, "documents").select("doc_id", "text")
    return variants(docs, Spelling(damage=97)).select("word", "form", "root", "n", "n_near", "form_n")


#: Near words by deleted and replaced places, whatever the method; crc32 by table over the bytes.
SQL_OP12 = r"""
WITH RECURSIVE polynomial AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
counted AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, run, count(*) AS n FROM runs GROUP BY 1, 2),
hashed AS (
  SELECT run, n, xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(id || ':' || run, ''), lambda ch:
      CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [192::BIGINT + (unicode(ch) >> 6), 128::BIGINT + (unicode(ch) & 63)] END)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM counted, polynomial),
damaged AS (SELECT CASE WHEN h % 97 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
places AS MATERIALIZED (SELECT word, n, i, word[: i - 1] || word[i + 1 :] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS near, b.n AS near_n FROM places a JOIN places b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM places a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM places a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min({'less': -near_n, 'near': near}) AS b FROM near GROUP BY word),
formed AS MATERIALIZED (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 2 * n THEN b.near END AS form, CASE WHEN -b.less >= 2 * n THEN -b.less END AS form_n
  FROM words LEFT JOIN best USING (word)),
chains(word, top) AS (SELECT word, word FROM formed UNION ALL SELECT chains.word, form FROM chains JOIN formed ON chains.top = formed.word WHERE form IS NOT NULL)
SELECT formed.word, formed.form, chains.top AS root, formed.n, formed.n_near, formed.form_n::BIGINT AS form_n
FROM formed JOIN chains ON chains.word = formed.word JOIN formed e ON e.word = chains.top AND e.form IS NULL
"""
