"""Removal of long repeated byte strings by merging sorted suffix runs.

A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document with a
smaller id, or before it in the same document.

1. Every string of ``length`` bytes holds an anchor: the smallest hashed ``gram`` in it, the leftmost
   of equals. Equal strings have equal anchors, so only anchors whose gram occurs twice or more
   matter. Grams are counted by their hash, with one entry per hash and task.
2. Each task takes the suffixes at those anchors (and what stands before them), sorts them into a
   run, settles equal ones by the earliest and sends front-coded parts of the run on, dealt by the
   anchor's gram.
3. Runs are merged by a loser tree that keeps the common prefix with the last winner and never
   compares a known prefix again. The common prefixes of the merged order tell which strings around
   the anchors are equal to earlier ones.

Copies of one passage are settled within each task first, so a passage in a third of all rows gives
one entry per task. Strings before an anchor are told apart by 64-bit hashes, those after it by
their bytes.

Null text counts as empty. Rows of distinct id and text are documents of their own, equal rows are one. Documents
are ordered by id, null last, and those of one id by a digest of their text. An empty table gives an empty table.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwright.llm.common import byte_chunks, row_ids, session, shuffle_partitions, table, text_bytes

#: String length, gram length, and the strings' count of grams, which must be a power of two.
LENGTH, GRAM = 100, 37
STEPS = LENGTH - GRAM + 1
#: Bytes before an anchor that matter; with those after it, the width of a suffix entry.
LEFT = STEPS - 1
WIDTH = LENGTH + LEFT + 2
_M = np.uint64(0x9E3779B97F4A7C15)
_M_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_PLACE = 24
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """Powers 0..n-1 modulo 2**64; kept by the worker."""
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 21), base, np.uint64)
        steps[0] = 1
        have = _powers[str(base)] = np.cumprod(steps)
    return have[:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all runs of ``gram`` bytes, from sums of powers."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(data * _power(_M, n), out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * _power(_M_INVERSE, n - gram + 1)
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, gram hash) of the anchors of each text's strings; the texts are at most 2**24 bytes."""
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    empty = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return empty, empty, np.empty(0, np.uint64)
    h = gram_hashes(data, GRAM)
    low = (h >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(h), dtype=np.uint64)
    reach = 1
    while reach < STEPS:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    starts = np.cumsum(sizes) - sizes
    valid = np.zeros(len(data) + 1, np.int32)
    long = sizes >= LENGTH
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, (starts + sizes - LENGTH + 1)[long], -1)
    low = low[np.cumsum(valid)[: len(low)] > 0] & np.uint64((1 << _PLACE) - 1)
    if not len(low):
        return empty, empty, np.empty(0, np.uint64)
    at = low[np.concatenate([[True], low[1:] != low[:-1]])].astype(np.int64)
    at = np.unique(at)
    text = np.searchsorted(starts, at, "right") - 1
    # empty texts share a start with the one after them
    return text, at - starts[text], h[at]


def _segments(raw: bytes, most: int = 1 << 22):
    """Parts of a long text that hold each of its strings once, as (start, bytes)."""
    if len(raw) <= most:
        yield 0, raw
        return
    for a in range(0, len(raw) - LENGTH + 1, most - LENGTH + 1):
        yield a, raw[a : a + most]


def _texts(ids: pa.Array, texts: pa.Array):
    """(ids, starts, texts) of parts of a batch that are small enough to work on at once."""
    for first, chunk in byte_chunks(texts):
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for i, raw in enumerate(chunk):
            if len(raw) >= LENGTH:
                doc = ids[first + i].as_py()
                for a, part in _segments(raw):
                    if size + len(part) > 1 << 23:
                        yield held
                        held, size = [], 0
                    held.append((doc, a, part))
                    size += len(part)
        if held:
            yield held


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    b, x = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(x, pa.binary())], ["bucket", "block"])


SCHEMA = "bucket int, block binary"


def _deal_by_doc(docs: np.ndarray, *values: np.ndarray, buckets: int):
    """(bucket, block): the values of documents, dealt by document; a block is rows of int64, doc first."""
    rows = np.stack([docs, *values], axis=1).astype(np.int64)
    key = (docs.astype(np.uint64) * _MIX) >> np.uint64(32)
    return [(b, rows[at].tobytes()) for b, at in _deal(key, buckets)] if len(docs) else []


def gather(blocks: DataFrame, width: int) -> DataFrame:
    """(doc, block) with one row per document, of (bucket, block) that were dealt by document."""

    def run(batches):
        held = [np.frombuffer(x.as_buffer(), np.int64).reshape(-1, width) for batch in batches for x in batch.column(0)]
        if held:
            rows = np.concatenate(held)
            rows = rows[np.argsort(rows[:, 0], kind="stable")]
            cuts = np.flatnonzero(np.diff(rows[:, 0])) + 1
            for a in range(0, len(cuts) + 1, 10_000):
                ends = [*cuts[a : a + 10_000], *([len(rows)] if a + 10_000 > len(cuts) else [])]
                start = 0 if a == 0 else cuts[a - 1]
                out = []
                for end in ends:
                    out.append((int(rows[start, 0]), rows[start:end, 1:].tobytes()))
                    start = end
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["doc", "block"])

    dealt = blocks.repartition(shuffle_partitions(blocks.sparkSession), "bucket").select("block")
    return dealt.mapInArrow(run, "doc long, block binary")


def _deal(key: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """Rows of each bucket, in the order given."""
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return [(b, order[cuts[b] : cuts[b + 1]]) for b in range(buckets) if cuts[b] < cuts[b + 1]]


def repeated_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block): places of anchors whose gram occurs twice or more; ``docs`` is (doc, text bytes)."""

    def find(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids, places, grams = [], [], []
            for held in _texts(batch.column(0), batch.column(1)):
                text, place, h = anchors([x[2] for x in held])
                ids.append(np.array([x[0] for x in held], np.int64)[text])
                places.append(place + np.array([x[1] for x in held], np.int64)[text])
                grams.append(h >> np.uint64(16))
            if not ids:
                continue
            doc, place, h = map(np.concatenate, (ids, places, grams))
            if not len(doc):
                continue
            _, first, back, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            rows = [(b, b"D" + b.to_bytes(4, "little") + x) for b, x in _deal_by_doc(doc[n[back] > 1], place[n[back] > 1], buckets=buckets)]
            # a gram goes on once, wherever else it is in this batch is settled
            sent = np.sort(first)
            for b, at in _deal(h[sent], buckets):
                at = sent[at]
                code = h[at].view(np.uint8).reshape(-1, 8)[:, :6].tobytes() + doc[at].tobytes() + np.diff(place[at], prepend=0).astype(np.int64).tobytes()
                rows.append((b, b"A" + len(at).to_bytes(8, "little") + pack.compress(code)))
            yield _batch(rows)

    def match(batches):
        unpack = zstandard.ZstdDecompressor()
        grams, docs, places = [], [], []
        for batch in batches:
            known = []
            for block in batch.column(1).to_pylist():
                if block[:1] == b"D":
                    known.append((int.from_bytes(block[1:5], "little"), block[5:]))
                    continue
                n = int.from_bytes(block[1:9], "little")
                raw = unpack.decompress(block[9:])
                h = np.zeros((n, 8), np.uint8)
                h[:, :6] = np.frombuffer(raw, np.uint8, 6 * n).reshape(n, 6)
                grams.append(h.reshape(-1).view(np.uint64))
                docs.append(np.frombuffer(raw, np.int64, n, 6 * n))
                places.append(np.cumsum(np.frombuffer(raw, np.int64, n, 14 * n)))
            if known:
                yield _batch(known)
        if grams:
            h, doc, place = map(np.concatenate, (grams, docs, places))
            order = np.argsort(h, kind="stable")
            h = h[order]
            same = h[1:] == h[:-1]
            twice = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
            if len(twice):
                yield _batch(_deal_by_doc(doc[twice], place[twice], buckets=buckets))

    sent = docs.mapInArrow(find, SCHEMA).repartition(shuffle_partitions(docs.sparkSession), "bucket")
    return sent.mapInArrow(match, SCHEMA)


def entries(raw: bytes, places: np.ndarray) -> np.ndarray:
    """Suffix entries: ``LENGTH`` bytes from each place on, ``LEFT`` bytes before it, backwards, and
    how many of either there are (plus one, as entries are zero-padded)."""
    data = np.frombuffer(bytes(LEFT) + raw + bytes(LENGTH), np.uint8)
    out = np.empty((len(places), WIDTH), np.uint8)
    out[:, :LENGTH] = data[(places + LEFT)[:, None] + np.arange(LENGTH)[None, :]]
    out[:, LENGTH : LENGTH + LEFT] = data[(places + LEFT)[:, None] - 1 - np.arange(LEFT)[None, :]]
    out[:, -2] = np.minimum(len(raw) - places, LENGTH) + 1
    out[:, -1] = np.minimum(places, LEFT) + 1
    return out


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before it; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    for a in range(1, len(rows), 1 << 16):
        b = min(len(rows), a + (1 << 16))
        differ = rows[a:b] != rows[a - 1 : b - 1]
        out[a:b] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def front_code(rows: np.ndarray) -> bytes:
    """Sorted rows as common prefixes and what follows them."""
    prefix = common_prefixes(rows)
    return prefix.astype(np.uint8).tobytes() + rows[np.arange(rows.shape[1])[None, :] >= prefix[:, None]].tobytes()


def front_decode(code: bytes, n: int) -> tuple[list[bytes], list[int]]:
    """The rows and their common prefixes."""
    prefixes, at, last, out = list(code[:n]), n, b"", []
    for p in prefixes:
        last = last[:p] + code[at : at + WIDTH - p]
        at += WIDTH - p
        out.append(last)
    return out, prefixes


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted runs (rows, common prefixes) by a loser tree.

    Gives (run, row) in sorted order and the common prefix of each with the one before it. A node
    holds the loser of its match and the loser's common prefix with the winner; of two that both
    share a prefix with the last winner, the one that shares more is smaller, and only if they
    share the same are bytes compared, from there on.
    """
    k = 1
    while k < max(2, len(runs)):
        k *= 2
    heads = [0] * k
    rows = [r[0] for r in runs] + [[]] * (k - len(runs))
    shared = [0] * k  # common prefix of each run's head with the last winner
    tree = [-1] * k

    def beats(a: int, b: int) -> bool:
        """Whether head a goes before head b; the loser's ``shared`` becomes that with the winner."""
        if heads[a] >= len(rows[a]):
            return False
        if heads[b] >= len(rows[b]):
            return True
        p, q = shared[a], shared[b]
        if p != q:
            return p > q
        x, y = rows[a][heads[a]], rows[b][heads[b]]
        u, v = int.from_bytes(x[p:], "big"), int.from_bytes(y[p:], "big")
        differ = u ^ v
        same = WIDTH - (differ.bit_length() + 7) // 8
        first = u < v or (u == v and a < b)
        if first:
            shared[b] = same
        else:
            shared[a] = same
        return first

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        winner, tree[node] = (a, b) if beats(a, b) else (b, a)
        return winner

    winner, order, prefixes = play(1), [], []
    total = sum(len(r) for r in rows)
    shared_with_last = 0
    for _ in range(total):
        order.append((winner, heads[winner]))
        prefixes.append(shared_with_last)
        heads[winner] += 1
        if heads[winner] < len(rows[winner]):
            shared[winner] = runs[winner][1][heads[winner]]
        node = (winner + k) // 2
        while node:
            if beats(tree[node], winner):
                winner, tree[node] = tree[node], winner
            node //= 2
        shared_with_last = shared[winner]
    return order, prefixes


def _whole(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far the strings around each anchor reach before and after it; 0 and 0 if there are none."""
    right, left = rows[:, -2].astype(np.int64) - 1, rows[:, -1].astype(np.int64) - 1
    ok = right + left >= LENGTH
    return np.where(ok, left, 0), np.where(ok, right, 0)


def _settle(rows: np.ndarray, prefix: np.ndarray, doc: np.ndarray, place: np.ndarray):
    """Of sorted rows, which are the earliest of their equals; and the spans of the others."""
    group = np.cumsum(prefix < WIDTH)
    order = np.lexsort((place, doc, group))
    firsts = order[np.concatenate([[True], np.diff(group[order]) > 0])]
    keep = np.zeros(len(rows), bool)
    keep[firsts] = True
    # a row at the very place of the earliest is not later than it
    lead = np.empty(group.max() + 1, np.int64)
    lead[group[firsts]] = firsts
    late = ~keep & ((doc != doc[lead[group]]) | (place != place[lead[group]]))
    left, right = _whole(rows[late])
    some = right > 0
    return keep, (doc[late][some], (place[late] - left)[some], (place[late] + right)[some])


def earlier_strings(rows: np.ndarray, prefix: np.ndarray, doc: np.ndarray, place: np.ndarray):
    """Spans (doc, start, end) of the strings around distinct sorted rows that start earlier elsewhere."""
    # rows that share no gram with a neighbour have no equals
    near = prefix >= GRAM
    some = near | np.concatenate([near[1:], [False]])
    if not some.any():
        return None
    at = np.flatnonzero(some)
    # a left-out row between two rows of a gram cannot be: rows of one gram are adjacent
    rows, doc, place = rows[at], doc[at], place[at]
    prefix = np.where(np.concatenate([[False], np.diff(at) == 1]), prefix[at], 0)
    right, left = rows[:, -2].astype(np.int64) - 1, rows[:, -1].astype(np.int64) - 1
    rank = np.empty(len(at), np.int64)
    by_start = np.lexsort((place, doc))
    rank[by_start] = np.arange(len(at))
    low = np.full(len(at), LENGTH + LEFT)
    high = np.full(len(at), -1)
    before = np.zeros(len(at), np.uint64)
    for o in range(LEFT + 1):
        if o:
            before = (before + rows[:, LENGTH + o - 1] + np.uint64(1)) * _M
            before ^= before >> np.uint64(31)
        ok = np.flatnonzero((left >= o) & (right >= LENGTH - o))
        if not len(ok):
            continue
        after = np.cumsum(prefix < LENGTH - o)[ok].astype(np.uint64)
        key = (after * _MIX) ^ before[ok]
        key = (key ^ (key >> np.uint64(30))) * _MIX
        order = np.lexsort((rank[ok], key))
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        if new.all():
            continue
        first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        a, b = ok[order], ok[first]
        late = a[(doc[a] != doc[b]) | (place[a] != place[b])]
        low[late] = np.minimum(low[late], o)
        high[late] = np.maximum(high[late], o)
    got = high >= 0
    # strings around one anchor overlap, so what they cover is one span
    return doc[got], (place - high)[got], (place - low + LENGTH)[got]


def removed_spans(docs: DataFrame, found: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block): spans to remove, as rows of doc, start and end; ``found`` is (doc, block of places)."""

    def sort(batches):
        for batch in batches:
            ids, places, rows = [], [], []
            for doc, raw, block in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                raw = raw.as_py()
                at = np.unique(np.frombuffer(block, np.int64))
                at = at[at + GRAM <= len(raw)]
                ids.append(np.full(len(at), doc))
                places.append(at)
                rows.append(entries(raw, at))
            doc, place, run = map(np.concatenate, (ids, places, rows))
            if not len(doc):
                continue
            order = np.argsort(run.view(f"S{WIDTH}").ravel(), kind="stable")
            run, doc, place = run[order], doc[order], place[order]
            keep, spans = _settle(run, common_prefixes(run), doc, place)
            out = [(b, b"S" + b.to_bytes(4, "little") + x) for b, x in _deal_by_doc(*spans, buckets=buckets)]
            run, doc, place = run[keep], doc[keep], place[keep]
            gram = gram_hashes(run[:, :GRAM].reshape(-1), GRAM)[::GRAM]
            for b, at in _deal(gram, buckets):
                out.append((b, b"R" + len(at).to_bytes(8, "little") + doc[at].tobytes() + place[at].tobytes() + front_code(run[at])))
            yield _batch(out)

    def merge(batches):
        runs = defaultdict(list)
        for batch in batches:
            known = []
            for bucket, block in zip(*(batch.column(i).to_pylist() for i in range(2))):
                if block[:1] == b"S":
                    known.append((int.from_bytes(block[1:5], "little"), block[5:]))
                else:
                    runs[bucket].append(block)
            if known:
                yield _batch(known)
        made = []
        for bucket in list(runs):
            parts, docs, places = [], [], []
            for block in runs.pop(bucket):
                n = int.from_bytes(block[1:9], "little")
                docs.append(np.frombuffer(block, np.int64, n, 9))
                places.append(np.frombuffer(block, np.int64, n, 9 + 8 * n))
                parts.append(front_decode(block[9 + 16 * n :], n))
            order, prefix = merge_runs(parts)
            rows = np.frombuffer(b"".join([parts[r][0][i] for r, i in order]), np.uint8).reshape(-1, WIDTH)
            base = np.cumsum([0, *map(len, docs)])
            at = np.array([base[r] + i for r, i in order])
            doc, place = np.concatenate(docs)[at], np.concatenate(places)[at]
            prefix = np.array(prefix)
            keep, spans = _settle(rows, prefix, doc, place)
            made.append(spans)
            if keep.sum() > 1:
                # the common prefix of kept neighbours is the least between them
                kept = np.flatnonzero(keep)
                least = np.minimum.reduceat(prefix, np.concatenate([[0], kept[:-1] + 1]))
                more = earlier_strings(rows[kept], least, doc[kept], place[kept])
                if more is not None:
                    made.append(more)
        if made and (out := _deal_by_doc(*map(np.concatenate, zip(*made)), buckets=buckets)):
            yield _batch(out)

    joined = docs.join(found, "doc").select("doc", "raw", "block")
    sent = joined.mapInArrow(sort, SCHEMA).repartition(shuffle_partitions(docs.sparkSession), "bucket")
    return sent.mapInArrow(merge, SCHEMA)


def cut_repeats(df: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row; kept holds the remaining bytes."""
    buckets = 8 * shuffle_partitions(df.sparkSession)
    rows, again = row_ids(df.select(F.col(doc).cast("long").alias("id"), F.col(text).alias("text")), "id")
    # never null, and the planner is to know it: both joins of the texts then share one exchange
    named = rows.select(F.coalesce("_row", F.lit(-1)).alias("doc"), text_bytes().alias("raw"), *(["id"] if again else []))
    # of equal rows one is searched, and what is found is cut from all
    docs = named.select("doc", "raw").dropDuplicates(["doc"]) if again else named
    found = gather(repeated_anchors(docs, buckets), 2)
    spans = gather(removed_spans(docs, found, buckets), 3)

    def cut(batches):
        for batch in batches:
            out = []
            for raw, block in zip(batch.column(1), batch.column(2).to_pylist()):
                raw = raw.as_py()
                n_spans = removed = last = 0
                kept = []
                if block:
                    pairs = np.frombuffer(block, np.int64).reshape(-1, 2)
                    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                    reach = np.maximum.accumulate(pairs[:, 1])
                    new = np.concatenate([[True], pairs[1:, 0] > reach[:-1]])
                    starts = pairs[new, 0].tolist()
                    ends = reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(pairs) - 1]])].tolist()
                    for a, b in zip(starts, ends):
                        b = min(b, len(raw))
                        if a < b:
                            kept.append(raw[last:a])
                            last, n_spans, removed = b, n_spans + 1, removed + b - a
                kept.append(raw[last:])
                out.append((len(raw), removed, n_spans, b"".join(kept)))
            n, r, s, k = zip(*out)
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(k, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = named.join(spans, "doc", "left").select("doc", "raw", "block", F.col("id" if again else "doc").alias("id"))
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated strings."""
    out = cut_repeats(table(session(spark), sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Bytes are hexadecimal digits here, in parts of 500 starts so that no substring is far into a text.
SQL_OP8 = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
part_starts AS (SELECT doc_id, h, n, unnest(range(0, n - 99, 500)) AS p FROM docs),
parts AS (SELECT doc_id, p, least(500, n - 99 - p) AS starts, substr(h, 2 * p + 1, 1198) AS x FROM part_starts),
places AS (SELECT doc_id, p, x, unnest(range(0, starts)) AS i FROM parts),
strings AS (SELECT doc_id, p + i AS p, md5_number(substr(x, 2 * i + 1, 200)) AS k FROM places),
earliest AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM strings),
late AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS last FROM earliest WHERE r > 1),
islands AS (SELECT doc_id, p, sum(CASE WHEN last IS NULL OR p > last + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM late),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM islands GROUP BY doc_id, g),
totals AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id),
ends AS (SELECT doc_id, a, b FROM spans UNION ALL SELECT doc_id, n, n FROM docs),
gaps AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS b FROM ends),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * gaps.b + 1, 2 * (gaps.a - gaps.b)), '' ORDER BY gaps.a, gaps.b) AS x FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(x)) AS kept_sha256
FROM docs JOIN kept USING (doc_id) LEFT JOIN totals USING (doc_id)
"""
