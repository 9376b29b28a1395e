"""Byte-level BPE: encode texts to token ids and decode them.

Two tiers. A minimal perfect hash over the vocabulary resolves every pre-token that is itself a
token: one hash, one displacement, one comparison. The rest is merged by rank with a heap over a
linked list of byte spans, the leftmost pair of the lowest rank first. Workers remember the ids of short pre-tokens.

Null text counts as empty and gives no ids. One row per input row, repeated rows included; the
other columns pass through, but for the text (an existing ``ids`` or ``decoded`` column is replaced). An
empty table gives an empty table. The vocabulary is of fixed size and is broadcast.
"""

from __future__ import annotations

import base64
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from rankwright.llm.common import session, table

#: Pre-tokens that a worker remembers in each of two generations (a full one becomes the older), and their most characters.
MEMO, MEMO_CHARS = 3 << 16, 64
_MASK = (1 << 64) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank file: a line per token, base64 bytes and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}


def _slot(h: int, d: int, n: int) -> int:
    return (((h ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93 & _MASK) >> 32) % n


class PerfectVocabulary:
    """Minimal perfect hash (hash, displace and compare): n tokens in n slots.

    Buckets are placed from the largest down, each by the first displacement that puts all its
    tokens on free slots; buckets of one token take the slots that are left, stored as -slot-1.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.n = n = len(ranks)
        self.buckets = max(1, n // 2)
        groups: list[list[tuple[int, bytes]]] = [[] for _ in range(self.buckets)]
        for token in ranks:
            h = xxh3_64_intdigest(token)
            groups[h % self.buckets].append((h, token))
        self.displacement, self.tokens = [0] * self.buckets, [b""] * n
        taken = bytearray(n)
        order = sorted(range(self.buckets), key=lambda b: -len(groups[b]))
        for b in order:
            group = groups[b]
            if len(group) < 2:
                break
            d = 0
            while True:
                slots = [_slot(h, d, n) for h, _ in group]
                if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                    break
                d += 1
            self.displacement[b] = d
            for s, (_, token) in zip(slots, group):
                taken[s], self.tokens[s] = 1, token
        free = iter([s for s in range(n) if not taken[s]])
        for b in order:
            if len(groups[b]) == 1:
                s = next(free)
                self.displacement[b], self.tokens[s] = -s - 1, groups[b][0][1]
        self.ids = [ranks[t] for t in self.tokens]

    def find(self, token: bytes) -> int | None:
        """The token's id; None if it is not in the vocabulary."""
        h = xxh3_64_intdigest(token)
        d = self.displacement[h % self.buckets]
        s = -d - 1 if d < 0 else _slot(h, d, self.n)
        return self.ids[s] if self.tokens[s] == token else None


def merge_bytes(token: bytes, ranks: dict[bytes, int], pairs: list[int | None]) -> list[int]:
    """Ids of a pre-token by merges: a heap of pairs over a linked list of spans.

    ``pairs`` has the rank of each pair of bytes. Heap entries are rank, start and end in one number. ``after`` has
    the end of the span that starts at a place, 0 if none does, and ``before`` the start of the one that ends there.
    """
    n = len(token)
    after, before = list(range(1, n + 2)), list(range(-1, n))
    after[n] = 0
    get, bits = ranks.get, n.bit_length()
    mask = (1 << bits) - 1
    heap = [((r << bits | i) << bits) | i + 2 for i, (x, y) in enumerate(zip(token, token[1:])) if (r := pairs[x << 8 | y]) is not None]
    heapify(heap)
    while heap:
        entry = heappop(heap)
        end, i = entry & mask, entry >> bits & mask
        j = after[i]
        if not j or after[j] != end:
            continue  # one of the two spans has changed
        after[j], after[i], before[end] = 0, end, i
        if (k := after[end]) and (r := get(token[i:k])) is not None:
            heappush(heap, ((r << bits | i) << bits) | k)
        if (p := before[i]) >= 0 and (r := get(token[p:end])) is not None:
            heappush(heap, ((r << bits | p) << bits) | end)
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i : after[i]]])
        i = after[i]
    return out


class Codec:
    """What a worker needs to encode and decode; small and of fixed size."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"{len(missing)} single bytes have no rank")
        self.ranks, self.pattern, self.perfect = ranks, pattern, PerfectVocabulary(ranks)
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.pieces[i] = token
        self.pairs = [ranks.get(bytes((x, y))) for x in range(256) for y in range(256)]
        self._split, self._known, self._older = None, {}, {}

    def __getstate__(self):
        return self.__dict__ | {"_split": None, "_known": {}, "_older": {}}

    def _ids(self, pretoken: str) -> bytes:
        token = pretoken.encode()
        found = self.perfect.find(token)
        return array("i", (found,) if found is not None else merge_bytes(token, self.ranks, self.pairs)).tobytes()

    def packed(self, text: str) -> bytes:
        """Ids of ``text`` as packed 32-bit integers."""
        if self._split is None:
            self._split = regex.compile(self.pattern).findall
        parts = self._split(text)
        if len(self._known) > MEMO:
            self._known, self._older = {}, self._known
        known, older, long = self._known, self._older, {}
        for part in set(parts).difference(known):
            ids = older.get(part) or self._ids(part)
            (known if len(part) <= MEMO_CHARS else long)[part] = ids
        if long:
            return b"".join([long[x] if x in long else known[x] for x in parts])
        return b"".join(map(known.__getitem__, parts))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def _with(batch: pa.RecordBatch, name: str, values: pa.Array, *dropped: str) -> pa.RecordBatch:
    kept = [i for i, n in enumerate(batch.schema.names) if n not in (name, *dropped)]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), values], [*(batch.schema.names[i] for i in kept), name])


def _schema(df: DataFrame, name: str, kind: T.DataType, *dropped: str) -> T.StructType:
    return T.StructType([*(f for f in df.schema if f.name not in (name, *dropped)), T.StructField(name, kind)])


def codec(spark: SparkSession, path: str, pattern: str):
    """The broadcast codec of a rank file."""
    return spark.sparkContext.broadcast(Codec(read_ranks(path), pattern))


def _encoded(texts: pa.Array, codec: Codec) -> pa.ListArray:
    made = [codec.packed(x.as_py() or "") for x in texts]
    ends = np.zeros(len(made) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in made], out=ends[1:])
    flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(made))])
    return pa.ListArray.from_arrays(pa.array(ends), flat)


def _decoded(ids: pa.ListArray, codec: Codec) -> pa.Array:
    """Row by row, as the ids of a whole batch would be nine times as large as a list."""
    ends = np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy())])
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    return pa.array((codec.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])), pa.binary(), size=len(ids))


def encode(df: DataFrame, shared, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the token ids of ``text`` as ``array<int>``; ``text`` is dropped."""
    at = df.columns.index(text)

    def run(batches):
        for batch in batches:
            yield _with(batch, ids, _encoded(batch.column(at), shared.value), text)

    return df.mapInArrow(run, _schema(df, ids, T.ArrayType(T.IntegerType()), text))


def decode(df: DataFrame, shared, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the bytes that ``ids`` stand for; null counts as no ids."""

    def run(batches):
        for batch in batches:
            yield _with(batch, decoded, _decoded(batch.column(batch.schema.names.index(ids)), shared.value))

    return df.mapInArrow(run, _schema(df, decoded, T.BinaryType()))


def encode_decode(df: DataFrame, shared, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``decode`` of ``encode``, in one worker for each task instead of two, each with its own vocabulary."""
    at = df.columns.index(text)

    def run(batches):
        for batch in batches:
            made = _with(batch, ids, _encoded(batch.column(at), shared.value), text)
            yield _with(made, decoded, _decoded(made.column(made.schema.names.index(ids)), shared.value))

    fields = T.StructType([f for f in df.schema if f.name not in (text, ids, decoded)])
    return df.mapInArrow(run, T.StructType([*fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.BinaryType())]))


def default_codec(spark: SparkSession):
    import public_tokenizers

    return codec(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the bytes decoded from them, as digests."""
    shared = default_codec(session(spark))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_decode(docs, shared)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
