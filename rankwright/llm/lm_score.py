"""Cross-entropy difference between a target and a background language model.

Both are bigram models over one vocabulary, that of the whole table, and are matched: the same Dirichlet
smoothing from pairs to words and from words to the uniform, and background counts scaled to the target's
size. The background is the whole table; the target is the texts marked as such. A document's score is the
mean over its words of the target model's loss less the background model's: lower is closer to the target.
What a document itself adds to either model is taken out before it is scored, so none is judged by its own
counts. Words are lower-cased (A-Z). The first word's context is a start mark, seen as often as all words;
any other context is seen as often as its word.

All words and pairs are counted, as 64-bit hashes; nothing that is gathered is bounded by a constant. Texts are
packed into blocks. A block asks for its distinct words and pairs, dealt by ranges of the hash; each range sums what
the blocks have and answers with totals in the order asked; blocks are scored from their answers. So
a word that is in every text is one entry per block.

Null and empty text has no words and a null score. One row per input row, repeated rows included;
equal texts of equal mark get equal scores; other columns pass through, output names replace input columns of
the same name. With an empty target its model is the uniform and the background's has words only. An empty
table gives an empty table.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from rankwright.llm.common import fresh, session, shuffle_partitions, sized_join, table, text_bytes, written

#: Text bytes of a block, unless one text is longer, and ranges per shuffle partition.
BLOCK_BYTES, RANGES = 4 << 20, 8
_RESULTS = [("n_tokens", T.LongType()), ("target_loss", T.DoubleType()), ("background_loss", T.DoubleType()), ("score", T.DoubleType())]


@dataclass(frozen=True)
class Shape:
    pair_weight: float = 50.0
    word_weight: float = 0.01


def word_ids(raw: bytes) -> np.ndarray:
    """Hashes of the lower-cased words, never 0, after the start mark 0."""
    words = raw.lower().split()
    out = np.zeros(len(words) + 1, np.uint64)
    out[1:] = np.maximum(np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)), np.uint64(1))
    return out


def pair_ids(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (context * np.uint64(0x9E3779B97F4A7C15)) ^ (context >> np.uint64(29))
    h = (h + word) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Block:
    """The words of a block's texts: a row per occurrence, with its text, and the distinct words and pairs."""

    def __init__(self, texts: list[bytes], marks: list[bool]):
        ids = [word_ids(x) for x in texts]
        self.sizes = np.array([len(x) - 1 for x in ids], np.int64)
        self.text = np.repeat(np.arange(len(texts)), self.sizes)
        self.marked = np.array(marks, bool)[self.text] if texts else np.empty(0, bool)
        none = np.empty(0, np.uint64)
        self.word = np.concatenate([x[1:] for x in ids]) if ids else none
        self.context = np.concatenate([x[:-1] for x in ids]) if ids else none
        self.words, self.word_at = np.unique(self.word, return_inverse=True)
        self.pairs, self.pair_at = np.unique(pair_ids(self.context, self.word), return_inverse=True)

    def counts(self, at: np.ndarray, n: int) -> list[np.ndarray]:
        """How often each of ``n`` distinct ones occurs, in all and in marked texts."""
        return [np.bincount(at, minlength=n).astype(np.uint64), np.bincount(at[self.marked], minlength=n).astype(np.uint64)]

    def own(self, at: np.ndarray, n: int) -> np.ndarray:
        """How often each occurrence's word or pair is in its own text."""
        _, back, counts = np.unique(self.text * max(1, n) + at, return_inverse=True, return_counts=True)
        return counts[back]


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of one length, byte by byte of all values."""
    return np.concatenate([c.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.reshape(-1) for c in columns]).tobytes()


def _unpacked(raw: bytes, n: int, k: int, at: int = 0) -> list[np.ndarray]:
    return [np.frombuffer(raw, np.uint8, 8 * n, at + 8 * n * i).reshape(8, n).T.copy().reshape(-1).view(np.uint64) for i in range(k)]


def packed_blocks(df: DataFrame, text: str, mark: str) -> DataFrame:
    """(block, tokens, target_tokens, data): rows packed as Arrow streams."""
    at, marked = df.columns.index(text), df.columns.index(mark)

    def run(batches):
        for batch in batches:
            texts, start, size, tokens, target = batch.column(at), 0, 0, 0, 0
            for i in range(batch.num_rows):
                raw = texts[i].as_py() or b""
                n = len(raw.split())
                size, tokens, target = size + len(raw), tokens + n, target + n * int(batch.column(marked)[i].as_py())
                if size >= BLOCK_BYTES or i == batch.num_rows - 1:
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                        out.write_batch(batch.slice(start, i + 1 - start))
                    yield pa.RecordBatch.from_pydict({"block": pa.array([uuid.uuid4().int >> 65], pa.int64()), "tokens": pa.array([tokens], pa.int64()), "target_tokens": pa.array([target], pa.int64()), "data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
                    start, size, tokens, target = i + 1, 0, 0, 0

    return df.mapInArrow(run, "block long, tokens long, target_tokens long, data binary")


def _block_of(data: bytes, text: int, mark: int) -> tuple[pa.RecordBatch, Block]:
    rows = pa.ipc.open_stream(data).read_next_batch()
    return rows, Block([x or b"" for x in rows.column(text).to_pylist()], rows.column(mark).to_pylist())


def asked(blocks: DataFrame, ranges: int, text: int, mark: int) -> DataFrame:
    """(range, block, data): the distinct words and pairs of each block with their counts, by ranges of the hash."""
    bounds = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                _, block = _block_of(data.as_buffer(), text, mark)
                kinds = [(block.words, block.counts(block.word_at, len(block.words))), (block.pairs, block.counts(block.pair_at, len(block.pairs)))]
                cuts = [np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]]) for keys, _ in kinds]
                out = []
                for r in range(ranges):
                    parts, sizes = [], []
                    for (keys, counts), cut in zip(kinds, cuts):
                        a, b = int(cut[r]), int(cut[r + 1])
                        sizes.append(b - a)
                        parts.append(_packed(np.diff(keys[a:b], prepend=np.uint64(0)), *(c[a:b] for c in counts)))
                    if any(sizes):
                        out.append((r, np.array(sizes, np.uint32).tobytes() + pack.compress(b"".join(parts))))
                if out:
                    yield pa.RecordBatch.from_pydict({"range": pa.array([x[0] for x in out], pa.int32()), "block": pa.array([name] * len(out), pa.int64()), "data": pa.array([x[1] for x in out], pa.binary())})

    return blocks.select("block", "data").mapInArrow(run, "range int, block long, data binary")


def _totals(keys: list[np.ndarray], counts: list[list[np.ndarray]]) -> tuple[int, list[list[np.ndarray]]]:
    """How many distinct keys there are, and for each list of keys the sums over all lists."""
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = every[order][1:] != every[order][:-1]
    group, starts = np.cumsum(new) - 1, np.flatnonzero(new)
    out = []
    for column in zip(*counts):
        sums = np.empty(len(order), np.uint64)
        sums[order] = np.add.reduceat(np.concatenate(column)[order], starts)[group] if len(order) else sums
        out.append(np.split(sums, np.cumsum([len(k) for k in keys])[:-1]))
    return len(starts), [list(x) for x in zip(*out)]


def answered(requests: DataFrame) -> DataFrame:
    """(block, range, words, data): totals in the order asked; ``words`` is the range's distinct words, told once."""
    dealt = requests.repartition(shuffle_partitions(requests.sparkSession), "range").sortWithinPartitions("range")

    def answers(name, held):
        pack, unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        kinds: list[tuple[list, list]] = [([], []), ([], [])]
        for _, data in held:
            sizes = np.frombuffer(data, np.uint32, 2)
            raw, at = unpack.decompress(data[8:]), 0
            for (keys, counts), n in zip(kinds, sizes.tolist()):
                steps, *own = _unpacked(raw, n, 3, at)
                keys.append(np.cumsum(steps, dtype=np.uint64))
                counts.append(own)
                at += 24 * n
        (n_words, words), (_, pairs) = (_totals(*kind) for kind in kinds)
        made = [pack.compress(_packed(*w) + _packed(*p)) for w, p in zip(words, pairs)]
        return pa.RecordBatch.from_pydict({"block": pa.array([b for b, _ in held], pa.int64()), "range": pa.array([name] * len(held), pa.int32()), "words": pa.array([n_words] + [0] * (len(held) - 1), pa.int64()), "data": pa.array(made, pa.binary())})

    def run(batches):
        at, held = None, []
        for batch in batches:
            for name, block, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if name != at:
                    if held:
                        yield answers(at, held)
                    at, held = name, []
                held.append((block, data))
        if held:
            yield answers(at, held)

    return dealt.mapInArrow(run, "block long, range int, words long, data binary")


@dataclass(frozen=True)
class Size:
    """What both models need of the whole table."""

    words: int
    background: int
    target: int


def _losses(block: Block, words: list[np.ndarray], pairs: list[np.ndarray], size: Size, shape: Shape) -> list[np.ndarray]:
    """Loss of each occurrence under the target and the background, its own text left out of both."""
    own_word, own_pair = block.own(block.word_at, len(block.words)), block.own(block.pair_at, len(block.pairs))
    length = block.sizes[block.text]
    first = block.context == 0
    # the word before an occurrence is the one of the row before it
    before = np.where(first, 0, np.arange(len(block.word)) - 1)
    out = []
    for k, whole, held in ((1, size.target, block.marked.astype(np.int64)), (0, size.background, np.ones(len(length), np.int64))):
        total = whole - length * held
        word = words[k].astype(np.int64)[block.word_at] - own_word * held
        pair = pairs[k].astype(np.int64)[block.pair_at] - own_pair * held
        seen = np.where(first, total, word[before])
        scale = 1.0 if k else size.target / max(1, size.background)
        alone = (word + shape.word_weight) / (total + shape.word_weight * max(1, size.words))
        out.append(-np.log((scale * pair + shape.pair_weight * alone) / (scale * seen + shape.pair_weight)))
    return out


def score(df: DataFrame, is_target: Column, text: str = "text", shape: Shape = Shape()) -> DataFrame:
    """Add n_tokens, target_loss, background_loss and score; ``text`` is dropped."""
    ranges = RANGES * shuffle_partitions(df.sparkSession)
    names = [name for name, _ in _RESULTS]
    passed = [f for f in df.schema if f.name not in [*names, text]]
    raw, mark = fresh(df, "_raw"), fresh(df, "_mark")
    rows = df.select(*(f.name for f in passed), text_bytes(text).alias(raw), F.coalesce(is_target, F.lit(False)).alias(mark))
    text_at, mark_at = len(passed), len(passed) + 1
    blocks = written(packed_blocks(rows, raw, mark), "blocks")
    answers = written(answered(asked(blocks, ranges, text_at, mark_at)), "answers")
    known = blocks.agg(F.sum("tokens").alias("tokens"), F.sum("target_tokens").alias("target")).first()
    size = Size(answers.agg(F.sum("words")).first()[0] or 0, known.tokens or 0, known.target or 0)
    lists = answers.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("range", "data"))).alias("answers"))
    joined = blocks.select("block", "data").join(lists, "block", "left").select("data", F.coalesce(F.col("answers.data"), F.array().cast("array<binary>")).alias("answers"))

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for data, answers in zip(batch.column(0), batch.column(1)):
                rows, block = _block_of(data.as_buffer(), text_at, mark_at)
                found, cuts = [], [0, 0]
                bounds = np.array([(i << 64) // ranges for i in range(1, ranges)] + [(1 << 64) - 1], np.uint64)
                ends = [np.concatenate([np.searchsorted(keys, bounds[:-1]), [len(keys)]]) for keys in (block.words, block.pairs)]
                parts = iter(answers)
                for r in range(ranges):
                    sizes = [int(e[r]) - c for e, c in zip(ends, cuts)]
                    cuts = [int(e[r]) for e in ends]
                    if any(sizes):
                        raw = unpack.decompress(next(parts).as_buffer())
                        found.append(_unpacked(raw, sizes[0], 2) + _unpacked(raw, sizes[1], 2, 16 * sizes[0]))
                words_all, words_target, pairs_all, pairs_target = (np.concatenate(x) for x in zip(*found)) if found else [np.empty(0, np.uint64)] * 4
                losses = _losses(block, [words_all, words_target], [pairs_all, pairs_target], size, shape)
                n = block.sizes
                target, background = (np.bincount(block.text, x, len(n)) / np.maximum(n, 1) for x in losses)
                none = n == 0
                made = [pa.array(n), *(pa.array(x, mask=none) for x in (target, background, target - background))]
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(passed)], *made], [*(f.name for f in passed), *names])

    return joined.mapInArrow(run, T.StructType([*passed, *(T.StructField(*x) for x in _RESULTS)]))


def labelled_good(labels: DataFrame) -> DataFrame:
    """Ids of all documents labelled good."""
    return labels.where("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id").distinct()


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; the target is all documents labelled good."""
    docs = table(session(spark), sf_dir, "documents").select("doc_id", "text")
    good = written(labelled_good(table(spark, sf_dir, "labels")).withColumn("_target", F.lit(True)), "good")
    out = score(sized_join(docs, good, "doc_id"), F.col("_target"))
    return out.select("doc_id", "n_tokens", F.round("target_loss", 6).alias("target_loss"), F.round("background_loss", 6).alias("background_loss"), F.round("score", 6).alias("score"))
