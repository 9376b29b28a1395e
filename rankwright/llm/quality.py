"""Quality rules with compression bands.

Base rules count words, symbols, duplicate lines and words in repeated windows over whole texts.
The compression rule compares zstandard ratios (raw bytes to compressed bytes) of the whole text
and of fixed chunks with limits that depend on the length: too high is repetitive, too low is
incompressible.

Null and empty text has no words: all counts are 0 and the text fails the base rules. One row per
input row, repeated rows included; ties do not arise; other columns pass through, and output names
replace input columns of the same name. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwright.llm.common import session, table, text_bytes

_SPACES = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Limits of the compression rule.

    ``whole``: (bytes from, least ratio, most ratio), of the last line whose length is reached.
    ``chunk``: the same for chunks of ``chunk_bytes``; a text fails on chunks when over
    ``bad_share`` of them are outside. Texts under the first length are not judged.
    """

    level: int = 3
    chunk_bytes: int = 4096
    whole: tuple[tuple[int, float, float], ...] = ((64, 0.85, 3.0), (256, 1.1, 3.5), (1024, 1.4, 4.0), (8192, 1.5, 5.0))
    chunk: tuple[tuple[int, float, float], ...] = ((512, 1.1, 4.0), (2048, 1.4, 4.5))
    bad_share: float = 0.5


@dataclass(frozen=True)
class Rules:
    least_words: int = 20
    window: int = 8
    repeat_percent: int = 30
    bands: Bands = Bands()


def _limits(lines, n: int):
    found = None
    for start, low, high in lines:
        if n >= start:
            found = low, high
    return found


def _outside(size: int, packed: int, lines) -> bool:
    limits = _limits(lines, size)
    return limits is not None and not limits[0] <= size / packed <= limits[1]


def repeated_words(words: list[bytes], window: int) -> int:
    """Words inside any window of ``window`` words that occurs twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for j in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    if len(np.unique(mixed)) == n:
        return 0
    # hashes may collide: ids of the windows by doubling are exact
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    have, ranks = 1, ids
    while have < window:
        step = min(have, window - have)
        m = len(words) - have - step + 1
        ranks = np.unique(ranks[:m] * np.int64(ranks.max() + 1) + ranks[step : step + m], return_inverse=True)[1].astype(np.int64)
        have += step
    starts = np.flatnonzero(np.bincount(ranks)[ranks] > 1)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + window, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def judge(raw: bytes, rules: Rules, packer: zstandard.ZstdCompressor) -> tuple:
    words = raw.split()
    n = len(words)
    points = len(raw) - (np.frombuffer(raw, np.uint8) & 0xC0 == 0x80).sum() - (len(raw) - len(raw.translate(None, _SPACES)))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats = repeated_words(words, rules.window)
    failed = n < rules.least_words or 100 * repeats > rules.repeat_percent * n
    ratio, bad, chunks, kept = None, 0, 0, not failed
    if raw:
        packed = len(packer.compress(raw))
        ratio = len(raw) / packed
        size = rules.bands.chunk_bytes
        for at in range(0, len(raw), size):
            chunk = raw[at : at + size]
            if _limits(rules.bands.chunk, len(chunk)) is not None:
                chunks += 1
                bad += _outside(len(chunk), len(packer.compress(chunk)), rules.bands.chunk)
        kept = kept and not _outside(len(raw), packed, rules.bands.whole) and bad <= rules.bands.bad_share * chunks
    return n, int(points), symbols, len(lines) - len(set(lines)), repeats, failed, ratio, chunks, bad, kept


OUTPUTS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, n_chunks long, n_bad_chunks long, kept boolean")
_KINDS = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]


def quality(df: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Add the counts, ratios and verdicts of every whole text; ``text`` itself is dropped."""
    names = [x.split()[0] for x in OUTPUTS.split(", ")]
    passed = [f for f in df.schema if f.name not in [*names, text]]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in passed), OUTPUTS])

    def run(batches):
        packer = zstandard.ZstdCompressor(level=rules.bands.level)
        for batch in batches:
            rows = [judge(x.as_py(), rules, packer) for x in batch.column(len(passed))]
            made = [pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)] if rows else [pa.array([], k) for k in _KINDS]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], *names])

    return df.select(*(f.name for f in passed), text_bytes(text).alias("_rankwright_text")).mapInArrow(run, schema)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    out = quality(table(session(spark), sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("ratio", 4).alias("ratio"))
