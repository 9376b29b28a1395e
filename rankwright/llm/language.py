"""Language identification by fusing text likelihoods with web evidence.

Text: naive Bayes over hashed byte trigrams, trained on a bounded sample of labelled rows
(``sample_rows``); the evidence of long texts is tempered to ``most_evidence`` trigrams. Web
evidence of a row is optional: the language that its markup declares, its address suffix, its host.
Expected counts of languages by declaration, suffix, host and domain are grouped aggregates over
all rows; host priors are smoothed towards the domain's, and those towards the global one. A row's
own text is taken out of every count that it is judged by. The posterior multiplies what is known.

A row is kept when its best posterior reaches ``least_posterior`` and its text fits a known
language (mean log-likelihood of a trigram at least ``least_fit``). Null, empty and
blank text has no trigrams: language null, not kept. Ties go to the language first in alphabetical order. One row per
input row; an empty table gives an empty table; without labelled rows nothing is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwright.llm.common import byte_chunks, row_key, session, sized_join, table, text_bytes, written
from rankwright.llm.urls import host_and_path


@dataclass(frozen=True)
class Fusion:
    sample_rows: int = 4000
    feature_bits: int = 15
    most_evidence: float = 60.0
    host_weight: float = 20.0
    evidence_weight: float = 1.0
    least_posterior: float = 0.5
    least_fit: float = -13.0


def features(raw: bytes, bits: int) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text, with a space at either end; none if it is blank."""
    if not raw.strip():
        return np.empty(0, np.uint32)
    b = np.frombuffer(b" %b " % raw.lower(), np.uint8).astype(np.uint32)
    return ((b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(32 - bits)


def train(rows: DataFrame, bits: int) -> tuple[list[str], np.ndarray]:
    """Languages, and log-probabilities by language and feature, of (text bytes, lang) rows."""
    size = 1 << bits

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for x, lang in zip(batch.column(0), batch.column(1)):
                held = counts.setdefault(lang.as_py(), np.zeros(size, np.int64))
                held += np.bincount(features(x.as_py() or b"", bits), minlength=size)
        for lang, held in counts.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(held[at])], ["lang", "feature", "n"])

    counts = rows.mapInArrow(run, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts["lang"].to_pylist()))
    matrix = np.full((len(langs), size), 0.5)
    where = {x: i for i, x in enumerate(langs)}
    matrix[[where[x] for x in counts["lang"].to_pylist()], counts["feature"].to_numpy()] += counts["n"].to_numpy()
    return langs, np.log(matrix / matrix.sum(axis=1, keepdims=True)).astype(np.float32)


def text_evidence(df: DataFrame, model: np.ndarray, how: Fusion) -> DataFrame:
    """Replace ``_text`` by ``loglik`` (tempered, an element per language), ``fit`` and ``n_features``."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = [c for c in df.columns if c != "_text"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "_text")

    def run(batches):
        m = shared.value.T.copy()  # a row per feature
        for batch in batches:
            logs, fits, sizes = [], [], []
            for _, texts in byte_chunks(batch.column(len(names))):
                for raw in texts:
                    f = features(raw, how.feature_bits)
                    n = len(f)
                    mean = m[f].sum(axis=0, dtype=np.float64) / n if n else np.zeros(m.shape[1])
                    logs.append((mean * min(n, how.most_evidence)).tolist())
                    fits.append(float(mean.max()) if n else None)
                    sizes.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(logs, pa.list_(pa.float64())), pa.array(fits, pa.float64()), pa.array(sizes, pa.int64())], [*names, "loglik", "fit", "n_features"])

    return df.select(*names, "_text").mapInArrow(run, f"{kinds}, loglik array<double>, fit double, n_features long")


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, y: a + y))


def _sums(n: int, column: str = "p") -> list[Column]:
    return [F.sum(F.col(column)[i]).alias(f"n{i}") for i in range(n)]


def _array(n: int, name: str = "n") -> Column:
    return F.array(*(F.col(f"{name}{i}") for i in range(n)))


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _others(counts: Column) -> Column:
    """Counts without the row's own part in them."""
    return F.zip_with(counts, "own", lambda c, o: F.greatest(c - o, F.lit(0.0)))


def _smoothed(counts: Column, prior: Column, weight: float) -> Column:
    total = _total(counts)
    return F.zip_with(counts, prior, lambda c, p: (c + F.lit(weight) * p) / (total + weight))


def identify(scored: DataFrame, langs: list[str], how: Fusion = Fusion()) -> DataFrame:
    """Languages of the rows of ``text_evidence`` with declared, suffix, host and domain (may be null)."""
    keys = [c for c in scored.columns if c not in ("loglik", "fit", "n_features", "declared", "suffix", "host", "domain")]
    n = len(langs)
    none = F.lit(None)
    if not n:
        return scored.select(*keys, none.cast("string").alias("language"), none.cast("double").alias("posterior"), none.cast("double").alias("fit"), F.lit(False).alias("kept"))
    zeros = F.array(*[F.lit(0.0)] * n)
    p = F.when(F.col("n_features") > 0, _softmax(F.col("loglik")))
    place = F.when(F.col("host").isNotNull(), F.concat_ws("\0", "host", "domain"))
    scored = written(scored.withColumns({"p": p, "place": place}), "evidence")

    seen = scored.where("p is not null")
    overall = seen.agg(*_sums(n)).first()
    world = [(overall[i] or 0.0) + 1.0 for i in range(n)]
    # a place is a host with its domain, if it has one
    places = written(seen.where("place is not null").groupBy("place", "domain").agg(*_sums(n)), "places")
    domains = places.where("domain is not null").groupBy("domain").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(n)))
    domains = written(domains.select("domain", _array(n).alias("domain_n")), "domains")
    places = written(sized_join(places.select("place", "domain", _array(n).alias("place_n")), domains, "domain").drop("domain"), "places")

    def given(column: str) -> tuple[DataFrame, Column]:
        """Counts of each value of ``column``, and how likely a row's value is under each language, up to a factor."""
        counts = written(seen.where(f"{column} is not null").groupBy(column).agg(*_sums(n)), column)
        sums = counts.agg(F.count("*").alias("values"), *(F.sum(f"n{i}").alias(f"n{i}") for i in range(n))).first()
        least = how.evidence_weight
        rest = F.array(*(F.lit((sums[f"n{i}"] or 0.0) + least * ((sums["values"] or 0) + 1)) for i in range(n)))
        logs = F.zip_with(_others(F.col(f"{column}_n")), F.zip_with(rest, "own", lambda x, o: x - o), lambda c, x: F.log((c + least) / x))
        return written(counts.select(column, _array(n).alias(f"{column}_n")), column), F.coalesce(logs, zeros)

    declared, declared_logs = given("declared")
    suffix, suffix_logs = given("suffix")
    out = sized_join(sized_join(sized_join(scored, places, "place"), declared, "declared"), suffix, "suffix")
    out = out.withColumn("own", F.coalesce("p", zeros))
    everywhere = F.zip_with(F.array(*map(F.lit, world)), "own", lambda x, o: (x - o) / (F.lit(sum(world)) - _total(F.col("own"))))
    out = out.withColumn("everywhere", everywhere)
    out = out.withColumn("prior", F.coalesce(_smoothed(_others(F.col("domain_n")), F.col("everywhere"), how.host_weight), "everywhere"))
    out = out.withColumn("prior", F.coalesce(_smoothed(_others(F.col("place_n")), F.col("prior"), how.host_weight), "everywhere"))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    logs = add(F.col("loglik"), F.transform("prior", lambda x: F.log(x)))
    out = out.withColumn("logs", add(add(logs, declared_logs), suffix_logs))
    fused = F.transform(_softmax(F.col("logs")), lambda x: F.round(x, 9))
    out = out.withColumn("fused", F.when(F.col("n_features") > 0, fused)).withColumn("posterior", F.array_max("fused"))
    names = F.array(*map(F.lit, langs))
    # element_at of a null place is not null where no element is
    language = F.when(F.col("posterior").isNotNull(), F.element_at(names, F.array_position("fused", F.col("posterior")).cast("int")))
    kept = F.coalesce((F.col("posterior") >= how.least_posterior) & (F.col("fit") >= how.least_fit), F.lit(False))
    return out.select(*keys, language.alias("language"), "posterior", "fit", kept.alias("kept"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """(doc_id, declared, suffix, host, domain) of documents that were fetched as a page.

    The last part of a page's path, if it is a number, is the document's id; of several pages that
    with the smallest page_id counts.
    """
    host, path = host_and_path(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"), F.regexp_extract("html", r"""(?i)<html[^>]*?\slang\s*=\s*["']?([A-Za-z]{2,3})""", 1).alias("declared"))
    number = F.regexp_extract("path", r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    base = base.select("page_id", number.alias("number"), "host", F.lower("declared").alias("declared")).where("number <> '' and host <> ''")
    suffix = F.element_at(F.split("host", r"\."), -1)
    domain = F.array_join(F.slice(F.split("host", r"\."), -2, 2), ".")
    one = base.withColumn("page_id", F.coalesce("page_id", F.lit(2**63 - 1)))
    found = one.groupBy(F.col("number").cast("long").alias("doc_id")).agg(F.min(F.struct("page_id", "host", "declared")).alias("x")).select("doc_id", F.col("x.host").alias("host"), F.when(F.col("x.declared") != "", F.col("x.declared")).alias("declared"))
    return found.select("doc_id", "declared", suffix.alias("suffix"), "host", F.when(F.size(F.split("host", r"\.")) > 1, domain).alias("domain"))


def languages(docs: DataFrame, pages: DataFrame, how: Fusion = Fusion()) -> DataFrame:
    """(key, doc_id, language, posterior, fit, kept) of documents; the source stands in for a missing host."""
    labelled = docs.where("lang is not null and text is not null").select("doc_id").distinct()
    sample = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(how.sample_rows)
    rows = docs.join(F.broadcast(sample), "doc_id", "left_semi").where("lang is not null").select(text_bytes().alias("_text"), "lang")
    langs, model = train(rows, how.feature_bits)
    light = text_evidence(docs.select(row_key("doc_id", "source", "text").alias("key"), "doc_id", "source", text_bytes().alias("_text")), model, how)
    joined = light.join(page_evidence(pages), "doc_id", "left")
    return identify(joined.withColumn("host", F.coalesce("host", "source")).drop("source"), langs, how)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and verdict of every document."""
    return languages(table(session(spark), sf_dir, "documents"), table(spark, sf_dir, "pages")).select("doc_id", "language", F.round("posterior", 6).alias("posterior"), "kept")
