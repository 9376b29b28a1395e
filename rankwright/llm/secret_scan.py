"""Secrets in texts: fixed patterns, then how widely each value is held over repositories and owners.

Base kinds (assign, access, hex) are the leftmost matches of fixed patterns, those that fail their test dropped.
Candidates are the values of base finds and the bare tokens: maximal runs of ``[A-Za-z0-9+/_-]`` of 12 or more characters with
a letter and a digit that touch no base find. Every value, without marks at its ends, is hashed, and the hashes are counted over the whole
corpus: distinct repositories, distinct owners. A value of over ``most_owners`` owners or ``most_repos`` repositories is
a copied example, as is one that reads like a placeholder; what is left is specific to its owners and live-looking. Bare
tokens that are live-looking are added as spans of kind ``live`` if a base find somewhere holds the same value, or if they look like a key (20 to
128 characters, both cases and three digits, at least 12 distinct characters, no ``/``).

All of it is DataFrame and SQL expressions. Written tables hold hashes, not values. Hot values are counted through distinct (hash, owner,
repository) rows, summed before they are sent.

Null and empty text has no spans. A null owner is one owner of its own, and so is a null repository of each owner. Spans count code
points, end exclusive, and are sorted by start, then kind as listed above, ``live`` last. One row per input row, repeated rows included (they
count for one repository and owner); other columns pass through, whatever their names; an existing ``secrets`` is replaced. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankwright.llm.common import session, sized_join, table, written
from rankwright.llm.pii import matches

#: Java patterns; possessive counts and look-arounds change no match.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
BARE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{12,}+"
#: Marks at the ends of a value that are not part of it.
EDGES = r"^[+/_.=-]+|[+/_.=-]+$"
#: What placeholders hold.
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|redacted|your|xxxx|0000|1234567|abcdefg"
KINDS = ("assign", "access", "hex", "live")
LIVE = KINDS.index("live")


@dataclass(frozen=True)
class Ownership:
    """Most owners and repositories of a value that is specific to its owners."""

    most_owners: int = 5
    most_repos: int = 20


def _candidate(kind: int, x: Column, value: Column) -> Column:
    """(start, kind, end, digest, shape, plain) of a match; ``shape``: looks like a key, ``plain``: like a placeholder."""
    bare = F.regexp_replace(value, EDGES, "")
    many = F.size(F.array_distinct(F.split(bare, "")))
    shape = F.length(bare).between(20, 128) & bare.rlike("[a-z]") & bare.rlike("[A-Z]") & bare.rlike("[0-9].*[0-9].*[0-9]") & ~F.contains(bare, F.lit("/")) & (many >= 12)
    plain = bare.rlike(PLACEHOLDER) | (many < 4)
    return F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), F.unhex(F.md5(bare.cast("binary"))).alias("digest"), shape.alias("shape"), plain.alias("plain"))


def candidates(text: Column) -> Column:
    """Array of candidates: base finds and all bare tokens; ``text`` has no nulls."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    assigned = F.filter(matches(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 1)) >= 6)
    found = [
        F.transform(F.when(text.rlike(r"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]"""), assigned).otherwise(none), lambda x: _candidate(0, x, F.regexp_extract(x["value"], ASSIGN, 1))),
        F.transform(F.when(F.contains(text, F.lit("AKIA")), matches(text, ACCESS)).otherwise(none), lambda x: _candidate(1, x, x["value"])),
        F.transform(F.when(text.rlike(HEX), matches(text, HEX)).otherwise(none), lambda x: _candidate(2, x, x["value"])),
        F.transform(F.when(text.rlike(BARE), matches(text, BARE)).otherwise(none), lambda x: _candidate(LIVE, x, x["value"])),
    ]
    return F.concat(*found)


def apart(found: DataFrame) -> DataFrame:
    """``found`` (row, start, kind, end, ...) without the bare tokens that touch a base find of their row."""
    base = F.col("kind") < LIVE
    order = Window.partitionBy("row").orderBy("start", "kind")
    before = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(0, Window.unboundedFollowing))
    marked = found.withColumns({"before": before, "after": after})
    return marked.where(base | ~(F.coalesce(F.col("before") > F.col("start"), F.lit(False)) | F.coalesce(F.col("after") < F.col("end"), F.lit(False)))).drop("before", "after")


def ownership(found: DataFrame, how: Ownership = Ownership()) -> DataFrame:
    """(digest, n_owners, n_repos, live, known) of (digest, owner, repo, kind, plain): ``known`` if a base find holds it."""
    held = found.groupBy("digest", "owner", "repo").agg(F.max(F.col("kind") < LIVE).alias("known"), F.max("plain").alias("plain"))
    owned = held.groupBy("digest", "owner").agg(F.count("*").alias("repos"), F.max("known").alias("known"), F.max("plain").alias("plain"))
    counted = owned.groupBy("digest").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.max("known").alias("known"), F.max("plain").alias("plain"))
    live = (F.col("n_owners") <= how.most_owners) & (F.col("n_repos") <= how.most_repos) & ~F.col("plain")
    return counted.select("digest", "n_owners", "n_repos", live.alias("live"), "known")


def find_secrets(df: DataFrame, owner: Column, repo: Column, text: str = "text", how: Ownership = Ownership(), keep_text: bool = True) -> DataFrame:
    """``df`` with ``secrets``: array of (start, kind, end, live, n_owners, n_repos), base finds and added spans.

    Not ``keep_text``, the text goes; then it is read once and nothing of its size is written.
    """
    kept = [c for c in df.columns if c != "secrets" and (keep_text or c != text)]
    col = lambda c: F.col(f"`{c}`")
    rest = F.struct(*map(col, kept)) if kept else F.struct(F.lit(0))
    # numbers of rows that hold once they are written
    rows = df.select(F.monotonically_increasing_id().alias("row"), rest.alias("rest"), owner.cast("string").alias("owner"), repo.cast("string").alias("repo"), candidates(F.coalesce(col(text), F.lit(""))).alias("found"))
    rows = written(rows, "candidates")
    found = written(apart(rows.select("row", "owner", "repo", F.explode("found").alias("x")).select("row", "owner", "repo", "x.*")), "found")
    values = written(ownership(found, how), "values")
    judged = sized_join(found, values, "digest")
    base = F.col("kind") < LIVE
    kept_spans = judged.where(base | (F.col("live") & (F.col("known") | F.col("shape"))))
    span = F.struct("start", "kind", "end", "live", F.col("n_owners"), F.col("n_repos"))
    spans = kept_spans.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    out = F.transform(F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean,n_owners:bigint,n_repos:bigint>>")), lambda s: F.struct(s["start"].alias("start"), name(s).alias("kind"), s["end"].alias("end"), s["live"].alias("live"), s["n_owners"].alias("n_owners"), s["n_repos"].alias("n_repos")))
    return rows.select("row", "rest").join(spans, "row", "left").select(*(F.col("rest").getField(c).alias(c) for c in kept), out.alias("secrets"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of secrets in every document; a source is an owner, its documents of one language a repository."""
    docs = table(session(spark), sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = find_secrets(docs, F.col("source"), F.col("lang"), keep_text=False)
    of = lambda *kinds: F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    base = of(*KINDS[:LIVE])
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:LIVE]]
    live = F.size(F.filter("secrets", lambda s: s["live"])).cast("long")
    return out.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), live.alias("n_live"))


#: Starts are the running lengths of what is between the matches.
SQL_OP11 = r"""
WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, source AS owner, lang AS repo FROM documents),
patterns(kind, name, p) AS (VALUES
  (0, 'assign', '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
  (1, 'access', 'AKIA[A-Z0-9]{16,}'), (2, 'hex', '[0-9a-f]{24,}'), (3, 'live', '[A-Za-z0-9+/_-]{12,}')),
parts AS (
  SELECT r, kind, unnest(regexp_extract_all(text, p)) AS m, unnest(string_split_regex(text, p)) AS gap, generate_subscripts(string_split_regex(text, p), 1) AS i
  FROM texts, patterns WHERE regexp_matches(text, p)),
placed AS (SELECT *, sum(length(gap) + coalesce(length(m), 0)) OVER (PARTITION BY r, kind ORDER BY i) AS stop FROM parts),
valued AS (
  SELECT r, kind, (stop - length(m))::BIGINT AS start, stop::BIGINT AS stop,
    CASE WHEN kind = 0 THEN regexp_extract(m, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1) ELSE m END AS v
  FROM placed WHERE m IS NOT NULL),
trimmed AS MATERIALIZED (
  SELECT *, regexp_replace(v, '^[+/_.=-]+|[+/_.=-]+$', '', 'g') AS x FROM valued
  WHERE (kind <> 0 OR length(v) >= 6) AND (kind <> 3 OR (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')))),
found AS MATERIALIZED (
  SELECT t.*, owner, repo FROM trimmed t JOIN texts USING (r)
  WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM trimmed b WHERE b.r = t.r AND b.kind < 3 AND b.start < t.stop AND t.start < b.stop)),
owned AS (SELECT x, count(DISTINCT coalesce('=' || owner, '')) AS n_owners, count(DISTINCT (coalesce('=' || owner, ''), coalesce('=' || repo, ''))) AS n_repos, bool_or(kind < 3) AS known FROM found GROUP BY x),
judged AS (
  SELECT x, known, n_owners <= 5 AND n_repos <= 20 AND NOT regexp_matches(x, '(?i)example|sample|dummy|changeme|placeholder|redacted|your|xxxx|0000|1234567|abcdefg') AND len(list_distinct(string_split(x, ''))) >= 4 AS live,
    length(x) BETWEEN 20 AND 128 AND regexp_matches(x, '[a-z]') AND regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[0-9].*[0-9].*[0-9]') AND NOT contains(x, '/') AND len(list_distinct(string_split(x, ''))) >= 12 AS shape
  FROM owned),
spans AS (
  SELECT r, f.kind, start, live, name || ':' || start || ':' || stop AS s FROM found f JOIN judged USING (x) JOIN patterns USING (kind) WHERE f.kind < 3 OR (live AND (known OR shape)))
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY start, kind), '') AS spans, count(*) FILTER (live) AS n_live
FROM texts LEFT JOIN spans USING (r) GROUP BY r, doc_id
"""
