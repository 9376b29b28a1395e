"""URL filters with trust and distrust over the host graph.

Rules block or allow a host, its subdomains and the paths under a prefix; the longest rule wins.
Pages without a rule get the verdict of their host: personalised PageRank from hosts with allowed
pages (trust, along the links) against that from hosts with blocked pages (distrust, against the
links). A host is blocked when its distrust is over ``ratio`` times its trust.

Edges between hosts are links in the page (absolute or protocol-relative ``href``) and membership:
a host and the domain right above it, of two labels or more, are linked both ways. Links within a
host carry nothing.

Null urls and urls without ``://`` have empty host and path, no rule and the verdict ``allow``, as
has a host that neither rank reaches. Ties (distrust equal to ratio times trust) are allowed. One row
per input row, repeated rows included; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwright.llm.common import fresh, table, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (size, verdict, rule) of the longest rule that fits; null if none does.

    The rules are few and inlined; ``rules`` over a thousand belong into a joined table.
    """
    if len(rules) > 1000:
        raise ValueError("too many rules to inline")
    found = []
    for verdict, h, p in rules:
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found.append(F.when(fits, F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))))
    return F.greatest(*found) if len(found) > 1 else found[0]


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst, weight) between hosts; ``pages`` has host and html."""
    linked = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/"'?#\s>]+)"""), F.lit(1))).alias("dst"))
    linked = linked.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    # the domains above each host, host included: a.b.c gives a.b.c and b.c
    hosts = pages.where("host <> ''").select("host").union(linked.select("dst")).distinct()
    labels = F.split("host", r"\.")
    chain = hosts.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("low")).distinct()
    above = F.expr("substring(low, instr(low, '.') + 1, length(low))")
    upward = chain.where("size(split(low, '[.]')) >= 3").select(F.col("low").alias("src"), above.alias("dst"), F.lit(1.0).alias("weight"))
    both = upward.union(upward.select("dst", "src", "weight"))
    return linked.union(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = 10, damping: float = 0.85, cut_every: int = 5) -> DataFrame:
    """(host, rank): personalised PageRank from ``seeds`` (host, mass; mass sums to 1) along ``edges``.

    Mass at hosts without links out leaves the graph. The lineage is cut by written tables.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    shares = written(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "shares")
    base = seeds.select("host", (F.col("mass") * (1 - damping)).alias("rank"))
    ranks = base
    for k in range(rounds):
        moved = shares.join(ranks, shares["src"] == ranks["host"]).select(F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
        ranks = moved.union(base).groupBy("host").agg(F.sum("rank").alias("rank"))
        if k % cut_every == cut_every - 1:
            ranks = written(ranks, "ranks")
    return ranks


def host_verdicts(pages: DataFrame, rounds: int = 10, damping: float = 0.85, ratio: float = 1.0) -> DataFrame:
    """(host, trust, distrust, host_verdict) of all hosts; ``pages`` has host, html and the rule's ``found``."""
    edges = written(host_edges(pages), "edges")
    counts = written(pages.where("host <> ''").groupBy("host").agg(F.count_if(F.expr("found.verdict = 'allow'")).alias("good"), F.count_if(F.expr("found.verdict = 'block'")).alias("bad")), "hosts")
    totals = counts.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    seeds = lambda name: counts.where(F.col(name) > 0).select("host", (F.col(name) / F.lit(float(totals[name] or 1))).alias("mass"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    trust = propagate(edges, seeds("good"), rounds, damping).withColumnRenamed("rank", "trust")
    distrust = propagate(back, seeds("bad"), rounds, damping).withColumnRenamed("rank", "distrust")
    both = counts.select("host").join(trust, "host", "left").join(distrust, "host", "left").na.fill(0.0)
    # by a relative margin, so that neither the order of summing nor the number of seed pages decides
    worse = F.col("distrust") > F.col("trust") * ratio * (1 + 1e-9)
    return both.withColumn("host_verdict", F.when(worse, "block").otherwise("allow"))


def judge_urls(pages: DataFrame, rules=RULES, url: str = "url", html: str = "html", **how) -> DataFrame:
    """Add host, path, rule, verdict, trust and distrust to every row of ``pages``; html goes."""
    host, path = host_and_path(F.col(url))
    kept = [c for c in pages.columns if c not in (html, "host", "path", "rule", "verdict", "trust", "distrust")]
    source, found, of_host = (fresh(pages, x) for x in ("_html", "found", "host_verdict"))
    parsed = pages.select(*kept, F.col(html).alias(source), host.alias("host"), path.alias("path")).withColumn(found, rule_for(F.col("host"), F.col("path"), rules))
    verdicts = written(host_verdicts(parsed.select("host", F.col(source).alias("html"), F.col(found).alias("found")), **how), "verdicts").withColumnRenamed("host_verdict", of_host)
    judged = parsed.drop(source).join(verdicts, "host", "left")
    return judged.select(*kept, "host", "path", F.col(f"{found}.rule").alias("rule"), F.coalesce(f"{found}.verdict", of_host, F.lit("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")
