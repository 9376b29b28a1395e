"""Personal data in texts: base patterns, then bootstrapped contextual extraction.

Base kinds (email, ip, card, phone) are the leftmost matches of fixed patterns, those that fail
their test dropped. The contextual method starts from seed entities (the base finds and key-like
tokens of known shape). The lexical cue right before a seed, such as ``password=``, is a pattern;
patterns and the tokens that follow them form a graph. Round by round, until nothing changes, a pattern is
scored by the share of its instances that are known, and an instance by the patterns that hold it;
what high-confidence patterns hold becomes known, and is a span of kind ``secret``.

All of it is DataFrame and SQL expressions. Only texts that can match a pattern are given to it.

Null and empty text has no spans. Spans count code points, end exclusive. One row per input row,
repeated rows included; other columns pass through, output names replace input columns of the same
name. Added spans never overlap base spans. Ties in scores decide alike for all instances. An empty
table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwright.llm.common import fresh, session, table, written

#: Java patterns. The look-behinds and possessive counts change no match; they keep long runs linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A cue (a word and a mark that binds it to what follows) and the token after it.
CUED = r"""(?<![A-Za-z_])([A-Za-z_]{2,24}+["']?+\x20?+[=:#]\x20?+["']?+)([A-Za-z0-9+/_.@-]{6,}+)"""
#: What every text with a cue and a token holds.
CAN_CUE = r"""[=:#]\x20?["']?[A-Za-z0-9+/_.@-]{6}"""
#: Shapes of tokens that are taken as seeds where they follow a cue.
SEED_SHAPES = r"^(?:[0-9a-f]{32,}|AKIA[0-9A-Z]{16})$"
#: Matches that are folded at a time.
BLOCK = 64
KINDS = ("email", "ip", "card", "phone")
_BYTE = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"


@dataclass(frozen=True)
class Bootstrap:
    """Most rounds, what makes a pattern trusted (distinct known instances and their share), and how many
    trusted patterns (of 30 letters at most each) go to all tasks; more are joined."""

    rounds: int = 10
    least_known: int = 5
    least_share: float = 0.5
    least_instance: float = 0.5
    most_patterns: int = 1000


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as array of (start, end, value), in code points.

    The text is split at the matches; starts are the running lengths of gaps and matches, summed over
    blocks of ``BLOCK`` matches and then within each, so that a fold never copies a long array.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    return _let(F.arrays_zip(gaps.alias("gap"), values.alias("value")), lambda both: _let(_blocks(both), _placed))


def _let(x: Column, body) -> Column:
    """``body`` of ``x``, which is computed once however often ``body`` refers to it."""
    return F.transform(F.array(x), body)[0]


def _blocks(xs: Column) -> Column:
    last = F.floor((F.size(xs) - 1) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(xs, i * BLOCK + 1, BLOCK))


def _placed(blocks: Column) -> Column:
    """Structs of start, end and value from blocks of (gap, value), the last of which has no value."""
    sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + F.coalesce(F.length(x["value"]), F.lit(0))))
    none = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out"))
    starts = F.aggregate(sizes, none, lambda acc, n: F.struct((acc["pos"] + n).alias("pos"), F.concat(acc["out"], F.array(acc["pos"])).alias("out")), lambda acc: acc["out"])

    def step(acc, x):
        at = acc["pos"] + x["gap"]
        end = at + F.length(x["value"])
        return F.when(x["value"].isNull(), acc).otherwise(F.struct(end.alias("pos"), F.concat(acc["out"], F.array(F.struct(at.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out")))

    within = lambda b, start: F.aggregate(b, F.struct(start.alias("pos"), _none().alias("out")), step, lambda acc: acc["out"])
    return _let(starts, lambda at: F.flatten(F.transform(blocks, lambda b, i: within(b, at[i]))))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    ds = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    doubled = F.transform(ds, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _none() -> Column:
    return F.array().cast("array<struct<start:int,end:int,value:string>>")


def base_spans(text: Column) -> dict[str, Column]:
    """Base spans by kind; ``text`` has no nulls."""
    ip_ok = lambda x: F.forall(F.split(x["value"], r"\."), lambda p: p.rlike(_BYTE))
    digits = lambda x: F.regexp_replace(x["value"], "[^0-9]", "")
    card_ok = lambda x: F.length(digits(x)).between(16, 19) & luhn(digits(x))
    phone_ok = lambda x: F.length(digits(x)).between(8, 15)
    return {
        "email": F.when(F.contains(text, F.lit("@")), matches(text, EMAIL)).otherwise(_none()),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), F.filter(matches(text, IP), ip_ok)).otherwise(_none()),
        "card": F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), F.filter(matches(text, CARD), card_ok)).otherwise(_none()),
        "phone": F.when(text.rlike(r"\+[0-9]"), F.filter(matches(text, PHONE), phone_ok)).otherwise(_none()),
    }


def cued_tokens(text: Column) -> Column:
    """Array of (start, end, value) of cue and token together."""
    return F.when(text.rlike(CAN_CUE), matches(text, CUED)).otherwise(_none())


def _tokens(base: Column, cued: Column) -> Column:
    """Structs of cue, value, start, end (of the token), is_base and seed. The token starts where the cue ends.

    A token that overlaps a base span is the seed instance of its cue.
    """
    parts = F.transform(cued, lambda x: F.struct(F.regexp_extract(x["value"], CUED, 1).alias("cue"), F.regexp_extract(x["value"], CUED, 2).alias("value"), x["start"].alias("start"), x["end"].alias("end")))
    placed = F.transform(parts, lambda x: F.struct(F.lower(x["cue"]).alias("cue"), x["value"].alias("value"), (x["start"] + F.length(x["cue"])).alias("start"), x["end"].alias("end")))

    def marked(x):
        hit = F.exists(base, lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"]))
        return _let(hit, lambda h: F.struct(*(x[c].alias(c) for c in ("cue", "value", "start", "end")), h.alias("is_base"), (h | x["value"].rlike(SEED_SHAPES)).alias("seed")))

    return F.transform(placed, marked)


def _as_kind(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _base(text: Column) -> Column:
    return F.concat(*(_as_kind(k, x) for k, x in base_spans(text).items()))


def tagged(text: Column) -> Column:
    """Struct of base, the (kind, start, end) in order of kind and start, and tokens (``_tokens``); ``text`` has no nulls."""
    return _let(F.struct(_base(text).alias("base"), cued_tokens(text).alias("cued")), lambda s: F.struct(s["base"].alias("base"), _tokens(s["base"], s["cued"]).alias("tokens")))


def trusted_patterns(edges: DataFrame, how: Bootstrap = Bootstrap()) -> DataFrame:
    """(cue, score) of the high-confidence patterns of (cue, value, seed) edges.

    Each round: patterns are scored by their known instances, the trusted ones make their
    instances known with one minus the product of the patterns' doubts. The rounds end when one
    changes no score of a trusted pattern (beliefs only rise, so none is lost), or after ``how.rounds``.
    """
    edges = written(edges.groupBy("cue", "value").agg(F.max("seed").alias("seed")), "edges")
    known = edges.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("belief"))
    trusted, before = None, None
    for _ in range(how.rounds):
        scored = edges.join(known, "value").groupBy("cue").agg(F.avg("belief").alias("score"), F.count_if(F.col("belief") >= how.least_instance).alias("n_known"))
        trusted = written(scored.where((F.round("score", 9) >= how.least_share) & (F.col("n_known") >= how.least_known)).select("cue", F.round("score", 9).alias("score")), "patterns")
        state = trusted.agg(F.count("*"), F.bit_xor(F.xxhash64("cue", "score"))).first()
        if state == before or not state[0]:
            break
        before = state
        doubt = F.sum(F.log(F.greatest(1 - F.coalesce("score", F.lit(0.0)), F.lit(1e-6))))
        believed = edges.join(trusted, "cue", "left").groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("seed"), (1 - F.exp(doubt)).alias("found"))
        known = written(believed.select("value", F.greatest("seed", "found").alias("belief")), "known")
    return trusted


def with_pii(df: DataFrame, text: str = "text", row: tuple[str, ...] = ("doc_id",), how: Bootstrap = Bootstrap()) -> DataFrame:
    """``df`` with the column ``pii``: array of (kind, start, end) in order of kind and start, added spans last.

    One pass over the texts that hold a cue gives the edges, a second one over all texts the spans. Up to ``how.most_patterns``
    trusted patterns go to it as a set of literals, so that no text is shuffled. More are joined with the tokens;
    ``row`` names the columns that, with the text, then spread equal texts over the join.
    """
    kept, filled = [c for c in df.columns if c != "pii"], fresh(df, "_text")
    raw = df.select(*kept, F.coalesce(text, F.lit("")).alias(filled))
    spans = tagged(F.col(filled))
    edges = raw.where(F.col(filled).rlike(CAN_CUE)).select(F.explode(spans["tokens"]).alias("x")).select("x.cue", "x.value", "x.seed")
    trusted = trusted_patterns(edges, how)
    few = [r.cue for r in trusted.select("cue").limit(how.most_patterns + 1).collect()]
    if len(few) <= how.most_patterns:
        secret = lambda t: ~t["is_base"] & (t["cue"].isin(few) if few else F.lit(False))
        return raw.select(*kept, _let(spans, lambda s: F.concat(s["base"], _as_kind("secret", F.filter(s["tokens"], secret)))).alias("pii"))

    key, added = fresh(df, "_key"), fresh(df, "_added")
    keyed = raw.withColumn(key, F.sha2(F.concat_ws("\0", *(F.coalesce(F.col(c).cast("string"), F.lit("\1")) for c in row), filled), 256))
    tokens = keyed.where(F.col(filled).rlike(CAN_CUE)).select(F.col(key).alias("_key"), F.explode(spans["tokens"]).alias("x")).where("not x.is_base").select("_key", "x.cue", "x.start", "x.end")
    # equal keys are equal rows: their tokens count once
    found = tokens.join(trusted, "cue").groupBy(F.col("_key").alias(key)).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(added))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return keyed.join(found, key, "left").select(*kept, F.concat(_base(F.col(filled)), _as_kind("secret", F.coalesce(added, none))).alias("pii"))


def mask_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """Put ``<KIND>`` in place of every span of ``pii`` (where spans of kinds overlap, of their union).

    Spans are folded ``BLOCK`` at a time, each block over its own piece of the text.
    """
    cut = lambda acc, s, w: F.when(
        s["start"] < acc["pos"], F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), acc["out"].alias("out"))
    ).otherwise(F.struct(s["end"].alias("pos"), F.concat(acc["out"], F.substring(w["piece"], acc["pos"] - w["pos"] + 1, s["start"] - acc["pos"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("out")))

    def of_block(acc, spans):
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        piece = F.struct(acc["pos"].alias("pos"), F.substring(F.col(text), acc["pos"] + 1, F.greatest(F.lit(0), last - acc["pos"])).alias("piece"))
        masked = _let(piece, lambda w: F.aggregate(spans, F.struct(w["pos"].alias("pos"), F.lit("").alias("out")), lambda at, s: cut(at, s, w)))
        return _let(masked, lambda m: F.struct(m["pos"].alias("pos"), F.concat(acc["out"], F.array(m["out"])).alias("out")))

    ordered = F.array_sort(F.transform("pii", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    none = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))
    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col(text), acc["pos"] + 1, F.length(F.col(text))))
    done = _let(ordered, lambda xs: F.aggregate(_blocks(xs), none, of_block, rest))
    return df.withColumn(text, F.when(F.size("pii") > 0, done).otherwise(F.col(text)))


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of personal data in every document."""
    docs = table(session(spark), sf_dir, "documents").select("doc_id", "text")
    out = with_pii(docs).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["kind"].isin(*KINDS))
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long")
    return out.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("pii")).alias("spans"))
