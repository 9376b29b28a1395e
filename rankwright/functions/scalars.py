"""Projections and scalar functions; missing is null throughout."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name suffixes.
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")


def number(c: Column) -> Column:
    """a number, missing if it cannot be read or is NaN."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def season_of(ts: Column, first_month: int = 9) -> Column:
    """the year a season ends in."""
    return F.year(ts) + (F.month(ts) >= first_month).cast("int")


def clock_seconds(c: Column) -> Column:
    """seconds of an ISO clock ``PT#M#S``; missing if it is none."""
    m, s = F.regexp_extract(c, r"^PT(\d+)M([\d.]+)S$", 1), F.regexp_extract(c, r"^PT(\d+)M([\d.]+)S$", 2)
    return F.when(m != "", m.try_cast("double") * 60 + s.try_cast("double"))


@cache
def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """What is left of each character beyond ASCII, decomposed for compatibility: those of one letter or space, and those of more."""
    one, more = {}, {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        if not unicodedata.decomposition(c):
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c).lower() if "a" <= x <= "z" or x == " ")
        if plain:
            (one if len(plain) == 1 else more)[c] = plain
    return one, more


def normal_name(c: Column) -> Column:
    """folded, lower-cased name of letters and single spaces, without suffixes.

    All characters that decompose for compatibility are folded, those into several letters (ligatures, units) too.
    """
    one, more = _folds()
    expansions = F.create_map(*(F.lit(x) for pair in more.items() for x in pair))
    # names with such a character are few; only they are taken apart
    apart = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(expansions, x), x)), "")
    whole = F.when(c.rlike("[" + "".join(more) + "]"), apart).otherwise(c)
    # a plain ASCII name is not looked through for them
    folded = F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(whole, "".join(one), "".join(one.values()))).otherwise(c)
    plain = F.regexp_replace(F.lower(folded), "[^a-z ]", "")
    return F.array_join(F.filter(F.split(plain, " +"), lambda t: (t != "") & ~t.isin(*SUFFIXES)), " ")


def last_token(c: Column) -> Column:
    """F5."""
    return F.element_at(F.split(c, " "), -1)


def first_token(c: Column) -> Column:
    """F5."""
    return F.element_at(F.split(c, " "), 1)


#: Fixed value: codes that stand for several teams.
AGGREGATE_TEAM = r"^(TOT|\dTM)$"


def is_aggregate_team(c: Column) -> Column:
    """whether a team code stands for several teams."""
    return F.coalesce(c.rlike(AGGREGATE_TEAM), F.lit(False))


def decade(year: Column, first: int = 1950) -> Column:
    """the decade label; earlier years fall into the first decade."""
    return F.concat(F.greatest(F.floor(year / 10) * 10, F.lit(first)).cast("string"), F.lit("s"))


def short_decade(label: Column) -> Column:
    """a decade label without its century."""
    return F.substring(label, 3, 10)


def composite_id(*parts: Column) -> Column:
    """F8."""
    return F.concat_ws("_", *parts)


def year_from_id(c: Column) -> Column:
    """the leading number of the second-last part of an id."""
    found = F.regexp_extract(F.try_element_at(F.split(c, "_"), F.lit(-2)), r"^(\d+)", 1)
    return F.when(found != "", found.cast("int"))


def per_game(total: Column, games: Column, digits: int = 1) -> Column:
    """a rate whose denominator is one at least."""
    return F.bround(total / F.greatest(games, F.lit(1)), digits)


def half_even(c: Column) -> Column:
    """nullable integer, rounded half to even."""
    return F.bround(c, 0).cast("int")


def clip(c: Column, low=None, high=None) -> Column:
    """limits that keep missing missing."""
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def guardrail(rate: Column, mean: Column, band: float, least: float) -> Column:
    """a multiplier that falls as a rate drops under its mean."""
    return clip((rate - (mean - band)) / band, least, 1.0)


def true_shooting(points: Column, attempts: Column, free: Column, weight: float = 0.44) -> Column:
    """F16: missing if nothing was attempted."""
    tries = attempts + weight * free
    return F.when(tries > 0, points / (2 * tries))


def tier(rating: Column, bounds: Sequence[float], lowest: str = "below") -> Column:
    """the highest of ``bounds`` (descending) that a rating reaches, as ``<bound>+``; ``lowest`` if none."""
    out = F.when(rating.isNull(), None)
    for least in bounds:
        out = out.when(rating >= least, f"{least:g}+")
    return out.otherwise(lowest)


#: The bounds of rating tiers.
TIER_BOUNDS = (99, 90, 82, 74, 65)


def overall(total: Column, anchor: Column | int, low_total: int = 470, low: int = 78, least: int = 40, most: int = 99, fallback: int = 588) -> Column:
    """linear from (low_total, low) to (anchor, most), rounded half up; a bad anchor falls back."""
    a = anchor if isinstance(anchor, Column) else F.lit(anchor)
    a = F.when(a > low_total, a).otherwise(F.lit(fallback)).cast("double")
    x = F.floor(low + (total - low_total) * (most - low) / (a - low_total) + 0.5)
    return F.when(total.isNotNull(), F.least(F.greatest(x, F.lit(least)), F.lit(most)).cast("int"))


def strict_date(c: Column) -> Column:
    """a date written exactly as YYYY-MM-DD, else missing."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date"))


def day_number(day: Column, launch: Column) -> Column:
    """launch day is 1."""
    return F.datediff(day, launch) + 1


def top_share(pct: Column) -> Column:
    """"top n percent", shown from the middle up."""
    return F.when(pct >= 50, F.greatest(F.floor(100 - pct + 0.5), F.lit(1)).cast("int"))


def folded(c: Column) -> Column:
    """letters and digits only, lower-cased."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def perfect(ratings: Column, most: int = 99) -> Column:
    """an aggregate: whether a run has ratings and all of them are ``most``."""
    return F.coalesce(F.bool_and(F.coalesce(ratings == most, F.lit(False))), F.lit(False))


def row_text(*columns: Column) -> Column:
    """A text that differs for different rows: each value as its length and itself, a missing one as ``n``."""
    cell = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("n"))
    return F.concat_ws("|", *map(cell, columns))


def by_last_name(name: Column) -> list[Column]:
    """sort keys: the last word of a name, then the whole name."""
    return [F.element_at(F.split(F.trim(name), r"\s+"), -1), name]
