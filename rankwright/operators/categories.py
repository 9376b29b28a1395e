"""The six categories, from components to ratings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwright.functions import scalars
from rankwright.operators import ranking, shrink
from rankwright.operators.ranking import Rank

#: Weight of each part of a category. Defense and clutch take the best of several archetypes.
WEIGHTS = {
    "shooting": {"fg3_pct": 0.43, "ft_pct": 0.35, "score3": 0.22, "mid_range": 0.15},
    "scoring": {"pts_rate": 0.62, "usg": 0.08, "ts_eff": 0.14, "scoring_accolade": 0.16},
    "playmaking": {"ast_total": 0.31, "ast_pct": 0.28, "ast_security": 0.15, "creation_load": 0.18, "star_accolade": 0.08},
    "defense": {"def_accolade": 0.45, "box_best": 0.55},
    "clutch": {"clutch_best": 0.90, "clutch_accolade": 0.10},
    "rebounding": {"trb_pct": 0.42, "trb_total": 0.28, "oreb_pct": 0.10, "dreb_pct": 0.20},
}
#: The archetypes.
PERIMETER = {"stl_pct": 0.40, "stl_total": 0.20, "dbpm": 0.40}
INTERIOR = {"blk_pct": 0.40, "blk_total": 0.15, "drb_pct": 0.20, "dbpm": 0.25}
CLUTCH_BOX = {"po_pts": 0.60, "po_depth": 0.25, "po_retention": 0.15}
#: Components ranked within the season, and (zero rank, floor) of the sparse ones. The rest ranks over all.
WITHIN_SEASON = ("pts_rate", "usg", "ts_eff", "clutch_time", "po_pts")
SPARSE = {"def_accolade": (35.0, 70.0), "clutch_accolade": (38.0, 72.0), "clutch_shots": (38.0, 72.0), "scoring_accolade": (40.0, 72.0), "star_accolade": (40.0, 72.0)}
#: Backing volume and weight of the universe's mean, of components that are shrunk before they are ranked.
CREDIBILITY = {
    "ast_pct": ("mp", 400), "creation_load": ("mp", 400), "ast_security": ("ast_tov", 80), "stl_pct": ("mp", 700), "blk_pct": ("mp", 700), "dbpm": ("mp", 400),
    "trb_pct": ("mp", 300), "oreb_pct": ("mp", 300), "dreb_pct": ("mp", 300), "drb_pct": ("mp", 300), "po_retention": ("po_fga", 150),
}
#: The season curve; scoring and shooting have spreads of their own.
MEAN, SPREAD, FLOOR, CAP = 50.0, {"scoring": 22.0, "shooting": 20.0}, 5.0, 100.0
#: Least share of long shots of a shooter, most of a rating without, and what gives the clutch arms their full weight.
GATE, OTHERS_CAP, CROWN, FULL_GAMES = 0.10, 82, 3.0, 6.0


@dataclass(frozen=True)
class Scheme:
    """Everything that can be tuned about the ratings; the defaults are the fixed values above.

    ``weights`` are by category and component; ``credibility`` maps a component to its backing volume and the weight of the mean, ``sparse`` to
    its zero rank and floor. ``spread`` is by category, ``usual_spread`` for the rest.
    """

    weights: Mapping[str, Mapping[str, float]] = field(default_factory=lambda: WEIGHTS)
    perimeter: Mapping[str, float] = field(default_factory=lambda: PERIMETER)
    interior: Mapping[str, float] = field(default_factory=lambda: INTERIOR)
    clutch_box: Mapping[str, float] = field(default_factory=lambda: CLUTCH_BOX)
    within_season: Sequence[str] = WITHIN_SEASON
    sparse: Mapping[str, tuple[float, float]] = field(default_factory=lambda: SPARSE)
    credibility: Mapping[str, tuple[str, float]] = field(default_factory=lambda: CREDIBILITY)
    mean: float = MEAN
    spread: Mapping[str, float] = field(default_factory=lambda: SPREAD)
    usual_spread: float = 18.0
    floor: float = FLOOR
    cap: float = CAP
    gate: float = GATE
    others_cap: float = OTHERS_CAP
    crown: float = CROWN
    full_games: float = FULL_GAMES
    band: float = 0.06
    least_guard: float = 0.10

    def sd(self, category: str) -> float:
        return self.spread.get(category, self.usual_spread)


def _games() -> Column:
    return F.greatest(F.coalesce(F.col("g"), F.lit(1.0)), F.lit(1.0))


def is_shooter(gate: float = GATE) -> Column:
    return F.coalesce(F.col("x3p_ar") >= gate, F.lit(False))


def components(gate: float = GATE, band: float = 0.06, least: float = 0.10) -> dict[str, dict[str, Column]]:
    """Category -> component -> value. Columns are named as in the survey's inputs; rates ending in _shrunk are shrunk before."""
    c, games, shooter = F.col, _games(), is_shooter(gate)
    plain = lambda *names: {n: c(n) for n in names}
    return {
        "shooting": {
            "fg3_pct": F.when(shooter, c("fg3_shrunk")),
            "ft_pct": c("ft_shrunk"),
            "score3": F.when(shooter, 3 * c("x3p") / games * scalars.guardrail(c("ts_percent"), c("mu_ts"), band, least)),
            "mid_range": F.when(~shooter, c("mid_shrunk")),
        },
        "scoring": {"pts_rate": c("pts") / games, "usg": c("usg_percent"), "ts_eff": c("ts_percent"), "scoring_accolade": c("scoring_accolade")},
        "playmaking": {
            "ast_total": c("ast") / games,
            "ast_pct": c("ast_percent"),
            "creation_load": c("ast_percent") * c("usg_percent") / 100,
            "ast_security": c("ast_percent") / scalars.clip(c("tov_percent"), low=1.0),
            "star_accolade": c("star_accolade"),
        },
        "defense": {**plain("def_accolade", "dbpm"), "stl_pct": c("stl_percent"), "stl_total": c("stl") / games, "blk_pct": c("blk_percent"), "blk_total": c("blk") / games, "drb_pct": c("drb_percent")},
        "clutch": {"clutch_time": c("ct_pts"), "po_pts": c("po_ppg"), "po_depth": c("po_g"), "po_retention": c("po_ts") - c("ts_percent"), "clutch_accolade": c("clutch_accolade"), "clutch_shots": c("gw_score")},
        "rebounding": {"trb_pct": c("trb_percent"), "trb_total": c("trb") / games, "oreb_pct": c("orb_percent"), "dreb_pct": c("drb_percent")},
    }


def fill_signals(df: DataFrame, playoff_weight: float = 20, first_season: int = 1997) -> DataFrame:
    """What a season without playoff or late-game rows counts as.

    Playoff volume is 0 and playoff efficiency that of the season; game winners and late points are 0 from
    ``first_season`` on and missing before it.
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    covered = F.col("season") >= first_season
    out = df.withColumns({c: zero(F.col(c)) for c in ("po_g", "po_ppg", "po_fga", "ct_g")}).withColumn("po_ts", F.coalesce("po_ts", "ts_percent"))
    return out.withColumns({"gw_score": F.when(covered, zero(F.col("gw")) + (playoff_weight - 1) * zero(F.col("gw_po"))), "ct_pts": F.when(covered, zero(F.col("ct_pts")))})


def credible(df: DataFrame, names: Sequence[str], player: str = "player_id", season: str = "season", how: Mapping[str, tuple[str, float]] | None = None) -> DataFrame:
    """Component columns ``c_<name>`` shrunk to their unweighted mean by the backing volume.

    Minutes, and assists with turnovers, are the totals of the player's season over all its rows.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    totals = df.groupBy(player, season).agg(F.sum(zero("mp")).alias("_mp"), F.sum(zero("ast") + zero("tov")).alias("_ast_tov"))
    means = df.agg(*(F.avg(f"c_{n}").alias(f"_m_{n}") for n in names))
    volume = {"mp": F.col("_mp"), "ast_tov": F.col("_ast_tov"), "po_fga": zero("po_fga")}
    out = df.join(totals, [player, season]).crossJoin(F.broadcast(means))
    made, how = {}, CREDIBILITY if how is None else how
    for n in names:
        of, k = how[n]
        mean, v = F.col(f"_m_{n}"), F.greatest(volume[of], F.lit(0.0))
        made[f"c_{n}"] = mean + (F.col(f"c_{n}") - mean) * v / (v + k)
    return out.withColumns(made).drop("_mp", "_ast_tov", *(f"_m_{n}" for n in names))


def _rank(name: str, how: Scheme) -> Rank:
    return Rank(f"c_{name}", f"rk_{name}", within=("season",) if name in how.within_season else (), sparse=how.sparse.get(name))


def _rounded(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Values that are ranked next; rounded, so that the order of summing makes no ties or breaks them."""
    return df.withColumns({n: F.round(c, 9) for n, c in columns.items()})


def rate(df: DataFrame, categories: Sequence[str] = tuple(WEIGHTS), how: Scheme = Scheme()) -> DataFrame:
    """comp_<category> and <category>, a rating of 0 to 100, of each row.

    Components are shrunk and ranked in one pass, archetypes made and ranked again, composites made, those of
    non-shooters confined below the composite whose rating is the cap, and all composites ranked and curved in one pass.
    ``gw_po`` and ``ct_g`` weigh the clutch arms; an arm whose weight or rank is missing is ignored.
    """
    parts = {n: c for cat in categories for n, c in components(how.gate, how.band, how.least_guard)[cat].items()}
    work = _rounded(df, {f"c_{n}": c for n, c in parts.items()})
    if shrunk := [n for n in parts if n in how.credibility]:
        work = _rounded(credible(work, shrunk, how=how.credibility), {f"c_{n}": F.col(f"c_{n}") for n in shrunk})
    work = ranking.percentile_ranks(work, [_rank(n, how) for n in parts])
    of = lambda weights: shrink.weighted_composite({f"rk_{n}": w for n, w in weights.items()})
    again = {}
    if "defense" in categories:
        again["box_best"] = shrink.best_of(of(how.perimeter), of(how.interior))
    if "clutch" in categories:
        again["clutch_box"] = of(how.clutch_box)
    if again:
        work = ranking.percentile_ranks(_rounded(work, {f"c_{n}": c for n, c in again.items()}), [Rank(f"c_{n}", f"rk_{n}") for n in again])
    if "clutch" in categories:
        arm = lambda rank, count, full: F.col(rank) * scalars.clip(F.col(count) / full, 0.0, 1.0)
        work = work.withColumn("rk_clutch_best", shrink.best_of(F.col("rk_clutch_box"), arm("rk_clutch_shots", "gw_po", how.crown), arm("rk_clutch_time", "ct_g", how.full_games)))
    comps = {f"comp_{cat}": of(how.weights[cat]) for cat in categories}
    if "clutch" in categories:
        comps["comp_clutch"] = shrink.lift_only(comps["comp_clutch"], F.col("rk_clutch_best"))
    work = _rounded(work, comps)
    if "shooting" in categories:
        share = NormalDist().cdf((how.others_cap - how.mean) / how.sd("shooting"))
        work = work.crossJoin(F.broadcast(ranking.quantiles(work, "comp_shooting", {"_most": share})))
        confined = F.when(is_shooter(how.gate) | F.col("comp_shooting").isNull(), F.col("comp_shooting")).otherwise(F.least("comp_shooting", "_most"))
        work = _rounded(work, {"comp_shooting": confined}).drop("_most")
    work = ranking.percentile_ranks(work, [Rank(f"comp_{cat}", f"_{cat}", curve=(how.mean, how.sd(cat), how.floor, how.cap)) for cat in categories])
    out = work.withColumns({cat: scalars.half_even(F.col(f"_{cat}")) for cat in categories})
    if "shooting" in categories:
        out = out.withColumn("shooting", F.when(is_shooter(how.gate), F.col("shooting")).otherwise(scalars.clip(F.col("shooting"), high=how.others_cap)))
    kept = [c for c in df.columns if c not in (*categories, *(f"comp_{x}" for x in categories))]
    return out.select(*kept, *(f"comp_{cat}" for cat in categories), *categories)
