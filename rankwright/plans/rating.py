"""Ratings of supplier-years: shrinkage, ranks, composites and curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwright.functions import scalars
from rankwright.functions.normal import inverse_normal_sql, with_bell_curve
from rankwright.operators import quality, ranking, shrink, windows
from rankwright.operators.ranking import Rank


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's year: lines, returned and open lines, quantity."""
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy("l_suppkey", F.year("l_shipdate").alias("season")).agg(
        F.count_if(F.col("l_returnflag") == "R").cast("double").alias("makes"),
        F.count("*").cast("double").alias("att"),
        F.count_if(F.col("l_linestatus") == "O").cast("double").alias("open_lines"),
        F.round(F.sum("l_quantity"), 2).alias("qty"),
    )


S = """s AS (SELECT l_suppkey, year(l_shipdate)::INTEGER AS season,
  (count(*) FILTER (WHERE l_returnflag = 'R'))::DOUBLE AS makes, count(*)::DOUBLE AS att,
  (count(*) FILTER (WHERE l_linestatus = 'O'))::DOUBLE AS open_lines, round(sum(l_quantity), 2) AS qty
  FROM lineitem GROUP BY 1, 2)"""


def pct_sql(value: str, source: str, part: str = "") -> str:
    """Percentile rank of ``value`` over rows of ``source`` where it is known."""
    p = f"PARTITION BY {part}" if part else ""
    tie = f"PARTITION BY {part + ', ' if part else ''}{value}"
    return f"100.0 * (rank() OVER ({p} ORDER BY {value}) + (count(*) OVER ({tie}) - 1) / 2.0 - 0.5) / count(*) OVER ({p})"


def curve_sql(pct: str, mean: float, sd: float, floor: float, cap: float) -> str:
    p = f"least(greatest(({pct}) / 100.0, 1e-6), 1 - 1e-6)::DOUBLE"
    return f"least(greatest({mean} + {sd} * ({inverse_normal_sql('x.p')}), {floor}), {cap})", p


def rate_supplier_years(spark, sf_dir, k: float = 20.0, least: float = 1.0):
    """Shrunk return rate of supplier-years, ranked over all of them and curved to 0-100."""
    df = seasons(spark, sf_dir).where(F.col("att") >= least)
    df = shrink.group_rate(df, "makes", "att", ["season"], "mu")
    df = df.withColumn("rate", F.round(shrink.shrink(F.col("makes"), F.col("att"), F.col("mu"), k), 9))
    df = ranking.percentile_rank(df, "rate", "pct")
    df = with_bell_curve(df, "pct", "curved")
    return df.select("l_suppkey", "season", F.round("rate", 6).alias("rate"), F.round("pct", 6).alias("pct"), scalars.half_even(F.col("curved")).alias("rating"))


_CURVE, _P = curve_sql("pct", 50.0, 18.0, 5.0, 100.0)
RATE_SQL = f"""WITH {S}, m AS (SELECT season, sum(makes) / sum(att) AS mu FROM s GROUP BY 1),
r AS (SELECT l_suppkey, season, round((makes + mu * 20.0) / (att + 20.0), 9) AS rate FROM s JOIN m USING (season)),
k AS (SELECT *, {pct_sql('rate', 'r')} AS pct FROM r), x AS (SELECT *, {_P} AS p FROM k)
SELECT l_suppkey, season, round(rate, 6) AS rate, round(pct, 6) AS pct, round_even({_CURVE}, 0)::INTEGER AS rating FROM x"""


def percentile_rank_prices(spark, sf_dir):
    df = ranking.percentile_rank(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", "pct")
    return df.select("l_orderkey", "l_linenumber", F.round("pct", 6).alias("pct"))


def percentile_rank_by_year(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("season"), "o_totalprice")
    return ranking.percentile_rank_within(orders, "o_totalprice", ["season"], "pct").select("o_orderkey", "season", F.round("pct", 6).alias("pct"))


def desaturated(spark, sf_dir):
    """Sparse signal: returned lines of supplier-years with few of them counted as none."""
    df = seasons(spark, sf_dir).withColumn("signal", F.when(F.col("makes") / F.col("att") >= 0.3, F.col("makes")).otherwise(0.0))
    return ranking.desaturated_rank(df, "signal", "pct", 35.0, 70.0).select("l_suppkey", "season", F.round("pct", 6).alias("pct"))


DESAT_SQL = f"""WITH {S}, g AS (SELECT *, CASE WHEN makes / att >= 0.3 THEN makes ELSE 0.0 END AS sig FROM s),
p AS (SELECT l_suppkey, season, {pct_sql('sig', 'g')} AS pct FROM g WHERE sig > 0)
SELECT g.l_suppkey, g.season, round(CASE WHEN sig > 0 THEN 70.0 + pct / 100 * 30.0 ELSE 35.0 END, 6) AS pct
FROM g LEFT JOIN p ON g.l_suppkey = p.l_suppkey AND g.season = p.season"""


def smoothed(spark, sf_dir):
    df = windows.smooth_reputation(seasons(spark, sf_dir), ["l_suppkey"], "season", "makes", 2, 0.6, "fame")
    return df.select("l_suppkey", "season", F.round("fame", 6).alias("fame"))


SMOOTH_SQL = f"""WITH {S} SELECT a.l_suppkey, a.season, round(max(b.makes * power(0.6, a.season - b.season)), 6) AS fame
FROM s a JOIN s b ON a.l_suppkey = b.l_suppkey AND a.season - b.season BETWEEN 0 AND 2 GROUP BY 1, 2"""


def credibility(spark, sf_dir):
    df = seasons(spark, sf_dir).withColumn("share", F.col("open_lines") / F.col("att"))
    return shrink.credibility_shrink(df, "share", "att", 30.0, "share_cred").select("l_suppkey", "season", F.round("share_cred", 6).alias("share_cred"))


CRED_SQL = f"""WITH {S}, v AS (SELECT l_suppkey, season, att, open_lines / att AS share FROM s), m AS (SELECT avg(share) AS mu FROM v)
SELECT l_suppkey, season, round(mu + (share - mu) * att / (att + 30.0), 6) AS share_cred FROM v, m"""


def two_round_rating(spark, sf_dir):
    """Components ranked, archetype of the better of two, composite ranked and curved, gated and capped."""
    df = seasons(spark, sf_dir).select("l_suppkey", "season", "qty", F.round(F.col("makes") / F.col("att"), 9).alias("back"), F.when(F.col("att") >= 5, F.round(F.col("open_lines") / F.col("att"), 9)).alias("still"), F.round(F.col("qty") / F.greatest("att", F.lit(1.0)), 9).alias("size"))
    df = ranking.percentile_ranks(df, [Rank("back", "rk_back"), Rank("still", "rk_still"), Rank("size", "rk_size", within=("season",))])
    df = ranking.percentile_ranks(df.withColumn("best", F.round(shrink.best_of("rk_back", "rk_still"), 9)), [Rank("best", "rk_best")])
    df = df.withColumn("comp", F.round(shrink.weighted_composite({"rk_best": 0.55, "rk_size": 0.25, "rk_still": 0.2}), 9))
    df = ranking.percentile_ranks(df, [Rank("comp", "curved", curve=(50.0, 18.0, 5.0, 100.0))])
    gated = F.when(F.col("still").isNull(), F.least("curved", F.lit(82.0))).otherwise(F.col("curved"))
    return df.select("l_suppkey", "season", F.round("comp", 6).alias("comp"), scalars.half_even(gated).alias("rating"))


TWO_SQL = f"""WITH {S}, c AS (SELECT l_suppkey, season, round(makes / att, 9) AS back, CASE WHEN att >= 5 THEN round(open_lines / att, 9) END AS still, round(qty / greatest(att, 1.0), 9) AS size FROM s),
k AS (SELECT *, {pct_sql('back', 'c')} AS rk_back, {pct_sql('size', 'c', 'season')} AS rk_size FROM c),
l AS (SELECT l_suppkey, season, {pct_sql('still', 'c')} AS rk_still FROM c WHERE still IS NOT NULL),
b AS (SELECT k.*, rk_still, round(greatest(rk_back, rk_still), 9) AS best FROM k LEFT JOIN l ON k.l_suppkey = l.l_suppkey AND k.season = l.season),
d AS (SELECT *, {pct_sql('best', 'b')} AS rk_best FROM b),
e AS (SELECT *, round((rk_best * 0.55 + rk_size * 0.25 + coalesce(rk_still * 0.2, 0.0)) / (0.55 + 0.25 + CASE WHEN rk_still IS NULL THEN 0.0 ELSE 0.2 END), 9) AS comp FROM d),
f AS (SELECT *, {pct_sql('comp', 'e')} AS pct FROM e), x AS (SELECT *, {_P} AS p FROM f)
SELECT l_suppkey, season, round(comp, 6) AS comp, round_even(CASE WHEN still IS NULL THEN least({_CURVE}, 82.0) ELSE {_CURVE} END, 0)::INTEGER AS rating FROM x"""


def rating_quality(spark, sf_dir):
    rated = rate_supplier_years(spark, sf_dir)
    return quality.rating_checks(rated, ["rating"])


QUALITY_SQL = f"""WITH rated AS ({RATE_SQL}), a AS (SELECT count(*) FILTER (WHERE rating IS NULL) AS n0, avg(rating) AS m, avg((rating >= 100)::INTEGER) AS t, count(*) FILTER (WHERE rating >= 90) AS h, count(*) FILTER (WHERE NOT rating BETWEEN 0 AND 100) AS o FROM rated)
SELECT 'nulls' AS "check", 'rating' AS subject, n0::DOUBLE AS value, 0.0::DOUBLE AS threshold, 'hard' AS level, n0 = 0 AS passed FROM a
UNION ALL SELECT 'mean', 'rating', round(m, 6), 45.0, 'soft', m BETWEEN 45 AND 55 FROM a
UNION ALL SELECT 'share_at_top', 'rating', round(t, 6), 0.02, 'hard', t <= 0.02 FROM a
UNION ALL SELECT 'fillable', 'rating', h, 3.0, 'hard', h >= 3 FROM a
UNION ALL SELECT 'range', 'rating', o, 0.0, 'hard', o = 0 FROM a"""


def game_curve_by_decade(spark, sf_dir):
    """Peak of each supplier's years, ranked again and curved onto the narrow scale, tiered."""
    s = seasons(spark, sf_dir).withColumn("era", scalars.decade(F.col("season")))
    peak = s.groupBy("l_suppkey", "era").agg(F.max(F.round(F.col("makes") / F.col("att"), 9)).alias("peak"), F.sum("att").alias("lines"))
    out = with_bell_curve(ranking.percentile_rank(peak, "peak", "pct"), "pct", "curved", 75.0, 9.0, 55.0, 99.0)
    out = out.withColumn("rating", scalars.half_even(F.col("curved")))
    return out.select(scalars.composite_id(F.col("l_suppkey").cast("string"), F.col("era")).alias("id"), "lines", "rating", scalars.tier(F.col("rating"), scalars.TIER_BOUNDS).alias("tier"))


_GAME, _ = curve_sql("pct", 75.0, 9.0, 55.0, 99.0)
GAME_SQL = f"""WITH {S}, g AS (SELECT l_suppkey, greatest(season // 10 * 10, 1950)::VARCHAR || 's' AS era, max(round(makes / att, 9)) AS peak, sum(att) AS lines FROM s GROUP BY 1, 2),
k AS (SELECT *, {pct_sql('peak', 'g')} AS pct FROM g), x AS (SELECT *, {_P} AS p FROM k), y AS (SELECT l_suppkey::VARCHAR || '_' || era AS id, lines, round_even({_GAME}, 0)::INTEGER AS rating FROM x)
SELECT *, CASE WHEN rating >= 99 THEN '99+' WHEN rating >= 90 THEN '90+' WHEN rating >= 82 THEN '82+' WHEN rating >= 74 THEN '74+' WHEN rating >= 65 THEN '65+' ELSE 'below' END AS tier FROM y"""

QUERIES = {
    "rate_supplier_years": (rate_supplier_years, RATE_SQL),
    "percentile_rank": (percentile_rank_prices, f"SELECT l_orderkey, l_linenumber, round({pct_sql('l_extendedprice', 'lineitem')}, 6) AS pct FROM lineitem"),
    "percentile_rank_within": (percentile_rank_by_year, f"WITH o AS (SELECT o_orderkey, year(o_orderdate)::INTEGER AS season, o_totalprice FROM orders) SELECT o_orderkey, season, round({pct_sql('o_totalprice', 'o', 'season')}, 6) AS pct FROM o"),
    "desaturated_rank": (desaturated, DESAT_SQL),
    "smooth_reputation": (smoothed, SMOOTH_SQL),
    "credibility_shrink": (credibility, CRED_SQL),
    "two_round_rating": (two_round_rating, TWO_SQL),
    "rating_quality": (rating_quality, QUALITY_SQL),
    "decade_game_curve": (game_curve_by_decade, GAME_SQL),
}
