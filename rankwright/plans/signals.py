"""Signals, category components, season grids and their checks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankwright.functions import scalars
from rankwright.operators import categories, grid, quality, signals
from rankwright.plans.rating import GAME_SQL, RATE_SQL, S, curve_sql, game_curve_by_decade, pct_sql, rate_supplier_years, seasons, table


def _spine(spark, sf_dir):
    return seasons(spark, sf_dir).withColumnRenamed("l_suppkey", "player_id")


def accolades(spark, sf_dir):
    """Recognition of supplier-years from shares on their lines."""
    line = table(spark, sf_dir, "lineitem").withColumn("season", F.year("l_shipdate")).withColumn("player_id", F.col("l_suppkey"))
    rows = lambda where, share: line.where(where).select("player_id", "season", share.alias("share"))
    votes, award = rows("l_returnflag = 'R'", F.col("l_discount") * 10), rows("l_linestatus = 'O'", F.col("l_tax") * 10)
    chosen = rows("l_quantity >= 49", F.lit(1.0))
    spine = _spine(spark, sf_dir)
    recorded = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("player_id"), F.lit(1995).alias("from_season"), F.lit(1996).alias("to_season"), F.lit(1.4).alias("share"))
    title = signals.scoring_titles(spine, "qty", "att", 5)
    of = signals.Source
    df = signals.recognition(spine.select("player_id", "season"), [of(votes, 1.0, 0.5), of(award, 1.0)], "defense", 2, 0.6, recorded)
    df = signals.recognition(df, [of(award, 1.0), of(votes, 0.5, 0.5), of(title, 0.5)], "scoring", 2, 0.6)
    df = signals.recognition(df, [of(award, 1.0), of(chosen, 0.25)], "star", 2, 0.6)
    df = signals.recognition(df, [of(title, 1.0), of(award, 0.25), of(votes, 0.75)], "clutch", 3, 0.7)
    return df.select("player_id", "season", *(F.round(c, 6).alias(c) for c in ("defense", "scoring", "star", "clutch")))


ACCOLADE_SQL = f"""WITH {S}, l AS (SELECT l_suppkey AS p, year(l_shipdate)::INTEGER AS y, max(CASE WHEN l_returnflag = 'R' AND l_discount * 10 >= 0.5 THEN l_discount * 10 END) AS vf,
 max(CASE WHEN l_returnflag = 'R' THEN l_discount * 10 END) AS v, max(CASE WHEN l_linestatus = 'O' THEN l_tax * 10 END) AS a, max((l_quantity >= 49)::INTEGER) AS c FROM lineitem GROUP BY 1, 2),
t AS (SELECT l_suppkey AS p, season AS y, round(qty / att, 9) AS r FROM s WHERE att >= 5), w AS (SELECT p, y FROM t WHERE r = (SELECT max(r) FROM t u WHERE u.y = t.y)),
b AS (SELECT s.l_suppkey AS p, season AS y, coalesce(vf, 0) AS vf, coalesce(v, 0) AS v, coalesce(a, 0) AS a, coalesce(c, 0) AS c, (w.p IS NOT NULL)::INTEGER AS t,
 CASE WHEN s_acctbal < 0 AND season IN (1995, 1996) THEN 1.4 ELSE 0 END AS rec FROM s LEFT JOIN l ON l.p = s.l_suppkey AND l.y = season LEFT JOIN w ON w.p = s.l_suppkey AND w.y = season LEFT JOIN supplier ON s_suppkey = s.l_suppkey),
k AS (SELECT p, y, greatest(vf + a, rec) AS d, a + 0.5 * vf + 0.5 * t AS sc, a + 0.25 * c AS st, t + 0.25 * a + 0.75 * v AS cl FROM b)
SELECT x.p AS player_id, x.y AS season, round(max(CASE WHEN x.y - z.y <= 2 THEN z.d * power(0.6, x.y - z.y) END), 6) AS defense, round(max(CASE WHEN x.y - z.y <= 2 THEN z.sc * power(0.6, x.y - z.y) END), 6) AS scoring,
round(max(CASE WHEN x.y - z.y <= 2 THEN z.st * power(0.6, x.y - z.y) END), 6) AS star, round(max(z.cl * power(0.7, x.y - z.y)), 6) AS clutch
FROM k x JOIN k z ON x.p = z.p AND x.y - z.y BETWEEN 0 AND 3 GROUP BY 1, 2"""


def _token(key):
    return F.concat(F.lit("q"), F.translate(key.cast("string"), "0123456789", "klmnopqrst"))


def _lines(spark, sf_dir):
    """Lines as plays of orders by parts. A third of the parts has its whole name, a third only the last token, a third an unknown one."""
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    kind, token = F.col("l_partkey") % 3, _token(F.col("l_partkey"))
    name = F.when(kind == 0, F.concat_ws(" ", "p_name", token)).when(kind == 1, F.concat(F.lit("x "), token)).otherwise(F.concat(F.lit("zz y"), token))
    return line.withColumn("name", name).withColumn("ts", F.col("l_shipdate"))


def _people(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("player_id"), scalars.season_of(F.col("l_shipdate")).alias("season")).distinct()
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("player_id"), scalars.normal_name(F.concat_ws(" ", "p_name", _token(F.col("p_partkey")))).alias("name"))
    return line.join(part, "player_id").select("season", "name", "player_id")


def _plays(spark, sf_dir):
    q, price = F.col("l_quantity").cast("int"), F.floor("l_extendedprice").cast("int")
    clock = F.concat(F.lit("PT"), (q % 3).cast("string"), F.lit("M"), (price % 60).cast("string"), F.lit(".0S"))
    return _lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("game_id"), F.col("l_linenumber").alias("period"), clock.alias("clock"), (F.col("l_suppkey") % 2).alias("team_id"), "name", "ts",
        (F.col("l_linestatus") == "O").alias("made"), (F.col("l_returnflag") == "R").alias("free"), F.when(q % 4 > 0, q % 4).alias("value"), (price % 7).alias("home_score"), (price % 5).alias("away_score"),
    )


def _games(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("game_id"), F.when(F.col("o_orderstatus") == "F", "Playoffs").otherwise("Regular").alias("game_type"), (F.col("o_custkey") % 2).alias("home_team"))


def playoff_box(spark, sf_dir):
    """Totals of parts by season, over names that are whole, cut or unknown."""
    box = _lines(spark, sf_dir).select("name", "ts", F.when(F.col("l_linestatus") == "O", "Playoffs").otherwise("Regular").alias("game_type"), F.col("l_quantity").alias("minutes"), F.floor("l_extendedprice").cast("double").alias("points"), F.col("l_linenumber").cast("double").alias("attempts"), (F.col("l_suppkey") % 3).cast("double").alias("free"))
    out = signals.playoff_box(box, _people(spark, sf_dir), least=0.5)
    return out.select("player_id", "season", "po_g", F.round("po_mp", 4).alias("po_mp"), "po_pts", "po_fga", "po_fta", F.round("po_ppg", 6).alias("po_ppg"), F.round("po_ts", 6).alias("po_ts"))


BOX_SQL = """WITH b AS (SELECT l_partkey AS player_id, (year(l_shipdate) + (month(l_shipdate) >= 9)::INTEGER)::INTEGER AS season, count(*) AS po_g, round(sum(l_quantity), 4) AS po_mp, sum(floor(l_extendedprice))::DOUBLE AS po_pts, sum(l_linenumber)::DOUBLE AS po_fga, sum(l_suppkey % 3)::DOUBLE AS po_fta
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linestatus = 'O' AND l_partkey % 3 < 2 GROUP BY 1, 2)
SELECT *, round(po_pts / po_g, 6) AS po_ppg, round(CASE WHEN po_fga + 0.44::DOUBLE * po_fta > 0 THEN po_pts / (2 * (po_fga + 0.44::DOUBLE * po_fta)) END, 6) AS po_ts FROM b"""

PLAYS_SQL = """p AS (SELECT *, (y + (m >= 9)::INTEGER)::INTEGER AS season, CASE WHEN home THEN h ELSE w END AS mine, CASE WHEN home THEN w ELSE h END AS theirs FROM (
SELECT l_partkey AS player_id, l_orderkey, year(l_shipdate) AS y, month(l_shipdate) AS m, l_linenumber AS period, trunc(l_quantity)::INTEGER % 3 * 60 + floor(l_extendedprice)::BIGINT % 60 AS clock, l_linestatus = 'O' AS made, l_returnflag = 'R' AS free,
CASE WHEN trunc(l_quantity)::INTEGER % 4 > 0 THEN trunc(l_quantity)::INTEGER % 4 ELSE 2 END AS worth, floor(l_extendedprice)::BIGINT % 7 AS h, floor(l_extendedprice)::BIGINT % 5 AS w, coalesce(l_suppkey % 2 = o_custkey % 2, false) AS home, o_orderstatus IS NOT DISTINCT FROM 'F' AS playoff
FROM lineitem JOIN part ON p_partkey = l_partkey LEFT JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey % 3 < 2))"""


def game_winners(spark, sf_dir):
    """R16, R18."""
    out = signals.game_winners(_plays(spark, sf_dir), _games(spark, sf_dir), _people(spark, sf_dir), least=0.5)
    return out.select("player_id", "season", "gw", "gw_po", signals.winner_score(F.col("gw"), F.col("gw_po"), F.col("season"), 20, 1997).cast("double").alias("gw_score"))


WINNER_SQL = f"""WITH {PLAYS_SQL} SELECT player_id, season, count(*) AS gw, count(*) FILTER (WHERE playoff) AS gw_po, CASE WHEN season >= 1997 THEN (count(*) + 19 * count(*) FILTER (WHERE playoff))::DOUBLE END AS gw_score
FROM p WHERE period >= 4 AND made AND NOT free AND clock <= 24 AND mine > theirs AND mine - worth <= theirs GROUP BY 1, 2"""


def late_scoring(spark, sf_dir):
    """R17."""
    out = signals.late_scoring(_plays(spark, sf_dir), _games(spark, sf_dir), _people(spark, sf_dir), least=0.5)
    return out.select("player_id", "season", F.round("ct_pts", 4).alias("ct_pts"), "ct_g")


LATE_SQL = f"""WITH {PLAYS_SQL}, q AS (SELECT *, CASE WHEN free THEN 1 ELSE worth END AS pts FROM p WHERE playoff AND made AND period >= 4 AND clock <= 300)
SELECT player_id, season, round(sum(pts * CASE WHEN mine - pts - theirs <= 0 THEN 1.0 ELSE 0.25 END)::DOUBLE, 4) AS ct_pts, count(DISTINCT l_orderkey) AS ct_g FROM q WHERE abs(mine - pts - theirs) <= 5 GROUP BY 1, 2"""


def _stats(spark, sf_dir):
    """Supplier-years under the names of the category inputs."""
    s = seasons(spark, sf_dir)
    share = F.round(F.col("makes") / F.col("att"), 9)
    still = F.round(F.col("open_lines") / F.col("att"), 9)
    rows = s.select(
        F.col("l_suppkey").alias("player_id"), "season", F.col("att").alias("g"), F.col("qty").alias("mp"), F.col("makes").alias("tov"), F.col("open_lines").alias("po_fga"), (F.col("makes") % 4).alias("gw_po"), (F.col("att") % 9).alias("ct_g"), share.alias("x3p_ar"), still.alias("fg3_shrunk"), share.alias("ft_shrunk"), still.alias("mid_shrunk"), F.col("makes").alias("x3p"), still.alias("ts_percent"), F.lit(0.5).alias("mu_ts"),
        F.col("qty").alias("pts"), (share * 100).alias("usg_percent"), F.col("open_lines").alias("ast"), (still * 100).alias("ast_percent"), (share * 10).alias("tov_percent"), F.col("makes").alias("trb"), (share * 50).alias("trb_percent"), (still * 20).alias("orb_percent"), (share * 30).alias("drb_percent"),
        F.when(share > 0.4, share).otherwise(0.0).alias("scoring_accolade"), F.when(still > 0.6, still).otherwise(0.0).alias("star_accolade"), share.alias("def_accolade"), (still - 0.5).alias("dbpm"), (share * 3).alias("stl_percent"), F.col("makes").alias("stl"), (still * 4).alias("blk_percent"), F.col("open_lines").alias("blk"),
        F.when(F.col("season") % 2 == 0, F.col("makes")).otherwise(F.when(F.col("makes") > 0, F.col("makes"))).alias("ct_pts"), F.col("qty").alias("po_ppg"), F.col("att").alias("po_g"), share.alias("po_ts"), still.alias("clutch_accolade"), F.when(F.col("makes") > 0, F.col("makes")).alias("gw"),
    )
    return categories.fill_signals(rows, 20, 1994)


def component_library(spark, sf_dir):
    """Every component of the six categories."""
    made = {f"{cat}_{name}": F.round(value, 6) for cat, parts in categories.components().items() for name, value in parts.items()}
    return _stats(spark, sf_dir).select(F.col("player_id").alias("l_suppkey"), "season", *(v.cast("double").alias(k) for k, v in made.items()))


#: SQL of each component over x: l_suppkey, season, g, h, o, makes, open_lines, qty.
COMPONENTS = {
    "shooting": {"fg3_pct": "CASE WHEN h >= 0.1 THEN o END", "ft_pct": "h", "score3": "CASE WHEN h >= 0.1 THEN 3 * makes / g * least(greatest((o - (0.5::DOUBLE - 0.06::DOUBLE)) / 0.06::DOUBLE, 0.1::DOUBLE), 1.0) END", "mid_range": "CASE WHEN h < 0.1 THEN o END"},
    "scoring": {"pts_rate": "qty / g", "usg": "h * 100", "ts_eff": "o", "scoring_accolade": "CASE WHEN h > 0.4 THEN h ELSE 0 END"},
    "playmaking": {"ast_total": "open_lines / g", "ast_pct": "o * 100", "creation_load": "o * 100 * (h * 100) / 100", "ast_security": "o * 100 / greatest(h * 10, 1.0)", "star_accolade": "CASE WHEN o > 0.6 THEN o ELSE 0 END"},
    "defense": {"def_accolade": "h", "dbpm": "o - 0.5::DOUBLE", "stl_pct": "h * 3", "stl_total": "makes / g", "blk_pct": "o * 4", "blk_total": "open_lines / g", "drb_pct": "h * 30"},
    "clutch": {"clutch_time": "CASE WHEN season >= 1994 THEN makes END", "po_pts": "qty", "po_depth": "g", "po_retention": "h - o", "clutch_accolade": "o", "clutch_shots": "CASE WHEN season >= 1994 THEN makes + 19 * (makes % 4) END"},
    "rebounding": {"trb_pct": "h * 50", "trb_total": "makes / g", "oreb_pct": "o * 20", "dreb_pct": "h * 30"},
}
X = f"""{S}, x AS (SELECT l_suppkey, season, att AS g, round(makes / att, 9) AS h, round(open_lines / att, 9) AS o, makes, open_lines, qty FROM s)"""
COMPONENT_SQL = f"WITH {X} SELECT l_suppkey, season, {', '.join(f'round({e}, 6) AS {cat}_{n}' for cat, parts in COMPONENTS.items() for n, e in parts.items())} FROM x"


def six_ratings(spark, sf_dir):
    """All six categories, from components to ratings."""
    return categories.rate(_stats(spark, sf_dir)).select("player_id", "season", *categories.WEIGHTS, *(F.round(f"comp_{c}", 6).alias(f"comp_{c}") for c in categories.WEIGHTS))


def rebounding_rating(spark, sf_dir):
    """One whole category, from components to rating."""
    return categories.rate(_stats(spark, sf_dir), ["rebounding"]).select(F.col("player_id").alias("l_suppkey"), "season", F.col("rebounding").alias("rating"))


def _rank_sql(v, group="", sparse=None):
    of = f"{group + ', ' if group else ''}{v} {'> 0' if sparse else 'IS NOT NULL'}"
    pct = f"100.0 * (rank() OVER (PARTITION BY {of} ORDER BY {v}) + (count(*) OVER (PARTITION BY {of}, {v}) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY {of})"
    if sparse:
        return f"CASE WHEN {v} > 0 THEN {sparse[1]} + {pct} / 100 * (100 - {sparse[1]}) WHEN {v} IS NOT NULL THEN {sparse[0]} END::DOUBLE"
    return f"CASE WHEN {v} IS NOT NULL THEN {pct} END::DOUBLE"


def _mean_sql(weights):
    total = " + ".join(f"CASE WHEN rk_{n} IS NULL THEN 0.0 ELSE {w} END::DOUBLE" for n, w in weights.items())
    return f"({' + '.join(f'coalesce(rk_{n} * {w}::DOUBLE, 0.0)' for n, w in weights.items())}) / nullif({total}, 0)"


def _ratings_sql(cats):
    """Ratings r (l_suppkey, season, cat, comp, rating) of the categories."""
    c = categories
    parts = {n: e for cat in cats for n, e in COMPONENTS[cat].items()}
    volume = {"mp": "qty", "ast_tov": "(open_lines + makes)", "po_fga": "open_lines"}
    credible = lambda n: f"round(avg(c_{n}) OVER () + (c_{n} - avg(c_{n}) OVER ()) * {volume[c.CREDIBILITY[n][0]]} / ({volume[c.CREDIBILITY[n][0]]} + {c.CREDIBILITY[n][1]}), 9)" if n in c.CREDIBILITY else f"c_{n}"
    comp = {cat: f"round({_mean_sql(c.WEIGHTS[cat])}, 9)" for cat in cats}
    more, best, most = [], [], "NULL::DOUBLE"
    if "defense" in cats:
        more.append(f"round(greatest({_mean_sql(c.PERIMETER)}, {_mean_sql(c.INTERIOR)}), 9) AS c_box_best")
        best.append(f"{_rank_sql('c_box_best')} AS rk_box_best")
    if "clutch" in cats:
        more.append(f"round({_mean_sql(c.CLUTCH_BOX)}, 9) AS c_clutch_box")
        best.append(f"greatest({_rank_sql('c_clutch_box')}, rk_clutch_shots * least((makes % 4) / 3.0::DOUBLE, 1.0), rk_clutch_time * least((g % 9) / 6.0::DOUBLE, 1.0)) AS rk_clutch_best")
        comp["clutch"] = f"round(greatest({_mean_sql(c.WEIGHTS['clutch'])}, rk_clutch_best), 9)"
    if "shooting" in cats:
        from statistics import NormalDist

        most = f"(SELECT quantile_cont(comp, {NormalDist().cdf((82 - 50.0) / 20.0)!r}::DOUBLE) FROM w0 WHERE cat = 'shooting')"
    curve, p = curve_sql("pct", 50.0, "x.sd", 5.0, 100.0)
    sd = "CASE cat WHEN 'scoring' THEN 22.0 WHEN 'shooting' THEN 20.0 ELSE 18.0 END::DOUBLE"
    return f"""{X}, c AS (SELECT *, {', '.join(f'round({e}, 9) AS c_{n}' for n, e in parts.items())} FROM x),
c2 AS (SELECT * REPLACE ({', '.join(f'{credible(n)} AS c_{n}' for n in parts)}) FROM c),
k AS (SELECT *, {', '.join(f"{_rank_sql(f'c_{n}', 'season' if n in c.WITHIN_SEASON else '', c.SPARSE.get(n))} AS rk_{n}" for n in parts)} FROM c2),
k1 AS (SELECT *{''.join(', ' + m for m in more)} FROM k), k2 AS (SELECT *{''.join(', ' + m for m in best)} FROM k1),
w0 AS ({' UNION ALL '.join(f"SELECT l_suppkey, season, h, '{cat}' AS cat, {comp[cat]} AS comp FROM k2" for cat in cats)}),
w AS (SELECT l_suppkey, season, h, cat, CASE WHEN cat = 'shooting' AND h < 0.1 THEN round(least(comp, {most}), 9) ELSE comp END AS comp FROM w0),
y AS (SELECT *, {_rank_sql('comp', 'cat')} AS pct, {sd} AS sd FROM w), x1 AS (SELECT *, {p} AS p FROM y),
r AS (SELECT l_suppkey, season, cat, comp, CASE WHEN cat = 'shooting' AND h < 0.1 THEN least(v, 82) ELSE v END AS rating FROM (SELECT *, CASE WHEN pct IS NOT NULL THEN round_even({curve}, 0)::INTEGER END AS v FROM x1 AS x))"""


SIX_SQL = f"""WITH {_ratings_sql(list(categories.WEIGHTS))} SELECT l_suppkey AS player_id, season, {', '.join(f"max(CASE WHEN cat = '{c}' THEN rating END) AS {c}, round(max(CASE WHEN cat = '{c}' THEN comp END), 6) AS comp_{c}" for c in categories.WEIGHTS)} FROM r GROUP BY 1, 2"""
REBOUND_SQL = f"WITH {_ratings_sql(['rebounding'])} SELECT l_suppkey, season, rating FROM r"


def _members(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("franchise"))
    sup = table(spark, sf_dir, "supplier").join(nation, "s_nationkey").select(F.col("s_suppkey").alias("l_suppkey"), "franchise")
    return seasons(spark, sf_dir).join(sup, "l_suppkey").select("season", "franchise", F.col("l_suppkey").alias("id"), F.col("qty").alias("minutes"), "att")


def season_grid(spark, sf_dir):
    """Best suppliers of each year and region by quantity, among those with enough lines."""
    members = _members(spark, sf_dir)
    return grid.season_grid(members, table(spark, sf_dir, "supplier").where("s_acctbal > -500").select(F.col("s_suppkey").alias("id")), 12, 2)


MEMBER_SQL = f"{S}, m AS (SELECT season, n_regionkey AS franchise, l_suppkey AS id, qty AS minutes FROM s JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > -500)"
GRID_SQL = f"WITH {MEMBER_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY season, franchise) AS n, (row_number() OVER (PARTITION BY season, franchise ORDER BY minutes DESC NULLS LAST, id))::INTEGER AS place FROM m) SELECT season, franchise, id, place FROM n WHERE n >= 2 AND place <= 12"


def thin_cells(spark, sf_dir):
    """C8."""
    return grid.thin_cells(_members(spark, sf_dir), table(spark, sf_dir, "supplier").where("s_acctbal > -500").select(F.col("s_suppkey").alias("id")), 20)


def head_to_head(spark, sf_dir):
    """Each part's lines of one flag against those of another, slot by slot."""
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("board"), F.col("l_linenumber").alias("slot"), "l_returnflag").agg(F.max("l_quantity").cast("int").alias("rating"))
    return grid.head_to_head(line.where("l_returnflag = 'A'"), line.where("l_returnflag = 'R'"))


VERSUS_SQL = """WITH r AS (SELECT l_partkey AS board, l_linenumber AS slot, l_returnflag AS f, trunc(max(l_quantity))::INTEGER AS rating FROM lineitem GROUP BY 1, 2, 3), j AS (SELECT a.board, a.rating - b.rating AS g FROM r a JOIN r b ON a.board = b.board AND a.slot = b.slot WHERE a.f = 'A' AND b.f = 'R')
SELECT board, count(*) FILTER (WHERE g > 0) AS won, count(*) FILTER (WHERE g < 0) AS lost, count(*) FILTER (WHERE g = 0) AS tied, CASE WHEN sum(g) > 0 THEN 'win' WHEN sum(g) < 0 THEN 'loss' ELSE 'tie' END AS verdict FROM j GROUP BY 1"""


def decade_scale(spark, sf_dir):
    """Q5."""
    return quality.scale_checks(game_curve_by_decade(spark, sf_dir), ["rating"])


SCALE_SQL = f"""WITH d AS ({GAME_SQL}), a AS (SELECT abs(avg(rating) - 75) AS m, avg((rating >= 99)::INTEGER) AS c FROM d)
SELECT 'scale_mean' AS "check", 'rating' AS subject, round(m, 6) AS value, 3.0::DOUBLE AS threshold, 'hard' AS level, m <= 3 AS passed FROM a UNION ALL SELECT 'share_at_cap', 'rating', round(c, 6), 0.02, 'hard', c <= 0.02 FROM a"""


def signature_floors(spark, sf_dir):
    """Q7: a stated floor for the best rating of every supplier with a large balance."""
    rated = rate_supplier_years(spark, sf_dir).join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    floors = table(spark, sf_dir, "supplier").where("s_acctbal > 4000").select(F.col("s_name").alias("name"), F.lit("rating").alias("ability"), F.lit(70).alias("floor"))
    return quality.signature_floors(rated, "s_name", ["rating"], floors)


FLOOR_SQL = f"""WITH rated AS ({RATE_SQL}) SELECT s_name AS name, 'rating' AS ability, 70 AS floor, max(rating) AS best, coalesce(max(rating) >= 70, false) AS passed FROM supplier LEFT JOIN rated ON l_suppkey = s_suppkey WHERE s_acctbal > 4000 GROUP BY 1"""

QUERIES = {
    "accolades": (accolades, ACCOLADE_SQL),
    "playoff_box": (playoff_box, BOX_SQL),
    "game_winners": (game_winners, WINNER_SQL),
    "late_scoring": (late_scoring, LATE_SQL),
    "component_library": (component_library, COMPONENT_SQL),
    "six_ratings": (six_ratings, SIX_SQL),
    "rebounding_rating": (rebounding_rating, REBOUND_SQL),
    "season_grid": (season_grid, GRID_SQL),
    "thin_cells": (thin_cells, f"WITH {MEMBER_SQL} SELECT season, franchise, count(*) AS n FROM m GROUP BY 1, 2 HAVING count(*) < 20"),
    "head_to_head": (head_to_head, VERSUS_SQL),
    "decade_scale": (decade_scale, SCALE_SQL),
    "signature_floors": (signature_floors, FLOOR_SQL),
}
