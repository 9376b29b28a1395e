"""From raw rows to a curated grid: stints, the rated universe, entries by decade, rosters, axes and their checks.

Suppliers stand for players, orders are dealt to seasons, the return flag is the team; ``TOT`` rows sum a season.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rankwright.functions import scalars
from rankwright.operators import curation, filters, joins, quality, ranking, shrink, signals, windows
from rankwright.operators.criteria import matching
from rankwright.plans.rating import curve_sql, pct_sql, table
from rankwright.sources.artifacts import Artifacts

ABILITIES = ("shooting", "scoring", "playmaking", "defense", "clutch", "rebounding")
STINT = ("player_id", "season", "team")


def _stints(spark, sf_dir):
    """Lines by supplier, season and team: a stage artifact, so that a query that needs it several times sums the lines once."""
    return Artifacts(spark).get("stints", [f"{sf_dir}/lineitem.parquet"], {}, lambda: _summed(table(spark, sf_dir, "lineitem")))


def _summed(line):
    return line.groupBy(F.col("l_suppkey").alias("player_id"), (F.col("l_orderkey") % 70 + 1945).cast("int").alias("season"), F.col("l_returnflag").alias("team")).agg(
        F.count("*").cast("double").alias("g"), F.round(F.sum("l_quantity"), 2).alias("mp"), F.round(F.sum("l_extendedprice"), 2).alias("pts"), F.sum("l_linenumber").cast("double").alias("trb"), F.count_if(F.col("l_linestatus") == "O").cast("double").alias("makes")
    )


T = """t AS (SELECT l_suppkey AS player_id, (l_orderkey % 70 + 1945)::INTEGER AS season, l_returnflag AS team, count(*)::DOUBLE AS g, round(sum(l_quantity), 2) AS mp, round(sum(l_extendedprice), 2) AS pts,
 sum(l_linenumber)::DOUBLE AS trb, (count(*) FILTER (WHERE l_linestatus = 'O'))::DOUBLE AS makes FROM lineitem GROUP BY 1, 2, 3)"""


def _raw(spark, sf_dir):
    """Stints, some of them twice with fewer minutes, and rows over all teams of a season."""
    t = _stints(spark, sf_dir).select(*STINT, "mp")
    total = t.groupBy("player_id", "season").agg(F.count("*").alias("n"), F.round(F.sum("mp"), 2).alias("mp")).where("n > 1")
    return t.union(t.where("player_id % 3 = 0").withColumn("mp", F.col("mp") / 2)).union(total.select("player_id", "season", F.lit("TOT"), "mp"))


def collapsed_seasons(spark, sf_dir):
    """W6, F6."""
    return windows.collapse_to_season(_raw(spark, sf_dir)).select(*STINT, F.round("mp", 4).alias("mp"))


COLLAPSE_SQL = f"""WITH {T}, n AS (SELECT player_id, season, count(*) AS n, round(sum(mp), 2) AS mp FROM t GROUP BY 1, 2), b AS (SELECT player_id, season, team, mp, row_number() OVER (PARTITION BY player_id, season ORDER BY mp DESC, team) AS r FROM t)
SELECT n.player_id, n.season, CASE WHEN n > 1 THEN 'TOT' ELSE team END AS team, CASE WHEN n > 1 THEN n.mp ELSE b.mp END AS mp FROM n JOIN b ON n.player_id = b.player_id AND n.season = b.season AND r = 1"""


def team_stints(spark, sf_dir):
    """Single-team rows with a per-game tie-break, and a fact that only some have."""
    kept = windows.keep_stints(_raw(spark, sf_dir))
    per_game = _stints(spark, sf_dir).where("g >= 2").select(*STINT, scalars.per_game(F.col("trb"), F.col("g")).alias("ppg"))
    members = curation.membership(kept, per_game, "ppg")
    return joins.with_facts(members, [(_stints(spark, sf_dir).where("makes > 0"), ["makes"])], STINT)


def _universe(spark, sf_dir):
    rows = _stints(spark, sf_dir).withColumns({"lg": F.when(F.col("player_id") % 7 == 0, "C").when(F.col("player_id") % 2 == 0, "A").otherwise("B"), "mp": F.when(F.col("season") >= 1952, F.col("mp"))})
    return filters.universe(rows, ["A", "B"], 1947, 2, 30)


def universe(spark, sf_dir):
    """P1, P2, P3."""
    return _universe(spark, sf_dir)[0].select(*STINT, "lg", "g", "mp")


def universe_funnel(spark, sf_dir):
    """P8 of the universe's filters."""
    return _universe(spark, sf_dir)[1]


U = f"""{T}, l AS (SELECT * REPLACE (CASE WHEN season >= 1952 THEN mp END AS mp), CASE WHEN player_id % 7 = 0 THEN 'C' WHEN player_id % 2 = 0 THEN 'A' ELSE 'B' END AS lg FROM t),
u AS (SELECT * FROM l WHERE lg IN ('A', 'B') AND season >= 1947 AND g >= 2 AND (mp >= 30 OR mp IS NULL))"""


def _scored(spark, sf_dir):
    c = F.col
    made = {"shooting": c("mp") / c("g"), "scoring": c("pts") / c("g"), "playmaking": c("makes") / c("g"), "defense": c("trb") / c("g"), "clutch": F.when(c("g") >= 3, c("pts") / c("trb")), "rebounding": F.when(c("season") >= 1951, c("trb") / c("mp"))}
    return _universe(spark, sf_dir)[0].withColumns({f"comp_{a}": F.round(x, 9) for a, x in made.items()})


def _lineage(spark):
    return spark.createDataFrame([("N", "A")], "code string, franchise string")


def _brands(spark):
    return spark.createDataFrame([("R", "Reds", 1), ("A", "Ambers", 2), ("N", "Navies", 3)], "franchise string, name string, ordinal int")


def _entries(spark, sf_dir):
    """The entries of all decades: a stage artifact that every query of the grid reads and the first one builds."""
    stats = ["g", "mp", "pts", "trb"]
    build = lambda: curation.decade_entries(_scored(spark, sf_dir), _lineage(spark), ABILITIES, stats)
    return Artifacts(spark).get("decade_entries", [f"{sf_dir}/lineitem.parquet"], {"abilities": ABILITIES, "stats": stats}, build)


def decade_entries(spark, sf_dir):
    """Peaks by decade and franchise, ranked again and curved."""
    return _entries(spark, sf_dir).select("id", *ABILITIES, "g", F.round("mp", 2).alias("mp"), "peak_season", "peak_team")


_CURVE, _P = curve_sql("pct", 75.0, 9.0, 55.0, 99.0)
D = f"""{U}, s AS (SELECT player_id, season, team, g, mp, pts, trb, round(mp / g, 9) AS shooting, round(pts / g, 9) AS scoring, round(makes / g, 9) AS playmaking, round(trb / g, 9) AS defense, CASE WHEN g >= 3 THEN round(pts / trb, 9) END AS clutch,
 CASE WHEN season >= 1951 THEN round(trb / mp, 9) END AS rebounding, CASE WHEN team = 'N' THEN 'A' ELSE team END AS franchise, greatest(season // 10 * 10, 1950)::VARCHAR || 's' AS decade FROM u),
o AS (SELECT *, round(({' + '.join(['0.0::DOUBLE', *(f'coalesce({a}, 0.0)' for a in ABILITIES)])}) / ({' + '.join(f'({a} IS NOT NULL)::INTEGER' for a in ABILITIES)}), 9) AS overall FROM s WHERE decade >= '1960s'),
w AS (SELECT *, row_number() OVER (PARTITION BY player_id, franchise, decade ORDER BY overall DESC NULLS LAST, season, team) AS r FROM o),
e AS (SELECT player_id, franchise, decade, {', '.join(f'max({a}) AS {a}' for a in ABILITIES)}, sum(g) AS g, sum(coalesce(mp, 0)) AS mp, sum(pts) AS pts, sum(trb) AS trb, max(CASE WHEN r = 1 THEN season END) AS peak_season, max(CASE WHEN r = 1 THEN team END) AS peak_team FROM w GROUP BY 1, 2, 3),
v AS (UNPIVOT e ON {', '.join(ABILITIES)} INTO NAME ability VALUE v),
k AS (SELECT *, {pct_sql('v', 'v', 'ability')} AS pct FROM v), x AS (SELECT *, {_P} AS p FROM k),
q AS (SELECT player_id, franchise, decade, ability, round_even({_CURVE}, 0)::INTEGER AS rating FROM x),
d AS (SELECT e.player_id::VARCHAR || '_' || e.decade || '_' || e.franchise AS id, e.player_id, e.franchise, e.decade, {', '.join(f"max(CASE WHEN ability = '{a}' THEN rating END) AS {a}" for a in ABILITIES)}, any_value(g) AS g, any_value(mp) AS mp, any_value(pts) AS pts, any_value(trb) AS trb, any_value(peak_season) AS peak_season, any_value(peak_team) AS peak_team
 FROM e LEFT JOIN q ON q.player_id = e.player_id AND q.franchise = e.franchise AND q.decade = e.decade GROUP BY e.player_id, e.franchise, e.decade),
f AS (SELECT * FROM d WHERE {' AND '.join(f'{a} IS NOT NULL' for a in ABILITIES)})"""


def incomplete_entries(spark, sf_dir):
    """How many entries lack a rating."""
    return curation.complete(_entries(spark, sf_dir), ABILITIES)[1]


def _stars(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("player_id"), (F.col("l_orderkey") % 70 + 1945).alias("season"), "l_quantity", "l_linenumber")
    return curation.starred([line.where("l_quantity = 50 and l_linenumber = 1"), line.where("l_quantity = 49 and l_linenumber = 2")])


def starred_seasons(spark, sf_dir):
    """C3, T5."""
    return _stars(spark, sf_dir)


STAR_SQL = "SELECT DISTINCT l_suppkey AS player_id, (l_orderkey % 70 + 1945)::INTEGER AS season FROM lineitem WHERE (l_quantity = 50 AND l_linenumber = 1) OR (l_quantity = 49 AND l_linenumber = 2)"


def recognized(spark, sf_dir):
    """One for every supplier and season with a large first line."""
    line = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.col("l_suppkey").alias("player_id"), (F.col("l_orderkey") % 70 + 1945).cast("int").alias("season"))
    return signals.presence(line)


def _manual(spark):
    return spark.createDataFrame([("1970s", "A", 1), ("1980s", "R", 2)], "decade string, franchise string, player_id long")


def _grid(spark, sf_dir):
    """The complete entries and their rosters, both stage artifacts."""
    entries = curation.complete(_entries(spark, sf_dir), ABILITIES)[0]
    members = _stints(spark, sf_dir).select(*STINT, "mp")
    build = lambda: curation.rosters(members, _universe(spark, sf_dir)[0], entries, _lineage(spark), _brands(spark), _stars(spark, sf_dir), _manual(spark), 5, 3)[0]
    return entries, Artifacts(spark).get("decade_rosters", [f"{sf_dir}/lineitem.parquet"], {"k": 5, "least": 3}, build)


def decade_rosters(spark, sf_dir):
    """Most minutes of each decade and franchise, stars and named ones never cut."""
    return _grid(spark, sf_dir)[1]


def thin_decades(spark, sf_dir):
    """C8 of the decade grid."""
    entries = curation.complete(_entries(spark, sf_dir), ABILITIES)[0]
    members = _stints(spark, sf_dir).select(*STINT, "mp")
    return curation.rosters(members, _universe(spark, sf_dir)[0], entries, _lineage(spark), _brands(spark), _stars(spark, sf_dir), None, 5, 86)[1]


G = f"""{D}, a AS (SELECT t.player_id, t.season, t.mp, CASE WHEN t.team = 'N' THEN 'A' ELSE t.team END AS franchise, greatest(t.season // 10 * 10, 1950)::VARCHAR || 's' AS decade FROM t SEMI JOIN u ON t.player_id = u.player_id AND t.season = u.season AND t.team = u.team),
st AS ({STAR_SQL}), fo AS (SELECT decade, franchise, player_id FROM a SEMI JOIN st ON a.player_id = st.player_id AND a.season = st.season UNION SELECT '1970s', 'A', 1 UNION SELECT '1980s', 'R', 2),
mi AS (SELECT decade, franchise, player_id, player_id::VARCHAR || '_' || decade || '_' || franchise AS id, sum(mp) AS mp FROM a GROUP BY 1, 2, 3),
li AS (SELECT mi.*, fo.player_id IS NOT NULL AS forced FROM mi LEFT JOIN fo ON fo.decade = mi.decade AND fo.franchise = mi.franchise AND fo.player_id = mi.player_id WHERE id IN (SELECT id FROM f)),
pl AS (SELECT *, count(*) OVER (PARTITION BY decade, franchise) AS n, count(*) FILTER (WHERE forced) OVER (PARTITION BY decade, franchise) AS nf, row_number() OVER (PARTITION BY decade, franchise, forced ORDER BY mp DESC, id) AS p FROM li),
g AS (SELECT decade, franchise, id, (row_number() OVER (PARTITION BY decade, franchise ORDER BY mp DESC, id))::INTEGER AS place FROM pl WHERE n >= 3 AND (forced OR p <= 5 - nf))"""


def shipped_entries(spark, sf_dir):
    """Listed entries with ratings, per-game stats and label."""
    entries, roster = _grid(spark, sf_dir)
    out = curation.shipped(entries, roster, _brands(spark).where("franchise <> 'N'"), ABILITIES, {"mpg": "mp", "rpg": "trb"})
    return out.select("id", "player_id", "ratings.*", "stats.*", "peak_season", "team_label")


SHIP_SQL = f"""WITH {G} SELECT id, player_id, {', '.join(ABILITIES)}, round_even(mp / greatest(g, 1), 1) AS mpg, round_even(trb / greatest(g, 1), 1) AS rpg, peak_season,
substr(decade, 3) || ' ' || CASE coalesce(nullif(peak_team, 'N'), franchise) WHEN 'A' THEN 'Ambers' ELSE 'Reds' END AS team_label FROM f WHERE id IN (SELECT id FROM g)"""


def grid_axes(spark, sf_dir):
    """Used franchises in their order with how many decades, and decades in theirs with how many franchises."""
    roster = _grid(spark, sf_dir)[1].select("decade", "franchise").distinct()
    franchises, decades = curation.axes(roster, _brands(spark))
    of = lambda a, b: roster.groupBy(a).agg(F.array_join(F.array_sort(F.collect_set(b)), ",").alias("others"))
    one = franchises.join(of("franchise", "decade"), "franchise").select(F.lit("franchise").alias("axis"), F.col("franchise").alias("value"), "ordinal", "others")
    return one.union(decades.join(of("decade", "franchise"), "decade").select(F.lit("decade"), "decade", F.substring("decade", 1, 4).cast("int"), "others"))


AXES_SQL = f"""WITH {G} SELECT 'franchise' AS axis, franchise AS value, CASE franchise WHEN 'R' THEN 1 ELSE 2 END AS ordinal, string_agg(DISTINCT decade, ',' ORDER BY decade) AS others FROM g GROUP BY franchise
UNION ALL SELECT 'decade', decade, left(decade, 4)::INTEGER, string_agg(DISTINCT franchise, ',' ORDER BY franchise) FROM g GROUP BY decade"""


def pool_ceiling(spark, sf_dir):
    """Best of each ability over listed entries."""
    entries, roster = _grid(spark, sf_dir)
    return curation.ceiling(entries, roster, ABILITIES)


CEILING_SQL = f"""WITH {G}, m AS (SELECT {', '.join(f'max({a}) AS {a}' for a in ABILITIES)} FROM f WHERE id IN (SELECT id FROM g)) SELECT *, {' + '.join(ABILITIES)} AS total FROM m"""


def roster_checks(spark, sf_dir):
    """Cells against entries; every eleventh entry is held back."""
    entries, roster = _grid(spark, sf_dir)
    cells = roster.groupBy(F.concat_ws("_", "decade", "franchise").alias("cell")).agg(F.collect_list("id").alias("ids"))
    return quality.roster_checks(cells, entries.where("player_id % 11 <> 0"), 6)


CHECK_SQL = f"""WITH {G}, c AS (SELECT decade, franchise, count(*) AS n FROM g GROUP BY 1, 2), m AS (SELECT count(*) AS v FROM g WHERE id NOT IN (SELECT id FROM f WHERE player_id % 11 <> 0)), sm AS (SELECT count(*) FILTER (WHERE n < 6) AS v FROM c)
SELECT 'missing_ids' AS "check", 'rosters' AS subject, v::DOUBLE AS value, 0.0::DOUBLE AS threshold, 'hard' AS level, v = 0 AS passed FROM m
UNION ALL SELECT 'empty_cells', 'rosters', 0.0, 0.0, 'hard', true UNION ALL SELECT 'small_cells', 'rosters', v::DOUBLE, 0.0, 'soft', v = 0 FROM sm"""


def browse_page(spark, sf_dir):
    """Entries of two decades by scoring, then last name, at most 300, with the number of all."""
    entries = filters.in_era(_entries(spark, sf_dir), "decade", ["1970s", "1980s"])
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("player_id"), "s_name")
    found = entries.join(names, "player_id").select("id", "s_name", "scoring")
    return filters.page(found, [F.desc_nulls_last("scoring"), *scalars.by_last_name(F.col("s_name")), F.col("id")], 300)


PAGE_SQL = f"""WITH {D}, j AS (SELECT id, s_name, scoring FROM d JOIN supplier ON s_suppkey = player_id WHERE decade IN ('1970s', '1980s'))
SELECT *, (SELECT count(*) FROM j) AS total FROM j ORDER BY scoring DESC NULLS LAST, string_split(trim(s_name), ' ')[-1], s_name, id LIMIT 300"""


def qualified_criteria(spark, sf_dir):
    """Entries by qualifiers of two abilities, by decade and by the end of the peak team's label."""
    wants = spark.createDataFrame([(1, 1, "scoring", "Elite"), (1, 2, "defense", "weak"), (2, 1, "shooting", None), (2, 2, "shooting", "elite"), (3, 1, "clutch", "decent")], "query_id int, seq int, ability string, qualifier string")
    more = spark.createDataFrame([(3, "season", 5, "decade", "peak_season", 1980.0, None, None), (3, "team:ds", 6, "suffix", None, None, None, "DS")], "query_id int, key string, seq int, kind string, field string, lo double, hi double, text string")
    criteria = filters.qualified(wants).unionByName(more)
    rows = _entries(spark, sf_dir).withColumn("label", F.when(F.col("peak_team") == "R", "Reds").otherwise("Ambers"))
    return matching(rows, "id", criteria, [*ABILITIES, "peak_season"], None, "label")


QUALIFIED_SQL = f"""WITH {D} SELECT 1 AS query_id, id FROM d WHERE coalesce(scoring, 0) >= 90 AND coalesce(defense, 0) <= 45 UNION ALL SELECT 2, id FROM d WHERE coalesce(shooting, 0) >= 70
UNION ALL SELECT 3, id FROM d WHERE coalesce(clutch, 0) >= 60 AND peak_season BETWEEN 1980 AND 1989 AND peak_team = 'R'"""


def archetype_balance(spark, sf_dir):
    """Franchises among the 200 best."""
    return quality.balance(curation.complete(_entries(spark, sf_dir), ABILITIES)[0], "franchise", "defense", "id", 200, 30)


def name_recall(spark, sf_dir):
    """Q6: suppliers with large balances among the 40 best by scoring."""
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("player_id"), F.col("s_name").alias("name"), "s_acctbal")
    return quality.recall(names.where("s_acctbal > 5000"), _entries(spark, sf_dir).join(names, "player_id"), "name", "scoring", 40)


RECALL_SQL = f"""WITH {D}, m AS (SELECT s_name AS name, max(scoring) AS v FROM d JOIN supplier ON s_suppkey = player_id GROUP BY 1), b AS (SELECT name FROM m ORDER BY v DESC NULLS LAST, name LIMIT 40), xs AS (SELECT s_name AS name FROM supplier WHERE s_acctbal > 5000),
n AS (SELECT count(*) AS expected, count(*) FILTER (WHERE name IN (SELECT name FROM b)) AS value FROM xs) SELECT *, value >= greatest(2, (2 * expected + 2) // 3) AS passed FROM n"""


def exact_quantiles(spark, sf_dir):
    """Quantiles of all prices."""
    line = table(spark, sf_dir, "lineitem").select("l_extendedprice")
    return ranking.quantiles(line, "l_extendedprice", {"high": 0.9452007083, "low": 0.25}).select(F.round("high", 6).alias("high"), F.round("low", 6).alias("low"))


def band_accuracy(spark, sf_dir):
    """Accuracy over one band, and over two with enough attempts, shrunk to the season's."""
    t = _stints(spark, sf_dir).select(*STINT, "g", F.when(F.col("player_id") % 5 > 0, F.col("makes") / F.col("g")).alias("p1"), (F.col("g") / 10).alias("s1"), F.when(F.col("season") % 2 == 0, F.col("trb") / (7 * F.col("g"))).alias("p2"), F.lit(0.5).alias("s2"))
    one = shrink.band_shrink(t, [("p1", "s1")], F.col("g"), 100.0, "rim", 1960)
    two = shrink.band_shrink(one, [("p1", "s1"), ("p2", "s2")], F.col("g"), 100.0, "mid", 1960, 2.0)
    return two.select(*STINT, F.round("rim", 6).alias("rim"), F.round("mid", 6).alias("mid"))


BAND_SQL = f"""WITH {T}, b AS (SELECT player_id, season, team, g, CASE WHEN player_id % 5 > 0 THEN makes / g END AS p1, g * (g / 10) AS n1, CASE WHEN season % 2 = 0 THEN trb / (7 * g) END AS p2, g * 0.5::DOUBLE AS n2 FROM t),
c AS (SELECT *, n1 + n2 AS n, coalesce(p1 * n1, 0) + coalesce(p2 * n2, 0) AS m, season >= 1960 AND p1 IS NOT NULL AS ok1, season >= 1960 AND (p1 IS NOT NULL OR p2 IS NOT NULL) AND n1 + n2 >= 2 AS ok2 FROM b),
r AS (SELECT season, sum(p1 * n1) FILTER (WHERE ok1) / sum(n1) FILTER (WHERE ok1) AS u1, sum(m) FILTER (WHERE ok2) / sum(n) FILTER (WHERE ok2) AS u2 FROM c GROUP BY 1)
SELECT player_id, season, team, round(CASE WHEN ok1 THEN (p1 * n1 + u1 * 100) / (n1 + 100) END, 6) AS rim, round(CASE WHEN ok2 THEN (m + u2 * 100) / (n + 100) END, 6) AS mid FROM c JOIN r USING (season)"""

QUERIES = {
    "collapsed_seasons": (collapsed_seasons, COLLAPSE_SQL),
    "team_stints": (team_stints, f"WITH {T} SELECT player_id, season, team, mp, CASE WHEN g >= 2 THEN round_even(trb / g, 1) END AS ppg, CASE WHEN makes > 0 THEN makes END AS makes FROM t"),
    "universe": (universe, f"WITH {U} SELECT player_id, season, team, lg, g, mp FROM u"),
    "universe_funnel": (universe_funnel, f"""WITH {U} SELECT count(*) AS "all", count(*) FILTER (WHERE lg IN ('A', 'B')) AS league, count(*) FILTER (WHERE lg IN ('A', 'B') AND season >= 1947) AS era, (SELECT count(*) FROM u) AS sample FROM l"""),
    "decade_entries": (decade_entries, f"WITH {D} SELECT id, {', '.join(ABILITIES)}, g, round(mp, 2) AS mp, peak_season, peak_team FROM d"),
    "incomplete_entries": (incomplete_entries, f"WITH {D} SELECT (SELECT count(*) FROM d) - (SELECT count(*) FROM f) AS dropped"),
    "starred_seasons": (starred_seasons, STAR_SQL),
    "recognized": (recognized, "SELECT DISTINCT l_suppkey AS player_id, (l_orderkey % 70 + 1945)::INTEGER AS season, 1.0::DOUBLE AS share FROM lineitem WHERE l_quantity >= 45"),
    "decade_rosters": (decade_rosters, f"WITH {G} SELECT decade, franchise, id, place FROM g"),
    "thin_decades": (thin_decades, f"WITH {G} SELECT decade, franchise, count(*) AS n FROM li GROUP BY 1, 2 HAVING count(*) < 86"),
    "shipped_entries": (shipped_entries, SHIP_SQL),
    "grid_axes": (grid_axes, AXES_SQL),
    "pool_ceiling": (pool_ceiling, CEILING_SQL),
    "roster_checks": (roster_checks, CHECK_SQL),
    "browse_page": (browse_page, PAGE_SQL),
    "qualified_criteria": (qualified_criteria, QUALIFIED_SQL),
    "archetype_balance": (archetype_balance, f"WITH {D}, b AS (SELECT franchise FROM f ORDER BY defense DESC, id LIMIT 200) SELECT franchise, count(*) AS value, count(*) >= 30 AS passed FROM b GROUP BY 1"),
    "name_recall": (name_recall, RECALL_SQL),
    "exact_quantiles": (exact_quantiles, "SELECT round(quantile_cont(l_extendedprice::DOUBLE, 0.9452007083), 6) AS high, round(quantile_cont(l_extendedprice::DOUBLE, 0.25), 6) AS low FROM lineitem"),
    "band_accuracy": (band_accuracy, BAND_SQL),
}
