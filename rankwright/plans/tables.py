"""Joins, windows, filters, draws and curation over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankwright.functions import scalars
from rankwright.operators import filters, joins, quality, sampling, windows
from rankwright.operators.criteria import matching
from rankwright.operators.nearest import nearest
from rankwright.plans.rating import S, seasons, table


def collapse(spark, sf_dir):
    """One line per order: the largest quantity, then the smallest line number."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return windows.first_per_key(line, ["l_orderkey"], [F.desc_nulls_last("l_quantity"), F.col("l_linenumber")])


def forced_roster(spark, sf_dir):
    """Suppliers of each nation by stock, those with negative balances forced in."""
    sup = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal").withColumn("forced", F.col("s_acctbal") < 0)
    return windows.forced_top(sup, ["s_nationkey"], "forced", [F.desc("s_acctbal"), F.col("s_suppkey")], 3, 2).select("s_nationkey", "s_suppkey", "place")


FORCED_SQL = """WITH a AS (SELECT s_nationkey, s_suppkey, s_acctbal, s_acctbal < 0 AS forced FROM supplier),
b AS (SELECT *, count(*) OVER (PARTITION BY s_nationkey) AS n, count(*) FILTER (WHERE forced) OVER (PARTITION BY s_nationkey) AS f,
row_number() OVER (PARTITION BY s_nationkey, forced ORDER BY s_acctbal DESC, s_suppkey) AS p FROM a)
SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey)::INTEGER AS place FROM b WHERE n >= 2 AND (forced OR p <= 3 - f)"""


def first_write(spark, sf_dir):
    """The first event of each user and day."""
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", "value")
    return windows.first_per_key(e, ["user_id", "day"], [F.col("ts"), F.col("event_id")]).select("user_id", "day", "event_id", "value")


def user_streaks(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"))
    return windows.streaks(e, "user_id", "day", F.lit("2024-01-20").cast("date"))


STREAK_SQL = """WITH d AS (SELECT DISTINCT user_id, ts::DATE AS d FROM events), i AS (SELECT *, d - row_number() OVER (PARTITION BY user_id ORDER BY d)::INTEGER AS g FROM d),
r AS (SELECT user_id, g, count(*) AS n, max(d) AS e FROM i GROUP BY 1, 2)
SELECT user_id, max(CASE WHEN e IN (DATE '2024-01-20', DATE '2024-01-19') THEN n ELSE 0 END)::BIGINT AS current, max(n)::BIGINT AS best, sum(n)::BIGINT AS total_days, bool_or(e = DATE '2024-01-20') AS played_today FROM r GROUP BY 1"""


def _scores(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderstatus", F.floor(F.col("o_totalprice") / 1000).cast("int").alias("score"))


def ecdf(spark, sf_dir):
    """Cumulative percent of whole scores per segment."""
    return windows.score_ecdf(_scores(spark, sf_dir), "score", ["o_orderstatus"])


ECDF_SQL = """WITH s AS (SELECT o_orderstatus, floor(o_totalprice / 1000)::INTEGER AS score FROM orders), c AS (SELECT o_orderstatus, score, count(*) AS n FROM s GROUP BY 1, 2),
b AS (SELECT o_orderstatus, min(score) AS lo, max(score) AS hi, sum(n) AS t FROM c GROUP BY 1), g AS (SELECT o_orderstatus, t, unnest(generate_series(lo, hi))::INTEGER AS score FROM b)
SELECT g.o_orderstatus, g.score, round(100.0 * sum(coalesce(n, 0)) OVER (PARTITION BY g.o_orderstatus ORDER BY g.score)::DOUBLE / t::DOUBLE, 2) AS pct FROM g LEFT JOIN c ON g.o_orderstatus = c.o_orderstatus AND g.score = c.score"""


def ecdf_anchor(spark, sf_dir):
    return windows.ecdf_anchor(ecdf(spark, sf_dir), 99.0, ["o_orderstatus"])


def ecdf_lookup(spark, sf_dir):
    """Percentile and top share of each customer's mean order."""
    curve = windows.score_ecdf(_scores(spark, sf_dir), "score")
    mean = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.avg("o_totalprice") / 1000, 6).alias("score"))
    return windows.ecdf_lookup(mean, "score", curve, "pct").select("o_custkey", "pct", scalars.top_share(F.col("pct")).alias("top"))


LOOKUP_SQL = """WITH s AS (SELECT floor(o_totalprice / 1000)::INTEGER AS score FROM orders), c AS (SELECT score, count(*) AS n FROM s GROUP BY 1), b AS (SELECT min(score) AS lo, max(score) AS hi, sum(n) AS t FROM c),
g AS (SELECT t, unnest(generate_series(lo, hi))::INTEGER AS score FROM b), e AS (SELECT g.score, round(100.0 * sum(coalesce(n, 0)) OVER (ORDER BY g.score)::DOUBLE / t::DOUBLE, 2) AS pct FROM g LEFT JOIN c ON g.score = c.score),
m AS (SELECT o_custkey, round(avg(o_totalprice) / 1000, 6) AS score FROM orders GROUP BY 1)
SELECT o_custkey, pct, CASE WHEN pct >= 50 THEN greatest(floor(100 - pct + 0.5), 1)::INTEGER END AS top FROM m, b JOIN e ON e.score = least(greatest(floor(m.score + 0.5)::INTEGER, b.lo), b.hi)"""


def resolve_names(spark, sf_dir):
    """Part names, some cut to a token, found again among the parts of their size."""
    parts = table(spark, sf_dir, "part").select(F.col("p_size").alias("season"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ident"))
    kind = F.col("ident") % 3
    rows = parts.select("season", F.when(kind == 0, F.col("name")).when(kind == 1, F.concat(F.lit("x "), scalars.last_token(F.col("name")))).otherwise(F.concat(scalars.first_token(F.col("name")), F.lit(" y"))).alias("name"))
    return joins.resolve(rows, parts, "season", "name", "ident", scalars.last_token(F.col("name")), scalars.first_token(F.col("name")))


RESOLVE_SQL = """WITH p AS (SELECT p_size AS season, p_name AS name, p_partkey AS ident, string_split(p_name, ' ')[-1] AS l, string_split(p_name, ' ')[1] AS f FROM part),
b AS (SELECT DISTINCT season, CASE ident % 3 WHEN 0 THEN name WHEN 1 THEN 'x ' || l ELSE f || ' y' END AS name FROM p),
u AS (SELECT season, name, min(ident) AS i FROM p GROUP BY 1, 2 HAVING count(DISTINCT ident) = 1), ul AS (SELECT season, l AS t, min(ident) AS i FROM p GROUP BY 1, 2 HAVING count(DISTINCT ident) = 1),
uf AS (SELECT season, f AS t, min(ident) AS i FROM p GROUP BY 1, 2 HAVING count(DISTINCT ident) = 1),
e AS (SELECT b.season, b.name, u.i AS ident, CASE WHEN u.i IS NOT NULL THEN 'exact' END AS tier FROM b LEFT JOIN u ON b.season = u.season AND b.name = u.name),
o1 AS (SELECT season, string_split(name, ' ')[-1] AS t, min(name) AS name FROM e WHERE ident IS NULL GROUP BY 1, 2 HAVING count(*) = 1),
e1 AS (SELECT e.season, e.name, coalesce(e.ident, ul.i) AS ident, CASE WHEN ul.i IS NOT NULL THEN 'last' ELSE tier END AS tier FROM e LEFT JOIN o1 ON e.ident IS NULL AND o1.season = e.season AND o1.name = e.name LEFT JOIN ul ON ul.season = o1.season AND ul.t = o1.t),
o2 AS (SELECT season, string_split(name, ' ')[1] AS t, min(name) AS name FROM e1 WHERE ident IS NULL GROUP BY 1, 2 HAVING count(*) = 1)
SELECT e1.season, e1.name, coalesce(e1.ident, uf.i) AS ident, CASE WHEN uf.i IS NOT NULL THEN 'first' ELSE tier END AS tier FROM e1 LEFT JOIN o2 ON e1.ident IS NULL AND o2.season = e1.season AND o2.name = e1.name LEFT JOIN uf ON uf.season = o2.season AND uf.t = o2.t"""


def intervals(spark, sf_dir):
    """Each supplier's first and last year as an interval with its balance, the larger of that and the season's."""
    s = seasons(spark, sf_dir)
    spans = s.groupBy("l_suppkey").agg(F.min("season").alias("a"), F.max("season").alias("b"), F.max("makes").alias("share"))
    out = joins.expand_intervals(spans, ["l_suppkey"], "a", "b", "share")
    return out.join(s.select("l_suppkey", "season", "att"), ["l_suppkey", "season"], "left").select("l_suppkey", "season", F.greatest("share", "att").alias("share"))


INTERVAL_SQL = f"""WITH {S}, i AS (SELECT l_suppkey, min(season) AS a, max(season) AS b, max(makes) AS share FROM s GROUP BY 1), g AS (SELECT l_suppkey, share, unnest(generate_series(a, b))::INTEGER AS season FROM i)
SELECT g.l_suppkey, g.season, greatest(share, att) AS share FROM g LEFT JOIN s ON s.l_suppkey = g.l_suppkey AND s.season = g.season"""


def clutch_events(spark, sf_dir):
    """Purchases in the last five minutes of an hour, weighted by the customer's standing."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").where((F.minute("ts") * 60 + F.second("ts")) >= 3300)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_acctbal")
    weight = F.when(F.coalesce(F.col("c_acctbal"), F.lit(0.0)) <= 0, 1.0).otherwise(0.25)
    return e.join(c, "user_id", "left").groupBy("user_id").agg(F.round(F.sum(F.col("value") * weight), 4).alias("points"), F.count_distinct(F.to_date("ts")).alias("days"))


CLUTCH_SQL = """SELECT user_id, round(sum(value * CASE WHEN coalesce(c_acctbal, 0.0) <= 0 THEN 1.0 ELSE 0.25 END::DOUBLE), 4) AS points, count(DISTINCT ts::DATE) AS days FROM events LEFT JOIN customer ON c_custkey = user_id
WHERE event_type = 'purchase' AND minute(ts) * 60 + second(ts) >= 3300 GROUP BY 1"""


def as_of_eras(spark, sf_dir):
    """The era of each order by its status's list of last years."""
    eras = spark.createDataFrame([("O", 1996, "early"), ("O", 1999, "middle"), ("F", 1997, "first"), ("P", 2005, "only")], "code string, until int, name string")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("code"), "o_orderdate")
    return joins.as_of(orders, "code", F.year("o_orderdate"), eras, "until", "name", "era").select("o_orderkey", "era")


ASOF_SQL = """WITH e(code, until, name) AS (VALUES ('O', 1996, 'early'), ('O', 1999, 'middle'), ('F', 1997, 'first'), ('P', 2005, 'only'))
SELECT o_orderkey, (SELECT min_by(name, until) FROM e WHERE code = o_orderstatus AND until >= year(o_orderdate)) AS era FROM orders"""


def nearest_profile(spark, sf_dir):
    """The nearest supplier-year of the suppliers' whole profiles, for a stated set of suppliers."""
    prof = seasons(spark, sf_dir).groupBy("l_suppkey").agg(F.sum("makes").alias("a"), F.sum("att").alias("b"), F.round(F.sum("qty"), 2).alias("c"))
    return nearest(prof.where("l_suppkey % 20 = 0"), prof, "l_suppkey", ["a", "b", "c"]).select("query_id", "match", F.round("distance", 6).alias("distance"), "percent")


NEAREST_SQL = f"""WITH {S}, p AS (SELECT l_suppkey AS id, sum(makes) AS a, sum(att) AS b, round(sum(qty), 2) AS c FROM s GROUP BY 1),
z AS (SELECT id, a AS ra, b AS rb, c AS rc, (a - avg(a) OVER ()) / CASE WHEN stddev_pop(a) OVER () = 0 THEN 1 ELSE stddev_pop(a) OVER () END AS a, (b - avg(b) OVER ()) / CASE WHEN stddev_pop(b) OVER () = 0 THEN 1 ELSE stddev_pop(b) OVER () END AS b, (c - avg(c) OVER ()) / CASE WHEN stddev_pop(c) OVER () = 0 THEN 1 ELSE stddev_pop(c) OVER () END AS c FROM p),
d AS (SELECT q.id AS query_id, greatest(least(floor(100.5 - round((abs(q.ra - p.ra) + abs(q.rb - p.rb) + abs(q.rc - p.rc)) / 3, 9)), 100), 0)::INTEGER AS percent, p.id AS match, round((0.25 + greatest(q.a, 0)) * (q.a - p.a) ** 2 + (0.25 + greatest(q.b, 0)) * (q.b - p.b) ** 2 + (0.25 + greatest(q.c, 0)) * (q.c - p.c) ** 2, 9) AS distance FROM z q JOIN z p ON p.id <> q.id WHERE q.id % 20 = 0)
SELECT query_id, match, round(distance, 6) AS distance, percent FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, match) AS n FROM d) WHERE n = 1"""


def _cells(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.select(F.col("r_name").alias("franchise"), F.col("n_name").alias("axis"))


def grid_index(spark, sf_dir):
    """The sorted set of nations per region."""
    return _cells(spark, sf_dir).groupBy("franchise").agg(F.array_join(F.array_sort(F.collect_set("axis")), ",").alias("nations"))


def grid_alternates(spark, sf_dir):
    return joins.alternates(_cells(spark, sf_dir), "franchise", "axis")


CELLS_SQL = "c AS (SELECT DISTINCT r_name AS franchise, n_name AS axis FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def part_funnel(spark, sf_dir):
    """P8."""
    part = table(spark, sf_dir, "part")
    return filters.funnel(part, {"big": F.col("p_size") >= 10, "costly": F.col("p_retailprice") >= 1000, "brand": F.upper("p_brand").endswith("1")})


FUNNEL_SQL = """SELECT count(*) AS "all", count(*) FILTER (WHERE p_size >= 10) AS big, count(*) FILTER (WHERE p_size >= 10 AND p_retailprice >= 1000) AS costly,
count(*) FILTER (WHERE p_size >= 10 AND p_retailprice >= 1000 AND upper(p_brand) LIKE '%1') AS brand FROM part"""


def part_criteria(spark, sf_dir):
    """P10: three queries of criteria over all parts."""
    rows = [(1, "size", 1, "range", "p_size", 40.0, None, None), (1, "size", 2, "range", "p_size", 1.0, None, None), (1, "price", 3, "range", "p_retailprice", None, 1500.0, None), (2, "name", 1, "words", None, None, None, "a e"), (3, None, 1, None, None, None, None, None)]
    criteria = spark.createDataFrame(rows, "query_id int, key string, seq int, kind string, field string, lo double, hi double, text string")
    return matching(table(spark, sf_dir, "part"), "p_partkey", criteria, ["p_size", "p_retailprice"], "p_name")


CRITERIA_SQL = """SELECT 1 AS query_id, p_partkey FROM part WHERE p_size >= 40 AND p_retailprice <= 1500
UNION ALL SELECT 2, p_partkey FROM part WHERE lower(p_name) LIKE '%a%' AND lower(p_name) LIKE '%e%' UNION ALL SELECT 3, p_partkey FROM part"""


def box_aggregate(spark, sf_dir):
    """Sums and counts, rates derived again from the sums."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("games"), F.count_if(F.col("l_returnflag") == "R").alias("wins"), F.round(F.sum("l_quantity"), 2).alias("points"), F.round(F.sum("l_tax"), 2).alias("tax"))
    return g.select("l_suppkey", "games", "wins", scalars.per_game(F.col("points"), F.col("games")).alias("ppg"), F.round(scalars.true_shooting(F.col("points"), F.col("games"), F.col("wins")), 6).alias("ts"))


BOX_SQL = """WITH g AS (SELECT l_suppkey, count(*) AS games, count(*) FILTER (WHERE l_returnflag = 'R') AS wins, round(sum(l_quantity), 2) AS points FROM lineitem GROUP BY 1)
SELECT l_suppkey, games, wins, round_even(points / greatest(games, 1), 1) AS ppg, round(points / (2 * (games + 0.44::DOUBLE * wins)), 6) AS ts FROM g"""


def season_leaders(spark, sf_dir):
    """The best of each season, ties included, with enough lines."""
    s = seasons(spark, sf_dir).where("att >= 3")
    return s.join(s.groupBy("season").agg(F.max("qty").alias("qty")), ["season", "qty"]).select("season", "l_suppkey", "qty")


def names(spark, sf_dir):
    """normal names of parts, their ends, and the folded form."""
    n = scalars.normal_name(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", n.alias("name"), scalars.last_token(n).alias("last"), scalars.first_token(n).alias("first"), scalars.folded(F.col("p_brand")).alias("brand"))


NAMES_SQL = r"""WITH n AS (SELECT p_partkey, p_brand, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(lower(strip_accents(p_name)), '[^a-z ]', '', 'g'), ' +', ' ', 'g'), ' '), lambda t: t <> '' AND t NOT IN ('jr', 'sr', 'ii', 'iii', 'iv', 'v')), ' ') AS name FROM part)
SELECT p_partkey, name, string_split(name, ' ')[-1] AS "last", string_split(name, ' ')[1] AS "first", regexp_replace(lower(p_brand), '[^\p{L}\p{N}]', '', 'g') AS brand FROM n"""


def run_totals(spark, sf_dir):
    """First six lines of an order as slots, running sum and overall."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("slot"), F.col("l_quantity").cast("int").alias("rating"))
    one = windows.first_per_key(line, ["l_orderkey", "slot"], [F.desc("rating")])
    total = windows.running_total("rating", ["l_orderkey"], [F.col("slot")])
    return one.select("l_orderkey", "slot", total.alias("total"), scalars.overall(10 * total, 588).alias("ovr"))


RUN_SQL = """WITH o AS (SELECT l_orderkey, l_linenumber AS slot, max(l_quantity::INTEGER) AS rating FROM lineitem GROUP BY 1, 2), t AS (SELECT l_orderkey, slot, (sum(rating) OVER (PARTITION BY l_orderkey ORDER BY slot))::BIGINT AS total FROM o)
SELECT l_orderkey, slot, total, least(greatest(floor(78 + (10 * total - 470) * 21 / (588.0::DOUBLE - 470) + 0.5), 40), 99)::INTEGER AS ovr FROM t"""


def filled_lookup(spark, sf_dir):
    """A table of every third score and some at 0, filled, and the first score of stated percentiles."""
    curve = windows.score_ecdf(_scores(spark, sf_dir), "score").where("score % 3 = 0").withColumn("pct", F.when(F.col("score") % 9 == 0, 0.0).otherwise(F.col("pct")))
    curve = windows.filled_ecdf(curve)
    wanted = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 101).cast("double").alias("target")).distinct()
    found = windows.scores_for(curve, wanted, "target")
    return windows.ecdf_lookup(found, "score", curve, "pct")


FILLED_SQL = """WITH s AS (SELECT floor(o_totalprice / 1000)::INTEGER AS score FROM orders), c AS (SELECT score, count(*) AS n FROM s GROUP BY 1), b AS (SELECT min(score) AS lo, max(score) AS hi, sum(n) AS t FROM c),
g AS (SELECT t, unnest(generate_series(lo, hi))::INTEGER AS score FROM b), e AS (SELECT g.score, round(100.0 * sum(coalesce(n, 0)) OVER (ORDER BY g.score)::DOUBLE / t::DOUBLE, 2) AS pct FROM g LEFT JOIN c ON g.score = c.score),
k AS (SELECT score, CASE WHEN score % 9 = 0 THEN 0.0 ELSE pct END AS pct FROM e WHERE score % 3 = 0), h AS (SELECT unnest(generate_series(min(score), max(score)))::INTEGER AS score FROM k),
f AS (SELECT h.score, coalesce(last_value(CASE WHEN pct > 0 THEN pct END IGNORE NULLS) OVER (ORDER BY h.score), 0.0) AS pct FROM h LEFT JOIN k ON k.score = h.score),
w AS (SELECT DISTINCT (o_custkey % 101)::DOUBLE AS target FROM orders), m AS (SELECT target, coalesce((SELECT min(score) FROM f WHERE pct >= target), (SELECT max(score) FROM f)) AS score FROM w)
SELECT target, m.score, pct FROM m JOIN f ON f.score = m.score"""


def full_runs(spark, sf_dir):
    """Orders whose lines fill slots one to six, their total, overall and tier."""
    line = table(spark, sf_dir, "lineitem").where("l_linenumber <= 6").select("l_orderkey", "l_linenumber", F.least(F.col("l_quantity").cast("int") * 2 + 30, F.lit(99)).alias("rating"), "l_suppkey")
    runs = windows.run_scores(line, "l_orderkey", "l_linenumber", "rating", [F.desc("rating"), F.col("l_suppkey")])
    ovr = scalars.overall(F.col("total"), 588)
    return runs.withColumn("ovr", ovr).select("l_orderkey", "total", "perfect", "ovr", scalars.tier(F.col("ovr"), scalars.TIER_BOUNDS).alias("tier"))


FULL_SQL = """WITH o AS (SELECT l_orderkey, l_linenumber, max(least(trunc(l_quantity)::INTEGER * 2 + 30, 99)) AS rating FROM lineitem WHERE l_linenumber <= 6 GROUP BY 1, 2), t AS (SELECT l_orderkey, sum(rating)::BIGINT AS total, bool_and(rating = 99) AS perfect FROM o GROUP BY 1 HAVING count(*) = 6),
v AS (SELECT *, least(greatest(floor(78 + (total - 470) * 21 / (588.0::DOUBLE - 470) + 0.5), 40), 99)::INTEGER AS ovr FROM t)
SELECT *, CASE WHEN ovr >= 99 THEN '99+' WHEN ovr >= 90 THEN '90+' WHEN ovr >= 82 THEN '82+' WHEN ovr >= 74 THEN '74+' WHEN ovr >= 65 THEN '65+' ELSE 'below' END AS tier FROM v"""


def loose_ids(spark, sf_dir):
    """Parts of orders that are not among the large ones, under their successor's key where one is stated."""
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("ids"))
    loose = joins.dangling(lists, "ids", table(spark, sf_dir, "part").where("p_size >= 5").select(F.col("p_partkey").alias("id")), "id")
    later = table(spark, sf_dir, "part").where("p_size = 1").select(F.col("p_partkey").alias("old"), (F.col("p_partkey") + 1).alias("new"))
    return joins.with_fallback(loose, "id", later, "old", "new", "current")


def drawn_boards(spark, sf_dir):
    """K1, K2: boards for every customer as seed, and a rerolled cell."""
    cells = _cells(spark, sf_dir).select(F.col("axis").alias("cell"), "franchise")
    seeds = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seed"))
    other = joins.alternates(cells.select("franchise", F.col("cell").alias("axis")), "franchise", "axis").select(F.col("axis").alias("cell"), "alternate")
    return sampling.reroll(sampling.boards(seeds, cells), other)


def digests(spark, sf_dir):
    """Q9."""
    return quality.digest(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("day")))


DRAW = "(('0x' || substr(md5({}), 1, 15))::BIGINT % {})"
BOARD_SQL = f"""WITH {CELLS_SQL}, l AS (SELECT axis AS cell, row_number() OVER (ORDER BY axis) - 1 AS at, count(*) OVER () AS n FROM (SELECT DISTINCT axis FROM c)),
d AS (SELECT c_custkey AS seed, spin FROM customer, (SELECT unnest(generate_series(1, 6))::INTEGER AS spin)),
b AS (SELECT seed, spin, cell FROM d JOIN l ON l.at = {DRAW.format("concat_ws('|', seed, spin, 'cell')", "l.n")}),
o AS (SELECT x.axis AS cell, list_sort(list(DISTINCT y.axis)) AS others FROM c x JOIN c y ON x.franchise = y.franchise AND x.axis <> y.axis GROUP BY 1)
SELECT seed, spin, b.cell, others[{DRAW.format("concat_ws('|', seed, spin, 'axis', b.cell)", "len(others)")} + 1] AS alternate FROM b LEFT JOIN o ON o.cell = b.cell"""
DIGEST_SQL = f"""WITH h AS (SELECT ('0x' || substr(md5(concat_ws('|', {", ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, 'n')" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate::DATE"))})), 1, 15))::BIGINT AS h FROM orders) SELECT count(*) AS rows, bit_xor(h) AS xor, sum(h::HUGEINT)::DECIMAL(38, 0) AS sum FROM h"""


def archive(spark, sf_dir):
    """Every January day with its count of events, day number and overall: that of the day, else by the count."""
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    spine = span.select(F.explode(F.sequence("a", "b")).alias("day"), "a")
    return spine.join(days, "day", "left").select("day", scalars.day_number(F.col("day"), F.col("a")).alias("number"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.when(F.col("n") % 2 == 0, F.lit(77)), scalars.overall(F.col("n"), 588)).alias("ovr"))


ARCHIVE_SQL = """WITH d AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1), s AS (SELECT min(day) AS a, max(day) AS b FROM d), g AS (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day, a FROM s)
SELECT g.day, (g.day - a + 1)::INTEGER AS number, coalesce(n, 0) AS n, CASE WHEN n % 2 = 0 THEN 77 WHEN n IS NOT NULL THEN least(greatest(floor(78 + (n - 470) * 21 / (588.0::DOUBLE - 470) + 0.5), 40), 99)::INTEGER END AS ovr FROM g LEFT JOIN d ON d.day = g.day"""

QUERIES = {
    "collapse_lines": (collapse, "SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC NULLS LAST, l_linenumber) AS n FROM lineitem) WHERE n = 1"),
    "forced_roster": (forced_roster, FORCED_SQL),
    "first_write": (first_write, "SELECT user_id, day, event_id, value FROM (SELECT user_id, ts::DATE AS day, event_id, value, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS n FROM events) WHERE n = 1"),
    "streaks": (user_streaks, STREAK_SQL),
    "score_ecdf": (ecdf, ECDF_SQL),
    "ecdf_anchor": (ecdf_anchor, f"WITH e AS ({ECDF_SQL}) SELECT o_orderstatus, coalesce(min(CASE WHEN pct >= 99.0 THEN score END), max(score)) AS anchor FROM e GROUP BY 1"),
    "ecdf_lookup": (ecdf_lookup, LOOKUP_SQL),
    "entity_resolution": (resolve_names, RESOLVE_SQL),
    "interval_expansion": (intervals, INTERVAL_SQL),
    "clutch_events": (clutch_events, CLUTCH_SQL),
    "as_of_era": (as_of_eras, ASOF_SQL),
    "nearest_profile": (nearest_profile, NEAREST_SQL),
    "grid_index": (grid_index, f"WITH {CELLS_SQL} SELECT franchise, string_agg(axis, ',' ORDER BY axis) AS nations FROM c GROUP BY 1"),
    "grid_alternates": (grid_alternates, f"WITH {CELLS_SQL} SELECT a.franchise, a.axis, b.axis AS alternate FROM c a JOIN c b ON a.franchise = b.franchise AND a.axis <> b.axis"),
    "stage_funnel": (part_funnel, FUNNEL_SQL),
    "batch_criteria": (part_criteria, CRITERIA_SQL),
    "box_aggregate": (box_aggregate, BOX_SQL),
    "season_leaders": (season_leaders, f"WITH {S} SELECT season, l_suppkey, qty FROM (SELECT *, rank() OVER (PARTITION BY season ORDER BY qty DESC) AS r FROM s WHERE att >= 3) WHERE r = 1"),
    "normal_names": (names, NAMES_SQL),
    "run_totals": (run_totals, RUN_SQL),
    "filled_lookup": (filled_lookup, FILLED_SQL),
    "full_runs": (full_runs, FULL_SQL),
    "loose_ids": (loose_ids, "WITH l AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size >= 5)) SELECT id, CASE WHEN id IN (SELECT p_partkey FROM part WHERE p_size = 1) THEN id + 1 ELSE id END AS current FROM l"),
    "keyed_boards": (drawn_boards, BOARD_SQL),
    "content_digest": (digests, DIGEST_SQL),
    "calendar_archive": (archive, ARCHIVE_SQL),
}
