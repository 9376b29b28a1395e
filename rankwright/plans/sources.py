"""Sources and sinks over the driver's tables: each query writes what it reads back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rankwright import sources
from rankwright.functions import scalars
from rankwright.operators import quality, windows
from rankwright.plans import curation
from rankwright.plans.rating import S, seasons, table
from rankwright.plans.tables import _scores
from rankwright.sources import documents


def _place(spark, name):
    return f"{sources.scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def csv_ingest(spark, sf_dir):
    """Orders through a CSV whose prices are partly no numbers; one optional source is there, one is not."""
    path = _place(spark, "csv")
    price = F.when(F.col("o_orderkey") % 5 == 0, "n/a").when(F.col("o_orderkey") % 7 == 0, "NaN").otherwise(F.col("o_totalprice").cast("string"))
    table(spark, sf_dir, "orders").select("o_orderkey", price.alias("price"), "o_orderstatus", "o_custkey").write.option("header", True).csv(path)
    rows = sources.read_csv(spark, path, "o_orderkey long, price string, o_orderstatus string, o_custkey long", ["o_orderkey", "price", "o_custkey"])
    rows = sources.require_columns(rows, ["o_orderkey", "price", "o_custkey"], "orders").withColumn("price", scalars.number(F.col("price")))
    balance = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").cast("double").alias("balance"))
    rows = sources.optional(rows, balance, ["o_custkey"], ["balance"])
    return sources.optional(rows, None, ["o_custkey"], ["shots"]).select("o_orderkey", F.round("price", 4).alias("price"), F.round("balance", 4).alias("balance"), "shots")


CSV_SQL = """SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 AND o_orderkey % 7 > 0 THEN round(o_totalprice::DOUBLE, 4) END AS price, round(c_acctbal::DOUBLE, 4) AS balance, NULL::DOUBLE AS shots
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = 0"""


def document_players(spark, sf_dir):
    """The grid's document in fragments, and its players read back from them."""
    entries, roster = curation._grid(spark, sf_dir)
    ship = curation.curation.shipped(entries, roster, curation._brands(spark).where("franchise <> 'N'"), curation.ABILITIES, {"mpg": "mp", "rpg": "trb"})
    cells = roster.groupBy(F.concat_ws("_", "decade", "franchise").alias("cell")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    path = _place(spark, "document")
    documents.write_fragments(ship, cells, curation.curation.ceiling(entries, roster, curation.ABILITIES), path, grain="decade")
    return documents.read_players(spark, path, ship.schema).select("id", "player_id", "ratings.*", "stats.*", "peak_season", "team_label")


def percentile_document(spark, sf_dir):
    """The score table as a document, read back."""
    path = _place(spark, "percentiles")
    sources.write_percentiles(windows.score_ecdf(_scores(spark, sf_dir), "score"), path, era="all")
    return sources.read_percentiles(spark, path)


PERCENTILE_SQL = """WITH c AS (SELECT floor(o_totalprice / 1000)::INTEGER AS score, count(*) AS n FROM orders GROUP BY 1), g AS (SELECT unnest(generate_series(min(score), max(score)))::INTEGER AS score, sum(n) AS t FROM c)
SELECT g.score, round(100.0 * sum(coalesce(n, 0)) OVER (ORDER BY g.score)::DOUBLE / t::DOUBLE, 2) AS pct FROM g LEFT JOIN c ON g.score = c.score"""


def asset_manifest(spark, sf_dir):
    """A path for each nation's flag, and for nothing twice."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return sources.manifest(rows, "flags", "n_name")


def rating_summary(spark, sf_dir):
    """Mean, least, most and share at the top of two rates."""
    s = seasons(spark, sf_dir).select(F.round(F.col("makes") / F.col("att"), 9).alias("back"), F.round(F.col("open_lines") / F.col("att"), 9).alias("still"))
    return quality.summary(s, ["back", "still"], 1.0)


def _summary_sql(x):
    return f"SELECT '{x}' AS ability, count({x}) AS n, round(avg({x}), 9) AS mean, min({x}) AS least, max({x}) AS most, round(avg(({x} >= 1)::INTEGER), 9) AS at_top FROM r"


QUERIES = {
    "csv_ingest": (csv_ingest, CSV_SQL),
    "document_players": (document_players, curation.SHIP_SQL),
    "percentile_document": (percentile_document, PERCENTILE_SQL),
    "asset_manifest": (asset_manifest, "SELECT DISTINCT 'flags/' || n_name AS path FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "rating_summary": (rating_summary, f"WITH {S}, r AS (SELECT round(makes / att, 9) AS back, round(open_lines / att, 9) AS still FROM s) {_summary_sql('back')} UNION ALL {_summary_sql('still')}"),
}
