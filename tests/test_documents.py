"""Documents in fragments: the same bytes as one made by hand, whatever the number of rows and parts."""

import json

from pyspark.sql import functions as F

from rankwright.sources import documents


def whole(spark, tmp_path, players, rosters, ceiling, **meta):
    documents.write_fragments(players, rosters, ceiling, str(tmp_path / "doc"), **meta)
    documents.joined(spark, str(tmp_path / "doc"), str(tmp_path / "doc.json"))
    return (tmp_path / "doc.json").read_bytes()


def test_bytes_equal_a_document_made_by_hand(spark, tmp_path):
    rows = [("a", "é\"x", 1), ("b", None, 2), ("b", None, 2), ("c", "line\nfeed {[", None)]
    players = spark.createDataFrame(rows, "id string, name string, n int")
    rosters = spark.createDataFrame([("1990s_\"A\"", ["a", "b"]), ("1980s_B", []), (None, ["a"])], "cell string, ids array<string>")
    ceiling = spark.createDataFrame([(9, 9.5)], "x int, total double")
    told = lambda x: json.dumps(x, separators=(",", ":"), ensure_ascii=False)
    lines = sorted(told({k: v for k, v in zip(("id", "name", "n"), r) if v is not None}) for r in rows)
    cells = sorted(told({c: ids})[1:-1] for c, ids in [("1990s_\"A\"", ["a", "b"]), ("1980s_B", [])])
    want = '{"meta":{"grain":"decade","é":"ü"},"players":[\n' + ",\n".join(lines) + '\n],"rosters":{\n' + ",\n".join(cells) + '\n},"ceiling":{"x":9,"total":9.5}}\n'
    assert whole(spark, tmp_path, players, rosters, ceiling, grain="decade", é="ü") == want.encode()
    assert json.loads(want)["players"][0]["id"] == "a"
    back = documents.read_players(spark, str(tmp_path / "doc"), players.schema).collect()
    assert sorted(map(tuple, back), key=str) == sorted(rows, key=str)


def test_empty_tables_make_a_document(spark, tmp_path):
    players = spark.createDataFrame([], "id string")
    rosters = spark.createDataFrame([], "cell string, ids array<string>")
    got = json.loads(whole(spark, tmp_path, players, rosters, spark.createDataFrame([], "x int")))
    assert got == {"meta": {}, "players": [], "rosters": {}, "ceiling": {}}
    assert documents.read_players(spark, str(tmp_path / "doc"), players.schema).collect() == []


def test_many_players_in_many_parts(spark, tmp_path):
    n = 300_000
    players = spark.range(n).select(F.format_string("p%07d", "id").alias("id"), (F.col("id") % 100).alias("rating"))
    rosters = spark.range(50).select(F.format_string("c%02d", "id").alias("cell"), F.array(F.format_string("p%07d", "id")).alias("ids"))
    text = whole(spark, tmp_path, players, rosters, spark.range(1).select(F.lit(99).alias("x")))
    sizes = [p.stat().st_size for p in (tmp_path / "doc").glob("part-*")]
    assert len(sizes) > 1 and max(sizes) < 0.6 * len(text)
    got = json.loads(text)
    assert [p["id"] for p in got["players"]] == [f"p{i:07d}" for i in range(n)] and len(got["rosters"]) == 50
