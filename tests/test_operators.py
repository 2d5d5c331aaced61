"""Column functions and DataFrame operators on small cases."""

from pyspark.sql import functions as F

from arbora.functions import text
from arbora.operators import joins, tree, windows
from arbora.streaming.budget import budgets


def one(spark, column, **values):
    kinds = {int: "int", str: "string", float: "double", type(None): "string"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())).select(column.alias("x")).first().x


def test_text(spark):
    assert one(spark, text.normalized_identifier(F.col("a")), a="  9.10.  3.. ") == "9.10. 3"
    assert one(spark, text.plain_characters(F.col("a")), a="“a”–‘b’²") == "\"a\"-'b'2"
    assert one(spark, text.duration(F.col("a")), a=59.96) == "1m 00s"
    assert one(spark, text.duration(F.col("a")), a=0.44) == "0.4 s"
    assert one(spark, text.duration(F.col("a")), a=3785.0) == "1h 03m 05s"
    assert one(spark, text.heading_type(F.col("a")), a="3.2.2.64.Group D") == "Article"
    assert one(spark, text.heading_type(F.col("a")), a="3.2.2. Walls") == "Subsection"
    assert one(spark, text.marker_kind(text.marker_token(F.col("a"))), a="iv) text") == "subclause"
    assert one(spark, text.roman(F.col("a")), a=49) == "xlix"
    assert one(spark, text.title_key(F.col("a")), a="Wall (1) types^{(2)} Forming Part of Sentence 3") == "walltypes"


def test_keys(spark):
    level = lambda rows: spark.createDataFrame(rows, "node_id long, parent_id long, type string, identifier string, ord long")
    rules = {"div": tree.KeyRule("root", scope=True, fallback="FM"), "part": tree.KeyRule("child"), "table": tree.KeyRule("ordinal", "T", scoped=True), "note": tree.KeyRule("literal", "Notes")}
    levels = [level([(1, None, "div", "B", 1), (2, None, "div", "", 2)]), level([(3, 1, "part", "9.", 1), (4, 1, "part", "9", 2), (5, 2, "part", "", 1), (6, 1, "note", "", 3)]), level([(7, 3, "table", "", 1), (8, 4, "table", "", 1)])]
    keys = {r.node_id: r.key for out in tree.keyed_levels(levels, rules) for r in out.collect()}
    assert keys == {1: "B", 2: "FM", 3: "B.9", 4: "B.9~2", 5: "FM.part1", 6: "B.Notes", 7: "B.T1", 8: "B.T2"}


def test_group_rank(spark):
    rows = spark.range(1000).selectExpr("id % 3 AS k", "id * 7 % 1000 AS v")
    ranks = {(r.k, r.v): r.n for r in tree.group_rank(rows, ["k"], ["v"], "n").collect()}
    for k in range(3):
        mine = sorted(v for kk, v in ranks if kk == k)
        assert [ranks[k, v] for v in mine] == list(range(1, len(mine) + 1))


def test_roll_up(spark):
    leaves = spark.createDataFrame([("r", "r.a", True), ("r", "r.b", False)], "top string, leaf string, ok boolean")
    assert {r.key: (r.ok, r.n_failed) for r in tree.rolled_up(leaves, ["top", "leaf"]).collect()} == {"r": (False, 1), "r.a": (True, 0), "r.b": (False, 1)}


def test_override_null_is_not_missing(spark):
    left = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    over = spark.createDataFrame([("a", "z"), ("b", None)], "key string, partner string")
    assert {r.key: r.partner_key for r in joins.with_override(left, over, "key").collect()} == {"a": "z", "b": None, "c": "c"}


def test_packing_and_shares(spark):
    rows = spark.createDataFrame([(1, i, w) for i, w in enumerate([5, 5, 50, 1, 1, 1])], "k long, o long, w long")
    assert [r.batch for r in windows.packed(rows, ["k"], "o", "w", 3, 10).orderBy("o").collect()] == [0, 0, 1, 2, 2, 2]
    shares = windows.apportioned(rows.withColumn("t", F.lit(10)), ["k"], "o", "w", "t").collect()
    assert sum(r.share for r in shares) == 10
    even = windows.apportioned(rows.withColumn("w", F.lit(0)).withColumn("t", F.lit(8)), ["k"], "o", "w", "t").orderBy("o").collect()
    assert [r.share for r in even] == [2, 2, 1, 1, 1, 1]


def test_as_of_ties_and_absence(spark):
    rows = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k long, t long")
    versions = spark.createDataFrame([(1, 5, "now"), (1, 2, "old")], "k long, t long, v string")
    assert {(r.k, r.t): r.v2 for r in joins.as_of(rows, versions, ["k"], "t", "v", "v2").collect()} == {(1, 5): "now", (1, 1): None, (2, 9): None}


def test_stream_budget(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 00:00:05", 3), ("2024-01-01 00:00:20", 4)], "ts string, tokens long").selectExpr("CAST(ts AS timestamp) AS ts", "tokens")
    events.write.parquet(str(tmp_path / "in"))
    stream = budgets(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("budget").option("checkpointLocation", str(tmp_path / "at")).start()
    query.processAllAvailable()
    query.stop()
    got = {(str(r.start), r.requests, r.tokens) for r in spark.table("budget").collect()}
    assert got == {(str(r.start), r.requests, r.tokens) for r in budgets(events).collect()}
    assert max(t for _, _, t in got) == 7


def test_packing_keeps_rows_on_ties(spark):
    rows = spark.createDataFrame([("k", 1, 5, "a"), ("k", 1, 5, "b"), ("k", 2, 5, "c"), ("j", 1, None, "d")], "k string, o int, w long, v string")
    found = sorted((r.v, r.batch) for r in windows.packed(rows, ["k"], "o", "w", 2, 100).collect())
    assert [v for v, _ in found] == ["a", "b", "c", "d"] and sorted(b for v, b in found if v in "abc") == [0, 0, 1]
    named = spark.createDataFrame([("k", "x", 60.0), ("k", "y", 60.0), ("k", "z", 600.0)], "k string, o string, w double")
    assert sorted((r.o, r.batch) for r in windows.packed(named, ["k"], "o", "w", 10, 100, 10).collect()) == [("x", 0), ("y", 1), ("z", 2)]
