from arbora.llm import common
from arbora.llm.common import joined_hot, numbered, row_keys
from pyspark.sql import functions as F


def test_hot_keys_join_like_others(spark):
    rows = spark.createDataFrame([(i, 7 if i % 2 else i % 9) for i in range(200)] + [(900, None), (901, 44)], "id long, k long")
    table = spark.createDataFrame([(k, f"v{k}") for k in range(9)], "k long, v string")
    for how in ("inner", "left"):
        told = lambda df: sorted(map(str, df.select("id", "k", "v").collect()))
        assert told(joined_hot(rows, table, "k", how, 50)) == told(rows.join(table, "k", how)) == told(joined_hot(rows, table, "k", how))


def test_ranks_over_ranges(spark):
    rows = spark.createDataFrame([(f"s{i % 37}", i) for i in range(300)] + [(None, 1)], "s string, i long").repartition(5)
    found = numbered(rows, [F.col("s").asc_nulls_last(), F.col("i")], "k").collect()
    order = sorted(found, key=lambda r: (r.s is None, r.s or "", r.i))
    assert [r.k for r in order] == list(range(301))


def test_keys_tell_rows_apart(spark):
    rows = spark.createDataFrame([(1, "a"), (1, None), (None, "a"), (1, "a")], "i long, t string")
    keys = [tuple(r) for r in rows.select(*(k.alias(n) for k, n in zip(row_keys("i", "t"), "ab"))).collect()]
    assert len(set(keys)) == 3 and keys[0] == keys[3] and common.HOT_ROWS > 0
