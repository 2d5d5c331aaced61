"""Readers, sinks and page operators on small cases."""

import pytest
from pyspark.sql import functions as F

from arbora.operators import pages
from arbora.sources import files


def test_cache_round_trip(spark, tmp_path):
    path, schema = f"{tmp_path}/cache", "key string, verdict string, cost double"
    assert files.read_cache(spark, path, schema).count() == 0
    files.write_cache(spark.createDataFrame([("a", "same", None), ("b", "differs", 0.5)], schema), path)
    old = files.read_cache(spark, path, schema)
    files.write_cache(files.upserted(old, spark.createDataFrame([("b", "same", 1.0), ("c", "same", None)], schema), "key"), path)
    assert sorted(tuple(r) for r in files.read_cache(spark, path, schema).collect()) == [("a", "same", None), ("b", "same", 1.0), ("c", "same", None)]
    assert not any("cost" in line for f in (tmp_path / "cache").glob("part*") for line in f.read_text().splitlines() if '"a"' in line)
    next((tmp_path / "cache").glob("part*")).write_text("{broken\n")
    for crc in (tmp_path / "cache").glob(".part*"):
        crc.unlink()
    assert files.read_cache(spark, path, schema).count() == 0


def test_checked_json(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"id": "x", "n": 1}')
    (tmp_path / "bad.json").write_text('{"n": 1}')
    (tmp_path / "broken.json").write_text('{"n": ')
    assert files.checked_json(spark, f"{tmp_path}/good.json", "id string, n int", ("id",)).first().id == "x"
    for name in ("bad", "broken", "none"):
        with pytest.raises(Exception, match="missing|FAILED_READ|Malformed|PATH"):
            files.checked_json(spark, f"{tmp_path}/{name}.json", "id string, n int", ("id",)).collect()


def test_files_and_bytes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.png", "b.c.png", ".hidden"):
        (tmp_path / "in" / name).write_bytes(name.encode())
    found = files.visible_files(spark, str(tmp_path / "in"))
    assert sorted((r.name, r.stem, r.length) for r in found.collect()) == [("a.png", "a", 5), ("b.c.png", "b.c", 7)]
    rows = spark.createDataFrame([("a.png",), ("gone.png",)], "path string")
    assert sorted((r.path, r.content and bytes(r.content)) for r in files.with_bytes(rows, "path", str(tmp_path / "in")).collect()) == [("a.png", b"a.png"), ("gone.png", None)]


def test_fallback(spark, tmp_path):
    good = lambda: spark.range(3)
    bad = lambda: spark.read.parquet(f"{tmp_path}/none")
    assert files.first_that_works(bad, good).count() == 3
    with pytest.raises(ValueError, match="no source works.*;"):
        files.first_that_works(bad, bad)


def test_settings(spark):
    text = "# note\nexport A = 'x y'\nB=\"1=2\"\n\nnothing\nA=z"
    (row,) = spark.createDataFrame([(text,)], "t string").select(files.settings(F.col("t")).alias("m")).collect()
    assert row.m == {"A": "z", "B": "1=2"}


def test_publishing_order(spark):
    state = spark.createDataFrame([("e1", "K-1"), ("s1", "K-2")], "key string, id string")
    parents = spark.createDataFrame([("e1",), ("e2",)], "key string")
    children = spark.createDataFrame([("s1", "e1"), ("s2", "e1"), ("s3", "e2")], "key string, parent string")
    left = files.to_publish(parents, children, state).orderBy("step", "key").collect()
    assert [(r.key, r.parent_id, r.step) for r in left] == [("e2", None, 0), ("s2", "K-1", 1), ("s3", None, 1)]


def test_report_and_pruning(spark):
    pairs = spark.createDataFrame([("a", "a.png", "a.jpg", 97.25), ("b", "b.png", None, None), ("c", "c.png", "c.jpg", 50.0), ("d", None, "d.jpg", None)], "stem string, left string, right string, score double")
    assert [r.line for r in files.report_lines(pairs).orderBy("ord").collect()] == ["c: 50.0%", "a: 97.3%", "only left: b.png", "only right: d.jpg"]
    rows = spark.createDataFrame([("Part", "t", "c"), ("Sentence", "t", ""), ("Cell", "t", "c")], "type string, title string, content string")
    kept = files.pruned(rows, "type", {"Part": ("title",), "Cell": ("content",), "Sentence": ("content",)}, ("title", "content"))
    assert [tuple(r) for r in kept.collect()] == [("Part", "t", None), ("Sentence", None, None), ("Cell", None, "c")]


def test_styled_ranges(spark):
    ranges = "array<struct<s:int,e:int,style:string>>"
    rows = spark.createDataFrame([("ab cd ef", [(0, 2, "b"), (2, 5, "b"), (6, 8, "i")])], f"t string, r {ranges}")
    t, r = F.col("t"), F.col("r")
    (got,) = rows.select(pages.merged_ranges(r).alias("m"), pages.sliced(t, r, F.lit(2), F.lit(7)).alias("s"), pages.joined_texts(t, r, t, r).alias("j")).collect()
    plain = lambda xs: [tuple(x) for x in xs]
    assert plain(got.m) == [(0, 5, "b"), (6, 8, "i")]
    assert got.s.text == "cd e" and plain(got.s.emphasis) == [(0, 2, "b"), (3, 4, "i")]
    assert got.j.text == "ab cd ef ab cd ef" and plain(got.j.emphasis) == [(0, 5, "b"), (6, 8, "i"), (9, 14, "b"), (15, 17, "i")]


def test_stitching(spark):
    rows = [("t", 1, True, 10.0, 90.0, 3), ("t", 2, True, 11.0, 90.5, 4), ("t", 3, False, 30.0, 90.0, 2), ("t", 5, False, 30.0, 90.0, 1), ("u", 2, False, 1.0, 2.0, 5)]
    found = pages.stitched_regions(spark.createDataFrame(rows, "id string, page int, open boolean, x0 double, x1 double, rows int"), "id").orderBy("id", "page").collect()
    assert [(r.id, r.page, r.first_page, r.row_start) for r in found] == [("t", 1, 1, 0), ("t", 2, 1, 3), ("t", 3, 3, 0), ("t", 5, 5, 0), ("u", 2, 2, 0)]
