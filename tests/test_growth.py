"""What keeps queries within their limits as tables grow."""

import os
import random
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from arbora.functions import site, styled
from arbora.operators import compare, islands
from arbora.plans import catalogue, compare_queries, island_queries

DATA = os.environ.get("ARBORA_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def plan(found) -> str:
    return found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["through_columns", "ruled_cells"])
def test_grids_are_never_broadcast(spark, name):
    assert "Broadcast" not in plan(catalogue.queries()[name](spark, DATA))


def split(rows: pd.DataFrame, rng: random.Random):
    while len(rows):
        n = rng.randint(0, 4)
        yield rows.iloc[:n].reset_index(drop=True)
        rows = rows.iloc[n:]


def test_frames_of_one_key_are_put_together_once(monkeypatch):
    moved, real = [], pd.concat
    monkeypatch.setattr(islands.pd, "concat", lambda parts, **k: moved.append(sum(map(len, parts))) or real(parts, **k))
    frames = (pd.DataFrame({"k": [1] * 10, "v": range(10)}) for _ in range(50))
    found = list(islands.grouped(frames, ["k", "v"], ["k"], lambda key, c: [(*key, len(c["v"]))], ["k", "n"]))
    assert [f.values.tolist() for f in found] == [[[1, 500]]] and sum(moved) == 500


def test_groups_of_frames_cut_anywhere():
    rng = random.Random(3)
    for _ in range(200):
        keys = sorted(rng.choice(["a", "b", "c"]) for _ in range(rng.randint(0, 12))) + [None] * rng.randint(0, 3)
        rows = pd.DataFrame({"k": pd.Series(keys, dtype=object), "v": range(len(keys))})
        found = [r for f in islands.grouped(split(rows, rng), ["k", "v"], ["k"], lambda key, c: [(*key, c["v"])], ["k", "v"]) for r in f.values.tolist()]
        assert found == [[k, [n for n, x in enumerate(keys) if x == k]] for k in dict.fromkeys(keys)]


def test_large_scopes_of_one_side_are_never_gathered(spark, monkeypatch):
    monkeypatch.setattr(compare, "MANY_TABLES", 2)
    schema = "scope string, ord int, key string, title string"
    left = spark.createDataFrame([("a", n, f"a{n}", f"t{n}") for n in range(5)] + [("x", n, f"x{n}", "x") for n in range(5)], schema)
    right = spark.createDataFrame([("a", n, f"a{n}", f"t{n}") for n in range(1, 4)] + [(None, n, f"n{n}", "x") for n in range(5)] + [("y", 1, "y1", "x")], schema)
    assert {r.scope for r in compare._paired_scopes(compare._sided(left, right)).collect()} == {"a", "y"}
    assert sorted(compare.titled_pairs(left, right).collect()) == [(f"a{n}", f"a{n}") for n in range(1, 4)]


def test_values_that_stand_once_match_without_a_search(monkeypatch):
    rng = random.Random(5)
    cases = [([*map(str, rng.sample(range(9), rng.randint(0, 9)))], rng) for _ in range(300)]
    cases = [(left, [x for x in left if rng.random() < 0.7] + [*"xy"][: rng.randint(0, 2)]) for left, _ in cases]
    expected = []
    for left, right in cases:
        codes = islands.SequenceMatcher(None, left, right, autojunk=False).get_opcodes()
        expected.append([p for kind, a, b, c, d in codes if kind in ("equal", "replace") for p in zip(range(a, b), range(c, d))])
    monkeypatch.setattr(islands, "SequenceMatcher", None)
    assert [islands.in_order(*case) for case in cases] == expected


def test_counted_characters_alone():
    rng = random.Random(7)
    parts = ["--", "-", ".", ",", '"', "”", "“", " ", "•", "A-", "1.2", "3.4.5", "(2)", "(a)", "a", "–", "²", "٣", "\n", '."', ",”", "\x1c"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert styled.counted(text) == styled.signature(text)[0]


def test_few_rows_pair_as_many_do(monkeypatch):
    rng = random.Random(11)
    sets = lambda: [frozenset(rng.sample("abcdefgh", rng.randint(0, 5))) for _ in range(rng.randint(0, 6))]
    cases = [(sets(), sets()) for _ in range(500)]
    few = [islands.similar_in_order(*case) for case in cases]
    monkeypatch.setattr(islands, "FEW_PAIRS", -1)
    assert few == [islands.similar_in_order(*case) for case in cases]


def test_few_boxes_merge_as_many_do():
    rng = random.Random(13)
    for _ in range(300):
        boxes = sorted({(float(x := rng.randint(0, 200)), float(y := rng.randint(0, 90)), x + rng.random() * 25, y + rng.random() * 18) for _ in range(rng.randint(1, 14))})
        assert sorted(islands._merged_few(boxes)) == sorted(map(tuple, islands.merged_boxes(np.array(boxes)).tolist()))


def test_one_pair_of_images_is_held_at_a_time():
    rows = pd.Series([np.arange(64.0) + n for n in range(400)])
    tracemalloc.start()
    try:
        found = island_queries._pair_scores(rows, rows[::-1].reset_index(drop=True), pd.Series(range(400)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found) == 400 and peak < 3_000_000  # all pairs are 15 MB


def test_few_texts_are_strings_at_once():
    texts = pa.array([None, ""] + ["a b. " * 2000] * 998)
    tracemalloc.start()
    try:
        found = islands._counted_texts(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found.to_pylist() == [None if v is None else styled.signature(v)[0] for v in texts.to_pylist()]
    assert peak < 4_000_000 and len(islands._counted_texts(texts.slice(0, 0))) == 0  # all texts are 10 MB


def test_spans_lie_as_placed_one_by_one(monkeypatch):
    rng = random.Random(17)
    grids = [[[(rng.choice([1, 1, 1, None, 2, 3]), rng.choice([1, 1, None, 2])) for _ in range(rng.randint(0, 4))] for _ in range(rng.randint(0, 5))] for _ in range(500)]
    found = [islands.laid_out(grid) for grid in grids]
    monkeypatch.setattr(islands, "PLAIN_SPANS", ())
    assert found == [islands.laid_out(grid) for grid in grids]


def test_scalars_are_never_walked():
    class Noted(dict):
        def get(self, *_):
            raise AssertionError("looked up although the walk ends nowhere")

    inner = Noted(a=1, b=[2, {"c": "x"}, "y"])
    assert list(site.objects([1, inner, "z"])) == [inner, {"c": "x"}]


def test_site_content_is_made_after_its_lines_are_gathered(spark):
    made, gathered = plan(compare_queries._json(spark, DATA)).split("ObjectHashAggregate", 1)
    assert "rowspan" in made and "rowspan" not in gathered


def test_many_kinds_of_nodes_from_one_parse(spark):
    rows = spark.createDataFrame([(1, '{"a": 1}'), (2, "no json"), (3, None), (4, "[]")], "k long, json string")
    named = lambda name: lambda value: iter([(name, str(n), None, "", "", "") for n in range(len(value))])
    found = islands.extracted(rows, "k", "json", named("x"), named("y")).select("k", "at", "type", "citation", "parent").collect()
    assert sorted(map(tuple, found)) == [(1, 0, "x", "0", None), (1, 0, "y", "0", None)]


def test_contents_are_left_behind_once_compared(spark, monkeypatch):
    written, real = [], compare.staged
    monkeypatch.setattr(compare, "staged", lambda df: written.append(df.columns) or real(df))
    found = compare_queries.compared_tree(spark, DATA)
    assert found.count() and written and not {"content", "__other", "type"} & {c for columns in written for c in columns}


def test_failures_are_worked_out_once(spark, monkeypatch):
    written, real = [], compare_queries.staged
    monkeypatch.setattr(compare_queries, "staged", lambda df: written.append(df) or real(df))
    assert compare_queries.told_reasons(spark, DATA).count() and len(written) == 1
    assert written[0].filter("ok").isEmpty()


def test_cells_are_placed_once(spark):
    assert "MapInPandas" not in plan(compare_queries.placed_in_grid(spark, DATA))
