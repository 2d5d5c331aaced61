"""Comparison and site operators on small trees."""

import pytest
from pyspark.sql import functions as F

from arbora.functions import raster, site
from arbora.operators import compare, islands, joins, windows

TABLES, CELLS = "scope string, ord int, key string, title string", "table string, row_ord int, row_key string, cell_ord int, cell_key string, content string"


def cells_of(name, rows):
    return [(name, r, f"{name}.r{r}", k, f"{name}.r{r}.{k}", text) for r, row in enumerate(rows) for k, text in enumerate(row)]


def test_tables_pair_by_title_then_place(spark):
    left = spark.createDataFrame([("s", 1, "a", "Loads Forming Part of Sentence 1"), ("s", 2, "b", None), ("s", 3, "c", "Spans(1)"), ("t", 1, "d", "Moved")], TABLES)
    right = spark.createDataFrame([("s", 1, "A", "loads"), ("s", 2, "B", ""), ("s", 3, "C", "Spans^{(2)}"), ("u", 1, "D", "moved")], TABLES)
    assert {tuple(r) for r in compare.titled_pairs(left, right).collect()} == {("a", "A"), ("b", "B"), ("c", "C")}
    assert {tuple(r) for r in compare.table_pairs(left, right).collect()} == {("a", "A"), ("b", "B"), ("c", "C"), ("d", "D")}


def test_rows_and_cells_pair_by_content(spark):
    left_tables = spark.createDataFrame([("s", 1, "a", "One"), ("s", 2, "b", "Two")], TABLES)
    right_tables = spark.createDataFrame([("s", 1, "x", "One"), ("z", 1, "b", "Else")], TABLES)
    left = spark.createDataFrame(cells_of("a", [["h", "k"], ["p q r s", ""], ["last", "one"]]) + cells_of("b", [["lost", "too"]]), CELLS)
    right = spark.createDataFrame(cells_of("x", [["h", "k"], ["new", "row"], ["p q r t", ""], ["last", "one"]]) + cells_of("b", [["other", "words"]]), CELLS)
    found = {r.left_key: r.right_key for r in compare.counterparts(left_tables, right_tables, left, right).collect()}
    assert found["a"] == "x" and found["a.r0"] == "x.r0" and found["a.r2"] == "x.r3" and found["a.r2.1"] == "x.r3.1"
    assert found["a.r1"] == "x.r2" and found["a.r1.0"] == "x.r2.0"
    assert all(found[k] is None for k in ("b", "b.r0", "b.r0.0", "b.r0.1"))


def test_statuses_go_up_any_depth(spark):
    nodes = [("1", "1", "Part", ""), ("1/1", "1.1", "Row", ""), ("1/1/1", "1.1.a", "Cell", "x"), ("1/1/2", "1.1.b", "Cell", " "), ("1/2", "", "Section", ""), ("1/2/1", "2.1", "Sentence", "same"), ("2", "2", "Part", ""), ("2/1", "2.9", "Cell", "")]
    others = [("1", ""), ("1.1", ""), ("1.1.a", "x"), ("2.1", "same"), ("2", None), ("moved", "there")]
    schema = "path string, key string, type string, content string"
    equal = lambda a, b: a == b

    def told(images=(), settled=(), right=others):
        found = compare.compared(spark.createDataFrame(nodes, schema), spark.createDataFrame(right, "key string, content string"), spark.createDataFrame(list(settled), "left_key string, right_key string"), spark.createDataFrame(list(images), "owner_path string, ok boolean"), equal)
        return {r.path: (r.own_ok, r.ok) for r in found.collect()}

    assert all(v == (True, True) for v in told().values())
    assert {p for p, v in told(images=[("1/2/1", False), ("2", True)]).items() if not v[1]} == {"1/2/1", "1/2", "1"}
    assert {p for p, v in told(settled=[("2.1", "moved")]).items() if not v[0]} == {"1/2/1"}
    assert {p for p, v in told(settled=[("1.1", None)]).items() if not v[1]} == {"1/1", "1/1/2", "1"}
    assert told(right=[("1", "")])["2/1"] == (False, False)


def test_grids_of_other_heights_fail(spark):
    ours = spark.createDataFrame([("t", 0, 0, "c", "x"), ("t", 1, 0, "d", "y")], "table string, row_ord int, cell_ord int, cell string, content string")
    theirs = spark.createDataFrame([("t", 0, 0, "p", "x")], "table string, row_ord int, cell_ord int, place string, text string")
    with pytest.raises(Exception, match="1 rendered rows, 2 in the document"):
        compare.placed_cells(ours, theirs).collect()
    with pytest.raises(Exception, match="no spec 7"):
        joins.required(spark.createDataFrame([(7,)], "k int"), spark.createDataFrame([(8, "x")], "k int, v string"), "k", "spec").collect()
    with pytest.raises(Exception, match="k twice: 1"):
        compare.once(spark.createDataFrame([(1,), (1,)], "k int"), "k").collect()


def test_content_as_of_a_day():
    row = lambda *vs: {"id": "r", "revised": True, "cells": 0, "revisions": [{"type": "x", "effective_date": d, "sequence": s, **f} for d, s, f in vs]}
    assert site.as_of(row(("2024-01-01", 1, {"cells": 1}), ("2024-05-01", 1, {"cells": 2})), "2024-03-01") == {"id": "r", "cells": 1}
    assert site.as_of(row(("2024-01-01", 2, {"cells": 3}), ("2024-01-01", 1, {"cells": 1})), "2024-01-01") == {"id": "r", "cells": 3}
    assert site.as_of(row(("2025-01-01", 1, {"cells": 1})), "2024-03-01") is None
    assert site.as_of(row(("2024-01-01", 1, {"deleted": True, "cells": 1})), "2024-03-01") is None
    assert site.as_of(row(("2024-01-01", 1, {"cells": []})), "2024-03-01") is None
    nested = {"rows": [row(("2025-01-01", 1, {"cells": 1})), row(("2023-01-01", 1, {"cells": [row(("2023-02-01", 1, {"cells": 9}))]})), None]}
    assert site.as_of(nested, "2024-01-01") == {"rows": [{"id": "r", "cells": [{"id": "r", "cells": 9}]}, None]}


def test_appendix_lists():
    lists = [{"type": "alphabetic", "items": [{"content": "one [LIST:x]"}, {"content": "two"}]}, {"type": "bulleted", "items": [{"content": "deep"}]}, {"type": "variable", "items": [{"content": "v [LIST:y]"}]}, {"type": "bulleted", "items": [{"content": "hidden"}]}]
    article = {"id": "a.sect1.sub2.article3", "content": [{"type": "paragraph", "id": "p", "content": "1) first [LIST:a] where [LIST:b]", "lists": lists}, {"type": "paragraph", "id": "q", "content": "no number"}]}
    found = list(site.appendix_nodes({"sections": [{"id": "s1", "subsections": [{"id": "s1.sub2", "articles": [article]}]}]}, "D"))
    assert [(n[0], n[1], n[2], n[3]) for n in found] == [("appendix_section", "s1", "", "D-1"), ("appendix_subsection", "s1.sub2", "s1", "D-1.2"), ("appendix_article", "a.sect1.sub2.article3", "s1.sub2", "D-1.2.3"), ("Sentence", "p", "a.sect1.sub2.article3", "(1)"), ("Clause", "p.li1", "p", "(a)"), ("Subclause", "p.li1.li1", "p.li1", "(i)"), ("Clause", "p.li2", "p", "(b)")]


def test_spans_keep_their_place():
    table = {"type": "table", "id": "B.T1", "structure": {"header_rows": [{"cells": [{"content": "h", "colspan": 2}, {"content": [{"type": "text", "value": " k "}], "rowspan": 2}]}], "body_rows": [{"cells": [{"content": "a"}, {"content": "b"}]}]}}
    found = [(n[1], n[5]) for n in site.table_nodes({"x": [table, {"type": "table"}]}, islands.laid_out) if n[0] == "Cell"]
    assert found == [("B.T1-row1-col1", "h"), ("B.T1-row1-col2", ""), ("B.T1-row1-col3", "k"), ("B.T1-row2-col1", "a"), ("B.T1-row2-col2", "b"), ("B.T1-row2-col3", "")]


def test_limiter(spark):
    rows = spark.createDataFrame([("u", 0.0, 10, 10, 1.0), ("u", 1.0, 10, 10, 1.0), ("u", 2.0, 10, 10, 1.0), ("u", 3.0, 500, 1, 1.0), ("u", 200.0, 90, 10, 5.0), ("u", 206.0, 85, 1, 1.0), ("u", 207.0, 20, 20, 1.0)], "k string, at double, e int, a int, s double")
    found = windows.admitted(rows, ["k"], "at", "e", "a", "s", 2, 100).orderBy("at").collect()
    assert [r.starts for r in found] == [0.0, 1.0, 60.0, 120.0, 200.0, 206.0, 260.0]


def test_prepared_images(spark):
    import numpy as np

    clear = np.zeros((60, 40, 4), np.uint8)
    clear[10:50, 10:20] = (0, 0, 0, 255)
    assert raster.prepared(clear, 20).shape == (20, 5, 3) and raster.on_white(clear)[0, 0].tolist() == [255, 255, 255]
    assert raster.upright(clear, True, False)[30, 25].tolist() == [0, 0, 0, 255]
    assert raster.pair_score(clear, clear, True) == 100.0
    assert spark.range(1).select(F.lit(1)).count() == 1
