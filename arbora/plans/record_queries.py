"""Report, viewer, backlog and layout records on the driver's tables, each made by a function that any table can use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.functions import boxes, records, text
from arbora.operators.windows import merged_boundaries
from arbora.sources.tables import table

c = F.col


def _text(*parts) -> F.Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def spend_texts(spark: SparkSession, d: str) -> DataFrame:
    """Cost, count and rate of orders as a report shows them; unknown ones too."""
    known = c("o_orderstatus") != "P"
    return table(spark, d, "orders").select("o_orderkey", records.money(F.when(known, c("o_totalprice") / 1000)).alias("cost"), records.whole_number(F.when(known, c("o_orderkey") * 1001)).alias("tokens"), records.rate(F.when(known, c("o_custkey") / 7)).alias("rate"))


def model_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(c("p_size") % 3 == 0, "").when(c("p_size") % 3 == 1, _text("maker/", c("p_brand"))).otherwise(c("p_brand"))
    return table(spark, d, "part").select("p_partkey", records.model_name(name, "house").alias("model"))


def routes(spark: SparkSession, d: str) -> DataFrame:
    """Routes of saved pages and images named after parts."""
    part = table(spark, d, "part")
    return part.select("p_partkey", records.page_route(_text("web_pages/", c("p_name"), " (1).html")).alias("page"), records.image_route(_text(c("p_brand"), "/", c("p_name"), ".png")).alias("image"), records.page_link(c("p_size")).alias("link"))


def safe_files(spark: SparkSession, d: str) -> DataFrame:
    """File names of pages, null where a name could leave its folder; assets mirrored below the site's root."""
    path = F.regexp_extract("url", r"^\w+://[^/]+([^?#]*)", 1)
    name = F.when(c("page_id") % 3 == 0, F.replace(path, F.lit("/"), F.lit("."))).when(c("page_id") % 3 == 1, path).otherwise(_text("p.", c("page_id")))
    asset = F.when(c("page_id") % 5 == 0, F.concat(F.lit("/a/../b"), path)).when(c("page_id") % 5 == 1, F.concat(F.lit("x"), path)).otherwise(F.concat(F.lit("/./s/"), path))
    return table(spark, d, "pages").select("page_id", records.safe_file(name, ".html").alias("file"), records.asset_file(asset).alias("asset"))


def call_manifests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", records.manifest(c("o_orderkey") % 4).alias("manifest"))


def own_texts(spark: SparkSession, d: str) -> DataFrame:
    """Contents without the marker or heading that is their node's own."""
    kind = F.element_at(F.array(*map(F.lit, ("Clause", "Note", "appendix_article", "Article"))), (c("p_size") % 4 + 1).cast("int"))
    ident = F.when(kind == "Clause", _text("(", c("p_size"), ")")).otherwise(_text("A-", c("p_size")))
    content = F.when((kind == "Clause") & (c("p_partkey") % 3 == 0), _text(c("p_size"), ") ", c("p_name"))).when(kind == "Clause", _text("(", c("p_size") + 1, ") ", c("p_name"))).when(kind == "Note", _text(ident, " ", c("p_brand"), " ", c("p_name"))).otherwise(_text(ident, ". ", c("p_brand"), c("p_name")))
    return table(spark, d, "part").select("p_partkey", records.own_text(kind, ident, c("p_brand"), content).alias("own"))


def formula_markups(spark: SparkSession, d: str) -> DataFrame:
    latex = _text("a < b & ", F.lit("\\\\times "), c("p_size"))
    return table(spark, d, "part").select("p_partkey", records.formula_markup(F.when(c("p_size") % 2 == 0, _text("<math>", c("p_size"), "</math>")), latex).alias("markup"), records.formula_letters(_text("X_", c("p_size"), " = Y")).alias("letters"))


def rebased_styles(spark: SparkSession, d: str) -> DataFrame:
    """Stylesheets whose references move under a mirror."""
    own = _text("i", c("p_size"), ".png")
    css = F.concat(F.lit("a{b:url(/r/"), own, F.lit(")} c{b:url('"), own, F.lit("')} d{b:url(\"../"), own, F.lit("\")} e{b:url(data:x)} f{b:url(../../"), own, F.lit(")}"))
    return table(spark, d, "part").select("p_partkey", records.rebased_css(css, F.lit("/css/main"), "assets").alias("css"))


def image_classes(spark: SparkSession, d: str) -> DataFrame:
    """What lines of orders would be shown as, were they images."""
    key = F.when(c("l_linenumber") == 1, _text("B.", c("l_orderkey"), ".Eq", c("l_linenumber"))).when(c("l_linenumber") == 2, _text("B.", c("l_orderkey"))).otherwise("")
    kind = F.when(c("l_quantity") > 45, "photo")
    caption = F.when(c("l_returnflag") == "R", "Figure").when(c("l_returnflag") == "A", "Table")
    shown = records.image_class(kind, key, caption, c("l_quantity") < 5, F.when(c("l_linestatus") == "F", "vector"))
    return table(spark, d, "lineitem").groupBy(shown.alias("class")).agg(F.count("*").alias("n"))


def reason_views(spark: SparkSession, d: str) -> DataFrame:
    """Badge, headline and note of statuses and reasons made from parts."""
    kinds = F.array(*map(F.lit, ("text", "emphasis", "no_web", "left_empty", "image_inside", "other")))
    kind = F.when(c("p_size") % 7 < 6, F.element_at(kinds, (c("p_size") % 7 + 1).cast("int")))
    ok = F.when(c("p_size") % 5 == 0, True).when(c("p_size") % 5 == 1, F.lit(None).cast("boolean")).otherwise(False)
    category = F.when(c("p_partkey") % 2 == 0, "Mixed").otherwise("Letter case")
    shown = F.least(c("p_size"), F.lit(3))
    return table(spark, d, "part").select("p_partkey", records.status_badge(ok).alias("badge"), records.reason_title(kind, category, c("p_partkey") % 3 == 0).alias("title"), records.hidden_note(c("p_size"), shown).alias("note"))


def inline_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of lines with bold and code."""
    line = F.when(c("p_size") % 3 == 0, _text("**", c("p_name"), "** is `", c("p_brand"), "`")).when(c("p_size") % 3 == 1, _text("see `", c("p_size"), "`, **x** or not")).otherwise(c("p_name"))
    shown = F.transform(records.inline_tokens(line), lambda x: F.concat_ws(":", F.coalesce(x["mark"], F.lit("plain")), x["text"]))
    return table(spark, d, "part").select("p_partkey", F.array_join(shown, "|").alias("pieces"))


def issue_previews(spark: SparkSession, d: str) -> DataFrame:
    """The JSON of issues made from parts, as a dry run shows it."""
    labels = F.array(text.slug(c("p_type")))
    parent = F.when(c("p_size") % 2 == 0, c("p_brand"))
    fields = records.issue_fields("KEY", "Story", F.concat(c("p_brand"), F.lit(" "), c("p_type")), labels, parent, F.when(c("p_size") > 25, "P1").otherwise("P9"), (("P1", "High"),), ("import",))
    return table(spark, d, "part").select("p_partkey", F.to_json(F.struct(fields.alias("fields"))).alias("issue"))


def usable_entries(spark: SparkSession, d: str) -> DataFrame:
    """Which cached entries may be used; broken ones are misses."""
    m = c("p_size") % 6
    verdict = F.when(m == 0, '"SAME"').otherwise('"IDENTICAL"')
    tokens = F.when(m == 1, "1.5").when(m == 2, '"x"').otherwise(c("p_size").cast("string"))
    cost = F.when(m == 3, '"free"').when(m == 4, "null").otherwise("0.25")
    entry = F.when(c("p_partkey") % 10 == 0, "{broken").otherwise(_text('{"verdict": ', verdict, ', "input_tokens": ', tokens, ', "output_tokens": 3, "cost": ', cost, ', "differences": ["a"]}'))
    return table(spark, d, "part").groupBy(m.alias("m"), (c("p_partkey") % 10 == 0).alias("broken")).agg(F.count_if(records.usable_entry(entry)).alias("usable"), F.count("*").alias("n"))


def retry_delays(spark: SparkSession, d: str) -> DataFrame:
    """Waits of events retried as often as their user's number says, with a hint for some."""
    attempt, hint = (c("user_id") % 8).cast("double"), F.when(c("event_id") % 5 == 0, c("value"))
    return table(spark, d, "events").select("event_id", F.round(records.retry_delay(attempt, hint, 0.5, 20.0, (c("event_id") % 4) / 4), 6).alias("delay"))


def neutral_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Grey shapes among lines whose rates are read as colours."""
    grey = boxes.neutral(c("l_discount"), c("l_tax"), c("l_quantity") / 500)
    return table(spark, d, "lineitem").groupBy(grey.alias("grey")).agg(F.count("*").alias("n"))


def composed_places(spark: SparkSession, d: str) -> DataFrame:
    """Where two maps in turn place the unit square, and whether it is flipped."""
    s = c("p_size").cast("double")
    first = F.array(s, F.lit(0.0), F.lit(1.0), F.when(c("p_partkey") % 2 == 0, s).otherwise(-s), F.lit(3.0), F.lit(5.0))
    second = F.array(F.when(c("p_partkey") % 3 == 0, -2.0).otherwise(2.0), F.lit(0.0), F.lit(0.0), F.lit(2.0), s, F.lit(1.0))
    box = boxes.placed_unit_square(boxes.composed(first, second))
    return table(spark, d, "part").select("p_partkey", box.alias("b")).select("p_partkey", "b.*")


def number_tree_hits(spark: SparkSession, d: str) -> DataFrame:
    """Entries of number trees found by key, where the key is within their limits."""
    nums = _text(c("p_size"), " ", c("p_partkey"), " 0 R ", c("p_size") + 3, " 7 0 R")
    key = c("p_size") + F.when(c("p_partkey") % 2 == 0, 3).otherwise(0)
    inside = boxes.within_limits(key, F.when(c("p_partkey") % 5 != 0, F.array(c("p_size"), c("p_size") + 2)))
    return table(spark, d, "part").select("p_partkey", boxes.number_tree_value(nums, key.cast("long")).alias("ref"), inside.alias("inside"), F.size(boxes.numbers(nums)).cast("long").alias("n"))


def grid_cells(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order in the columns of a grid whose edges are the merged quantities of all its lines."""
    rows = table(spark, d, "lineitem")
    edges = rows.groupBy("l_orderkey").agg(merged_boundaries(F.collect_list("l_quantity")).alias("edges"))
    return rows.join(edges, "l_orderkey").select("l_orderkey", "l_partkey", F.size("edges").cast("long").alias("n_edges"), boxes.band_index(c("l_quantity") + 3, c("edges")).cast("long").alias("band"))


def contained_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order inside the box of some returned line of it, with slack."""
    q = c("l_quantity")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", q.alias("x0"), c("l_tax").alias("y0"), (q + 2).alias("x1"), (c("l_tax") + 0.01).alias("y1"))
    outer = rows.filter("l_returnflag = 'R'").select(c("l_orderkey").alias("page"), (c("x0") - 5).alias("a0"), (c("y0") - 1).alias("b0"), (c("x1") + 5).alias("a1"), (c("y1") + 1).alias("b1"))
    inside = (c("page") == c("l_orderkey")) & boxes.contains([c("a0"), c("b0"), c("a1"), c("b1")], [c("x0"), c("y0"), c("x1"), c("y1")])
    return rows.filter("l_returnflag <> 'R'").join(outer, inside, "left_semi").select("l_orderkey", "l_partkey")


def keyed_groups(spark: SparkSession, d: str) -> DataFrame:
    """Images by tag, shape and source in three groups, numbered within order and group; the unkeyed get no number."""
    w, h = c("l_quantity") * 5, c("l_linenumber") * 12.0
    alt = F.when(c("l_tax") == 0.05, " EQUATION ").when(c("l_tax") == 0.06, "drawing")
    group = boxes.image_group(alt, w, h, ~boxes.is_decorative(w, h), c("l_linestatus") == "F")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", group.alias("kind"))
    nth = F.row_number().over(Window.partitionBy("l_orderkey", "kind").orderBy("l_linenumber", "l_partkey"))
    return rows.select("l_orderkey", "l_partkey", "kind", F.when(c("kind") != "unkeyed", nth).alias("nth"))


def shown_extents(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines clipped to its box, what is left of them, with a visible size."""
    box = [c("l_quantity"), c("l_linenumber").cast("double"), c("l_quantity") + 4, c("l_linenumber") + 0.5]
    bounds = [F.lit(10.0), F.lit(1.0), F.lit(30.0), F.lit(4.0)]
    left = table(spark, d, "lineitem").groupBy("l_orderkey").agg(*boxes.content_extent(box, bounds))
    return left.filter("x0 IS NOT NULL").select("l_orderkey", boxes.shown_box([c("x0"), c("y0"), c("x1"), c("y1")]).alias("b")).select("l_orderkey", "b.*")


def _headings(spark: SparkSession, d: str) -> DataFrame:
    s = c("p_size")
    made = F.array(_text("Division ", F.lit("B")), _text("Part ", s), _text("Notes to Part ", s), _text("Section ", s, ".1. ", c("p_brand")), _text(s, ".1.2.3.", c("p_brand")), _text(s, ".1.2. ", c("p_brand")), _text("Appendix ", F.lit("C")), _text("Section C-", s, " ", c("p_brand")), _text("C-", s, ".1.2. ", c("p_brand")), _text("C-", s, ".1. ", c("p_brand")), F.lit("Span Tables"), c("p_name"))
    font = F.when(c("p_partkey") % 7 == 0, "Body-Bold").otherwise("Face-Black")
    return table(spark, d, "part").select("p_partkey", F.element_at(made, (c("p_partkey") % 12 + 1).cast("int")).alias("line"), font.alias("font"))


def fonted_headings(spark: SparkSession, d: str) -> DataFrame:
    """Heading types of lines in their fonts, and the words of each that are no title."""
    typed = _headings(spark, d).withColumn("type", text.heading_type(c("line"), c("font")))
    return typed.select("p_partkey", "type", F.when(c("type").isNotNull(), text.heading_words(c("line"), c("type"))).alias("words"))


def fonted_captions(spark: SparkSession, d: str) -> DataFrame:
    """Captions by font and place: bold ones, and bare ones on centred lines."""
    s = c("p_size")
    line = F.concat(F.when(s % 2 == 0, "Table ").otherwise("Figure "), s.cast("string"), F.lit(".1."), F.when(c("p_partkey") % 3 == 0, "-A").otherwise(" more"))
    font = F.element_at(F.array(*map(F.lit, ("Face-Bold", "Face-Black-Bold", "FaceNarrow-Bold", "FaceMT", "FaceNarrow"))), (c("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", text.caption_kind(line, font, s % 4 < 2).alias("kind"), text.font_family(font).alias("family"), text.is_table_notes_heading(_text("Notes to ", line)).alias("notes"))


def glued_markers(spark: SparkSession, d: str) -> DataFrame:
    """Markers of lines, those without a space where the line's first span ends at the bracket."""
    token = F.element_at(F.array(*map(F.lit, ("1", "a", "iv", "zz"))), (c("p_size") % 4 + 1).cast("int"))
    line = F.concat(token, F.when(c("p_partkey") % 3 == 0, ") ").otherwise(")"), c("p_name"))
    end = F.when(c("p_partkey") % 2 == 0, F.length(token) + 1).otherwise(F.length(line))
    return table(spark, d, "part").select("p_partkey", text.marker_token(line, end).alias("token"))


def typed_citations(spark: SparkSession, d: str) -> DataFrame:
    kinds = ("Division", "Part", "NotesContainer", "Section", "Article", "Appendix", "AppendixArticle", "TableGroup", "BackMatter")
    kind = F.element_at(F.array(*map(F.lit, kinds)), (c("p_partkey") % 9 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", records.citation(kind, c("p_size").cast("string"), F.lit("B")).alias("citation"))


QUERIES = {f.__name__: f for f in (spend_texts, model_names, routes, safe_files, call_manifests, own_texts, formula_markups, rebased_styles, image_classes, reason_views, inline_pieces, issue_previews, usable_entries, retry_delays, neutral_shapes, composed_places, number_tree_hits, grid_cells, contained_boxes, keyed_groups, shown_extents, fonted_headings, fonted_captions, glued_markers, typed_citations)}

ORACLES = {
    "spend_texts": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'cost unavailable' ELSE printf('$%.5f', o_totalprice / 1000) END AS cost, CASE WHEN o_orderstatus = 'P' THEN '—' ELSE format('{:,}', o_orderkey * 1001) END AS tokens, CASE WHEN o_orderstatus = 'P' THEN '—' WHEN o_custkey / 7 >= 10 THEN printf('%.0f', o_custkey / 7) ELSE printf('%.1f', o_custkey / 7) END AS rate FROM orders",
    "model_names": "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'maker/' || p_brand ELSE 'house/' || p_brand END AS model FROM part",
    "routes": "SELECT p_partkey, '/web-page/' || replace(replace(p_name, ' ', '%20'), '#', '%23') || '%20(1)' AS page, '/api/llm-image/' || replace(p_brand, '#', '%23') || '/' || replace(replace(p_name, ' ', '%20'), '#', '%23') || '.png' AS image, '/pdf#page=' || p_size AS link FROM part",
    "safe_files": """
WITH p AS (SELECT page_id, regexp_extract(url, '^\\w+://[^/]+([^?#]*)', 1) AS path FROM pages),
n AS (SELECT page_id, path, CASE page_id % 3 WHEN 0 THEN replace(path, '/', '.') WHEN 1 THEN path ELSE 'p.' || page_id END AS name, list_filter(string_split(path, '/'), lambda x: x <> '' AND x <> '.') AS parts FROM p)
SELECT page_id, CASE WHEN regexp_full_match(name, '[\\w.\\-]+') AND NOT contains(name, '..') THEN name || '.html' END AS file, CASE WHEN page_id % 5 > 1 THEN array_to_string(list_concat(['s'], parts), '/') END AS asset FROM n""",
    "call_manifests": "SELECT o_orderkey, array_to_string(list_concat(['This call holds ' || o_orderkey % 4 || ' numbered pair(s). Images are given in the order listed.'], list_transform(generate_series(1, o_orderkey % 4), lambda n: 'PAIR ' || n || ': image ' || (2 * n - 1) || ' is A (PDF), image ' || (2 * n) || ' is B (web)')), chr(10)) AS manifest FROM orders",
    "own_texts": "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE '(' || (p_size + 1) || ') ' || p_name END WHEN 1 THEN ' ' || p_name WHEN 2 THEN p_name ELSE 'A-' || p_size || '. ' || p_brand || p_name END AS own FROM part",
    "formula_markups": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '<math>' || p_size || '</math>' ELSE '\\[a &lt; b &amp; \\times ' || p_size || '\\]' END AS markup, 'x' || p_size || 'y' AS letters FROM part",
    "rebased_styles": """SELECT p_partkey, 'a{b:url("assets/r/' || i || '")} c{b:url("assets/css/main/' || i || '")} d{b:url("assets/css/' || i || '")} e{b:url(data:x)} f{b:url("assets/' || i || '")}' AS css FROM (SELECT p_partkey, 'i' || p_size || '.png' AS i FROM part)""",
    "image_classes": "SELECT CASE WHEN l_quantity > 45 THEN 'photo' WHEN l_linenumber = 1 THEN 'equation' WHEN l_returnflag = 'R' THEN 'figure' WHEN l_quantity < 5 THEN 'image' WHEN l_linestatus <> 'F' THEN 'equation' WHEN l_linenumber = 2 THEN 'figure' ELSE 'image' END AS class, count(*) AS n FROM lineitem GROUP BY 1",
    "reason_views": """
SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '✓' WHEN 1 THEN '' ELSE '✗' END AS badge,
  CASE p_size % 7 WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'Text differs in several ways' ELSE 'Text differs: letter case' END WHEN 1 THEN 'Same words, different bold/italic' WHEN 2 THEN 'No matching item on the website' WHEN 3 THEN 'The PDF has no text here; the website does' WHEN 4 THEN 'The text matches; an image it holds differs' WHEN 5 THEN 'Differs from the website' ELSE CASE WHEN p_partkey % 3 = 0 THEN 'Something inside differs' ELSE 'Differs from the website' END END AS title,
  CASE WHEN p_size <= 3 THEN '' WHEN p_size = 4 THEN '1 more difference not shown.' ELSE (p_size - 3) || ' more differences not shown.' END AS note FROM part""",
    "inline_pieces": "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'strong:' || p_name || '|plain: is |code:' || p_brand WHEN 1 THEN 'plain:see |code:' || p_size || '|plain:, |strong:x|plain: or not' ELSE 'plain:' || p_name END AS pieces FROM part",
    "issue_previews": """SELECT p_partkey, '{"fields":{"project":{"key":"KEY"},"issuetype":{"name":"Story"},"summary":"' || p_brand || ' ' || p_type || '","labels":["import","' || trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') || '"]' || CASE WHEN p_size % 2 = 0 THEN ',"parent":{"key":"' || p_brand || '"}' ELSE '' END || CASE WHEN p_size > 25 THEN ',"priority":{"name":"High"}' ELSE '' END || '}}' AS issue FROM part""",
    "usable_entries": "SELECT p_size % 6 AS m, p_partkey % 10 = 0 AS broken, count(*) FILTER (WHERE p_partkey % 10 <> 0 AND p_size % 6 IN (4, 5)) AS usable, count(*) AS n FROM part GROUP BY 1, 2",
    "retry_delays": "SELECT event_id, round(CASE WHEN event_id % 5 = 0 THEN least(value, 20.0) ELSE least(20.0, 0.5 * 2.0 ** (user_id % 8)) * (0.5 + 0.5 * (event_id % 4) / 4) END, 6) AS delay FROM events",
    "neutral_shapes": "SELECT greatest(l_discount, l_tax, l_quantity / 500) - least(l_discount, l_tax, l_quantity / 500) <= 0.05 AS grey, count(*) AS n FROM lineitem GROUP BY 1",
    "composed_places": """
WITH m AS (SELECT p_partkey, p_size::DOUBLE AS s, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE -p_size END::DOUBLE AS v, CASE WHEN p_partkey % 3 = 0 THEN -2.0 ELSE 2.0 END::DOUBLE AS u FROM part),
p AS (SELECT p_partkey, s * u AS a, 1 * u AS c, 2 * v AS d, 3 * u + s AS e, 11.0::DOUBLE AS f FROM m)
SELECT p_partkey, least(e, e + a, e + c, e + a + c) AS x0, least(f, f + d) AS y0, greatest(e, e + a, e + c, e + a + c) AS x1, greatest(f, f + d) AS y1, a < 0 AS flip_x, d < 0 AS flip_y FROM p""",
    "number_tree_hits": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 7 ELSE p_partkey END::BIGINT AS ref, p_partkey % 5 = 0 OR p_partkey % 2 <> 0 AS inside, 6::BIGINT AS n FROM part",
    "grid_cells": """
WITH RECURSIVE v AS (SELECT DISTINCT l_orderkey, l_quantity AS x FROM lineitem), e AS (SELECT l_orderkey, min(x) AS x FROM v GROUP BY 1 UNION ALL SELECT e.l_orderkey, (SELECT min(v.x) FROM v WHERE v.l_orderkey = e.l_orderkey AND v.x > e.x + 2) FROM e WHERE e.x IS NOT NULL),
g AS (SELECT l_orderkey, list_sort(list(x)) AS edges FROM e WHERE x IS NOT NULL GROUP BY 1)
SELECT l.l_orderkey, l_partkey, len(edges)::BIGINT AS n_edges, CASE WHEN len(list_filter(edges, lambda x: x <= l_quantity + 3)) BETWEEN 1 AND len(edges) - 1 THEN len(list_filter(edges, lambda x: x <= l_quantity + 3)) - 1 END::BIGINT AS band FROM lineitem l JOIN g USING (l_orderkey)""",
    "contained_boxes": "SELECT l_orderkey, l_partkey FROM lineitem a WHERE l_returnflag <> 'R' AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_returnflag = 'R' AND b.l_orderkey = a.l_orderkey AND a.l_quantity >= b.l_quantity - 5.5 AND a.l_quantity + 2 <= b.l_quantity + 7.5)",
    "keyed_groups": """
WITH k AS (SELECT l_orderkey, l_partkey, l_linenumber, l_tax, l_linestatus, l_quantity * 5 AS w, l_linenumber * 12.0::DOUBLE AS h FROM lineitem),
g AS (SELECT *, CASE WHEN l_tax = 0.05 THEN 'equation' WHEN NOT (w > h AND h <= 70 AND w / h >= 2 AND NOT (greatest(w, h) / least(w, h) <= 2 AND w * h < 1600)) THEN 'figure' WHEN l_linestatus = 'F' THEN 'unkeyed' ELSE 'equation' END AS kind FROM k)
SELECT l_orderkey, l_partkey, kind, CASE WHEN kind <> 'unkeyed' THEN row_number() OVER (PARTITION BY l_orderkey, kind ORDER BY l_linenumber, l_partkey) END AS nth FROM g""",
    "shown_extents": """
WITH k AS (SELECT l_orderkey, greatest(l_quantity, 10) AS x0, greatest(l_linenumber, 1)::DOUBLE AS y0, least(l_quantity + 4, 30) AS x1, least(l_linenumber + 0.5::DOUBLE, 4) AS y1 FROM lineitem),
b AS (SELECT l_orderkey, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM k WHERE x1 > x0 AND y1 > y0 GROUP BY 1)
SELECT l_orderkey, x0 AS "left", y0 AS top, greatest(x1 - x0, 2) AS width, greatest(y1 - y0, 2) AS height FROM b""",
    "fonted_headings": """
WITH t AS (SELECT *, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE ['Division', 'Part', 'NotesContainer', 'Section', 'Article', 'Subsection', 'Appendix', 'AppendixPart', 'AppendixArticle', 'AppendixSection', 'TableGroup', NULL][p_partkey % 12 + 1] END AS type FROM part)
SELECT p_partkey, type, CASE type WHEN 'Division' THEN 'Division B' WHEN 'Part' THEN 'Part ' || p_size WHEN 'NotesContainer' THEN 'Notes to Part ' || p_size WHEN 'Section' THEN 'Section ' || p_size || '.1.' WHEN 'Article' THEN p_size || '.1.2.3.' WHEN 'Subsection' THEN p_size || '.1.2.' WHEN 'Appendix' THEN 'Appendix C' WHEN 'AppendixPart' THEN 'Section C-' || p_size WHEN 'AppendixArticle' THEN 'C-' || p_size || '.1.2.' WHEN 'AppendixSection' THEN 'C-' || p_size || '.1.' WHEN 'TableGroup' THEN 'Span Tables' END AS words FROM t""",
    "fonted_captions": "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 OR (p_size % 4 < 2 AND p_partkey % 5 IN (1, 3) AND p_partkey % 3 = 0) THEN CASE WHEN p_size % 2 = 0 THEN 'Table' ELSE 'Figure' END END AS kind, CASE p_partkey % 5 WHEN 2 THEN 'FaceNarrow' WHEN 4 THEN 'FaceNarrow' ELSE 'Face' END AS family, p_partkey % 3 = 0 AS notes FROM part",
    "glued_markers": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 OR (p_partkey % 2 = 0 AND p_size % 4 < 3) THEN ['1', 'a', 'iv', 'zz'][p_size % 4 + 1] END AS token FROM part",
    "typed_citations": "SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN 'B-' || p_size WHEN 2 THEN 'Notes-B-' || p_size WHEN 3 THEN 'B-' || p_size || '.' WHEN 4 THEN 'B-' || p_size || '.' WHEN 5 THEN 'Appendix-' || p_size WHEN 6 THEN 'Appendix-' || p_size || '.' WHEN 7 THEN 'B-' || p_size ELSE 'BackMatter' END AS citation FROM part",
}
