"""Scalar functions over text, shapes, scores and vectors on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions import numbers, text
from arbora.plans.window_queries import document_lines
from arbora.sources.tables import table


def heading_classify(spark: SparkSession, d: str) -> DataFrame:
    """Heading types of numbered lines made from documents: dotted numbers by line, a title behind them."""
    made = F.concat(F.concat_ws(".", F.lit("3"), (F.col("line_no") % 5 + 1).cast("string"), F.when(F.col("line_no") % 2 == 0, (F.col("doc_id") % 9 + 1).cast("string")), F.when(F.col("line_no") % 4 == 0, F.lit("2"))), F.lit(". Title"))
    lines = document_lines(spark, d).withColumn("line", F.when(F.col("line_no") % 7 == 3, F.concat(F.lit("Part "), (F.col("doc_id") % 12).cast("string"))).when(F.length("line") < 200, made).otherwise(F.col("line")))
    return lines.groupBy(F.coalesce(text.heading_type(F.col("line")), F.lit("body")).alias("type")).agg(F.count("*").alias("n"))


def marker_classify(spark: SparkSession, d: str) -> DataFrame:
    """Marker kinds of lines that begin with letters or digits made into markers."""
    token = F.regexp_extract("line", r"^([A-Za-z0-9]{1,4})", 1)
    found = document_lines(spark, d).select(token.alias("token")).filter("token <> ''")
    made = found.withColumn("line", F.concat("token", F.lit(") text")))
    return made.groupBy(text.marker_kind(text.marker_token(F.col("line"))).alias("kind")).agg(F.count("*").alias("n"), F.min("token").alias("least"))


def shape_classify(spark: SparkSession, d: str) -> DataFrame:
    """Decorative and equation-like shapes among lineitems as width and height."""
    w, h = F.col("l_quantity") * 3, F.floor(F.col("l_discount") * 1000).cast("double")
    rows = table(spark, d, "lineitem").select(w.alias("w"), h.alias("h"))
    return rows.groupBy(numbers.decorative(F.col("w"), F.col("h")).alias("decorative"), numbers.equation_shaped(F.col("w"), F.col("h")).alias("equation")).agg(F.count("*").alias("n"))


def plain_char_fold(spark: SparkSession, d: str) -> DataFrame:
    """Typographic variants put into documents, then folded to plain characters."""
    curly = F.translate("text", ",.-'", "–’”²")
    return table(spark, d, "documents").select("doc_id", F.md5(text.plain_characters(curly).cast("binary")).alias("folded"))


def title_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of part titles with what they form part of and footnote marks."""
    title = F.concat("p_name", F.lit(" ("), F.col("p_size").cast("string"), F.lit(") "), "p_type", F.lit(" Forming part of Sentence 3."))
    return table(spark, d, "part").select("p_partkey", text.title_key(title).alias("key"))


def edit_categories(spark: SparkSession, d: str) -> DataFrame:
    """Categories of edits between pairs of part words."""
    left = F.element_at(F.split("p_name", " "), 1)
    right = F.when(F.col("p_partkey") % 6 == 0, F.upper(left)).when(F.col("p_partkey") % 6 == 1, "").when(F.col("p_partkey") % 6 == 2, "Note").otherwise(F.element_at(F.split("p_name", " "), 2))
    shown = F.when(F.col("p_partkey") % 12 == 1, F.element_at(F.array(*map(F.lit, ("Sentences", ".,", "CSA", "ofDivisionB", "Note", "3.2.(1)"))), (F.col("p_size") % 6 + 1).cast("int"))).otherwise(left)
    return table(spark, d, "part").select("p_partkey", text.edit_category(shown, right).alias("category"))


def context_window(spark: SparkSession, d: str) -> DataFrame:
    """Thirty characters on either side of a stretch of each document."""
    at = F.least(F.lit(40), F.floor(F.length("text") / 2)).cast("int")
    sides = text.context(F.col("text"), at, at + 5)
    return table(spark, d, "documents").select("doc_id", sides["before"].alias("before"), sides["changed"].alias("changed"), sides["after"].alias("after"))


def duration_format(spark: SparkSession, d: str) -> DataFrame:
    """Order numbers as seconds, in words."""
    return table(spark, d, "orders").select("o_orderkey", text.duration(F.when(F.col("o_orderkey") % 97 != 0, F.col("o_orderkey").cast("double"))).alias("text"))


def roman_numerals(spark: SparkSession, d: str) -> DataFrame:
    """Part sizes in roman numerals and letters."""
    return table(spark, d, "part").select("p_partkey", text.roman(F.col("p_size")).alias("roman"), F.chr(F.lit(96) + F.col("p_size") % 26 + 1).alias("letter"))


def slug_label(spark: SparkSession, d: str) -> DataFrame:
    """Labels of parts."""
    return table(spark, d, "part").select("p_partkey", text.slug(F.concat_ws(" & ", "p_brand", "p_type", "p_name")).alias("label"))


def story_summary(spark: SparkSession, d: str) -> DataFrame:
    """Stories made from parts, shortened at their purpose, references dropped."""
    story = F.concat(F.lit("As a buyer I want "), "p_name", F.lit(" (REQ-"), F.col("p_size").cast("string"), F.lit("), so that "), "p_type", F.lit(" works"))
    return table(spark, d, "part").select("p_partkey", text.summary(story).alias("summary"))


def html_clean(spark: SparkSession, d: str) -> DataFrame:
    """Pages without scripts, styles, headers and ids, by digest and length."""
    cleaned = text.clean_html(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(cleaned).alias("length"), F.md5(cleaned.cast("binary")).alias("digest"))


def html_links_extract(spark: SparkSession, d: str) -> DataFrame:
    """Distinct link targets of each page, in order."""
    links = text.link_paths(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.size(links).cast("long").alias("n"), F.array_join(links, " ").alias("links"))


def jaccard_words(spark: SparkSession, d: str) -> DataFrame:
    """Word similarity of each document with the one before it by id; words meet as 64-bit hashes, so no text is shuffled."""
    words = F.array_distinct(F.transform(F.split(F.lower("text"), " "), lambda w: F.xxhash64(w)))
    rows = table(spark, d, "documents").select("doc_id", words.alias("words"))
    before = rows.select((F.col("doc_id") + 1).alias("doc_id"), F.col("words").alias("before"))
    return rows.join(before, "doc_id").select("doc_id", F.round(text.jaccard(F.col("words"), F.col("before")), 9).alias("similarity"))


def hamming_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Sign-bit similarity of each vector with the first of its label."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", numbers.sign_bits(F.col("embedding"), 32).alias("bits"))
    first = rows.groupBy("label").agg(F.min_by("bits", "vec_id").alias("first"))
    return rows.join(F.broadcast(first), "label").select("vec_id", numbers.hamming_similarity(F.col("bits"), F.col("first"), 32).alias("similarity"))


def centred_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of each vector with the first of its label."""
    rows = table(spark, d, "embeddings")
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return rows.join(F.broadcast(first), "label").select("vec_id", F.round(numbers.centred_cosine(F.col("embedding"), F.col("first")), 5).alias("correlation"))


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Estimated tokens of images as large as lineitems say."""
    w, h = (F.col("l_quantity") * 37).cast("int"), (F.col("l_partkey") % 1500 + 1).cast("int")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(numbers.image_tokens(w, h)).cast("long").alias("tokens"))


def score_routing(spark: SparkSession, d: str) -> DataFrame:
    """Scores routed by a threshold that depends on the key's class."""
    score, equation = F.col("l_discount") * 1000, F.col("l_linenumber") % 3 == 0
    passed = score >= F.when(equation, 70).otherwise(80)
    return table(spark, d, "lineitem").groupBy(F.when(passed, "hash match").otherwise("judge").alias("route")).agg(F.count("*").alias("n"))


def match_decision(spark: SparkSession, d: str) -> DataFrame:
    """The decision list of an image match: missing fails, hash passes, ink passes, an equation's text passes unless it shows an error."""
    c = F.col
    rows = table(spark, d, "lineitem")
    missing, hashed, ink = c("l_tax") == 0, c("l_discount") * 1000 >= 80, c("l_quantity") / 50 >= 0.83
    text_ok = (c("l_linenumber") == 3) & (c("l_returnflag") != "R")
    verdict = F.when(missing, "missing").when(hashed, "hash").when(ink, "ink").when(text_ok, "text").otherwise("differs")
    return rows.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def name_filter(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one verdict whose name has a text, case aside."""
    return table(spark, d, "part").filter((F.col("p_type") == "ECONOMY") & F.contains(F.lower("p_name"), F.lit("ring"))).select("p_partkey", "p_name")


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    """Content keys of parts over length-prefixed fields."""
    return table(spark, d, "part").select("p_partkey", text.content_key(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("key"))


def content_urls(spark: SparkSession, d: str) -> DataFrame:
    """Targets of pages whose own address ends in a number: host, language and number by pattern."""
    part = lambda g: F.regexp_extract("url", r"^https?://([^/]+)/([a-z]+)/(\d+)", g)
    return table(spark, d, "pages").filter(part(3) != "").select("page_id", F.format_string("/%s/%s/%06d.json", part(1), part(2), part(3).cast("int")).alias("target"))


def scrub_secret(spark: SparkSession, d: str) -> DataFrame:
    """A secret's text replaced wherever it stands."""
    return table(spark, d, "events").groupBy(F.replace("props", F.lit('"k": 1'), F.lit('"k": *')).alias("props")).agg(F.count("*").alias("n"))


def json_prune(spark: SparkSession, d: str) -> DataFrame:
    """Fields kept by node type, as JSON without the null ones."""
    c = F.col
    rows = table(spark, d, "part").select("p_partkey", F.when(c("p_size") > 25, c("p_name")).alias("title"), F.when(c("p_size") <= 25, c("p_brand")).alias("content"))
    return rows.select("p_partkey", F.to_json(F.struct("title", "content")).alias("json"))


def sorted_names(spark: SparkSession, d: str) -> DataFrame:
    """Nation names in order without regard to case, numbered."""
    from pyspark.sql import Window

    return table(spark, d, "nation").select("n_name", F.row_number().over(Window.partitionBy("n_regionkey").orderBy(F.lower("n_name"))).alias("n"))


QUERIES = {f.__name__: f for f in (heading_classify, marker_classify, shape_classify, plain_char_fold, title_keys, edit_categories, context_window, duration_format, roman_numerals, slug_label, story_summary, html_clean, html_links_extract, jaccard_words, hamming_similarity, centred_cosine, token_estimate, score_routing, match_decision, name_filter, content_hash, content_urls, scrub_secret, json_prune, sorted_names)}

_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"
_ROMAN = "repeat('l', {n} // 50) || ['', 'x', 'xx', 'xxx', 'xl'][{n} % 50 // 10 + 1] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][{n} % 10 + 1]"
_AT = "least(40, length(text) // 2)"
ORACLES = {
    "heading_classify": f"""
WITH {_LINES}, made AS (SELECT CASE WHEN line_no % 7 = 3 THEN 'Part ' || doc_id % 12 WHEN length(line) < 200 THEN '3.' || (line_no % 5 + 1) || CASE WHEN line_no % 2 = 0 THEN '.' || (doc_id % 9 + 1) ELSE '' END || CASE WHEN line_no % 4 = 0 THEN '.2' ELSE '' END || '. Title' ELSE line END AS line FROM lines)
SELECT CASE WHEN regexp_matches(line, '^Part\\s+\\d+\\s*$') THEN 'Part' WHEN regexp_matches(line, '^\\d+\\.\\d+\\.\\d+\\.\\d+\\.') THEN 'Article' WHEN regexp_matches(line, '^\\d+\\.\\d+\\.\\d+\\.\\s') THEN 'Subsection' ELSE 'body' END AS type, count(*) AS n FROM made GROUP BY 1""",
    "marker_classify": f"""
WITH {_LINES}, t AS (SELECT regexp_extract(line, '^([A-Za-z0-9]{{1,4}})', 1) AS token FROM lines), romans AS (SELECT {_ROMAN.format(n='i')} AS r FROM range(1, 61) g(i))
SELECT CASE WHEN regexp_full_match(token, '[0-9]+') THEN 'sentence' WHEN length(token) = 1 AND contains('ivxlcdm', lower(token)) THEN 'ambiguous' WHEN length(token) = 1 THEN 'clause' WHEN lower(token) IN (SELECT r FROM romans) THEN 'subclause' ELSE 'noise' END AS kind, count(*) AS n, min(token) AS least FROM t WHERE token <> '' GROUP BY 1""",
    "shape_classify": """
WITH s AS (SELECT l_quantity * 3 AS w, floor(l_discount * 1000) AS h FROM lineitem)
SELECT CASE WHEN w <= 0 OR h <= 0 THEN false ELSE greatest(w, h) / least(w, h) <= 2 AND w * h < 1600 END AS decorative, CASE WHEN w <= 0 OR h <= 0 THEN false ELSE w > h AND h <= 70 AND w / h >= 2 END AS equation, count(*) AS n FROM s GROUP BY 1, 2""",
    "plain_char_fold": "SELECT doc_id, md5(translate(translate(text, ',.-''', '–’”²'), '“”„‘’‚‐‑‒–—−¹²³', '\"\"\"''''''------123')) AS folded FROM documents",
    "title_keys": "SELECT p_partkey, lower(regexp_replace(p_name || p_type, '[^A-Za-z0-9]+', '', 'g')) AS key FROM part",
    "edit_categories": """
WITH w AS (SELECT p_partkey, CASE WHEN p_partkey % 12 = 1 THEN ['Sentences', '.,', 'CSA', 'ofDivisionB', 'Note', '3.2.(1)'][p_size % 6 + 1] ELSE string_split(p_name, ' ')[1] END AS l, CASE p_partkey % 6 WHEN 0 THEN upper(string_split(p_name, ' ')[1]) WHEN 1 THEN '' WHEN 2 THEN 'Note' ELSE string_split(p_name, ' ')[2] END AS r FROM part)
SELECT p_partkey, CASE WHEN l <> '' AND r <> '' THEN CASE WHEN lower(l) = lower(r) THEN 'Letter case' WHEN contains(r, 'Note') THEN 'Note link text' ELSE 'Wording' END
 WHEN l IN ('.,') THEN 'Punctuation' WHEN l IN ('Sentences', 'ofDivisionB', '3.2.(1)') THEN 'Reference wording' WHEN l = 'CSA' THEN 'Standard designation' WHEN l = 'Note' THEN 'Note link text' ELSE 'Wording' END AS category FROM w""",
    "context_window": f"SELECT doc_id, CASE WHEN {_AT} > 30 THEN '…' ELSE '' END || substr(text, greatest(0, {_AT} - 30) + 1, {_AT} - greatest(0, {_AT} - 30)) AS before, substr(text, {_AT} + 1, 5) AS changed, substr(text, {_AT} + 6, 30) || CASE WHEN {_AT} + 35 < length(text) THEN '…' ELSE '' END AS after FROM documents",
    "duration_format": """
SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'n/a' WHEN o_orderkey < 60 THEN o_orderkey || ' s' WHEN o_orderkey >= 3600 THEN o_orderkey // 3600 || 'h ' || lpad((o_orderkey % 3600 // 60)::VARCHAR, 2, '0') || 'm ' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') || 's' ELSE o_orderkey // 60 || 'm ' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') || 's' END AS text FROM orders""",
    "roman_numerals": f"SELECT p_partkey, {_ROMAN.format(n='p_size')} AS roman, chr(97 + p_size % 26) AS letter FROM part",
    "slug_label": "SELECT p_partkey, trim(regexp_replace(lower(p_brand || ' & ' || p_type || ' & ' || p_name), '[^a-z0-9]+', '-', 'g'), '-') AS label FROM part",
    "story_summary": "SELECT p_partkey, 'As a buyer I want ' || p_name AS summary FROM part",
    "html_clean": r"""
WITH c AS (SELECT page_id, regexp_replace(regexp_replace(html, '<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<header\b[^>]*>.*?</header>', '', 'gs'), '\s+id="[^"]*"', '', 'g') AS h FROM pages)
SELECT page_id, length(h)::INT AS length, md5(h) AS digest FROM c""",
    "html_links_extract": """
WITH l AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS xs FROM pages), u AS (SELECT page_id, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM l), f AS (SELECT page_id, x, min(i) AS i FROM u GROUP BY 1, 2)
SELECT l.page_id, count(f.x) AS n, coalesce(string_agg(f.x, ' ' ORDER BY f.i), '') AS links FROM l LEFT JOIN f ON l.page_id = f.page_id GROUP BY 1""",
    "jaccard_words": """
WITH w AS (SELECT doc_id, list_distinct(string_split(lower(text), ' ')) AS words FROM documents), p AS (SELECT a.doc_id, a.words, b.words AS before FROM w a JOIN w b ON a.doc_id = b.doc_id + 1)
SELECT doc_id, round(len(list_intersect(words, before)) / (len(words) + len(before) - len(list_intersect(words, before))), 9) AS similarity FROM p""",
    "hamming_similarity": """
WITH b AS (SELECT vec_id, label, list_reduce(list_prepend(0::BIGINT, list_transform(embedding[1:32], lambda x: (x > 0)::BIGINT)), lambda a, x: a * 2 + x) AS bits FROM embeddings), f AS (SELECT label, first(bits ORDER BY vec_id) AS first FROM b GROUP BY 1)
SELECT vec_id, round((1 - bit_count(xor(bits, first)) / 32) * 100, 1) AS similarity FROM b JOIN f USING (label)""",
    "centred_cosine": """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE - list_avg(list_transform(embedding, lambda y: y::DOUBLE))) AS e FROM embeddings), f AS (SELECT label, first(e ORDER BY vec_id) AS g FROM v GROUP BY 1)
SELECT vec_id, round(list_cosine_similarity(e, g), 5) AS correlation FROM v JOIN f USING (label)""",
    "token_estimate": """
WITH s AS (SELECT l_orderkey, (l_quantity * 37)::INT AS w, (l_partkey % 1500 + 1)::INT AS h FROM lineitem), u AS (SELECT *, least(768, greatest(256, floor(least(w, h) / 1.5))) AS unit FROM s)
SELECT l_orderkey, sum(CASE WHEN greatest(w, h) <= 384 THEN 258 ELSE 258 * ceil(w / unit) * ceil(h / unit) END)::BIGINT AS tokens FROM u GROUP BY 1""",
    "score_routing": "SELECT CASE WHEN l_discount * 1000 >= CASE WHEN l_linenumber % 3 = 0 THEN 70 ELSE 80 END THEN 'hash match' ELSE 'judge' END AS route, count(*) AS n FROM lineitem GROUP BY 1",
    "match_decision": "SELECT CASE WHEN l_tax = 0 THEN 'missing' WHEN l_discount * 1000 >= 80 THEN 'hash' WHEN l_quantity / 50 >= 0.83 THEN 'ink' WHEN l_linenumber = 3 AND l_returnflag <> 'R' THEN 'text' ELSE 'differs' END AS verdict, count(*) AS n FROM lineitem GROUP BY 1",
    "name_filter": "SELECT p_partkey, p_name FROM part WHERE p_type = 'ECONOMY' AND p_name ILIKE '%ring%'",
    "content_hash": "SELECT p_partkey, sha256(strlen(p_name) || ':' || p_name || strlen(p_brand) || ':' || p_brand || strlen(p_type) || ':' || p_type) AS key FROM part",
    "content_urls": r"SELECT page_id, '/' || regexp_extract(url, '^https?://([^/]+)/', 1) || '/' || regexp_extract(url, '^https?://[^/]+/([a-z]+)/\d+', 1) || '/' || lpad(regexp_extract(url, '^https?://[^/]+/[a-z]+/(\d+)', 1), 6, '0') || '.json' AS target FROM pages WHERE regexp_matches(url, '^https?://[^/]+/[a-z]+/\d+')",
    "scrub_secret": """SELECT replace(props, '"k": 1', '"k": *') AS props, count(*) AS n FROM events GROUP BY 1""",
    "json_prune": """SELECT p_partkey, CASE WHEN p_size > 25 THEN '{"title":"' || p_name || '"}' ELSE '{"content":"' || p_brand || '"}' END AS json FROM part""",
    "sorted_names": "SELECT n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY lower(n_name)) AS n FROM nation",
}
