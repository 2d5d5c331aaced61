"""Records, labels, links and documents of reports, viewers and backlogs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arbora.functions.text import FORMULA_ERROR, OWN_MARKER

#: What stands for a missing number and a missing cost.
MISSING, NO_COST = "—", "cost unavailable"
#: Verdicts a judge may give, and the class each verdict is shown in.
JUDGED = ("IDENTICAL", "DIFFERENT")
VERDICT_CLASSES = (("MATCH_PHASH", "verdict-ok"), ("IDENTICAL", "verdict-ok"), ("DIFFERENT", "verdict-bad"), ("ERROR", "verdict-bad"), ("SKIPPED", "verdict-warn"), ("WEB_ONLY", "verdict-info"))
#: Sentences for reasons without a text to show.
REASONS = (
    ("no_web", "No matching item on the website"),
    ("left_empty", "The PDF has no text here; the website does"),
    ("right_empty", "The website has no text here; the PDF does"),
    ("image_inside", "The text matches; an image it holds differs"),
    ("image_differs", "The image differs from the website's"),
    ("no_web_image", "No matching image on the website"),
)
MARKED = ("Sentence", "Clause", "Subclause")
INLINE = r"\*\*.+?\*\*|`[^`]+`"
EQUATION_KEY = r"\.Eq\d+$"


def _by(value: Column, table, otherwise: Column) -> Column:
    out = otherwise
    for name, found in reversed(table):
        out = F.when(value == name, found).otherwise(out)
    return out


def money(value: Column) -> Column:
    return F.when(value.isNull(), NO_COST).otherwise(F.format_string("$%.5f", value))


def whole_number(value: Column) -> Column:
    return F.when(value.isNull(), MISSING).otherwise(F.format_number(value, 0))


def rate(value: Column) -> Column:
    """One decimal below ten, none from there on."""
    return F.when(value.isNull(), MISSING).when(value >= 10, F.format_string("%.0f", value)).otherwise(F.format_string("%.1f", value))


def model_name(name: Column, provider: str) -> Column:
    """A model's name with its provider in front, unless it names one or is empty."""
    return F.when((name == "") | F.contains(name, F.lit("/")), name).otherwise(F.concat(F.lit(provider + "/"), name))


def quoted(text: Column) -> Column:
    """A URL component: all but letters, digits and -_.!~*'() as percent codes."""
    out = F.url_encode(text)
    for code, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def page_route(page_file: Column, folder: str = "web_pages") -> Column:
    """The route of a saved page."""
    return F.concat(F.lit("/web-page/"), quoted(F.regexp_replace(F.regexp_replace(page_file, f"^{folder}/", ""), r"\.html$", "")))


def image_route(path: Column) -> Column:
    return F.when(path != "", F.concat(F.lit("/api/llm-image/"), F.array_join(F.transform(F.split(path, "/"), quoted), "/")))


def page_link(page: Column) -> Column:
    return F.concat(F.lit("/pdf#page="), page.cast("string"))


def safe_file(name: Column, suffix: str) -> Column:
    """A name as a single file name, null if it could leave its folder."""
    return F.when(F.rlike(name, F.lit(r"^[\w.\-]+$")) & ~F.contains(name, F.lit("..")), F.concat(name, F.lit(suffix)))


def asset_file(site_path: Column) -> Column:
    """A site-root path relative to a mirror's folder, null if it is none or climbs."""
    parts = F.filter(F.split(site_path, "/"), lambda x: ~x.isin("", "."))
    return F.when(F.startswith(site_path, F.lit("/")) & ~F.array_contains(F.split(site_path, "/"), "..") & (F.size(parts) > 0), F.array_join(parts, "/"))


def manifest(count: Column) -> Column:
    """Which image of a call belongs to which pair."""
    line = lambda n: F.concat(F.lit("PAIR "), n.cast("string"), F.lit(": image "), (2 * n - 1).cast("string"), F.lit(" is A (PDF), image "), (2 * n).cast("string"), F.lit(" is B (web)"))
    head = F.concat(F.lit("This call holds "), count.cast("string"), F.lit(" numbered pair(s). Images are given in the order listed."))
    lines = F.when(count > 0, F.transform(F.sequence(F.lit(1).cast("long"), count.cast("long")), line)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(head), lines), "\n")


def style_name(bold: Column, italic: Column) -> Column:
    return F.concat(F.when(bold, "b").otherwise(""), F.when(italic, "i").otherwise(""))


def own_text(kind: Column, identifier: Column, title: Column, content: Column) -> Column:
    """A node's content without the marker or heading that repeats its own identifier and title."""
    text, name = F.coalesce(content, F.lit("")), F.coalesce(identifier, F.lit(""))
    marker, token = F.regexp_extract(text, OWN_MARKER, 0), F.regexp_extract(text, OWN_MARKER, 1)
    own = kind.isin(*MARKED) & (marker != "") & (F.lower(token) == F.lower(F.regexp_replace(name, r"^[()]+|[()]+$", "")))
    heading = F.when(kind == "Note", F.concat(name, F.lit(" "), F.coalesce(title, F.lit("")))).when(kind == "appendix_article", F.concat(name, F.lit(". "), F.coalesce(title, F.lit(""))))
    cut = F.when(own, F.length(marker)).when(F.startswith(text, heading), F.length(heading)).otherwise(0)
    return F.substr(text, cut + 1, F.length(text))


def formula_letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^0-9a-z]", "")


def shows_formula_error(text: Column) -> Column:
    return F.rlike(text, F.lit(FORMULA_ERROR))


def formula_markup(mathml: Column, latex: Column) -> Column:
    """MathML as it is, else LaTeX with single backslashes, escaped, between display marks."""
    bare = F.replace(latex, F.lit("\\\\"), F.lit("\\"))
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        bare = F.replace(bare, F.lit(plain), F.lit(code))
    return F.coalesce(mathml, F.concat(F.lit("\\["), bare, F.lit("\\]")))


def rebased_css(css: Column, folder: Column, prefix: str, deepest: int = 4) -> Column:
    """url(...) references of a stylesheet in ``folder`` (from the site's root, without a slash at the end) under ``prefix``.

    References to data, other sites and fragments stay; up to ``deepest`` steps up (``../``) are taken."""
    out = css
    for steps in range(deepest, -1, -1):  # the references with most steps first, so that none is taken twice
        own = F.regexp_replace(folder, rf"(/[^/]*){{0,{steps}}}$", "") if steps else folder
        mark = r"""url\(\s*(['"]?)""" + r"\.\./" * steps + r"""(?!data:|https?:|/|#|\.\./|\x01)(?:\./)?([^'")]+)\1\s*\)"""
        out = F.regexp_replace(out, F.lit(mark), F.concat(F.lit(f'url("\u0001{prefix}'), own, F.lit('/$2")')))
    out = F.regexp_replace(out, r"""url\(\s*(['"]?)(/(?!/)[^'")]+)\1\s*\)""", f'url("{prefix}$2")')
    return F.replace(out, F.lit("\u0001"), F.lit(""))


def image_class(kind: Column, key: Column, caption: Column, decorative: Column, source: Column) -> Column:
    """What an image is shown as: its kind, else by its key, caption, decoration and source, in that order."""
    keyed = F.coalesce(key, F.lit("")) != ""
    return (
        F.when(F.coalesce(kind, F.lit("")) != "", kind)
        .when(F.rlike(F.coalesce(key, F.lit("")), F.lit(EQUATION_KEY)), "equation")
        .when(caption == "Figure", "figure")
        .when(decorative, "image")
        .when(source.isNull(), "equation")
        .when(keyed, "figure")
        .otherwise("image")
    )


def status_badge(ok: Column) -> Column:
    return F.when(ok, "✓").when(~ok, "✗").otherwise("")


def verdict_class(verdict: Column) -> Column:
    return _by(verdict, VERDICT_CLASSES, F.lit("verdict-none"))


def reason_title(kind: Column, category: Column, container: Column) -> Column:
    """The headline of a reason; without one, that of a container or of a difference that is not told."""
    text = F.when(category == "Mixed", "Text differs in several ways").otherwise(F.concat(F.lit("Text differs: "), F.lower(category)))
    untold = F.when(kind.isNull() & container, "Something inside differs").otherwise("Differs from the website")
    return F.when(kind == "text", text).when(kind == "emphasis", "Same words, different bold/italic").otherwise(_by(kind, REASONS, untold))


def hidden_note(edit_count: Column, shown: Column) -> Column:
    hidden = F.coalesce(edit_count, F.lit(0)) - shown
    return F.when(hidden > 0, F.concat(hidden.cast("string"), F.when(hidden == 1, " more difference not shown.").otherwise(" more differences not shown."))).otherwise("")


def inline_tokens(text: Column) -> Column:
    """(text, mark) pieces of a line in order: bold and code without their marks, plain text between them."""
    gaps, hits = F.split(text, INLINE, -1), F.regexp_extract_all(text, F.lit(INLINE), F.lit(0))
    piece = lambda t, m: F.struct(t.alias("text"), m.alias("mark"))
    marked = lambda h: piece(F.when(F.startswith(h, F.lit("`")), F.substr(h, F.lit(2), F.length(h) - 2)).otherwise(F.substr(h, F.lit(3), F.length(h) - 4)), F.when(F.startswith(h, F.lit("`")), "code").otherwise("strong"))
    zipped = F.transform(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), lambda x: F.array(piece(F.coalesce(x["gap"], F.lit("")), F.lit(None).cast("string")), F.when(x["hit"].isNotNull(), marked(x["hit"])).otherwise(piece(F.lit(""), F.lit(None).cast("string")))))
    return F.filter(F.flatten(zipped), lambda x: x["text"] != "")


def issue_fields(project: str, kind: str, summary: Column, labels: Column, parent: Column | None = None, priority: Column | None = None, priorities: tuple = (), always: tuple[str, ...] = ()) -> Column:
    """The fields of an issue; parent and a mapped priority only where there are any, as nulls are left out of JSON."""
    fields = [
        F.struct(F.lit(project).alias("key")).alias("project"),
        F.struct(F.lit(kind).alias("name")).alias("issuetype"),
        summary.alias("summary"),
        F.concat(F.array(*map(F.lit, always)).cast("array<string>"), labels).alias("labels"),
    ]
    if parent is not None:
        fields.append(F.when(parent.isNotNull(), F.struct(parent.alias("key"))).alias("parent"))
    if priority is not None:
        mapped = _by(priority, priorities, F.lit(None).cast("string"))
        fields.append(F.when(mapped.isNotNull(), F.struct(mapped.alias("name"))).alias("priority"))
    return F.struct(*fields)


def usable_entry(entry: Column) -> Column:
    """Whether a cached JSON entry has a judge's verdict, whole token counts, texts as differences and a number or no cost."""
    value = lambda path: F.get_json_object(entry, path)
    whole = lambda path: F.rlike(value(path), F.lit(r"^-?\d+$"))
    texts = F.from_json(value("$.differences"), "array<string>")
    cost = value("$.cost").isNull() | value("$.cost").try_cast("double").isNotNull()
    return F.coalesce(value("$.verdict").isin(*JUDGED) & whole("$.input_tokens") & whole("$.output_tokens") & texts.isNotNull() & cost, F.lit(False))


def retry_delay(attempt: Column, hint: Column, base: float, most: float, jitter: Column) -> Column:
    """Seconds to wait: a hint up to ``most``, else a doubling delay up to ``most`` of which at least half is kept."""
    doubling = F.least(F.lit(most), base * F.pow(F.lit(2.0), attempt)) * (0.5 + 0.5 * jitter)
    return F.when(hint.isNotNull(), F.least(hint, F.lit(most))).otherwise(doubling)


def error_route(status: Column, name: Column, transient: tuple[str, ...]) -> Column:
    """rate limit, transient or permanent, by status and by the error's name."""
    return F.when(F.coalesce((status == 429) | (name == "RateLimitError"), F.lit(False)), "rate limit").when(F.coalesce(status >= 500, F.lit(False)) | F.coalesce(name.isin(*transient), F.lit(False)), "transient").otherwise("permanent")


def citation(kind: Column, identifier: Column, division: Column) -> Column:
    """How a node of a type is cited; a final dot closes the numbers of sections, subsections and articles."""
    numbered = F.concat(identifier, F.lit("."))
    return (
        F.when(kind == "Division", identifier)
        .when(kind == "Part", F.concat_ws("-", division, identifier))
        .when(kind == "NotesContainer", F.concat_ws("-", F.lit("Notes"), division, identifier))
        .when(kind.isin("Section", "Subsection", "Article"), F.concat_ws("-", division, numbered))
        .when(kind.isin("Appendix", "AppendixPart"), F.concat(F.lit("Appendix-"), identifier))
        .when(kind.isin("AppendixArticle", "AppendixSection"), F.concat(F.lit("Appendix-"), numbered))
        .when(kind == "TableGroup", F.concat_ws("-", division, identifier))
        .otherwise(kind)
    )


def rich_inline(text: Column) -> Column:
    """The JSON array of a line's text nodes, bold and code as marks."""
    node = lambda x: F.struct(F.lit("text").alias("type"), x["text"].alias("text"), F.when(x["mark"].isNotNull(), F.array(F.struct(x["mark"].alias("type")))).alias("marks"))
    return F.to_json(F.transform(inline_tokens(text), node))


def rich_paragraph(text: Column) -> Column:
    return F.concat(F.lit('{"type":"paragraph","content":'), rich_inline(text), F.lit("}"))


def rich_document(sections: Column) -> Column:
    """The JSON of a description from sections (heading, text, items, ordered): headings, paragraphs and lists; an empty one is an empty paragraph."""
    item = lambda x: F.concat(F.lit('{"type":"listItem","content":['), rich_paragraph(x), F.lit("]}"))
    listed = lambda s: F.concat(F.lit('{"type":"'), F.when(s["ordered"], "orderedList").otherwise("bulletList"), F.lit('","content":['), F.array_join(F.transform(s["items"], item), ","), F.lit("]}"))
    heading = lambda s: F.concat(F.lit('{"type":"heading","attrs":{"level":3},"content":'), rich_inline(s["heading"]), F.lit("}"))
    nodes = F.flatten(F.transform(sections, lambda s: F.filter(F.array(heading(s), F.when(F.coalesce(s["text"], F.lit("")) != "", rich_paragraph(s["text"])), F.when(F.size(s["items"]) > 0, listed(s))), lambda x: x.isNotNull())))
    whole = F.when(F.size(nodes) > 0, F.array_join(nodes, ",")).otherwise(F.lit('{"type":"paragraph","content":[]}'))
    return F.concat(F.lit('{"type":"doc","version":1,"content":['), whole, F.lit("]}"))


def escaped(text: Column) -> Column:
    """Text as HTML shows it."""
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def html_row(cells: list[Column], css: Column | None = None) -> Column:
    """A table row of escaped cells, null ones empty, in a class where one is given."""
    start = F.lit("<tr>") if css is None else F.concat(F.lit('<tr class="'), css, F.lit('">'))
    return F.concat(start, *(x for c in cells for x in (F.lit("<td>"), F.coalesce(escaped(c.cast("string")), F.lit("")), F.lit("</td>"))), F.lit("</tr>"))


def card(label: str, value: Column) -> Column:
    return F.struct(F.lit(label).alias("label"), value.alias("value"))


def pair_record(key: Column, verdict: Column, score: Column, cached: Column, error: Column, cost: Column) -> Column:
    """What a run tells of a pair: an error has no cost and no cached answer, a cached one costs nothing now."""
    failed = error.isNotNull()
    return F.struct(key.alias("key"), F.when(failed, "ERROR").otherwise(verdict).alias("verdict"), score.alias("score"), (cached & ~failed).alias("cached"), F.when(~failed & ~cached, cost).alias("cost_now"), F.when(~failed, cost).alias("cost"), error.alias("error"))
