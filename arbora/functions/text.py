"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Typographic variants and the plain characters they are read as.
VARIANTS = "“”„‘’‚‐‑‒–—−¹²³"
PLAIN = "\"\"\"'''------123"
ROMAN = ((50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))
#: Glyphs that never count, and how a provision is cited.
DOTS = "•·⋅"
CITED = r"(?:(?<![A-Za-z])[A-Z]-\d+(?:\.\d+)*|\d+(?:\.\d+)+)(?:\.?\([0-9a-z]+\)(?:\s*\([0-9a-z]+\))*)?"
#: Heading type, pattern and what its font's name holds, in order of precedence.
HEADINGS = (
    ("Division", r"^Division\s+([A-Z])\s*$", "Black"),
    ("NotesContainer", r"^Notes to Part\s+(\d+)\s*$", "Black"),
    ("Part", r"^Part\s+(\d+)\s*$", "Black"),
    ("Section", r"^Section\s+(\d+\.\d+)\.\s*(.*)$", "Black"),
    ("Article", r"^(\d+\.\d+\.\d+\.\d+)\.\s*(.*)$", "Black"),
    ("Subsection", r"^(\d+\.\d+\.\d+)\.\s+(.*)$", "Black"),
    ("Appendix", r"^Appendix\s+([A-Z])\s*$", "Black"),
    ("AppendixPart", r"^Section\s+([A-Z])-(\d+)\s+(.*)$", "Black"),
    ("AppendixArticle", r"^([A-Z])-(\d+\.\d+\.\d+)\.\s+(.*)$", "Black"),
    ("AppendixSection", r"^([A-Z])-(\d+\.\d+)\.\s+(.*)$", "Black"),
    ("TableGroup", r"^[A-Z][A-Za-z ]*\bTables\s*$", "Black"),
    ("BackMatter", r"^PROVINCE OF BRITISH COLUMBIA$", "Bold"),
)
#: Captions, captions of an identifier alone, headings of table notes, font families, leading markers.
CAPTION = r"^(Table|Figure)\s+(\S.*)$"
BARE_CAPTION = r"^(Table|Figure)\s+([A-Z]-)?\d+(\.\d+)*\.?(-[A-Z])?$"
TABLE_NOTES = r"^Notes? to (Table|Figure)\s*[A-Z0-9]\S*:?\s*$"
FONT_FAMILY = r"^([A-Za-z]*?)(?=MT|PS|-|/|$)"
MARKER = r"^([A-Za-z0-9]{1,4})\)\s+(.*)$"
GLUED_MARKER = r"^([A-Za-z0-9]{1,4})\)(.*)$"
OWN_MARKER = r"^\(?([0-9A-Za-z]{1,6})\)\s*"
FORMULA_ERROR = r"\[[a-z]\]"
#: What one-sided edits look like without whitespace, in order of precedence.
ONE_SIDED = (
    ("Punctuation", r"""[.,;:"'()]+"""),
    ("Reference wording", r"(Sentences?|Articles?|Clauses?|Subclauses?|Tables?|Figures?|Subsections?|Sections?|Parts?|ofDivision[ABC]|([0-9]+\.)+(\([0-9A-Za-z_]+\))*|-[A-Z])+"),
    ("Standard designation", r"(ULC|CSA|CGSB|ASTM|ANSI|UL|NFPA|CCBFC|NRCC|ISO|IEC|:[0-9]{2,4})+"),
    ("Note link text", r"Note"),
)


def normalized_identifier(text: Column) -> Column:
    """Whitespace collapsed, final dots gone."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"\.+$", "")


def dotted(base: Column, segment: Column) -> Column:
    """``base.segment``, the segment alone under an empty base."""
    return F.when(F.coalesce(base, F.lit("")) == "", segment).otherwise(F.concat(base, F.lit("."), segment))


def plain_characters(text: Column) -> Column:
    return F.translate(text, VARIANTS, PLAIN)


def title_key(title: Column) -> Column:
    """A table title without what it is part of, footnote marks, and anything but word characters, in lower case."""
    bare = F.regexp_replace(title, r"\s*Forming [Pp]art of .*$", "")
    bare = F.regexp_replace(bare, r"\^\{\(\d+\)\}|\(\d+\)", "")
    return F.lower(F.regexp_replace(bare, r"[\W_]+", ""))


def heading_type(line: Column, font: Column | None = None) -> Column:
    """The first heading type whose pattern the line has, set in its kind of font where one is given, else null."""
    found = F.lit(None).cast("string")
    for name, pattern, face in reversed(HEADINGS):
        fits = F.rlike(line, F.lit(pattern))
        found = F.when(fits if font is None else fits & F.contains(font, F.lit(face)), name).otherwise(found)
    return found


def heading_words(line: Column, kind: Column) -> Column:
    """The words of a heading that are no title: what stands before the pattern's last group where that is a title, else all."""
    out = line
    for name, pattern, _ in HEADINGS:
        if pattern.endswith("(.*)$"):
            title = F.regexp_extract(line, pattern, pattern.count("("))
            out = F.when(kind == name, F.rtrim(F.substr(line, F.lit(1), F.length(line) - F.length(title)))).otherwise(out)
    return out


def caption_kind(line: Column, font: Column, centred: Column) -> Column:
    """Table or Figure where a line is a caption: in a bold face that is neither black nor narrow, or alone on a centred line."""
    has = lambda face: F.contains(font, F.lit(face))
    bold = has("Bold") & ~has("Black") & ~has("Narrow")
    bare = centred & ~has("Narrow") & F.rlike(line, F.lit(BARE_CAPTION))
    kind = F.regexp_extract(line, CAPTION, 1)
    return F.when((bold | bare) & (kind != ""), kind)


def is_table_notes_heading(line: Column) -> Column:
    return F.rlike(line, F.lit(TABLE_NOTES))


def font_family(font: Column) -> Column:
    return F.regexp_extract(font, FONT_FAMILY, 1)


def roman(number: Column) -> Column:
    """Lower-case roman numeral of 1 to 89."""
    out, rest = F.lit(""), number
    for value, symbol in ROMAN:
        times = F.floor(rest / value).cast("int")
        out = F.concat(out, F.repeat(F.lit(symbol), times))
        rest = rest - times * value
    return out


def roman_of(number: int) -> str:
    out = ""
    for value, symbol in ROMAN:
        times, number = divmod(number, value)
        out += symbol * times
    return out


VALID_ROMANS = [roman_of(n) for n in range(1, 61)]


def marker_token(line: Column, first_run_end: Column | None = None) -> Column:
    """The token of a leading ``token)`` marker followed by a space, else null.

    Where the line's first span of text is known to end at the bracket, the space may be missing, unless the token is noise."""
    token = F.regexp_extract(line, MARKER, 1)
    spaced = F.when(token != "", token)
    if first_run_end is None:
        return spaced
    glued = F.regexp_extract(line, GLUED_MARKER, 1)
    own = (glued != "") & (first_run_end == F.length(glued) + 1) & (marker_kind(glued) != "noise")
    return F.coalesce(spaced, F.when(own, glued))


def marker_kind(token: Column) -> Column:
    """sentence, ambiguous, clause, subclause or noise; null for null."""
    low = F.lower(token)
    return (
        F.when(F.rlike(token, F.lit(r"^[0-9]+$")), "sentence")
        .when((F.length(low) == 1) & low.isin(*"ivxlcdm"), "ambiguous")
        .when(F.length(low) == 1, "clause")
        .when(low.isin(*VALID_ROMANS), "subclause")
        .when(token.isNotNull(), "noise")
    )


def edit_category(left: Column, right: Column) -> Column:
    """How a changed stretch of text differs; an empty side is text that one side alone has."""
    changed = F.when(left == "", right).otherwise(left)
    one_sided = F.lit("Wording")
    for name, body in reversed(ONE_SIDED):
        one_sided = F.when(F.rlike(changed, F.lit(f"^(?:{body})$")), name).otherwise(one_sided)
    both = F.when(F.lower(left) == F.lower(right), "Letter case").when(F.contains(right, F.lit("Note")), "Note link text").otherwise("Wording")
    return F.when((left != "") & (right != ""), both).otherwise(one_sided)


def context(text: Column, start: Column, end: Column, width: int = 30) -> Column:
    """before, changed and after of [start, end) with ``width`` characters on either side."""
    begin = F.greatest(F.lit(0), start - width)
    before = F.concat(F.when(start > width, "…").otherwise(""), F.substr(text, begin + 1, start - begin))
    after = F.concat(F.substr(text, end + 1, F.lit(width)), F.when(end + width < F.length(text), "…").otherwise(""))
    return F.struct(before.alias("before"), F.substr(text, start + 1, end - start).alias("changed"), after.alias("after"))


def duration(seconds: Column) -> Column:
    """``n/a``, ``0.4 s``, ``38 s``, ``4m 12s`` or ``1h 03m 05s``; halves go to the even neighbour."""
    span = F.greatest(seconds, F.lit(0.0))
    tenths, whole = F.bround(span, 1), F.bround(span, 0).cast("long")
    short = F.concat(F.when(tenths == F.floor(tenths), F.floor(tenths).cast("string")).otherwise(F.format_number(tenths, 1)), F.lit(" s"))
    hours, minutes, rest = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    long = F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), two(minutes), F.lit("m "), two(rest), F.lit("s"))).otherwise(F.concat(minutes.cast("string"), F.lit("m "), two(rest), F.lit("s")))
    return F.when(seconds.isNull(), "n/a").when(tenths < 60, short).otherwise(long)


def slug(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def summary(text: Column, most: int = 250) -> Column:
    """Up to ``, so that``, bracketed references dropped, cut at a word boundary with an ellipsis when longer than ``most``."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"\s*\([A-Z]+-?\d+\)", ""), r",? so that .*$", ""))
    cut = F.regexp_replace(F.substring(bare, 1, most - 1), r"\s+\S*$", "")
    return F.when(F.length(bare) <= most, bare).otherwise(F.concat(cut, F.lit("…")))


def normalized_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9\s]", " "), r"\s+", " "))


def clean_html(html: Column) -> Column:
    """Without header and script elements, style elements and id attributes."""
    bare = F.regexp_replace(html, r"(?s)<(script|style|header)\b[^>]*>.*?</\1>", "")
    return F.regexp_replace(bare, r"""\s+id="[^"]*\"""", "")


def link_paths(html: Column) -> Column:
    """Distinct link targets in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1)))


def content_key(*parts: Column) -> Column:
    """SHA-256 over parts, each after its length, so that no two lists of parts run together."""
    return F.sha2(F.concat(*(x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p))).cast("binary"), 256)


def jaccard(left: Column, right: Column) -> Column:
    """Similarity of two arrays as sets, 0 where both are empty."""
    union = F.size(F.array_union(left, right))
    return F.when(union > 0, F.size(F.array_intersect(left, right)) / union).otherwise(0.0)
