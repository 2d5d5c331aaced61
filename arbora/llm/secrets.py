"""Secret scans in DataFrame functions alone: fixed patterns, and a battery of randomness tests beside them.

Base kinds (assign, access, hex) are leftmost matches of a pattern that are long enough. The battery tests every long token of
an inferred encoding (hex, base 32, base 36, base 62, base 64, its URL form), in base spans too, for randomness in its encoding's
alphabet: chi-squared uniformity of its symbols, runs of symbols of one class (digits, small and capital letters, others)
against those that the alphabet leads to expect, and serial correlation at distance one. Fisher's method combines the three
into ``fit``, the probability that random symbols look no more random than these.

A token is found random against what words and identifiers give: each text lends all its runs of words. A run is written as
identifiers (joined by capitals, slashes, dashes, ... and ended by digits) of an encoding and stratum of length that the corpus'
tokens have, drawn by hash among those it is long enough for, and cut from end to end at a length that varies by run, the last
identifier ending where the run ends; these null tokens take the same battery. A token's p-value is the share of null tokens of its encoding and length that
fit as well as it does, itself included. Benjamini-Hochberg within strata of length decides which p-values are discoveries, so the
rate of words and identifiers among the spans of kind random is what is controlled, and short tokens, where the battery tells
little apart, do not set the level of long ones. The null and the levels come from counts in LOG_BINS fixed bins an encoding
and stratum, tables of fixed size.

Spans are found by lengths of matches and of the pieces between them, added up by window functions within a row.

Defined cases: null and empty texts have no span; rows with equal id and text are found once and reported for each row; where
no text lends a run of words that is long enough nothing is random; an empty table gives an empty result; further columns are ignored. Places are
code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.llm.common import row_keys, staged

#: Kind, pattern, the group whose length counts, its least length.
BASE = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: Patterns that match where a long enough match of the same kind is, to pass over most texts; they shorten nothing.
HINTS = {"assign": r"[sS][sS][wW]|[cC][rR][eE][tT]|[kK][eE][nN]|[kK][eE][yY]", "access": r"AKIA", "hex": r"[0-9a-f]{16}"}
LEAST_TOKEN = 20
TOKEN = rf"[A-Za-z0-9+/_=-]{{{LEAST_TOKEN},}}"
RANDOM = "random"
KINDS = (*(k for k, *_ in BASE), RANDOM)
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encoding, what its tokens look like, its alphabet. The first that fits counts.
ENCODINGS = (
    ("hex", r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]+$", DIGITS + "abcdef"),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*$", UPPER + "234567"),
    ("base36", r"^(?=.*[0-9])(?=.*[A-Za-z])(?:[a-z0-9]+|[A-Z0-9]+)$", DIGITS + LOWER),
    ("base62", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9]+$", DIGITS + UPPER + LOWER),
    ("base64", r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/]+=*$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_-]+=*$", UPPER + LOWER + DIGITS + "-_"),
)
CLASSES = (DIGITS, UPPER, LOWER, "+/-_")
STRATA = (28, 36, 48, 72, 128)
LEVEL = 0.05
WORD_RUN = r"(?<![A-Za-z])[A-Za-z]++(?:[^A-Za-z0-9]{1,2}[A-Za-z]++){3,}+"
LONGEST = 192
ROW = ["k1", "k2"]
LOG_BINS, BINS_PER_TEN = 400, 20


def _pieces(docs: DataFrame) -> DataFrame:
    """(row, kind, nth, gap, whole, part): each match, the length of what stands before it, its whole and its counted group."""
    text = F.col("text")
    found = docs.select(*ROW, "text", *(F.when(F.rlike(text, F.lit(HINTS[k])), F.regexp_extract_all(text, F.lit(p), F.lit(0))).alias(f"{k}_whole") for k, p, *_ in BASE), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)).alias(f"{RANDOM}_whole"))
    patterns = {k: (p, g) for k, p, g, _ in BASE} | {RANDOM: (TOKEN, 0)}
    listed = []
    for kind, (pattern, group) in patterns.items():
        whole = F.col(f"{kind}_whole")
        parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
        zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), parts.alias("part"))
        rows = F.transform(F.slice(zipped, 1, F.size(whole)), lambda x: F.struct(F.char_length(x["gap"]).alias("gap"), x["whole"].alias("whole"), x["part"].alias("part")))
        listed.append(F.when(F.size(whole) > 0, F.struct(F.lit(kind).alias("kind"), rows.alias("found"))))
    kinds = found.select(*ROW, F.explode(F.filter(F.array(*listed), lambda x: x.isNotNull())).alias("x"))
    return kinds.select(*ROW, "x.kind", F.posexplode("x.found").alias("nth", "x")).select(*ROW, "kind", "nth", "x.gap", "x.whole", "x.part")


def _placed(pieces: DataFrame) -> DataFrame:
    """(row, kind, start, end, token, part) of each match."""
    upto = Window.partitionBy(*ROW, "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    once = pieces.dropDuplicates([*ROW, "kind", "nth"])
    ended = once.withColumn("end", F.sum(F.col("gap") + F.char_length("whole")).over(upto))
    return ended.select(*ROW, "kind", (F.col("end") - F.char_length("whole")).alias("start"), "end", F.col("whole").alias("token"), "part")


def _upper_tail(z: Column) -> Column:
    """The standard normal's upper tail, by a rational approximation of its error function (absolute error under 1e-7)."""
    x = F.abs(z) / 2**0.5
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = poly * F.exp(-x * x) / 2.0
    return F.when(z >= 0, tail).otherwise(1.0 - tail)


def encoded(tokens: DataFrame) -> DataFrame:
    """``tokens`` (token) with the encoding it looks like; tokens of none are left out."""
    encoding = F.lit(None).cast("string")
    for name, pattern, _ in reversed(ENCODINGS):
        encoding = F.when(F.rlike("token", F.lit(pattern)), F.lit(name)).otherwise(encoding)
    return tokens.withColumn("encoding", encoding).filter("encoding IS NOT NULL")


def tested(tokens: DataFrame) -> DataFrame:
    """``tokens`` (token, encoding) with length and fit, the combined probability of the battery."""
    alphabet = F.lit(None).cast("string")
    for name, _, symbols in ENCODINGS:
        alphabet = F.when(F.col("encoding") == name, F.lit(symbols)).otherwise(alphabet)
    known = tokens.withColumn("alphabet", alphabet)
    body = F.rtrim(F.col("token"), F.lit("="))
    known = known.withColumn("body", F.when(F.col("encoding").isin("hex", "base36"), F.lower(body)).otherwise(body))
    known = known.withColumn("length", F.char_length("body").cast("double")).withColumn("k", F.char_length("alphabet").cast("double"))
    known = known.withColumn("symbols", F.filter(F.split("body", ""), lambda c: c != "")).withColumn("codes", F.transform("symbols", lambda c: (F.instr(F.col("alphabet"), c) - 1).cast("double")))
    squares = F.aggregate(F.array_distinct("symbols"), F.lit(0.0), lambda a, c: a + F.pow(F.col("length") - F.char_length(F.replace("body", c, F.lit(""))), 2))
    known = known.withColumn("chi", F.col("k") / F.col("length") * squares - F.col("length"))
    freedom = F.col("k") - 1
    by_chi = (F.pow(F.col("chi") / freedom, 1 / 3) - (1 - 2 / (9 * freedom))) / F.sqrt(2 / (9 * freedom))
    known = known.withColumn("mean", F.aggregate("codes", F.lit(0.0), lambda a, c: a + c) / F.col("length"))
    pairs = F.arrays_zip(F.slice("codes", F.lit(1), F.size("codes") - 1).alias("a"), F.slice("codes", F.lit(2), F.size("codes") - 1).alias("b"))
    classed = F.translate("body", "".join(CLASSES), "".join(str(i) * len(c) for i, c in enumerate(CLASSES)))
    turns = F.char_length(F.regexp_replace(classed, r"(.)\1+", "$1")).cast("double") - 1
    chance = F.lit(None).cast("double")
    for name, _, symbols in ENCODINGS:
        shares = [sum(s in c for s in symbols) / len(symbols) for c in CLASSES]
        chance = F.when(F.col("encoding") == name, 1 - sum(x * x for x in shares)).otherwise(chance)
    joint = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + (x["a"] - F.col("mean")) * (x["b"] - F.col("mean")))
    spread = F.aggregate("codes", F.lit(0.0), lambda s, c: s + F.pow(c - F.col("mean"), 2))
    known = known.withColumn("turns", turns).withColumn("chance", chance).withColumn("joint", joint).withColumn("spread", spread)
    places = F.col("length") - 1
    by_runs = F.abs(F.col("turns") - places * F.col("chance")) / F.sqrt(places * F.col("chance") * (1 - F.col("chance")))
    by_order = F.when(F.col("spread") > 0, F.abs(F.col("joint") / F.col("spread") + 1 / F.col("length")) * F.sqrt("length")).otherwise(F.sqrt("length"))
    log_p = F.log(F.greatest(_upper_tail(by_chi), F.lit(1e-30))) + F.log(F.greatest(2 * _upper_tail(by_runs), F.lit(1e-30))) + F.log(F.greatest(2 * _upper_tail(by_order), F.lit(1e-30)))
    half = -log_p
    known = known.withColumn("half", half).withColumn("fit", F.exp(-F.col("half")) * (1 + F.col("half") + F.col("half") * F.col("half") / 2))
    return known.drop("alphabet", "body", "k", "symbols", "codes", "chi", "mean", "turns", "chance", "joint", "spread", "half")


def null_tokens(docs: DataFrame, groups: list[tuple[str, int]]) -> DataFrame:
    """(token, encoding): every run of words of ``docs`` (text) as identifiers of one of the (encoding, stratum) it is long enough for.

    What a run can be is judged by lengths alone, and only the style drawn is written. Rows without a token go after the last
    explode: a filter before it, and one that Spark infers from an inner explode, would be moved below and work out all of this again."""
    runs = docs.select(F.xxhash64("text").alias("t"), F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD_RUN), F.lit(0))).alias("nth", "run"))
    spaced = runs.select(F.regexp_replace("run", "[^A-Za-z]+", " ").alias("words"), F.xxhash64("t", "nth").alias("h")).withColumn("digits", F.pmod("h", F.lit(1000)).cast("string"))
    joined = lambda column, mark: F.replace(column, F.lit(" "), F.lit(mark))
    words = F.col("words")
    styles = {
        "hex": F.regexp_replace(F.lower(words), "[^a-f]", ""),
        "base32": joined(F.upper(words), ""),
        "base36": joined(F.lower(words), ""),
        "base62": joined(F.initcap(words), ""),
        "base64": joined(words, "/"),
        "base64url": joined(words, "-"),
    }
    spaced = spaced.withColumn("of_hex", F.char_length(styles["hex"])).withColumn("of_words", F.char_length("words")).withColumn("of_letters", F.char_length(joined(words, "")))
    long_by = {"hex": "of_hex", "base64": "of_words", "base64url": "of_words"}  # other styles hold the letters alone
    bounds = [LEAST_TOKEN, *STRATA, LONGEST]
    fitting = [F.struct(F.lit("hex").alias("encoding"), F.lit(1).alias("size"), F.lit(0).alias("long"))]
    for encoding, stratum in groups:
        least, most = bounds[stratum], bounds[stratum + 1]
        length = (least + F.pmod(F.shiftright("h", 10), F.lit(most - least))).cast("int")
        fitting.append(F.struct(F.lit(encoding).alias("encoding"), (length - F.length("digits")).alias("size"), F.col(long_by.get(encoding, "of_letters")).alias("long")))
    able = spaced.withColumn("able", F.filter(F.array(*fitting), lambda x: x["long"] >= x["size"]))
    nth = F.pmod(F.shiftrightunsigned("h", 32), F.greatest(F.size("able"), F.lit(1))).cast("int")  # null of none
    drawn = able.withColumn("x", F.get("able", nth)).select("words", "digits", "x.encoding", "x.size")
    styled = F.lit(None).cast("string")
    for encoding, style in styles.items():
        styled = F.when(F.col("encoding") == encoding, style).otherwise(styled)
    whole = drawn.withColumn("whole", styled)
    pieces = F.regexp_extract_all("whole", F.concat(F.lit(".{"), F.col("size").cast("string"), F.lit("}")), F.lit(0))
    last = F.when(F.char_length("whole") % F.col("size") > 0, F.array(F.right("whole", F.col("size")))).otherwise(F.array().cast("array<string>"))
    ends = F.when(F.col("encoding") == "base32", F.translate("digits", "0189", "2345")).otherwise(F.col("digits"))
    cut = whole.select("encoding", ends.alias("ends"), F.explode_outer(F.concat(pieces, last)).alias("body")).filter("body IS NOT NULL")
    return cut.select(F.concat("body", "ends").alias("token"), "encoding")


def _stratum() -> Column:
    return sum((F.when(F.col("length") >= s, 1).otherwise(0) for s in STRATA), F.lit(0))


def _bin() -> Column:
    return F.least(F.floor(-F.log10(F.greatest("fit", F.lit(1e-30))) * BINS_PER_TEN), F.lit(LOG_BINS))


def discovered(judged: DataFrame, null: DataFrame, level: float = LEVEL) -> DataFrame:
    """``judged`` (encoding, length, fit) with p, by the null's fits, and random, whether p is a discovery among its length's."""
    marked = judged.withColumn("stratum", _stratum()).withColumn("bin", _bin())
    group = ["encoding", "stratum"]
    counted = staged(null.withColumn("stratum", _stratum()).withColumn("bin", _bin()).groupBy(*group, "bin").agg(F.count("*").alias("n")))
    asked = marked.select(*group, "bin").distinct().withColumn("n", F.lit(0).cast("long"))  # so that each token's bin is in the table
    as_well = F.sum("n").over(Window.partitionBy(*group).orderBy("bin"))
    whole = F.sum("n").over(Window.partitionBy(*group))
    table = counted.unionByName(asked).groupBy(*group, "bin").agg(F.sum("n").alias("n")).select(*group, "bin", ((1 + as_well) / (1 + whole)).alias("p"))
    valued = marked.join(F.broadcast(table), [*group, "bin"])  # at most encodings x strata x bins rows
    steps = valued.groupBy("stratum", "p").agg(F.count("*").alias("n"))
    rank, of_all = F.sum("n").over(Window.partitionBy("stratum").orderBy("p")), F.sum("n").over(Window.partitionBy("stratum"))
    cut = steps.withColumn("passes", F.col("p") <= level * rank / of_all).groupBy("stratum").agg(F.max(F.when(F.col("passes"), F.col("p"))).alias("cut"))
    return valued.join(F.broadcast(cut), "stratum").withColumn("random", F.coalesce(F.col("p") <= F.col("cut"), F.lit(False))).drop("stratum", "bin", "cut")


def spans(docs: DataFrame) -> DataFrame:
    """Row keys, kind, start, end and, of kind random, encoding, p and random of every base span and tested token, for ``docs`` of (k1, k2, text)."""
    placed = staged(_placed(_pieces(docs)))
    long_enough = F.lit(False)
    for kind, _, _, least in BASE:
        long_enough = F.when(F.col("kind") == kind, F.char_length("part") >= least).otherwise(long_enough)
    base = placed.filter(long_enough).select(*ROW, "kind", "start", "end")
    tokens = encoded(placed.filter(F.col("kind") == RANDOM))
    judged = staged(tested(tokens))
    groups = sorted((r.encoding, r.stratum) for r in judged.select("encoding", _stratum().alias("stratum")).distinct().collect())  # of a fixed set
    found = discovered(judged, tested(null_tokens(docs, groups)))
    return base.unionByName(found.select(*ROW, "kind", "start", "end", "encoding", "p", "random"), allowMissingColumns=True)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base, spans (kind:start:end, by start and kind) and tested (start:end:encoding:p) of each row."""
    keyed = docs.select("doc_id", *(k.alias(n) for k, n in zip(row_keys("doc_id", "text"), ROW)), F.coalesce("text", F.lit("")).alias("text"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct("start", rank.alias("rank"), "kind", "end", "encoding", "p", "random")
    listed = spans(keyed.select(*ROW, "text")).groupBy(*ROW).agg(F.sort_array(F.collect_list(span)).alias("every"))
    joined = keyed.select("doc_id", *ROW).join(listed, ROW, "left")
    joined = joined.withColumn("found", F.filter("every", lambda x: x["random"].isNull() | x["random"]))
    shown = lambda xs: F.coalesce(F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","), F.lit(""))
    probed = F.transform(F.filter("every", lambda x: x["kind"] == RANDOM), lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"), x["encoding"], F.format_string("%.2e", x["p"])))
    count_of = lambda kind: F.coalesce(F.size(F.filter("found", lambda x: x["kind"] == kind)), F.lit(0)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["kind"] != RANDOM)
    return joined.select("doc_id", *map(count_of, KINDS), shown(base).alias("base"), shown(F.col("found")).alias("spans"), F.coalesce(F.array_join(probed, ","), F.lit("")).alias("tested"))
