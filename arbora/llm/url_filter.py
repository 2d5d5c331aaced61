"""URL filters: fixed host and path rules first, then association rules mined from labels by FP-growth.

Labelled pages are a sample of all pages; what is known of one is the verdict of the fixed rule that fits its URL, else its
label, so rules are learnt against the share of bad URLs that they will meet. A known URL is a basket of its tokens (labels of
the host with their place from the right, directories of the path with their place, the extension, names of query fields) and
its label. FP-growth finds frequent baskets; those that hold the label to block give rules "tokens -> block". A rule stays if
its support, its confidence and its lift over the share of bad URLs suffice and no rule of fewer of its tokens is as sure. The
rules carry over to URLs that no fixed rule fits. They match by an inverted index: each is listed under its rarest token, a
URL looks up its tokens and holds a rule if it has all of the rule's.

Defined cases: a URL that is null or has no ``://`` has empty host and path, no token, and fits no rule; labels that are null
are none; without labels or frequent baskets there is no mined rule, and what no fixed rule fits is allowed; repeated rows are
judged alike; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.llm.common import staged

SUPPORT = 0.0
LEAST_ROWS = 10
CONFIDENCE = 0.5
LIFT = 1.5
BROADCAST_RULES = 100_000
BAD = "label:bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """``text`` is a host and a path that starts with a slash; it fits the host, its subdomains and paths that start with the path."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def fixed_rule(rules: tuple[Rule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, F.lit(rule.text)).otherwise(text), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL."""
    labels = F.filter(F.reverse(F.split(host_of(url), r"\.")), lambda x: x != "")
    parts = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    extension = F.regexp_extract(path_of(url), r"\.([A-Za-z0-9]{1,8})$", 1)
    fields = F.regexp_extract_all(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(r"([^&=]+)(?:=[^&]*)?"), F.lit(1))
    return F.array_distinct(
        F.concat(
            F.transform(labels, lambda x, i: F.concat(F.lit("host"), i.cast("string"), F.lit(":"), x)),
            F.transform(parts, lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit(":"), x)),
            F.when(extension != "", F.array(F.concat(F.lit("ext:"), F.lower(extension)))).otherwise(F.array().cast("array<string>")),
            F.transform(F.coalesce(fields, F.array().cast("array<string>")), lambda x: F.concat(F.lit("field:"), x)),
        )
    )


def mined_rules(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least_rows: int = LEAST_ROWS, lift: float = LIFT) -> DataFrame:
    """(rule, tokens, confidence, support) from rows of tokens and bad (boolean); a rule needs a number of rows, the same at any size, and a share only if asked."""
    baskets = staged(labelled.select(F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items")))
    empty = "rule string, tokens array<string>, confidence double, support long"
    rows, bad_rows = baskets.agg(F.count("*"), F.count_if(F.array_contains("items", BAD))).first()
    if rows < least_rows or not bad_rows:
        return labelled.sparkSession.createDataFrame([], empty)
    frequent = staged(FPGrowth(itemsCol="items", minSupport=max(support, (least_rows - 0.5) / rows), minConfidence=confidence).fit(baskets).freqItemsets)
    key = lambda items: F.array_join(F.array_sort(items), "\n")
    bad = frequent.filter(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_sort(F.array_remove("items", BAD)).alias("tokens"), F.col("freq").alias("support")).withColumn("rule", key(F.col("tokens")))
    sure = bad.join(frequent.select(key(F.col("items")).alias("rule"), "freq"), "rule").withColumn("confidence", F.col("support") / F.col("freq")).filter(F.col("confidence") >= max(confidence, lift * bad_rows / rows))
    sure = staged(sure.select("rule", "tokens", "confidence", "support"))
    # a rule is one of another's tokens at most once under each of them, so they meet by token
    shorter = sure.select(F.col("rule").alias("part"), F.col("tokens").alias("part_tokens"), F.col("confidence").alias("part_confidence"), F.element_at("tokens", 1).alias("token"))
    met = sure.select("rule", "tokens", "confidence", F.explode("tokens").alias("token")).join(shorter, "token")
    covered = met.filter((F.size("part_tokens") < F.size("tokens")) & (F.size(F.array_except("part_tokens", "tokens")) == 0) & (F.col("part_confidence") >= F.col("confidence"))).select("rule").distinct()
    return sure.join(covered, "rule", "left_anti")


def inverted_index(rules: DataFrame) -> DataFrame:
    """``rules`` under the token that fewest rules have: (token, rule, tokens, confidence)."""
    spread = rules.select("rule", "tokens", "confidence", F.explode("tokens").alias("token"))
    rare = spread.withColumn("n", F.count("*").over(Window.partitionBy("token")))
    nth = F.row_number().over(Window.partitionBy("rule").orderBy("n", "token"))
    return rare.withColumn("nth", nth).filter("nth = 1").select("token", "rule", "tokens", "confidence")


def matched(urls: DataFrame, index: DataFrame) -> DataFrame:
    """(url, mined_confidence, mined_rule): the surest mined rule that each distinct url holds."""
    index = index.withColumnRenamed("tokens", "needed")
    index = F.broadcast(index) if index.count() <= BROADCAST_RULES else index
    looked_up = urls.filter("url IS NOT NULL").select("url").distinct().withColumn("tokens", tokens_of(F.col("url"))).withColumn("token", F.explode("tokens"))
    held = looked_up.join(index, "token").filter(F.size(F.array_except("needed", "tokens")) == 0)
    return held.groupBy("url").agg(F.max(F.struct("confidence", "rule")).alias("best")).select("url", F.col("best.confidence").alias("mined_confidence"), F.col("best.rule").alias("mined_rule"))


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...], document: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule and mined_confidence of each row of ``pages`` (page_id, url).

    ``document`` is the id that ``labels`` (doc_id, quality) know a page by, its page_id if none is given."""
    bad = labels.filter("quality IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg((F.min("quality") == 0).alias("labelled"))
    _, by_rule = fixed_rule(rules, host_of(F.col("url")), path_of(F.col("url")))
    mine = pages.select("url", (F.col("page_id") if document is None else document).cast("long").alias("__id"), by_rule.alias("by_rule")).join(bad, "__id")
    known = mine.select(tokens_of(F.coalesce("url", F.lit(""))).alias("tokens"), F.coalesce(F.col("by_rule") == "block", "labelled").alias("bad"))
    found = staged(matched(pages, inverted_index(staged(mined_rules(known.filter(F.size("tokens") > 0))))))
    text, verdict = fixed_rule(rules, F.col("host"), F.col("path"))
    parted = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).join(found, "url", "left")
    mined = F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")
    return parted.select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, mined).alias("verdict"), "mined_rule", "mined_confidence")
