import re

from arbora.llm.url_filter import judge, mined_rules, tokens_of
from arbora.llm.url_query import RULES
from pyspark.sql import functions as F

URLS = ["http://a.net/x", "https://m.b.example.net/en/2?x=1", "http://EXAMPLE.com/de/1", "http://x.example.com/fr/1", "http://q.org/fr/", "http://net", "http://net/", "http://notnet.com/", "no scheme", None, "", "a://b.ORG/fr/x#y", "x\ny://h.net/p", "http://É.net/ü?q", "http://example.com/de"]


def brute(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best.verdict if best else "allow"


def test_fixed_rules_against_brute_force(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(0, URLS[0])], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge(pages, labels, RULES).collect()]
    assert sorted(found, key=str) == sorted([(i, *brute(u)) for i, u in list(enumerate(URLS)) + [(0, URLS[0])]], key=str)


def test_mined_rules_block(spark):
    rows = [(i, f"http://www.spam-farm.org/p{i}/buy?ref=1") for i in range(30)] + [(100 + i, f"http://good{i % 5}.org/p{i}/read?ref=1") for i in range(60)]
    labels = spark.createDataFrame([(i, 0 if i < 100 else 1, 0) for i, _ in rows if i % 3 or i > 90] + [(7, None, 0)], "doc_id long, quality int, toxic int")
    found = {r.page_id: r for r in judge(spark.createDataFrame(rows, "page_id long, url string"), labels, RULES).collect()}
    assert all(found[i].verdict == ("block" if i < 100 else "allow") for i, _ in rows)
    assert found[0].mined_confidence == 1.0 and "\n" not in found[0].mined_rule


def test_rules_of_fewer_tokens_win(spark):
    rows = [(["a", "b"], True)] * 6 + [(["a", "c"], True)] * 2 + [(["b"], False)] * 6
    rules = {r.rule: r.confidence for r in mined_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.1, 0.5, 1, 0.0).collect()}
    assert rules == {"a": 1.0, "b": 0.5, "c": 1.0} and mined_rules(spark.createDataFrame([], "tokens array<string>, bad boolean")).collect() == []


def test_tokens(spark):
    found = spark.createDataFrame([("http://M.x.org/a/b.HTML?q=1&r#t",), ("nothing",), ("",)], "url string").select(tokens_of(F.col("url")).alias("t")).collect()
    assert set(found[0].t) == {"host0:org", "host1:x", "host2:m", "path0:a", "path1:b.HTML", "ext:html", "field:q", "field:r"} and found[1].t == [] and found[2].t == []


def test_sparse_hosts_keep_their_rule_as_rows_grow(spark):
    rows = [(["host1:bad"], True)] * 10 + [(["host1:few"], True)] * 9 + [(["host1:good%d" % (i % 90)], False) for i in range(6000)]
    rules = mined_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).collect()
    assert [(r.rule, r.support) for r in rules] == [("host1:bad", 10)]


def test_fixed_verdicts_teach_and_lift_prunes(spark):
    """Where /win/ stands under blocked hosts only, it blocks elsewhere; /en/ stands under both and does not."""
    rows = [(i, f"http://h{i}.net/{'win' if i % 2 else 'en'}/{i}") for i in range(40)] + [(100 + i, f"http://x{i}.org/fr/{i}") for i in range(30)]
    rows += [(200, "http://y.org/win/1"), (201, "http://y.org/en/1"), (202, None)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    found = {r.page_id: r for r in judge(spark.createDataFrame(rows, "page_id long, url string"), labels, RULES).collect()}
    assert (found[200].rule, found[200].verdict, found[200].mined_rule) == (None, "block", "path0:win")
    assert found[202].verdict == "allow" and all(found[100 + i].verdict == "allow" for i in range(30))
