"""Every operator over the same odd rows: nulls in any column, empty and very long texts, ties, repeats, further columns with names of its own."""

import pytest
from pyspark.sql import functions as F

from arbora.llm import decontamination, hmm, line_dedup, mixing, quality, secrets, simhash, toxicity, url_filter
from arbora.llm.url_query import RULES

LONG = "Lorem ipsum dolor sit amet consetetur sadipscing elitr\n" * 4000 + "token=abcdefghijklmnop " + "end " * 20_000
ROWS = [(1, None, None), (None, "a b c", "s"), (2, "", None), (3, LONG, "s"), (4, "one two three four five six seven", "t"), (4, "one two three four five six seven", "t"), (5, "Ünï ẞ 😀 \x0b\x0c x", "ß"), (6, " \t\n", "t")]
CLASHING = "k1 k2 row words at n run element shingle found kind start end token p random size order slot block rank pass print key root node evidence score held_out head n_lines __drop times word".split()


def plain(rows):
    return sorted(str(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.fixture(scope="module")
def model(docs_of, spark):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (3, 1, 0), (2, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = docs_of(ROWS)
    return toxicity.fit(docs, labels, F.lit(True)), quality.fit(docs, labels), labels


def operators(model, spark):
    items = spark.createDataFrame([(1, "two three four five six"), (None, "dolor"), (2, None)], "item_id long, text string")
    return {
        "toxicity": lambda d: toxicity.score(d, model[0]),
        "quality": lambda d: quality.judged(d, model[1], texts=False).select("doc_id", "evidence", "host_posterior", "path_posterior", "quality_score"),
        "line_dedup": lambda d: line_dedup.dedup_lines(d, 2).select("doc_id", "n_lines", "n_dropped", F.md5(F.col("text").cast("binary"))),
        "secrets": secrets.scan,
        "hmm": lambda d: hmm.score(d, head=3, classes=3, states=2, rounds=1),
        "decontamination": lambda d: decontamination.hits(d, items).select("doc_id", "n_words", "n_hit", F.array_join("items", ",")),
        "decontaminated": lambda d: decontamination.decontaminated(d, items).select("doc_id", F.md5(F.col("text").cast("binary"))),
        "simhash": simhash.simhash_groups,
        "near": simhash.near_duplicates,
        "mixing": lambda d: mixing.mix(d, 100),
    }


@pytest.mark.parametrize("name", ["toxicity", "quality", "line_dedup", "secrets", "hmm", "decontamination", "decontaminated", "simhash", "near", "mixing"])
def test_odd_rows(spark, docs_of, model, name):
    run = operators(model, spark)[name]
    docs = docs_of(ROWS)
    bare = plain(run(docs).collect())
    assert len(bare) == len(ROWS) - {"decontaminated": 3}.get(name, 0)
    wide = docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHING) if c not in docs.columns))
    assert plain(run(wide).collect()) == bare
    assert run(docs_of([])).collect() == []


def test_pages_with_clashing_columns(spark, model):
    pages = spark.createDataFrame([(1, "http://a.net/en/1", "x", 1), (1, "http://a.net/en/1", "x", 1), (None, None, None, None), (2, "x" * 100_000, "", 2), (3, "http://b.org/de/" + "y/" * 20_000, "", 3)], "page_id long, url string, rule string, tokens int")
    found = url_filter.judge(pages, model[2], RULES).collect()
    assert len(found) == 5 and {r.page_id: r.verdict for r in found} == {1: "block", None: "allow", 2: "allow", 3: "allow"}
