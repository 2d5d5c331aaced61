import random
import re

import pytest

from arbora.llm import decontamination
from arbora.llm.decontamination import decontaminated, hits


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(text, items, span=10):
    own, hit, named = words(text), set(), set()
    for item_id, item in items:
        item = words(item)
        n = min(len(item), span)
        wins = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if n else set()
        for i in range(len(own) - n + 1):
            if tuple(own[i : i + n]) in wins:
                hit.update(range(i, i + n))
                named.add("" if item_id is None else str(item_id))
    return len(own), len(hit), sorted(named)


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_against_brute_force(spark, docs_of, monkeypatch, broadcast):
    monkeypatch.setattr(decontamination, "BROADCAST_ELEMENTS", broadcast)
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choices(["ab", "cd", "EF", "Éa", "é9", "x-y", "zz"], k=n))
    items = [(i, text(rng.choice([1, 2, 3, 4, 6, 9, 10, 11, 25]) + 1)) for i in range(25)] + [(30, None), (31, ""), (None, "single"), (2, "second text of item two"), (33, "!!")]
    texts = [text(rng.randrange(40)) for _ in range(40)] + [None, "", "Single", "ab", items[4][1] + " " + (items[5][1] or "")] + [f"pre {t} post" for _, t in items if t]
    found = hits(docs_of(texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in found} == {i: brute(t, items) for i, t in enumerate(texts)}


def test_empty_tables_repeats_and_names(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    item = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    rows = [(None, "a b c d e f g h i j", "s")] * 3 + [(4, "clean", None)]
    assert [r.n_hit for r in hits(docs_of(rows), none).collect()] == [0] * 4
    assert hits(docs_of([]), item).collect() == []
    kept = decontaminated(docs_of(rows).selectExpr("*", "1 AS words", "2 AS maybe"), item).collect()
    assert [(r.doc_id, r.text, r.words, r.maybe) for r in kept] == [(4, "clean", 1, 2)]
