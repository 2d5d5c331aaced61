import random

import numpy as np
from pyspark.sql import functions as F

from arbora.llm import quality, toxicity
from arbora.llm.quality import judged, measures
from arbora.llm.toxicity import Scorer, train


def prose(rng, n=60):
    return " ".join(rng.choice(["the", "river", "stone", "walks", "slowly", "over", "green", "hills", "and", "waters"]) for _ in range(n)) + "."


def test_toxicity_learns_words_and_misspellings():
    rng = random.Random(0)
    bad = ["idiot", "pathetic", "worthless"]
    texts, labels = [], []
    for i in range(300):
        words = prose(rng, rng.choice([8, 60, 400])).split()
        if i % 4 == 0:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    scorer = Scorer(*train(texts, np.array(labels)))
    scores = np.array([scorer.score(t) for t in texts])
    assert ((scores >= 0.3) == np.array(labels)).mean() > 0.97
    clean = scorer.score(prose(rng))
    assert scorer.score("you idi0t walk over the hills patheticc man") > 10 * clean
    assert 0 <= scorer.score("") <= 1 and 0 <= scorer.score("!!! ...") <= 1


def test_toxicity_without_classes(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs_of(["a", None]), none, F.lit(True))
    assert len({r.score for r in toxicity.score(docs_of(["a", None, ""]), model).collect()}) == 1
    some = spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs_of(["a", "b"]), some, F.lit(True)).collect()
    assert [(r.text, r.label) for r in rows] == [("a", 1)]
    assert toxicity.score(docs_of([]), model).collect() == []


def test_quality_separates_and_shrinks(spark, docs_of):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(240):
        good = i % 3 > 0
        text = prose(rng) if good else prose(rng).upper().replace(" ", "!! ")
        rows.append((i, text, "big" if i % 2 else f"site{i}"))
        labels.append((i, int(good), 0))
    docs = docs_of(rows + [(500, None, None), (501, "", "big")])
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {r.doc_id: r for r in judged(docs, model).collect()}
    assert all((found[i].quality_score >= 0.5) == bool(q) for i, q, _ in labels)
    assert len(found) == 242 and all(0 <= r.quality_score <= 1 for r in found.values())
    overall = np.mean([r.evidence for r in found.values()])
    assert abs(found[0].host_posterior - overall) < abs(found[0].evidence - overall)
    assert judged(docs_of([]), model).collect() == []


def test_measures_are_finite():
    for text in (b"", b" ", b"A", b"\xc3\xa9" * 9, b"x " * 10_000):
        assert np.isfinite(measures(text)).all() and len(measures(text)) == quality.SIZE
