import os

import pytest

import corpus_pipeline
from arbora.llm.common import staged
from arbora.llm.simhash import fingerprints
from arbora.sources.tables import table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    names, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = staged(stage(spark, docs, DATA))
        kept = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(kept) == len(set(kept)) and set(kept) <= ids
        ids = set(kept)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
    assert ids and all(r.taken <= 2 * r["size"] for r in docs.collect())


def test_stages_take_odd_rows(spark, docs_of):
    docs = docs_of([(1, None, None), (1, None, None), (None, "", "a"), (2, "some words stand here", None), (None, "other words", "b")])
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = staged(stage(spark, docs, DATA))
    assert sorted((r.doc_id for r in docs.collect()), key=str) == [1, 2, None, None]
    empty = docs_of([])
    for _, stage in corpus_pipeline.STAGES:
        empty = staged(stage(spark, empty, DATA))
    assert empty.count() == 0


def test_near_dedup_tells_rows_of_one_id_apart(spark, docs_of):
    one, two, three = (" ".join(f"{n}{i}" for i in range(60)) for n in ("first", "second", "third"))
    docs = docs_of([(5, one, "a"), (5, two, "a"), (5, two, "a"), (5, two, "b"), (3, one, "b"), (None, three, "a"), (None, three, "a")])
    found = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, DATA).collect()), key=str)
    assert found == sorted([(3, one), (5, two), (None, three), (None, three)], key=str)


def test_near_dedup_takes_the_links_of_fingerprints_and_of_whole_sets(spark, docs_of):
    """0 and 1 are of one fingerprint and share few shingles; 2 and 3 share over 0.8 and are further apart."""
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    refrain = "to be sung " * 200
    texts = [refrain + words("first", 60), refrain + words("second", 60), words("page", 200), words("page", 200) + " " + words("tail", 40)]
    texts += [refrain + words("second", 60) + " so be it", words("lone", 80), refrain.upper() + words("third", 60)]
    docs = docs_of(texts)
    prints = {r.doc_id: r.print % 2**64 for r in fingerprints(docs).collect()}
    assert prints[0] == prints[1] == prints[6] and (prints[2] ^ prints[3]).bit_count() > 2
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, DATA).collect()) == [0, 2, 5]


def test_near_dedup_runs_few_jobs(spark, docs_of):
    """Each job and exchange leaves a thread on the driver for a minute, which small inputs fill its memory with."""
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    docs = staged(docs_of([words("page", 200), words("page", 200) + " " + words("tail", 40), words("page", 200) + " more", words("lone", 80)] * 2 + ["", "x"]))
    spark.sparkContext.setJobGroup("near", "near")
    try:
        kept = corpus_pipeline.near_dedup(spark, docs, DATA).count()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("near"))
    assert kept == 4 and jobs <= 88
