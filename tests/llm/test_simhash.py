import itertools
import random

import numpy as np
import pytest
import xxhash

from arbora.llm import simhash
from arbora.llm.components import components
from arbora.llm.simhash import fingerprint, linked_fingerprints, near_duplicates, simhash_groups


def brute_fingerprint(text, n=3):
    words = "".join(c.lower() if c.isascii() else c for c in text).split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", "one", "one two", "One two THREE", "a b c d e f g a b c", "Élan É x y z w"])
def test_fingerprint(text):
    assert fingerprint(text.encode()) % 2**64 == brute_fingerprint(text)


@pytest.mark.parametrize("hot", [1024, 1])
@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_links_are_exact(spark, monkeypatch, hot, bits):
    monkeypatch.setattr(simhash, "HOT_HOMES", hot)
    rng = random.Random(bits)
    values = {0, 2**63, 1}
    for _ in range(40):
        base = rng.getrandbits(64)
        values |= {base} | {base ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (1, 2, 3, 4)}
    signed = [v - (v >> 63 << 64) for v in values]
    found = {frozenset((r.a, r.b)) for r in linked_fingerprints(spark.createDataFrame([(v,) for v in signed], "print long"), bits).collect()}
    assert found == {frozenset(p) for p in itertools.combinations(signed, 2) if ((p[0] ^ p[1]) % 2**64).bit_count() <= bits}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(50, 90)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(25)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_groups(docs_of):
    rows = [(3, "the same text here", "s"), (2, "The same TEXT here", "s"), (2, "The same TEXT here", "s"), (9, None, "s"), (8, "", "s"), (None, "  ", "s"), (None, "lonely words stand here", "s")]
    found = sorted(((r.doc_id, r.component_id) for r in simhash_groups(docs_of(rows)).collect()), key=str)
    assert found == sorted([(3, 2), (2, 2), (2, 2), (9, 8), (8, 8), (None, 8), (None, None)], key=str)
    assert simhash_groups(docs_of([])).collect() == []


def test_near_duplicates(docs_of, monkeypatch):
    monkeypatch.setattr(simhash, "WINDOW", 8)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "CARRIED", 4)
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=8)) for _ in range(4000)]
    base = rng.sample(words, 300)
    copies = [base[:k] + ["changed%d" % k] + base[k + 1 :] for k in range(0, 300, 8)]
    others = [rng.sample(words, 300) for _ in range(30)]
    texts = [" ".join(t) for t in [base, *copies, *others]] + [" ".join(base).upper(), None, "", "one two"]
    found = {r.doc_id: r.component_id for r in near_duplicates(docs_of(texts)).collect()}
    assert all(found[i] == 0 for i in range(len(copies) + 1)) and found[len(copies) + 31] == 0
    assert all(found[i] == i for i in range(len(copies) + 1, len(copies) + 31))
    assert found[len(texts) - 2] == len(texts) - 3 and found[len(texts) - 1] == len(texts) - 1
    assert near_duplicates(docs_of([])).collect() == []


def brute_groups(texts):
    """The least index reachable over pairs of 0.8 or more, by whole sets."""
    sets = []
    for t in texts:
        words = t.lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    group = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if group[a] != group[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = [new if g == old else g for g in group]
    return group


def test_tails_against_brute_force(docs_of):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(3000)]
    texts = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(100, 400))]
        n = len(base)
        texts += [base, base[: int(n * 0.83)], base[: int(n * 0.79)], base + [rng.choice(words) for _ in range(int(n * 0.22))]]
        texts += [base[int(n * 0.1) :] + [rng.choice(words) for _ in range(int(n * 0.1))]]
    texts = [" ".join(t) for t in texts]
    found = {r.doc_id: r.component_id for r in near_duplicates(docs_of(texts)).collect()}
    assert [found[i] for i in range(len(texts))] == brute_groups(texts)


def test_templated_pages_against_brute_force(docs_of):
    """Pages of the same long words that differ in numbers: all meet at common shingles, and only some are near copies."""
    rng = random.Random(11)
    fixed = ["heading%02d" % i for i in range(14)]
    texts = []
    for i in range(150):
        page = fixed + [str(rng.randint(0, 9999)) for _ in range(90)]
        texts.append(page)
        if i % 5 == 0:
            at = rng.randrange(30, 90)
            texts.append(page[:at] + [str(rng.randint(0, 9999))] + page[at + 1 :])
    texts = [" ".join(t) for t in texts]
    found = {r.doc_id: r.component_id for r in near_duplicates(docs_of(texts)).collect()}
    groups = brute_groups(texts)
    assert [found[i] for i in range(len(texts))] == groups and len(set(groups)) == 150


def test_a_large_group_of_copies_against_brute_force(docs_of):
    """1,500 copies of 200 words, three of them replaced in each: every pair's similarity counts, none is lost in the group."""
    rng = random.Random(9)
    base = ["word%d" % i for i in range(200)]
    texts = []
    for i in range(1500):
        own = list(base)
        for n, k in enumerate(rng.sample(range(200), 3)):
            own[k] = f"other{i}x{n}"
        texts.append(own)
    index: dict = {}
    sets = [sorted({index.setdefault(tuple(t[k : k + 5]), len(index)) for k in range(196)}) for t in texts]
    marks = np.zeros((len(texts), len(index)), np.float32)
    for row, own in zip(marks, sets):
        row[own] = 1
    shared = marks @ marks.T
    sizes = np.array(list(map(len, sets)))
    near = shared >= 0.8 * (sizes[:, None] + sizes[None, :] - shared) - 1e-6
    group = np.arange(len(texts))
    while True:
        least = np.where(near, group[None, :], len(texts)).min(1)
        if (least == group).all():
            break
        group = least
    found = {r.doc_id: r.component_id for r in near_duplicates(docs_of([" ".join(t) for t in texts])).collect()}
    assert [found[i] for i in range(len(texts))] == group.tolist() and near.sum() > 30_000
