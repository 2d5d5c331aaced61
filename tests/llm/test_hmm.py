import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from arbora.llm import hmm
from arbora.llm.hmm import Model, expected, likelihoods, maximised, score, started


def model_of(k=3, symbols=5, seed=0):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    return Model(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((symbols, k)), 0))


def brute_likelihood(text, m):
    total = 0.0
    for path in itertools.product(range(len(m.start)), repeat=len(text)):
        p = m.start[path[0]] * m.emissions[text[0], path[0]]
        for a, b, s in zip(path, path[1:], text[1:]):
            p *= m.moves[a, b] * m.emissions[s, b]
        total += p
    return math.log10(total)


def test_likelihood_is_exact():
    m = model_of()
    texts = [np.array(t, np.int32) for t in ([0], [1, 2], [4, 3, 2, 1, 0, 0], [2, 2, 2])]
    assert likelihoods(texts, m) == pytest.approx([brute_likelihood(t, m) for t in texts])
    assert sum(10 ** likelihoods([np.array(t, np.int32) for t in itertools.product(range(5), repeat=3)], m)) == pytest.approx(1.0)


def test_expected_counts():
    m = model_of(2, 3)
    text = np.array([0, 2, 1, 1], np.int32)
    starts, moves, emissions = expected([text, text[:2]], m)
    assert starts.sum() == pytest.approx(2) and moves.sum() == pytest.approx(4) and emissions.sum(1) == pytest.approx([2, 2, 2])


def test_training_raises_likelihood():
    rng = random.Random(0)
    texts = [np.array([rng.choice(p) for _ in range(40)], np.int32) for p in ([0, 1], [2, 3]) for _ in range(20)]
    prior = np.full(5, 0.2)
    m = started(texts, prior, 2, 0)
    before = likelihoods(texts, m).sum()
    for _ in range(5):
        m = maximised(*expected(texts, m), prior)
    assert likelihoods(texts, m).sum() > before


def test_cutting_groups_changes_nothing(monkeypatch):
    m, rng = model_of(), np.random.default_rng(1)
    texts = [rng.integers(0, 5, n).astype(np.int32) for n in (1, 30, 2, 500, 7, 7, 90)]
    whole = likelihoods(texts, m), expected(texts, m)
    monkeypatch.setattr(hmm, "CELL_TOKENS", 100)
    monkeypatch.setattr(hmm, "TOGETHER", 2)
    assert likelihoods(texts, m) == pytest.approx(whole[0])
    assert all(np.allclose(a, b) for a, b in zip(expected(texts, m), whole[1]))


TEXTS = ["The cat the dog", "le chat et le chien", None, "", "rare words stand here", "the the the", "A b c d e", "zzz unseen only"] * 2


@pytest.mark.parametrize("head", [1 << 17, 4])
def test_scores_against_brute_force(docs_of, head):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(3, "", "s"), (4, "rare words stand here", "s"), (4, "rare words stand here", "s")]
    found = score(docs_of(rows), head=head, classes=3, states=2).collect()
    assert len(found) == len(rows)
    own = lambda t: (t or "").lower().split() + ["\n"]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter(w for i, t, _ in rows if not held(i) for w in own(t))
    total, distinct = sum(counts.values()), len(counts)
    base = {i: sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own(t)) for i, t, _ in rows}
    for r in found:
        words = own(dict((i, t) for i, t, _ in rows)[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(words), sum(counts[w] > 0 for w in words), total, held(r.doc_id))
        assert r.base_score == pytest.approx(base[r.doc_id]) and r.score < 0


def test_head_does_not_change_scores(docs_of):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)]
    whole, cut = ({r.doc_id: r.score for r in score(docs_of(rows), head=h, classes=3, states=2).collect()} for h in (1 << 17, 4))
    assert whole == pytest.approx(cut)


def test_empty(docs_of):
    assert score(docs_of([])).collect() == []


def test_end_outside_of_the_head(docs_of):
    rows = [(i, "w x y z " * 3 + extra, "s") for i, extra in enumerate(("rare", "rare words", "none"))] * 2
    whole, cut = ({r.doc_id: (r.n_known, r.base_score, r.score) for r in score(docs_of(rows), head=h, classes=2, states=2).collect()} for h in (1 << 17, 4))
    assert all(whole[i] == pytest.approx(cut[i]) for i in whole) and len(cut) == 3


def test_corpus_rounds_raise_likelihood(docs_of):
    rng = random.Random(2)
    docs = docs_of([" ".join(rng.choice(p) for _ in range(30)) for p in ("abcd", "efgh", "aceg") for _ in range(20)])
    total = lambda **rounds: sum(r.score for r in score(docs, classes=9, states=3, **rounds).collect() if not r.held_out)
    assert hmm.CORPUS_ROUNDS >= 2 and total() == pytest.approx(total(rounds=hmm.CORPUS_ROUNDS)) and total() > total(rounds=0)
