import random

import pytest

from arbora.llm import mixing
from arbora.llm.mixing import mix


def brute_targets(words):
    order = sorted(s for s in words if s is not None) + [s for s in words if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(words.values()), set()
    while True:
        rest = total - sum(2 * words[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        goal = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_} | {s: 2.0 * words[s] for s in capped}
        over = {s for s in open_ if goal[s] > 2 * words[s]}
        if not over:
            return goal
        capped |= over


@pytest.mark.parametrize("block", [1, 7, 2048])
def test_against_brute_force(docs_of, block):
    rng = random.Random(block)
    rows = [(i, "w " * rng.randrange(60), rng.choice(["a", "b", "B", "ß", None, "big", "big", "big"])) for i in range(400)] + [(400, "w " * 5000, "big"), (401, None, "a"), (402, "", "empty"), (5, "twice x", "a"), (5, "twice x", "a")]
    found = mix(docs_of(rows), block).collect()
    assert len(found) == len(rows)
    words = {}
    for r in found:
        words[r.source] = words.get(r.source, 0) + r["size"]
        assert 0 <= r.taken <= 2 * r["size"]
    goal = brute_targets(words)
    for s in words:
        mine = [r for r in found if r.source == s]
        assert mine[0].target == pytest.approx(goal[s]) and mine[0].source_size == words[s]
        assert abs(sum(r.taken for r in mine) - goal[s]) <= 1
    again = mix(docs_of(rows).repartition(3), block).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_empty(docs_of):
    assert mix(docs_of([])).collect() == []
    assert [r.taken for r in mix(docs_of([None, " \t"])).collect()] == [0, 0]


def test_the_schedule_decides(docs_of, monkeypatch):
    rng = random.Random(3)
    rows = [(i, f"t{i} " * (1 + rng.randrange(40)), "abc"[i % 3]) for i in range(300)]
    taken = lambda: {r.doc_id: (r.taken, r.first_slot) for r in mix(docs_of(rows), 50).collect()}
    golden = taken()
    monkeypatch.setattr(mixing, "GOLDEN", 0.1234)
    other = taken()
    assert sum(golden[i][0] != other[i][0] for i in golden) > 30
    assert sum(t for t, _ in golden.values()) == sum(t for t, _ in other.values())
    assert all((t == 0) == (slot is None) for t, slot in golden.values())


def test_every_stretch_holds_the_sources_in_proportion(docs_of):
    rows = [(i, "w " * 20, "abcd"[i % 4]) for i in range(400)]
    found = [r for r in mix(docs_of(rows), 20).collect() if r.first_slot is not None]
    goal = {r.source: r.target for r in found}
    early = [r.source for r in found if r.first_slot <= 100]
    for s in goal:
        assert abs(early.count(s) / len(early) - goal[s] / sum(goal.values())) < 0.1


def test_documents_repeat_only_where_a_source_is_used_up(docs_of):
    rows = [(i, "w " * 30, "a" if i % 10 else "b") for i in range(300)]
    for r in mix(docs_of(rows), 30).collect():
        assert r.taken <= r["size"] or r.target > r.source_size
