from collections import Counter

import numpy as np
import pytest

from arbora.llm import line_dedup
from arbora.llm.line_dedup import PerfectHash, Shard, build_shard, dedup_lines


def brute(texts, least):
    keys = [[x.strip(" \t\n\x0b\x0c\r") for x in "".join(c.lower() if c.isascii() else c for c in t or "").split("\n")] for t in texts]
    seen = Counter(k for ks in keys for k in set(ks))
    out = []
    for text, ks in zip(texts, keys):
        lines = (text or "").split("\n")
        keep = [x for x, k in zip(lines, ks) if not (k and seen[k] >= least)]
        out.append((len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out)


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**64, 5000, dtype=np.uint64))
    slots = PerfectHash.build(keys).slots(keys)
    assert sorted(slots) == list(range(len(keys)))
    assert PerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1] * 3


def test_shard_tells_strangers_and_equal_addresses():
    keys, prints, counts = np.array([5, 5, -7]), np.array([1, 2, 3], np.int32), np.array([4, 9, 100_000])
    shard = Shard(build_shard(keys, prints, counts))
    assert shard.counted(np.array([5, 5, -7, -7, 6]), np.array([1, 2, 3, 4, 1], np.int32)).tolist() == [4, 9, 65535, 0, 0]


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(docs_of, monkeypatch, small):
    if small:
        monkeypatch.setattr(line_dedup, "SHARD_KEYS", 4)
        monkeypatch.setattr(line_dedup, "SALT_ROWS", 3)
    texts = ["Shared line\n  own %d\n\nÉtoile" % i for i in range(6)] + ["SHARED LINE \t\nshared line\nx", None, "", "étoile", "a\r\nb", "\n\n", "long " * 5000, "a\nb"]
    found = dedup_lines(docs_of(texts), 3).collect()
    assert sorted((r.n_lines, r.n_dropped, r.text) for r in found) == brute(texts, 3)


def test_repeated_rows_empty_tables_and_clashing_names(docs_of, spark):
    rows = [(None, "same\nown", "s")] * 4 + [(7, "same", None)]
    found = dedup_lines(docs_of(rows).selectExpr("*", "1 AS n_lines", "2 AS row", "3 AS key"), 5).collect()
    assert sorted((r.n_dropped, r.text, r.row) for r in found) == [(1, "", 2)] + [(1, "own", 2)] * 4
    assert dedup_lines(docs_of([]), 2).collect() == []
