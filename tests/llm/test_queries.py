"""Every opN query over the smallest tables: the columns that their contracts fix, by plain Python and by SQL in DuckDB."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest
import xxhash

from arbora.llm import queries
from arbora.llm.mixing import GOLDEN

DATA = os.environ.get("ARBORA_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
ALL = queries.queries()
SPACES = " \t\n\x0b\x0c\r"


def rows_of(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))


def bucket(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r for r in rows_of("documents")}


def found(spark, name):
    return ALL[name](spark, DATA).collect()


def by_id(spark, name, docs):
    rows = found(spark, name)
    assert len(rows) == len(docs)
    return {r.doc_id: r for r in rows}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    told = con.sql(queries.oracle_sql()[name])
    rows = found(spark, name)
    assert sorted(tuple(r[c] for c in told.columns) for r in rows) == sorted(told.fetchall())


def test_toxicity(spark, docs):
    rows = by_id(spark, "op1_toxicity", docs)
    for i, r in rows.items():
        assert r.held_out == (bucket(i, 4) == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    texts = {}
    for i, r in docs.items():
        texts.setdefault(r["text"], set()).add(rows[i].score)
    assert all(len(scores) == 1 for scores in texts.values())


def test_quality(spark, docs):
    """Evidence apart, posteriors and scores follow from it by plain arithmetic; held-out labels are met."""
    rows = by_id(spark, "op2_quality", docs)
    sites = {}
    for i, r in rows.items():
        own = sites.setdefault((docs[i]["source"], docs[i]["lang"]), [0.0, 0])
        own[0] += r.evidence
        own[1] += 1
    total = [sum(s[k] for s in sites.values()) for k in (0, 1)]
    overall = (total[0] + 0.5) / (total[1] + 1.0)

    def strength(groups):
        many = [(m, g / n, n) for m, g, n in groups if n > 1]
        spread = sum((m - w) ** 2 for m, w, _ in many) / len(many) - sum(m * (1 - m) / n for m, _, n in many) / len(many)
        mean = sum(m for m, _, _ in many) / len(many)
        return 1000.0 if spread <= 0 else min(1000.0, max(1.0, mean * (1 - mean) / spread - 1))

    hosts = {}
    for (host, _), (g, n) in sites.items():
        own = hosts.setdefault(host, [0.0, 0])
        own[0] += g
        own[1] += n
    s = strength([(overall, g, n) for g, n in hosts.values()])
    hosts = {h: (s * overall + g) / (s + n) for h, (g, n) in hosts.items()}
    s = strength([(hosts[h], g, n) for (h, _), (g, n) in sites.items()])
    odds = lambda p: math.log(p / (1 - p))
    for i, r in rows.items():
        host = hosts[docs[i]["source"]]
        g, n = sites[docs[i]["source"], docs[i]["lang"]]
        path = (s * host + g) / (s + n)
        assert r.host_posterior == pytest.approx(host) and r.path_posterior == pytest.approx(path)
        assert r.score == pytest.approx(1 / (1 + math.exp(-(odds(r.evidence) + odds(path) - odds(overall))))) and r.keep == (r.score >= 0.5)
    held = [(rows[x["doc_id"]].keep, x["quality"]) for x in rows_of("labels") if bucket(x["doc_id"], 4) == 2 and x["quality"] is not None and x["doc_id"] in rows]
    assert sum(k == bool(q) for k, q in held) >= 0.8 * len(held)


def test_urls(spark):
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    pages = {r["page_id"]: r["url"] for r in rows_of("pages")}
    rows = found(spark, "op3_url_filter")
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        url = pages[r.page_id]
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = lower(host)
        fits = [t for t in rules if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith("/" + t.split("/", 1)[1])]
        best = max(fits, key=len, default=None)
        assert (r.host, r.path, r.rule) == (host, path, best)
        assert r.verdict == (rules[best] if best else "block" if r.mined_rule else "allow")


def test_secrets(spark, docs):
    kinds = (("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16))
    for i, r in by_id(spark, "op5_secrets", docs).items():
        text = docs[i]["text"] or ""
        own = [(m.start(), n, k, m.end()) for n, (k, p, g, least) in enumerate(kinds) for m in re.finditer(p, text) if len(m[g]) >= least]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[2] == k for x in own) for k, *_ in kinds)
        shown = [f"{k}:{a}:{z}" for a, _, k, z in sorted(own)]
        assert r.base_sha256 == sha(",".join(shown))
        spans = r.spans.split(",") if r.spans else []
        assert [x for x in spans if not x.startswith("random:")] == shown and len(spans) - len(shown) == r.n_random
        starts = [int(x.split(":")[1]) for x in spans]
        assert starts == sorted(starts)


def test_language_model(spark, docs):
    training = [words(r["text"]) + ["\n"] for i, r in docs.items() if bucket(i, 10) != 0]
    counts = Counter(t for text in training for t in text)
    total, distinct = sum(counts.values()), len(counts)
    rows = by_id(spark, "op6_hmm_score", docs)
    for i, r in rows.items():
        own = words(docs[i]["text"]) + ["\n"]
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (bucket(i, 10) == 0, len(own), sum(counts[t] > 0 for t in own), total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_fingerprints(spark, docs):
    def fingerprint(text):
        own = words(text)
        grams = [" ".join(own[i : i + 3]) for i in range(len(own) - 2)] or ([" ".join(own)] if own else [])
        hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {i: fingerprint(r["text"]) for i, r in docs.items()}
    parent = {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(docs)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    for i, r in by_id(spark, "op8_simhash", docs).items():
        assert (r.fingerprint, r.component_id) == (f"{prints[i]:016x}", root(i))


def test_mix(spark, docs):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for i, r in docs.items()}
    of_source = Counter()
    for i, r in docs.items():
        of_source[r["source"]] += size[i]
    order = sorted(s for s in of_source if s is not None) + [s for s in of_source if s is None]
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(order)}
    stopped = set()
    while True:
        rest = 1.5 * sum(of_source.values()) - sum(2 * of_source[s] for s in stopped)
        goal = {s: 2.0 * of_source[s] if s in stopped else rest * weight[s] / sum(weight[o] for o in order if o not in stopped) for s in order}
        over = {s for s in order if goal[s] > 2 * of_source[s]}
        if not over:
            break
        stopped |= over
    rows = by_id(spark, "op9_mixing", docs)
    taken = Counter()
    for i, r in rows.items():
        source = docs[i]["source"]
        assert (r["size"], r.source_size) == (size[i], of_source[source]) and r.target == pytest.approx(goal[source]) and 0 <= r.taken <= 2 * r["size"]
        taken[source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 1 for s in order) and 0 < GOLDEN < 1


def test_media(spark, docs):
    for i, r in by_id(spark, "op10_tiff_media", docs).items():
        text = (docs[i]["text"] or "").encode()
        payload = text + b" " * (-len(text) % 192 if text else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), sha(payload), zlib.crc32(payload[-16:]))
        ranges = Counter(b >> 5 for b in payload)
        pages = -(-len(payload) // 192 // 4096)
        assert r.feature == f"pages={pages};rows={len(payload) // 192};min={min(payload)};max={max(payload)};sum={sum(payload)};ranges={','.join(str(ranges[k]) for k in range(8))}"
        assert r.media_bytes > 0 and len(r.media_sha256) == 64
