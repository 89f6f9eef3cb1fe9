import math
import zlib
from collections import Counter

import numpy as np
import pytest

from anonspark.llm import lm
from anonspark.llm.eliasfano import EliasFano, Trie, quantise, restore


@pytest.mark.parametrize(("n", "top"), [(0, 10), (1, 1), (5, 3), (1000, 1000), (1000, 2**40), (3000, 2**63 - 2), (2000, 100)])
def test_elias_fano(n, top):
    r = np.random.default_rng(n)
    v = np.sort(r.integers(0, top + 1, n)).astype(np.uint64)
    e = EliasFano.of(v)
    assert (e.get(np.arange(n)) == v).all()
    q = np.concatenate([r.integers(0, min(top + 5, 2**63 - 2), 500).astype(np.uint64), v, np.array([0, 2**64 - 1], np.uint64)])
    assert (e.successor(q) == np.searchsorted(v, q, "left")).all()
    assert (e.find(v) == np.searchsorted(v, v, "left")).all()


def test_trie_round_trip():
    r = np.random.default_rng(5)
    v, w = r.integers(0, 2**24, 300).astype(np.uint64), r.integers(0, 2**24, 200).astype(np.uint64)
    pairs = np.unique((r.choice(v, 2000) << np.uint64(24)) | r.choice(w, 2000))
    triples = np.unique((r.integers(0, len(pairs), 5000).astype(np.uint64) << np.uint64(24)) | r.choice(w, 5000))
    parent, before, p2, p3 = (triples >> np.uint64(24)).astype(int), triples & np.uint64(2**24 - 1), r.random(len(pairs)), r.random(len(triples))
    trie = Trie.mapped(Trie.of(24, pairs, quantise(p2), parent, before, quantise(p3)).pack())
    every = np.unique(np.concatenate([pairs, (np.repeat(v, 20) << np.uint64(24)) | np.tile(w[:20], 300), np.array([0, 2**64 - 1], np.uint64)]))
    at = trie.find_pairs(every)
    assert (at == np.where(np.isin(every, pairs), np.searchsorted(pairs, every), -1)).all() and (trie.codes2 == quantise(p2)).all()
    places, words = np.repeat(np.arange(len(pairs)), 30), np.tile(w[:30], len(pairs))
    key = (places.astype(np.uint64) << np.uint64(24)) | words
    want = np.where(np.isin(key, triples), quantise(p3)[np.minimum(np.searchsorted(triples, key), len(triples) - 1)], 0)
    assert (trie.find(places, words) == want).all() and (trie.find(np.full(5, -1), w[:5]) == 0).all()
    none = Trie.of(32, *(np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, np.uint16)))
    none = Trie.mapped(none.pack())
    assert (none.find(none.find_pairs(pairs), np.zeros(len(pairs), np.uint64)) == 0).all()
    assert np.allclose(restore(quantise(p3)), p3, rtol=3e-4)


def brute(rows):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    words = [(i, [*(t or "").encode().lower().split(), b"\n"]) for i, t in rows]
    uni, bi, tri, contexts = Counter(), Counter(), Counter(), Counter()
    grams = lambda w: zip([b"\n", b"\n", *w[:-2]][: len(w)], [b"\n", *w[:-1]], w)
    for i, w in words:
        if not held(i):
            uni.update(w)
            tri.update(grams(w))
            bi.update((v, x) for _, v, x in grams(w))
            contexts.update((u, v) for u, v, _ in grams(w))
    n, v = sum(uni.values()), len(uni)
    g, out = lm.PRIOR, []
    for i, w in words:
        base = {x: (uni[x] + 1) / (n + v + 1) for x in w}
        p2 = lambda v, x: (bi[v, x] + g * base[x]) / (uni[v] + g)  # noqa: E731, B023
        score = sum(math.log10((tri[u, v, x] + g * p2(v, x)) / (contexts[u, v] + g)) for u, v, x in grams(w))
        out.append((i, held(i), len(w), sum(uni[x] > 0 for x in w), n, sum(math.log10(base[x]) for x in w), score))
    return out


def _same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=5e-4)


def test_scores_equal_counting(spark, sf, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 20_000)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = [tuple(r) for r in lm.score(docs, shard_text=60_000).collect()]  # several shards, several blocks
    _same(got, brute([tuple(r) for r in docs.collect()]))
    out = [r for r in got if r[1]]
    assert sum(r[6] for r in out) > sum(r[5] for r in out)  # better than single words on held-out text


def test_probabilities_sum_to_one():
    text = b"a b a c a b b a".split()
    uni, bi, tri = Counter(text), Counter(zip(text, text[1:])), Counter(zip(text, text[1:], text[2:]))
    n, v, g = len(text), len(uni), lm.PRIOR
    p1 = lambda w: (uni[w] + 1) / (n + v + 1)
    p2 = lambda v, w: (bi[v, w] + g * p1(w)) / (sum(c for (x, _), c in bi.items() if x == v) + g)
    p3 = lambda u, v, w: (tri[u, v, w] + g * p2(v, w)) / (sum(c for (x, y, _), c in tri.items() if (x, y) == (u, v)) + g)
    assert sum(p3(b"a", b"b", w) for w in [*uni, b"unknown"]) == pytest.approx(1.0)


def test_repeated_documents_stand_apart(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 60) % 5000) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate([*texts, *texts[:30]])]
    mean = {r["doc_id"]: r["score"] / r["n_tokens"] for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if not r["held_out"]}
    once = sorted(m for i, m in mean.items() if 30 <= i < 300)
    twice = [m for i, m in mean.items() if (i < 30 or i >= 300) and (i + 300 if i < 30 else i - 300) in mean]
    assert sum(m > once[int(0.9 * len(once))] for m in twice) > 0.9 * len(twice)


def test_odd_rows(odd, none, clashing):
    _same([tuple(r) for r in lm.score(odd).collect()], brute([(r["doc_id"], r["text"]) for r in odd.collect()]))
    assert lm.score(none).count() == 0
    assert lm.score(clashing).count() == clashing.count()


def test_model_table(spark, sf, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 20_000)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bits = lm.shard_bits(docs, 100_000)
    told = lm.counted(lm.encode(docs, bits))
    model = lm.tries(told, 1000, 100, bits).collect()
    assert bits > 1 and sum(r["shard"] is not None for r in model) > 1 and sum(r["block"] is not None for r in model) > 1
    assert sum(Trie.unpack(r["trie"]).before.n for r in model) > 1000
