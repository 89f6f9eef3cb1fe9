import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from anonspark.llm import simhash


def slow_print(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_roots(fp, radius=4):
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius
    root = np.arange(len(fp))
    while True:
        new = np.array([root[near[i]].min() for i in range(len(fp))])
        if (new == root).all():
            return root
        root = new


def test_fingerprints():
    texts = [None, "", "a", "A b", "a b c d", "a b  c\nd e", " ".join(str(i % 700) for i in range(1500)), "é É x y z"]
    got = simhash.fingerprints([simhash.shingle_hashes(t) for t in texts])
    assert [int(x) for x in got] == [slow_print(t) for t in texts]


@pytest.mark.parametrize("size", [3, 24, 25, 64, 65, 150])
@pytest.mark.parametrize("radius", [0, 1, 4, 6])
def test_groups_equal_pairwise_distances(size, radius):
    r = np.random.default_rng(size)
    base = r.integers(0, 2**63, 50).astype(np.uint64)
    fp = np.concatenate([base, base ^ np.uint64(0b1111), base[:20] ^ np.uint64(0b11111), base[:20] ^ (np.uint64(1) << np.uint64(63))])
    fp = fp[r.permutation(len(fp))]
    group = np.arange(len(fp)) // size
    want = np.concatenate([slow_roots(fp[group == g], radius) + np.flatnonzero(group == g)[0] for g in np.unique(group)])
    assert (simhash.link_groups(fp, group, radius) == want).all()


def _doc(rng, n=40):
    return [rng.choice("abcdefghijklmnop") * rng.randint(1, 6) + str(rng.randint(0, 50)) for _ in range(n)]


def test_classes_equal_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(25):
        w = _doc(rng, 300)
        texts.append(w)
        for _ in range(rng.randint(0, 3)):
            texts.append([*w[:-1], "changed"])
    rows = [(i + 1, " ".join(t)) for i, t in enumerate(texts)] + [(500, ""), (501, None), (502, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fp = np.array([slow_print(t) for _, t in rows], np.uint64)
    ids = np.array([i for i, _ in rows])
    roots = slow_roots(fp)
    least = {r: ids[roots == r].min() for r in np.unique(roots)}
    want = {i: (f"{int(f):016x}", int(least[r])) for i, f, r in zip(ids.tolist(), fp, roots)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    assert got == want
    kept = {r["doc_id"] for r in simhash.keep_one(df).collect()}
    assert kept == set(int(x) for x in least.values())


def test_large_buckets_are_dealt_as_chunk_pairs(spark):
    r = np.random.default_rng(0)
    fp = np.unique(np.concatenate([r.integers(0, 2**20, 300), r.integers(0, 2**62, 50)]).astype(np.int64))
    df = spark.createDataFrame([(int(x),) for x in fp], "fp long")
    from anonspark.llm.graph import components

    def roots(chunk):
        found = {x["node"]: x["root"] for x in components(simhash.links(df, len(fp), chunk=chunk)).collect()}
        return [found.get(int(x), int(x)) for x in fp]

    whole = slow_roots(fp.view(np.uint64))
    classes = Counter(zip(roots(16), whole))
    assert roots(16) == roots(4096) and len(classes) == len(set(whole.tolist()))


def test_odd_rows(odd, none, clashing):
    got = simhash.near_duplicates(odd)
    assert got.count() == odd.count()
    by = {r["doc_id"]: r["component_id"] for r in got.collect() if r["doc_id"] is not None}
    assert by[1] == by[2] == 1 and by[3] == by[4] == by[5] == 3
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0
    kept = simhash.keep_one(clashing)
    assert kept.columns == clashing.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 6, 7] and ids.count(None) == 3


def test_rows_that_repeat_an_id_with_another_text_stay(spark):
    rng = random.Random(9)
    copy, x, y = (" ".join(_doc(rng, 60)) for _ in range(3))
    docs = spark.createDataFrame([(1, copy), (5, x), (5, copy), (6, x), (7, y), (7, copy + " z"), (8, y), (7, y)], "doc_id long, text string")
    kept = sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect() if r["text"] in (copy, x, y))
    assert kept == sorted([(1, copy), (5, x), (7, y)])


def test_blocks_beyond_the_radius_are_given_up(monkeypatch):
    r = np.random.default_rng(2)
    fp = r.integers(0, 2**63, 4096).astype(np.uint64)
    fp[:100] = fp[100:200] ^ np.uint64(7)
    seen, more = [], simhash._more
    monkeypatch.setattr(simhash, "_more", lambda ones, *rest: seen.append(ones.size) or more(ones, *rest))
    root = simhash.link_groups(fp, np.zeros(4096, int))
    assert (root[100:200] == np.arange(100)).all() and (root != np.arange(4096)).sum() == 100
    assert sum(seen) < 4 * (64 * 64 * 65 // 2)  # nine looks at each of so many blocks, if none were given up


def test_columns_that_cannot_be_sorted(spark):
    df = spark.createDataFrame([(1, "a b c", {"k": 1}), (1, "a b c", {"k": 2}), (2, "a b c", None), (3, None, None)], "doc_id long, text string, extra map<string,int>")
    assert sorted((r["doc_id"], r["extra"]) for r in simhash.keep_one(df).collect()) == [(1, {"k": 1}), (3, None)]
