import random

import numpy as np
import pytest

from anonspark.llm import partenum, queries


def slow_set(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow(rows):
    """(doc_id, size, least id reachable) by comparing all pairs."""
    sets = [slow_set(t) for _, t in rows]
    near = [[j for j, t in enumerate(sets) if i == j or s and t and 100 * len(s & t) >= 80 * len(s | t)] for i, s in enumerate(sets)]
    least = [(i is None, i) for i, _ in rows]
    while True:
        new = [min((least[j] for j in n), key=lambda x: (x[0], x[1] or 0)) for n in near]
        if new == least:
            return [(i, len(s), m[1]) for (i, _), s, m in zip(rows, sets, least)]
        least = new


def texts(rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    out = []
    for size in [*range(4, 16), 20, 60, 200, 400]:
        for _ in range(3):
            base = [word() for _ in range(size)]
            for _ in range(rng.randint(1, 5)):
                copy = list(base)
                for _ in range(rng.randint(0, max(1, size // 25))):
                    copy[rng.randrange(len(copy))] = word()
                if rng.random() < 0.3:
                    copy = copy[: max(1, len(copy) * rng.randint(80, 100) // 100)]
                out.append(" ".join(copy))
    base = [word() for _ in range(100)]
    for _ in range(60):  # a large group of which many pairs are less alike than 0.8
        copy = list(base)
        for _ in range(rng.randint(1, 4)):
            copy[rng.randrange(100)] = word()
        out.append(" ".join(copy))
    shared = [word() for _ in range(60)]
    for size in [10] * 40 + [60] * 20:  # a passage that many documents share
        out.append(" ".join([*shared, *(word() for _ in range(size))]))
    out += ["one", "One ", "ONE", "a a a a a", "a a a a a a a", "É x", "é x", "", None, " \n\x0b", "A\x1cb c d e f", "a\x1cB c d e f"]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("group, chunk, turns", [(8, 2048, 32), (3, 7, 1), (2, 1000, 0)])
def test_classes_equal_all_pairs(spark, monkeypatch, group, chunk, turns):
    monkeypatch.setattr(partenum, "GROUP", group)
    monkeypatch.setattr(partenum, "TURNS", turns)
    monkeypatch.setattr(partenum, "HELD", 5000)
    monkeypatch.setattr(partenum, "CENTER", 10)
    rows = list(enumerate(texts(random.Random(group)), 1))
    rows += [(None, "no id here"), (None, "no id here"), (None, rows[3][1]), (3, rows[2][1]), (3, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in partenum.classes(df, star_chunk=40, chunk=chunk).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=str) == sorted(slow(rows), key=str)


def test_linked_sets_share_a_signature():
    """Sets at the very bound, of all sizes, meet under a signature or have too many empty ones at the last hash."""
    rng = np.random.default_rng(4)
    for n in [*range(1, 60), 100, 101, 250, 999, 3000]:
        for _ in range(20):
            same = rng.integers(1, 2**63, n, np.uint64)
            apart = int(rng.integers(0, n // 4 + 1))  # |both| = n, |either| = n + apart <= n / 0.8
            cut = int(rng.integers(0, apart + 1))
            more = rng.integers(1, 2**63, apart, np.uint64)
            a, b = np.unique(np.append(same, more[:cut])), np.unique(np.append(same, more[cut:]))
            assert partenum.linked(a, b)
            one, other = (set(np.concatenate([s for s, _ in partenum.signatures(x)]).tolist()) for x in (a, b))
            assert one & other


def test_partitions():
    tops = partenum.bands().tolist()
    for band in range(1, 60):
        assert tops[band] * 5 // 4 <= tops[band + 1]  # linked sets are of neighbouring bands
        n1, n2, k2, spare = partenum.partition(band)
        k = tops[band] // 4
        assert spare == n1 - k // (k2 + 1) >= 1 and k2 < n2
        assert (k2 > 0) == (0 < k <= partenum.ENUMERATED)


def test_sketch_rules_out_nothing_linked():
    rng = np.random.default_rng(6)
    for n in (5, 40, 300, 20_000):
        same, more = rng.integers(1, 2**63, n, np.uint64), rng.integers(1, 2**63, n // 4, np.uint64)
        a, b = np.append(same, more), same
        assert partenum.may_link(partenum.sketch(b)[None], np.array([len(b)]), partenum.sketch(a), len(a))[0].size == 1
    other = rng.integers(1, 2**63, 300, np.uint64)
    assert not partenum.may_link(partenum.sketch(other)[None], np.array([300]), partenum.sketch(same[:300]), 300)[0].size


def test_odd_tables(spark, odd, none, clashing, sf):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = sorted(slow(rows), key=str)
    for docs in (odd, clashing):
        assert sorted((tuple(r) for r in partenum.classes(docs).collect()), key=str) == want
    assert partenum.classes(none).count() == 0
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op11_jaccard_join"](spark, sf).select("doc_id", "n_shingles", "component_id")
    assert sorted(tuple(r) for r in got.collect()) == sorted(slow(docs))
