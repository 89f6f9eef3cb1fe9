import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from anonspark.llm import queries, runs


def slow_runs(words, least=24, exponent=3):
    """Every lag at every place; a stretch counts with its smallest lag."""
    n, out = len(words), set()
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, exponent * q) and not any((i, size, p) in out for p in range(1, q)):
                out.add((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def slow_words(key, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(key.encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def slow_row(doc_id, text):
    words = slow_words("" if doc_id is None else str(doc_id), text)
    found = slow_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id, len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def mixed(rng, size):
    out, k = [], rng.choice([1, 2, 3, 5, 30])
    while len(out) < size:
        kind = rng.random()
        if kind < 0.4:
            out += [rng.randrange(k) for _ in range(rng.randrange(1, 20))]
        elif kind < 0.8:
            unit = [rng.randrange(k) for _ in range(rng.choice([1, 2, 3, 8, 30, 70, 130]))]
            out += unit * rng.randrange(1, 6) + unit[: rng.randrange(len(unit))]
        else:
            out.append(1000 + rng.randrange(5))
    return out


@pytest.mark.parametrize("short", [2, 8, 64])
def test_runs_equal_every_lag(monkeypatch, short):
    monkeypatch.setattr(runs, "SHORT_LAGS", short)
    rng = random.Random(short)
    for _ in range(150):
        words = mixed(rng, rng.choice([10, 60, 200, 600]))
        assert [tuple(r) for r in runs.find_runs(np.array(words, np.int32)).tolist()] == slow_runs(words)


def test_rare_words_split_to_stability():
    words = [1, 2] * 20 + [7] + [3, 4, 5] * 9 + [8, 8] + [6] * 23 + [9, 1, 2]
    assert runs.segments(np.array(words, np.int32)) == [(0, 40), (41, 68)]  # 8 and 9 are rare, then 6 is too short a piece


def test_long_texts_are_searched_whole():
    rng = np.random.default_rng(3)
    unit = rng.integers(0, 400, 90_000)
    words = np.concatenate([rng.integers(0, 400, 5000), unit, unit, unit, unit[:777], [999], np.zeros(70_000, int)]).astype(np.int32)
    found = runs.find_runs(words).tolist()
    assert [5000, 270_777, 90_000] in found and [275_778, 70_000, 1] in found


def test_query_equals_brute_force(spark, odd):
    rng = random.Random(8)
    rows = [(i, " ".join(f"W{w}" for w in mixed(rng, rng.choice([5, 40, 300])))) for i in range(60)]
    rows += [(100 + i, "same words " * i) for i in range(30)] + [(3, "a\x0bb\x0cc d " * 9), (3, "a\x0bb\x0cc d " * 9), (None, "x " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in runs.report(df).collect()]
    assert sorted(got, key=str) == sorted((slow_row(*r) for r in rows), key=str)
    got = {r["doc_id"]: r for r in runs.report(odd).collect() if r["doc_id"] in (3, 4, 5, 7)}
    assert all(r["n_runs"] == 0 and r["start"] is None and r["runs_sha256"] == hashlib.sha256(b"").hexdigest() for r in got.values())


def test_text_keeps_one_period(spark):
    df = spark.createDataFrame([(1, "so " + "the quick fox " * 10 + "runs"), (2, "nothing here")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in runs.collapsed(df).collect()}
    assert got[1]["text"] == "so the quick fox runs" and [tuple(r) for r in got[1]["runs"]] == [(1, 30, 3)]
    assert got[2]["text"] == "nothing here" and got[2]["runs"] == []


def test_odd_tables(spark, odd, none, clashing, sf):
    want = sorted(map(str, runs.report(odd).collect()))
    assert len(want) == odd.count() and sorted(map(str, runs.report(clashing).collect())) == want
    assert runs.report(none).count() == 0
    assert queries.QUERIES["op12_periodic_runs"](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
