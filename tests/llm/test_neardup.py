import random

import numpy as np
import pandas as pd

import corpus_pipeline
from anonspark.llm import graph, neardup, simhash


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_least(rows):
    """The least id that chains of pairs at 0.8 or more connect with each row."""
    sets = [shingles(t or "") for _, t in rows]
    least = [i for i, _ in rows]
    near = [[j for j, t in enumerate(sets) if s == t or 5 * len(s & t) >= 4 * len(s | t)] for s in sets]
    while True:
        new = [min(least[j] for j in n) for n in near]
        if new == least:
            return new
        least = new


def _rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    texts = []
    for size in (6, 20, 60, 200, 400):
        for _ in range(6):
            base = [word() for _ in range(size)]
            for _ in range(rng.randint(1, 5)):
                copy = list(base)
                for _ in range(rng.randint(0, max(1, size // 25))):
                    copy[rng.randrange(size)] = word()
                texts.append(" ".join(copy))
    base = [word() for _ in range(100)]
    for _ in range(60):  # a large group of which many pairs are less alike than 0.8
        copy = list(base)
        for _ in range(rng.randint(1, 4)):
            copy[rng.randrange(100)] = word()
        texts.append(" ".join(copy))
    texts += ["one", "One ", "a a a a a", "a a a a a a a", "", None, " \n"]
    rng.shuffle(texts)
    return list(enumerate(texts, 1))


def test_stage_equals_brute_force(spark, sf):
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow_least(rows)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, df, sf).collect())
    assert kept == sorted(set(want)) and len(kept) < 120
    ids = {}
    for r in neardup.linked(df, star_chunk=16, chunk=10).collect():  # large buckets in chunks
        ids.setdefault(r["root"], []).append(r["doc_id"])
    assert sorted(min(x) for x in ids.values()) == sorted(set(want))


def test_rows_of_one_id_are_told_apart(spark):
    docs = spark.createDataFrame([(1, "copy"), (5, "x"), (5, "copy"), (None, "y"), (None, "y"), (None, "copy"), (6, "z"), (6, "w")], "doc_id long, text string")
    kept = sorted((str(r["doc_id"]), r["text"]) for r in neardup.keep_one(docs).collect())
    assert kept == [("1", "copy"), ("5", "x"), ("6", "w"), ("6", "z"), ("None", "y")]


def test_sketches_are_compared_as_bit_planes():
    """Small groups, stars and pairs across roots are those of a comparison byte by byte."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (6, neardup.MINIMA), np.uint8)
    sketch = base[rng.integers(0, 6, 300)]
    sketch = np.where(rng.random(sketch.shape) < rng.uniform(0.1, 0.4, (300, 1)), rng.integers(0, 256, sketch.shape, np.uint8), sketch)
    agree = np.count_nonzero(sketch[:, None] == sketch[None], axis=2)
    group = np.repeat(np.arange(100), rng.integers(1, 6, 100))[:300]
    group = np.concatenate([group, np.full(300 - len(group), 99)]) if len(group) < 300 else group
    few = np.isin(group, np.flatnonzero(np.bincount(group) <= neardup.PAIRED))
    i, j = neardup.paired(sketch[few], group[few])
    rows = np.flatnonzero(few)
    want = {(a, b) for a in rows for b in rows if a < b and group[a] == group[b] and agree[a, b] >= neardup.AGREE}
    assert set(zip(rows[i], rows[j])) == want and want
    seen = np.zeros(300, int)
    for center, near in neardup.stars(sketch):
        assert set(near) == set(np.flatnonzero((agree[center] >= neardup.AGREE) & (seen == 0))) - {center}
        seen[[center, *near]] += 1
    assert seen.max() == 1 and (seen == 0).sum() <= 1
    fine = rng.integers(0, 256, (2, neardup.FINE), np.uint8)[rng.integers(0, 2, 300)]
    fine = np.where(rng.random(fine.shape) < rng.uniform(0.05, 0.2, (300, 1)), rng.integers(0, 256, fine.shape, np.uint8), fine)
    root, bands = rng.integers(0, 3, 300), rng.integers(0, 20, (300, 32))
    pdf = pd.DataFrame({"key": 1, "band": 2, "node": np.arange(300), "root": root, "bands": list(bands), "sketch": [x.tobytes() for x in sketch], "fine": [x.tobytes() for x in fine]})
    close = np.count_nonzero(fine[:, None] == fine[None], axis=2)
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if root[a] != root[b] and agree[a, b] >= neardup.AGREE
            and close[a, b] >= neardup.FINE_AGREE and not (bands[a, :2] == bands[b, :2]).any()}
    found = [(a, b) for i, j in neardup._across(pdf, np.array([0, 300])) for a, b in zip(i, j)]
    assert set(found) == want and len(found) == len(want) > 0


def test_components_end_without_a_round_that_changes_nothing(spark, monkeypatch):
    """More edges are joined to known roots as if all had come at once."""
    written = []
    monkeypatch.setattr(graph, "saved", lambda df, name, real=graph.saved: written.append(name) or real(df, name))
    edges = lambda rows: spark.createDataFrame(rows, "a long, b long")
    got = lambda df: sorted((r["node"], r["root"]) for r in df.collect())
    roots = graph.components(edges([(3, 2), (2, 1), (2, 1), (6, 5), (9, 8)]))
    assert got(roots) == [(2, 1), (3, 1), (6, 5), (9, 8)]
    assert len(written) == 5  # the edges, and one round
    more = [(6, 3), (9, 9), (5, 2), (20, 10), (9, 7), (4, 4)]
    want = [(2, 1), (3, 1), (5, 1), (6, 1), (8, 7), (9, 7), (20, 10)]
    assert got(graph.joined(roots, edges(more))) == want
    assert got(graph.joined(graph.components(edges([])), edges([]))) == []


def test_blocks_without_a_lane_cost_no_planes(monkeypatch):
    """Where no lane counts, no plane is read; small buckets are compared in few passes."""
    none = np.full(3, 0xFFFFFFFFFFFFFFFF, np.uint64)
    assert not simhash.within(None, np.arange(3), None, np.arange(3), none, 56, 8, ()).any()
    passes = []
    monkeypatch.setattr(neardup, "alike", lambda *a, real=neardup.alike: passes.append(1) or real(*a))
    sketch = np.random.default_rng(1).integers(0, 256, (200, neardup.MINIMA), np.uint8)
    i, j = neardup.paired(np.repeat(sketch, 10, axis=0)[:200], np.repeat(np.arange(10), 20))
    assert len(passes) == 1 and len(i) == 10 * 2 * 45
