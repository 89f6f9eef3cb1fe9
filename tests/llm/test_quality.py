import random
import re
from collections import Counter

import numpy as np

from anonspark.llm import quality_gbt, quality_knn


def _held_out_accuracy(rows, labels, score, cut):
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = [(known[r["doc_id"]], r[score]) for r in rows if r["held_out"] and r["doc_id"] in known]
    return np.mean([(s >= cut) == (y == 1) for y, s in got]), len(got)


def test_neighbours_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = quality_knn.quality(docs, labels).collect()
    share, n = _held_out_accuracy(rows, labels, "score", 0.7)
    assert n > 500 and share > 0.98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_blocked_products_equal_plain_voting():
    r = np.random.default_rng(0)
    counts = quality_knn.term_counts(["".join(r.choice(list("ab c!\n"), 200)) for _ in range(700)])
    model = quality_knn.Model(np.ones(quality_knn.TERMS, np.float32), r.normal(size=(quality_knn.TERMS, 8)).astype(np.float32), np.zeros((0, 8), np.float32), (r.random(100) > 0.4).astype(float), np.ones(100))
    model.vectors = model.embed(counts[:100])
    got = model.score(counts)
    for i in range(0, 700, 37):
        cos = model.embed(counts[i : i + 1])[0] @ model.vectors.T
        near = np.argsort(-cos)[: quality_knn.NEIGHBOURS]
        vote = np.maximum(cos[near], 0).astype(float) ** 8
        assert abs(got[i] - (vote * model.labels[near]).sum() / vote.sum()) < 1e-4


def test_terms_and_embedding_equal_plain_counting():
    """The terms of a text, counted pair by pair."""
    def slow(text):
        raw, out = text.encode(), np.zeros(quality_knn.TERMS)
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
        for a, b in zip(low, low[1:]):
            out[((a << 8 | b) * 40503 & 0xFFFF) % 768] += 1
        kind = lambda b: int(quality_knn._CLASS[b])
        for a, b in zip(raw, raw[1:]):
            out[768 + 8 * kind(a) + kind(b)] += 1
        out[:768] = np.sqrt(out[:768] / len(raw))
        out[768:832] = 2 * np.sqrt(out[768:832] / len(raw))
        w = text.split()
        by = [sum(kind(b) == k for b in raw) / len(raw) for k in range(8)]
        same, again = sum(a == b for a, b in zip(w, w[1:])), len(w) - len(set(w))
        tail = by[7], by[2], by[3], same / (len(w) + 20), again / (len(w) + 20), min(1.0, len(raw) / max(1, len(w)) / 20), by[6], by[5]
        out[832:] = 3 * np.sqrt(tail)
        return out

    texts = ["One two two three, FOUR!\nfive # 6", "a", "é ä ö 12 12 12"]
    got = quality_knn.term_counts([*texts, "", None])
    assert np.allclose(got[:3], [slow(t) for t in texts], atol=1e-6) and not got[3:].any()


def test_ties_and_class_weights():
    vectors = np.array([[1, 0]] * 30 + [[0, 1]] * 3, np.float32)
    labels = np.array([1.0] * 20 + [0.0] * 10 + [0.0] * 3)
    weights = np.where(labels > 0, 2.0, 0.5)
    counts = np.zeros((1, quality_knn.TERMS), np.float32)
    counts[0, 0] = 1
    axes = np.zeros((quality_knn.TERMS, 2), np.float32)
    axes[0, 0] = 1
    model = quality_knn.Model(np.ones(quality_knn.TERMS, np.float32), axes, vectors, labels, weights)
    assert model.score(counts)[0] == 40 / 45  # all thirty that tie vote, not 25 of them


def test_weights_are_those_of_the_labelled_classes(spark):
    docs = spark.createDataFrame([(i, f"text {i} " + "ab " * (i % 7)) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)], "doc_id long, quality int")
    model = quality_knn.fit(docs, labels, per_class=30)
    n = {q: labels.filter(~quality_knn.held_out("doc_id", 4, 2)).filter(f"quality = {q}").count() for q in (0, 1)}
    assert len(model.labels) == 60
    assert np.isclose(model.weights[model.labels == 1].sum() / model.weights[model.labels == 0].sum(), n[1] / n[0])


def slow_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)]


def test_base_counts():
    rng = random.Random(4)
    texts = [None, "", "a", "\n\n", "a b c d e", "a b c d e a b c d e", "x\nx\n x\nx\x0b", "é é é é é é é\r\n", "  ", "€ # 𝄞\n€ # 𝄞"]
    texts += ["".join(rng.choice("ab \n#é") for _ in range(rng.randint(0, 200))) for _ in range(300)]
    got, _ = quality_gbt.statistics(texts)
    assert got.tolist() == [slow_counts(t) for t in texts]


def test_trees_fit_and_stay_monotone():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 3))
    y = (-x[:, 0] + x[:, 1] ** 2 + 0.3 * r.normal(size=2000) > 0.5).astype(float)
    forest = quality_gbt.train(x, y, [-1, 0, 0])
    assert ((forest.probability(x) > 0.5) == y).mean() > 0.9
    grid = np.repeat(r.normal(size=(50, 3)), 40, axis=0)
    grid[:, 0] = np.tile(np.linspace(-3, 3, 40), 50)
    assert (np.diff(forest.probability(grid).reshape(50, 40), axis=1) <= 1e-12).all()


def test_node_arrays_equal_a_walk_down_each_tree():
    r = np.random.default_rng(4)
    x = r.normal(size=(500, 3))
    forest = quality_gbt.train(x, (x[:, 0] * x[:, 1] > 0).astype(float), [0, 0, 0])

    def walk(row):
        margin = forest.bias
        for root in forest.roots:
            at = root
            while forest.left[at] != at:
                at = forest.left[at] if row[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
            margin += forest.value[at]
        return 1 / (1 + np.exp(-margin))

    some = np.concatenate([x[:60], np.array([[forest.threshold[0]] * 3])])
    assert np.allclose(forest.probability(some), [walk(row) for row in some])


def test_rules_on_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = {r["doc_id"]: r for r in quality_gbt.report(docs, labels).collect()}
    own = [(r["quality"], rows[r["doc_id"]]) for r in labels.collect()]
    free = [(q, r) for q, r in own if not r["base_failed"]]
    assert np.mean([(r["score"] >= 0.5) == (q == 1) for q, r in free]) > 0.98
    assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) for r in rows.values())


def test_odd_rows(odd, none, labels, clashing):
    for rows in (quality_knn.quality(odd, labels), quality_gbt.report(odd, labels)):
        assert rows.count() == odd.count()
    got = {r["doc_id"]: r for r in quality_knn.quality(odd, labels).collect()}
    assert got[4]["score"] == 0 and got[4]["predicted"] == 0
    assert {r["doc_id"]: r for r in quality_gbt.report(odd, labels).collect()}[3]["kept"] is False
    for f in (quality_knn.quality, quality_gbt.report):
        assert f(none, labels).count() == 0
        assert f(odd, labels.limit(0)).count() == odd.count()
    assert quality_knn.accepted(clashing, labels).columns == clashing.columns
    done = quality_gbt.judged(clashing, quality_gbt.fit(clashing, labels))
    assert done.count() == clashing.count() and len({c.lower() for c in done.columns}) == len(done.columns)
