import math

import pytest

from anonspark.llm import mixing


@pytest.fixture(scope="module")
def skewed(spark):
    rows, i = [], 0
    for source, n in (("big", 900), ("mid", 250), ("tiny", 60), (None, 40)):
        for _ in range(n):
            rows.append((i, "w " * (5 + i % 9), source))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def entropy(shares, a):
    z = sum(s**a for s in shares)
    return -sum(s**a / z * math.log(s**a / z) for s in shares)


def test_exponent_meets_the_target(skewed):
    totals = mixing.source_tokens(skewed)
    t = [r["tokens"] for r in totals.collect()]
    shares = [x / sum(t) for x in t]
    a = mixing.exponent(totals, 0.8, 100.0)
    assert entropy(shares, a) == pytest.approx(0.8 * math.log(4), abs=1e-6)
    b = mixing.exponent(totals, 0.999, 2.0)  # the limit on repeats binds
    assert (max(t) / min(t)) ** (1 - b) == pytest.approx(2.0, rel=1e-6)
    assert mixing.exponent(totals, 0.1, 100.0) == 1.0


def test_mixture_has_the_weights_and_every_row(skewed, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 50)
    done = mixing.mixed(skewed, target_entropy=0.9, max_repeats=50.0)
    mix = {r["source"]: r for r in mixing.plan_blocks(skewed, target_entropy=0.9, max_repeats=50.0)[0].collect()}
    rows = [(r["doc_id"], r["source"], len(r["text"].split()), r["epoch"], r["block"], r["position"]) for r in done.collect()]
    assert {r[0] for r in rows} == {r["doc_id"] for r in skewed.collect()}
    assert len({(r[0], r[3]) for r in rows}) == len(rows)
    total = {s: sum(r[2] for r in rows if r[1] == s) for s in mix}
    for s, m in mix.items():
        assert abs(total[s] - m["repeats"] * m["tokens"]) <= 300, s
        assert total[s] / sum(total.values()) == pytest.approx(m["weight"], abs=0.03)
    for cut in (0.3, 0.7):  # at any point of the order the sources stand near their weights
        part = [r for r in rows if r[5] < cut]
        n = sum(r[2] for r in part)
        for s, m in mix.items():
            assert sum(r[2] for r in part if r[1] == s) / n == pytest.approx(m["weight"], abs=0.08)


def test_epochs_are_different_permutations(skewed, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 20)
    rows = mixing.plan_blocks(skewed, target_entropy=0.99, max_repeats=50.0)[1].filter("source = 'tiny'").collect()
    orders = {}
    for r in sorted(rows, key=lambda r: r["position"]):
        orders.setdefault(r["epoch"], []).append(r["block"])
    assert len(orders) > 2 and orders[1] != orders[2] and sorted(orders[1]) == sorted(orders[2])


def test_main_path_has_no_python(skewed):
    plan = mixing.mixture(skewed)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_odd_rows(odd, none, clashing):
    assert {r["doc_id"] for r in mixing.mixture(odd).collect()} == {r["doc_id"] for r in odd.collect()}
    assert mixing.mixture(none).count() == 0
    done = mixing.mixed(clashing, marks=False)
    assert done.columns == clashing.columns and done.count() >= clashing.count()
    marked = mixing.mixed(clashing)
    assert len({c.lower() for c in marked.columns}) == len(marked.columns)
