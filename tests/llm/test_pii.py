import hashlib
import random
import re

import numpy as np
import pytest

from anonspark.llm import pii


def slow(t):
    d = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d(m[0])) <= 19 and pii.luhn(d(m[0]))]
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(d(m[0])) <= 15]
    return out


def test_base_spans():
    rng = random.Random(2)
    for alphabet in ("ab.@@-+1 2é(%", "0123456789 -.", "+12 ()5.-"):
        for _ in range(4000):
            s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
            assert pii.base_spans(s) == slow(s), s
    assert pii.base_spans("a" * 300_000 + "@") == []


def test_gradients():
    t = pii.Tagger(1)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    r = np.random.default_rng(0)
    x, y = r.integers(0, 131, (3, pii.LENGTH)), np.zeros((3, pii.LENGTH), int)
    y[0, 3:6], y[1, 0:2] = [1, 2, 2], [3, 4]
    _, g = t.gradients(x, y)
    for k, p in t.p.items():
        i = np.unravel_index(np.argmax(np.abs(g[k])), p.shape)
        old, up = p[i], []
        for step in (1e-3, -1e-3):
            p[i] = old + step
            up.append(t.gradients(x, y)[0])
        p[i] = old
        assert g[k][i] == pytest.approx((up[0] - up[1]) / 2e-3, rel=2e-3), k


def test_windows_cover_every_anchor():
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice("abc 1@" if rng.random() < 0.2 else "abc ") for _ in range(rng.randint(0, 400)))
        spots = pii.windows(t)
        for i, c in enumerate(t):
            if c in "1@":
                assert any(a <= i < b for a, b, _ in spots)
        assert all(0 <= a < b <= len(t) and b - a <= pii.LENGTH for a, b, _ in spots)


def test_decoding_is_the_best_path():
    t, r = pii.Tagger(3), np.random.default_rng(1)
    x = r.integers(0, 131, (2, pii.LENGTH))
    em, _ = t.emissions(x)
    move, first = t.p["move"] + t.wrong, t.p["first"] + t.wrong_first
    value = lambda w, y: first[y[0]] + sum(em[i, w, y[i]] for i in range(pii.LENGTH)) + sum(move[a, b] for a, b in zip(y, y[1:]))
    for w, best in enumerate(t.decode(x)):
        top = value(w, best)
        for _ in range(300):
            other = best.copy()
            other[r.integers(0, pii.LENGTH)] = r.integers(0, 9)
            assert value(w, other) <= top + 1e-3


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id % 2 = 0"))


def test_tagger_on_held_out_documents(spark, tagger):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id % 2 = 1").select("text").collect()]
    hit = miss = wrong = 0
    for t in texts:
        spots = pii.windows(t)
        if spots:
            got = set(pii.reconcile(t, spots, tagger.decode(pii.encode([t[a:b] for a, b, _ in spots]))))
            want = set(pii.base_spans(t))
            hit, miss, wrong = hit + len(got & want), miss + len(want - got), wrong + len(got - want)
    assert hit / (hit + miss) > 0.75 and hit / (hit + wrong) > 0.75  # by itself; base spans come on top
    base, every = pii.all_spans(texts, tagger)
    assert sum(len(e) - len(b) for b, e in zip(base, every)) <= 0.05 * sum(map(len, base))
    assert all(set(b) <= set(e) for b, e in zip(base, every))


def test_tagger_finds_what_no_pattern_names(tagger):
    assert pii.all_spans(["please call (555) 123-4567 today"], tagger)[1][0] == [(3, 12, 26)] or pii.all_spans(["it is (555) 555-4567 then"], tagger)[1][0]
    assert pii.all_spans(["the year 2024 and 12 items of 4.0.1"], tagger)[1][0] == []


def test_other_forms_in_held_out_documents(spark, tagger):
    """Values that no pattern reads: the recall of what the tagger adds, and its silence elsewhere."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id % 10 = 1 AND text IS NOT NULL").select("text").collect()]
    found = asked = 0
    for t in texts:
        for kind, a, b in pii.base_spans(t)[:1]:
            for form in pii.forms(kind, t[a:b]):
                asked += 1
                found += (kind, a, a + len(form)) in pii.all_spans([t[:a] + form + t[b:]], tagger)[1][0]
    assert asked > 100 and found / asked >= 0.9, (found, asked)
    clean = [t for t in texts if not pii.base_spans(t)]
    added = sum(bool(e) for e in pii.all_spans(clean, tagger)[1])
    assert len(clean) > 500 and added <= 0.005 * len(clean), (added, len(clean))


def test_windows_in_other_forms():
    piece = "mail a.b@c.example.org or +1 (222) 555-0199 now"
    (text, tags), = pii.labelled(piece)[:1]
    more = pii.rewritten(text, tags)
    assert any("[at]" in t for t, _ in more) and any("222-555-0199" in t for t, _ in more)
    for t, m in more:
        assert len(t) == len(m) <= pii.LENGTH and any(m)


def test_long_texts_and_clashing_columns(spark, tagger):
    rows = spark.createDataFrame([(1, "x" * 200_000 + " mail a@b.org " + "y " * 50_000, "z", "z")], "doc_id long, text string, base_spans string, pii_spans string")
    done = pii.find(rows, tagger)
    assert len(set(done.columns)) == len(done.columns) == 6
    assert [(s["kind"], s["start"]) for s in done.first()["base_spans_"]] == [(0, 200_006)]


def test_odd_rows(odd, none, spark):
    rows = odd.unionByName(spark.createDataFrame([(9, "mail a.b@c.org, +1 (222) 555-0199; 10.0.0.1 é", None, None, None)], odd.schema))
    got = pii.report(rows).collect()
    assert len(got) == rows.count()
    nine = next(r for r in got if r["doc_id"] == 9)
    want = "email:5:14,ip:35:43,phone:16:33"
    assert nine["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and nine["n_email"] == nine["n_ip"] == nine["n_phone"] == 1
    assert nine["spans"].startswith("email:5:14")
    assert next(r for r in got if r["doc_id"] == 3)["spans"] == ""
    assert pii.report(none).count() == 0
