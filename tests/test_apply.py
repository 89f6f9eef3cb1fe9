import random
import re
import timeit

import pytest
from pyspark.sql import functions as F

from anonspark.operators import apply as A

ATOMS = ["acme", "acme corp", "corp", "zoë", "o'neil", "İstanbul", "北京", "a.b", "a.b.c", "{x}", "+1 555", "x-1", "x", "ß", "foo_bar", "10.0.0.1", "\\\\srv\\a", "é"]
FILL = [" ", ".", ",", "_", "-", "\n", "a", "1", "(", "é", "'", "  ", "北", "", "/", "{"]


def regex_oracle(pairs, text):
    """One alternation, longest first, between characters that are not word characters."""
    low = {}
    for v, t in pairs:
        low.setdefault(A._low(v), t)
    if not low:
        return text
    rx = re.compile("(?<!\\w)(?:" + "|".join(map(re.escape, sorted(low, key=len, reverse=True))) + ")(?!\\w)")
    base, out, done = A._low(text), [], 0
    for m in rx.finditer(base):
        out += [text[done : m.start()], low[m[0]]]
        done = m.end()
    return "".join([*out, text[done:]])


def test_substitution_equals_an_alternation():
    for seed in range(300):
        rng = random.Random(seed)
        pairs = [(v, f"{{T_{i}}}") for i, v in enumerate(rng.sample(ATOMS, rng.randint(0, 8)))]
        sub = A.Substitution(pairs)
        for _ in range(8):
            text = "".join(rng.choice(ATOMS if rng.random() < 0.5 else FILL) for _ in range(rng.randint(0, 12)))
            text = text.upper() if rng.random() < 0.2 else text
            assert sub(text) == regex_oracle(pairs, text), (pairs, text)


def test_time_does_not_grow_with_the_vocabulary():
    texts = [f"ping 10.1.{i % 250}.{i} and Acme Customer {i} Incorporated, user {i}@mail.local or server-host-{i}-prod" for i in range(200)]
    took = {}
    for n in (5_000, 100_000):
        values = [f"10.{i // 65536}.{i // 256 % 256}.{i % 256}" for i in range(n)] + [f"Acme Customer {i} Incorporated" for i in range(n)]
        sub = A.Substitution([(v, "{T}") for v in values])
        took[n] = min(timeit.repeat(lambda: [sub(t) for t in texts], number=1, repeat=5))  # noqa: B023
    assert took[5_000] < 0.02 and took[100_000] < 4 * took[5_000] + 0.005


@pytest.mark.parametrize(("text", "want"), [("Acme Corporation", "Acme Corporation"), ("xAcme", "xAcme"), ("ACME corp!", "{A}!"), ("Zoëzz zoë", "Zoëzz {Z}")])
def test_boundaries(text, want):
    assert A.Substitution([("Acme Corp", "{A}"), ("zoë", "{Z}")])(text) == want


def test_both_paths_and_restore(spark):
    rng = random.Random(1)
    pairs = [(v, f"{{T_{i}}}" if i else "{T}") for i, v in enumerate(ATOMS) if "{" not in v]
    texts = ["".join(rng.choice(ATOMS[:8] + FILL[:6]) for _ in range(15)) for _ in range(60)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokens = spark.createDataFrame(pairs, "real_value string, token string")
    done = A.apply_by_candidates(A.apply_map(docs, tokens, out="a"), tokens, out="b")
    sub = A.Substitution(pairs)
    for r in done.collect():
        assert r["a"] == r["b"] == sub(r["text"])
    back = A.restore(A.apply_map(docs, tokens), tokens, "scrubbed").collect()
    lower = {A._low(v): v for v, _ in pairs}
    for r in back:
        assert r["restored"] == (None if r["text"] is None else regex_oracle([(k, v) for k, v in lower.items()], r["text"]))
    assert A.apply_map(docs, tokens, most_keys=3).filter(~F.col("scrubbed").eqNullSafe(F.col("scrubbed"))).count() == 0


def test_redaction(spark):
    key = "ghp_" + "a1" * 18
    docs = spark.createDataFrame([(f"use {key} and password = 'x1y2' or Secret:abc",), ("nothing",), (None,)], "t string")
    t = F.col("t")
    rows = docs.select(A.redact_kv(A.redact_credentials(t)), A.credential_snippets(t), A.has_credentials(t)).collect()
    assert rows[0][0] == "use [CREDENTIAL-REDACTED] and password=[REDACTED]' or Secret=[REDACTED]"
    assert rows[0][1] == ["ghp_a1…", "password=…", "Secret=…"] and rows[0][2] is True
    assert rows[1][0] == "nothing" and rows[1][2] is False


def test_context(spark):
    t = "x" * 50 + "HIT" + "y" * 50
    one = spark.createDataFrame([(t,)], "t string").select(A.context(F.col("t"), F.lit(51), F.lit(3)), A.context(F.lit("HIT"), F.lit(1), F.lit(3)), A.context(F.col("t"), F.lit(51), F.lit(3), 40, False)).first()
    assert one[0] == "…" + "x" * 32 + "HIT" + "y" * 32 + "…" and one[1] == "HIT" and one[2] == "x" * 40 + "HIT" + "y" * 40


def test_stretches_that_travel_are_hits(spark):
    from anonspark.operators.apply import _lowered, apply_by_candidates, stretches

    docs = spark.range(300).selectExpr("id AS doc_id", "concat('we told acme customer ', id, ' and acme client 7 that other customer ', id, ' of Acme Customer ', id * 3, ' left; plain prose goes on and on here') AS text")
    tokens = spark.range(5000).selectExpr("concat('Acme Customer ', id, ' left') AS real_value", "concat('{T_', id, '}') AS token").unionByName(spark.createDataFrame([("plain prose", "{P}"), ("İd x", "{I}")], "real_value string, token string"))
    named = tokens.select(_lowered("real_value").alias("_key"), "real_value", "token")
    found = stretches(docs, named)
    hits = found.join(named, "_key").count()
    assert hits == 600 and found.count() <= 2 * hits
    every = stretches(docs, named, most_bytes=0)
    assert every.count() > 40 * hits and every.join(named, "_key").count() == hits
    got = {r["doc_id"]: r["scrubbed"] for r in apply_by_candidates(docs, tokens).collect()}
    assert got[5] == "we told acme customer 5 and acme client 7 that other customer 5 of {T_15}; {P} goes on and on here"


def test_filter_forgets_nothing(spark):
    from anonspark.functions.bloom import hash_of, made

    rows = [f"value {i}" for i in range(20_000)]
    held = made(spark.createDataFrame([(r,) for r in [*rows, None]], "v string").repartition(3), lambda s: [hash_of(s, 0)], len(rows))
    assert held.has(hash_of(r, 0) for r in rows).all()
    assert held.has(hash_of(f"other {i}", 0) for i in range(20_000)).mean() < 0.005


def test_stretches_are_found_by_the_values_beginnings(spark, monkeypatch):
    """At any length of the beginnings, and at less than a tenth of a millisecond for each text."""
    import time

    from anonspark.functions import automaton
    from anonspark.operators.apply import begun_keys

    tokens = spark.range(3000).selectExpr("concat('Acme Customer ', id, CASE WHEN id % 2 = 0 THEN ' left' ELSE '' END) AS real_value", "concat('{T_', id, '}') AS token")
    tokens = tokens.unionByName(spark.createDataFrame([("é", "{E}"), ("a", "{A}"), ("İd x", "{I}"), ("", "{N}"), ("$5", "{S}")], "real_value string, token string"))
    docs = spark.createDataFrame([(1, "é a acme customer 7 acme customer 8 left, İD X xé $5"), (2, None), (3, ""), (4, "acme customer 70 leftacme")], "doc_id long, text string")
    want = {1: "{E} {A} {T_7} {T_8}, {I} xé {S}", 2: None, 3: "", 4: "acme customer 70 leftacme"}
    for most in (200_000, 20, 0):
        monkeypatch.setattr(automaton, "MOST_HEADS", most)
        assert {r["doc_id"]: r["scrubbed"] for r in A.apply_by_candidates(docs, tokens).collect()} == want, most
    begun = automaton.Beginnings([(f"acme {i}", [9, 12]) for i in range(1000)])
    begins = time.perf_counter()
    found = [begun_keys("plain prose goes on, and on here; " * 100 + "acme 7 of", begun) for _ in range(500)]
    assert time.perf_counter() - begins < 0.5 and found[0] == {"acme 7 of"}
