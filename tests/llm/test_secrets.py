import hashlib
import random
import re
from collections import Counter

from anonspark.llm import secrets


def test_queries_hold_in_every_match():
    """Whatever a rule matches holds one of its alternatives in full."""
    samples = {
        "assign": ["PassWord = 'abcdefg", "passwd:abcdef", "secret=\"abcdef", "TOKEN: abcdefg", "api_key=abcdef", "apikey = abcdef"],
        "access": ["AKIA" + "Q" * 16], "pem": ["-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----"],
        "github": ["ghp_" + "a" * 36], "slack": ["xoxb-" + "1" * 12], "google": ["AIza" + "b" * 35],
        "jwt": [".".join(("eyJ" + "a" * 9, "eyJ" + "b" * 9, "c"))], "stripe": ["sk_live_" + "a" * 20],
    }
    for r in secrets.RULES:
        q = secrets.trigram_query(r.pattern)
        for s in samples.get(r.kind, []):
            assert re.search(r.pattern, s) and q and any(all(t in s.lower() for t in a) for a in q), (r.kind, s)
    assert secrets.trigram_query(secrets.BASE_RULES[2].pattern) is None
    assert secrets.trigram_query("(abc|de)f?") is None and secrets.trigram_query("(abc)+x*(def)?") == [frozenset({"abc"})]


def _row(i, text):
    spans = secrets.python_spans(text)
    base = [s for s in spans if s[1] in ("assign", "access", "hex")]
    join = lambda a: ",".join(f"{k}:{s}:{e}" for s, k, e in a)
    return (i, *[sum(s[1] == k for s in base) for k in ("assign", "access", "hex")], hashlib.sha256(join(base).encode()).hexdigest(), join(spans))


def test_equals_plain_scan(spark):
    rng = random.Random(2)
    parts = ["password", "token", "=", ":", " ", "'", '"', "AKIA", "A" * 16, "f" * 12, "0a" * 12, "é", "\n", "secret", "x1y2z3", "api_key", "passwd", "𝄞", "ghp_" + "a1" * 18, "abc"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(600)]
    rows += [(601, "token= token' = abcdefg"), (601, "token=token=abcdefgh"), (None, "Secret=123456"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, secrets.report(df).collect())) == Counter(_row(*r) for r in rows)


def _by_contract(text):
    """The base spans, read off the contract and not off the module's rules."""
    name = "".join
    any_case = lambda w: name(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    keys = "|".join([any_case(w) for w in ("password", "passwd", "secret", "token", "api")][:4] + [any_case("api") + "_?" + any_case("key")])
    assign = re.compile(f"({keys})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_rules_are_those_of_the_contract(spark):
    rng = random.Random(8)
    parts = ["PassWord", "passWD", "Token", "secret", "api_key", "ApiKey", "=", ":", " ", "'", '"', "AKIA", "B" * 16, "f" * 24, "0a1", "x1y2z3", "+/_.=-", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(500)]
    got = secrets.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        assert r["base_sha256"] == hashlib.sha256(_by_contract(texts[r["doc_id"]]).encode()).hexdigest(), texts[r["doc_id"]]


def test_main_path_has_no_python(odd):
    plan = secrets.report(odd.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_odd_rows(odd, none, clashing):
    assert Counter(map(tuple, secrets.report(odd).collect())) == Counter(_row(r["doc_id"], r["text"]) for r in odd.collect())
    assert secrets.report(none).count() == 0
    done = secrets.find(clashing)
    assert done.count() == clashing.count() and len({c.lower() for c in done.columns}) == len(done.columns)
