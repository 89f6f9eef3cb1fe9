import pytest
from pyspark.sql import functions as F

from anonspark.config import ScrubConfig
from anonspark.functions import patterns as P
from anonspark.operators.detect import counts, detect, drop_allowlisted, premint

CASES = [
    ("ipv4", "Server at 192.168.1.1 is down, not 999.1.1.1 or 1.2.3", ["192.168.1.1"]),
    ("ipv4", "é10.0.0.1", ["10.0.0.1"]),  # boundaries are ASCII
    ("ipv6", "at fe80:0:0:0:0:0:0:1 now", ["fe80:0:0:0:0:0:0:1"]),
    ("email", "write zoë@bücher.example.org or a@b", ["zoë@bücher.example.org"]),
    ("unc_path", r"see \\srv\share\x.txt and \\srv alone", [r"\\srv\share\x.txt"]),
    ("domain_user", r"login CORP\jdoe or corp\jdoe", [r"CORP\jdoe"]),
    ("mac", "00:1A:2b:3c:4d:5e or 00-1a-2b-3c-4d-5e", ["00:1A:2b:3c:4d:5e", "00-1a-2b-3c-4d-5e"]),
    ("guid", "id 550e8400-e29b-41d4-a716-446655440000.", ["550e8400-e29b-41d4-a716-446655440000"]),
    ("phone", "(555) 123-4567, +44 20 7946 0958, 555-123-4567, 5551234567", ["(555) 123-4567", "+44 20 7946 0958", "555-123-4567"]),
    ("street", "at 123 Main Street and 123 main street", ["123 Main Street"]),
    ("card", "4111-1111-1111-1111 and 1234 5678 9012 3456", ["4111-1111-1111-1111"]),
    ("url", "go to https://app.site.org/a?b=c now, not http://x.github.com/y", ["https://app.site.org/a?b=c"]),
    ("fqdn", "hosts db1.corp.example.org, printer.local, api.github.com, el.classList.contains, 1.2.3, a.b", ["db1.corp.example.org", "printer.local"]),
    ("corp", "We met Acme Corp and acme corp", ["Acme Corp"]),
    ("person_header", "From: Anna Bell <a@b.org>; Jean-Luc Picard <j@b.org>\nTo: Friday Monday <f@b.org>", ["Anna Bell", "Jean-Luc Picard"]),
    ("person_adjacent", "please ask Anna Bell at anna@b.org", ["Anna Bell"]),
    ("person_sign_off", "text\n\nBest,\nAnna Bell\n", ["Anna Bell"]),
    ("person_sign_off", "text\n\nBest,\nAnna\n", []),
]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(CASES)], "doc_id long, text string")
    out = {}
    for r in detect(docs).orderBy("doc_id", "rank", "match_idx").collect():
        out.setdefault((r["doc_id"], P.BY_RANK[r["rank"]].name), []).append(r["value"])
    return out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_detector(found, i):
    assert found.get((i, CASES[i][0]), []) == CASES[i][2]


def test_filters(spark):
    rows = spark.createDataFrame([("13.05.2026",), ("1.2.3",), ("el.style",), ("host.local",), ("api.GitHub.com",), ("github.com",), ("Server_3",)], "v string")
    got = {r[0]: tuple(r)[1:] for r in rows.select("v", P.looks_like_date(F.col("v")), P.looks_like_identifier(F.col("v")), P.fqdn_allowed(F.col("v")), P.looks_like_code_identifier(F.col("v"))).collect()}
    assert got["13.05.2026"][0] and got["1.2.3"][0] and not got["host.local"][0]
    assert got["el.style"][1] and not got["host.local"][1]
    assert got["api.GitHub.com"][2] and not got["github.com"][2]
    assert got["Server_3"][3] and not got["host.local"][3]


def test_names_and_literals(spark):
    config = ScrubConfig(customer_names=("Acme Corp",), person_names=(" Bob ",), user_patterns=(("Project X", "my cat"),), literals=(("a+b", "sum"),), name_allowlist=("Anna Bell",), fqdn_allowlist_extra=(".example.org",))
    docs = spark.createDataFrame([(1, "A+B and From: Anna Bell <x@y.org> at db.x.example.org")], "doc_id long, text string")
    hits = detect(docs, config=config)
    assert [(r["value"], r["type"]) for r in hits.filter("rank = 3").collect()] == [("A+B", "SUM")]
    assert hits.filter("rank IN (7, 8, 9, 18)").count() == 0
    got = [(r["rank"], r["value"], r["type"], r["category"]) for r in premint(spark, config).orderBy("rank").collect()]
    assert got == [(0, "Acme Corp", "CUSTOMER", "customer"), (1, "Bob", "PERSON", "person"), (2, "Project X", "MY_CAT", "my cat")]


def test_allowlist(spark):
    rows = spark.createDataFrame([("Host1",), ("host2",), ("web-1.internal",), ("keep",)], "value string")
    allow = spark.createDataFrame([("HOST1", False), ("^WEB-.*internal$", True)], "pattern string, is_regex boolean")
    assert sorted(r[0] for r in drop_allowlisted(rows, allow).collect()) == ["host2", "keep"]


def test_counts_and_nulls(spark):
    docs = spark.createDataFrame([(1, "10.0.0.1 10.0.0.1"), (2, None), (3, "")], "doc_id long, text string")
    assert [tuple(r) for r in counts(detect(docs)).collect()] == [("ipv4", 2, 1)]


def test_every_allowlist_regex_counts(spark):
    rows = spark.createDataFrame([(f"host{i}x",) for i in range(1500)] + [("a b",), ("keep",), (None,)], "value string")
    allow = spark.createDataFrame([(f"^HOST{i}x$", True) for i in range(1500)] + [(r"\ba\sB", True)], "pattern string, is_regex boolean")
    assert [r[0] for r in drop_allowlisted(rows, allow).collect() if r[0]] == ["keep"]


def test_java_column_equals_java(spark):
    from anonspark.functions.patterns import java, java_column

    cases = [r"\bA\s+[\s,][^\s]\\b\\s", "plain", ""]
    got = spark.createDataFrame([(c,) for c in cases], "p string").select(java_column(F.col("p"))).collect()
    assert [r[0] for r in got] == [java(c) for c in cases]


def test_one_scan_finds_what_the_regexes_find(spark, sf):
    """Detection from anchors equals each regex run over the whole text."""
    import random

    rng = random.Random(9)
    pieces = [t for _, t, _ in CASES] + [v for _, _, vs in CASES for v in vs] + ["a.b", "x-f", "::1", "fe80::1", "-", ".", "\\", " ", "　", "\x85", "é", "1.2.3.4", "(555)", "123-4567", "+1", "555 123 4567", "4111 1111 1111 1111", "x4111-1111-1111-1111", "a@b.cd", "co.uk", "https://a.bc/d", "Co", "Acme Co", "12 Main St", "\n", "\t", ":"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", "  ", "\n", " ", ","]) for _ in range(rng.randint(1, 12))) for _ in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = docs.unionByName(spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text"))
    plain = docs.select("doc_id", F.map_from_entries(F.array(*[F.struct(F.lit(d.name), F.regexp_extract_all("text", F.lit(d.regex), F.lit(d.group))) for d in P.DETECTORS])).alias("m"))
    want = {(r["doc_id"], n): v for r in plain.collect() for n, v in r["m"].items() if v}
    from anonspark.operators.detect import all_hits

    arrays = all_hits(F.col("text"), P.anchored(F.col("text")), P.may_have_number(F.col("text")), P.DETECTORS)
    rows = docs.select("doc_id", *[a["value"].alias(d.name) for a, d in zip(arrays, P.DETECTORS)]).collect()
    got = {(r["doc_id"], d.name): r[d.name] for r in rows for d in P.DETECTORS if r[d.name]}
    assert got == want and len({n for _, n in want}) == len(P.DETECTORS)


def test_scan_for_anchors_costs_as_much_as_another_scan(spark):
    import time

    docs = spark.range(0, 8, 1, 4).select(F.concat(F.repeat(F.lit("a sentence of prose, and its end. "), 40_000), F.col("id")).alias("t")).persist()
    docs.count()

    def seconds(c):
        begun = time.perf_counter()
        docs.select(c).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begun

    both = {n: min(seconds(c) for _ in range(3)) for n, c in (("anchors", P.anchored(F.col("t"))), ("numbers", P.may_have_number(F.col("t"))))}
    docs.unpersist()
    assert both["anchors"] < 5 * both["numbers"] + 0.2, both


def test_scan_for_anchors_of_long_tokens(spark):
    long = [".-" * 500_000, "x" * 1_000_000, "y-" * 500_000 + "@z", ""]
    got = spark.createDataFrame([(t,) for t in long], "t string").select(F.length(P.anchored(F.col("t")))).collect()
    assert [r[0] for r in got] == [0, 0, 1_000_003, 0]


def test_active_patterns_of_customers_whose_last_digits_are_equal(spark, tmp_path):
    from anonspark.plans.queries import QUERIES

    rows = [(i, f"Customer#{i:09d}") for i in (0, 4, 7, 10_000, 20_000, 20_004)]
    spark.createDataFrame(rows, "c_custkey long, c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    got = sorted(tuple(r) for r in QUERIES["active_pattern_set"](spark, str(tmp_path)).collect())
    want = [(i, n, i) for i, n in rows] + [(i, n[8:], 0) for i, n in rows] + [(i, f"ask {n}", -i) for i, n in rows if i % 2 == 0]
    assert got == sorted(want)


def test_a_string_that_all_patterns_share_costs_nothing(spark):
    import time

    from anonspark.operators.detect import candidate_patterns

    docs = spark.range(0, 1500, 1, 2).select("id", F.concat(F.lit("ask for name#"), F.col("id"), F.lit(" of all")).alias("t"))
    patterns = [(i, "c", rf"ask\sfor\sname#{i:04d}\b", 0.5) for i in range(8000)]
    begun = time.perf_counter()
    got = docs.select("id", candidate_patterns(docs, patterns)(F.col("t"))["id"].alias("p")).filter("size(p) > 0").collect()
    assert {r["id"]: r["p"] for r in got} == {i: [i] for i in range(1000, 1500)}
    assert time.perf_counter() - begun < 8


def test_a_table_of_patterns_has_the_hits_of_a_list(spark):
    from anonspark.operators.detect import detect

    texts = ["ask for Name#0001 or NAME#0002", "mail a@b.example.com, name#0001 name#0001", None, "", "nothing", "tell İ cat-77 or dog-77", "x1"]
    docs = spark.createDataFrame([(i % 5, t, "k") for i, t in enumerate([*texts, texts[0]])], "doc_id long, t string, _hash string")
    patterns = [(i, f"c{i % 2}", r"(?i)\bname#0001\b", 0.5) for i in range(40)]  # many of one regex
    patterns += [(100, "d", r"for\sname#000[12]\b", 0.5), (101, "d", r"for\sName#000[12]\b", 0.7), (102, "e", r"(?:cat|dog)-\d+", 0.4), (103, "e", r"\d+", 0.3), (104, "e", r"x?", 0.3), (105, "e", r"unseen#\d+", 0.3)]
    listed = detect(docs, "t", patterns=patterns)
    tabled = detect(docs, "t", patterns=spark.createDataFrame(patterns, "id long, category string, regex string, confidence double"))
    assert tabled.columns == listed.columns
    want = sorted(map(repr, listed.collect()))
    assert sorted(map(repr, tabled.collect())) == want and sum("source=7," in r or "source=7)" in r for r in want) == 4
    none = detect(docs, "t", patterns=spark.createDataFrame([], "id long, category string, regex string, confidence double"))
    assert none.filter("rank = 20").count() == 0
