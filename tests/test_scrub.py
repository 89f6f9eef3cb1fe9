import pytest
from pyspark.sql import functions as F

from anonspark.config import ScrubConfig
from anonspark.functions import patterns as P
from anonspark.operators.apply import Substitution
from anonspark.operators.detect import detect
from anonspark.operators.mint import assign_tokens, first_by_key
from anonspark.operators.nested import scrub_json
from anonspark.plans import scrub

KEY = "ghp_" + "b2" * 18
TEXTS = [
    (1, "Server 192.168.1.1 for Acme Corp, mail Anna@Site.example.org"),
    (2, "again 192.168.1.1 and 10.0.0.2, anna@site.example.org, password=pw1"),
    (3, f"key {KEY} at host db.intra.example.org"), (4, "Fabrikam Holdings called; nothing else"), (5, ""), (6, None),
    (7, "{IP} is a token already, 10.0.0.2"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


@pytest.fixture(scope="module")
def result(docs):
    return scrub.scrub_corpus(docs, config=ScrubConfig(customer_names=("Acme Corp",)))


def sequential(spark, texts, names=()):
    """The documents one after another with one dict, over the detectors' own hits."""
    df = spark.createDataFrame(texts, "doc_id long, text string")
    tokens, n = {}, {}

    def mint(value, type_):
        if value.lower() not in tokens:
            k = n.get(type_, 0)
            n[type_] = k + 1
            tokens[value.lower()] = (value, "{" + type_ + (f"_{k}" if k else "") + "}")

    for v in names:
        mint(v, "CUSTOMER")
    for r in sorted(detect(df).filter("rank <> 19").collect(), key=lambda r: (r["doc_id"], r["rank"], r["match_idx"])):
        mint(r["value"], r["type"])
    return tokens


def test_tokens_equal_the_sequential_run(spark, result):
    got = {r["key"]: (r["real_value"], r["token"]) for r in result.tokens.collect()}
    assert got == sequential(spark, TEXTS, ["Acme Corp"])


def test_documents_of_the_test_data_equal_the_sequential_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    want = sequential(spark, rows)
    done = scrub.scrub_corpus(docs)
    assert {r["key"]: (r["real_value"], r["token"]) for r in done.tokens.collect()} == want
    sub = Substitution(list(want.values()))
    got = {r["doc_id"]: r["_x"] for r in done.documents.select("doc_id", F.col("scrubbed").alias("_x")).collect()}
    clean = {i for i, t in rows if not any(x in t.lower() for x in ("password", "akia", "token", "secret"))}
    assert all(got[i] == sub(t) for i, t in rows if i in clean)


def test_results(result):
    by = {r["doc_id"]: r for r in result.documents.collect()}
    assert by[1]["scrubbed"] == "Server {IP} for {CUSTOMER}, mail {EMAIL}" and by[1]["modified"]
    assert by[2]["scrubbed"] == "again {IP} and {IP_1}, {EMAIL}, password=[REDACTED]" and by[2]["has_credentials"]
    assert by[3]["credential_snippets"] == ["ghp_b2…"] and "[CREDENTIAL-REDACTED]" in by[3]["scrubbed"]
    assert [u["span"] for u in by[4]["unsure"]] == ["Fabrikam Holdings"] and by[4]["modified"] and by[4]["scrubbed"] == TEXTS[3][1]
    assert by[5]["scrubbed"] == "" and not by[5]["modified"] and by[6]["scrubbed"] is None and not by[6]["modified"]
    assert [(m["token"], m["is_new"]) for m in by[2]["minted"]][:2] == [("{IP}", False), ("{IP_1}", True)]
    assert scrub.review_rows(result).count() == 1


def test_nothing_is_left(result):
    assert scrub.audit_residual(result.documents).count() == 0


def test_known_values_and_numbers_continue(spark, docs):
    vocab = spark.createDataFrame([("10.0.0.2", "{IP_7}", "ip"), ("x y", "{DOMAIN_USER_2}", "domain_user")], "real_value string, token string, category string")
    done = scrub.scrub_corpus(docs, vocab=vocab)
    got = {r["key"]: r["token"] for r in done.tokens.collect()}
    assert got["10.0.0.2"] == "{IP_7}" and got["192.168.1.1"] == "{IP_8}"


def test_each_document_alone(docs):
    by = {r["doc_id"]: r["scrubbed"] for r in scrub.scrub_documents(docs).collect()}
    assert by[2].startswith("again {IP} and {IP_1}") and by[7] == "{IP} is a token already, {IP}"


def test_token_shapes_are_refused(spark):
    rows = spark.createDataFrame([(1, 0, 0, "{IP}", "X"), (1, 0, 1, "v", "X"), (2, 0, 0, "V", "Y")], "doc_order long, rank int, match_idx int, value string, type string")
    got = [(r["key"], r["value"], r["token"]) for r in assign_tokens(first_by_key(rows, scrub.ORDER), None, scrub.ORDER).collect()]
    assert got == [("v", "v", "{X}")]


def test_numbering_over_many_tasks(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_order"), F.lit(0).alias("rank"), F.lit(0).alias("match_idx"), F.concat(F.lit("v"), "id").alias("value"), F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("type"))
    got = {r["value"]: r["token"] for r in assign_tokens(first_by_key(rows.repartition(7), scrub.ORDER), None, scrub.ORDER).collect()}
    n = {"A": 0, "B": 0}
    for i in range(5000):
        t = "A" if i % 3 == 0 else "B"
        assert got[f"v{i}"] == ("{" + t + (f"_{n[t]}" if n[t] else "") + "}")
        n[t] += 1


def test_a_text_is_searched_once_for_its_doubtful_spans(spark):
    text = "Fabrikam Holdings, " + "then " * 12 + "Contoso Bank and again Fabrikam Holdings " + "more " * 12
    docs = spark.createDataFrame([(1, text), (2, "Contoso Bank")], "doc_id long, text string")
    hits = detect(docs, names=["corp"])
    doubt = scrub.unsure_spans(docs, hits, hits.limit(0).selectExpr("lower(value) AS key"), "doc_id", "text")
    got = {r["doc_id"]: [(u["span"], u["surrounding"]) for u in r["unsure"]] for r in doubt.collect()}
    first, second, third = (text.index("Fabrikam"), text.index("Contoso"), text.rindex("Fabrikam"))
    around = lambda at, n: ("…" if at > 32 else "") + text[max(0, at - 32) : at + n + 32] + "…"
    assert got == {1: [("Fabrikam Holdings", around(first, 17)), ("Contoso Bank", around(second, 12)), ("Fabrikam Holdings", around(third, 17))], 2: [("Contoso Bank", "Contoso Bank")]}
    assert doubt._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_previews_runs_and_payload(spark, result):
    by = {r["doc_id"]: r["findings"] for r in scrub.findings_preview(result.documents).collect()}
    assert by[5] == "none" and by[2] == "IP×2, EMAIL×1, FQDN×1"
    vocab = spark.createDataFrame([("{A}", "ip")], "token string, category string")
    runs = scrub.token_runs(spark.createDataFrame([(1, "x {A} y{B_1}")], "doc_id long, text string"), vocab).orderBy("idx").collect()
    assert [(r["kind"], r["value"], r["category"]) for r in runs] == [("text", "x ", None), ("token", "{A}", "ip"), ("text", " y", None), ("token", "{B_1}", None)]
    parts = spark.createDataFrame([(1, 0, "composer", None, " hi ", None), (1, 1, "file", "a.txt", "body", None), (1, 2, "file", "b", "x", "too large"), (2, 0, "composer", None, "  ", None)], "id long, ord int, kind string, name string, text string, error string")
    assert [tuple(r) for r in scrub.build_payload(parts).collect()] == [(1, " hi \n\n--- file: a.txt ---\nbody")]


def test_nested_records(spark):
    import json

    deep = "10.9.9.9"
    for _ in range(20):
        deep = [deep]
    rows = [
        (1, json.dumps({"file_path": "at 10.0.0.1", "old_string": "10.0.0.1", "new_string": f"key {KEY}", "n": 3, "list": ["10.0.0.2", {"k": "10.0.0.1"}]}), "Edit"),
        (2, "not json", "Edit"), (3, json.dumps({"x": deep}), "Bash"), (4, json.dumps({"command": "ping 10.0.0.1"}), "Bash"), (5, None, None),
    ]
    got = {r["id"]: r for r in scrub_json(spark.createDataFrame(rows, "id long, rec string, tool string"), "id", "rec", "tool").collect()}
    one = json.loads(got[1]["updated"])
    assert one["file_path"] == "at {IP}" and one["old_string"] == "10.0.0.1" and one["list"] == ["{IP_1}", {"k": "{IP}"}] and one["n"] == 3
    assert got[1]["has_credentials"] and KEY in one["new_string"] and got[2]["updated"] == "not json" and not got[3]["modified"]
    assert json.loads(got[4]["updated"]) == {"command": "ping {IP}"} and not got[4]["has_credentials"]


def test_nested_records_are_numbered_in_their_order(spark):
    import json

    rows = [(i, json.dumps({"b": f"at 10.0.0.{i}", "a": [f"10.1.0.{i}"]}), "Bash") for i in range(1, 13)]
    rows.append((13, "[" * 200_000, "Bash"))
    rows.append((14, '{"x": ' + "[" * 5_000 + "]" * 5_000 + "}", "Bash"))
    got = {r["id"]: r["updated"] for r in scrub_json(spark.createDataFrame(rows, "id long, rec string, tool string"), "id", "rec", "tool").collect()}
    name = lambda n: "{IP}" if n == 0 else f"{{IP_{n}}}"
    assert all(json.loads(got[i]) == {"b": f"at {name(2 * i - 2)}", "a": [name(2 * i - 1)]} for i in range(1, 13))
    assert got[13] == rows[12][1] and got[14] == rows[13][1]


def test_nested_fields_are_scrubbed_once(spark):
    """Flags, lists and edits of a record come from one pass over its fields."""
    rows = spark.createDataFrame([(1, '{"x": "at 10.0.0.1"}', "Bash")], "id long, rec string, tool string")
    done = scrub_json(rows, "id", "rec", "tool")
    assert done._jdf.queryExecution().optimizedPlan().toString().count("[of(") == 1
    assert done.first()["updated"] == '{"x": "at {IP}"}'


def test_patterns_read_in_both_dialects():
    assert P.java(r"a\\b") == r"a\\b" and P.java(r"\bx") == P.BOUNDARY + "x" and P.java(r"[^\s@]").startswith("[^\\t")


def test_bytes_outside_of_the_edits_stay(spark):
    record = '{ "n" : 12345678901234567.123456,"u":"\\u00e9\\/x" , "t":"at 10.0.0.1 \\"q\\"", "k 10.0.0.1":[1e5, "10.0.0.1"], "t":"again 10.0.0.1"}'
    got = scrub_json(spark.createDataFrame([(1, record, "Bash"), (2, '"10.0.0.1"', "Bash")], "id long, rec string, tool string"), "id", "rec", "tool")
    got = {r["id"]: r["updated"] for r in got.collect()}
    assert got[1] == record.replace('"at 10.0.0.1 ', '"at {IP} ').replace('"10.0.0.1"]', '"{IP}"]').replace("again 10.0.0.1", "again {IP}") and got[2] == '"{IP}"'


def test_rows_without_an_id_and_clashing_columns(spark):
    rows = [(None, "at 10.0.0.1", "a", 1), (None, "at 10.0.0.2", "b", 2), (5, "at 10.0.0.1", "c", 3), (5, "Fabrikam Holdings, 10.0.0.3", "d", 4), (None, None, "e", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, minted string, _row long").withColumns({n: F.lit("x") for n in ("unsure", "scrubbed", "_h", "_hits", "_applied", "_cells", "value", "rank", "_text", "_anchored", "key")})
    for run in (lambda: scrub.scrub_corpus(docs).documents, lambda: scrub.scrub_documents(docs)):
        got = run().collect()
        assert len(got) == 5 and all(r["_h"] == "x" and r["value"] == "x" and r["rank"] == "x" for r in got)
        lists = {r["_row"]: ([m["real_value"] for m in r["minted"]], [u["span"] for u in r["unsure"]], r["scrubbed"]) for r in got}
        assert [lists[i][0] for i in range(1, 6)] == [["10.0.0.1"], ["10.0.0.2"], ["10.0.0.1"], ["10.0.0.3"], []]
        assert lists[4][1] == ["Fabrikam Holdings"] and lists[5][2] is None and "{IP" in lists[1][2] and "10.0.0" not in "".join(lists[i][2] for i in range(1, 5))


def test_large_tables_are_not_broadcast(spark):
    from anonspark.plans.storage import small

    hinted = lambda df, **bounds: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString() or "broadcast" in small(df, **bounds)._jdf.queryExecution().analyzed().toString()
    lists = spark.range(100).selectExpr("id", "transform(sequence(1, 100), x -> named_struct('a', repeat('y', 100), 'b', x)) AS l")
    assert hinted(lists) and not hinted(lists, most_bytes=500_000) and not hinted(lists, bound=99)


def test_a_derived_text_is_made_once_for_detection(spark):
    """Nor is a null text a fault: detectors and patterns find nothing in it."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def derived(i: int):
        made.add(1)
        return f"see 10.0.0.{i} and a{i}@b.example.com" if i % 3 else None

    rows = spark.range(30).repartition(2).withColumn("text", derived("id"))
    got = detect(rows, config=ScrubConfig(literals=(("see", "word"),)), patterns=[(1, "c", r"\band\b", 0.5), (2, "c", r"x?e+", 0.5)]).groupBy("id").count().collect()
    # an address, a mail, its host, the literal, "and", three times "e"
    assert len(got) == 20 and {r["count"] for r in got} == {8} and made.value == 30, (got[:3], made.value)


def test_nested_records_are_cut_once(spark):
    """Their strings are read four times; a record is made for these once, and once for its edits."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def record(i: int):
        made.add(1)
        return '{"a": "10.0.0.%d", "old_string": "x", "b": ["%s"]}' % (i, KEY) if i % 5 else None if i else "no JSON, 10.0.0.1"

    rows = spark.range(20).repartition(2).select(F.when(F.col("id") < 19, F.col("id")).alias("id"), record("id").alias("record"), F.lit("Edit").alias("tool"))
    got = {r["id"]: r for r in scrub_json(rows, "id", "record", "tool").collect()}
    assert made.value <= 40, made.value
    assert got[1]["updated"] == '{"a": "{IP_1}", "old_string": "x", "b": ["[CREDENTIAL-REDACTED]"]}' and got[1]["has_credentials"]
    assert got[0]["updated"] == "no JSON, 10.0.0.1" and got[5]["updated"] is None and len(got) == 20
