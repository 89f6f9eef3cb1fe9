"""The vocabulary, the review queue, the gate, the log and learned patterns."""

import random
import re

import pytest
from pyspark.sql import functions as F

from anonspark.operators import gate, induce, judge, review, vocab
from anonspark.plans.store import SCHEMAS, VocabStore

def now():
    return F.lit(100).cast("long")


@pytest.fixture(scope="module")
def words(spark):
    rows = [("a@x.org", "{EMAIL}", "email", 1.0, 1, 1, 1, None, "auto"), ("b@x.org", "{EMAIL_1}", "email", 1.0, 1, 2, 3, None, "auto"), ("Acme", "{CUSTOMER}", "customer", 1.0, 1, 1, 1, None, None), ("abc", "{X}", "x", 1.0, 1, 1, 1, None, "auto")]
    return spark.createDataFrame(rows, SCHEMAS["vocab"])


def test_upsert(spark, words):
    new = spark.createDataFrame([("a@x.org", "{NEW}", "other", 0.5), ("c", "{C}", "x", 0.9)], "real_value string, token string, category string, confidence double")
    got = {r["real_value"]: r for r in vocab.upsert(words, new, now()).collect()}
    assert len(got) == 5 and got["a@x.org"]["token"] == "{EMAIL}" and got["a@x.org"]["hit_count"] == 2 and got["a@x.org"]["last_seen"] == 100
    assert got["c"]["hit_count"] == 1 and got["c"]["first_seen"] == 100 and got["c"]["confirmed_by"] == "auto" and got["b@x.org"]["last_seen"] == 2
    forced = {r["real_value"]: r for r in vocab.upsert(words, new, now(), True).collect()}
    assert forced["a@x.org"]["token"] == "{NEW}" and forced["a@x.org"]["category"] == "other"


def test_views(spark, words):
    assert vocab.confirmed_map(words).count() == 3
    assert [tuple(r) for r in vocab.categories_above(words, 2).collect()] == [("email", 2)]
    assert [r["real_value"] for r in vocab.listed(words, "email").collect()] == ["a@x.org", "b@x.org"]
    assert vocab.searched(words, "EMAIL_1").count() == 1 and vocab.searched(words, "", "Email").count() == 2
    first = vocab.merge_first([words.select("token", "real_value").limit(1).withColumn("real_value", F.lit("z")), words.select("token", "real_value")])
    assert first.count() == 4 and first.filter("real_value = 'z'").count() == 1
    assert vocab.merge_last([words.select("token", "real_value").withColumn("real_value", F.lit("z")), words.select("token", "real_value")]).filter("real_value = 'z'").count() == 0
    left, report = vocab.clear(words)
    assert left.count() == 0 and tuple(report.first()) == (4, 0)


def test_forget(spark, words):
    allow = spark.createDataFrame([], SCHEMAS["allowlist"])
    kept, listed = vocab.forget(words, spark.createDataFrame([("A@X.ORG",), ("ABC",), ("nobody",)], "value string"), allow, now())
    assert {r["real_value"] for r in kept.collect()} == {"b@x.org", "Acme"} and [r["pattern"] for r in listed.collect()] == ["a@x.org"]


def test_admission(spark):
    key = "ghp_" + "c3" * 18
    rows = spark.createDataFrame([(" ok ", "customer"), ("", "x"), ("a​b", "x"), ("v", "Bad!"), (key, "x"), ("x" * 201, "x"), ("ﬁne", None)], "value string, category string")
    got = {r["value"]: r["reason"] for r in vocab.validated(rows).collect()}
    assert got["ok"] is None and got["fine"] is None and got[""] == "value required" and got["v"] == "invalid category" and got[key] == "credential-shape rejected"
    rows = spark.createDataFrame([("abc", False), ("abcd", False), ("a.*b", True), ("a.*bcd", True), ("(((((((", True), ("a*b*c*d*", True)], "value string, is_regex boolean")
    got = {r["value"]: r["reason"] for r in vocab.validated(rows, True).collect()}
    assert got == {"abc": "pattern too short", "abcd": None, "a.*b": "pattern too short", "a.*bcd": None, "(((((((": "invalid regex pattern", "a*b*c*d*": "pattern matches empty string"}


def test_envelope(spark, words):
    env = vocab.export_map(words)
    assert vocab.import_map(env).count() == 4
    assert vocab.import_map(spark.createDataFrame([('{"v":1,"entries":[{"token":"{A}","real":"x"},{"token":"bad","real":"y"},{"real":"z"}]}',)], "payload string")).count() == 1
    for bad in ('{"v":2,"entries":[]}', '{"v":1,"entries":5}', "null"):
        with pytest.raises(Exception, match="envelope"):
            vocab.import_map(spark.createDataFrame([(bad,)], "payload string")).collect()


def test_an_envelope_of_any_size(spark, tmp_path):
    import json

    many = spark.range(0, 50_000, 1, 8).selectExpr("concat('{T_', id, '}') AS token", "concat('value \"', id, '\", [x]') AS real_value")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    vocab.write_envelope(many, f"file://{tmp_path}/e")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(p for p in (tmp_path / "e").iterdir() if p.suffix == ".txt")
    whole = json.loads("".join(p.read_text() for p in files))
    assert len(files) > 1 and whole["v"] == 1 and len(whole["entries"]) == 50_000 and whole["entries"][0] == {"token": "{T_0}", "real": 'value "0", [x]'}
    assert vocab.read_envelope(spark, f"file://{tmp_path}/e").exceptAll(many.withColumnRenamed("real_value", "real")).count() == 0
    vocab.write_envelope(many.limit(0), f"file://{tmp_path}/none")
    assert vocab.read_envelope(spark, f"file://{tmp_path}/none").count() == 0
    for i, text in enumerate(('{"v":2,"entries":[\n]}', '{"v":1,"entries":[\n{"token":"{A}","real":"x"}', "null")):
        (tmp_path / f"{i}.txt").write_text(text)
        with pytest.raises(ValueError, match="envelope"):
            vocab.read_envelope(spark, f"file://{tmp_path}/{i}.txt")


def test_store_after_a_dead_writer(spark, words, tmp_path):
    store = VocabStore(spark, f"file://{tmp_path}")
    store.write("vocab", words)
    (tmp_path / "vocab" / "m=2").mkdir()  # a writer that died left no _SUCCESS
    (tmp_path / "vocab" / "m=2" / "part-0.parquet").write_bytes(b"half")
    (tmp_path / "vocab" / "d=dead").mkdir()
    for i in range(3):
        store.append("vocab", words.withColumn("real_value", F.concat("real_value", F.lit(f" {i}"))))
    assert store.read("vocab").count() == 4 * words.count()
    names = [p.name for p in (tmp_path / "vocab").iterdir()]
    assert len([n for n in names if n.startswith("m=")]) == 2 and "d=dead" not in names


def test_changes_touch_few_files(spark, tmp_path):
    from anonspark.plans import store as plans

    store = VocabStore(spark, f"file://{tmp_path}", part_rows=500)
    base = spark.range(100_000).selectExpr("concat('v', id) AS real_value", "concat('{T_', id, '}') AS token", "'t' AS category", "1.0D AS confidence", "1L AS first_seen", "1L AS last_seen", "1L AS hit_count", "CAST(NULL AS STRING) AS project", "'auto' AS confirmed_by")
    store.write("vocab", base)
    before = {f["path"] for f in store.files("vocab")}
    assert len(before) == 200
    want = {}
    for n in range(1, plans.MOST_CHANGES + 3):
        minted = spark.createDataFrame([(v, f"{{NEW_{n}}}", "t", 0.5) for v in ("v7", "v77777", f"new {n}")], "real_value string, token string, category string, confidence double")
        store.merge("vocab", vocab.upsert(store.look_up("vocab", minted), minted, F.lit(10 + n).cast("long")))
        want |= {"v7": (n + 1, 10 + n, "{T_7}"), "v77777": (n + 1, 10 + n, "{T_77777}"), f"new {n}": (1, 10 + n, f"{{NEW_{n}}}")}
        files = {f["path"] for f in store.files("vocab")}
        gone = before - files
        assert len(gone) <= 3 and len(files - before) < 20  # base files put together anew, and changes
        got = {r["real_value"]: (r["hit_count"], r["last_seen"], r["token"]) for r in store.look_up("vocab", minted).collect()}
        assert got == {k: v for k, v in want.items() if k in got} and len(got) == 3
    rows = store.read("vocab")
    assert rows.count() == 100_000 + plans.MOST_CHANGES + 2 == rows.select("real_value").distinct().count()
    assert {r["real_value"]: (r["hit_count"], r["last_seen"], r["token"]) for r in rows.filter("last_seen > 1").collect()} == want
    assert gone  # of the parts with many changes


def test_an_allowlist_of_thousands_of_regexes(spark):
    from anonspark.operators.detect import drop_allowlisted

    entries = [(f"^host-{i}\\.(?:corp|lan)$", True) for i in range(5000)] + [(f"Value{i}", False) for i in range(500)]
    allow = spark.createDataFrame(entries, "pattern string, is_regex boolean")
    values = [f"HOST-{i}.lan" for i in range(4990, 5010)] + ["value7", "other", "x host-1.lan"]
    rows = spark.createDataFrame([(v,) for v in values], "value string")
    left = sorted(r["value"] for r in drop_allowlisted(rows, allow).collect())
    assert left == sorted([f"HOST-{i}.lan" for i in range(5000, 5010)] + ["other", "x host-1.lan"])


def test_regexes_meet_few_values(spark):
    from anonspark.operators import detect

    shapes = [lambda i: f"^host-{i}\\.(?:corp|lan)$", lambda i: f"(?:db|web){i:04d}x?\\d", lambda i: f"[Uu]ser\\s{i:04d}\\b", lambda i: f"id={i}[a-c]+;$"]
    regexes = [shapes[i % 4](i) for i in range(5000)]
    values = [v for i in range(0, 6000, 3) for v in (f"HOST-{i}.corp", f"web{i:04d}7", f"user {i:04d}", f"id={i}AB;", f"nothing {i}")]
    allow = spark.createDataFrame([(r, True) for r in [*regexes, "^..$"]], "pattern string, is_regex boolean")
    rows = spark.createDataFrame([(v,) for v in [*values, "xy"]], "value string")
    left = {r["value"] for r in detect.drop_allowlisted(rows, allow).collect()}
    by_shape = [{i for i in range(5000) if i % 4 == s} for s in range(4)]
    want = {v for i in range(0, 6000, 3) for s, v in enumerate((f"HOST-{i}.corp", f"web{i:04d}7", f"user {i:04d}", f"id={i}AB;")) if i not in by_shape[s]} | {f"nothing {i}" for i in range(0, 6000, 3)}
    slow = {v for v in values[:200] if not any(re.search(r, v, re.I) for r in regexes)}
    assert left == want and slow == want & set(values[:200])
    found = allow.select(detect._clauses("pattern").alias("_f"), F.concat(F.lit("(?i)"), "pattern").alias("_p")).filter("size(_f) > 0")
    pairs = detect.candidates(rows.select(F.col("value").alias("_k")), found).count()
    assert pairs < len(values) * 5000 / 1000  # regexes that are run, of all pairs


def test_store(spark, words, tmp_path):
    store = VocabStore(spark, f"file://{tmp_path}")
    assert store.read("vocab").count() == 0
    store.write("vocab", words)
    store.write("vocab", vocab.upsert(store.read("vocab"), words.select("real_value", "token", "category", "confidence"), now()))
    assert store.read("vocab").agg(F.sum("hit_count")).first()[0] == 10


def test_review(spark, words):
    queue = spark.createDataFrame([], SCHEMAS["review_queue"])
    allow = spark.createDataFrame([("Quiet Inc", False, "x", 1, None)], SCHEMAS["allowlist"])
    spans = spark.createDataFrame([(s, "ctx", "customer", 0.6, e) for s, e in (("New Corp", "scrub"), ("New Corp", "scrub"), ("acme", "scrub"), ("Quiet Inc", "scrub"), ("Jane Doe", "judge:scrub"))], "span string, surrounding string, suggested_cat string, confidence double, source_event string")
    queue = spark.createDataFrame(review.enqueue(queue, spans, words, allow, now()).collect(), SCHEMAS["review_queue"])
    assert sorted(r["span"] for r in queue.collect()) == ["Jane Doe", "New Corp", "New Corp"]
    assert review.by_origin(queue, True).count() == 1 and review.pending(queue, allow).count() == 3
    ids = {r["id"]: r["span"] for r in queue.collect()}
    decisions = [(i, "confirm" if s == "Jane Doe" else "ignore", "person" if s == "Jane Doe" else None) for i, s in ids.items()] + [(9999, "confirm", None), (min(ids), "explode", None)]
    done, new, listed, rejected = review.triage(queue, spark.createDataFrame(decisions, "id long, action string, category string").filter("action <> 'explode' OR id < 0"), words, allow, now())
    assert {r["span"]: r["token"] for r in new.withColumnRenamed("real_value", "span").collect()}["Jane Doe"] == "{PERSON}"
    assert sorted(r["status"] for r in done.collect()) == ["confirmed", "ignored", "ignored"] and rejected.count() == 1 and listed.count() == 1


def test_decisions(spark):
    rows = [("UserPromptSubmit", 3, 10, False, True, 1, 0), ("UserPromptSubmit", 9, 2_000_000, True, True, 0, 0), ("UserPromptSubmit", 9, 9, False, True, 1, 2), ("PreToolUse", 9, 9, True, True, 1, 0), ("PreToolUse", 9, 9, False, True, 1, 0), ("PostToolUse", 9, 9, False, True, 0, 2), ("PostToolUse", 9, 9, True, True, 0, 0), ("PreToolUse", 9, 9, False, False, 0, 0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, kind string, size int, payload_size int, has_credentials boolean, modified boolean, n_minted int, n_reused int")
    got = [(r["decision"], r["logged"], r["tokens_minted"], r["blocked"]) for r in gate.decide(df).orderBy("i").collect()]
    assert got == [("pass", False, 1, 0), ("warn", False, 0, 0), ("block", True, 1, 1), ("block", True, 0, 1), ("mutate", True, 1, 0), ("warn", False, 0, 0), ("block", True, 0, 1), ("pass", False, 0, 0)]
    assert {r["decision"] for r in gate.decide(df, "observe").collect()} == {"pass", "warn"} and {r["decision"] for r in gate.decide(df, "disabled").collect()} == {"pass"}


def test_conversations_without_an_id_stay(spark):
    rows = [(1, "user", True, "x"), (1, "bot", False, "y"), (2, "system", False, "z"), (None, "assistant", None, "w"), (None, "user", True, "v")]
    df = spark.createDataFrame(rows, "conv_id long, role string, has_credentials boolean, _bad string")
    got = sorted((str(r["conv_id"]), r["role"], r["rejected"], r["_bad"]) for r in gate.conversation_gate(df).collect())
    assert got == [("1", "user", True, "x"), ("1", "user", True, "y"), ("2", "system", False, "z"), ("None", "assistant", True, "w"), ("None", "user", True, "v")]


def test_rate_limit(spark):
    rng = random.Random(1)
    rows = [(k, rng.randint(0, 60_000), i) for i in range(600) for k in ("a", "b") if rng.random() < 0.7]
    got = {(r["k"], r["i"]): r["accepted"] for r in gate.rate_limit(spark.createDataFrame(rows, "k string, ms long, i long"), "k", "ms", "i").collect()}
    want = {}
    for key in ("a", "b"):
        kept = []
        for _, ms, i in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:]):
            kept = [t for t in kept if t > ms - 10_000]
            want[key, i] = len(kept) < 10
            kept += [ms] * want[key, i]
    assert got == want


def test_rate_limit_in_pieces(spark):
    rng = random.Random(2)
    rows, t = [], 0
    for i in range(900):
        t += rng.choice([0, 1, 300, 900, 2000, 25_000])
        rows.append((rng.choice([None, 1, 1, 1, 2]), t - 3_000_000, i))
    df = spark.createDataFrame(rows, "k long, ms long, i long").repartition(3)
    cut = gate.pieces(df, "k", "ms")
    assert cut.filter("_key = 1").select("_piece").distinct().count() > 20
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    used = gate.rate_limit(df, "k", "ms", "i").withColumn("task", F.spark_partition_id()).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r["task"] for r in used if r["k"] == 1}) == 4
    want = {}
    for key in (None, 1, 2):
        kept = []
        for _, ms, i in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:]):
            kept = [x for x in kept if x > ms - 10_000]
            want[i] = len(kept) < 10
            kept += [ms] * want[i]
    assert {r["i"]: r["accepted"] for r in used} == want and not all(want.values())


@pytest.mark.parametrize(("regex", "reason"), [
    ("(a|a)*b", "exponential backtracking"), ("([a-z]|[a-y])*#", "exponential backtracking"), ("(a+)+$", "nested quantifier"), ("(a{2,5})+", "nested quantifier"), ("a{1,50}a{1,50}a{1,50}b", "backtracking of degree 2"),
    (".*a.*b.*c", "backtracking of degree 2"), ("(?:ab|a|b)*c", "exponential backtracking"), ("(a?){30}a{30}", "pattern too complex"), (r"(a)\1*b", "exponential backtracking"), ("x*", "pattern matches empty string"), ("(", "invalid regex pattern"), ("a" * 201, "pattern too long"),
    ("(?:a|ab)*c", None), (r"\bCustomer#\d{9}\b", None), ("foo.{3,60}bar", None), (r"\w+@\w+\.com", None), ("a*a*b", None), ("[A-Z]{3}-[0-9]{4,}", None), ("(?:foo|bar)[0-9]", None),
])
def test_regexes_are_admitted_by_their_ambiguity(spark, regex, reason):
    df = spark.createDataFrame([(regex,)], "regex_source string")
    assert induce.admitted(df).first()["reason"] == reason


def test_mandatory_strings():
    from anonspark.functions.regexes import mandatory

    for regex, want in ((r"foo(?:bar|baz)\d", (("foobar", "foobaz"),)), (r"[Aa]cme\s+Corp", (("acme",), ("corp",))), ("x{3,}y", (("xxx",),)), ("(?:abc|d)x", ()), ("a|bcd", ()), ("(?:abc)?", ()), ("(?!abc)d", ()), ("Éabc", (("abc",),)), ("(?:abcd|efgh)+z", (("abcd", "efgh"),)), ("[^a]bcd", (("bcd",),))):
        assert mandatory(regex) == want, regex
    rng = random.Random(3)
    for _ in range(400):  # every match holds a string of each clause
        piece = lambda: rng.choice(["ab", "c", "[cd]", "(?:ab|cd)", "d+", "(?:abc){2}", "a?", ".", r"\w", "(?:b|cc)d", "ba{2,3}"])  # noqa: B023, E731
        regex = "".join(piece() for _ in range(rng.randint(2, 7)))
        text = "".join(rng.choice("aabbccdd") for _ in range(60))
        for m in re.finditer(regex, text, re.I):
            assert all(any(s in m[0] for s in clause) for clause in mandatory(regex)), (regex, m[0])


def test_one_pass_over_many_literals():
    from anonspark.functions.automaton import Strings, low

    rng = random.Random(4)
    words = ["".join(rng.choice("abAB") for _ in range(rng.randint(1, 4))) for _ in range(30)]
    text = "".join(rng.choice("abAB ") for _ in range(300))
    want = [(n, m.start(), m.end()) for n, w in enumerate(words) for m in re.finditer(re.escape(low(w)), low(text))]
    assert Strings((w, n) for n, w in enumerate(words)).places(text) == want
    assert Strings([]).places("x") == [] and Strings([("x", 0)]).numbers(None) == []


@pytest.mark.parametrize(("examples", "want"), [
    (["INC-12345", "INC-99001", "INC-00007"], r"\bINC-\d{5}\b"), (["INC-1", "INC-22"], None), (["a", "b", "c"], None),
    (["host01.corp", "host02.corp", "host11.corp"], r"\bhost\d{2}\.corp\b"), (["12345", "99001", "11111"], None),
])
def test_induction(spark, examples, want):
    df = spark.createDataFrame([("c", e) for e in examples], "category string, value string")
    got = [r["regex_source"] for r in induce.induce(df, ["category"]).collect()]
    if want:
        assert got == [want]
        assert all(re.search(want, e) for e in examples)
    else:
        assert got == []


def test_pattern_life(spark):
    known = spark.createDataFrame([("t", f"INC-{i:05d}") for i in range(40)] + [("u", "x")], "category string, real_value string")
    values = known.withColumnRenamed("real_value", "value")
    found = induce.suggest(known)
    table, stored = induce.persist(spark.createDataFrame([], SCHEMAS["induced_patterns"]), found, now(), values)
    rows = [tuple(r) for r in table.collect()]
    stored = spark.createDataFrame([tuple(r) for r in stored.collect()], SCHEMAS["pattern_examples"])
    table = spark.createDataFrame(rows, SCHEMAS["induced_patterns"])
    again = induce.persist(table, found, now(), values)
    assert table.count() == 1 and again[0].count() == 1 and again[1].count() == 0
    assert sorted(r["example"] for r in stored.collect()) == [f"INC-{i:05d}" for i in range(40)]
    for regex, want in (("zzz", rows[0][2]), (r"\bINC-000[0-2]\d\b", rows[0][2]), (r"\bINC-\d+\b", r"\bINC-\d+\b")):  # all examples decide
        assert induce.decide(table, spark.createDataFrame([(rows[0][0], "edit", regex)], "id long, action string, regex string"), stored).first()["regex_source"] == want
    assert induce.decide(table, spark.createDataFrame([(rows[0][0], "edit", "zzz")], "id long, action string, regex string"), stored.limit(0)).first()["regex_source"] == rows[0][2]
    i = rows[0][0]
    done = induce.decide(table, spark.createDataFrame([(i, "activate", None)], "id long, action string, regex string"), stored)
    assert done.first()["status"] == "active"
    assert induce.decide(table, spark.createDataFrame([(i, "delete", None)], "id long, action string, regex string"), stored).count() == 0
    assert induce.decide(table, spark.createDataFrame([(i, "edit", "(a+)+")], "id long, action string, regex string"), stored).first()["regex_source"] == rows[0][2]
    examples = induce.examples_of(table, spark.createDataFrame([("t", "INC-00001"), ("t", "other"), ("v", "INC-00002")], "category string, value string"))
    assert [tuple(r) for r in examples.collect()] == [(i, "INC-00001")]
    for regex, want in ((r"\bINC-\d+\b", r"\bINC-\d+\b"), (r"\bINC-2\d*\b", rows[0][2])):
        done = induce.decide(table, spark.createDataFrame([(i, "edit", regex)], "id long, action string, regex string"), examples)
        assert done.first()["regex_source"] == want
    hits = spark.createDataFrame([(1, i), (1, i), (2, i)], "doc_id long, source long")
    assert induce.bump_hits(table, hits).first()["hit_count"] == 2


def test_chunks_cover_the_text():
    rng = random.Random(4)
    for _ in range(50):
        text = "".join(rng.choice(["word", " ", "\n", "\n\n", "x" * 40]) for _ in range(rng.randint(0, 900)))
        at = 0
        for chunk in judge.chunk_text(text, 400):
            found = text.find(chunk, max(0, at - 700))
            assert found >= 0 and len(chunk) <= max(400, len(text) if len(text) <= 400 else 0) and not text[at:found].strip()[: max(0, found - at)]
            at = max(at, found + len(chunk))
        assert len(text[at:].strip()) < judge.LEAST + judge.OVERLAP


def test_second_opinion(spark, words):
    long = "\n\n".join("paragraph %d with some words" % i + " filler" * 30 for i in range(40))
    cut = judge.chunk_text(long)
    assert all(len(c) <= 1800 for c in cut) and cut[0][-40:] in long and all(w in " ".join(cut) for w in ("paragraph 0 ", "paragraph 39 "))
    assert len(judge.chunk_text("x" * 5000)) == 3 and judge.chunk_text("a" * 10 + " " + "b" * 4000)[0].startswith("a")
    rows = [(1, 0, '```json\n{"suspicious_spans":[{"text":"Jane Doe","category":"person","confidence":0.9,"reason":"r"},{"text":"Server_3","category":"org","confidence":0.9,"reason":"r"},{"text":"{IP}","category":"org","confidence":0.9,"reason":"r"}]}\n```', None), (1, 1, '[{"text":"Jane Doe","category":"zzz","confidence":0.9,"reason":"r"},{"text":"ACME","category":"org","confidence":0.9,"reason":"r"},{"text":"low","category":"org","confidence":0.2,"reason":"r"}]', None), (2, 0, "nope", None), (3, 0, None, "timeout")]
    answers = judge.parsed(spark.createDataFrame(rows, "doc_id long, chunk_idx int, response string, error string"))
    spans = judge.capped(judge.valid_spans(answers, words))
    assert [(r["doc_id"], r["text"], r["category"]) for r in spans.collect()] == [(1, "Jane Doe", "person")]
    got = {r["doc_id"]: (r["suspicious_count"], r["failed"]) for r in judge.verdicts(answers, spans).collect()}
    assert got == {1: (1, False), 2: (0, True), 3: (0, True)}
    why = {r["doc_id"]: (r["error_reason"], r["n_failed"], r["n_chunks"]) for r in judge.verdicts(answers, spans).collect()}
    assert why == {1: (None, 0, 2), 2: ("parse_failed: not JSON", 1, 1), 3: ("llm_failed: timeout", 1, 1)}
    rows = judge.review_rows(spans, spark.createDataFrame([(1, "see Jane Doe there")], "doc_id long, scrubbed string"), "scrub").collect()
    assert rows[0]["surrounding"] == "see Jane Doe there" and rows[0]["source_event"] == "judge:scrub"


def test_spans_are_made_once_for_the_queue(spark, words):
    made = spark.sparkContext.accumulator(0)

    def make(span):
        made.add(1)
        return span.title()

    allow = spark.createDataFrame([("^Quiet", True)], "pattern string, is_regex boolean")
    rows = spark.createDataFrame([("new corp",), ("acme",), ("quiet inc",)], "span string")
    spans = rows.select(F.udf(make)("span").alias("span"), F.lit("ctx").alias("surrounding"), F.lit("customer").alias("suggested_cat"), F.lit(0.6).alias("confidence"), F.lit("scrub").alias("source_event"))
    queue = review.enqueue(spark.createDataFrame([], SCHEMAS["review_queue"]), spans, words, allow, now())
    assert [(r["span"], r["surrounding"]) for r in queue.collect()] == [("New Corp", "ctx")]
    assert made.value == 3


def test_answers_are_parsed_once_and_in_many_tasks(spark, words, tmp_path):
    answer = '[{"text":"Jane Doe","category":"person","confidence":0.9,"reason":"r"}]'
    texts = [answer, "```json\n" + answer + "\n```", " " + answer + "\n```  ", "```JSON" + answer, "[]", "{}", "nope", None]
    spark.createDataFrame([(i, 0, t, None) for i, t in enumerate(texts)], "doc_id long, chunk_idx int, response string, error string").coalesce(1).write.parquet(str(tmp_path / "answers"))
    answers = judge.parsed(spark.read.parquet(str(tmp_path / "answers")))
    spans = judge.valid_spans(answers, words)
    assert sorted(r["doc_id"] for r in spans.collect()) == [0, 1, 2, 3]
    assert [r["doc_id"] for r in answers.filter("error_reason IS NOT NULL").collect()] in ([6, 7], [7, 6])
    assert answers.rdd.getNumPartitions() > 1
    assert spans._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_admission_looks_at_a_shape_once_and_in_many_tasks(spark, tmp_path):
    from anonspark.functions import regexes

    seen = regexes._growth.cache_info().misses
    assert {regexes.fault(f"[p-t]+[p-t]+v{i}") for i in range(50)} == {regexes.fault("[p-t]+[p-t]+")}
    assert regexes._growth.cache_info().misses == seen + 1
    assert regexes.growth(r"(?:a|a\x61k1)*b1") == 0 and regexes.growth("(?:a|a)*k1") == -1 and regexes.growth(".*a.*k") == regexes.growth(".*a.*")
    spark.createDataFrame([("a+b",)] * 8, "regex_source string").coalesce(1).write.parquet(str(tmp_path / "one"))
    assert induce.admitted(spark.read.parquet(str(tmp_path / "one"))).rdd.getNumPartitions() > 1


def test_literal_hits_travel_as_whole_numbers(spark, monkeypatch):
    """No structs come back from the workers; hits are those of the literals' places."""
    from anonspark.config import ScrubConfig
    from anonspark.operators import detect as D

    docs = spark.createDataFrame([(1, "\U0001f600 Ab ab-x ABC"), (2, None), (3, ""), (4, "none")], "doc_id long, text string")
    literals = (("ab", "My kind"), ("x abc", "odd"))
    kinds, once = [], D._once
    monkeypatch.setattr(D, "_once", lambda docs, make, use, kind: kinds.append(kind) or once(docs, make, use, kind))
    got = D.detect(docs, config=ScrubConfig(literals=literals)).filter("rank = 3")
    assert kinds == ["array<int>"]
    rows = sorted((r["doc_id"], r["match_idx"], r["value"], r["type"], r["category"], r["confidence"]) for r in got.collect())
    assert rows == [(1, 0, "Ab", "MY_KIND", "my kind", 1.2), (1, 1, "ab", "MY_KIND", "my kind", 1.2), (1, 2, "AB", "MY_KIND", "my kind", 1.2), (1, 3, "x ABC", "ODD", "odd", 1.2)]
