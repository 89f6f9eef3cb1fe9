import pytest

from anonspark.config import ColumnRule, ScrubConfig
from anonspark.operators import tables as T
from anonspark.sources import readers


@pytest.fixture(scope="module")
def contacts(spark):
    rows = [(1, "a@x.org", "555-123-4567", "mail b@x.org now", 7, None), (2, "A@X.org", None, None, 8, "Bob Lee"), (3, " ", "none", "a@x.org", 9, "bob lee")]
    return spark.createDataFrame(rows, "row long, Email string, Phone string, Notes string, ID int, Name string")


@pytest.mark.parametrize(("header", "want"), [("E-Mail", "Email"), ("mobile no", "Phone"), ("IP", "IPv4"), ("ship", None), ("Full Name", "PersonName"), ("hostname", "FQDN"), ("hosts", None), ("  ", None), ("SSN#", "SSN")])
def test_headers(header, want):
    assert T.resolve_column(header)[0] == want


def test_rules_come_first():
    rules = (ColumnRule("(", "Email", True), ColumnRule("misc", "GUID"), ColumnRule("^cust", "Email", True))
    assert T.resolve_column("Misc", rules) == ("GUID", "rule") and T.resolve_column("Customer Phone", rules) == ("Email", "rule")
    assert T.resolve_column("Phone", rules, False) == (None, "unresolved")


def test_labels_and_overrides():
    assert T.normalize_custom_label(" my-label 1 ") == "MY_LABEL_1" and T.normalize_custom_label("1x") is None and T.normalize_custom_label("x" * 30) is None
    for bad in ({"kind": "?"}, {"kind": "pattern", "pattern": "Nope"}, {"kind": "custom", "label": "!"}):
        with pytest.raises(ValueError):
            T.validate_overrides({"c": bad})
    plan = T.plan_columns(["Email", "Notes", " "], ScrubConfig(), {"Email": {"kind": "skip"}, "Notes": {"kind": "custom", "label": "note"}})
    assert plan == {"Email": ("skip", ""), "Notes": ("custom", "NOTE"), " ": ("skip", "")}


def test_inspect(contacts):
    got = {r["header"]: (r["resolved_pattern"], r["sample_value"], r["row_count"]) for r in T.inspect_table(contacts, "t", "row").collect()}
    assert got == {
        "Email": ("Email", "a@x.org", 2), "Phone": ("Phone", "555-123-4567", 2), "Notes": (None, "mail b@x.org now", 2), "ID": (None, "7", 3), "Name": ("PersonName", "Bob Lee", 2)}


def test_scrub(contacts):
    done, tokens, summary = T.scrub_table(contacts, "t", "row")
    got = [tuple(r) for r in done.orderBy("row").collect()]
    assert got == [
        (1, "{EMAIL}", "{PHONE}", "mail {EMAIL_1} now", 7, None), (2, "{EMAIL}", None, None, 8, "{PERSON}"), (3, " ", "{PHONE_1}", "{EMAIL}", 9, "{PERSON}")]
    assert done.schema["ID"].dataType.simpleString() == "int"
    one = summary.first()
    assert one["rows"] == 3 and one["cells_scrubbed"] == 8 and "t::Email → Email" in one["columns_resolved"]


def test_tables_share_a_map(spark, contacts):
    other = spark.createDataFrame([(1, "see a@x.org")], "row long, Text string")
    done, _, _ = T.scrub_tables({"a": (contacts, "row"), "b": (other, "row")}, overrides={"a": {"ID": {"kind": "custom", "label": "ident"}}})
    assert done["b"].first()["Text"] == "see {EMAIL}"
    assert [r["ID"] for r in done["a"].orderBy("row").collect()] == ["{IDENT}", "{IDENT_1}", "{IDENT_2}"]


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("héllo")
    (tmp_path / "in/b.png").write_bytes(b"x")
    (tmp_path / "in/c.log").write_bytes(b"a\0b")
    (tmp_path / "in/d.csv").write_text('Email,Notes\na@x.org,"two\nlines"\n')
    rows = {r["name"]: (r["text"], r["error"]) for r in readers.read_text_corpus(spark, str(tmp_path / "in")).collect()}
    assert rows["a.txt"] == ("héllo", None) and rows["b.png"][1] == "unsupported file type" and rows["c.log"] == (None, "binary file")
    (tmp_path / "in/e.txt").write_bytes(b"0\nabc\x00def")  # a NUL byte that no odd place of the hex digits shows first
    (tmp_path / "in/f.note").write_text("typed")
    kinds = spark.createDataFrame([("f.note", "text/plain"), ("b.png", "image/png")], "name string, mime string")
    rows = {r["name"]: (r["text"], r["error"]) for r in readers.read_text_corpus(spark, str(tmp_path / "in"), kinds).collect()}
    assert rows["e.txt"] == (None, "binary file") and rows["f.note"] == ("typed", None) and rows["b.png"][1] == "unsupported file type"
    table = readers.read_table(spark, str(tmp_path / "in/d.csv"))
    assert [tuple(r) for r in table.collect()] == [("a@x.org", "two\nlines")]
    out = readers.write_scrubbed(table, str(tmp_path / "in/d.csv"))
    assert out.endswith("d.scrubbed.csv") and readers.read_table(spark, out).count() == 1
    (tmp_path / "ev").mkdir()
    (tmp_path / "ev/e.json").write_text('{"prompt":"hi"}\n{"tool_name":"Bash","tool_input":{"c":1}}\nnot json\n{"tool_result":"x","hook_event_name":"PostToolUse"}\n')
    assert sorted(r["kind"] for r in readers.read_events(spark, str(tmp_path / "ev")).collect()) == ["PostToolUse", "PreToolUse", "UserPromptSubmit"]


def test_columns_are_rewritten_by_their_dictionary(spark, monkeypatch):
    """Each distinct cell meets the map once; cells that are values don't, and rows are as cell by cell."""
    from pyspark.sql import functions as F

    from anonspark.operators import apply

    words = ["Ann", "ann lee", "x Ann Lee y", "ANN", " ", "", None, "annex", "b", "b Ann"]
    rows = [(i, words[i % 10], words[i * 7 % 10]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    pairs = [("Ann", "{P}"), ("ann Lee", "{P_1}"), ("b", "{P_2}"), (" ", "{P_3}")]
    tokens = spark.createDataFrame(pairs, "real_value string, token string")
    parts = F.array(*[F.struct(F.lit(i).alias("col"), F.col(c).alias("cell")) for i, c in enumerate("ab")])
    cells = df.select(F.explode(parts).alias("c")).select("c.*").filter("cell IS NOT NULL").distinct()
    searched, one = [], apply.Substitution(pairs)
    monkeypatch.setattr(apply, "apply_map", lambda docs, *rest, run=apply.apply_map: searched.extend(r["cell"] for r in docs.collect()) or run(docs, *rest))
    done = apply.apply_columns(df, cells, tokens, [("a", "na", False), ("b", "nb", True)]).collect()
    assert sorted(searched) == ["", "annex", "b Ann", "x Ann Lee y"]
    assert len(done) == 200 and all(r["na"] == one(r["a"]) and r["nb"] == one.whole(r["b"]) for r in done)
