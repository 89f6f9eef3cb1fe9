import random

import pytest

from anonspark.llm import decontam


def slow_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        new = [i + 1]
        for j, c in enumerate(text):
            new.append(min(row[j] + (p != c), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_myers_equals_the_table():
    rng = random.Random(1)
    for _ in range(400):
        p = "".join(rng.choice("abé") for _ in range(rng.randint(1, 90)))
        t = "".join(rng.choice("abé") for _ in range(rng.randint(0, 120)))
        assert decontam.edit_distance(p, t, 1000) == slow_distance(p, t)


def _edit(rng, s, k):
    s = list(s)
    for _ in range(k):
        i = rng.randrange(len(s))
        match rng.randint(0, 2):
            case 0: s[i] = rng.choice("xyzé")
            case 1: s.insert(i, rng.choice("xyzé"))
            case _: del s[i]
    return "".join(s)


def test_matches_equal_all_distances(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("aeiouthrné") for _ in range(rng.randint(1, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randint(2, 30))).capitalize()) for i in range(25)] + [(90, "ab"), (91, None), (92, " "), (93, items_text := "same text of an item here")]
    items.append((94, items_text))
    docs = []
    for i in range(120):
        body = [word() for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.7:
            name, text = items[rng.randrange(25)]
            clean = decontam.normalised(text)
            body.insert(rng.randint(0, len(body)), _edit(rng, text, rng.randint(0, decontam.budget(len(clean)) + 2)).replace(" ", rng.choice([" ", "\n", "  "])))
        docs.append((i, " ".join(body)))
    docs += [(500, items_text.upper()), (501, "cab"), (502, None)]
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=500).collect()}
    want = {}
    for d, t in docs:
        for i, item in items:
            p = decontam.normalised(item)
            if p and t is not None:
                e = slow_distance(p, decontam.normalised(t))
                if e <= decontam.budget(len(p)):
                    want[d, i] = e
    assert got == want and len(got) > 40


@pytest.mark.parametrize("k", [0, 1, 5, 30])
def test_pieces_cover_the_item(k):
    item = "é" * 7 + "abc " * 100
    edges = decontam.cut(item, k)
    assert len(edges) == k + 2 and edges[0] == 0 and edges[-1] == len(item) and max(b - a for a, b in zip(edges, edges[1:])) - min(b - a for a, b in zip(edges, edges[1:])) <= 1


def test_runs_are_the_halves_around_a_piece():
    for pieces in range(1, 40):
        for j in range(pieces):
            runs = decontam.runs_around(j, pieces)
            assert all(lo <= j < hi and hi - lo < pieces for lo, hi in runs)
            sizes = [1, *[hi - lo for lo, hi in runs], pieces]
            assert all(b <= 2 * a + 1 for a, b in zip(sizes, sizes[1:]))


@pytest.mark.parametrize("size", [3, 5, 9, 10, 16, 20, 23, 30, 47, 80, 200])
def test_every_size_has_its_whole_budget(size):
    rng = random.Random(size)
    item = "".join(rng.choice("abcdefgh") for _ in range(size))
    k = size // 10
    assert decontam.budget(size) == k
    matcher = decontam.Matcher([(1, item)])
    for _ in range(60):
        near = _edit(rng, item, k) if k else item
        text = "".join(rng.choice("abcdefgh") for _ in range(30)) + near + "".join(rng.choice("abcdefgh") for _ in range(30))
        assert matcher.search([text]) == [{0: slow_distance(item, text)}]


def test_long_texts_ties_and_repeats(spark):
    item = "a passage of the benchmark that is hidden in a long text"
    near = item.replace("hidden", "hiden")
    bench = spark.createDataFrame([(1, item), (1, item), (2, item.upper())], "item_id long, text string")
    far = "word " * 200_000
    docs = spark.createDataFrame([(1, far + near + " " + far + item), (2, far), (3, near + " " + near)], "doc_id long, text string")
    rows = {r["doc_id"]: (r["item_ids"], r["least_edits"]) for r in decontam.contamination(docs, bench).collect()}
    assert rows == {1: ("1,2", 0), 2: ("", None), 3: ("1,2", 1)}


def test_odd_rows(odd, none, spark, clashing):
    bench = spark.createDataFrame([(1, "quick BROWN fox jumps over"), (2, None), (None, "no id here")], "item_id long, text string")
    rows = decontam.contamination(odd, bench).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["contaminated"] and by[2]["item_ids"] == "1" and not by[3]["contaminated"] and by[4]["least_edits"] is None
    assert decontam.contamination(none, bench).count() == 0
    assert decontam.contamination(odd, bench.limit(0)).filter("contaminated").count() == 0
    kept = decontam.decontaminated(clashing, bench)
    assert kept.columns == clashing.columns and kept.count() == odd.count() - 3


def test_rows_of_one_id_are_decided_by_their_own_text(spark):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the dog")], "item_id long, text string")
    leak, clean = "see the quick brown fox jumps over the dog run", "nothing of the kind is here"
    docs = spark.createDataFrame([(None, leak), (None, clean), (5, leak), (5, clean), (6, None)], "doc_id long, text string")
    kept = decontam.decontaminated(docs, bench).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == [("5", clean), ("6", None), ("None", clean)]
    rows = decontam.contamination(docs, bench).collect()
    assert sorted((str(r["doc_id"]), r["n_items"]) for r in rows) == [("5", 0), ("5", 1), ("6", 0), ("None", 0), ("None", 1)]
