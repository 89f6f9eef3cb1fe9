import hashlib
import math
import random

import numpy as np
import pytest

from anonspark.llm import queries, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows, parts=16, entries=64, rounds=2):
    """Plain loops over whole numbers."""
    kept = [(i, v, c) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ints = [[math.floor(256 * float(np.float32(x))) for x in v] for _, v, _ in kept]
    if not kept:
        return []
    width = len(ints[0]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))[:entries]
    books = [[cut(ints[r], p) for r in order] for p in range(parts)]

    def assign():
        out = []
        for v in ints:
            best = []
            for p in range(parts):
                d = [sum((a - b) ** 2 for a, b in zip(cut(v, p), e)) for e in books[p]]
                best.append((d.index(min(d)), min(d)))
            out.append(best)
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(v, p) for v, f in zip(ints, found) if f[p][0] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    found = assign()
    errors = [sum(d for _, d in f) for f in found]
    per = {}
    for (_, _, label), error in zip(kept, errors):
        per[label] = per.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{c:02x}" for c, _ in f), e, per[label], digest) for (i, _, label), f, e in zip(kept, found, errors)]


def key(row):
    return str(tuple(row))


def vectors(n=300, dims=32, seed=1):
    rng = random.Random(seed)
    rows = [(i * 3 + 1, [rng.gauss(0, 0.4) for _ in range(dims)], rng.choice([0, 1, 2, None])) for i in range(n)]
    rows += [(7, rows[5][1], 1), (7, rows[5][1], 1), (1, rows[9][1], 2), (None, rows[3][1], 0), (None, None, None)]  # repeated rows and ids
    bad = list(rows[0][1])
    for value in (None, float("nan"), float("inf"), float("-inf")):
        bad[4] = value
        rows.append((5, list(bad), 1))
    rows += [(900 + i, [0.25] * dims, None) for i in range(40)]  # ties
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n", [300, 20, 0])
def test_equals_plain_loops(spark, n):
    rows = vectors(n) if n else [(1, None, 1), (None, [None] * 32, None)]
    if n == 20:
        rows = [r for r in rows if r[0] is None or r[0] < 40]  # fewer vectors than entries
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [tuple(r) for r in vector_codes.compressed(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]
    assert sorted(got, key=key) == sorted(slow(rows), key=key)


def test_query_reads_the_whole_table(spark, sf):
    got = queries.QUERIES["op13_vector_codes"](spark, sf)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    found = [tuple(r) for r in got.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]
    assert sorted(found) == sorted(slow(rows))


def test_dictionaries_give_the_same_distances():
    rng = np.random.default_rng(2)
    block, books = rng.integers(-300, 300, (500, 8)), rng.integers(-300, 300, (2, 9, 4))
    code, least = vector_codes.nearest(block, books)
    for p in range(2):
        d = ((block[:, None, 4 * p : 4 * p + 4] - books[p][None]) ** 2).sum(axis=2)
        assert (code[:, p] == d.argmin(axis=1)).all() and (least[:, p] == d.min(axis=1)).all()


def test_decoding_is_within_the_error(spark):
    rows = [r for r in vectors(100) if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    df = spark.createDataFrame(rows, SCHEMA)
    ints = vector_codes.kept_rows(df)
    books = vector_codes.codebooks(ints)
    for r in vector_codes.decode(vector_codes.encode(ints, books), books).collect():
        assert sum((a - 256 * b) ** 2 for a, b in zip(r["embedding"], r["vector"])) == r["error"]


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, [0.5] * 16, 1, "x", 2, "y")], SCHEMA + ", code string, error int, _coded string")
    assert vector_codes.compressed(df).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert vector_codes.compressed(spark.createDataFrame([], SCHEMA)).count() == 0
    coded = vector_codes.encode(vector_codes.kept_rows(df), np.zeros((16, 1, 1), np.int64), code="c", error="e")
    assert {"code", "error", "_coded", "c", "e"} <= set(coded.columns) and coded.first()["code"] == "x"
    for bad in ([0.5] * 15, [1e9] * 16):
        with pytest.raises(Exception):
            vector_codes.compressed(spark.createDataFrame([(1, bad, 1)], SCHEMA)).collect()
