import hashlib
import random

import pytest

from anonspark.llm import sharding


def brute(rows, limit):
    """Split the set of all rows bit by bit, only where it is too large."""
    h = lambda k: int(hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()[:15], 16)
    out, todo = {}, [("", rows)]
    while todo:
        bits, part = todo.pop()
        if sum(len((t or "").encode()) for _, t in part) <= limit or len({k for k, _ in part}) == 1:
            out[bits] = sorted((str(k), t) for k, t in part)
            continue
        for b in "01":
            todo.append((bits + b, [r for r in part if format(h(r[0]), "060b").startswith(bits + b)]))
    return {b: p for b, p in out.items() if p}


def test_equals_bitwise_splitting(spark):
    rng = random.Random(1)
    rows = [(i, "é" * rng.randint(0, 60)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in sharding.assign_shards(df, 1500).collect():
        assert r["shard_depth"] == len(r["shard"]) and r["n_bytes"] == len(r["text"].encode())
        got.setdefault(r["shard"], []).append((str(r["doc_id"]), r["text"]))
    assert {k: sorted(v) for k, v in got.items()} == brute(rows, 1500)


def _h(key):
    return format(int(hashlib.md5(str(key).encode()).hexdigest()[:15], 16), "060b")


def test_rows_that_share_many_bits_are_split_on_the_next(spark):
    by = {}
    pair = next((by[b], k) for k in range(20_000) if (b := _h(k)[:18]) in by or by.setdefault(b, k) is None)
    rows = [(k, "x" * 90) for k in pair] + [(100_000 + i, "y") for i in range(50)]
    done = {r["doc_id"]: r for r in sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 100).collect()}
    a, b = (done[k]["shard"] for k in pair)
    assert a != b and a[:-1] == b[:-1] and len(a) > 18 and "." not in a + b
    big = spark.createDataFrame([(39, "x" * 90), (40, "x" * 90), (41, "x" * 500)], "doc_id long, text string")
    got = {r["shard"]: r["doc_id"] for r in sharding.assign_shards(big, 100).collect()}
    assert len(got) == 3 and all("." not in s for s in got) and got == {k: int(v[0][0]) for k, v in brute([(r["doc_id"], r["text"]) for r in big.collect()], 100).items()}


def test_few_rows_are_dealt_to_many_readers(spark):
    df = spark.createDataFrame([(i, "x" * 10) for i in range(2000)], "doc_id long, text string")
    done = sharding.shard_report(df)
    assert done.select("shard").distinct().count() >= 64
    assert max(r["b"] for r in done.groupBy("shard").agg({"n_bytes": "sum"}).withColumnRenamed("sum(n_bytes)", "b").collect()) <= 20_000 // 64


def test_hot_key_is_cut_by_running_sums(spark):
    rows = [(7, "x" * 10)] * 500 + [(7, "y" * 300)] + [(i, "z" * 10) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    done = sharding.assign_shards(df, 200).collect()
    assert len(done) == len(rows)
    sizes, n = {}, {}
    for r in done:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["n_bytes"]
        n[r["shard"]] = n.get(r["shard"], 0) + 1
    assert all(s <= 200 or n[k] == 1 for k, s in sizes.items())


def test_odd_rows(odd, none, clashing):
    assert sharding.shard_report(odd).count() == odd.count()
    assert sharding.shard_report(none).count() == 0
    done = sharding.assign_shards(clashing, 100)
    assert done.count() == odd.count() and len(set(done.columns)) == len(done.columns)
    with pytest.raises(ValueError):
        sharding.assign_shards(odd, 0)
