"""Sharding by extendible hashing.

The directory is addressed by the leading bits of a hash of the key. A bucket that
holds more bytes than the limit is split on its next bit, and only that bucket, until
every bucket fits or holds a single key. A histogram of hash cells (a few per shard)
decides most splits; the keys of cells that are still too large are counted again, some
bits deeper each time, so the rows themselves are read once for the histogram, once more
where such cells exist, and once to look them up.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, id_hash, saved, small, text_bytes

HASH_BITS = 60
#: Bits below the expected depth of the histogram's cells, and bits that each further round adds.
CELL_BITS, ROUND_BITS = 6, 8
SHARD_BYTES = 16 << 20
#: A table of less than so many full shards is cut finer, so that as many readers have work.
LEAST_SHARDS = 64
#: Levels of the directory that are summed from one level of cells.
_STRIDE = 6
#: Largest directory (in entries) that is broadcast.
DIRECTORY_ENTRIES = 1 << 19


def _levels(cells: DataFrame, top: int, bottom: int) -> DataFrame:
    """(depth, prefix, b, n, lo, hi) of all buckets of the depths top to bottom, from stored
    cells (prefix, b, n, lo, hi) of the depth bottom. A few levels at a time are summed from
    the deepest of them, so no cell is counted at every level."""
    sums = [F.sum("b").alias("b"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    out = None
    while True:
        first = max(top, bottom - _STRIDE + 1)
        each = cells.select(F.explode(F.sequence(F.lit(first), F.lit(bottom))).alias("depth"), "prefix", "b", "n", "lo", "hi")
        part = each.groupBy("depth", F.expr(f"shiftright(prefix, {bottom} - depth)").alias("prefix")).agg(*sums)
        out = part if out is None else out.unionByName(part)
        if first == top:
            return out
        cells = cells.groupBy(F.shiftright("prefix", bottom - first + 1).alias("prefix")).agg(*sums)
        bottom = first - 1


def build_directory(sizes: DataFrame, byte_limit: int, least_shards: int = 1) -> tuple[DataFrame, int, int]:
    """The leaves of the directory of `sizes` (h long, n_bytes long): a stored table (depth,
    prefix, b, n), the limit, and the depth at which the leaves would fit if all were alike.

    The limit is byte_limit, or less where that gives fewer than least_shards full shards. A
    leaf holds at most the limit or a single key; see assign_shards for the latter.
    """
    total = sizes.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("b")).first()["b"]
    limit = max(1, min(byte_limit, total // least_shards))
    expected = min(HASH_BITS, max(0, math.ceil(math.log2(max(1.0, total / limit)))))
    bottom, top, leaves = min(HASH_BITS, expected + CELL_BITS), 0, None
    rows = sizes.select("h", F.col("n_bytes").alias("b"), F.lit(1).cast("long").alias("n"))
    over = (F.col("b") > limit) & (F.col("lo") < F.col("hi"))
    while True:
        cells = rows.groupBy(F.shiftright("h", HASH_BITS - bottom).alias("prefix")).agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        levels = saved(_levels(saved(cells, "cells"), top, bottom), "levels")
        split = levels.filter(over).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"))
        ends = levels.filter(~over).withColumn("above", F.shiftright("prefix", 1))
        below = ends.filter(F.col("depth") > top).join(split, ["depth", "above"], "left_semi")
        found = below.unionByName(ends.filter(F.col("depth") == top).select(*below.columns)).select("depth", "prefix", "b", "n")
        leaves = found if leaves is None else leaves.unionByName(found)
        wide = levels.filter(over).filter(F.col("depth") == bottom).select(F.col("prefix").alias("cell"))
        count = wide.count()
        if not count:
            return saved(leaves, "directory"), limit, expected
        # the keys of these cells, each once; what a bucket at the next depth has above it was too large
        inner = rows.withColumn("cell", F.shiftright("h", HASH_BITS - bottom)).join(small(wide, count), "cell", "left_semi")
        rows = saved(inner.groupBy("h").agg(F.sum("b").alias("b"), F.sum("n").alias("n")), "keys")
        top, bottom = bottom + 1, min(HASH_BITS, bottom + ROUND_BITS)


def assign_shards(docs: DataFrame, byte_limit: int = SHARD_BYTES, key: str = "doc_id", text: str = "text", least_shards: int = 1) -> DataFrame:
    """docs with the columns (under a longer name if docs has one of that name) shard (the
    bits of the directory entry, then ".k" for the k-th part of an entry of one key),
    shard_depth and n_bytes.

    Every shard holds at most `byte_limit` bytes of text (less for a table of fewer than
    least_shards such shards), but for a single row that is larger by itself, which gets a
    shard of its own. A null text has 0 bytes, a very long one its own; a null key counts as
    empty text. Rows that repeat a key share a hash, so an entry of one key may be too large:
    its rows are laid end to end in an order of (scan task, row) and cut at the limit, with
    one running sum per task and one over the tasks' totals, so no group is gathered in one
    place. An empty table gives an empty table.

    A directory of up to DIRECTORY_ENTRIES entries is broadcast; above, rows are exchanged by
    their slot, as they have to be when the shards are written.
    """
    if byte_limit < 1 or least_shards < 1:
        raise ValueError("byte_limit and least_shards must be positive")
    h, size, slot, shard, part_depth, over, first, last = fresh(docs.columns, "_h", "n_bytes", "_slot", "shard", "shard_depth", "_over", "_first", "_last")
    rows = docs.withColumns({h: id_hash(key), size: text_bytes(text)})
    leaves, limit, slots = build_directory(rows.select(F.col(h).alias("h"), F.col(size).alias("n_bytes")), byte_limit, least_shards)
    start = F.expr(f"shiftleft(prefix, {HASH_BITS} - depth)")
    end = F.expr(f"shiftleft(prefix + 1, {HASH_BITS} - depth) - 1")
    cut = (F.col("b") > limit) & (F.col("n") > 1)
    table = leaves.select(start.alias(first), end.alias(last), F.col("depth").alias(part_depth), cut.alias(over))
    # an entry is looked up by the slots that it covers, and told from others of its slot by its range
    covered = F.sequence(F.shiftright(first, HASH_BITS - slots), F.shiftright(last, HASH_BITS - slots))
    table = saved(table.withColumn(slot, F.explode(covered)), "slots")
    found = rows.withColumn(slot, F.shiftright(h, HASH_BITS - slots)).join(small(table, table.count(), DIRECTORY_ENTRIES), slot).filter(F.col(h).between(F.col(first), F.col(last)))
    bits = F.expr(f"substring(lpad(bin({h}), {HASH_BITS}, '0'), 1, {part_depth})")
    placed = found.drop(slot, first, last).withColumn(shard, bits)
    order = [*docs.columns, size, shard, part_depth]
    if leaves.filter(cut).isEmpty():
        return placed.select(*order)
    whole = placed.filter(~F.col(over)).select(*order)
    return whole.unionByName(_cut(placed.filter(F.col(over)).drop(over), h, size, shard, limit).select(*order))


def _cut(rows: DataFrame, h: str, size: str, shard: str, byte_limit: int) -> DataFrame:
    """Rows of entries of one key, cut by running sums. A row of over half
    the limit is a part of its own; the others fill parts of half the limit and at most
    one row more."""
    half = max(1, byte_limit // 2)
    task, seq, start, before, own, sum_ = fresh(rows.columns, "_task", "_seq", "_start", "_before", "_own", "_sum")
    rows = saved(rows.withColumns({task: F.spark_partition_id(), seq: F.monotonically_increasing_id(), own: F.col(size) > half}), "oversized")
    in_task = Window.partitionBy(shard, own, task).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    weight = F.when(F.col(own), F.lit(half)).otherwise(F.col(size))
    totals = rows.groupBy(shard, own, task).agg(F.sum(weight).alias(sum_))
    across = Window.partitionBy(shard, own).orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(shard, own, task, F.coalesce(F.sum(sum_).over(across), F.lit(0)).alias(before))
    rows = rows.withColumn(start, F.coalesce(F.sum(weight).over(in_task), F.lit(0))).join(totals, [shard, own, task])
    part = F.floor((F.col(start) + F.col(before)) / half)
    label = F.concat(shard, F.lit("."), F.when(F.col(own), F.lit("x")).otherwise(""), part.cast("string"))
    return rows.withColumn(shard, label).drop(h, task, seq, start, before, own)


def shard_report(docs: DataFrame, byte_limit: int = SHARD_BYTES, least_shards: int = LEAST_SHARDS) -> DataFrame:
    """Per document: doc_id, shard, shard_depth, n_bytes."""
    return assign_shards(docs.select("doc_id", "text"), byte_limit, least_shards=least_shards).select("doc_id", "shard", "shard_depth", "n_bytes")


#: Entries of one key that are too large are not cut in SQL; doc_id is unique in the tables.
SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, COALESCE(strlen(text), 0) AS b,
         ('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h FROM documents),
lim AS (SELECT greatest(1, least({SHARD_BYTES}, CAST(SUM(b) AS BIGINT) // {LEAST_SHARDS})) AS most FROM d),
leaf AS (
  SELECT doc_id, b, h, 0 AS depth, SUM(b) OVER () AS total, MIN(h) OVER () AS lo, MAX(h) OVER () AS hi, most FROM d, lim
  UNION ALL
  SELECT doc_id, b, h, depth + 1, SUM(b) OVER w, MIN(h) OVER w, MAX(h) OVER w, most FROM leaf WHERE total > most AND lo < hi
  WINDOW w AS (PARTITION BY h >> ({HASH_BITS} - depth - 1)))
SELECT doc_id, substr(lpad(bin(h), {HASH_BITS}, '0'), 1, depth) AS shard,
       depth AS shard_depth, CAST(b AS BIGINT) AS n_bytes
FROM leaf WHERE total <= most OR lo = hi
"""
