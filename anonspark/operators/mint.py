"""Minting: the first sight of each value decides its type; tokens are numbered per type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anonspark.functions.patterns import TOKEN_PARTS, TOKEN_SHAPE
from anonspark.plans.storage import saved, small

VOCAB = (
    "real_value string, token string, category string, confidence double, first_seen long, last_seen long, "
    "hit_count long, project string, confirmed_by string"
)


def key_of(value: str | Column) -> Column:
    return F.lower(value)


def mintable(rows: DataFrame, value: str = "value") -> DataFrame:
    """Rows whose value is not shaped like a token and not empty."""
    return rows.filter(~F.col(value).rlike(TOKEN_SHAPE) & (F.col(value) != ""))


def first_by_key(rows: DataFrame, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """One row per key, the first by `order`, whose columns are kept. Partial minima before
    the shuffle take the weight off frequent values."""
    keys = keys or []
    rest = [c for c in rows.columns if c not in keys]
    rows = mintable(rows).withColumn("key", key_of("value"))
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_f")
    return rows.groupBy(*keys, "key").agg(first).select(*keys, "key", "_f.*")


def counters(vocab: DataFrame, token: str = "token") -> DataFrame:
    """(type, next_n): the number of the next token of each type that the vocabulary has."""
    number = F.regexp_extract(token, TOKEN_PARTS, 2)
    n = F.when(number == "", 0).otherwise(number.cast("long"))
    parts = vocab.filter(F.col(token).rlike(TOKEN_PARTS)).select(F.regexp_extract(token, TOKEN_PARTS, 1).alias("type"), n.alias("n"))
    return parts.groupBy("type").agg((F.max("n") + 1).alias("next_n"))


def token_text(type_: Column, n: Column) -> Column:
    return F.concat(F.lit("{"), type_, F.when(n > 0, F.concat(F.lit("_"), n.cast("string"))).otherwise(""), F.lit("}"))


#: Up to so many rows, places are numbered by one window for each type.
FEW = 100_000


def number_by_type(new: DataFrame, order: list[str]) -> DataFrame:
    """new with n, the row's place among those of its type in the given order, from 0.

    Few rows, by count, are numbered by a window; the places are the same either way.
    A sort over ranges of (type, order) puts each task in charge of a run of places; the
    runs' lengths, a few rows for each task, give each run its start. No task sees a type whole.
    """
    new = saved(new, "to_number")
    if new.count() <= FEW:
        return new.withColumn("n", (F.row_number().over(Window.partitionBy("type").orderBy(*order)) - 1).cast("long"))
    placed = new.repartitionByRange("type", *order).sortWithinPartitions("type", *order)
    placed = saved(placed.withColumn("_m", F.monotonically_increasing_id()), "numbered")
    task = F.shiftright("_m", 33)
    runs = placed.groupBy("type", task.alias("_task")).agg(F.min("_m").alias("_first"), F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy("type").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = saved(runs.select(F.col("type").alias("_type"), "_task", "_first", before.alias("_before")), "runs")  # types x tasks
    joined = placed.join(small(runs), (F.col("type") == F.col("_type")) & (task == F.col("_task")))
    return joined.withColumn("n", F.col("_m") - F.col("_first") + F.col("_before")).drop("_m", "_type", "_task", "_first", "_before")


def assign_tokens(firsts: DataFrame, vocab: DataFrame | None, order: list[str]) -> DataFrame:
    """firsts (key, value, type, …) with token, real_value and is_new: a known key keeps its
    token whatever its type; new ones continue the vocabulary's numbers."""
    if vocab is None:
        known, fresh = None, firsts
    else:
        old = vocab.filter(~F.col("real_value").rlike(TOKEN_SHAPE)).select(key_of("real_value").alias("key"), F.col("real_value").alias("real_value"), "token")
        old = old.groupBy("key").agg(F.min_by(F.struct("real_value", "token"), F.struct("token")).alias("_o")).select("key", "_o.*")
        known = firsts.join(old, "key").withColumn("is_new", F.lit(False))
        fresh = firsts.join(old, "key", "left_anti")
    numbered = number_by_type(fresh, order)
    if vocab is not None:
        numbered = numbered.join(small(saved(counters(vocab), "counters")), "type", "left").withColumn("n", F.col("n") + F.coalesce("next_n", F.lit(0))).drop("next_n")
    minted = numbered.withColumns({"token": token_text(F.col("type"), F.col("n")), "real_value": F.col("value"), "is_new": F.lit(True)}).drop("n")
    return minted if known is None else minted.unionByName(known)


def minted_tokens(hits: DataFrame, tokens: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per document its minted values: one struct per key in order of sight, new only in the
    first document that has it. doc: what tells documents apart, in hits and in tokens."""
    order = ["rank", "match_idx"]
    rows = mintable(hits).repartition(doc)  # once for both groupings
    seen = rows.withColumn("key", key_of("value")).groupBy(doc, "key").agg(F.min(F.struct(*order)).alias("_at"), F.min_by(F.struct("category", "confidence"), F.struct(*order)).alias("_c"))
    named = seen.join(small(tokens.select("key", "token", "real_value", "type", "is_new", F.col(doc).alias("_first"))), "key")
    one = F.struct("_at", F.struct(
        F.col("type"), F.col("real_value"), F.col("token"), (F.col("is_new") & F.col("_first").eqNullSafe(F.col(doc))).alias("is_new"), F.col("_c.category").alias("category"), F.col("_c.confidence").alias("confidence")).alias("m"))
    return named.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["m"]).alias("minted"))
