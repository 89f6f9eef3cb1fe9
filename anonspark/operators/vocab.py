"""The vocabulary as tables: upserts, look-ups, forgetting, allowlist, views, admission."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anonspark.functions.patterns import CREDENTIAL, TOKEN_SHAPE, java
from anonspark.plans.storage import saved

VOCAB_COLUMNS = ["real_value", "token", "category", "confidence", "first_seen", "last_seen", "hit_count", "project", "confirmed_by"]


def upsert(vocab: DataFrame, minted: DataFrame, now: Column, force: bool = False) -> DataFrame:
    """vocab with minted (real_value, token, category, confidence). A known value keeps its
    row but for last_seen and hit_count; force also takes token, category and confidence."""
    new = minted.groupBy("real_value").agg(F.max_by(F.struct("token", "category", "confidence"), F.struct("confidence", "token")).alias("n"))
    both = vocab.alias("v").join(new.alias("m"), "real_value", "full_outer")
    known = F.col("v.token").isNotNull()
    hit = F.col("n").isNotNull()

    def pick(name: str) -> Column:
        old, fresh = F.col(f"v.{name}"), F.col(f"n.{name}")
        return (F.coalesce(fresh, old) if force else F.coalesce(old, fresh)).alias(name)

    return both.select(
        "real_value", pick("token"), pick("category"), pick("confidence"),
        F.coalesce("v.first_seen", now).alias("first_seen"), F.when(hit, now).otherwise(F.col("v.last_seen")).alias("last_seen"),
        F.when(known & hit, F.col("v.hit_count") + 1).otherwise(F.coalesce("v.hit_count", F.lit(1).cast("long"))).alias("hit_count"),
        F.col("v.project").alias("project"), F.when(known, F.col("v.confirmed_by")).otherwise("auto").alias("confirmed_by"))


def confirmed_map(vocab: DataFrame) -> DataFrame:
    """The rows that a scrub may apply."""
    return vocab.filter(F.col("confirmed_by").isNotNull() & ~F.col("real_value").rlike(TOKEN_SHAPE))


def look_up_tokens(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    return tokens.join(vocab, "token")


def listed(vocab: DataFrame, category: str | None = None) -> DataFrame:
    rows = vocab if category is None else vocab.filter(F.col("category") == category)
    return rows.orderBy("category", "real_value")


def categories_above(vocab: DataFrame, least: int = 3) -> DataFrame:
    return vocab.groupBy("category").agg(F.count("*").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "category")


def forget(vocab: DataFrame, values: DataFrame, allow: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(vocab without the values, allow with those that were there and have four characters
    or more). Values match without ASCII case."""
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    gone = values.select(fold(F.col("value")).alias("_k")).distinct()
    keyed = vocab.withColumn("_k", fold(F.col("real_value")))
    dropped = keyed.join(gone, "_k", "left_semi").filter(F.length("real_value") >= 4)
    entries = dropped.select(F.col("real_value").alias("pattern"), F.lit(False).alias("is_regex"), F.lit("forget").alias("added_by"), now.alias("added_at"), F.lit("forgotten").alias("reason"))
    return keyed.join(gone, "_k", "left_anti").select(*vocab.columns), allow_upsert(allow, entries)


def allow_upsert(allow: DataFrame, entries: DataFrame) -> DataFrame:
    """Insert or replace: the last entry of a pattern wins."""
    both = allow.withColumn("_o", F.lit(0)).unionByName(entries.withColumn("_o", F.lit(1)))
    rest = [c for c in allow.columns if c != "pattern"]
    return both.groupBy("pattern").agg(F.max_by(F.struct(*rest), F.struct("_o", "added_at")).alias("e")).select("pattern", "e.*").select(*allow.columns)


def clear(vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(an empty vocabulary, one row: deleted, remaining)."""
    return vocab.limit(0), vocab.agg(F.count("*").alias("deleted"), F.lit(0).cast("long").alias("remaining"))


def merge_first(sources: list[DataFrame], key: str = "token") -> DataFrame:
    """The sources' rows, the first source that has a key winning."""
    return _merged(sources, key, F.min_by)


def merge_last(sources: list[DataFrame], key: str = "token") -> DataFrame:
    return _merged(sources, key, F.max_by)


def _merged(sources: list[DataFrame], key: str, pick) -> DataFrame:
    rows = None
    for i, s in enumerate(sources):
        part = s.withColumn("_source", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    rest = [c for c in sources[0].columns if c != key]
    return rows.groupBy(key).agg(pick(F.struct(*rest), F.struct("_source", *rest)).alias("r")).select(key, "r.*")


def view(current: DataFrame, session: DataFrame, stored: DataFrame) -> DataFrame:
    """The vocabulary page: all tokens (token, real_value, category), with the stored uses."""
    keep = ["token", "real_value", "category"]
    rows = merge_first([current.select(*keep), session.select(*keep), stored.select(*keep)])
    uses = stored.groupBy("token").agg(F.sum("hit_count").alias("uses"))
    return rows.join(uses, "token", "left").withColumn("uses", F.coalesce("uses", F.lit(0).cast("long")))


def searched(rows: DataFrame, text: str = "", category: str | None = None) -> DataFrame:
    """Rows whose token or value holds the text, without case, of a category if one is given."""
    low = text.lower()
    out = rows.filter(F.lower("token").contains(low) | F.lower("real_value").contains(low)) if low else rows
    return out.filter(F.lower("category") == category.lower()) if category else out


def by_category(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.lower("category").alias("category")).agg(F.count("*").alias("n"))


@F.pandas_udf(T.StringType())
def _normal(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v or "").strip())


@F.pandas_udf(T.StringType())
def regex_fault(patterns: pd.Series) -> pd.Series:
    """Why a regex is not admitted, or null."""
    def fault(p: str | None) -> str | None:
        try:
            return "pattern matches empty string" if re.search(p or "", "") else None
        except re.error:
            return "invalid regex pattern"

    return patterns.map(fault)


def validated(entries: DataFrame, allowlist: bool = False) -> DataFrame:
    """entries (value, category, or value, is_regex for the allowlist) with value normalised
    and reason: null if it is admitted, else the first rule that it breaks."""
    rows = entries.withColumn("value", _normal(F.col("value")))
    v = F.col("value")
    control = v.rlike("[\\x00-\\x1f\\u200b-\\u200f\\ufeff]")
    reason = F.when(v == "", "value required")
    if allowlist:
        least = F.when(F.col("is_regex"), 6).otherwise(4)
        reason = reason.when(F.length(v) < least, "pattern too short").when(F.length(v) > 200, "pattern too long")
        reason = reason.when(control, "control characters not allowed").when(v.rlike(java(CREDENTIAL)), "credential-shape rejected")
        rows = rows.withColumn("_fault", regex_fault(F.when(F.col("is_regex"), v).otherwise("x")))
        reason = reason.when(F.col("is_regex"), F.col("_fault"))
    else:
        reason = reason.when(F.length(v) > 200, "value too long").when(control, "control characters not allowed")
        reason = reason.when(~F.coalesce("category", F.lit("customer")).rlike("^[a-z][a-z0-9_]{0,15}$"), "invalid category").when(v.rlike(java(CREDENTIAL)), "credential-shape rejected")
    return rows.withColumn("reason", reason).drop("_fault")


def export_map(vocab: DataFrame) -> DataFrame:
    """One row: the map as a versioned JSON envelope. Meant for a vocabulary that one reader can hold."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col("token"), F.col("real_value").alias("real"))))
    return vocab.agg(F.to_json(F.struct(F.lit(1).alias("v"), pairs.alias("entries"))).alias("payload"))


def import_map(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(token, real) of envelopes; another version or no list fails, malformed entries go."""
    parsed = payloads.select(F.from_json(column, "v int, entries string").alias("e"))
    entries = F.from_json("e.entries", "array<struct<token:string,real:string>>")
    bad = F.col("e.v").isNull() | (F.col("e.v") != 1) | entries.isNull()
    good = F.when(bad, F.raise_error(F.lit("not a version 1 map envelope")).cast("array<struct<token:string,real:string>>")).otherwise(entries)
    return parsed.select(F.explode(good).alias("p")).select("p.token", "p.real").filter("token IS NOT NULL AND real IS NOT NULL AND real <> ''").filter(F.col("token").rlike(TOKEN_SHAPE))


def write_envelope(vocab: DataFrame, path: str) -> None:
    """The map as a versioned JSON envelope in a folder: its part files, in the order of their names,
    are one JSON text, with an entry a line in the order of tokens. No row or task holds the map."""
    entry = F.to_json(F.struct(F.col("token"), F.col("real_value").alias("real")))
    rows = vocab.select(F.lit(1).alias("_o"), F.col("token").alias("_t"), F.col("real_value").alias("_v"), entry.alias("value"))
    first = saved(vocab.agg(F.min(F.struct("token", "real_value")).alias("m")).select("m.token", "m.real_value"), "first")
    rows = rows.join(F.broadcast(first), F.col("_t").eqNullSafe(F.col("token")) & F.col("_v").eqNullSafe(F.col("real_value")), "left")
    rows = rows.select("_o", "_t", "_v", F.concat(F.when(F.col("token").isNull(), ",").otherwise(""), "value").alias("value"))
    ends = vocab.sparkSession.createDataFrame([(0, '{"v":1,"entries":['), (2, "]}")], "_o int, value string")
    every = rows.unionByName(ends.select("_o", F.lit(None).cast("string").alias("_t"), F.lit(None).cast("string").alias("_v"), "value"))
    every.repartitionByRange("_o", "_t", "_v").sortWithinPartitions("_o", "_t", "_v").select("value").write.text(path)


def read_envelope(spark: SparkSession, path: str) -> DataFrame:
    """(token, real) of an envelope of one entry a line; another version, or a text that breaks off,
    fails, malformed entries go."""
    lines = spark.read.text(path)
    head = F.get_json_object(F.concat(F.regexp_extract("value", r'^\s*(\{"v":\s*[^,]*),\s*"entries":\s*\[\s*$', 1), F.lit("}")), "$.v") == "1"
    row = lines.agg(F.count_if(head).alias("head"), F.count_if(F.trim("value") == "]}").alias("tail")).first()
    if (row["head"], row["tail"]) != (1, 1):
        raise ValueError("not a version 1 map envelope")
    pairs = lines.select(F.from_json(F.regexp_replace("value", "^,|,$", ""), "token string, real string").alias("p")).select("p.token", "p.real")
    return pairs.filter("token IS NOT NULL AND real IS NOT NULL AND real <> ''").filter(F.col("token").rlike(TOKEN_SHAPE))
