"""Learning regexes from the values of a category, cluster by cluster, with aggregates.

No cluster is gathered: all examples have one shape if the least and the greatest shape
are the same, a run is literal if its least and greatest value are, and the common prefix
of a set is that of its least and greatest member.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anonspark.functions.patterns import java
from anonspark.functions.regexes import fault
from anonspark.operators.mint import number_by_type
from anonspark.operators.vocab import categories_above
from anonspark.plans.storage import saved, small, spread

MIN_EXAMPLES, MIN_SPECIFICITY, MAX_PATTERN = 3, 0.3, 200
_RUNS = "[A-Z]+|[a-z]+|[0-9]+|."


def runs(value: Column) -> Column:
    """A value cut into runs of capitals, of small letters, of digits, and other characters."""
    return F.regexp_extract_all(value, F.lit("(?s)" + _RUNS), F.lit(0))


def run_kind(run: Column) -> Column:
    return F.when(run.rlike("^[A-Z]"), "U").when(run.rlike("^[a-z]"), "L").when(run.rlike("^[0-9]"), "D").otherwise("LIT")


def shape(value: Column) -> Column:
    return F.array_join(F.transform(runs(value), run_kind), ",")


def cluster_key(value: Column) -> Column:
    """Shape and content without digits: values of one cluster differ in case or digits only."""
    return F.concat(shape(value), F.lit("\x01"), F.lower(F.regexp_replace(value, "[0-9]+", "\x00")))


#: What is made of a cluster; written out, as workers import this module without a session.
_MADE = T.StructType([T.StructField("regex", T.StringType()), T.StructField("skeleton", T.StringType()), T.StructField("specificity", T.DoubleType())])


def _escaped(text: str) -> str:
    return re.sub(r"([.*+?^${}()|\[\]\\/])", r"\\\1", text)


def _regex(row) -> tuple[str | None, str | None, float]:
    """(regex, skeleton, specificity) from a cluster's aggregates, or Nones."""
    body, specificity = "", 0.0
    if row.low_shape == row.high_shape:
        parts, literal = [], 0
        for kind, low, high, least, most in zip(row.low_shape.split(","), row.low, row.high, row.least, row.most):
            if low == high:
                parts.append(_escaped(low))
                literal += len(low)
            elif kind == "LIT":
                parts.append(_escaped(low))
                literal += 1
            else:
                count = f"{{{least}}}" if least == most else f"{{{least},{most}}}"
                parts.append({"U": "[A-Z]", "L": "[a-z]", "D": r"\d"}[kind] + count)
        body, specificity = "".join(parts), literal / row.mean_len if row.mean_len else 0.0
    if not body or specificity < MIN_SPECIFICITY:
        prefix, suffix = row.prefix, row.suffix
        least, most = row.min_len - len(prefix) - len(suffix), row.max_len - len(prefix) - len(suffix)
        if len(prefix) + len(suffix) < 2 or most < 0:
            return None, None, 0.0
        least = max(0, least)
        middle = f".{{{least}}}" if least == most else f".{{{least},{most}}}"
        body = _escaped(prefix) + middle + _escaped(suffix)
        specificity = (len(prefix) + len(suffix)) / row.mean_len if row.mean_len else 0.0
    if specificity < MIN_SPECIFICITY:
        return None, None, 0.0
    regex = body
    if re.match(r"\[A-Z\]|\[a-z\]|\\d|\\w|[A-Za-z0-9_]", body):
        regex = r"\b" + regex
    if re.search(r"[}A-Za-z0-9_]$", body):
        regex += r"\b"
    return (regex, body, specificity) if len(regex) <= MAX_PATTERN else (None, None, 0.0)


@F.pandas_udf(_MADE)
def _assemble(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([_regex(r) for r in rows.itertuples(index=False)], columns=["regex", "skeleton", "specificity"])


def _common_prefix(a: Column, b: Column) -> Column:
    same = F.transform(F.sequence(F.lit(0), F.least(F.length(a), F.length(b))), lambda n: F.when(F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n), n).otherwise(0))
    return F.substring(a, F.lit(1), F.array_max(same))


def induce(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, n_examples, regex_source, skeleton, confidence) of the clusters (by keys) of at
    least three values whose regex is specific enough and matches every one of them."""
    rows = values.select(*keys, F.col(value).alias("value")).withColumns({"shape": shape(F.col("value")), "len": F.length("value"), "back": F.reverse("value")})
    whole = rows.groupBy(*keys).agg(
        F.count("*").alias("n_examples"), F.min("shape").alias("low_shape"), F.max("shape").alias("high_shape"), F.min("len").alias("min_len"), F.max("len").alias("max_len"), F.avg("len").alias("mean_len"),
        F.min("value").alias("a"), F.max("value").alias("b"), F.min("back").alias("c"), F.max("back").alias("d")).filter(F.col("n_examples") >= MIN_EXAMPLES)
    places = rows.select(*keys, F.posexplode(runs(F.col("value"))).alias("place", "run"))
    per = places.groupBy(*keys, "place").agg(F.min("run").alias("low"), F.max("run").alias("high"), F.min(F.length("run")).alias("least"), F.max(F.length("run")).alias("most"))
    # places grow with the longest value, not with the cluster
    columns = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "low", "high", "least", "most"))).alias("p"))
    facts = whole.join(columns, keys).withColumns({"prefix": _common_prefix(F.col("a"), F.col("b")), "suffix": F.reverse(_common_prefix(F.col("c"), F.col("d")))})
    made = facts.withColumn("r", _assemble(F.struct("low_shape", "high_shape", "min_len", "max_len", "mean_len", "prefix", "suffix", F.col("p.low").alias("low"), F.col("p.high").alias("high"), F.col("p.least").alias("least"), F.col("p.most").alias("most"))))
    made = made.filter("r.regex IS NOT NULL").select(*keys, "n_examples", F.col("r.regex").alias("regex_source"), F.col("r.skeleton").alias("skeleton"), F.col("r.specificity").alias("confidence"))
    # a regex that varies by row has Spark's own dialect, so its boundary is spelled out
    missed = rows.join(made.withColumn("_rx", _spelled("regex_source")), keys).filter(~F.expr("value RLIKE _rx")).select(*keys).distinct()
    return made.join(missed, keys, "left_anti")


def suggest(vocab: DataFrame) -> DataFrame:
    """Regexes for the clusters of every category of three values or more."""
    large = categories_above(vocab, MIN_EXAMPLES).select("category")
    rows = vocab.join(large, "category").select("category", F.col("real_value").alias("value"))
    return induce(rows.withColumn("cluster", cluster_key(F.col("value"))), ["category", "cluster"])


def suggest_by_category(vocab: DataFrame) -> DataFrame:
    """One regex for each category as a whole, where there is one."""
    return induce(vocab.select("category", F.col("real_value").alias("value")), ["category"])


def persist(patterns: DataFrame, found: DataFrame, now: Column, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patterns, examples): patterns and the found ones as pending, but for those whose category
    and skeleton are there and not rejected; and of the new ones all values (category, value) that
    they come from, as rows (id, example), since a cluster has no bound."""
    known = patterns.filter("status <> 'rejected'").select("category", "skeleton")
    new = found.join(known, ["category", "skeleton"], "left_anti")
    base = patterns.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = number_by_type(new.withColumn("type", F.lit("")), ["category", "skeleton", "regex_source"]).withColumn("id", F.col("n") + 1 + base)
    rows = new.select("id", "category", "regex_source", "skeleton", F.lit("pending").alias("status"), "confidence", now.alias("created_at"), F.lit(0).cast("long").alias("hit_count"))
    return patterns.unionByName(rows), examples_of(new, values)


@F.pandas_udf(T.StringType())
def _fault(patterns: pd.Series) -> pd.Series:
    return patterns.map(fault)


def admitted(patterns: DataFrame, regex: str = "regex_source") -> DataFrame:
    """patterns with reason: null, or why the regex may not run: too long, a quantified group
    that holds a quantifier, no regex, one that matches nothing at all, or one whose backtracking
    grows exponentially or by more than one power of the text."""
    r = F.col(regex)
    nested = r.rlike(r"\([^)]*[+*{][^)]*\)[+*{]")
    return spread(patterns).withColumn("reason", F.when(F.length(r) > MAX_PATTERN, "pattern too long").when(nested, "nested quantifier").otherwise(_fault(r)))


def _spelled(regex: str) -> Column:
    """A regex column with the boundary spelled out."""
    return F.replace(regex, F.lit(r"\b"), F.lit(java(r"\b")))


def examples_of(patterns: DataFrame, values: DataFrame) -> DataFrame:
    """(id, example): the distinct values (category, value) of the clusters that patterns were
    made of, or of their categories if these are not clustered. Without a cluster column in
    patterns that were stored, the values of a category that the pattern matches."""
    rows = values.select("category", F.col("value").alias("example"))
    if "cluster" in patterns.columns:
        rows = rows.withColumn("cluster", cluster_key(F.col("example"))).distinct()
        return rows.join(small(saved(patterns.select("id", "category", "cluster"), "clusters")), ["category", "cluster"]).select("id", "example")
    rx = saved(patterns.select("id", "category", _spelled("regex_source").alias("_rx")), "patterns")
    return rows.distinct().join(small(rx), "category").filter(F.expr("example RLIKE _rx")).select("id", "example")


def decide(patterns: DataFrame, decisions: DataFrame, examples: DataFrame) -> DataFrame:
    """Applies decisions (id, action: activate, reject, delete or edit, regex): an edit must
    be admitted and match all examples (id, example) of its pattern, of which there must be one,
    else nothing changes. Rejected patterns can't be edited."""
    d = admitted(decisions.select("id", F.col("action").alias("_a"), F.col("regex").alias("_r")), "_r").withColumnRenamed("reason", "_bad")
    d = saved(d.withColumn("_rx", F.when(F.col("_bad").isNull() & (F.col("_a") == "edit"), _spelled("_r"))), "decisions")
    edits = small(d.filter("_rx IS NOT NULL").select("id", "_rx"))  # so that a pattern's examples stay where they are
    seen = examples.join(edits, "id").groupBy("id").agg(F.bool_and(F.expr("example RLIKE _rx")).alias("_all"))
    rows = patterns.join(d, "id", "left").join(seen, "id", "left").filter(~F.coalesce(F.col("_a") == "delete", F.lit(False)))
    fits = F.coalesce("_all", F.lit(False)) & (F.col("status") != "rejected")
    status = F.when(F.col("_a") == "activate", "active").when(F.col("_a") == "reject", "rejected").otherwise(F.col("status"))
    return rows.withColumns({"status": status, "regex_source": F.when(fits, F.col("_r")).otherwise(F.col("regex_source"))}).select(*patterns.columns)


def bump_hits(patterns: DataFrame, hits: DataFrame, doc: str = "doc_id") -> DataFrame:
    """hit_count grows by one for each text in which a pattern (source of a hit) minted."""
    n = hits.filter("source IS NOT NULL").groupBy(F.col("source").alias("id")).agg(F.countDistinct(doc).alias("_n"))
    return patterns.join(n, "id", "left").withColumn("hit_count", F.col("hit_count") + F.coalesce("_n", F.lit(0))).select(*patterns.columns)
