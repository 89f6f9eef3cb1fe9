"""Scrubbing whole tables of texts: detect, mint, apply, redact, report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anonspark.config import ScrubConfig
from anonspark.functions.patterns import BY_NAME, TOKEN_ANYWHERE
from anonspark.operators.apply import apply_map, context, credential_snippets, redact_credentials, redact_kv, Substitution
from anonspark.operators.detect import detect, drop_allowlisted, premint
from anonspark.operators.mint import assign_tokens, first_by_key, key_of, minted_tokens, token_text
from anonspark.plans.storage import fresh, saved, small, spread

ORDER = ["doc_order", "rank", "match_idx"]
UNSURE = "array<struct<span:string,surrounding:string,suggested_category:string,confidence:double>>"
MINTED = "array<struct<type:string,real_value:string,token:string,is_new:boolean,category:string,confidence:double>>"


@dataclass
class ScrubResult:
    """What a scrub of a table yields. tokens holds every value that the batch met."""

    documents: DataFrame
    tokens: DataFrame
    hits: DataFrame


#: Columns that a scrub adds; columns of the input that bear these names give way.
ADDED = ("scrubbed", "credential_snippets", "minted", "unsure", "has_credentials", "modified")


def ordered_hits(docs: DataFrame, doc: str, text: str, config: ScrubConfig, allow: DataFrame | None, patterns=(), names=None, keep: Sequence[str] = ()) -> DataFrame:
    """The hits of docs with doc, the columns `keep`, and doc_order, in which documents are read."""
    hits = detect(spread(docs.select(doc, *keep, text)), text, config, names, patterns).withColumn("doc_order", F.col(doc))
    return drop_allowlisted(hits, allow) if allow is not None else hits


def corpus_tokens(hits: DataFrame, doc: str, config: ScrubConfig, vocab: DataFrame | None, allow: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """The tokens of all values that hits and the configuration name, numbered as if the
    documents had been read one after another. Suspected companies are not minted. keep: columns
    of the hits that tell documents of one id apart."""
    rows = hits.filter("rank <> 19").select(doc, *keep, *ORDER, "value", "type", "category", "confidence")
    names = premint(hits.sparkSession, config)
    names = drop_allowlisted(names, allow) if allow is not None else names
    missing = [c for c in rows.columns if c not in names.columns]
    before = names.select(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in missing], *names.columns)
    order = [*ORDER, *keep]
    return assign_tokens(first_by_key(rows.unionByName(before), order), vocab, order)


def _keyed(docs: DataFrame, doc: str, text: str) -> tuple[DataFrame, str, str]:
    """docs without the columns that a scrub adds, with a hash of id and text that tells rows apart
    (of equal rows the same), and the names of that column and of a free one."""
    docs = docs.drop(*[c for c in ADDED if c not in (doc, text)])
    row, free = fresh([*docs.columns, *ADDED, *ORDER, "value", "type", "category", "confidence", "source", "key"], "_row", "_applied")
    return docs.withColumn(row, F.xxhash64(F.col(doc), F.col(text))), row, free


def scrub_corpus(docs: DataFrame, doc: str = "doc_id", text: str = "text", config: ScrubConfig | None = None, vocab: DataFrame | None = None, allow: DataFrame | None = None, patterns=()) -> ScrubResult:
    """One vocabulary over all documents. It is closed over the batch before it is applied,
    so a value is also replaced in documents before the one in which it was detected. A null text
    stays null; rows without an id, or with the id of another, have lists of their own."""
    config = config or ScrubConfig()
    keyed, row, applied = _keyed(docs, doc, text)
    hits = saved(ordered_hits(keyed, doc, text, config, allow, patterns, keep=[row]), "hits")
    tokens = saved(corpus_tokens(hits, doc, config, vocab, allow, [row]), "tokens")
    named = tokens.select("real_value", "token")
    if vocab is not None:
        named = named.unionByName(vocab.select("real_value", "token")).distinct()
    base = apply_map(keyed, named, text, applied)
    per = minted_tokens(hits.filter("rank <> 19"), tokens, row)
    doubt = unsure_spans(keyed, hits, tokens, row, text)
    return ScrubResult(_finish(_with_lists(base, per, doubt, row), text, applied).drop(row), tokens.drop(row), hits.drop(row))


def _with_lists(docs: DataFrame, per: DataFrame, doubt: DataFrame, row: str) -> DataFrame:
    """docs with their minted and unsure lists. The lists are stored, so that texts stay where
    they are if few documents have any, and move once if many have."""
    lists = saved(per.join(doubt, row, "full_outer"), "lists")
    return docs.join(small(lists), row, "left")


def _finish(rows: DataFrame, text: str, applied: str) -> DataFrame:
    """Redacts what the map has been applied to, and derives the flags."""
    t = F.col(text)
    rows = rows.withColumn("scrubbed", redact_kv(redact_credentials(F.col(applied)))).drop(applied)
    rows = rows.withColumns({
        "credential_snippets": F.coalesce(credential_snippets(t), F.array().cast("array<string>")),
        "minted": F.coalesce("minted", F.array().cast(MINTED)), "unsure": F.coalesce("unsure", F.array().cast(UNSURE)),
    })
    found = F.size("credential_snippets") > 0
    changed = (F.col("scrubbed") != t) | found | F.exists("minted", lambda m: m["is_new"]) | (F.size("unsure") > 0)
    return rows.withColumns({"has_credentials": found, "modified": F.coalesce(changed, F.lit(False))})


def unsure_spans(docs: DataFrame, hits: DataFrame, tokens: DataFrame, row: str, text: str) -> DataFrame:
    """Per row (a key that hits have as well) its suspected companies that no token names, with their surroundings."""
    left = hits.filter("rank = 19").join(small(tokens.select("key")), key_of("value") == F.col("key"), "left_anti")
    spans = left.select(row, "match_idx", "value").distinct().groupBy(row).agg(F.array_sort(F.collect_list(F.struct("match_idx", "value"))).alias("_spans"))
    rows = docs.select(F.col(row), F.col(text).alias("_t")).join(small(saved(spans, "spans")), row).groupBy(row, "_spans").agg(F.min("_t").alias("_t"))
    regex = BY_NAME["corp"].regex
    parts = F.struct(F.split("_t", regex, -1).alias("gaps"), F.regexp_extract_all("_t", F.lit(regex), F.lit(0)).alias("found"))

    def of(p: Column) -> Column:
        return F.transform("_spans", lambda s: F.struct(
            s["value"].alias("span"), context_of(F.col("_t"), p["gaps"], p["found"], s["match_idx"], s["value"]).alias("surrounding"),
            F.lit("customer").alias("suggested_category"), F.lit(0.6).alias("confidence")))

    return rows.select(row, F.flatten(F.transform(F.array(parts), of)).alias("unsure"))  # so that the text is searched once


def context_of(text: Column, gaps: Column, found: Column, index: Column, value: Column, reach: int = 32) -> Column:
    """Surroundings of the index-th hit of a regex, given its hits in the text and the gaps between
    them: all that comes before it is the first of both, whose lengths add up."""
    length = lambda parts, n: F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda a, x: a + F.length(x))
    position = length(gaps, index + 1) + length(found, index) + 1
    return F.transform(F.array(position), lambda at: context(text, at, F.length(value), reach))[0]  # added up once


def scrub_documents(docs: DataFrame, doc: str = "doc_id", text: str = "text", config: ScrubConfig | None = None) -> DataFrame:
    """Each document with a vocabulary of its own: as scrub_corpus, but tokens start anew."""
    config = config or ScrubConfig()
    keyed, row, applied = _keyed(docs, doc, text)
    hits = saved(ordered_hits(keyed, doc, text, config, None, keep=[row]), "hits")
    rows = hits.filter("rank <> 19").select(row, *ORDER, "value", "type", "category", "confidence")
    firsts = first_by_key(rows, ORDER, [row])
    place = F.row_number().over(Window.partitionBy(row, "type").orderBy(*ORDER)) - 1
    tokens = firsts.withColumns({"token": token_text(F.col("type"), place), "real_value": F.col("value"), "is_new": F.lit(True)})
    one = F.struct("rank", "match_idx", F.struct("type", "real_value", "token", "is_new", "category", "confidence").alias("m"))
    per = tokens.groupBy(row).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["m"]).alias("minted"))
    left = hits.join(tokens.select(row, "key"), (hits[row] == tokens[row]) & (key_of("value") == F.col("key")), "left_anti")
    spans = unsure_spans(keyed, left, tokens.limit(0), row, text)

    @F.pandas_udf("string")
    def of(part: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([t if m is None else Substitution([(x["real_value"], x["token"]) for x in m])(t) for t, m in zip(part, own)], dtype=object)

    joined = _with_lists(keyed, per, spans, row)
    return _finish(joined.withColumn(applied, of(F.col(text), F.col("minted"))), text, applied).drop(row)


def review_rows(result: ScrubResult, doc: str = "doc_id", source: str = "scrub") -> DataFrame:
    """One row per doubtful span: span, surrounding, suggested_cat, confidence, source_event."""
    rows = result.documents.select(doc, F.explode("unsure").alias("u"))
    return rows.select(doc, F.col("u.span").alias("span"), F.col("u.surrounding").alias("surrounding"), F.col("u.suggested_category").alias("suggested_cat"), F.col("u.confidence").alias("confidence"), F.lit(source).alias("source_event"))


def merge_fields(results: DataFrame, key: str, order: str, *more: Column) -> DataFrame:
    """The results of one record's fields as one: flags by any, lists end to end in the order
    of the fields; more: other aggregates, so that the fields are scrubbed once for all."""
    end_to_end = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(c).alias("v")))), lambda x: x["v"])).alias(c)
    return results.groupBy(key).agg(
        F.bool_or("has_credentials").alias("has_credentials"), F.bool_or("modified").alias("modified"), *map(end_to_end, ("credential_snippets", "minted", "unsure")), *more)


#: The category of a token's type where no stored category is known.
CATEGORY_OF_TYPE = {"IP": "ip", "EMAIL": "email", "PATH": "path", "USER": "domain_user", "MAC": "mac", "GUID": "guid", "PHONE": "phone", "ADDR": "address", "ACCOUNT": "account_number", "URL": "url", "HOST": "fqdn", "PERSON": "person", "CUSTOMER": "customer"}


def tokens_in_output(docs: DataFrame, vocab: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, token, real_value, category): tokens in a document's scrubbed text that are
    neither in its minted list nor in its original text."""
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(TOKEN_ANYWHERE), F.lit(0)))
    fresh = F.array_except(F.array_except(tokens("scrubbed"), tokens(text)), F.transform("minted", lambda m: m["token"]))
    rows = docs.select(doc, F.explode(fresh).alias("token"))
    kinds = F.create_map(*[F.lit(x) for kv in CATEGORY_OF_TYPE.items() for x in kv])
    type_ = F.regexp_extract("token", r"^\{([A-Z][A-Z0-9_]*?)(?:_\d+)?\}$", 1)
    found = rows.join(vocab.select("token", "real_value", F.col("category").alias("_c")), "token")
    return found.select(doc, "token", "real_value", F.coalesce("_c", kinds[type_], F.lower(type_)).alias("category"))


def audit_residual(docs: DataFrame, doc: str = "doc_id", text: str = "scrubbed", config: ScrubConfig | None = None) -> DataFrame:
    """Hits that are left in scrubbed texts, tokens and redactions aside."""
    clean = F.regexp_replace(F.regexp_replace(text, TOKEN_ANYWHERE, " "), r"\[(?:CREDENTIAL-)?REDACTED\]", " ")
    return detect(docs.select(doc, clean.alias("_text")), "_text", config).filter("rank <> 19").select(doc, "rank", "match_idx", "value", "category")


def findings_preview(documents: DataFrame, extra: DataFrame | None = None, doc: str = "doc_id") -> DataFrame:
    """(doc, findings): 'EMAIL×2, IP×1' by count, then name; 'none' without any."""
    rows = documents.select(doc, F.explode("minted").alias("m")).select(doc, F.upper("m.category").alias("cat"), "m.token")
    if extra is not None:
        rows = rows.unionByName(extra.select(doc, F.upper("category").alias("cat"), "token"))
    per = rows.distinct().groupBy(doc, "cat").agg(F.count("*").alias("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("a"), F.col("cat").alias("c")))), lambda x: F.concat(x["c"], F.lit("×"), (-x["a"]).cast("string"))), ", ")
    return documents.select(doc).join(per.groupBy(doc).agg(text.alias("findings")), doc, "left").withColumn("findings", F.coalesce("findings", F.lit("none")))


def token_runs(docs: DataFrame, vocab: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, idx, kind, value, category): a text as runs of plain text and tokens, in order."""
    gaps, tokens = F.split(text, TOKEN_ANYWHERE, -1), F.regexp_extract_all(text, F.lit(TOKEN_ANYWHERE), F.lit(0))
    run = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    pairs = F.flatten(F.zip_with(gaps, tokens, lambda g, t: F.array(run("text", g), run("token", t))))
    full = F.filter(pairs, lambda x: x["value"].isNotNull() & (x["value"] != ""))
    rows = docs.select(doc, F.posexplode(full).alias("idx", "r")).select(doc, "idx", "r.kind", "r.value")
    return rows.join(vocab.select(F.col("token").alias("value"), "category").distinct(), "value", "left").select(doc, "idx", "kind", "value", F.when(F.col("kind") == "token", F.col("category")).alias("category"))


def build_payload(parts: DataFrame, key: str = "id") -> DataFrame:
    """(key, payload): the composer's text and the files' blocks in order, a line apart. parts:
    key, ord, kind (composer or file), name, text, error; parts with an error, a composer of
    white space and files without text are left out."""
    composer = F.col("kind") == "composer"
    body = F.when(composer, F.col("text")).otherwise(F.concat(F.lit("\n--- file: "), "name", F.lit(" ---\n"), "text"))
    good = parts.filter("error IS NULL").filter(F.when(composer, F.trim("text") != "").otherwise(F.col("text") != "")).select(key, "ord", body.alias("body"))
    return good.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "body"))), lambda x: x["body"]), "\n").alias("payload"))
