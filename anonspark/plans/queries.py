"""The library's queries over the driver's tables, with the SQL that gives the same rows.

Some kinds of values don't occur in the tables; for these a text is derived from every
row of a table by an expression that Spark and the SQL engine read alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from anonspark.config import ColumnRule, ScrubConfig
from anonspark.functions import patterns as P
from anonspark.operators import gate, induce, judge, review, tables, vocab
from anonspark.operators.apply import apply_by_candidates, apply_map, credential_snippets, has_credentials, redact_credentials, redact_kv, restore
from anonspark.operators.detect import detect, drop_allowlisted
from anonspark.operators.mint import assign_tokens, first_by_key
from anonspark.operators.nested import scrub_json
from anonspark.plans import scrub
from anonspark.plans.storage import saved, shared_dir, spread
from anonspark.plans.store import SCHEMAS, VocabStore
from anonspark.sources.readers import read_events, read_table, read_text_corpus, write_scrubbed
from anonspark.streaming.jobs import daily_counts, rate_limit_stream, scrub_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

NOTE = (
    "concat('mac 00:1a:2b:3c:4d:', 10 + event_id % 80, ' id 550e8400-e29b-41d4-a716-4466554400', 10 + event_id % 80, "
    "' share ', chr(92), chr(92), 'srv', user_id % 20, chr(92), 'data', chr(92), 'f', event_id % 7, ' user CORP', chr(92), 'u', user_id % 50, "
    "' see https://app', user_id % 9, '.site.example.com/p?id=', event_id % 100, ' password=pw', event_id % 100, ' at 12', event_id % 10, "
    "' Main Street with Acme Corp ping 10.', user_id % 200, '.', event_id % 7, '.1 fe80:0:0:0:0:0:0:', event_id % 10, ' ', "
    "CASE WHEN event_id % 10 = 0 THEN concat('ghp_', repeat('a1', 18)) ELSE '' END)"
)
LETTER = "concat(chr(65 + CAST(c_custkey % 26 AS INT)), repeat(chr(97 + CAST(c_nationkey AS INT)), 3))"
MAIL = (
    f"concat('From: ', CASE WHEN c_custkey % 5 = 0 THEN 'Monday ' WHEN c_custkey % 5 = 1 THEN concat(repeat('Anna', 20), ' ') ELSE 'Anna ' END, '{{L}} <anna', c_custkey, '@mail.example.com>', chr(10), 'see you', chr(10), chr(10), 'Best,', chr(10), 'Bob {{L}}', chr(10))"
    .replace("{L}", f"', {LETTER}, '")
)
CONTACT = {
    "c_custkey": "c_custkey",
    "Email": "concat('user', c_custkey, '@mail', c_nationkey, '.example.com')",
    "Phone": "concat('+1 555 ', lpad(concat(c_custkey % 1000, ''), 3, '0'), ' ', lpad(concat(c_custkey % 10000, ''), 4, '0'))",
    "Name": "c_name",
    "Notes": "concat('acct ', c_mktsegment, ' ip 10.0.', c_custkey % 250, '.', c_nationkey)",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id AS doc_id", f"{NOTE} AS text")


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS doc_id", f"{MAIL} AS text")


SOURCE = {
    "documents": (docs, "SELECT doc_id, text FROM documents"),
    "notes": (notes, f"SELECT event_id AS doc_id, {NOTE} AS text FROM events"),
    "mails": (mails, f"SELECT c_custkey AS doc_id, {MAIL} AS text FROM customer"),
    "pages": (lambda s, d: table(s, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("text")), "SELECT page_id AS doc_id, url AS text FROM pages"),
}


def query(name: str, oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Patterns as the SQL engine reads them: ASCII boundaries, no look-around.
_SQL_PATTERN = {
    "phone": P.PHONE.replace(r"(?<!\d)", "").replace(r"(?!\d)", ""), "person_header": "(?m)" + P.PERSON_HEADER,
    "person_adjacent": P.PERSON_ADJACENT.replace("(?=", "").removesuffix(")"),  # what follows the name is read with it
}


def hits_sql(source: str, name: str) -> str:
    d = P.BY_NAME[name]
    pattern = quoted(_SQL_PATTERN.get(name, d.pattern))
    return f"""SELECT doc_id, {d.rank} AS rank, i - 1 AS match_idx, v AS value FROM (
      SELECT doc_id, unnest(l) AS v, generate_subscripts(l, 1) AS i FROM (
        SELECT doc_id, regexp_extract_all(text, {pattern}, {d.group}) AS l FROM ({SOURCE[source][1]})))"""


_ALLOWED = " OR ".join(["lower(h) = 'localhost'", *[f"suffix(lower(h), '{s}')" for s in P.FQDN_ALLOWED_SUFFIXES]])
_LISTED = lambda words: ", ".join(quoted(w) for w in words)
HOST_FILTER = f"""NOT ({_ALLOWED.replace('(h)', '(value)')}) AND NOT regexp_matches(value, '^\\d+(\\.\\d+)+$')
  AND NOT (len(list_filter(string_split(value, '.'), lambda p: regexp_matches(p, '[a-z][A-Z]'))) > 0
    OR string_split(value, '.')[1] IN ({_LISTED(P.CODE_HEADS)}) OR string_split(value, '.')[-1] IN ({_LISTED(P.CODE_TAILS)})
    OR regexp_matches(string_split(value, '.')[-1], '^[A-Z]'))"""
URL_FILTER = "NOT (" + _ALLOWED.replace("(h)", "(regexp_extract(value, '^https?://([^/]+)', 1))") + ")"
PERSON_FILTER = f"len(value) < 60 AND len(list_filter(string_split(lower(value), ' '), lambda p: p IN ({_LISTED(P.NAME_DENYLIST)}))) = 0"
FILTERS = {"fqdn": HOST_FILTER, "url": URL_FILTER} | {n: PERSON_FILTER for n in ("person_header", "person_adjacent", "person_sign_off")}


def _detector(name: str, source: str, with_sql: bool = True) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = detect(SOURCE[source][0](spark, sf_dir), names=[name])
        return rows.select("doc_id", F.col("match_idx").cast("long").alias("match_idx"), "value")

    where = FILTERS.get(name, "true")
    sql = f"SELECT doc_id, CAST(match_idx AS BIGINT) AS match_idx, value FROM ({hits_sql(source, name)}) WHERE {where}"
    query(f"detect_{name}", sql if with_sql else None)(run)


for _name, _source in (
    ("ipv4", "documents"), ("email", "documents"), ("fqdn", "documents"), ("phone", "documents"), ("card", "documents"), ("url", "pages"),
    ("ipv6", "notes"), ("unc_path", "notes"), ("domain_user", "notes"), ("mac", "notes"), ("guid", "notes"), ("street", "notes"), ("corp", "notes"),
    ("person_header", "mails"), ("person_sign_off", "mails"),
):
    _detector(_name, _source)
_detector("person_adjacent", "mails")

# ---------------------------------------------------------------- credentials
KV_SQL = quoted(P.SENSITIVE_KV)
CRED_SQL = quoted(P.CREDENTIAL)


@query("redact", f"SELECT doc_id, regexp_replace(regexp_replace(text, {CRED_SQL}, '[CREDENTIAL-REDACTED]', 'g'), {KV_SQL}, '\\1=[REDACTED]', 'g') AS redacted FROM ({SOURCE['notes'][1]})")
def redact(spark, sf_dir):
    return notes(spark, sf_dir).select("doc_id", redact_kv(redact_credentials(F.col("text"))).alias("redacted"))


@query("credential_flags", f"""SELECT doc_id, regexp_matches(text, {CRED_SQL}) OR regexp_matches(text, {KV_SQL}) AS has_credentials,
  array_to_string(list_concat(list_transform(regexp_extract_all(text, {CRED_SQL}), lambda c: CASE WHEN len(c) <= 6 THEN '***' ELSE concat(substr(c, 1, 6), '…') END),
    list_transform(regexp_extract_all(text, {KV_SQL}, 1), lambda k: concat(k, '=…'))), ',') AS snippets FROM ({SOURCE['documents'][1]} UNION ALL {SOURCE['notes'][1]})""")
def credential_flags(spark, sf_dir):
    rows = docs(spark, sf_dir).unionByName(notes(spark, sf_dir))
    return rows.select("doc_id", has_credentials(F.col("text")).alias("has_credentials"), F.array_join(credential_snippets(F.col("text")), ",").alias("snippets"))


# ---------------------------------------------------------------- minting and substitution
MINTED_KINDS = ["ipv4", "email", "phone", "card", "fqdn"]
_types = "CASE rank " + " ".join(f"WHEN {d.rank} THEN '{d.type}'" for d in P.DETECTORS) + " END"
_categories = "CASE rank " + " ".join(f"WHEN {d.rank} THEN '{d.category}'" for d in P.DETECTORS) + " END"


def mint_cte(source: str, kinds: list[str], alone: bool = False) -> str:
    """hits, firsts and minted of a source; alone: of each document by itself."""
    union = " UNION ALL ".join(f"SELECT * FROM ({hits_sql(source, n)}) WHERE {FILTERS.get(n, 'true')}" for n in kinds)
    own = "doc_id, " if alone else ""
    return f"""hits AS ({union}),
firsts AS (SELECT * FROM (SELECT *, lower(value) AS key, row_number() OVER (PARTITION BY {own}lower(value) ORDER BY doc_id, rank, match_idx) AS k FROM hits) WHERE k = 1),
minted AS (SELECT value AS real_value, type, category, doc_id,
  concat('{{', type, CASE WHEN n > 0 THEN concat('_', n) ELSE '' END, '}}') AS token
  FROM (SELECT *, row_number() OVER (PARTITION BY {own}type ORDER BY doc_id, rank, match_idx) - 1 AS n
        FROM (SELECT *, {_types} AS type, {_categories} AS category FROM firsts)))"""


def apply_cte(source: str, alone: bool = False) -> str:
    """applied (doc_id, text, scrubbed): the minted values of the source's texts replaced, from
    left to right, the longest first, where no word character is next to them."""
    own = "AND d.doc_id = p.doc_id" if alone else ""
    return f"""d AS (SELECT doc_id, text, lower(text) AS low FROM ({SOURCE[source][1]})),
cut AS (SELECT d.doc_id, p.token, len(p.real_value) AS n, list_transform(string_split(d.low, lower(p.real_value)), lambda x: len(x)) AS gaps
  FROM d JOIN minted p ON contains(d.low, lower(p.real_value)) {own}),
occ AS (SELECT doc_id, token, n, unnest(list_transform(range(1, len(gaps)), lambda i: list_sum(gaps[1:i]) + (i - 1) * n + 1))::BIGINT AS at FROM cut),
fit AS (SELECT o.* FROM occ o JOIN d USING (doc_id) WHERE NOT regexp_matches(CASE WHEN o.at > 1 THEN d.low[o.at - 1] ELSE '' END, '[\\pL\\pN_]')
  AND NOT regexp_matches(d.low[o.at + o.n], '[\\pL\\pN_]')),
walk AS (SELECT doc_id, 0 AS step, 1::BIGINT AS begun, 1::BIGINT AS at, 1::BIGINT AS done, '' AS token FROM d
  UNION ALL
  SELECT w.doc_id, w.step + 1, w.done, f.at, f.at + f.n, f.token FROM walk w JOIN fit f ON f.doc_id = w.doc_id AND f.at >= w.done
  QUALIFY row_number() OVER (PARTITION BY w.doc_id ORDER BY f.at, f.n DESC) = 1),
applied AS (SELECT d.doc_id, any_value(d.text) AS text,
  concat(string_agg(concat(substr(d.text, w.begun, w.at - w.begun), w.token), '' ORDER BY w.step), substr(any_value(d.text), max(w.done))) AS scrubbed
  FROM d JOIN walk w USING (doc_id) WHERE d.text IS NOT NULL GROUP BY d.doc_id)"""


MINT_CTE = mint_cte("documents", MINTED_KINDS)
SCRUBBED_KINDS = [*MINTED_KINDS, "person_adjacent"]  # what a scrub of the documents finds
NOTED_KINDS = ["ipv4", "ipv6", "unc_path", "domain_user", "mac", "guid", "street", "url", "fqdn"]
REDACTED = "regexp_replace(regexp_replace(a.scrubbed, {c}, '[CREDENTIAL-REDACTED]', 'g'), {k}, '\\1=[REDACTED]', 'g')".format(c=CRED_SQL, k=KV_SQL)


def scrub_sql(alone: bool = False) -> str:
    """A scrub of the documents, with one vocabulary or with one for each."""
    return f"""WITH RECURSIVE {mint_cte('documents', SCRUBBED_KINDS, alone)}, {apply_cte('documents', alone)},
per AS (SELECT doc_id, count(DISTINCT lower(value)) AS n FROM hits GROUP BY 1)
SELECT a.doc_id, {REDACTED} AS scrubbed, COALESCE(per.n, 0) AS n_minted,
  regexp_matches(a.text, {CRED_SQL}) OR regexp_matches(a.text, {KV_SQL}) AS has_credentials,
  {REDACTED} <> a.text OR regexp_matches(a.text, {CRED_SQL}) OR regexp_matches(a.text, {KV_SQL}) OR a.doc_id IN (SELECT doc_id FROM minted) AS modified
FROM applied a LEFT JOIN per USING (doc_id)"""


def minted(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    hits = detect(docs(spark, sf_dir) if rows is None else rows, names=MINTED_KINDS).withColumn("doc_order", F.col("doc_id"))
    return saved(assign_tokens(first_by_key(hits, scrub.ORDER), known, scrub.ORDER), "minted")


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minted values as a vocabulary table."""
    rows = minted(spark, sf_dir)
    zero = F.lit(0).cast("long")
    return rows.select("real_value", "token", "category", "confidence", zero.alias("first_seen"), zero.alias("last_seen"), F.lit(1).cast("long").alias("hit_count"), F.lit(None).cast("string").alias("project"), F.lit("auto").alias("confirmed_by"))


@query("mint_tokens", f"WITH {MINT_CTE} SELECT real_value, token, type, category, doc_id FROM minted")
def mint_tokens(spark, sf_dir):
    return minted(spark, sf_dir).select("real_value", "token", "type", "category", "doc_id")


@query("mint_continues", f"WITH {MINT_CTE} SELECT real_value, concat('{{', type, '_', n + 41, '}}') AS token FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY doc_id, rank, match_idx) AS n FROM (SELECT *, value AS real_value, {_types} AS type FROM firsts))")
def mint_continues(spark, sf_dir):
    """A vocabulary whose numbers have come to 41 continues with 42."""
    types = sorted({P.BY_NAME[n].type for n in MINTED_KINDS})
    known = table(spark, sf_dir, "region").limit(1).select(F.explode(F.array(*map(F.lit, types))).alias("t")).select(F.concat(F.lit("known "), "t").alias("real_value"), F.concat(F.lit("{"), "t", F.lit("_41}")).alias("token"))
    return minted(spark, sf_dir, known=known).select("real_value", "token")


@query("premint_names", """WITH n AS (SELECT 0 AS rank, s_suppkey AS match_idx, s_name AS value, 'CUSTOMER' AS type FROM supplier
  UNION ALL SELECT 1, s_suppkey, concat('Person ', row_number() OVER (ORDER BY s_suppkey)), 'PERSON' FROM supplier)
SELECT value AS real_value, concat('{', type, CASE WHEN n > 0 THEN concat('_', n) ELSE '' END, '}') AS token
FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY rank, match_idx) - 1 AS n FROM n)""")
def premint_names(spark, sf_dir):
    """The configured names come before all hits; names shaped like tokens and blank ones are refused."""
    names = [r["s_name"] for r in table(spark, sf_dir, "supplier").orderBy("s_suppkey").select("s_name").collect()]
    config = ScrubConfig(customer_names=(*names, "{CUSTOMER_3}", " "), person_names=tuple(f"Person {i}" for i in range(1, len(names) + 1)))
    hits = detect(docs(spark, sf_dir), names=["ipv4"]).withColumn("doc_order", F.col("doc_id"))
    return scrub.corpus_tokens(hits, "doc_id", config, None).filter("type <> 'IP'").select("real_value", "token")


@query("mint_reused", f"""WITH {MINT_CTE} SELECT CASE WHEN old THEN upper(real_value) ELSE real_value END AS real_value, CASE WHEN old THEN concat('{{OLD_', doc_id, '_', length(real_value), '}}') ELSE token2 END AS token, NOT old AS is_new
FROM (SELECT *, doc_id % 2 = 0 AS old, concat('{{', type, CASE WHEN row_number() OVER (PARTITION BY type, doc_id % 2 = 0 ORDER BY doc_id, rank, match_idx) > 1 THEN concat('_', row_number() OVER (PARTITION BY type, doc_id % 2 = 0 ORDER BY doc_id, rank, match_idx) - 1) ELSE '' END, '}}') AS token2
  FROM (SELECT f.*, value AS real_value, {_types} AS type FROM firsts f))""")
def mint_reused(spark, sf_dir):
    """Values that the vocabulary has in other letters keep their tokens, whatever their type."""
    known = minted(spark, sf_dir).filter("doc_id % 2 = 0").select(F.upper("real_value").alias("real_value"), F.concat(F.lit("{OLD_"), "doc_id", F.lit("_"), F.length("real_value"), F.lit("}")).alias("token"))
    return minted(spark, sf_dir, known=known).select("real_value", "token", "is_new")


@query("restore_roundtrip", f"WITH RECURSIVE {MINT_CTE}, {apply_cte('documents')} SELECT doc_id, scrubbed, text FROM applied")
def restore_roundtrip(spark, sf_dir):
    tokens = minted(spark, sf_dir)
    applied = apply_map(docs(spark, sf_dir), tokens)
    return restore(applied, tokens, "scrubbed").select("doc_id", "scrubbed", F.col("restored").alias("text"))


@query("apply_large_vocabulary", f"WITH RECURSIVE {MINT_CTE}, {apply_cte('documents')} SELECT doc_id, scrubbed FROM applied")
def apply_large_vocabulary(spark, sf_dir):
    """The way of applying a map that no worker could hold."""
    return apply_by_candidates(docs(spark, sf_dir), minted(spark, sf_dir), out="scrubbed").select("doc_id", "scrubbed")


@query("scrub_corpus", scrub_sql())
def scrub_corpus(spark, sf_dir):
    rows = scrub.scrub_corpus(docs(spark, sf_dir)).documents
    return rows.select("doc_id", "scrubbed", F.size("minted").cast("long").alias("n_minted"), "has_credentials", "modified")


@query("scrub_documents", scrub_sql(alone=True))
def scrub_documents(spark, sf_dir):
    rows = scrub.scrub_documents(docs(spark, sf_dir))
    return rows.select("doc_id", "scrubbed", F.size("minted").cast("long").alias("n_minted"), "has_credentials", "modified")


@query("audit_residual", f"WITH {mint_cte('documents', SCRUBBED_KINDS)} SELECT doc_id, value FROM hits WHERE doc_id % 2 = 0")
def audit_residual(spark, sf_dir):
    """What is left to detect if every other document stays as it was: nothing in the others."""
    rows = scrub.scrub_corpus(docs(spark, sf_dir)).documents
    half = rows.withColumn("scrubbed", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.col("scrubbed")))
    return scrub.audit_residual(half).select("doc_id", "value")


@query("findings_preview", f"""WITH {MINT_CTE}, seen AS (SELECT h.doc_id, upper(min_by(CASE h.rank WHEN 4 THEN 'ip' WHEN 6 THEN 'email' WHEN 14 THEN 'phone' WHEN 16 THEN 'account_number' WHEN 18 THEN 'fqdn' END, h.rank * 100000 + h.match_idx)) AS cat, lower(h.value) AS k FROM hits h GROUP BY h.doc_id, lower(h.value)),
c AS (SELECT doc_id, cat, count(*) AS n FROM seen GROUP BY 1, 2)
SELECT d.doc_id, COALESCE(string_agg(concat(cat, '×', n), ', ' ORDER BY n DESC, cat) FILTER (WHERE cat IS NOT NULL), 'none') AS findings FROM documents d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id""")
def findings_preview(spark, sf_dir):
    from anonspark.operators.mint import minted_tokens

    hits = detect(docs(spark, sf_dir), names=MINTED_KINDS).withColumn("doc_order", F.col("doc_id"))
    per = minted_tokens(hits, minted(spark, sf_dir))
    return scrub.findings_preview(docs(spark, sf_dir).join(per, "doc_id", "left"))


@query("token_runs", f"""WITH RECURSIVE {MINT_CTE}, {apply_cte('documents')},
r AS (SELECT doc_id, string_split_regex(scrubbed, '\\{{[A-Z][A-Z0-9_]*\\}}') AS g, regexp_extract_all(scrubbed, '\\{{[A-Z][A-Z0-9_]*\\}}') AS t FROM applied),
x AS (SELECT doc_id, list_filter(flatten(list_transform(range(1, len(g) + 1), lambda i: [{{'kind': 'text', 'value': g[i]}}, {{'kind': 'token', 'value': t[i]}}])), lambda v: v.value IS NOT NULL AND v.value <> '') AS v FROM r),
y AS (SELECT doc_id, generate_subscripts(v, 1)::INT - 1 AS idx, unnest(v) AS r FROM x)
SELECT y.doc_id, y.idx, y.r.kind AS kind, y.r.value AS value, CASE WHEN y.r.kind = 'token' THEN m.category END AS category FROM y LEFT JOIN (SELECT DISTINCT token, category FROM minted) m ON m.token = y.r.value""")
def token_runs(spark, sf_dir):
    v = vocabulary(spark, sf_dir)
    return scrub.token_runs(apply_map(docs(spark, sf_dir), v), v, text="scrubbed")


@query("tokens_in_output", f"""WITH {MINT_CTE}, seen AS (SELECT DISTINCT doc_id, lower(value) AS k FROM hits),
twice AS (SELECT k FROM seen GROUP BY k HAVING count(*) > 1)
SELECT s.doc_id, m.token, m.real_value, m.category FROM seen s JOIN twice USING (k) JOIN minted m ON lower(m.real_value) = s.k WHERE s.doc_id <> m.doc_id
  AND m.type IN ('IP', 'ACCOUNT', 'PHONE')""")
def tokens_in_output(spark, sf_dir):
    """Tokens of numbers in a document's output that an earlier document minted."""
    v = minted(spark, sf_dir).filter("type IN ('IP', 'ACCOUNT', 'PHONE')")
    own = v.groupBy("doc_id").agg(F.collect_list(F.struct("token")).alias("minted"))
    rows = apply_map(docs(spark, sf_dir), v).join(own, "doc_id", "left").withColumn("minted", F.coalesce("minted", F.array().cast("array<struct<token:string>>")))
    return scrub.tokens_in_output(rows, v)


@query("build_payload", """SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN text ELSE concat(chr(10), '--- file: ', role, ' ---', chr(10), text) END, chr(10) ORDER BY turn) AS payload
FROM conversations WHERE CASE WHEN role = 'user' THEN trim(text) <> '' ELSE text <> '' END GROUP BY conv_id""")
def build_payload(spark, sf_dir):
    kind = F.when(F.col("role") == "user", "composer").otherwise("file")
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ord"), kind.alias("kind"), F.col("role").alias("name"), "text", F.lit(None).cast("string").alias("error"))
    return scrub.build_payload(rows, "conv_id")


_quoted_sql = lambda c: f"concat('\"', replace({c}, chr(92), concat(chr(92), chr(92))), '\"')"


@query("scrub_nested", f"""WITH RECURSIVE {mint_cte('notes', NOTED_KINDS)}, {apply_cte('notes')}
SELECT doc_id, concat('{{"id" : ', doc_id, '.10, "new_string":', {_quoted_sql('text')}, ',"old_string":', {_quoted_sql('text')}, ',"meta":{{"lines":[', {_quoted_sql(REDACTED)}, ']}}}}') AS updated,
  regexp_matches(text, {CRED_SQL}) OR regexp_matches(text, {KV_SQL}) AS has_credentials, {REDACTED} <> text AS modified FROM applied a""")
def scrub_nested(spark, sf_dir):
    """Records whose fields are scrubbed, skipped or no strings; what is no scrubbed string stays as it was written."""
    record = F.to_json(F.struct(F.col("text").alias("new_string"), F.col("text").alias("old_string"), F.struct(F.array("text").alias("lines")).alias("meta")))
    record = F.concat(F.lit('{"id" : '), F.col("doc_id").cast("string"), F.lit(".10, "), F.substring(record, F.lit(2), F.length(record)))
    rows = notes(spark, sf_dir).select("doc_id", record.alias("record"), F.lit("Edit").alias("tool"))
    done = scrub_json(rows, "doc_id", "record", "tool")
    return done.select("doc_id", "updated", "has_credentials", "modified")


# ---------------------------------------------------------------- vocabulary
@query("vocab_categories", f"WITH {MINT_CTE} SELECT category, count(*) AS n FROM minted GROUP BY category HAVING count(*) >= 3")
def vocab_categories(spark, sf_dir):
    return vocab.categories_above(vocabulary(spark, sf_dir))


@query("vocab_list", f"WITH {MINT_CTE} SELECT real_value, token FROM minted WHERE category = 'email'")
def vocab_list(spark, sf_dir):
    return vocab.listed(vocabulary(spark, sf_dir), "email").select("real_value", "token")


@query("vocab_search", f"WITH {MINT_CTE} SELECT real_value, token FROM minted WHERE category = 'ip' AND (contains(lower(token), '1') OR contains(lower(real_value), '1'))")
def vocab_search(spark, sf_dir):
    return vocab.searched(vocabulary(spark, sf_dir), "1", "IP").select("real_value", "token")


@query("vocab_by_category", f"WITH {MINT_CTE} SELECT lower(category) AS category, count(*) AS n FROM minted GROUP BY 1")
def vocab_by_category(spark, sf_dir):
    return vocab.by_category(vocabulary(spark, sf_dir))


@query("vocab_upsert", f"""WITH {MINT_CTE}, e AS (SELECT DISTINCT value AS real_value FROM hits WHERE rank = 4)
SELECT COALESCE(m.real_value, e.real_value) AS real_value, COALESCE(m.token, concat('new ', e.real_value)) AS token,
  CAST(CASE WHEN m.real_value IS NOT NULL AND e.real_value IS NOT NULL THEN 2 ELSE 1 END AS BIGINT) AS hit_count,
  CAST(CASE WHEN e.real_value IS NOT NULL THEN 7 ELSE 0 END AS BIGINT) AS last_seen FROM minted m FULL JOIN e USING (real_value)""")
def vocab_upsert(spark, sf_dir):
    again = detect(docs(spark, sf_dir), names=["ipv4"]).select(F.col("value").alias("real_value"), F.concat(F.lit("new "), "value").alias("token"), "category", "confidence")
    return vocab.upsert(vocabulary(spark, sf_dir), again, F.lit(7).cast("long")).select("real_value", "token", "hit_count", "last_seen")


@query("vocab_changes", f"""WITH {MINT_CTE}, a AS (SELECT DISTINCT value AS real_value, 4 AS day FROM hits WHERE rank = 4 UNION SELECT DISTINCT value, 5 FROM hits WHERE rank IN (4, 6) UNION SELECT concat('new ', value), 6 FROM hits WHERE rank = 14),
c AS (SELECT real_value, count(*) AS n, max(day) AS last FROM a GROUP BY 1)
SELECT COALESCE(m.real_value, c.real_value) AS real_value, COALESCE(m.token, concat('day ', (SELECT min(day) FROM a WHERE a.real_value = c.real_value))) AS token, CAST(COALESCE(c.n, 0) + CASE WHEN m.real_value IS NULL THEN 0 ELSE 1 END AS BIGINT) AS hit_count, CAST(COALESCE(c.last, 0) AS BIGINT) AS last_seen
FROM minted m FULL JOIN c USING (real_value)""")
def vocab_changes(spark, sf_dir):
    """A stored vocabulary, read after three days of changes to it."""
    store = VocabStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", part_rows=100)
    store.write("vocab", vocabulary(spark, sf_dir))
    hits = saved(detect(docs(spark, sf_dir), names=["ipv4", "email", "phone"]).select("rank", F.col("value").alias("real_value"), "category", "confidence"), "hits")
    days = {4: hits.filter("rank = 4"), 5: hits.filter("rank IN (4, 6)"), 6: hits.filter("rank = 14").withColumn("real_value", F.concat(F.lit("new "), "real_value"))}
    for day, rows in days.items():
        seen = saved(rows.select("real_value", F.lit(f"day {day}").alias("token"), "category", "confidence").distinct(), "seen")
        store.merge("vocab", saved(vocab.upsert(store.look_up("vocab", seen), seen, F.lit(day).cast("long")), "changed"))
    return store.read("vocab").select("real_value", "token", "hit_count", "last_seen")


@query("vocab_forget", f"WITH {MINT_CTE} SELECT real_value AS value, 'kept' AS state FROM minted WHERE category <> 'phone' UNION ALL SELECT real_value, 'allowed' FROM minted WHERE category = 'phone'")
def vocab_forget(spark, sf_dir):
    v = vocabulary(spark, sf_dir)
    allow = spark.createDataFrame([], "pattern string, is_regex boolean, added_by string, added_at long, reason string")
    kept, listed = vocab.forget(v, v.filter("category = 'phone'").select(F.upper("real_value").alias("value")), allow, F.lit(0).cast("long"))
    return kept.select(F.col("real_value").alias("value"), F.lit("kept").alias("state")).unionByName(listed.select(F.col("pattern").alias("value"), F.lit("allowed").alias("state")))


@query("vocab_view", f"WITH {MINT_CTE} SELECT token, real_value, category, CAST(CASE WHEN category = 'ip' THEN 1 ELSE 0 END AS BIGINT) AS uses FROM minted")
def vocab_view(spark, sf_dir):
    v = vocabulary(spark, sf_dir)
    return vocab.view(v.filter("category = 'email'"), v, v.filter("category = 'ip'"))


@query("map_envelope", f"WITH {MINT_CTE} SELECT token, real_value AS real FROM minted")
def map_envelope(spark, sf_dir):
    return vocab.import_map(vocab.export_map(vocabulary(spark, sf_dir)))


@query("map_files", f"WITH {MINT_CTE} SELECT token, real_value AS real FROM minted")
def map_files(spark, sf_dir):
    """The envelope as part files, and read again."""
    path = f"{shared_dir(spark)}/envelope-{uuid.uuid4().hex}"
    vocab.write_envelope(vocabulary(spark, sf_dir), path)
    return vocab.read_envelope(spark, path)


@query("allowlist_gate", f"WITH h AS ({hits_sql('documents', 'ipv4')}) SELECT doc_id, value FROM h WHERE NOT regexp_matches(value, '^1') AND lower(value) NOT IN (SELECT DISTINCT value FROM h WHERE doc_id % 2 = 0)")
def allowlist_gate(spark, sf_dir):
    hits = saved(detect(docs(spark, sf_dir), names=["ipv4"]).select("doc_id", "value"), "hits")
    literal = hits.filter("doc_id % 2 = 0").select(F.col("value").alias("pattern"), F.lit(False).alias("is_regex")).distinct()
    allow = literal.unionByName(table(spark, sf_dir, "region").limit(1).select(F.lit("^1").alias("pattern"), F.lit(True).alias("is_regex")))
    return drop_allowlisted(hits, allow)


_pick = lambda words, key: "CASE " + " ".join(f"WHEN {key} % {len(words)} = {i} THEN {'NULL' if w is None else quoted(w)}" for i, w in enumerate(words)) + " END"
#: (value, category, reason) and (pattern, whether a regex, reason), one of each rule.
_ENTRIES = (
    (" Customer", "customer", None), (" ", "customer", "value required"), ("x" * 201, "customer", "value too long"), ("a\x01b", "customer", "control characters not allowed"), ("a\u200bb", "customer", "control characters not allowed"),
    ("Acme", "Bad!", "invalid category"), ("Acme", "1abc", "invalid category"), ("ghp_" + "a1" * 18, "customer", "credential-shape rejected"), ("\uff21cme", "org_2", None),
)
_ALLOWED_ENTRIES = (
    ("abc", False, "pattern too short"), ("abcde", True, "pattern too short"), ("abcd", False, None), ("(abcde", True, "invalid regex pattern"), ("x*y*z*", True, "pattern matches empty string"), ("x" * 201, False, "pattern too long"),
    ("ab\x02cd", False, "control characters not allowed"), ("ghp_" + "a1" * 18, False, "credential-shape rejected"), ("abc.+d", True, None),
)


@query("validate_entries", f"SELECT c_custkey, {_pick([e[2] for e in _ENTRIES], 'c_custkey')} AS reason FROM customer")
def validate_entries(spark, sf_dir):
    """Every rule for a value of the vocabulary."""
    part = lambda i: F.expr(_pick([e[i] for e in _ENTRIES], "c_custkey"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", part(0).alias("value"), part(1).alias("category"))
    return vocab.validated(rows).select("c_custkey", "reason")


@query("validate_allowlist", f"SELECT c_custkey, {_pick([e[2] for e in _ALLOWED_ENTRIES], 'c_custkey')} AS reason FROM customer")
def validate_allowlist(spark, sf_dir):
    """Every rule for an entry of the allowlist."""
    regex = F.expr(_pick(["yes" if e[1] else "no" for e in _ALLOWED_ENTRIES], "c_custkey")) == "yes"
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_pick([e[0] for e in _ALLOWED_ENTRIES], "c_custkey")).alias("value"), regex.alias("is_regex"))
    return vocab.validated(rows, allowlist=True).select("c_custkey", "reason")


@query("vocab_confirmed", f"WITH {MINT_CTE} SELECT real_value, token FROM minted WHERE doc_id % 3 <> 0")
def vocab_confirmed(spark, sf_dir):
    """Rows without a confirmation, and values shaped like tokens, are not applied."""
    open_ = minted(spark, sf_dir).filter("doc_id % 3 = 0").select("real_value").distinct()
    v = vocabulary(spark, sf_dir)
    v = v.join(open_.withColumn("_o", F.lit(True)), "real_value", "left").withColumn("confirmed_by", F.when(F.col("_o").isNull(), F.col("confirmed_by"))).drop("_o")
    shaped = v.limit(1).withColumns({"real_value": F.lit("{IP_3}"), "confirmed_by": F.lit("auto")}).select(v.columns)
    return vocab.confirmed_map(v.unionByName(shaped)).select("real_value", "token")


@query("vocab_lookup", f"WITH {MINT_CTE} SELECT token, real_value, category FROM minted WHERE type = 'IP'")
def vocab_lookup(spark, sf_dir):
    wanted = minted(spark, sf_dir).filter("type = 'IP'").select("token").unionByName(table(spark, sf_dir, "region").select(F.concat(F.lit("{NONE_"), "r_regionkey", F.lit("}")).alias("token")))
    return vocab.look_up_tokens(wanted, vocabulary(spark, sf_dir)).select("token", "real_value", "category")


@query("vocab_clear", f"WITH {MINT_CTE} SELECT count(*) AS deleted, 0::BIGINT AS remaining FROM minted")
def vocab_clear(spark, sf_dir):
    return vocab.clear(vocabulary(spark, sf_dir))[1]


@query("vocab_merge_last", f"WITH {MINT_CTE} SELECT token, CASE WHEN category = 'email' THEN concat('later ', real_value) ELSE real_value END AS real_value FROM minted")
def vocab_merge_last(spark, sf_dir):
    v = vocabulary(spark, sf_dir).select("token", "real_value")
    later = v.filter("token LIKE '{EMAIL%'").withColumn("real_value", F.concat(F.lit("later "), "real_value"))
    return vocab.merge_last([v, later]).select("token", "real_value")


@query("allowlist_upsert", "SELECT s_name AS pattern, s_suppkey % 2 = 0 AS is_regex FROM supplier")
def allowlist_upsert(spark, sf_dir):
    """The last entry of a pattern wins."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("pattern"), (F.col("s_suppkey") % 2 == 0).alias("is_regex"), F.lit("user").alias("added_by"), F.lit(1).cast("long").alias("added_at"), F.lit("r").alias("reason"))
    before = rows.withColumns({"is_regex": ~F.col("is_regex"), "added_at": F.lit(2).cast("long")})
    return vocab.allow_upsert(before, rows).select("pattern", "is_regex")


# ---------------------------------------------------------------- review
VENDOR = "concat('Vendor', chr(97 + CAST(s_suppkey % 26 AS INT)), chr(97 + CAST(s_nationkey AS INT)), ' Holdings')"
_text = f"concat('Please talk to {{V}} today or not')".replace("{V}", f"', {VENDOR}, '")
_queue_sql = f"SELECT s_suppkey AS doc_id, {VENDOR} AS span FROM supplier WHERE s_nationkey <> 3 AND NOT regexp_matches({VENDOR}, '(?i)^Vendora')"


def _queue(spark, sf_dir):
    texts = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS doc_id", f"{_text} AS text", "s_nationkey", f"{VENDOR} AS vendor")
    hits = detect(texts.select("doc_id", "text"), names=["corp"])
    tokens = hits.limit(0).selectExpr("lower(value) AS key")
    doubt = scrub.unsure_spans(texts.select("doc_id", "text"), hits, tokens, "doc_id", "text")
    spans = doubt.select("doc_id", F.explode_outer("unsure").alias("u")).select("doc_id", F.col("u.span").alias("span"), F.col("u.surrounding").alias("surrounding"), F.col("u.suggested_category").alias("suggested_cat"), F.col("u.confidence").alias("confidence"), F.lit("scrub").alias("source_event"))
    known = texts.filter("s_nationkey = 3").select(F.col("vendor").alias("real_value"))
    allow = table(spark, sf_dir, "region").limit(1).select(F.lit("^Vendora").alias("pattern"), F.lit(True).alias("is_regex"))
    empty = spark.createDataFrame([], "id long, span string, surrounding string, suggested_cat string, confidence double, source_event string, detected_at long, status string")
    return review.enqueue(empty, spans, known, allow, F.lit(5).cast("long")), allow


@query("review_pending", f"SELECT span, concat('Please talk to ', span, ' today or not') AS surrounding FROM ({_queue_sql}) WHERE span NOT IN (SELECT {VENDOR} FROM supplier WHERE s_nationkey = 3)")
def review_pending(spark, sf_dir):
    queue, allow = _queue(spark, sf_dir)
    return review.pending(queue, allow).select("span", "surrounding")


@query("review_triage", f"""WITH q AS (SELECT DISTINCT span FROM ({_queue_sql}) WHERE span NOT IN (SELECT {VENDOR} FROM supplier WHERE s_nationkey = 3))
SELECT CASE WHEN regexp_matches(span, '[a-m] Holdings$') THEN 'confirmed' ELSE 'allowlisted' END AS state, span AS value FROM q""")
def review_triage(spark, sf_dir):
    queue, allow = _queue(spark, sf_dir)
    queue = saved(queue, "queue")
    action = F.when(F.col("span").rlike("[a-m] Holdings$"), "confirm").otherwise("allowlist")
    decisions = queue.select("id", action.alias("action"), F.lit(None).cast("string").alias("category"))
    empty = vocabulary(spark, sf_dir).limit(0)
    none = spark.createDataFrame([], "pattern string, is_regex boolean, added_by string, added_at long, reason string")
    _, words, listed, _ = review.triage(queue, decisions, empty, none, F.lit(6).cast("long"))
    return words.select(F.lit("confirmed").alias("state"), F.col("real_value").alias("value")).unionByName(listed.select(F.lit("allowlisted").alias("state"), F.col("pattern").alias("value")))


@query("review_origin", f"SELECT span, CASE WHEN s % 3 = 0 THEN 'judge' ELSE 'scrub' END AS origin FROM (SELECT {VENDOR} AS span, s_suppkey AS s FROM supplier)")
def review_origin(spark, sf_dir):
    source = F.when(F.col("s_suppkey") % 3 == 0, "judge:LLM").otherwise("scrub")
    queue = table(spark, sf_dir, "supplier").select(F.expr(VENDOR).alias("span"), source.alias("source_event"))
    both = [review.by_origin(queue, judged).select("span", F.lit(name).alias("origin")) for judged, name in ((True, "judge"), (False, "scrub"))]
    return both[0].unionByName(both[1])


# ---------------------------------------------------------------- gate, log, statistics
_LOG = ["event_id % 3 AS tokens_minted", "user_id % 2 AS tokens_reused", "CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS blocked"]
_DAYS = f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS events, CAST(sum(tokens_minted) AS BIGINT) AS minted, CAST(sum(tokens_reused) AS BIGINT) AS reused, CAST(sum(blocked) AS BIGINT) AS blocked FROM (SELECT ts, {', '.join(_LOG)} FROM events) GROUP BY 1"


@query("daily_stats", _DAYS)
def daily_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("unix_millis(CAST(ts AS TIMESTAMP)) AS timestamp", *_LOG)
    return gate.daily_stats(rows).withColumn("day", F.col("day").cast("string"))


@query("daily_counts_windowed", _DAYS)
def daily_counts_windowed(spark, sf_dir):
    return daily_counts(table(spark, sf_dir, "events").selectExpr("ts", *_LOG)).withColumn("day", F.col("day").cast("string"))


_SAID = "concat(text, CASE WHEN conv_id % 7 = 0 AND turn = 1 THEN ' password=hunter22' ELSE '' END)"


@query("conversation_gate", f"""WITH m AS (SELECT conv_id, turn, role, regexp_matches(t, {CRED_SQL}) OR regexp_matches(t, {KV_SQL}) AS bad FROM (SELECT *, {_SAID} AS t FROM conversations))
SELECT conv_id, turn, CASE WHEN role IN ('assistant', 'system') THEN role ELSE 'user' END AS role, bool_or(bad) OVER (PARTITION BY conv_id) AS rejected FROM m""")
def conversation_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("text", F.expr(_SAID)).withColumn("has_credentials", has_credentials(F.col("text")))
    return gate.conversation_gate(rows).select("conv_id", "turn", "role", "rejected")


@query("event_gate", """SELECT event_id, CASE WHEN big THEN 'warn' WHEN small THEN 'pass' WHEN k = 0 AND (c OR p) THEN 'block' WHEN c THEN 'block' WHEN k = 1 AND p THEN 'mutate' WHEN k = 2 AND p THEN 'warn' ELSE 'pass' END AS decision,
CASE WHEN NOT big AND NOT small AND (k = 0 AND (c OR p) OR c) THEN 1 ELSE 0 END AS blocked
FROM (SELECT event_id, event_id % 3 AS k, event_id % 10 = 0 AS c, user_id % 4 = 0 AS p, event_id % 17 = 0 AS big, event_id % 3 = 0 AND event_id % 7 < 4 AS small FROM events)""")
def event_gate(spark, sf_dir):
    """Events of all kinds and modes of content, some too large and some prompts too short."""
    kind = F.element_at(F.array(F.lit("UserPromptSubmit"), F.lit("PreToolUse"), F.lit("PostToolUse")), (F.col("event_id") % 3 + 1).cast("int"))
    pii = F.col("user_id") % 4 == 0
    rows = table(spark, sf_dir, "events").select(
        "event_id", kind.alias("kind"), (F.col("event_id") % 7).alias("size"), F.when(F.col("event_id") % 17 == 0, gate.MAX_INPUT + 1).otherwise(gate.MAX_INPUT).alias("payload_size"), (F.col("event_id") % 10 == 0).alias("has_credentials"),
        pii.alias("modified"), F.when(pii, 1).otherwise(0).alias("n_minted"), F.lit(0).alias("n_reused"))
    return gate.decide(rows).select("event_id", "decision", "blocked")


@query("log_rows", """SELECT event_id AS session_id, CASE WHEN c AND k > 0 THEN 0 ELSE p END AS tokens_minted, 0 AS tokens_reused, CASE WHEN k = 0 OR c THEN 1 ELSE 0 END AS blocked
FROM (SELECT CAST(event_id AS VARCHAR) AS event_id, event_id % 3 AS k, event_id % 10 = 0 AS c, CASE WHEN user_id % 4 = 0 THEN 1 ELSE 0 END AS p FROM events)
WHERE c OR p = 1 AND k < 2""")
def log_rows(spark, sf_dir):
    """What the log keeps of the decisions on all events."""
    kind = F.element_at(F.array(F.lit("UserPromptSubmit"), F.lit("PreToolUse"), F.lit("PostToolUse")), (F.col("event_id") % 3 + 1).cast("int"))
    pii = F.col("user_id") % 4 == 0
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("session_id"), kind.alias("kind"), kind.alias("event"), F.lit(100).alias("size"), F.lit(100).alias("payload_size"),
        (F.col("event_id") % 10 == 0).alias("has_credentials"), pii.alias("modified"), F.when(pii, 1).otherwise(0).alias("n_minted"), F.lit(0).alias("n_reused"))
    return gate.log_rows(gate.decide(rows), F.lit(0).cast("long")).select("session_id", "tokens_minted", "tokens_reused", "blocked")


@query("auto_approve", "SELECT doc_id, toxic = 0 AND quality = 1 AS approved FROM labels UNION ALL SELECT doc_id, false FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def auto_approve(spark, sf_dir):
    judged = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("long").alias("suspicious_count"), (F.col("quality") == 0).alias("failed"))
    return gate.auto_approve(docs(spark, sf_dir).select("doc_id", F.lit(False).alias("modified")), judged, True)


_HOT_KEY = "CASE WHEN event_id % 3 = 0 THEN 1 WHEN user_id % 20 = 0 THEN NULL ELSE user_id % 20 END"


@query("rate_limit", f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ms, event_id) AS i
  FROM (SELECT {_HOT_KEY} AS k, epoch_ns(ts) // 1000000 // 2000 AS ms, event_id FROM events)),
r AS (SELECT k, ms, event_id, i, true AS accepted, [ms] AS kept FROM e WHERE i = 1
  UNION ALL
  SELECT k, ms, event_id, i, len(l) < 10, CASE WHEN len(l) < 10 THEN list_append(l, ms) ELSE l END FROM (
    SELECT e.k, e.ms, e.event_id, e.i, list_transform(list_filter(list_transform(r.kept, lambda x: {{'t': x, 'now': e.ms}}), lambda y: y.t > y.now - 10000), lambda y: y.t) AS l
      FROM r JOIN e ON e.k IS NOT DISTINCT FROM r.k AND e.i = r.i + 1))
SELECT k AS user_id, ms, event_id, accepted FROM r""")
def rate_limit(spark, sf_dir):
    """Users whose events come two thousand times as fast, so that many are refused; one has a third
    of all events, some events have no user."""
    rows = table(spark, sf_dir, "events").selectExpr(f"{_HOT_KEY} AS user_id", "unix_millis(CAST(ts AS TIMESTAMP)) DIV 2000 AS ms", "event_id")
    return gate.rate_limit(rows, "user_id", "ms", "event_id")


# ---------------------------------------------------------------- sources
@query("source_texts", """SELECT CASE b WHEN 0 THEN 'file too large' WHEN 1 THEN 'binary file' WHEN 2 THEN 'not UTF-8' END AS error, CASE WHEN b > 2 THEN text END AS text,
  strlen(text) + CASE WHEN b = 0 THEN 6000000 WHEN b < 3 THEN 1 ELSE 0 END AS size
FROM (SELECT page_id % 16 AS b, concat(string_agg(concat(page_id, ' ', url), chr(10) ORDER BY page_id), chr(10)) AS text FROM pages GROUP BY 1)
UNION ALL SELECT 'unsupported file type', NULL, 0""")
def source_texts(spark, sf_dir):
    """Files of the pages' addresses, one of which is too large, one binary, one no UTF-8, and one of another kind."""
    path = f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}"
    line = F.array_sort(F.collect_list(F.struct("page_id", F.concat_ws(" ", "page_id", "url").alias("l"))))
    per = table(spark, sf_dir, "pages").groupBy((F.col("page_id") % 16).alias("b")).agg(F.array_join(F.transform(line, lambda x: x["l"]), "\n").alias("t"))
    more = F.when(F.col("b") == 0, F.repeat(F.lit("x"), F.lit(6_000_000))).when(F.col("b") == 1, F.lit("\x00")).when(F.col("b") == 2, F.unhex(F.lit("FF")).cast("string")).otherwise("")
    per.select("b", F.concat(more, "t").alias("value")).write.partitionBy("b").text(f"{path}/a")
    table(spark, sf_dir, "region").coalesce(1).write.parquet(f"{path}/b")
    rows = read_text_corpus(spark, path)
    other = F.col("error") == "unsupported file type"
    return rows.select("error", "text", F.when(other, 0).otherwise(F.col("size")).alias("size"))


@query("source_events", """SELECT concat('s', user_id) AS session_id, CASE event_id % 3 WHEN 0 THEN 'UserPromptSubmit' WHEN 1 THEN 'PreToolUse' ELSE 'PostToolUse' END AS kind, concat('say "', event_id, '"') AS said
FROM events WHERE event_id % 7 > 0""")
def source_events(spark, sf_dir):
    """Events from lines of JSON, of which every seventh breaks off; their kinds are told by their fields."""
    path = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"
    field = F.element_at(F.array(F.lit("prompt"), F.lit("tool_input"), F.lit("tool_result")), (F.col("event_id") % 3 + 1).cast("int"))
    line = F.concat(F.lit('{"session_id":"s'), "user_id", F.lit('","'), field, F.lit('":"say \\"'), "event_id", F.lit('\\""'), F.when(F.col("event_id") % 7 > 0, "}").otherwise(""))
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    return read_events(spark, path).select("session_id", "kind", F.coalesce("prompt", "tool_input", "tool_result").alias("said"))


_CELL = "concat('line \"', c_custkey, '\"', chr(10), 'next, line ', c_name, chr(10))"


@query("source_tables", f"SELECT CAST(c_custkey AS VARCHAR) AS id, {_CELL} AS notes, c_mktsegment AS segment FROM customer")
def source_tables(spark, sf_dir):
    """A table of cells with quotes, commas and line breaks, written and read again as CSV."""
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", f"{_CELL} AS notes", "c_mktsegment AS segment")
    return read_table(spark, write_scrubbed(rows, f"{shared_dir(spark)}/table-{uuid.uuid4().hex}.csv"))


# ---------------------------------------------------------------- streams
_SPAN = "SELECT *, epoch_ns(ts) // 1000000 AS ms, min(epoch_ns(ts) // 1000000) OVER () + (max(epoch_ns(ts) // 1000000) OVER () - min(epoch_ns(ts) // 1000000) OVER ()) // 3 AS third FROM events"


def _in_three_runs(spark, sf_dir: str, start: Callable[[DataFrame, str], DataStreamWriter], by: str = "ms", late: int | None = None) -> str:
    """Runs a stream of the events three times from one checkpoint, each time over all files that are
    there: the thirds by a column, and with the last one the tenth of the events of the first that are
    late by `late` or more. The folder of what the stream keeps."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").withColumn("ms", F.expr("unix_millis(CAST(ts AS TIMESTAMP))"))
    span = events.agg(F.min(by).alias("a"), F.max(by).alias("b")).first()
    step = (span["b"] - span["a"]) // 3
    one, two = span["a"] + step, span["a"] + 2 * step
    behind = (F.col("event_id") % 10 == 0) & (F.col(by) < one - late) if late is not None else F.lit(False)
    empty = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(empty)
    spark.conf.set(empty, "false")  # else batches without rows go on to look for idle keys
    try:
        for some in ((F.col(by) < one) & ~behind, (F.col(by) >= one) & (F.col(by) < two), (F.col(by) >= two) | behind):
            events.filter(some).write.mode("append").parquet(f"{folder}/in")
            query = start(spark.readStream.schema(events.schema).parquet(f"{folder}/in"), folder).trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.set(empty, before)
    return folder


@query("stream_daily_counts", f"""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS events, CAST(sum(tokens_minted) AS BIGINT) AS minted, CAST(sum(tokens_reused) AS BIGINT) AS reused, CAST(sum(blocked) AS BIGINT) AS blocked
FROM (SELECT ts, {', '.join(_LOG)} FROM ({_SPAN}) WHERE NOT (event_id % 10 = 0 AND ms < third - 259200000)) GROUP BY 1""")
def stream_daily_counts(spark, sf_dir):
    """Counts by day as a stream keeps them, without the events that come three days late."""
    def start(stream: DataFrame, folder: str) -> DataStreamWriter:
        days = daily_counts(stream.selectExpr("CAST(ts AS TIMESTAMP) AS ts", *_LOG))
        write = lambda rows, batch: rows.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{folder}/out")
        return days.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/check")

    rows = spark.read.parquet(f"{_in_three_runs(spark, sf_dir, start, late=259_200_000)}/out")
    last = rows.groupBy("day").agg(F.max_by(F.struct("events", "minted", "reused", "blocked"), "batch").alias("r"))
    return last.select(F.col("day").cast("string").alias("day"), "r.*")


@query("stream_rate_limit", f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ms, event_id) AS i
  FROM (SELECT user_id % 20 AS k, ms // 2000 AS ms, event_id FROM ({_SPAN}) WHERE NOT (event_id % 10 = 0 AND ms < third - 600000000))),
r AS (SELECT k, ms, i, true AS accepted, [ms] AS kept FROM e WHERE i = 1
  UNION ALL
  SELECT k, ms, i, len(l) < 10, CASE WHEN len(l) < 10 THEN list_append(l, ms) ELSE l END FROM (
    SELECT e.k, e.ms, e.i, list_transform(list_filter(list_transform(r.kept, lambda x: {{'t': x, 'now': e.ms}}), lambda y: y.t > y.now - 10000), lambda y: y.t) AS l
      FROM r JOIN e ON e.k = r.k AND e.i = r.i + 1))
SELECT k AS user_id, ms, accepted FROM r""")
def stream_rate_limit(spark, sf_dir):
    """The rate limit as a stream keeps it over a restart, without the events that come late."""
    def start(stream: DataFrame, folder: str) -> DataStreamWriter:
        rows = rate_limit_stream(stream.selectExpr("user_id % 20 AS user_id", "ms DIV 2000 AS ms"), "user_id", "ms")
        return rows.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check")

    return spark.read.parquet(f"{_in_three_runs(spark, sf_dir, start, late=600_000_000)}/out")


@query("stream_scrub", f"WITH RECURSIVE {mint_cte('notes', NOTED_KINDS)}, {apply_cte('notes')} SELECT doc_id, {REDACTED} AS scrubbed FROM applied a")
def stream_scrub(spark, sf_dir):
    """The notes scrubbed as they arrive, in three runs with one stored vocabulary."""
    def start(stream: DataFrame, folder: str) -> DataStreamWriter:
        store = VocabStore(spark, f"{folder}/store")
        return scrub_stream(stream.selectExpr("event_id AS doc_id", f"{NOTE} AS text"), store, f"{folder}/out", f"{folder}/check")

    return spark.read.parquet(f"{_in_three_runs(spark, sf_dir, start, by="event_id")}/out").select("doc_id", "scrubbed")


@query("overall_counts", f"WITH {MINT_CTE} SELECT 'vocab_size' AS name, count(*) AS n FROM minted UNION ALL SELECT 'pending', count(*) FROM ({_queue_sql}) WHERE span NOT IN (SELECT {VENDOR} FROM supplier WHERE s_nationkey = 3)")
def overall_counts(spark, sf_dir):
    return gate.overall_counts(vocabulary(spark, sf_dir), _queue(spark, sf_dir)[0])


# ---------------------------------------------------------------- tables
_CONTACTS_SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in CONTACT.items()) + " FROM customer"


def contacts(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(*[f"{e} AS {c}" for c, e in CONTACT.items()])


def _token(type_: str, value: str) -> str:
    return f"concat('{{{type_}', CASE WHEN {value} > 0 THEN concat('_', {value}) ELSE '' END, '}}')"


_number = lambda value: f"(SELECT k.v, row_number() OVER (ORDER BY k.r) - 1 AS n FROM (SELECT {value} AS v, min(c_custkey) AS r FROM c GROUP BY 1) k)"
_IP = "regexp_extract(Notes, '10[.0-9]+')"


@query("inspect_table", " UNION ALL ".join(
    f"SELECT 'contacts' AS table_name, '{c}' AS header, {p} AS resolved_pattern, '{s}' AS source, arg_min({c}, c_custkey) AS sample_value, count({c}) AS row_count FROM ({_CONTACTS_SQL})"
    for c, p, s in (("Email", "'Email'", "heuristic"), ("Phone", "'Phone'", "heuristic"), ("Name", "'PersonName'", "heuristic"), ("Notes", "NULL", "unresolved"))))
def inspect_table(spark, sf_dir):
    return tables.inspect_table(contacts(spark, sf_dir), "contacts", "c_custkey")


@query("scrub_table", f"""WITH c AS ({_CONTACTS_SQL})
SELECT c_custkey, {_token('EMAIL', 'e.n')} AS Email, {_token('PHONE', 'p.n')} AS Phone, {_token('PERSON', 'm.n')} AS Name, replace(Notes, {_IP}, {_token('IP', 'i.n')}) AS Notes
FROM c JOIN {_number('Email')} e ON e.v = Email JOIN {_number('Phone')} p ON p.v = Phone JOIN {_number('Name')} m ON m.v = Name JOIN {_number(_IP)} i ON i.v = {_IP}""")
def scrub_table(spark, sf_dir):
    return tables.scrub_table(contacts(spark, sf_dir), "contacts", "c_custkey")[0]


_ITEM = {"l_id": "l_orderkey * 8 + l_linenumber", "Email": "concat('user', l_suppkey, '@mail.example.com')", "Phone": "concat('+1 555 ', lpad(concat(l_partkey % 1000, ''), 3, '0'), ' ', lpad(concat(l_suppkey % 10000, ''), 4, '0'))", "Host": "concat('db', l_partkey % 300, '.corp.example.org')", "Quantity": "l_quantity"}


@query("scrub_lineitem", f"""WITH c AS (SELECT {", ".join(f"{e} AS {c}" for c, e in _ITEM.items())} FROM lineitem),
e AS (SELECT v, row_number() OVER (ORDER BY r, v) - 1 AS n FROM (SELECT Email AS v, min(l_id) AS r FROM c GROUP BY 1)), p AS (SELECT v, row_number() OVER (ORDER BY r, v) - 1 AS n FROM (SELECT Phone AS v, min(l_id) AS r FROM c GROUP BY 1)),
h AS (SELECT v, row_number() OVER (ORDER BY r, v) - 1 AS n FROM (SELECT Host AS v, min(l_id) AS r FROM c GROUP BY 1))
SELECT l_id, {_token('EMAIL', 'e.n')} AS Email, {_token('PHONE', 'p.n')} AS Phone, {_token('HOST', 'h.n')} AS Host, Quantity FROM c JOIN e ON e.v = Email JOIN p ON p.v = Phone JOIN h ON h.v = Host""")
def scrub_lineitem(spark, sf_dir):
    """Many rows of few values: tokens are found on the columns' dictionaries."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in _ITEM.items()])
    return tables.scrub_table(rows, "items", "l_id")[0]


@query("scrub_tables_shared", f"""WITH c AS ({_CONTACTS_SQL}), x AS (SELECT s_suppkey, s_name, concat('user', s_suppkey, '@mail', s_nationkey, '.example.com') AS mail, c_email FROM supplier LEFT JOIN (SELECT c_custkey, Email AS c_email FROM c) ON c_custkey = s_suppkey)
SELECT s_suppkey, concat('{{VENDOR', CASE WHEN n > 0 THEN concat('_', n) ELSE '' END, '}}') AS Vendor, mail AS Kept, mail_token AS Mail
FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS n FROM x)
JOIN (SELECT v, concat('{{EMAIL', CASE WHEN row_number() OVER (ORDER BY r) > 1 THEN concat('_', row_number() OVER (ORDER BY r) - 1) ELSE '' END, '}}') AS mail_token
  FROM (SELECT v, min(r) AS r FROM (SELECT Email AS v, c_custkey AS r FROM c UNION ALL SELECT mail, 1000000000 + s_suppkey FROM x) GROUP BY 1)) m ON m.v = mail""")
def scrub_tables_shared(spark, sf_dir):
    """Two tables with one map: a custom column, a skipped one, and one that a rule finds."""
    mail = F.expr("concat('user', s_suppkey, '@mail', s_nationkey, '.example.com')")
    vendors = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("Vendor"), mail.alias("Kept"), mail.alias("Mail"))
    config = ScrubConfig(column_rules=(ColumnRule("^ma?il$", "Email", True),))
    both = {"contacts": (contacts(spark, sf_dir), "c_custkey"), "vendors": (vendors, "s_suppkey")}
    return tables.scrub_tables(both, config, {"vendors": {"Vendor": {"kind": "custom", "label": "vendor"}, "Kept": {"kind": "skip"}}})[0]["vendors"]


@query("scrub_summary", "SELECT 'contacts' AS table_name, count(*) AS rows, 4 * count(*) AS cells_scrubbed FROM customer")
def scrub_summary(spark, sf_dir):
    return tables.scrub_table(contacts(spark, sf_dir), "contacts", "c_custkey")[2].select("table_name", "rows", "cells_scrubbed")


# ---------------------------------------------------------------- induction
@query("induce_patterns", r"""SELECT 'customer' AS category, count(*) AS n_examples, '\bCustomer#\d{9}\b' AS regex_source FROM customer HAVING count(*) >= 3
UNION ALL SELECT 'supplier', count(*), '\bSupplier#\d{9}\b' FROM supplier HAVING count(*) >= 3""")
def induce_patterns(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.lit("customer").alias("category"), F.col("c_name").alias("real_value"))
    names = names.unionByName(table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("category"), F.col("s_name").alias("real_value")))
    return induce.suggest(names).select("category", "n_examples", "regex_source")


def _patterns(spark, sf_dir):
    """Patterns learned from the customers' and suppliers' names, as stored."""
    names = table(spark, sf_dir, "customer").select(F.lit("customer").alias("category"), F.col("c_name").alias("real_value"))
    names = names.unionByName(table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("category"), F.col("s_name").alias("real_value")))
    none = spark.createDataFrame([], SCHEMAS["induced_patterns"])
    return induce.persist(none, induce.suggest(names), F.lit(0).cast("long"), names.withColumnRenamed("real_value", "value"))


@query("pattern_store", r"""SELECT 1::BIGINT AS id, 'customer' AS category, '\bCustomer#\d{9}\b' AS regex_source, 'pending' AS status, c_name AS example FROM (SELECT DISTINCT c_name FROM customer)
UNION ALL SELECT 2, 'supplier', '\bSupplier#\d{9}\b', 'pending', s_name FROM (SELECT DISTINCT s_name FROM supplier)""")
def pattern_store(spark, sf_dir):
    """The stored patterns with all the values that they come from."""
    patterns, examples = _patterns(spark, sf_dir)
    return patterns.join(examples, "id").select("id", "category", "regex_source", "status", "example")


@query("pattern_decisions", r"""SELECT CASE WHEN n = 'customer' THEN 1 ELSE 2 END::BIGINT AS id, CASE WHEN hit = total THEN edit ELSE concat('\b', made, '\d{9}\b') END AS regex_source, 'pending' AS status
FROM (SELECT 'customer' AS n, 'Customer#' AS made, '\bCustomer#\d+\b' AS edit, count(*) AS total, count(*) FILTER (WHERE regexp_matches(c_name, '\bCustomer#\d+\b')) AS hit FROM customer
  UNION ALL SELECT 'supplier', 'Supplier#', '\bSupplier#0+[0-9]{1,2}\b', count(*), count(*) FILTER (WHERE regexp_matches(s_name, '\bSupplier#0+[0-9]{1,2}\b')) FROM supplier)""")
def pattern_decisions(spark, sf_dir):
    """An edit that matches all examples holds; one that misses any, the hundredth say, changes nothing."""
    p, examples = (saved(t, "patterns") for t in _patterns(spark, sf_dir))
    regex = F.when(F.col("category") == "customer", r"\bCustomer#\d+\b").otherwise(r"\bSupplier#0+[0-9]{1,2}\b")
    done = induce.decide(p, p.select("id", F.lit("edit").alias("action"), regex.alias("regex")), examples)
    return done.select("id", "regex_source", "status")


_SHAPES = ["(a|a)*b", "([a-z]|[a-y])*#", "a{1,50}a{1,50}a{1,50}b", "(a{2,5})+", "(?:a|ab)*c", "x*", "INC-[0-9]{4,}", "(?:[a-z]+[.])*com", "(", ".*a.*b"]
_REASONS = ["exponential backtracking", "exponential backtracking", "backtracking of degree 2", "nested quantifier", None, "pattern matches empty string", None, "nested quantifier", "invalid regex pattern", None]


@query("regex_admission", f"SELECT p_partkey, {_pick(_REASONS, 'p_partkey')} AS reason FROM part")
def regex_admission(spark, sf_dir):
    """Which regexes of users may run, by what their automata tell."""
    ends = F.when(F.col("p_partkey") % 10 == 5, "").otherwise(F.concat(F.lit("k"), "p_partkey"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.expr(_pick(_SHAPES, "p_partkey")), ends).alias("regex_source"))
    return induce.admitted(rows).select("p_partkey", "reason")


@query("pattern_hits", "SELECT 1::BIGINT AS id, count(*) FILTER (WHERE c_custkey % 3 > 0) AS hit_count FROM customer UNION ALL SELECT 2, 0")
def pattern_hits(spark, sf_dir):
    """A pattern's hits count once for each text."""
    text = F.when(F.col("c_custkey") % 3 > 0, F.concat("c_name", F.lit(" or "), "c_name")).otherwise("nobody")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), text.alias("text"))
    p = saved(_patterns(spark, sf_dir)[0], "patterns")
    hits = detect(rows, patterns=[(r["id"], r["category"], r["regex_source"], r["confidence"]) for r in p.collect()])  # two patterns
    return induce.bump_hits(p, hits).select("id", "hit_count")


_ALLOW = """CASE o_orderkey % 4 WHEN 0 THEN concat('^customer#', lpad(concat(o_custkey, ''), 9, '0'), CASE WHEN o_custkey % 3 = 0 THEN '$' ELSE 'z' END)
  WHEN 1 THEN concat('(?:clerk|customer)#0+', 100 + o_custkey % 900, '[0-4]$') WHEN 2 THEN concat('#[0-9]{6}', 900 + o_custkey * 7 % 100, '\\\\b') ELSE concat('^[x-z]', o_orderkey % 5, '$') END"""


@query("allowlist_regexes", """WITH a AS (SELECT DISTINCT o_orderkey % 4 AS k, o_custkey AS c FROM orders)
SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM a WHERE k = 0 AND c % 3 = 0 AND c = c_custkey)
  AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT 100 + c % 900 AS n FROM a WHERE k = 1) x WHERE x.n = c_custkey // 10 AND c_custkey % 10 < 5)
  AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT 900 + c * 7 % 100 AS n FROM a WHERE k = 2) y WHERE y.n = c_custkey % 1000)""")
def allowlist_regexes(spark, sf_dir):
    """A regex of one of four shapes from every order against every customer's name."""
    allow = table(spark, sf_dir, "orders").select(F.expr(_ALLOW).alias("pattern"), F.lit(True).alias("is_regex"))
    return drop_allowlisted(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), allow, "c_name")


@query("active_pattern_set", r"""SELECT c_custkey AS doc_id, c_name AS value, c_custkey AS source FROM customer
UNION ALL SELECT c_custkey, substr(c_name, 9), 0 FROM customer UNION ALL SELECT c_custkey, concat('ask ', c_name), -c_custkey FROM customer WHERE c_custkey % 2 = 0""")
def active_pattern_set(spark, sf_dir):
    """A learned regex for every customer, some with two mandatory strings, and one with none."""
    names = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    rows = names.select(F.col("c_custkey").alias("doc_id"), F.concat(F.when(F.col("c_custkey") % 2 == 0, "ask ").otherwise("tell "), "c_name", F.lit(" now")).alias("text"))
    one = F.concat(F.lit(r"\b"), "c_name", F.lit(r"\b"))
    other = F.concat(F.lit(r"ask\sCustomer#\d*"), F.substring("c_name", -4, 4), F.lit(r"\b"))
    number = names.limit(1).select(F.lit(0).alias("id"), F.lit("number").alias("category"), F.lit(r"#\d+").alias("regex"), F.lit(0.4).alias("confidence"))
    two = [names.select(id_.alias("id"), F.lit("customer").alias("category"), regex.alias("regex"), F.lit(0.5).alias("confidence")) for id_, regex in ((F.col("c_custkey"), one), (-F.col("c_custkey"), other))]
    found = detect(spread(rows), patterns=two[0].unionByName(two[1]).unionByName(number)).filter("rank = 20")
    own = (F.col("category") == "number") | (F.abs("source") == F.col("doc_id"))  # others end in the same digits
    return found.filter(own).select("doc_id", "value", "source")


@query("active_patterns", r"SELECT c_custkey AS doc_id, c_name AS value, 9::BIGINT AS source FROM customer")
def active_patterns(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("ask "), "c_name", F.lit(" now")).alias("text"))
    return detect(rows, patterns=[(9, "customer", r"\bCustomer#\d{9}\b", 0.5)]).filter("rank = 20").select("doc_id", "value", "source")


@query("literal_patterns", """SELECT l_orderkey * 8 + l_linenumber AS doc_id, CASE WHEN s_suppkey % 2 = 0 THEN 'EVEN_ONES' ELSE 'ODD' END AS type, concat('SUPPLIER#', lpad(concat(l_suppkey, ''), 9, '0')) AS value
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
UNION ALL SELECT l_orderkey * 8 + l_linenumber, 'WORD', 'er#' FROM lineitem UNION ALL SELECT l_orderkey * 8 + l_linenumber, 'WORD', 'ER#' FROM lineitem""")
def literal_patterns(spark, sf_dir):
    """Every supplier's name as a literal, and one that others hold."""
    names = [(r["s_name"], "even ones" if r["s_suppkey"] % 2 == 0 else "odd") for r in table(spark, sf_dir, "supplier").orderBy("s_suppkey").collect()]
    text = "concat('to SUPPLIER#', lpad(concat(l_suppkey, ''), 9, '0'), '; other#1')"
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 8 + l_linenumber AS doc_id", f"{text} AS text")
    hits = detect(rows, config=ScrubConfig(literals=(*names, ("eR#", "word"))))
    return hits.filter("rank = 3").select("doc_id", "type", "value")


# ---------------------------------------------------------------- second opinion
_ANSWER = """concat('{"suspicious_spans":[{"text":"Jane', event_id % 40, ' Doe","category":"', CASE WHEN event_id % 2 = 0 THEN 'person' ELSE 'org' END, '","confidence":0.', 5 + event_id % 5, ',"reason":"name"}]}')"""


@query("judge_mask", "SELECT doc_id, regexp_replace(concat('Contact {EMAIL_', doc_id % 5, '} or {PERSON} about ', text), '\\{[A-Z][A-Z0-9]*(?:_\\d+)?\\}', '[*]', 'g') AS masked FROM documents")
def judge_mask(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.expr("concat('Contact {EMAIL_', doc_id % 5, '} or {PERSON} about ', text)").alias("scrubbed"))
    return judge.masked(rows).select("doc_id", "masked")


_last = lambda mark: f"CASE WHEN instr(reverse(substr(t, start + 1, 1800 + {len(mark)})), '{mark}') > 0 THEN len(substr(t, start + 1, 1800 + {len(mark)})) - instr(reverse(substr(t, start + 1, 1800 + {len(mark)})), '{mark}') - {len(mark)} + 1 ELSE -1 END"
_length = f"CASE WHEN {_last(chr(10) * 2)} >= 720 THEN {_last(chr(10) * 2)} WHEN {_last(chr(10))} >= 720 THEN {_last(chr(10))} WHEN {_last(' ')} >= 151 THEN {_last(' ')} ELSE 1800 END"


@query("judge_chunks", f"""WITH RECURSIVE long AS (SELECT doc_id, regexp_replace(text, '\\s+$', '') AS t FROM documents WHERE len(text) > 1800),
walk AS (SELECT doc_id, t, 0 AS idx, 0::BIGINT AS start, NULL::BIGINT AS a, NULL::BIGINT AS n FROM long
  UNION ALL
  SELECT doc_id, t, idx + 1, start + n - 150 + len(regexp_extract(substr(t, start + n - 149), '^\\s*')), start, n
  FROM (SELECT doc_id, t, idx, start, {_length} AS n FROM walk WHERE len(t) - start > 1800)),
pieces AS (SELECT doc_id, 0 AS chunk_idx, text AS chunk FROM documents WHERE len(text) <= 1800
  UNION ALL SELECT doc_id, idx - 1, regexp_replace(substr(t, a + 1, n), '^\\s+|\\s+$', '', 'g') FROM walk WHERE n IS NOT NULL
  UNION ALL SELECT doc_id, idx, substr(t, start + 1) FROM walk WHERE len(t) - start <= 1800 AND len(t) - start >= 24)
SELECT doc_id, chunk_idx, chunk, concat({quoted(chr(10).join(judge.PROMPT_HEAD).format(most=16))}, chr(10), chunk, chr(10), {quoted(chr(10).join(judge.PROMPT_TAIL))}) AS prompt FROM pieces""")
def judge_chunks(spark, sf_dir):
    return judge.prompts(judge.chunks(docs(spark, sf_dir).select("doc_id", F.col("text").alias("masked"))))


@query("judge_spans", """WITH s AS (SELECT user_id AS doc_id, event_id AS chunk_idx, concat('Jane', event_id % 40, ' Doe') AS text, CASE WHEN event_id % 2 = 0 THEN 'person' ELSE 'customer' END AS category
  FROM events WHERE event_id % 5 >= 1), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY chunk_idx) AS k FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_idx) AS j FROM o WHERE k = 1)
SELECT doc_id, chunk_idx, text, category FROM p WHERE j <= 16""")
def judge_spans(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("user_id AS doc_id", "event_id AS chunk_idx", f"{_ANSWER} AS response", "CAST(NULL AS STRING) AS error")
    spans = judge.valid_spans(judge.parsed(rows), vocabulary(spark, sf_dir))
    return judge.capped(spans).select("doc_id", "chunk_idx", "text", "category")


@query("judge_review", """SELECT event_id AS doc_id, concat('Jane', event_id % 40, ' Doe') AS span, substr(t, greatest(1, pos - 40), pos + len(s) + 40 - greatest(1, pos - 40)) AS surrounding, 'judge:post' AS source_event
FROM (SELECT event_id, concat('Jane', event_id % 40, ' Doe') AS s, concat(repeat('x', (event_id % 60)::INT), ' so ', s, ' said ', repeat('y', 60)) AS t, (event_id % 60 + 5)::INT AS pos FROM events WHERE event_id % 5 >= 1)""")
def judge_review(spark, sf_dir):
    """Spans with their surroundings, as they are queued."""
    events = table(spark, sf_dir, "events")
    rows = events.selectExpr("event_id AS doc_id", "0 AS chunk_idx", f"{_ANSWER} AS response", "CAST(NULL AS STRING) AS error")
    texts = events.selectExpr("event_id AS doc_id", "concat(repeat('x', CAST(event_id % 60 AS INT)), ' so ', 'Jane', event_id % 40, ' Doe said ', repeat('y', 60)) AS scrubbed")
    spans = judge.capped(judge.valid_spans(judge.parsed(rows), vocabulary(spark, sf_dir)))
    return judge.review_rows(spans, texts, "post").select("doc_id", "span", "surrounding", "source_event")


@query("judge_verdicts", """SELECT user_id AS doc_id, CAST(count(*) FILTER (WHERE event_id % 11 > 1) AS BIGINT) AS suspicious_count, bool_or(event_id % 11 <= 1) AS failed,
  CASE max(event_id) FILTER (WHERE event_id % 11 <= 1) % 11 WHEN 0 THEN 'parse_failed: not JSON' WHEN 1 THEN 'llm_failed: timeout' END AS error_reason,
  count(*) FILTER (WHERE event_id % 11 <= 1) AS n_failed, count(*) AS n_chunks FROM events GROUP BY 1""")
def judge_verdicts(spark, sf_dir):
    answer = """CASE WHEN event_id % 11 = 0 THEN 'no json' ELSE '[{"text":"Jane Doe","category":"person","confidence":0.9,"reason":"name"}]' END AS response"""
    error = "CASE WHEN event_id % 11 = 1 THEN 'timeout' END AS error"
    rows = judge.parsed(table(spark, sf_dir, "events").selectExpr("user_id AS doc_id", "event_id AS chunk_idx", answer, error))
    found = judge.valid_spans(rows, vocabulary(spark, sf_dir))
    return judge.verdicts(rows, found).select("doc_id", "suspicious_count", "failed", "error_reason", "n_failed", "n_chunks")
