"""A second opinion by a model that the caller runs: chunks out, answers in, spans reviewed."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anonspark.functions.patterns import looks_like_code_identifier
from anonspark.operators.mint import key_of
from anonspark.plans.storage import spread

LEAST, CHUNK, OVERLAP, SPAN_TEXT, SPAN_REASON = 24, 1800, 150, 200, 280
#: The model's categories and the review queue's.
CATEGORIES = {"person": "person", "org": "customer", "address": "address", "credential": "credential", "hostname": "fqdn", "url": "url", "other": "unsure"}
# The lines around a chunk, as the model was tuned to read them.
PROMPT_HEAD = ("Return AT MOST {most} suspicious spans. If you find none, return an empty array.", "", "--- BEGIN SCRUBBED TEXT ---")
PROMPT_TAIL = ("--- END SCRUBBED TEXT ---",)
_TOKEN = r"\{[A-Z][A-Z0-9]*(?:_\d+)?\}"


def masked(docs: DataFrame, text: str = "scrubbed", out: str = "masked") -> DataFrame:
    """docs with the tokens of a text as [*]; texts under 24 characters go."""
    return docs.filter(F.length(text) >= LEAST).withColumn(out, F.regexp_replace(text, _TOKEN, "[*]"))


#: Where a chunk may end: the last break of the first kind that comes late enough, a share of
#: the chunk; of the last kind any that leaves something after the overlap.
_BREAKS = (("\n\n", 0.4), ("\n", 0.4), (" ", 0.0))
_SPACE = re.compile(r"\s*")


def chunk_ends(text: str, size: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the chunks of a text without space at its end."""
    start = 0
    while len(text) - start > size:
        breaks = ((text.rfind(mark, start, start + size + len(mark)) - start, share) for mark, share in _BREAKS)
        length = next((n for n, share in breaks if n >= max(share * size, OVERLAP + 1)), size)
        yield start, start + length
        start = _SPACE.match(text, start + length - OVERLAP).end()
    yield start, len(text)


def chunk_text(text: str, size: int = CHUNK) -> list[str]:
    """Chunks of at most `size` characters that break at a blank line, a line or a space, with
    an overlap; a last one of under 24 characters goes. A text that fits is one chunk as it is."""
    if len(text) <= size:
        return [text]
    *chunks, last = [text[a:b].strip() for a, b in chunk_ends(text.rstrip(), size)]
    return chunks + [last] * (len(last) >= LEAST)


def chunks(docs: DataFrame, doc: str = "doc_id", text: str = "masked") -> DataFrame:
    """(doc, chunk_idx, chunk)."""
    @F.pandas_udf("array<string>")
    def cut(part: pd.Series) -> pd.Series:
        return part.map(lambda t: chunk_text(t or ""))

    return docs.select(doc, F.posexplode(cut(F.col(text))).alias("chunk_idx", "chunk"))


def prompts(rows: DataFrame, most: int = 16) -> DataFrame:
    """rows with prompt, what the model is asked about a chunk."""
    head, tail = ("\n".join(lines).format(most=most) for lines in (PROMPT_HEAD, PROMPT_TAIL))
    return rows.withColumn("prompt", F.concat_ws("\n", F.lit(head), F.col("chunk"), F.lit(tail)))


def parsed(responses: DataFrame) -> DataFrame:
    """responses (…, response, error) with spans and error_reason: llm_failed where the call
    failed, parse_failed where the answer is no JSON. Fences are taken off; the spans are a
    bare list or in suspicious_spans. Answers of a small scan are dealt out over all cores."""
    fenced = F.regexp_replace(F.regexp_replace("response", r"(?i)^```(?:json)?\s*", ""), r"\s*```\s*$", "")
    clean = F.trim(F.when(F.contains("response", F.lit("```")), fenced).otherwise(F.col("response")))
    kind = "array<struct<text:string,category:string,confidence:double,reason:string>>"
    rows = spread(responses).withColumn("_c", clean).withColumn("_v", F.try_parse_json("_c"))
    spans = F.when(F.col("_c").startswith("["), F.from_json("_c", kind)).otherwise(F.from_json("_c", f"suspicious_spans {kind}")["suspicious_spans"])
    reason = F.when(F.col("error").isNotNull(), F.concat(F.lit("llm_failed: "), "error")).when(F.col("_v").isNull(), F.lit("parse_failed: not JSON"))
    none = F.array().cast(kind)
    return rows.withColumns({"error_reason": reason, "spans": F.when(reason.isNull(), F.coalesce(spans, none)).otherwise(none)}).drop("_c", "_v")


def normalize_category(category: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])[category], F.lit("unsure"))


def valid_spans(rows: DataFrame, vocab: DataFrame, least: float = 0.6) -> DataFrame:
    """One row per valid span: known values, tokens, placeholders, code identifiers, and
    spans whose confidence is out of bounds go."""
    keys = [c for c in rows.columns if c not in ("spans", "response", "error", "error_reason")]
    # the outer form, as Spark infers a filter from the other one, for which all answers are parsed once more
    each = rows.select(*keys, F.posexplode_outer("spans").alias("span_idx", "s")).select(*keys, "span_idx", "s.*")
    c, t = F.col("confidence"), F.col("text")
    fine = t.isNotNull() & F.col("category").isNotNull() & F.col("reason").isNotNull() & ~F.isnan(c) & (c >= least) & (c <= 1) & (F.length(t) >= 2)
    fine = fine & ~t.rlike(_TOKEN) & ~F.trim(t).isin("[*]", "*") & ~looks_like_code_identifier(t)
    known = vocab.select(key_of("real_value").alias("_k")).distinct()
    left = each.filter(F.coalesce(fine, F.lit(False))).join(known, key_of("text") == F.col("_k"), "left_anti")
    return left.withColumns({"text": F.substring("text", 1, SPAN_TEXT), "category": normalize_category(F.col("category")), "reason": F.substring("reason", 1, SPAN_REASON)})


def capped(spans: DataFrame, doc: str = "doc_id", most: int = 16) -> DataFrame:
    """The first `most` distinct spans of a document in the order of its chunks."""
    order = ["chunk_idx", "span_idx"]
    first = F.row_number().over(Window.partitionBy(doc, "text").orderBy(*order))
    once = spans.withColumn("_n", first).filter("_n = 1")
    place = F.row_number().over(Window.partitionBy(doc).orderBy(*order))
    return once.withColumn("_n", place).filter(F.col("_n") <= most).drop("_n")


def review_rows(spans: DataFrame, docs: DataFrame, source: str, doc: str = "doc_id", text: str = "scrubbed") -> DataFrame:
    """The spans as rows for the review queue, with 40 characters to either side."""
    rows = spans.withColumnRenamed("text", "span").join(docs.select(doc, F.col(text).alias("_t")), doc)
    at = F.instr("_t", F.col("span"))
    start = F.greatest(F.lit(1), at - 40)
    around = F.when(at > 0, F.substring("_t", start, at + F.length("span") + 40 - start)).otherwise("")
    return rows.select(doc, "span", around.alias("surrounding"), F.col("category").alias("suggested_cat"), "confidence", F.lit(f"judge:{source}").alias("source_event"))


def verdicts(answers: DataFrame, spans: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, failed, error_reason, n_failed, n_chunks, suspicious_count): a failed chunk fails
    its document, and the last one that failed says why."""
    reason = F.col("error_reason")
    errors = answers.groupBy(doc).agg(
        F.bool_or(reason.isNotNull()).alias("failed"), F.max_by(reason, F.when(reason.isNotNull(), F.col("chunk_idx"))).alias("error_reason"),
        F.count(reason).alias("n_failed"), F.count("*").alias("n_chunks"))
    n = spans.groupBy(doc).agg(F.count("*").alias("suspicious_count"))
    return errors.join(n, doc, "left").withColumn("suspicious_count", F.coalesce("suspicious_count", F.lit(0).cast("long")))
