"""Substituting values by tokens, restoring them, and redacting credentials."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anonspark.functions.automaton import Beginnings, beginnings
from anonspark.functions.automaton import low as _low
from anonspark.functions.bloom import BITS, Bloom, hash_of, made
from anonspark.functions.patterns import CREDENTIAL, SENSITIVE_KV, TOKEN_ANYWHERE, java, may_have_credential, may_have_pair
from anonspark.plans.storage import fresh, saved, small, spread

CREDENTIAL_MARK = "[CREDENTIAL-REDACTED]"
#: A map of at most so many values, and bytes of them and their tokens, travels to the workers;
#: beyond, texts meet only the values they may hold.
MAP_KEYS, MAP_BYTES = 200_000, 16 << 20
#: Largest filter of values that travels to the workers.
FILTER_BYTES = 64 << 20
#: Characters of a value's beginning that the automaton knows.
HEAD = 6
_PIECE = re.compile(r"\w+|\W")


def _wordy(c: str) -> bool:
    return c.isalnum() or c == "_"


class Substitution:
    """Leftmost, longest, without case, and never next to a letter, digit or underscore.

    An automaton finds the beginnings of values, of up to HEAD characters, in one pass over the
    text; where one stands, values are looked up whole by the lengths that values of this
    beginning have. So a text costs the same for any number of values.
    """

    def __init__(self, pairs):
        self.tokens: dict[str, str] = {}
        sizes: dict[str, set[int]] = {}
        for value, token in pairs:
            low = _low(value)
            if low:
                self.tokens.setdefault(low, token)
                sizes.setdefault(low[:HEAD], set()).add(len(low))
        self.heads = ahocorasick.Automaton()
        for head, n in sizes.items():
            self.heads.add_word(head, (len(head), sorted(n, reverse=True)))
        if sizes:
            self.heads.make_automaton()

    def whole(self, cell: str | None) -> str | None:
        """The token of a cell that is a value, else the cell."""
        return None if cell is None else self.tokens.get(_low(cell), cell)

    def __call__(self, text: str | None) -> str | None:
        if not text or not self.tokens:
            return text
        low = _low(text)
        found = []
        for last, (size, lengths) in self.heads.iter(low):
            at = last + 1 - size
            if not at or not _wordy(low[at - 1]):
                found.append((at, -size, lengths))
        found.sort()  # at one place the longer beginning has the longer values
        out, done = [], 0
        for at, _, lengths in found:
            if at < done:
                continue
            for size in lengths:
                end = at + size
                token = self.tokens.get(low[at:end]) if end <= len(low) else None
                if token is not None and (end == len(low) or not _wordy(low[end])):
                    out += [text[done:at], token]
                    done = end
                    break
        return "".join([*out, text[done:]]) if done else text


def worker_map(tokens: DataFrame, most_keys: int = MAP_KEYS, most_bytes: int = MAP_BYTES) -> list[tuple[str, str]] | None:
    """The pairs of tokens (real_value, token), if they are few enough to travel; else None."""
    size = F.coalesce(F.sum(F.octet_length("real_value") + F.octet_length("token")), F.lit(0))
    row = tokens.agg(F.count("*").alias("n"), size.alias("b")).first()
    if row["n"] > most_keys or row["b"] > most_bytes:
        return None
    pairs = tokens.select("real_value", "token").toPandas()
    return list(zip(pairs["real_value"], pairs["token"]))


def apply_map(docs: DataFrame, tokens: DataFrame, text: str = "text", out: str = "scrubbed", most_keys: int = MAP_KEYS) -> DataFrame:
    """docs with `out`, the text with the real_values of tokens (real_value, token) replaced.
    Few values travel to the workers as one map; see apply_by_candidates for more."""
    pairs = worker_map(tokens, most_keys)
    if pairs is None:
        return apply_by_candidates(docs, tokens, text, out)
    return _apply_pairs(spread(docs), pairs, [(text, out, False)])


def _apply_pairs(docs: DataFrame, pairs: list[tuple[str, str]], columns: list[tuple[str, str, bool]]) -> DataFrame:
    """docs with new columns from one map in one pass. columns: (from, to, whether a cell is a
    value as a whole)."""
    shared = docs.sparkSession.sparkContext.broadcast(pairs)
    made: list[Substitution] = []
    use = [whole for _, _, whole in columns]
    kind = "struct<" + ", ".join(f"c{i}: string" for i in range(len(columns))) + ">"

    @F.pandas_udf(kind)
    def of(cells: pd.DataFrame) -> pd.DataFrame:
        if not made:
            made.append(Substitution(shared.value))
        one = made[0]
        return pd.DataFrame({f"c{i}": cells.iloc[:, i].map(one.whole if whole else one, na_action="ignore").astype(object) for i, whole in enumerate(use)})

    (cells_,) = fresh([*docs.columns, *(to for _, to, _ in columns)], "_cells")
    done = docs.withColumn(cells_, of(F.struct(*[F.col(c).cast("string").alias(f"c{i}") for i, (c, _, _) in enumerate(columns)])))
    return done.withColumns({to: F.col(f"{cells_}.c{i}") for i, (_, to, _) in enumerate(columns)}).drop(cells_)


def apply_cells(cells: DataFrame, tokens: DataFrame, whole: list[int]) -> DataFrame:
    """(col, cell, new) of the distinct cells (col, cell) that a map changes. A cell that is a value
    takes its token: it begins first and is the longest, so no other value counts. Only the rest
    is searched, each cell once for all columns, but for those that are read whole."""
    keys = tokens.select(_lowered("real_value").alias("_key"), "real_value", "token").filter("_key <> ''")
    keys = keys.groupBy("_key").agg(F.min_by("token", F.struct("real_value", "token")).alias("_token"))
    named = saved(cells.select("col", "cell", _lowered("cell").alias("_key")).join(keys, "_key", "left").select("col", "cell", "_token"), "cells_named")
    rest = saved(named.filter(F.col("_token").isNull() & ~F.col("col").isin(whole)).select("col", "cell"), "cells_open")
    found = saved(apply_map(rest.select("cell").distinct(), tokens, "cell", "new").filter("new <> cell"), "cells_found")
    exact = named.filter("_token IS NOT NULL").select("col", "cell", F.col("_token").alias("new"))
    return saved(exact.unionByName(rest.join(small(found), "cell").select("col", "cell", "new")), "cells_changed")


def apply_columns(df: DataFrame, cells: DataFrame, tokens: DataFrame, columns: list[tuple[str, str, bool]]) -> DataFrame:
    """df with new columns, all from one map. columns: (from, to, whether a cell is a value as a
    whole); cells: their distinct cells (col, the place in columns; cell). The map meets each distinct cell
    once, and a column is joined with those that change."""
    if not columns:
        return df
    changed = apply_cells(cells, tokens, [i for i, (_, _, whole) in enumerate(columns) if whole])
    names = fresh([*df.columns, *(to for _, to, _ in columns)], "_cell", "_changed")
    for i, (c, to, _) in enumerate(columns):
        cell = F.col(f"`{c}`").cast("string")
        own = changed.filter(F.col("col") == i).select(F.col("cell").alias(names[0]), F.col("new").alias(names[1]))
        df = df.join(small(own), cell == F.col(names[0]), "left").withColumn(to, F.coalesce(names[1], cell)).drop(*names)
    return df


def _cuts(low: str) -> list[tuple[int, int]]:
    return [(m.start(), m.end()) for m in _PIECE.finditer(low)]


def candidate_keys(text: str | None, most: int) -> set[str]:
    """The stretches of a text that a value of up to `most` pieces could cover."""
    if not text:
        return set()
    low = _low(text)
    pieces = _cuts(low)
    out = set()
    for i, (a, _) in enumerate(pieces):
        if not (a and _wordy(low[a - 1])):
            out |= {low[a:b] for _, b in pieces[i : i + most] if b == len(low) or not _wordy(low[b])}
    return out


def begun_keys(text: str | None, begun: Beginnings) -> set[str]:
    """The stretches of a text that begin as values do and are as long."""
    low = _low(text or "")
    free = lambda a, b: not (a and _wordy(low[a - 1])) and (b == len(low) or not _wordy(low[b]))
    return {low[a:b] for a, b in begun.places(low) if free(a, b)}


@F.pandas_udf(T.StringType())
def _lowered(part: pd.Series) -> pd.Series:
    """As the stretches are: one character for each."""
    return part.map(_low, na_action="ignore")


def stretches(docs: DataFrame, tokens: DataFrame, text: str = "text", most_bytes: int = FILTER_BYTES) -> DataFrame:
    """(_h, _key): the stretches of the texts, known by a hash, that the values (_key) of tokens may
    cover. An automaton of the values' beginnings finds where one may stand, and a filter of the values
    leaves out what none is; they travel to the workers if the filter's bytes, by count, allow that.
    Without them all stretches of up to the longest value's pieces go on."""
    size = F.size(F.regexp_extract_all("_key", F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]"), F.lit(0)))
    row = tokens.agg(F.coalesce(F.max(size), F.lit(0)).alias("most"), F.count("*").alias("n")).first()
    most, shared = row["most"], None
    if row["n"] * BITS // 8 <= most_bytes:
        words = made(tokens.select("_key"), lambda key: [hash_of(key, 1)], row["n"]).words
        shared = docs.sparkSession.sparkContext.broadcast((words, beginnings(tokens, "_key")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, begun = (Bloom(shared.value[0]), Beginnings(shared.value[1])) if shared is not None else (None, None)

        def put(hashes: list, keys: list) -> Iterator[pd.DataFrame]:
            kept = held.has(hash_of(k, 1) for k in keys).tolist() if held is not None else [True] * len(keys)
            if any(kept):
                yield pd.DataFrame({"_h": list(compress(hashes, kept)), "_key": list(compress(keys, kept))})

        for pdf in batches:
            hashes, keys = [], []
            for h, t in zip(pdf["_h"], pdf["_text"]):
                own = begun_keys(t, begun) if begun is not None else candidate_keys(t, most)
                keys += own
                hashes += [h] * len(own)
                if len(keys) > 100_000:
                    yield from put(hashes, keys)
                    hashes, keys = [], []
            yield from put(hashes, keys)

    return docs.select(F.xxhash64(text).alias("_h"), F.col(text).alias("_text")).mapInPandas(run, "_h long, _key string")


def apply_by_candidates(docs: DataFrame, tokens: DataFrame, text: str = "text", out: str = "scrubbed") -> DataFrame:
    """As apply_map for vocabularies of any size: a text's stretches are joined with the
    values, and each text is rewritten with its own few pairs. Texts are known by a hash: two
    of one hash would share their pairs, which are right for both."""
    named = saved(tokens.select(_lowered("real_value").alias("_key"), "real_value", "token"), "named")
    docs = spread(docs)
    held = stretches(docs, named, text).join(named, "_key")
    pairs = saved(held.groupBy("_h").agg(F.collect_set(F.struct("real_value", "token")).alias("_pairs")), "pairs")

    @F.pandas_udf("string")
    def of(part: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([t if p is None else Substitution(sorted((x["real_value"], x["token"]) for x in p))(t) for t, p in zip(part, own)], dtype=object)

    h, p = fresh([*docs.columns, out], "_h", "_pairs")
    rows = docs.withColumn(h, F.xxhash64(text)).join(small(pairs.withColumnsRenamed({"_h": h, "_pairs": p})), h, "left")
    return rows.withColumn(out, of(F.col(text), F.col(p))).drop(h, p)


def restore(docs: DataFrame, vocab: DataFrame, text: str = "text", out: str = "restored") -> DataFrame:
    """docs with `out`, the text with the tokens of vocab (token, real_value) replaced in one
    pass. The tokens of each text are looked up, not the vocabulary's in each text. Texts are
    known by a hash: two of one hash would share their tokens, which are right for both."""
    found = F.regexp_extract_all(text, F.lit(TOKEN_ANYWHERE), F.lit(0))
    wanted = docs.select(F.xxhash64(text).alias("_h"), F.explode(F.array_distinct(found)).alias("token")).distinct()
    one = vocab.groupBy("token").agg(F.min("real_value").alias("real_value"))
    maps = wanted.join(one, "token").groupBy("_h").agg(F.map_from_entries(F.collect_list(F.struct("token", "real_value"))).alias("_map"))
    h, m = fresh([*docs.columns, out], "_h", "_map")
    maps = saved(maps, "maps").withColumnsRenamed({"_h": h, "_map": m})
    rows = spread(docs).withColumn(h, F.xxhash64(text)).join(small(maps), h, "left")
    tokens = F.transform(found, lambda t: F.coalesce(F.col(m)[t], t))
    gaps = F.split(text, TOKEN_ANYWHERE, -1)
    spliced = F.array_join(F.flatten(F.zip_with(gaps, F.concat(tokens, F.array(F.lit(""))), lambda g, t: F.array(g, t))), "")
    return rows.withColumn(out, F.when(F.col(m).isNull(), F.col(text)).otherwise(spliced)).drop(h, m)


def redact_credentials(text: Column) -> Column:
    return F.when(may_have_credential(text), F.regexp_replace(text, java(CREDENTIAL), CREDENTIAL_MARK)).otherwise(text)


def redact_kv(text: Column) -> Column:
    return F.when(may_have_pair(text), F.regexp_replace(text, java(SENSITIVE_KV), "$1=[REDACTED]")).otherwise(text)


def credential_snippets(text: Column) -> Column:
    """The beginnings of credentials, and the keys of sensitive pairs, never the secrets."""
    none = F.array().cast("array<string>")
    found = F.coalesce(F.when(may_have_credential(text), F.regexp_extract_all(text, F.lit(java(CREDENTIAL)), F.lit(0))), none)
    keys = F.coalesce(F.when(may_have_pair(text), F.regexp_extract_all(text, F.lit(java(SENSITIVE_KV)), F.lit(1))), none)
    short = F.transform(found, lambda c: F.when(F.length(c) <= 6, "***").otherwise(F.concat(F.substring(c, 1, 6), F.lit("…"))))
    return F.concat(short, F.transform(keys, lambda k: F.concat(k, F.lit("=…"))))


def has_credentials(text: Column) -> Column:
    return (may_have_credential(text) & text.rlike(java(CREDENTIAL))) | (may_have_pair(text) & text.rlike(java(SENSITIVE_KV)))


def context(text: Column, position: Column, length: Column, reach: int = 32, ellipsis: bool = True) -> Column:
    """The text around a span (position from 1), `reach` characters to either side."""
    start = F.greatest(F.lit(1), position - reach)
    end = F.least(F.length(text), position + length - 1 + reach)
    part = F.substring(text, start, end - start + 1)
    if not ellipsis:
        return part
    return F.concat(F.when(start > 1, "…").otherwise(""), part, F.when(end < F.length(text), "…").otherwise(""))
