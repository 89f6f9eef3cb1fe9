"""Detection: every hit of every detector as a row, from one pass over the texts."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from itertools import compress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anonspark.config import ScrubConfig
from anonspark.functions.automaton import Beginnings, Strings, beginnings, low
from anonspark.functions.bloom import BITS, Bloom, hash_of, made
from anonspark.functions.patterns import (
    BY_RANK, DETECTORS, NUMBERED, Detector, anchored, fqdn_allowed, java, java_column, looks_like_date, looks_like_identifier, may_have_number, url_host, valid_person,
)
from anonspark.functions.regexes import mandatory
from anonspark.plans.storage import fresh, saved, small, spread

HIT = "struct<rank:int,match_idx:int,value:string,type:string,category:string,confidence:double,source:bigint>"
_PERSON = (7, 8, 9)
#: Distinct values that one task holds against the regexes that have no mandatory string.
GROUP = 20_000
#: Largest filter of mandatory strings that travels to the workers.
FILTER_BYTES = 64 << 20


def label(category: Column | str) -> Column:
    """A category as a token type: upper case, other characters as underscores."""
    text = F.lit(category) if isinstance(category, str) else category
    return F.regexp_replace(F.upper(text), "[^A-Z0-9_]", "_")


def _as_hits(values: Column, rank: int, type_: Column, category: Column, confidence: float, source: Column) -> Column:
    return F.transform(values, lambda v, i: F.struct(
        F.lit(rank).alias("rank"), i.cast("int").alias("match_idx"), v.alias("value"), type_.alias("type"), category.alias("category"),
        F.lit(confidence).cast("double").alias("confidence"), source.alias("source")))


def hits_of(text: Column, d: Detector) -> Column:
    """Array of a detector's values in a text, empty where the cheap gate fails."""
    none = F.array().cast("array<string>")
    return F.coalesce(F.when(d.gate(text), F.regexp_extract_all(text, F.lit(d.regex), F.lit(d.group))), none)


def all_hits(text: Column, anchors: Column, numbers: Column, chosen: Sequence[Detector]) -> list[Column]:
    """Arrays of HIT, one for each detector. anchors: the text's tokens with an anchor; numbers:
    whether a number in groups can be in it."""
    none, null = F.array().cast("array<string>"), F.lit(None).cast("long")
    out = []
    for d in chosen:
        values = hits_of(anchors if d.within_token else text, d)
        if d.name in NUMBERED:
            values = F.when(numbers, values).otherwise(none)
        out.append(_as_hits(values, d.rank, F.lit(d.type), F.lit(d.category), d.confidence, null))
    return out


def accepted(config: ScrubConfig) -> Column:
    """Whether a hit (columns rank, value) passes the filters of its kind."""
    person = valid_person(F.col("value"), config.name_allowlist)
    host = ~fqdn_allowed(F.col("value"), config.fqdn_allowlist_extra) & ~looks_like_identifier(F.col("value")) & ~looks_like_date(F.col("value"))
    url = ~fqdn_allowed(url_host(F.col("value")), config.fqdn_allowlist_extra)
    return F.when(F.col("rank").isin(*_PERSON), person).when(F.col("rank") == 18, host).when(F.col("rank") == 17, url).otherwise(True)


def detect(docs: DataFrame, text: str = "text", config: ScrubConfig | None = None, names: Sequence[str] | None = None, patterns: Sequence[tuple[int, str, str, float]] | DataFrame = ()) -> DataFrame:
    """docs without the text, one row per hit: rank, match_idx, value, type, category,
    confidence, source. names: only these detectors; patterns: active learned patterns
    (id, category, regex, confidence), whose id is the source of their hits; they must have passed admission.
    A few are a list, any number of them a table.
    """
    config = config or ScrubConfig()
    chosen = [d for d in DETECTORS if names is None or d.name in names]
    kept = [c for c in docs.columns if c != text]
    t_, a_, n_, h_ = fresh(kept, "_text", "_anchored", "_numbers", "_hits")
    t = F.col(t_)
    rows = docs.select(*kept, F.col(text).alias(t_)).withColumns({  # a null has no hits; a filter would make a derived text once more, below all joins
        a_: anchored(t) if any(d.within_token for d in chosen) else F.lit(""), n_: may_have_number(t) if any(d.name in NUMBERED for d in chosen) else F.lit(False)})
    found = all_hits(t, F.col(a_), F.col(n_), chosen)
    if names is None and config.literals:
        found.append(literal_hits(docs, config.literals)(t))
    tabled = isinstance(patterns, DataFrame)
    if names is None and not tabled and patterns:
        found.append(_as_pattern_hits(t, candidate_patterns(docs, patterns)(t)))
    hits = F.concat(*found) if len(found) > 1 else found[0]
    rows = rows.select(*kept, F.explode(hits).alias(h_)).select(*kept, f"{h_}.*")
    rows = rows.filter(accepted(config))
    return rows.unionByName(tabled_hits(docs, text, patterns)) if names is None and tabled else rows


def _once(docs: DataFrame, make: Callable[[], Strings], use: Callable[[Strings, str | None], list], kind: str) -> Callable[[Column], Column]:
    """A function of texts that asks an automaton, which each worker makes once."""
    made: list[Strings] = []

    @F.pandas_udf(kind)
    def of(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(make())
        return pd.Series([use(made[0], t) for t in texts], dtype=object)

    return of


def literal_hits(docs: DataFrame, literals: Sequence[tuple[str, str]]) -> Callable[[Column], Column]:
    """Hits (an array of HIT) of literals (text, category), letters in either case and without
    boundaries: all literals by one pass over a text, in the order of the literals, then of places."""
    kinds = sorted({category for _, category in literals})
    place = {category: k for k, category in enumerate(kinds)}
    shared = docs.sparkSession.sparkContext.broadcast([(value, place[category]) for value, category in literals])

    def use(automaton: Strings, text: str | None) -> list[int]:
        return [x for i, (n, a, b) in enumerate(automaton.places(text)) for x in (i, a, b, shared.value[n][1])]

    found = _once(docs, lambda: Strings((v, i) for i, (v, _) in enumerate(shared.value)), use, "array<int>")  # whole numbers travel cheaply
    types = F.array(*[F.lit(re.sub("[^A-Z0-9_]", "_", c.upper())) for c in kinds])
    lower = F.array(*[F.lit(c.lower()) for c in kinds])

    def of(text: Column) -> Column:
        def hit(at: Column, flat: Column) -> Column:
            i, start, end, kind = (F.get(flat, at + k) for k in range(4))
            return F.struct(
                F.lit(3).alias("rank"), i.alias("match_idx"), F.substring(text, start + 1, end - start).alias("value"), F.get(types, kind).alias("type"),
                F.get(lower, kind).alias("category"), F.lit(1.2).cast("double").alias("confidence"), F.lit(None).cast("long").alias("source"))

        def hits(flat: Column) -> Column:
            ats = F.when(F.size(flat) > 0, F.sequence(F.lit(0), F.size(flat) - 4, F.lit(4))).otherwise(F.array().cast("array<int>"))
            return F.transform(ats, lambda at: hit(at, flat))

        return F.flatten(F.transform(F.array(found(text)), hits))  # so that the text is searched once

    return of


def candidate_patterns(docs: DataFrame, patterns: Sequence[tuple[int, str, str, float]]) -> Callable[[Column], Column]:
    """The patterns (id, category, regex, confidence) that can match in a text, in order of
    ids: those of whose mandatory strings it holds one of each clause. The automaton looks for the
    clause whose strings the fewest patterns have, so a string that all patterns share leads to
    none of them; the other clauses are looked up in the text. A pattern without any can match
    everywhere."""
    ordered = sorted(patterns, key=lambda p: p[0])
    clauses = [[tuple(map(low, c)) for c in mandatory(regex)] for _, _, regex, _ in ordered]
    often = Counter(s for own in clauses for c in own for s in c)
    for own in clauses:  # the rarest clause first
        own.sort(key=lambda c: sum(often[s] for s in c))
    shared = docs.sparkSession.sparkContext.broadcast(([(i, c, java(r), float(w)) for i, c, r, w in ordered], clauses))

    def use(automaton: Strings, text: str | None) -> list:
        if not text:
            return []
        held, (rows, own) = low(text), shared.value
        met = (n for n in automaton.numbers(text) if all(any(s in held for s in c) for c in own[n][1:]))
        return [rows[n] for n in sorted({*always, *met})]

    always = [n for n, c in enumerate(clauses) if not c]
    kind = "array<struct<id:bigint,category:string,regex:string,confidence:double>>"
    return _once(docs, lambda: Strings((s, n) for n, c in enumerate(shared.value[1]) for s in (c[0] if c else ())), use, kind)


def _as_pattern_hits(text: Column, patterns: Column) -> Column:
    """Hits of each text's own candidate patterns."""
    def of(p: Column) -> Column:
        values = F.filter(F.regexp_extract_all(text, p["regex"], F.lit(0)), lambda v: v != "")
        return F.transform(values, lambda v, i: F.struct(
            F.lit(20).alias("rank"), i.cast("int").alias("match_idx"), v.alias("value"), F.upper(p["category"]).alias("type"), p["category"].alias("category"),
            p["confidence"].alias("confidence"), p["id"].alias("source")))

    return F.coalesce(F.flatten(F.transform(patterns, of)), F.array().cast(f"array<{HIT}>"))


def tabled_hits(docs: DataFrame, text: str, patterns: DataFrame) -> DataFrame:
    """The hits of a table of patterns (id, category, regex, confidence), as of detect. Patterns of
    one regex are searched for once and take its hits by a join. A regex is told by the clause whose
    strings the fewest regexes have: texts that hold one of them, and one of each other clause, are
    searched. A regex without any is searched for in all texts."""
    kept = [c for c in docs.columns if c != text]
    t_, h_, own_, hit_, i_, c_, r_, w_ = fresh([*kept, "rank", "match_idx", "value", "type", "category", "confidence", "source"], "_text", "_hash", "_own", "_hit", "_id", "_category", "_regex", "_confidence")
    patterns = saved(patterns.filter("regex IS NOT NULL").select(F.col("id").cast("long").alias(i_), F.col("category").alias(c_), F.col("regex").alias(r_), F.col("confidence").cast("double").alias(w_)), "patterns")
    regexes = spread(patterns.select(F.col(r_).alias("_p")).distinct())
    regexes = saved(regexes.select("_p", java_column(F.col("_p")).alias("_j"), _clauses("_p").alias("_f")), "regexes")
    rows = spread(docs.filter(F.col(text).isNotNull()).select(*kept, F.col(text).alias(t_)))

    strings = saved(regexes.select("_p", F.posexplode("_f").alias("_c", "_s")).select("_p", "_c", F.explode("_s").alias("_s")), "strings")
    often = strings.groupBy("_s").agg(F.count("*").alias("_n"))
    cost = strings.join(often, "_s").groupBy("_p", "_c").agg(F.sum("_n").alias("_n"))
    best = cost.groupBy("_p").agg(F.min_by("_c", F.struct("_n", "_c")).alias("_best"))
    others = F.filter("_f", lambda _, i: i != F.col("_best"))
    asked = regexes.join(best, "_p").withColumns({"_rest": others, "_one": F.get("_f", F.col("_best"))})
    asked = saved(asked.select(F.struct("_p", "_j", "_rest").alias("_r"), F.explode("_one").alias("_s")), "asked")
    held = held_strings(rows.select(F.xxhash64(t_).alias("_h"), F.col(t_).alias("_t")), asked.select("_s").distinct())
    own = saved(held.join(small(asked), "_s").groupBy("_h").agg(F.collect_set("_r").alias("_own")).withColumnsRenamed({"_h": h_, "_own": own_}), "candidates")

    def hits(r: Column) -> Column:
        values = F.filter(F.regexp_extract_all(F.col(t_), r["_j"], F.lit(0)), lambda v: v != "")
        return F.transform(values, lambda v, i: F.struct(r["_p"].alias("p"), i.cast("int").alias("i"), v.alias("v")))

    def fits(lower: Column) -> Column:  # of a text in lower case, made once for all its candidates
        return F.filter(own_, lambda r: F.forall(r["_rest"], lambda c: F.exists(c, lambda s: F.contains(lower, s))))

    few = rows.withColumn(h_, F.xxhash64(t_)).join(small(own), h_)
    few = few.withColumn(own_, F.flatten(F.transform(F.array(F.lower(t_)), fits)))
    found = few.select(*kept, F.explode(F.flatten(F.transform(own_, hits))).alias(hit_))
    free = regexes.filter(F.size("_f") == 0)
    if not free.isEmpty():
        every = rows.crossJoin(small(free.select(F.struct("_p", "_j").alias(own_))))
        found = found.unionByName(every.select(*kept, F.explode(hits(F.col(own_))).alias(hit_)))
    found = found.join(small(patterns), F.col(f"{hit_}.p") == F.col(r_))
    return found.select(
        *kept, F.lit(20).alias("rank"), F.col(f"{hit_}.i").alias("match_idx"), F.col(f"{hit_}.v").alias("value"), F.upper(c_).alias("type"), F.col(c_).alias("category"),
        F.col(w_).alias("confidence"), F.col(i_).alias("source"))


def held_strings(texts: DataFrame, strings: DataFrame) -> DataFrame:
    """(_h, _s): the strings (_s, of ASCII in lower case, three characters or more) that texts (_h, _t)
    hold, and a few stretches that are none. An automaton finds where a string may begin, by beginnings
    so short that they are few; from there stretches of the lengths that strings of this beginning
    have are taken, and most that are none left out by a filter, if it may travel."""
    strings = saved(strings, "asked_for")
    n, context = strings.count(), strings.sparkSession.sparkContext
    shared = context.broadcast(beginnings(strings, "_s"))
    words = context.broadcast(made(strings, lambda s: [hash_of(s, 1)], n).words) if n * BITS // 8 <= FILTER_BYTES else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun = Beginnings(shared.value)
        held = Bloom(words.value) if words is not None else None

        def put(hashes: list, keys: list) -> Iterator[pd.DataFrame]:
            kept = held.has(hash_of(k, 1) for k in keys).tolist() if held is not None else [True] * len(keys)
            if any(kept):
                yield pd.DataFrame({"_h": list(compress(hashes, kept)), "_s": list(compress(keys, kept))})

        for pdf in batches:
            hashes, keys = [], []
            for h, t in zip(pdf["_h"], pdf["_t"]):
                text = low(t)
                own = {text[a:b] for a, b in begun.places(text)}
                keys += own
                hashes += [h] * len(own)
                if len(keys) > 100_000:
                    yield from put(hashes, keys)
                    hashes, keys = [], []
            yield from put(hashes, keys)

    return texts.mapInPandas(run, "_h long, _s string")


def premint(spark, config: ScrubConfig) -> DataFrame:
    """The configured names as rows (rank, match_idx, value, type, category, confidence); a
    handful, from the configuration."""
    rows = [(0, i, v.strip(), "CUSTOMER", "customer", 1.0) for i, v in enumerate(config.customer_names) if v.strip()]
    rows += [(1, i, v.strip(), "PERSON", "person", 1.0) for i, v in enumerate(config.person_names) if v.strip()]
    out = spark.createDataFrame(rows, "rank int, match_idx int, value string, type string, category string, confidence double")
    if config.user_patterns:
        own = [(2, i, v.strip(), c, c.lower(), 1.2) for i, (v, c) in enumerate(config.user_patterns) if v.strip()]
        out = out.unionByName(spark.createDataFrame(own, out.schema).withColumn("type", label(F.col("type"))))
    return out


def drop_allowlisted(rows: DataFrame, allow: DataFrame, value: str = "value") -> DataFrame:
    """Rows whose value no allowlist entry (pattern, is_regex) covers: literals by equality
    without case, regexes by a search without case. A regex only meets the distinct values that
    hold one of its mandatory strings; one without such strings meets all of them."""
    literal = allow.filter("NOT is_regex").select(F.lower("pattern").alias("_k")).distinct()
    out = rows.join(literal, F.lower(F.col(value)) == F.col("_k"), "left_anti")
    regexes = saved(allow.filter("is_regex").select(_clauses("pattern").alias("_f"), F.concat(F.lit("(?i)"), java_column(F.col("pattern"))).alias("_p")).distinct(), "regexes")
    if regexes.isEmpty():
        return out
    values = saved(out.select(F.col(value).alias("_k")).distinct(), "values")
    some = candidates(values, regexes.filter(F.size("_f") > 0)).filter(F.rlike("_k", F.col("_p"))).select("_k")
    covered = some.unionByName(_scanned(values, regexes.filter(F.size("_f") == 0).select("_p"))).distinct()
    return out.join(small(saved(covered, "covered")), F.col(value) == F.col("_k"), "left_anti")


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _clauses(patterns: pd.Series) -> pd.Series:
    return pd.Series([[list(c) for c in mandatory(p or "")] for p in patterns], dtype=object)


def grams(text: Column) -> Column:
    """The distinct three-character pieces of a text in lower case."""
    low = F.lower(text)
    places = F.when(F.length(low) >= 3, F.sequence(F.lit(1), F.length(low) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(low, i, F.lit(3))))


def candidates(values: DataFrame, regexes: DataFrame) -> DataFrame:
    """(_k, _p): the values (_k) that hold a string of a clause (of _f) of a regex (_p). Postings of
    the values by three-character pieces; a string is looked up by the piece that fewest values
    have, a regex by the clause whose strings have the fewest postings, and the strings are
    compared as a whole."""
    strings = regexes.select("_p", F.posexplode("_f").alias("_c", "_s")).select("_p", "_c", F.explode("_s").alias("_s"))
    pieces = saved(strings.select("*", F.explode(grams(F.col("_s"))).alias("_g")), "strings")
    asked = saved(pieces.select("_g").distinct(), "pieces")
    held = values.select("_k", F.explode(grams(F.col("_k"))).alias("_g"))
    postings = saved(held.join(small(asked), "_g", "left_semi"), "postings")
    often = saved(postings.groupBy("_g").agg(F.count("*").alias("_n")), "often")
    of = F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_g").alias("g"))
    least = pieces.join(small(often), "_g", "left").groupBy("_p", "_c", "_s").agg(F.min(of).alias("_l"))
    clause = least.groupBy("_p", "_c").agg(F.sum("_l.n").alias("n"), F.collect_list(F.struct("_s", F.col("_l.g").alias("_g"))).alias("s"))  # MOST_STRINGS at most
    best = clause.groupBy("_p").agg(F.min_by("s", F.struct("n", "_c")).alias("s")).select("_p", F.explode("s").alias("s")).select("_p", "s._s", "s._g")
    pairs = postings.join(small(saved(best, "asked")), "_g")
    return pairs.filter(F.contains(F.lower("_k"), F.col("_s"))).select("_k", "_p").distinct()


def _scanned(values: DataFrame, regexes: DataFrame) -> DataFrame:
    """(_k): the values that one of the regexes (_p) matches. Values are dealt out to groups of
    bounded size, and each takes one regex after the other, which is compiled once for a group."""
    if regexes.isEmpty():
        return values.limit(0)
    n = values.count()
    groups = max(1, math.ceil(n / GROUP), min(values.sparkSession.sparkContext.defaultParallelism, n // 200))
    dealt = values.withColumn("_g", F.pmod(F.xxhash64("_k"), F.lit(groups)))
    every = regexes.withColumn("_g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    return every.hint("merge").join(dealt, "_g").filter(F.rlike("_k", F.col("_p"))).select("_k")


def counts(hits: DataFrame) -> DataFrame:
    """Hits and distinct values by detector."""
    name = F.create_map(*[x for r, d in BY_RANK.items() for x in (F.lit(r), F.lit(d.name))])
    return hits.groupBy(name[F.col("rank")].alias("detector")).agg(F.count("*").alias("hits"), F.countDistinct("value").alias("distinct_values"))
