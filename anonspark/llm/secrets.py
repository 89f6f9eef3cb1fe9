"""Secret scanning with a trigram index, in DataFrame operations only.

Each rule's regex yields a Boolean query: alternatives, each a set of trigrams that every
match of it must hold. The index lists, for the trigrams of all rules, the documents whose
lower-cased text holds them; intersecting the lists of an alternative gives its candidates,
and only these meet the regex. A rule with an alternative without trigrams reads all texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as _c
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, saved, small


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` (Java and Python read it alike) whose group has `least`
    characters or more; shorter ones are consumed and dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules, in the order in which spans of one start are listed.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Formats of keys that their issuers describe.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE_RULES + MORE_RULES
_MOST_ALTERNATIVES = 256


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of lower-case trigrams, one of which every match holds in full; None
    if a match may hold none."""
    found = _walk(_parser.parse(pattern), {(frozenset(), "")})
    if found is None:
        return None
    queries = {frozenset(run[i : i + 3] for run in [*runs, last] for i in range(len(run) - 2)) for runs, last in found}
    if not all(queries):
        return None
    return sorted((q for q in queries if not any(o < q for o in queries)), key=sorted)  # a larger set adds nothing


def _end(states: set) -> set:
    """The states once their runs have ended; runs without a trigram don't matter."""
    return {(runs | {last} if len(last) >= 3 else runs, "") for runs, last in states}


def _walk(nodes, states: set) -> set | None:
    """states: (literal runs so far, the run that may go on)."""
    for op, arg in nodes:
        ends = _end(states)
        if op is _c.LITERAL:
            states = {(runs, last + chr(arg).lower()) for runs, last in states}
        elif op is _c.IN and len(arg) <= 6 and all(o is _c.LITERAL for o, _ in arg):
            states = {(runs, last + chr(a).lower()) for runs, last in states for _, a in arg}
        elif op is _c.SUBPATTERN:
            states = _walk(arg[3], states)
        elif op is _c.BRANCH:
            parts = [_walk(branch, states) for branch in arg[1]]
            states = None if None in parts else set().union(*parts)
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
            least, most, inner = arg
            once = _walk(inner, states)
            if once is None:
                return None
            if (least, most) == (0, 1):
                states = states | once
            elif least == most == 1:
                states = once
            else:  # what is repeated is at least there once, and then any number of times
                states = _end(once) if least else ends
        elif op in (_c.AT, _c.ASSERT, _c.ASSERT_NOT):
            continue
        else:
            states = ends
        if states is None or len(states) > _MOST_ALTERNATIVES:
            return None
    return states


#: Letters of prose from frequent to rare.
_LETTERS = "etaoinshrdlucmfwypvbgkjqxz"


def rarest(trigrams: frozenset[str]) -> str:
    """The trigram that prose is least likely to hold; a guess, on which only time depends."""
    weight = lambda t: (len(set(t)), sum(_LETTERS.find(c) % 27 for c in t), t)
    return max(trigrams, key=weight)


def build_index(docs: DataFrame, alternatives: list[frozenset[str]]) -> DataFrame:
    """Postings (trigram, doc_id) of the alternatives' trigrams, in the shared folder. A text
    that lacks the rarest trigram of an alternative is not looked through for its others, as it
    can't answer it."""
    low = docs.select("doc_id", F.lower("text").alias("low"))
    by_first: dict[str, set[str]] = {}
    for a in alternatives:
        by_first.setdefault(rarest(a), set()).update(a)
    none = F.array().cast("array<string>")
    held = [
        F.when(F.col("low").contains(first), F.array_compact(F.array(F.lit(first), *[F.when(F.col("low").contains(t), t) for t in sorted(others - {first})]))).otherwise(none)
        for first, others in sorted(by_first.items())
    ]
    return saved(low.select("doc_id", F.explode(F.array_distinct(F.concat(*held))).alias("trigram")), "postings")


def candidates(postings: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(doc_id, kinds): the rules whose query the document's postings answer."""
    terms = [(kind, a, t, 1 << i, (1 << len(q)) - 1) for kind, qs in queries.items() for a, q in enumerate(qs) for i, t in enumerate(sorted(q))]
    values = ", ".join("('{}', {}, '{}', {}L, {}L)".format(k, a, t.replace("'", "\\'"), b, n) for k, a, t, b, n in terms)
    table = postings.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(kind, alternative, trigram, bit, need)")
    hit = postings.join(F.broadcast(table), "trigram")  # as many rows as the rules have trigrams
    met = hit.groupBy("doc_id", "kind", "alternative", "need").agg(F.bit_or("bit").alias("bits")).filter("bits = need")
    return saved(met.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds")), "candidates")


def match_spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of the rule's matches, in code points, end exclusive."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    group = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    parts = F.arrays_zip(F.transform(found, F.length).alias("size"), F.transform(gaps, F.length).alias("gap"), F.transform(group, F.length).alias("kept"))
    empty = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,kept:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        one = F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["kept"].alias("kept"))
        return F.struct((start + F.coalesce(x["size"], F.lit(0))).alias("at"), F.concat(acc["spans"], F.array(one)).alias("spans"))

    spans = F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])
    return F.filter(spans, lambda s: s["kept"] >= rule.least)  # what follows the last match has no size


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the column secrets: array of (start, kind, stop, text), kind being the rule's
    number, sorted. A null text has none, a very long one is read whole; matches of one start come
    in the order of the rules. Rows that repeat a doc_id, or have none, share their
    candidates, which only means that more rules are tried on them."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    kinds, key, name, text = fresh(docs.columns, "_kinds", "_key", "secrets", "_text")
    rows = docs.withColumn(text, F.coalesce("text", F.lit("")))
    if queries:
        near = candidates(build_index(docs, [a for q in queries.values() for a in q]), queries)
        near = near.withColumnsRenamed({"doc_id": key, "kinds": kinds})
        rows = rows.join(small(near, near.count()), F.col("doc_id").eqNullSafe(F.col(key)), "left").drop(key)
    every = []
    for i, rule in enumerate(rules):
        spans = F.transform(match_spans(F.col(text), rule), lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("stop")))  # noqa: B023
        gate = F.array_contains(kinds, rule.kind) if rule.kind in queries else F.col(text).rlike(rule.pattern)
        every.append(F.when(F.coalesce(gate, F.lit(False)), spans))
    none = F.from_json(F.lit("[]"), "array<struct<start:int,kind:int,stop:int>>")
    found = F.array_sort(F.concat(*[F.coalesce(e, none) for e in every]))
    return rows.withColumn(name, found).drop(kinds, text)


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    rows = find(docs.select("doc_id", "text"), rules)
    name = F.array(*[F.lit(r.kind) for r in rules])

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["stop"])), ",")

    def count(kind: int) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")

    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(F.filter("secrets", lambda s: s["kind"] < len(BASE_RULES))), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )


def python_spans(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, str, int]]:
    """The same spans by Python's re, for tests."""
    out = [(m.start(), i, m.end()) for i, r in enumerate(rules) for m in re.finditer(r.pattern, text or "") if len(m.group(r.group)) >= r.least]
    return [(s, rules[i].kind, e) for s, i, e in sorted(out)]
