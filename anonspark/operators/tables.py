"""Scrubbing tables column by column."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anonspark.config import ColumnRule, ScrubConfig
from anonspark.functions.patterns import BY_NAME
from anonspark.operators.apply import apply_columns, redact_credentials, redact_kv
from anonspark.operators.detect import detect
from anonspark.operators.mint import assign_tokens, first_by_key
from anonspark.plans.storage import saved

#: A column pattern's token type and detector (None: the whole cell).
PATTERNS = {
    "Email": ("EMAIL", "email"), "Phone": ("PHONE", "phone"), "SSN": ("SSN", None), "IPv4": ("IP", "ipv4"), "IPv6": ("IP", "ipv6"),
    "PersonName": ("PERSON", None), "StreetAddress": ("ADDR", "street"), "FQDN": ("HOST", "fqdn"), "CreditCard": ("ACCOUNT", "card"),
    "UncPath": ("PATH", "unc_path"), "DomainUser": ("USER", "domain_user"), "MAC": ("MAC", "mac"), "GUID": ("GUID", "guid"),
}
#: Headers that tell a column's pattern, first match wins, without case.
HEURISTICS = (
    (r"email|e-?mail", "Email"), (r"phone|tel|mobile", "Phone"), (r"ssn", "SSN"), (r"^ip$|ip[\s_-]?addr", "IPv4"),
    (r"^name$|full[\s_-]?name|person[\s_-]?name", "PersonName"), (r"address|street", "StreetAddress"), (r"domain|fqdn|host(name)?$", "FQDN"),
)


def _compiled(regex: str) -> re.Pattern | None:
    try:
        return re.compile(regex, re.I)
    except re.error:
        return None


def resolve_column(header: str, rules: tuple[ColumnRule, ...] = (), auto: bool = True) -> tuple[str | None, str]:
    """(pattern, source) of a header: what the first of the rules, and then of the heuristics,
    that matches it says. A rule's text matches as a whole, without case; a regex that doesn't
    compile and a blank header match nothing."""
    tests = [(r.match if r.is_regex else rf"\A{re.escape(r.match)}\Z", r.pattern, "rule") for r in rules]
    tests += [(regex, pattern, "heuristic") for regex, pattern in HEURISTICS] if auto else []
    name = header.strip()
    says = ((pattern, source) for regex, pattern, source in tests if name and (rx := _compiled(regex)) and rx.search(name))
    return next(says, (None, "unresolved"))


def normalize_custom_label(raw: str) -> str | None:
    """A label as a token type of 2 to 24 characters that begins with a letter, or None."""
    text = re.sub(r"[^A-Z0-9_]+", "_", raw.strip().upper()).strip("_") if isinstance(raw, str) else ""
    return text if 2 <= len(text) <= 24 and "A" <= text[0] <= "Z" else None


def plan_columns(columns: list[str], config: ScrubConfig, overrides: dict[str, dict] | None = None) -> dict[str, tuple[str, str]]:
    """(action, type or pattern) of each column. overrides: {"kind": "pattern" | "custom" |
    "regex" | "skip", "pattern"/"label": …} by header; they precede rules and heuristics; a
    column that nothing resolves is scrubbed as text, a blank header is skipped."""
    overrides = overrides or {}
    validate_overrides(overrides)
    out = {}
    for c in columns:
        own = overrides.get(c)
        if not c.strip():
            out[c] = ("skip", "")
        elif own and own["kind"] == "pattern":
            out[c] = ("pattern", own["pattern"])
        elif own and own["kind"] == "custom":
            out[c] = ("custom", normalize_custom_label(own["label"]))
        elif own:
            out[c] = (own["kind"], "")
        else:
            pattern, _ = resolve_column(c, config.column_rules, config.auto_columns)
            out[c] = ("pattern", pattern) if pattern else ("regex", "")
    return out


def validate_overrides(overrides: dict[str, dict]) -> None:
    for header, o in overrides.items():
        if o.get("kind") not in ("pattern", "custom", "regex", "skip"):
            raise ValueError(f"{header}: unknown kind {o.get('kind')!r}")
        if o["kind"] == "pattern" and o.get("pattern") not in PATTERNS:
            raise ValueError(f"{header}: unknown pattern {o.get('pattern')!r}")
        if o["kind"] == "custom" and normalize_custom_label(o.get("label")) is None:
            raise ValueError(f"{header}: invalid label {o.get('label')!r}")


def inspect_table(df: DataFrame, name: str, row: str, config: ScrubConfig | None = None) -> DataFrame:
    """One row per column but `row`, which orders the table: table_name, header,
    resolved_pattern, source, sample_value (the first cell with text, 80 characters), row_count
    (cells with text). One pass over the table."""
    config = config or ScrubConfig()
    columns = [c for c in df.columns if c != row]
    text = lambda c: F.trim(F.col(f"`{c}`").cast("string"))
    aggs = []
    for i, c in enumerate(columns):
        full = text(c).isNotNull() & (text(c) != "")
        aggs += [F.min_by(F.when(full, text(c)), F.when(full, F.col(row))).alias(f"s{i}"), F.count(F.when(full, 1)).alias(f"n{i}")]
    one = df.agg(*aggs)
    items = []
    for i, c in enumerate(columns):
        pattern, source = resolve_column(c, config.column_rules, config.auto_columns)
        sample = F.when(F.length(f"s{i}") > 80, F.concat(F.substring(f"s{i}", 1, 80), F.lit("…"))).otherwise(F.col(f"s{i}"))
        items.append(F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("header"), F.lit(pattern).cast("string").alias("resolved_pattern"), F.lit(source).alias("source"), sample.alias("sample_value"), F.col(f"n{i}").alias("row_count")))
    return one.select(F.explode(F.array(*items)).alias("c")).select("c.*")


def _dictionary(df: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """(row, col, cell): each distinct cell of each column, at its first row. One scan of the table,
    whatever the number of columns; repeated cells go before the shuffle."""
    parts = [F.struct(F.lit(i).alias("col"), F.col(f"`{c}`").cast("string").alias("cell")) for i, c in enumerate(columns)]
    cells = df.select(F.col(row).alias("row"), F.explode(F.array(*parts)).alias("c")).select("row", "c.*").filter("cell IS NOT NULL")
    return saved(cells.groupBy("col", "cell").agg(F.min("row").alias("row")), "cells")


def _forced(cells: DataFrame, plan: list[tuple[str, str | None]]) -> DataFrame:
    """The values of the columns with a pattern or a label of their own: the matches in a cell, or the
    whole cell if there are none."""
    values = F.lit(None).cast("array<string>")
    type_ = F.lit(None).cast("string")
    for i, (action, what) in enumerate(plan):
        if action == "regex":
            continue
        name, detector = PATTERNS[what] if action == "pattern" else (what, None)
        own = F.array("cell")
        if detector:
            found = F.regexp_extract_all("cell", F.lit(BY_NAME[detector].regex), F.lit(0))
            own = F.when(F.size(found) > 0, found).otherwise(own)
        values = F.when(F.col("col") == i, own).otherwise(values)
        type_ = F.when(F.col("col") == i, F.lit(name)).otherwise(type_)
    rows = cells.select("row", "col", type_.alias("type"), F.posexplode(values).alias("match_idx", "value"))
    return rows.select("row", "col", "match_idx", "value", "type", F.lower("type").alias("category"), F.lit(1.0).alias("confidence"), F.lit(0).alias("rank"))


def scrub_tables(tables: dict[str, tuple[DataFrame, str]], config: ScrubConfig | None = None, overrides: dict[str, dict[str, dict]] | None = None, vocab: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """(tables, tokens, summary) of {name: (table, ordering column)} with one shared map.

    Columns of a pattern have their matches replaced whatever their type, or the whole cell
    if nothing in it matches; custom columns the whole cell; text columns what a scrub of
    text finds. Numbers and dates stay as they are in text columns. Order of sight: table, row, column, match; of rows that share an
    ordering value, the value."""
    config, overrides = config or ScrubConfig(), overrides or {}
    hits, plans, held = None, {}, {}
    for t, (name, (df, row)) in enumerate(tables.items()):
        plans[name] = plan = plan_columns([c for c in df.columns if c != row], config, overrides.get(name))
        kinds = dict(df.dtypes)
        columns = [c for c in plan if plan[c][0] in ("pattern", "custom") or plan[c][0] == "regex" and kinds[c] == "string"]
        if not columns:
            continue
        held[name] = _dictionary(df, row, columns)
        cells = held[name].filter("trim(cell) <> ''")
        forced = _forced(cells, [plan[c] for c in columns])
        loose = [i for i, c in enumerate(columns) if plan[c][0] == "regex"]
        if loose:
            part = detect(cells.filter(F.col("col").isin(loose)), "cell", config).filter("rank <> 19").select("row", "col", "match_idx", "value", "type", "category", "confidence", "rank")
            forced = forced.unionByName(part)
        part = forced.withColumn("tab", F.lit(t))
        hits = part if hits is None else hits.unionByName(part)
    order = ["tab", "row", "col", "rank", "match_idx", "value"]
    tokens = saved(assign_tokens(first_by_key(hits, order), vocab, order), "cell_tokens")
    named = tokens.select("real_value", "token")
    if vocab is not None:
        named = named.unionByName(vocab.select("real_value", "token")).distinct()
    out, summary = {}, None
    for name, (df, row) in tables.items():
        done, per = _apply_table(df, held.get(name), name, plans[name], named)
        out[name] = done
        summary = per if summary is None else summary.unionByName(per)
    return out, tokens, summary


def _apply_table(df: DataFrame, cells: DataFrame | None, name: str, plan: dict, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every column that is not skipped takes the shared map by way of its dictionary."""
    kinds = dict(df.dtypes)
    touched = [c for c in plan if plan[c][0] in ("pattern", "custom") or plan[c][0] == "regex" and kinds[c] == "string"]
    whole = lambda c: plan[c][0] == "custom" or plan[c][0] == "pattern" and PATTERNS[plan[c][1]][1] is None
    done = apply_columns(df, cells, tokens, [(c, f"_new{i}", whole(c)) for i, c in enumerate(touched)])
    for i, c in enumerate(touched):
        if plan[c][0] == "regex":
            done = done.withColumn(f"_new{i}", redact_kv(redact_credentials(F.col(f"_new{i}"))))
    changed = F.lit(0)
    for i, c in enumerate(touched):
        changed = changed + F.when(F.col(f"_new{i}") != F.col(f"`{c}`").cast("string"), 1).otherwise(0)
    resolved = "; ".join(f"{name}::{c} → {plan[c][1] or plan[c][0]}" for c in plan)
    summary = done.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows"), F.coalesce(F.sum(changed), F.lit(0)).cast("long").alias("cells_scrubbed"), F.lit(resolved).alias("columns_resolved"))
    new = {c: f"_new{i}" for i, c in enumerate(touched)}
    return done.select(*[F.col(new[c]).alias(c) if c in new else F.col(f"`{c}`") for c in df.columns]), summary


def scrub_table(df: DataFrame, name: str, row: str, config: ScrubConfig | None = None, overrides: dict[str, dict] | None = None, vocab: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    out, tokens, summary = scrub_tables({name: (df, row)}, config, {name: overrides or {}}, vocab)
    return out[name], tokens, summary
