"""Settings of a scrub."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ColumnRule:
    """Applies `pattern` to the columns whose header equals `match`, or matches it as a regex."""

    match: str
    pattern: str
    is_regex: bool = False


@dataclass(frozen=True)
class ScrubConfig:
    customer_names: tuple[str, ...] = ()
    person_names: tuple[str, ...] = ()
    user_patterns: tuple[tuple[str, str], ...] = ()  # (text, category)
    literals: tuple[tuple[str, str], ...] = ()  # (text, category) of one call
    name_allowlist: tuple[str, ...] = ()
    fqdn_allowlist_extra: tuple[str, ...] = ()
    #: Fields of a tool's input that are only scanned for credentials.
    skip_fields: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "Edit": ("old_string", "new_string"), "MultiEdit": ("edits",), "Grep": ("pattern",), "Glob": ("pattern",),
        "NotebookEdit": ("old_string", "new_string"),
    })
    column_rules: tuple[ColumnRule, ...] = ()
    auto_columns: bool = True
    judge_min_confidence: float = 0.6
    judge_max_spans: int = 16
    auto_approve: bool = False
