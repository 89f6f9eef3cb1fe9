"""Thousands of strings found in a text by one pass: an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a string's beginning that an automaton knows: the most of these of which there are
#: not too many.
HEADS, MOST_HEADS = (6, 5, 4, 3, 2, 1), 200_000


def low(s: str) -> str:
    """Lower case, one character for each."""
    out = s.lower()
    return out if len(out) == len(s) else "".join(x if len(x := c.lower()) == 1 else c for c in s)


class Strings:
    """An automaton over strings, letters in either case, each with the numbers of those who ask for it."""

    def __init__(self, strings: Iterable[tuple[str, int]]):
        asked: dict[str, list[int]] = {}
        for text, number in strings:
            if text:
                asked.setdefault(low(text), []).append(number)
        self.automaton = ahocorasick.Automaton()
        for text, numbers in asked.items():
            self.automaton.add_word(text, (len(text), numbers))
        self.empty = not asked
        if not self.empty:
            self.automaton.make_automaton()

    def numbers(self, text: str | None) -> list[int]:
        """The numbers of the strings that the text holds, in order."""
        if self.empty or not text:
            return []
        found: set[int] = set()
        for _, (_, numbers) in self.automaton.iter(low(text)):
            found.update(numbers)
        return sorted(found)

    def places(self, text: str | None) -> list[tuple[int, int, int]]:
        """(number, start, end) of each string's places from left to right that don't overlap,
        by number, then start."""
        if self.empty or not text:
            return []
        done: dict[int, int] = {}
        out = []
        for last, (size, numbers) in self.automaton.iter(low(text)):
            start = last + 1 - size
            for n in numbers:
                if start >= done.get(n, 0):
                    done[n] = last + 1
                    out.append((n, start, last + 1))
        return sorted(out)


def beginnings(strings: DataFrame, column: str) -> list[tuple[str, list[int]]]:
    """What the strings of a column begin with, and how long those are that begin so. Of millions
    of strings the beginnings are shorter, so that they are few."""
    row = strings.agg(*[F.count_distinct(F.substring(column, 1, k)).alias(f"h{k}") for k in HEADS]).first()
    size = next((k for k in HEADS if row[f"h{k}"] <= MOST_HEADS), HEADS[-1])
    heads = strings.groupBy(F.substring(column, 1, size).alias("h")).agg(F.collect_set(F.length(column)).alias("n")).filter("h <> ''")
    return [(r["h"], list(r["n"])) for r in heads.collect()]


class Beginnings:
    """Where in a text strings may stand, by what they begin with and their lengths."""

    def __init__(self, heads: Iterable[tuple[str, list[int]]]):
        self.automaton = ahocorasick.Automaton()
        for head, lengths in heads:
            self.automaton.add_word(head, (len(head), lengths))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def places(self, text: str) -> Iterator[tuple[int, int]]:
        """(start, end) of the stretches of a text in lower case."""
        for last, (size, lengths) in () if self.empty else self.automaton.iter(text):
            start = last + 1 - size
            for n in lengths:
                if start + n <= len(text):
                    yield start, start + n
