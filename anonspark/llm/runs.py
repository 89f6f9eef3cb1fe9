"""Periodic runs of words: stretches that repeat a sequence three times or more.

A run has `exponent` periods at least, so each of its words occurs that often in it. Words
that occur more rarely within a segment of a text can be in no run: they split the segment,
and its pieces are counted anew until no word is rare in its segment. Segments that are
shorter than a run go. The others are scanned at their lags: short lags one by one, longer
ones only where a whole stretch of g words, g the power of two below the lag, is found again
at the lag. The stretch is taken at every g-th word, of which every run of such a lag holds
one with its repetition. Equal stretches are known by ranks, which double in length until no
stretch repeats, so a text costs n log n, however long its periods are.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release

LEAST, EXPONENT = 24, 3
#: Lags below are scanned one by one; a power of two.
SHORT_LAGS = 64
Words = list[bytes]


# ---------------------------------------------------------------- segments
def segments(codes: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int]]:
    """(begin, end) of the stretches of at least `least` words in which every word occurs
    `exponent` times or more."""
    out, work = [], [(0, len(codes))]
    while work:
        begin, end = work.pop()
        if end - begin < least:
            continue
        part = codes[begin:end]
        low = int(part.min())
        if int(part.max()) - low < 4 * len(part):
            times = np.bincount(part - low)[part - low]
        else:
            _, code, count = np.unique(part, return_inverse=True, return_counts=True)
            times = count[code]
        rare = np.flatnonzero(times < exponent)
        if not rare.size:
            out.append((begin, end))
            continue
        edges = np.concatenate([[-1], rare, [end - begin]])
        long = np.flatnonzero(np.diff(edges) > least)
        work += [(begin + int(edges[i]) + 1, begin + int(edges[i + 1])) for i in long]
    return sorted(out)


# ---------------------------------------------------------------- lags
def _stretches(same: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of the stretches of true values of at least `need`."""
    edges = np.concatenate([[-1], np.flatnonzero(~same), [len(same)]])
    size = np.diff(edges) - 1
    at = np.flatnonzero(size >= need)
    return edges[at] + 1, size[at]


def _ranks(codes: np.ndarray) -> list[np.ndarray]:
    """ranks[l][i]: a number for the 2^l words from i on, equal for equal words, as far as any repeat."""
    out = [codes]
    while True:
        half, last = 1 << (len(out) - 1), out[-1]
        if len(last) <= half:
            return out
        pair = last[:-half].astype(np.int64) * (int(last.max()) + 1) + last[half:]
        distinct, rank = np.unique(pair, return_inverse=True)
        if len(distinct) == len(pair):
            return out
        out.append(rank.astype(np.int32))


def _common(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
    """How many words agree from i and j on (forward), or before them; j > i."""
    i, j = i.copy(), j.copy()
    first = i.copy()
    for level in range(len(ranks) - 1, -1, -1):
        rank, size = ranks[level], 1 << level
        if forward:
            at = np.flatnonzero(j + size <= len(ranks[0]))
            at = at[rank[i[at]] == rank[j[at]]]
            i[at] += size
            j[at] += size
        else:
            at = np.flatnonzero(i >= size)
            at = at[rank[i[at] - size] == rank[j[at] - size]]
            i[at] -= size
            j[at] -= size
    return np.abs(i - first)


def _long_lags(codes: np.ndarray, first: int, most: int, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(begin, length, lag) of the maximal stretches that keep a lag of first to most."""
    ranks = _ranks(codes)
    size, level = first, first.bit_length() - 1
    while size <= most and level < len(ranks):
        rank = ranks[level].astype(np.int64)
        n = len(rank)
        order = np.sort(rank * n + np.arange(n))  # by rank, then place
        anchor = np.arange(0, n, size)
        low = np.searchsorted(order, rank[anchor] * n + np.minimum(anchor + size, n))
        high = np.searchsorted(order, rank[anchor] * n + np.minimum(anchor + min(2 * size, most + 1), n))
        times = np.maximum(high - low, 0)
        i = np.repeat(anchor, times)
        j = order[np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)] % n
        lag = j - i
        begin = i - _common(ranks, i, j, False)
        length = i + _common(ranks, i, j, True) - begin + lag
        fit = np.flatnonzero(length >= exponent * lag)
        yield begin[fit], length[fit], lag[fit]
        size, level = 2 * size, level + 1


def find_runs(codes: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (start, length, period) of all runs of a sequence of numbers, by start, then period.
    A stretch counts with its smallest period: with `exponent` periods of one lag, another
    lag of the same stretch is a multiple of the smallest, which the stretch keeps as far."""
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    found = []
    for begin, end in segments(codes, least, exponent):
        part = codes[begin:end]
        most = len(part) // exponent
        for lag in range(1, min(SHORT_LAGS - 1, most) + 1):
            start, size = _stretches(part[:-lag] == part[lag:], max(least, exponent * lag) - lag)
            if start.size:
                found.append(np.stack([start + begin, size + lag, np.full(start.size, lag)], axis=1))
        if most >= SHORT_LAGS:
            _, part = np.unique(part, return_inverse=True)
            for start, length, lag in _long_lags(part.astype(np.int32), SHORT_LAGS, most, exponent):
                fit = length >= least
                found.append(np.stack([start[fit] + begin, length[fit], lag[fit]], axis=1))
    rows = np.concatenate([np.zeros((0, 3), np.int64), *found])
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
    rows = rows[new]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def repeated_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of n words stands in a run after its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(steps[:-1]) > 0


def numbered(words: Words) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


# ---------------------------------------------------------------- tables
def collapsed(docs: DataFrame, prepare: Callable[[str | None, Words], Words] | None = None, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, runs (array of start, length, period in words, by
    start, then period), text (the words that no run repeats, joined by one space).

    Words are what white space of ASCII separates. prepare: changes a row's words before they
    are searched, given the id as text. A null text has no words, as an empty one; a very long
    one is searched whole; repeated rows repeat; a null id is kept. Empty in, empty out; extra
    columns don't matter.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, out, held = pdf.iloc[:, 0], [], 0
            for i, (key, text) in enumerate(zip(ids, pdf.iloc[:, 1])):
                words = (text or "").encode().split()
                if prepare is not None:
                    words = prepare(key, words)
                runs = find_runs(numbered(words), least, exponent) if len(words) >= least else np.zeros((0, 3), np.int64)
                if len(runs):
                    words = [w for w, gone in zip(words, repeated_words(len(words), runs).tolist()) if not gone]
                out.append((key, *runs.T, b" ".join(words).decode()))
                held += len(out[-1][-1])
                if held > 8 << 20 or i + 1 == len(pdf):
                    yield pd.DataFrame(out, columns=["doc_id", "start", "length", "period", "text"])
                    out, held = [], 0
            release()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    done = rows.mapInPandas(run, "doc_id string, start array<long>, length array<long>, period array<long>, text string")
    runs = F.arrays_zip("start", "length", "period")
    return done.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), runs.alias("runs"), "text")


def strongest(runs: Column) -> Column:
    """The run with the greatest length/period, of these the one that starts first, of these
    the one of the least period; null without any."""
    def order(a: Column, b: Column) -> Column:
        one, other = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(one != other, F.when(one > other, -1).otherwise(1)).when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(
            F.when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0))

    return F.get(F.array_sort(runs, order), 0)


def made_periodic(key: str | None, words: Words) -> Words:
    """The words of a document, those of every tenth (by a hash of its id) replaced from some
    place on by a repetition of the first of them."""
    h, n = zlib.crc32((key or "").encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def report(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_runs; of the strongest run start, length, period and
    exponent_milli; runs_sha256 and collapsed_sha256, over the documents that made_periodic makes."""
    rows = collapsed(docs, made_periodic)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), strongest(F.col("runs")).alias("b"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    return best.select(
        "doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("1000 * b.length DIV b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


SQL = """WITH d AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS r, doc_id, COALESCE(CAST(doc_id AS VARCHAR), '') AS k, regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
c AS (SELECT r, doc_id, w, len(w) AS n, xor(list_reduce(list_concat([4294967295], flatten(list_transform(range(1, len(k) + 1), lambda i: [CAST(ascii(k[i]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda x, v: CASE WHEN v >= 0 THEN xor(x, v) ELSE xor(x >> 1, 3988292384 * (x & 1)) END), 4294967295) AS h FROM d),
s AS (SELECT r, n, h % 10 = 0 AND n > 0 AS made, CASE WHEN n > 0 THEN (h // 10) % n ELSE 0 END AS a, (h // 10) % 8 AS g FROM c),
o AS (SELECT r, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS word FROM c),
f AS (SELECT o.r, o.i, s.n, CASE WHEN s.made AND o.i >= s.a THEN s.a + (o.i - s.a) % (1 + (s.n - s.a) // (3 + s.g)) ELSE o.i END AS j FROM o JOIN s USING (r)),
t AS (SELECT f.r, f.i, f.n, o.word FROM f JOIN o ON o.r = f.r AND o.i = f.j),
u AS (SELECT *, count(*) OVER (PARTITION BY r, word) AS times FROM t),
m AS (SELECT a.r, b.i - a.i AS q, a.i FROM u a JOIN u b ON a.r = b.r AND a.word = b.word AND b.i > a.i AND 3 * (b.i - a.i) <= a.n WHERE a.times >= 3 AND b.times >= 3),
e AS (SELECT r, q, min(i) AS begun, count(*) + q AS size FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM m) GROUP BY r, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS (SELECT r, begun, size, min(q) AS q FROM e GROUP BY r, begun, size),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY CAST(size AS DOUBLE) / q DESC, begun, q) = 1),
per AS (SELECT r, count(*) AS n_runs, string_agg(concat(begun, ',', size, ',', q, chr(10)), '' ORDER BY begun, q) AS lines FROM runs GROUP BY r),
gone AS (SELECT DISTINCT t.r, t.i FROM t JOIN runs x ON x.r = t.r AND t.i >= x.begun + x.q AND t.i < x.begun + x.size),
kept AS (SELECT t.r, string_agg(t.word, ' ' ORDER BY t.i) AS words FROM t LEFT JOIN gone g ON g.r = t.r AND g.i = t.i WHERE g.r IS NULL GROUP BY t.r)
SELECT c.doc_id, COALESCE(p.n_runs, 0) AS n_runs, b.begun AS start, b.size AS length, b.q AS period, 1000 * b.size // b.q AS exponent_milli,
  sha256(COALESCE(p.lines, '')) AS runs_sha256, sha256(COALESCE(k.words, '')) AS collapsed_sha256
FROM c LEFT JOIN per p USING (r) LEFT JOIN best b USING (r) LEFT JOIN kept k USING (r)"""
