"""Quality rules: base counts of a text and gradient-boosted trees over its statistics.

The trees are grown on the driver from the statistics of a bounded labelled sample, with
histogram splits, and flattened into node arrays, so that a batch of documents walks all
trees at once. Chosen features are monotone: more of them never raises the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, held_out, one_text, saved

#: Labelled documents of each class that are used at most.
PER_CLASS = 5000
TREES, DEPTH, RATE, BINS, LEAST_WEIGHT = 60, 3, 0.2, 64, 2.0
THRESHOLD = 0.5
WINDOW = 5
_BATCH_WORDS = 300_000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Features of the trees and their direction: -1 if more of it never raises the score.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1,
    "digit_share": 0, "exclamation_share": -1, "adjacent_repeats": -1, "distinct_share": 0, "mean_line": 0, "short_lines": 0,
}


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, np.uint8)
    t[[ord(c) for c in chars]] = 1
    return t


_SPACES = _table(" \t\n\x0b\x0c\r")
_SYMBOLS = _table("#*$%&|<>")
_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGITS = _table("0123456789")
_MARKS = _table("!")
_STARTS = np.array([(b & 0xC0) != 0x80 for b in range(256)], np.uint8)  # first bytes of code points


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def statistics(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(base counts, features) of each text, in the order of COUNTS and FEATURES."""
    n = len(texts)
    raws = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raws])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    count = lambda flags: np.add.reduceat(flags, starts, dtype=np.int64)
    letter = _STARTS[data] & (1 - _SPACES[data])
    chars = count(letter)
    symbols, upper, digits, marks = (count(t[data]) for t in (_SYMBOLS, _UPPER, _DIGITS, _MARKS))
    ids: dict[bytes, int] = {}
    local, sizes, distinct, dup, lines, brief = [], [], [], [], [], []
    for raw in raws:
        words = raw.split()
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
        local.append(w)
        sizes.append(len(w))
        distinct.append(len(set(words)))
        full = [x for x in raw.split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
        dup.append(len(full) - len(set(full)))
        lines.append(len(full))
        brief.append(sum(len(x) < 25 for x in full))
    sizes, distinct, dup, lines, brief = map(np.array, (sizes, distinct, dup, lines, brief))
    flat = np.concatenate(local) if n else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(n), sizes)
    repeat = np.zeros(n, np.int64)
    adjacent = np.zeros(n, np.int64)
    if flat.size > 1:
        adjacent += np.bincount(doc[1:][(flat[1:] == flat[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
    if flat.size >= WINDOW:
        code = _mix(flat.astype(np.uint64))
        m = flat.size - WINDOW + 1
        key = np.zeros(m, np.uint64)
        for j in range(WINDOW):
            key = key * np.uint64(0x5851F42D4C957F2D) + code[j : j + m]
        key = _mix(key ^ _mix(doc[:m].astype(np.uint64) << np.uint64(32)))  # equal only inside one text
        whole = np.flatnonzero(doc[:m] == doc[WINDOW - 1 :])
        order = whole[np.argsort(key[whole], kind="stable")]
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        edge = np.zeros(flat.size + 1, np.int64)
        np.add.at(edge, order[twice], 1)
        np.add.at(edge, order[twice] + WINDOW, -1)
        repeat += np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n)
    words, chars1 = np.maximum(sizes, 1), np.maximum(chars, 1)
    counts = np.stack([sizes, chars, symbols, dup, repeat], axis=1).astype(np.int64) if n else np.zeros((0, 5), np.int64)
    features = np.stack([
        np.log1p(sizes), chars / words, symbols / chars1, dup / np.maximum(lines, 1), repeat / words, upper / chars1,
        digits / chars1, marks / chars1, adjacent / words, distinct / words, sizes / np.maximum(lines, 1), brief / np.maximum(lines, 1),
    ], axis=1) if n else np.zeros((0, len(FEATURES)))
    return counts, features


# ---------------------------------------------------------------- trees
@dataclass
class Forest:
    """Trees as node arrays: rows go left where the feature is at most the threshold; a
    leaf is its own child."""

    bias: float = 0.0
    roots: list[int] = field(default_factory=list)
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def flat(self) -> Forest:
        kinds = dict(roots=int, feature=int, threshold=float, left=int, right=int, value=float)
        return Forest(self.bias, **{k: np.array(getattr(self, k), kind) for k, kind in kinds.items()})

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            margin += self.value[at]
        return 1 / (1 + np.exp(-margin))


def train(x: np.ndarray, y: np.ndarray, directions: list[int], trees: int = TREES) -> Forest:
    """Boosted trees for the logistic loss. A split of a monotone feature must order its
    children's values, and their middle bounds all values below."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1) if len(x) else np.zeros(x.shape, int)
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    forest = Forest(bias=float(np.log(share / (1 - share))))
    margin = np.full(len(y), forest.bias)

    def node(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, lo: float, hi: float) -> int:
        me = len(forest.value)
        forest.feature.append(0)
        forest.threshold.append(0.0)
        forest.left.append(me)
        forest.right.append(me)
        gs, hs = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-gs / (hs + 1), lo, hi))
        forest.value.append(RATE * value)
        best = (1e-6, None)
        if depth:
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                gl = np.cumsum(np.bincount(bins[rows, f], g[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(bins[rows, f], h[rows], len(e) + 1))[:-1]
                gr, hr = gs - gl, hs - hl
                vl, vr = np.clip(-gl / (hl + 1), lo, hi), np.clip(-gr / (hr + 1), lo, hi)
                gain = -(gl * vl + (hl + 1) * vl**2 / 2) - (gr * vr + (hr + 1) * vr**2 / 2) + gs * value + (hs + 1) * value**2 / 2
                bad = (hl < LEAST_WEIGHT) | (hr < LEAST_WEIGHT) | (directions[f] * (vr - vl) < 0)
                k = int(np.argmax(np.where(bad, -np.inf, gain)))
                if not bad[k] and gain[k] > best[0]:
                    best = (gain[k], (f, k, float(vl[k]), float(vr[k])))
        if best[1]:
            f, k, vl, vr = best[1]
            forest.feature[me], forest.threshold[me] = f, float(edges[f][k])
            mid, d = (vl + vr) / 2, directions[f]
            go = bins[rows, f] <= k
            forest.left[me] = node(rows[go], g, h, depth - 1, mid if d < 0 else lo, mid if d > 0 else hi)
            forest.right[me] = node(rows[~go], g, h, depth - 1, mid if d > 0 else lo, mid if d < 0 else hi)
        return me

    if len(np.unique(y)) < 2:
        return forest.flat()
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        before = len(forest.value)
        forest.roots.append(node(np.arange(len(y)), p - y, p * (1 - p), DEPTH, -4.0, 4.0))
        one = Forest(0.0, [0], *[list(a) for a in (
            forest.feature[before:], forest.threshold[before:], [i - before for i in forest.left[before:]], [i - before for i in forest.right[before:]], forest.value[before:])]).flat()
        p = one.probability(x)
        margin += np.log(p / (1 - p))
    return forest.flat()


# ---------------------------------------------------------------- Spark
def _pieces(texts: pd.Series) -> Iterator[tuple[int, list]]:
    """Parts of a batch with a bounded number of bytes."""
    part, held, done = [], 0, 0
    for i, t in enumerate(texts):
        part.append(t)
        held += len(t or "")
        if held > 6 * _BATCH_WORDS or i + 1 == len(texts):
            yield done, part
            part, held, done = [], 0, i + 1


def _sample_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at, part in _pieces(pdf["text"]):
            yield pd.DataFrame({"label": pdf["label"].iloc[at : at + len(part)], "x": list(statistics(part)[1])})


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Forest:
    """Trees from up to per_class labelled documents of each class, in the order of a hash
    of the id, of those whose crc32 of doc_id mod 4 is not 2. Without both classes no tree
    grows and the verdict is the label that there is, or 1."""
    good = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(~held_out("doc_id", 4, 2)).select("doc_id", "quality").distinct()
    parts = [good.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    picked = saved(parts[0].unionByName(parts[1]), "labelled")  # at most 2 * per_class rows
    rows = one_text(docs, picked, 2 * per_class).select(F.col("quality").cast("int").alias("label"), "text")
    got = rows.mapInPandas(_sample_batches, "label int, x array<double>").toPandas()
    if not len(got):
        return Forest(bias=1.0).flat()
    x, y = np.stack(got["x"].to_numpy()), got["label"].to_numpy(float)
    order = np.lexsort([*x.T[::-1], y])  # the same order for any number of tasks
    return train(x[order], y[order], list(FEATURES.values()))


def judged(docs: DataFrame, forest: Forest) -> DataFrame:
    """docs with the base counts, base_failed, score and kept."""
    names = fresh(docs.columns, *COUNTS, "base_failed", "score", "kept")
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # at most TREES * 2^(DEPTH + 1) nodes
    one, = fresh([*docs.columns, *names], "_judged")

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS) + ", score double")
    def of(text: pd.Series) -> pd.DataFrame:
        parts = []
        for _, part in _pieces(text):
            counts, x = statistics(part)
            parts.append(pd.DataFrame(counts, columns=COUNTS).assign(score=shared.value.probability(x)))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=[*COUNTS, "score"])

    rows = docs.withColumn(one, of(F.col("text")))
    rows = rows.withColumns({n: F.col(one)[c] for n, c in zip(names, [*COUNTS, None, "score"]) if c})
    failed = (F.col(names[0]) < 10) | (100 * F.col(names[4]) > 20 * F.col(names[0]))
    return rows.withColumn(names[5], failed).withColumn(names[7], ~failed & (F.col(names[6]) >= THRESHOLD)).drop(one)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, the base counts, base_failed, score, kept. A null text has no
    words and fails; repeated rows repeat. Empty in, empty out; extra columns don't matter."""
    rows = judged(docs.select("doc_id", "text"), fit(docs, labels))
    return rows.select("doc_id", *COUNTS, "base_failed", "score", "kept")
