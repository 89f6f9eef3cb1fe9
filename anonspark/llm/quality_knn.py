"""Quality by similarity-weighted votes of labelled neighbours in a latent space.

A text becomes counts of hashed byte pairs and of word forms, and of a few features of
its layout; these are damped, weighted by inverse document frequency and projected on the
leading singular vectors of a labelled sample. The sample's vectors are broadcast; every
document takes exact cosine products with all of them, in blocks, and the labels of the
nearest ones vote in proportion to a power of their similarity and to how many labelled
documents of their class each stands for. Of neighbours at the same distance all vote.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, held_out, one_text, release, saved

#: Labelled documents of each class that are used at most. This bounds what is broadcast
#: (4,000 vectors of 64 floats) and what the driver gathers (their term counts).
PER_CLASS = 2000
DIMENSIONS = 64
NEIGHBOURS = 25
THRESHOLD = 0.7
_PAIRS, _SHAPES = 768, 64
TERMS = _PAIRS + _SHAPES + 8
_BLOCK = 512

#: Class of each byte: letters, upper case, digits, spaces, and signs of their own.
_CLASS = np.zeros(256, np.uint8)
_CLASS[128:] = 1
for _c in range(256):
    if chr(_c).isascii() and chr(_c).isupper():
        _CLASS[_c] = 2
    elif chr(_c).isascii() and chr(_c).islower():
        _CLASS[_c] = 1
    elif chr(_c).isascii() and chr(_c).isdigit():
        _CLASS[_c] = 3
    elif chr(_c) in " \t\r\x0b\x0c":
        _CLASS[_c] = 4
    elif _c == 10:
        _CLASS[_c] = 5
    elif chr(_c) in ".,;:'\"-()":
        _CLASS[_c] = 6
    elif _c < 128:
        _CLASS[_c] = 7


def term_counts(texts: list[str | None]) -> np.ndarray:
    """Rows of damped term weights: hashed byte pairs, hashed pairs of byte classes, and
    shares that describe repetition and layout."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for r, text in enumerate(texts):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        if not raw.size:
            continue
        n = raw.size
        low = raw | ((raw - np.uint8(65) < 26).astype(np.uint8) << 5)
        pair = (low[:-1].astype(np.uint16) << 8) | low[1:]
        kinds = _CLASS[raw]
        counts = np.bincount(((pair.astype(np.uint32) * np.uint32(40503)) & np.uint32(0xFFFF)) % np.uint32(_PAIRS), minlength=_PAIRS)
        shapes = np.bincount(kinds[:-1].astype(np.int64) * 8 + kinds[1:], minlength=_SHAPES)
        out[r, :_PAIRS] = np.sqrt(counts / n)
        out[r, _PAIRS : _PAIRS + _SHAPES] = 2 * np.sqrt(shapes / n)
        words = (text or "").encode().split()
        w = max(1, len(words))
        same = sum(a == b for a, b in zip(words, words[1:]))
        by = np.bincount(kinds, minlength=8) / n
        tail = by[7], by[2], by[3], same / (w + 20), (len(words) - len(set(words))) / (w + 20), min(1.0, n / w / 20), by[6], by[5]
        out[r, _PAIRS + _SHAPES : _PAIRS + _SHAPES + 8] = 3 * np.sqrt(tail)
    return out


@dataclass
class Model:
    idf: np.ndarray  # of each term
    axes: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # unit vectors of the sample
    labels: np.ndarray  # 0 or 1
    weights: np.ndarray  # of each sample row: the labelled documents of its class that it stands for

    def embed(self, counts: np.ndarray) -> np.ndarray:
        v = (counts * self.idf) @ self.axes
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 among the neighbours' votes; a vector of zero (an empty text)
        gets 0 if the sample has both labels."""
        out = np.zeros(len(counts))
        k = min(NEIGHBOURS, len(self.labels))
        if not k:
            return out
        for at in range(0, len(counts), _BLOCK):
            v = self.embed(counts[at : at + _BLOCK])
            cos = v @ self.vectors.T
            least = np.partition(cos, len(self.labels) - k, axis=1)[:, len(self.labels) - k, None]
            vote = np.where(cos >= np.maximum(least, 0.0), cos, 0.0)
            vote = vote * vote
            vote = vote * vote
            vote = vote * vote  # the eighth power
            total = vote @ self.weights
            good = vote @ (self.weights * self.labels)
            out[at : at + _BLOCK] = np.divide(good, total, out=np.zeros(len(v)), where=total > 0)
        return np.clip(out, 0.0, 1.0)


def _count_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        terms = term_counts(list(pdf.iloc[:, 1]))
        yield pd.DataFrame({"label": pdf.iloc[:, 0].astype("int32"), "terms": [t.tobytes() for t in terms]})


def usable(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of the labels that may be learned from, each once."""
    return labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(~held_out("doc_id", 4, 2)).select("doc_id", "quality").distinct()


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Up to per_class labelled rows of each class whose crc32 of doc_id mod 4 is not 2, in
    the order of a hash of the id: (label, text). Rows without an id, a label of 0 or 1 or a
    text are left out."""
    good = usable(labels)
    picked = None
    for label in (0, 1):
        part = good.filter(F.col("quality") == label).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    picked = saved(picked, "labelled")  # at most 2 * per_class rows
    return one_text(docs, picked, 2 * per_class).select(F.col("quality").cast("int").alias("label"), "text")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, dimensions: int = DIMENSIONS) -> Model:
    """The model of a bounded labelled sample."""
    rows = training_rows(docs, labels, per_class)
    got = rows.mapInPandas(_count_batches, "label int, terms binary").toPandas()
    if not len(got):
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(0))
    got = got.sort_values(["label", "terms"], ignore_index=True)  # the same order for any number of tasks
    all_ = {r["quality"]: r["count"] for r in usable(labels).groupBy("quality").count().collect()}  # two rows
    terms = np.frombuffer(b"".join(got["terms"]), np.float32).reshape(-1, TERMS)
    y = got["label"].to_numpy(float)
    idf = (1 + np.log((1 + len(terms)) / (1 + (terms > 0).sum(axis=0)))).astype(np.float32)
    x = terms * idf
    values, axes = np.linalg.eigh((x.T @ x).astype(np.float64))
    axes = np.ascontiguousarray(axes[:, ::-1][:, :dimensions]).astype(np.float32)
    weights = np.where(y > 0, all_.get(1, 0) / max(1, (y > 0).sum()), all_.get(0, 0) / max(1, (y == 0).sum()))
    model = Model(idf, axes, np.zeros((0, axes.shape[1]), np.float32), y, weights / weights.mean())
    model.vectors = model.embed(terms)
    return model


def score_rows(docs: DataFrame, model: Model) -> DataFrame:
    """docs with the column score (0 to 1)."""
    score, = fresh(docs.columns, "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(text: pd.Series) -> pd.Series:
        parts = [shared.value.score(term_counts(list(text.iloc[i : i + _BLOCK]))) for i in range(0, len(text), _BLOCK)]
        release()
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(score, of(F.col("text")))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted. A null text counts as empty; an
    empty text has no direction, so nothing votes for it: score 0, rejected. A null doc_id
    counts as empty text in held_out. Without a usable label all scores are 0. Very long texts
    count whole; neighbours that tie for the last place all vote; repeated rows repeat. Empty in,
    empty out; extra columns, of whatever name, don't matter."""
    rows = score_rows(docs.select("doc_id", "text"), fit(docs, labels))
    return rows.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier accepts, with their own columns."""
    score, = fresh(docs.columns, "score")
    return score_rows(docs, fit(docs, labels)).filter(F.col(score) >= THRESHOLD).select(*docs.columns)
