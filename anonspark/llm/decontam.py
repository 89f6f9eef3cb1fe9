"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may occur with up to k = floor(rate * n) edits. Cut into
k + 1 pieces, at least one of them survives any k edits unchanged. Pieces are found by
their first bytes in a bitmap over all positions of a batch of texts at once and confirmed
in full. Hits are verified with Myers' bit-parallel edit distance, one integer as long as
the pattern. A hit that stands alone first meets ever longer runs of pieces around it: of a
run of m pieces that occurs with m - 1 edits, one half does so with one edit less than it has
pieces, so a hit whose runs all occur leads to every match and the others end early.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, release, saved, small, text_key

ERROR_RATE = 0.1
#: Items of one pass hold at most this many bytes of text (what a task keeps of them).
BLOCK_BYTES = 8 << 20
#: Bytes of a piece that the bitmap looks at; pieces have five characters at least, but of items under ten.
_KEY, _SHORT = 8, 5
#: Patterns whose bit masks a task keeps.
_MASKS = 20_000


def normalised(text: str | None) -> str:
    """Lower case A-Z, runs of white space as one space, trimmed."""
    raw = (text or "").encode().lower()
    return b" ".join(raw.split()).decode()


def budget(chars: int, rate: float = ERROR_RATE) -> int:
    """Edits allowed for an item."""
    return int(rate * chars)


def cut(item: str, k: int) -> list[int]:
    """Where k + 1 pieces of nearly the same length begin, and the end."""
    return [len(item) * i // (k + 1) for i in range(k + 2)]


def runs_around(piece: int, pieces: int) -> list[tuple[int, int]]:
    """The halves, quarters and so on of the pieces that hold one of them, the shortest
    first, without the piece itself and the whole."""
    lo, hi, out = 0, pieces, []
    while hi - lo > 1:
        out.append((lo, hi))
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if piece < mid else (mid, hi)
    return out[:0:-1]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def edit_distance(pattern: str, text: str, most: int, peq: dict[str, int] | None = None) -> int:
    """The least edit distance between the pattern and any substring of text, or most + 1
    if it is larger (Myers 1999, with a Python integer as the bit vector)."""
    m = len(pattern)
    peq = masks(pattern) if peq is None else peq
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = mask, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & mask
        pv = (mh << 1 | ~(xv | ph)) & mask
        mv = ph & xv
        best = min(best, score)
    return min(best, most + 1)


class Matcher:
    """The items of one block, ready to search batches of texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        self.items = [(i, t) for i, t in ((i, normalised(t)) for i, t in items) if t]
        self.budgets = np.array([budget(len(t), rate) for _, t in self.items], np.int64)
        self.edges = [cut(t, k) for (_, t), k in zip(self.items, self.budgets.tolist())]
        pieces = []  # key, item, piece, byte offset, bytes
        self.tiny = []  # items under five bytes: searched directly
        for n, ((_, t), edges) in enumerate(zip(self.items, self.edges)):
            offset = 0
            for j, (a, b) in enumerate(zip(edges, edges[1:])):
                raw = t[a:b].encode()
                if len(raw) < _SHORT:
                    self.tiny.append((n, raw))
                else:
                    pieces.append((raw[:_KEY] if len(raw) >= _KEY else raw[:_SHORT], n, j, offset, raw))
                offset += len(raw)
        pieces.sort(key=lambda p: p[:3])
        self.piece_bytes = [p[4] for p in pieces]
        self.item_of, self.piece_of, self.offset_of = (np.array([p[i] for p in pieces], np.int64) for i in (1, 2, 3))
        keys, width = np.array([int.from_bytes(p[0], "little") for p in pieces], np.uint64), np.array([len(p[0]) for p in pieces], int)
        self.tables = []  # (mask, sorted keys, their pieces, bitmap) by length of key
        for w in (_KEY, _SHORT):
            own = np.flatnonzero(width == w)
            if own.size:
                order = own[np.argsort(keys[own], kind="stable")]
                bitmap = np.zeros(1 << 20, bool)
                bitmap[self._slot(keys[own])] = True
                self.tables.append((np.uint64((1 << 8 * w) - 1), keys[order], order, bitmap))
        self.halves = lru_cache(_MASKS)(self._halves)
        self.masks = lru_cache(_MASKS)(lambda n, lo, hi: masks(self._run(n, lo, hi)))

    def _halves(self, n: int, lo: int, piece: int, hi: int) -> list[bytes]:
        item, edges = self.items[n][1], self.edges[n]
        cuts = [(a, (a + b) // 2, b) for i, (a, b) in enumerate(zip(edges[lo:hi], edges[lo + 1 : hi + 1]), lo) if i != piece]
        return [item[x:y].encode() for a, m, b in cuts for x, y in ((a, m), (m, b))]

    def _run(self, n: int, lo: int, hi: int) -> str:
        return self.items[n][1][self.edges[n][lo] : self.edges[n][hi]]

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def hits(self, raw: bytes) -> np.ndarray:
        """Rows (position, piece) of every exact piece hit in raw."""
        found = []
        data = raw + b"\0" * 16
        for shift in range(8):  # every eighth position at once
            words = np.frombuffer(data, np.uint64, (len(data) - shift) // 8, shift)
            for mask, known, order, bitmap in self.tables:
                keys = words & mask
                at = np.flatnonzero(bitmap[self._slot(keys)])
                lo = np.searchsorted(known, keys[at], "left")
                hi = np.searchsorted(known, keys[at], "right")
                for a, x, y in zip(*(v[hi > lo].tolist() for v in (at, lo, hi))):
                    pos = a * 8 + shift
                    for r in order[x:y].tolist():
                        if raw.startswith(self.piece_bytes[r], pos):
                            found.append((pos, r))
        return np.array(found, np.int64).reshape(-1, 2)

    def leads(self, text: bytes, at: int, piece: int) -> bool:
        """Whether the runs of pieces around a hit at a place of a text all occur there."""
        n, j = int(self.item_of[piece]), int(self.piece_of[piece])
        edges, item = self.edges[n], self.items[n][1]
        for lo, hi in runs_around(j, len(edges) - 1):
            e = hi - lo - 1
            before = len(item[edges[lo] : edges[j]].encode()) + 4 * e  # an edit moves at most four bytes
            after = len(item[edges[j] : edges[hi]].encode()) + 4 * e
            near = text[max(0, at - before) : at + after]
            if not any(half in near for half in self.halves(n, lo, j, hi)):
                return False  # m - 1 edits can't change all 2 (m - 1) halves of the other pieces
            window = near.decode(errors="replace")
            if edit_distance(self._run(n, lo, hi), window, e, self.masks(n, lo, hi)) > e:
                return False
        return True

    def search(self, texts: list[str]) -> list[dict[int, int]]:
        """For each normalised text: item index -> least edits, within its budget."""
        out: list[dict[int, int]] = [{} for _ in texts]
        raws = [t.encode() for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])]).astype(np.int64)
        whole = b"\0".join(raws)
        for n, p in self.tiny:
            for d, r in enumerate(raws):
                if p in r:
                    out[d][n] = 0
        hits = self.hits(whole)
        if not len(hits):
            return out
        place, piece = hits[:, 0], hits[:, 1]
        item, offset = self.item_of[piece], self.offset_of[piece]
        doc = np.searchsorted(starts, place, "right") - 1
        diagonal = place - offset
        order = np.lexsort((diagonal, item, doc))
        doc, item, diagonal, piece, place = doc[order], item[order], diagonal[order], piece[order], place[order]
        reach = 4 * self.budgets[item]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > reach[1:])])
        at = np.flatnonzero(new)
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(doc)]):
            n, d = int(item[a]), int(doc[a])
            if out[d].get(n) == 0:
                continue
            base = int(starts[d])
            if b - a == 1 or (piece[a:b] == piece[a]).all():
                if not any(self.leads(raws[d], p - base, int(piece[a])) for p in place[a:b].tolist()):
                    continue
            name, pattern = self.items[n]
            k = int(self.budgets[n])
            exact = pattern.encode()
            lo = max(0, int(diagonal[a]) - base - 4 * k)
            hi = min(len(raws[d]), int(diagonal[b - 1]) - base + len(exact) + 4 * k)
            window = raws[d][lo:hi]
            edits = 0 if exact in window else edit_distance(pattern, window.decode(errors="replace"), k, self.masks(n, 0, k + 1))
            if edits <= k:
                out[d][n] = min(edits, out[d].get(n, edits))
        return out


def _scan(items: list[tuple[int, str]], rate: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(items, rate)
        for pdf in batches:
            ids, keys, texts, n = pdf.iloc[:, 0], pdf.iloc[:, 1], [], 0
            done = 0
            for i, text in enumerate(pdf.iloc[:, 2]):
                texts.append(normalised(text))
                n += len(texts[-1])
                if n > 4 << 20 or i + 1 == len(pdf):
                    rows = [
                        (ids.iloc[done + d], keys.iloc[done + d], matcher.items[m][0], edits)
                        for d, found in enumerate(matcher.search(texts)) for m, edits in found.items()
                    ]
                    if rows:
                        yield pd.DataFrame(rows, columns=["doc_id", "text_key", "item_id", "edits"])
                    texts, n, done = [], 0, i + 1
            release()
    return run


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items, streamed to the driver in blocks of bounded size, as they are stored. An item
    without an id or without a word can't be matched; one that is repeated in another block is
    found twice, which its matches' least edits make good."""
    block, held = {}, 0
    for row in benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").toLocalIterator():
        block[row["item_id"], row["text"]] = None
        held += len(row["text"].encode())
        if held >= block_bytes:
            yield list(block)
            block, held = {}, 0
    if block:
        yield list(block)


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, text_key, item_id, edits): every item that occurs anywhere in a document's
    text with at most its budget of edits, once for rows of the same doc_id and text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    rows = docs.filter("text IS NOT NULL").select("doc_id", text_key().alias("text_key"), "text")
    schema = f"doc_id {kind}, text_key string, item_id {item_kind}, edits int"
    found = docs.sparkSession.createDataFrame([], schema)
    for block in item_blocks(benchmark, block_bytes):  # one block at a time is held; what it finds is stored
        found = found.unionByName(saved(rows.mapInPandas(_scan(block, rate), schema), "found"))
    return saved(found.groupBy("doc_id", "text_key", "item_id").agg(F.min("edits").alias("edits")), "leaks")


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """Per row of docs: doc_id, contaminated, n_items, item_ids (sorted, comma-joined),
    least_edits (null if clean). A null or empty text is clean, a very long one is searched
    whole; a row's own text decides, also where rows repeat a doc_id or have none. An item that
    occurs several times counts once, with its least edits. Empty in, empty out; extra columns,
    of whatever name, don't matter."""
    found = matches(docs, benchmark, rate)
    per = found.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list("item_id")).alias("ids"), F.min("edits").alias("least_edits"))
    per = per.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("own_key") == F.col("_key"))
    rows = docs.select("doc_id", text_key().alias("own_key")).join(small(per, per.count()), same, "left")
    return rows.select(
        "doc_id",
        F.col("ids").isNotNull().alias("contaminated"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.concat_ws(",", F.col("ids").cast("array<string>")), F.lit("")).alias("item_ids"),
        F.col("least_edits").cast("long").alias("least_edits"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """docs without the rows that hold an item, with the columns of docs, whatever their names.
    Rows without a text stay; rows that repeat one another stay or go together."""
    leak, key = fresh(docs.columns, "_leak_id", "_leak_key")
    leaks = matches(docs, benchmark, rate).select(F.col("doc_id").alias(leak), F.col("text_key").alias(key)).distinct()
    leaks = saved(leaks, "leaking")
    same = F.col("doc_id").eqNullSafe(F.col(leak)) & (text_key() == F.col(key))
    return docs.join(small(leaks, leaks.count()), same, "left_anti")
