"""SimHash near-duplicates with bit-sliced comparison.

Each document gets a 64-bit fingerprint. Two fingerprints that differ in at most R bits
agree in full on at least m - R of m bit blocks, so equal values of some choice of m - R
blocks bring every such pair together. Inside such a bucket the fingerprints are stored
as vertical bit planes, 64 fingerprints to a word; the distances of many pairs advance
together through a carry-save counter, plane by plane, and a block of lanes is given up
once all of its lanes exceed the radius. A bucket returns stars, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_first, release, saved, small, text_key
from .graph import components

RADIUS = 4
SHINGLE_WORDS = 4
SEED = 42
#: A bucket of more fingerprints is dealt out as pairs of chunks of this size.
CHUNK = 4096
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Planes after which blocks are looked at: 64 random lanes are mostly beyond four bits after 24.
_LOOKS = frozenset((15, 19, 23, 27, 31, 39, 47, 55))
_BYTE_LOW = np.uint64(0x0101010101010101)
#: Words of planes that are compared at once where digits have several bits.
_TOGETHER = 1 << 17
#: Largest group that is compared by shifting all lanes of a batch at once.
_SHIFTED = 24


# ---------------------------------------------------------------- fingerprints
def shingle_hashes(text: str | None, words: int = SHINGLE_WORDS) -> list[int]:
    """XXH64 of each shingle of a text with A-Z in lower case; fewer words than a
    shingle: of the whole sequence; no word: none."""
    w = (text or "").encode().lower().split()
    if not w:
        return []
    line = b" ".join(w)
    if len(w) <= words:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = (np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1).tolist()
    starts = [0, *[e + 1 for e in ends[:-1]]]
    h = xxhash.xxh64_intdigest
    return [h(line[s:e], SEED) for s, e in zip(starts, ends[words - 1 :])]


def fingerprints(groups: list[list[int]]) -> np.ndarray:
    """A bit of a fingerprint is 1 if it is set in over half of the group's hashes."""
    sizes = np.fromiter(map(len, groups), np.int64, len(groups))
    out = np.zeros(len(groups), np.uint64)
    full = np.flatnonzero(sizes)
    if not full.size:
        return out
    h = np.fromiter((x for g in groups for x in g), np.uint64, int(sizes.sum()))
    n = sizes[full]
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    pieces = (n + 254) // 255  # byte counters hold 255
    piece_first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    starts = np.repeat(first - 255 * piece_first, pieces) + 255 * np.arange(pieces.sum())
    bits = np.zeros((full.size, 64), bool)
    for s in range(8):
        byte = np.add.reduceat((h >> np.uint64(s)) & _BYTE_LOW, starts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        bits[:, s::8] = 2 * np.add.reduceat(byte, piece_first, axis=0) > n[:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _fingerprint_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keys, groups, n, done = pdf.iloc[:, 0], [], 0, 0
        for i, text in enumerate(pdf.iloc[:, 1]):
            groups.append(shingle_hashes(text))
            n += len(groups[-1])
            if n > 300_000 or i + 1 == len(pdf):
                fp = fingerprints(groups).view(np.int64)
                yield pd.DataFrame({"doc_id": keys.iloc[done : i + 1], "fp": fp})
                groups, n, done = [], 0, i + 1
        release()


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of every row, in the shared folder."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInPandas(_fingerprint_batches, f"doc_id {kind}, fp long")
    return saved(rows, "fingerprints")


# ---------------------------------------------------------------- bit-sliced comparison
def planes(fp: np.ndarray) -> np.ndarray:
    """64 bit planes of the fingerprints, 64 lanes to a word."""
    return byte_planes(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8))


def byte_planes(rows: np.ndarray) -> np.ndarray:
    """The bit planes of rows of bytes, 64 lanes to a word."""
    out = np.zeros((8 * rows.shape[1], -(-len(rows) // 64)), np.uint64)
    for a in range(0, len(rows), 4096):  # few bits at a time lie one to a byte
        bits = np.unpackbits(rows[a : a + 4096], axis=1, bitorder="little")
        part = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
        out.view(np.uint8)[:, a // 8 : a // 8 + part.shape[1]] = part
    return out


def within(left: np.ndarray, i: np.ndarray, right: np.ndarray, j: np.ndarray, out: np.ndarray, radius: int, digit: int = 1, looks=_LOOKS) -> np.ndarray:
    """Lanes whose distance is at most `radius`. left, right: bit planes, 64 lanes to a word;
    word i[k] of left meets word j[k] of right in block k; out: lanes of the blocks that don't
    count. The distance is that of digits of so many bits, a bit by itself or a byte. Counters are
    carry-save: ones, twos, fours and so on, and a sticky bit for what they can't hold. Behind the
    digits of `looks` the blocks whose lanes all exceed the radius are given up, and only the
    others go on."""
    result = np.zeros(out.shape, np.uint64)
    live = np.flatnonzero(out != _ONES)
    if not live.size:
        return result
    i, j, over = i[live], j[live], out[live]
    counts = [np.zeros(live.size, np.uint64) for _ in range(max(1, radius.bit_length()))]
    ahead = iter(())
    for d in range(len(left) // digit):
        if digit == 1:
            carry = left[d][i] ^ right[d][j]
        else:
            carry = next(ahead, None)
            if carry is None:  # few blocks: several digits at a time
                upto = min(len(left), (d + max(1, min(16, _TOGETHER // (digit * live.size)))) * digit)
                differ = np.take(left[d * digit : upto], i, axis=1) ^ np.take(right[d * digit : upto], j, axis=1)
                ahead = iter(np.bitwise_or.reduce(differ.reshape(-1, digit, live.size), axis=1))
                carry = next(ahead)
        for k, plane in enumerate(counts):
            carry, counts[k] = plane & carry, plane ^ carry
        over |= carry
        if d in looks:
            stay = np.flatnonzero((over | _more(*counts, radius)) != _ONES)
            if 4 * stay.size < 3 * live.size:
                live, i, j, over, *counts = (x[stay] for x in (live, i, j, over, *counts))
                ahead = iter([x[stay] for x in ahead])
                if not stay.size:
                    break
    result[live] = ~(over | _more(*counts, radius))
    return result


def _more(*rest) -> np.ndarray:
    """Lanes whose counter is over the radius: the counter's planes, ones first, and the radius."""
    *counts, radius = rest
    above, equal = np.zeros_like(counts[0]), np.full_like(counts[0], _ONES)
    for k in reversed(range(len(counts))):
        plane = counts[k]
        if radius >> k & 1:
            equal &= plane
        else:
            above |= equal & plane
            equal &= ~plane
    return above


def whole_words(rows: np.ndarray) -> np.ndarray:
    """Bit b of each of the rows of bytes, as a whole word."""
    return np.where(np.unpackbits(rows, axis=1, bitorder="little").T.astype(bool), _ONES, np.uint64(0))


def shifted(p: np.ndarray, s: int) -> np.ndarray:
    """Lane i of the result is lane i + s."""
    w, r = divmod(s, 64)
    out = np.zeros_like(p)
    keep = p.shape[-1] - w
    if keep > 0:
        out[..., :keep] = p[..., w:] >> np.uint64(r)
        if r and keep > 1:
            out[..., : keep - 1] |= p[..., w + 1 :] << np.uint64(64 - r)
    return out


def lanes(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)


def packed(flags: np.ndarray) -> np.ndarray:
    padded = np.zeros(-(-flags.size // 64) * 64, np.uint8)
    padded[: flags.size] = flags
    return np.packbits(padded, bitorder="little").view(np.uint64)


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of the pairs in place; the root of a set is its least member."""
    while a.size:
        ra, rb = root[a], root[b]
        keep = ra != rb
        a, b, ra, rb = a[keep], b[keep], ra[keep], rb[keep]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := root[root], root):
            root[:] = up


def link_groups(fp: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For rows sorted by group: the least row that each row is linked to inside its group."""
    n = len(fp)
    root = np.arange(n)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, int)
    sizes = np.diff(np.concatenate([starts, [n]]))
    few = np.repeat(sizes <= _SHIFTED, sizes)
    rows = np.flatnonzero(few)
    if rows.size:
        p, size, place = planes(fp[rows]), np.repeat(sizes, sizes)[rows], (np.arange(n) - np.repeat(starts, sizes))[rows]
        for s in range(1, int(sizes[sizes <= _SHIFTED].max())):
            inside = place + s < size  # the row s further on is of the same group
            word = np.arange(p.shape[1])
            lane = within(p, word, shifted(p, s), word, ~packed(inside), radius)
            i = np.flatnonzero(lanes(lane, rows.size))
            _merge(root, rows[i], rows[np.minimum(i + s, rows.size - 1)])
    for g in np.flatnonzero(sizes > _SHIFTED):
        own = slice(starts[g], starts[g] + sizes[g])
        _link_large(fp[own], root[own], int(starts[g]), radius)
    return root


def _link_large(fp: np.ndarray, root: np.ndarray, base: int, radius: int) -> None:
    """As link_groups for one large group: 64 fingerprints at a time against all planes from
    their own block of lanes on. root: a view whose entries count from base."""
    n, p = len(fp), planes(fp)
    local = root - base
    out = ~packed(np.ones(n, bool))
    for first in range(p.shape[1]):
        q = fp[64 * first : 64 * first + 64]
        bits = whole_words(q.view(np.uint8).reshape(-1, 8))
        width = p.shape[1] - first
        word, query = np.tile(np.arange(first, p.shape[1]), len(q)), np.repeat(np.arange(len(q)), width)
        near = within(p, word, bits, query, np.tile(out[first:], len(q)), radius)
        hit = np.flatnonzero(near)
        lane, bit = np.nonzero(lanes(near[hit, None], 64))
        _merge(local, query[hit[lane]] + 64 * first, word[hit[lane]] * 64 + bit)
    root[:] = local + base


# ---------------------------------------------------------------- candidate buckets
def block_count(distinct: int, radius: int = RADIUS) -> int:
    """Bit blocks for so many distinct fingerprints: enough that a bucket of random
    fingerprints has about 16 members at most, at radius + 2 blocks at the least."""
    m = radius + 2
    while m < 4 * radius and distinct > 16 << (64 * (m - radius) // m):
        m += 1
    return m


def bucket_keys(fp: Column, m: int, radius: int = RADIUS) -> Column:
    """The value of every choice of m - radius of m blocks, each with the choice's number."""
    edges = [64 * i // m for i in range(m + 1)]
    keys = []
    for k, chosen in enumerate(combinations(range(m), m - radius)):
        value = F.lit(0).cast("long")
        for i in chosen:
            width = edges[i + 1] - edges[i]
            value = F.shiftleft(value, width).bitwiseOR(F.shiftrightunsigned(fp, edges[i]).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(F.struct(F.lit(k).alias("choice"), value.alias("value")))
    return F.array(*keys)


def _link_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (choice, value, i, j, fp) sorted by the first four: whole groups are linked,
    the last group of a batch waits for the next batch."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        new = (pdf.iloc[:, :4].diff() != 0).any(axis=1).to_numpy()
        last = int(np.flatnonzero(new)[-1]) if len(pdf) else 0
        rest = pdf.iloc[last:]
        yield from _linked(pdf.iloc[:last], new[:last])
    if rest is not None and len(rest):
        yield from _linked(rest, np.arange(len(rest)) == 0)


def _linked(pdf: pd.DataFrame, new: np.ndarray) -> Iterator[pd.DataFrame]:
    if len(pdf):
        fp = pdf["fp"].to_numpy()
        root = link_groups(fp.view(np.uint64), np.cumsum(new))
        hung = np.flatnonzero(root != np.arange(len(fp)))
        yield pd.DataFrame({"a": fp[hung], "b": fp[root[hung]]})


def links(distinct: DataFrame, n: int, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) over distinct fingerprints (fp) that connect exactly those which a
    chain of links of at most `radius` bits connects."""
    if radius > 6:
        raise ValueError("the carry-save counter takes a radius of 6 at most")
    m = block_count(n, radius)
    keys = distinct.select(F.explode(bucket_keys(F.col("fp"), m, radius)).alias("k"), "fp").select("k.choice", "k.value", "fp")
    counts = keys.groupBy("choice", "value").agg(F.count("*").alias("n")).filter("n > 1")
    rows = keys.join(counts, ["choice", "value"])
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp"), chunks.cast("long")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), chunks - 1), lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j")))
    dealt = rows.select("choice", "value", F.explode(F.when(F.col("n") <= chunk, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(pair)).alias("p"), "fp")
    dealt = dealt.select("choice", "value", "p.i", "p.j", "fp")
    order = ["choice", "value", "i", "j"]
    return dealt.repartition(*order).sortWithinPartitions(*order).mapInPandas(_link_batches, "a long, b long").distinct()


def classes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per row of docs: doc_id, fp (long), component_id: the smallest doc_id that links reach."""
    prints = fingerprint_table(docs)
    distinct = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    roots = components(links(distinct, distinct.count(), radius))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = saved(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    named = saved(rooted.join(small(least, least.count()), "root").select("fp", "component_id"), "components")
    return prints.join(small(named, named.count()), "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    A null text counts as empty; a text without words has fingerprint zero and links like
    any other. Repeated rows repeat in the result. A null doc_id takes part in links and
    is no component_id unless the whole component has no other. Empty in, empty out;
    extra columns don't matter.
    """
    rows = classes(docs, radius)
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs without near-duplicates: of each component the row of the least doc_id stays,
    one row of those that repeat it. Rows without a doc_id stay. Components are found by
    text, so rows that repeat a doc_id with another text are told apart."""
    found = classes(docs.select(text_key().alias("doc_id"), "text"), radius)
    named = saved(found.select(F.col("doc_id").alias("text_key"), "component_id").distinct(), "classes")
    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", text_key().alias("text_key"))
    return keep_first(docs, saved(rows.join(small(named, named.count()), "text_key"), "named"), "component_id")
