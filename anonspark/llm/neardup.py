"""Near-duplicates by Jaccard similarity of five-word shingles, for the pipeline's stage.

Two texts are linked if their sets of shingles have a similarity of 0.8 or more, counted
over the whole sets. Candidates come from MinHash: 32 bands of four minima each, and a
sketch of one byte for each of the 128 minima. A pair at 0.8 exactly shares no band in one
of 2e7 cases and is kept apart by its sketch in fewer; more similar pairs are missed still
less. A bucket of many texts is first compared with its most typical members (stars), so
that a large group of copies costs as many comparisons as it has texts; only texts that
these leave in different components are compared in pairs. As such texts may all be about
as alike as 0.7, these pairs must also agree in a finer sketch of 1,024 minima, which is made
for them alone; a pair at 0.8 exactly fails it in one of 3e6 cases.

Sketches are compared as operator 2 compares fingerprints: as vertical bit planes, 64 sketches to
a word, whose differing bytes carry-save counters add up, and blocks of lanes are given up once all
of them differ in too many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_first, release, saved, small, text_key
from .graph import components, joined
from .simhash import SEED, byte_planes, lanes, packed, shifted, shingle_hashes, whole_words, within

WORDS = 5
BANDS, ROWS = 32, 4
MINIMA = BANDS * ROWS
#: Equal bytes of two sketches that make a candidate; 102 of 128 are expected at 0.8.
AGREE = 72
#: Minima of the finer sketch, and equal bytes that make a candidate: 820 are expected at 0.8, with a deviation of 12.8.
FINE, FINE_AGREE = 1024, 756
#: Up to so many members of a bucket, all pairs are candidates.
PAIRED = 24
#: Words of lanes, over all shifts, that small buckets are compared in at once (8 MB of planes).
SHIFTED_WORDS = 1024
#: Members of a bucket that one task compares with stars, and in pairs.
STAR_CHUNK, CHUNK = 65_536, 4096
_R = np.random.default_rng(SEED)
_XOR = _R.integers(0, 2**64, FINE, np.uint64)
_ODD = _R.integers(0, 2**64, FINE, np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def node_of(text: str | None) -> int:
    """Hash of the words of a text, A-Z in lower case: texts of one node have equal shingles."""
    return xxhash.xxh64_intdigest(b" ".join((text or "").encode().lower().split()), SEED)


def minima(groups: list[list[int]], count: int) -> Iterator[np.ndarray]:
    """The least value of each non-empty set of hashes under so many hash functions."""
    sizes = np.fromiter(map(len, groups), np.int64, len(groups))
    h = np.fromiter((x for g in groups for x in g), np.uint64, int(sizes.sum()))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for k in range(count):
        yield np.minimum.reduceat((h ^ _XOR[k]) * _ODD[k], starts)


def fine_sketches(groups: list[list[int]]) -> np.ndarray:
    return np.ascontiguousarray(np.stack([(m >> np.uint64(8)).astype(np.uint8) for m in minima(groups, FINE)]).T)


def sketches(groups: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (n x 32) and sketches (n x 128 bytes) of non-empty sets of hashes."""
    least = np.stack(list(minima(groups, MINIMA)))
    keys = np.empty((len(groups), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(groups), _ODD[b])
        for k in range(b * ROWS, (b + 1) * ROWS):
            key = (key ^ least[k]) * _MIX
            key ^= key >> np.uint64(32)
        keys[:, b] = key
    return keys.view(np.int64), np.ascontiguousarray((least >> np.uint64(8)).astype(np.uint8).T)


def _sketch_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids, keys, groups, nodes, n, done = pdf.iloc[:, 0], pdf.iloc[:, 1], [], [], 0, 0
        for i, text in enumerate(pdf.iloc[:, 2]):
            groups.append(shingle_hashes(text, WORDS))
            nodes.append(node_of(text))
            n += len(groups[-1])
            if n > 300_000 or i + 1 == len(pdf):
                bands, bytes_ = [[]] * len(groups), [b""] * len(groups)
                full = [g for g, x in enumerate(groups) if x]
                if full:
                    b, s = sketches([groups[g] for g in full])
                    for at, g in enumerate(full):
                        bands[g], bytes_[g] = b[at], s[at].tobytes()
                yield pd.DataFrame({
                    "doc_id": ids.iloc[done : i + 1].to_numpy(), "text_key": keys.iloc[done : i + 1].to_numpy(),
                    "node": np.array(nodes, np.uint64).view(np.int64), "bands": bands, "sketch": bytes_})
                groups, nodes, n, done = [], [], 0, i + 1
        release()


# ---------------------------------------------------------------- candidates
def alike(left: np.ndarray, i: np.ndarray, right: np.ndarray, j: np.ndarray, out: np.ndarray, differ: int) -> np.ndarray:
    """Lanes whose sketches differ in at most so many bytes, by operator 2's comparison: bit planes,
    carry-save counters, and blocks of 64 lanes given up once all of them differ in more."""
    return within(left, i, right, j, out, differ, 8, range(differ | 15, len(left) // 8, 32))


def paired(sketch: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) of rows of one group whose sketches agree; rows sorted by groups of at
    most PAIRED. All groups at once: the lanes meet themselves, shifted by one, two and so on."""
    p, n = byte_planes(sketch), len(sketch)
    out = []
    for s in range(1, PAIRED):
        inside = np.zeros(n, bool)
        inside[: n - s] = group[s:] == group[: n - s]
        if not inside.any():
            break
        out.append(~packed(inside))
    found, word, at_once = [(np.zeros(0, np.int64),) * 2], np.arange(p.shape[1]), max(1, SHIFTED_WORDS // max(1, p.shape[1]))
    for a in range(0, len(out), at_once):  # few rows: several shifts in one comparison
        part = out[a : a + at_once]
        right = np.concatenate([shifted(p, a + 1 + k) for k in range(len(part))], axis=1)
        near = alike(p, np.tile(word, len(part)), right, np.arange(right.shape[1]), np.concatenate(part), MINIMA - AGREE)
        k, i = np.nonzero(lanes(near.reshape(len(part), -1), n))
        found.append((i, i + a + 1 + k))
    i, j = (np.concatenate(x) for x in zip(*found))
    return i, j


def stars(sketch: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(center, members) until every row is in a star."""
    left, turn = np.arange(len(sketch)), 0
    while left.size > 1:
        rows, some = sketch[left], np.arange(min(64, left.size))
        if turn < 8:  # the row next to what most rows have
            flat = rows.astype(np.int64) + 256 * np.arange(rows.shape[1])
            usual = np.bincount(flat.ravel(), minlength=256 * rows.shape[1]).reshape(-1, 256).argmax(axis=1)
            some = np.array([np.count_nonzero(rows == usual.astype(np.uint8), axis=1).argmax()])
        p = byte_planes(rows)
        word, query = np.tile(np.arange(p.shape[1]), some.size), np.repeat(np.arange(some.size), p.shape[1])
        out = np.tile(~packed(np.ones(left.size, bool)), some.size)
        near = lanes(alike(p, word, whole_words(rows[some]), query, out, MINIMA - AGREE).reshape(some.size, -1), left.size)
        free = np.ones(left.size, bool)
        for center, own in zip(some.tolist(), near):
            if free[center]:
                free[center] = False
                yield int(left[center]), left[own & free]
                free &= ~own
        left, turn = left[free], turn + 1


def _grouped(batches: Iterator[pd.DataFrame], keys: int, use) -> Iterator[pd.DataFrame]:
    """use(rows, edges) for whole runs of rows that agree in the first `keys` columns."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        new = np.flatnonzero((pdf.iloc[:, :keys].diff() != 0).any(axis=1).to_numpy())
        rest = pdf.iloc[new[-1] :]
        yield from _used(pdf, new, use)
    if rest is not None:
        yield from _used(rest, np.array([0, len(rest)]), use)
    release()


def _used(pdf: pd.DataFrame, edges: np.ndarray, use) -> Iterator[pd.DataFrame]:
    node = pdf["node"].to_numpy()
    found, held = [], 0
    for i, j in use(pdf, edges) if len(edges) > 1 else ():
        if len(j):
            one, other = np.broadcast_to(node[i], len(j)), node[j]
            found.append(np.stack([np.maximum(one, other), np.minimum(one, other)], axis=1))
            held += len(j)
            if held > 200_000:
                yield pd.DataFrame(np.concatenate(found), columns=["a", "b"])
                found, held = [], 0
    if found:
        yield pd.DataFrame(np.concatenate(found), columns=["a", "b"])


def _stacked(sketches_: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sketches_), np.uint8).reshape(len(sketches_), -1)


def _starred(pdf: pd.DataFrame, edges: np.ndarray) -> Iterator[tuple]:
    """Pairs of rows: all of the small groups, stars of the large ones."""
    sketch, sizes = _stacked(pdf["sketch"].iloc[: edges[-1]]), np.diff(edges)
    group = np.repeat(np.arange(len(sizes)), sizes)
    few = np.flatnonzero(np.repeat(sizes <= PAIRED, sizes))
    i, j = paired(sketch[few], group[few])
    yield few[i], few[j]
    for g in np.flatnonzero(sizes > PAIRED):
        for center, near in stars(sketch[edges[g] : edges[g + 1]]):
            yield edges[g] + center, edges[g] + near


def _star_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    yield from _grouped(batches, 2, _starred)


def _across(pdf: pd.DataFrame, edges: np.ndarray) -> Iterator[tuple]:
    """Pairs of different roots, each in the bucket of the first band that it shares: 64 rows at a
    time against all from their own block of lanes on, by the sketch and then by the finer one."""
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        group = pdf.iloc[a:b]
        sketch, fine, root = _stacked(group["sketch"]), _stacked(group["fine"]), group["root"].to_numpy()
        before = np.stack(group["bands"].to_list())[:, : int(group["band"].iloc[0])]
        p, q, n = byte_planes(sketch), byte_planes(fine), b - a
        for first in range(0, n, 64):
            rows = np.arange(first, min(first + 64, n))
            words = np.arange(first // 64, p.shape[1])
            other = (root[rows, None] != root[None, first:]) & (rows[:, None] < np.arange(first, n))
            out = np.concatenate([~packed(o) for o in other])
            word, query = np.tile(words, rows.size), np.repeat(np.arange(rows.size), words.size)
            near = alike(p, word, whole_words(sketch[rows]), query, out, MINIMA - AGREE)
            near = alike(q, word, whole_words(fine[rows]), query, ~near, FINE - FINE_AGREE)
            i, j = np.nonzero(lanes(near.reshape(rows.size, -1), n - first))
            i, j = i + first, j + first
            once = ~(before[i] == before[j]).any(axis=1)
            yield a + i[once], a + j[once]


def _pair_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    yield from _grouped(batches, 3, _across)


def star_pairs(members: DataFrame, chunk: int) -> DataFrame:
    """Candidates (a, b) of members (key, n, node, sketch)."""
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / chunk).cast("long"))
    rows = members.select("key", part.alias("part"), "node", "sketch")
    return rows.repartition("key", "part").sortWithinPartitions("key", "part").mapInPandas(_star_batches, "a long, b long").distinct()


def cross_pairs(members: DataFrame, chunk: int) -> DataFrame:
    """Candidates (a, b) of different roots, of members (key, n, band, node, root, bands, sketch, fine)."""
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("node"), chunks.cast("long")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), chunks - 1), lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j")))
    rest = ["band", "node", "root", "bands", "sketch", "fine"]
    rows = members.select("key", F.explode(pair).alias("p"), *rest).select("key", "p.i", "p.j", *rest)
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInPandas(_pair_batches, "a long, b long").distinct()


# ---------------------------------------------------------------- exact similarity
def _set_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for a in range(0, len(pdf), 500):
            part = pdf.iloc[a : a + 500]
            sets = [np.unique(np.array(shingle_hashes(t, WORDS), np.uint64)).view(np.int64) for t in part["text"]]
            yield pd.DataFrame({"node": part["node"].to_numpy(), "shingles": sets})
        release()


def _fine_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for a in range(0, len(pdf), 500):
            part = pdf.iloc[a : a + 500]
            fine = fine_sketches([shingle_hashes(t, WORDS) for t in part["text"]])
            yield pd.DataFrame({"node": part["node"].to_numpy(), "fine": [f.tobytes() for f in fine]})
        release()


def texts_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes, one text for each."""
    need = saved(wanted.select("node").distinct().join(nodes.select("node", "text_key"), "node"), "compared")
    texts = docs.select(text_key().alias("text_key"), "text").join(small(need, need.count()), "text_key")
    return texts.groupBy("node").agg(F.min("text").alias("text"))


def similar(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts have a Jaccard similarity of 0.8 or more."""
    texts = texts_of(docs, nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")))
    sets = saved(texts.mapInPandas(_set_batches, "node long, shingles array<long>"), "shingles")
    one, other = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    rows = pairs.join(one, "a").join(other, "b")
    both, total = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
    rows = rows.filter(5 * F.least(F.size("sa"), F.size("sb")) >= 4 * F.greatest(F.size("sa"), F.size("sb")))
    return saved(rows.filter(9 * both >= 4 * total).select("a", "b"), "similar")  # both / (total - both) >= 4 / 5


def linked(docs: DataFrame, star_chunk: int = STAR_CHUNK, chunk: int = CHUNK) -> DataFrame:
    """Per row of docs: doc_id, text_key, root (equal for texts that a chain of similar texts
    connects). A null text counts as empty; texts without words are alike."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_key().alias("text_key"), "text")
    prints = saved(rows.mapInPandas(_sketch_batches, f"doc_id {kind}, text_key string, node long, bands array<long>, sketch binary"), "sketches")
    nodes = prints.groupBy("node").agg(F.min(F.struct("text_key", "bands", "sketch")).alias("_m"))
    nodes = saved(nodes.select("node", "_m.*"), "nodes")
    keys = nodes.select(F.posexplode("bands").alias("band", "key"), "node")
    # Buckets of the same members, as bands of near copies mostly are, are looked at once, in their first band.
    bucket = keys.groupBy("band", "key").agg(
        F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("x"))
    bucket = saved(bucket.filter("n > 1").groupBy("n", "lo", "hi", "x").agg(F.min(F.struct("band", "key")).alias("b")).select("b.key", "b.band", "n"), "buckets")
    held = saved(keys.join(small(bucket, bucket.count()), ["band", "key"]), "members")
    sketch = nodes.select("node", "sketch")
    pairs = saved(star_pairs(held.join(sketch, "node"), star_chunk), "pairs")
    found = similar(docs, nodes, pairs)
    roots = components(found)
    named = held.filter(F.col("n") > PAIRED).join(roots, "node", "left").select("key", "n", "band", "node", F.coalesce("root", "node").alias("root"))
    open_ = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    open_ = saved(open_, "open")
    if n := open_.count():
        members = saved(named.join(small(open_, n), "key"), "crossed")
        fine = texts_of(docs, nodes, members).mapInPandas(_fine_batches, "node long, fine binary")
        rows = nodes.select("node", "bands", "sketch").join(small(members, members.count()), "node")
        rest = cross_pairs(rows.join(saved(fine, "fine"), "node"), chunk)
        rest = saved(rest.join(pairs, ["a", "b"], "left_anti"), "pairs")
        roots = joined(roots, similar(docs, nodes, rest))
    rooted = prints.select("doc_id", "text_key", "node").join(roots, "node", "left")
    return rooted.select("doc_id", "text_key", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near-duplicates: the one of the least doc_id, of
    these the one of the least hash of its text. A row without a doc_id stays if its group
    has no other."""
    return keep_first(docs, saved(linked(docs), "linked"), "root")
