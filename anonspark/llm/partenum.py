"""Jaccard join of shingle sets by PartEnum signatures, and the classes of linked documents.

Two sets are linked if their intersection has at least four fifths of their union. Sizes fall
into bands, each reaching a quarter further than the one before, so linked sets are of one
band or of neighbouring ones and differ in at most a quarter of the smaller one's size: in
k elements. The domain of shingles is partitioned by a hash into n1 parts, of which more than
k / (k2 + 1) leave at least one with k2 differences or fewer; each of these is partitioned
again into n2 parts, and every subset of n2 - k2 of them makes a signature: the hash of what
the set holds there. One of these subsets has no difference, so linked sets share a signature.
Each set has the signatures of its own band's partition and of the band's below. In bands of
small sets k2 is 1 or more, so that a signature still holds some elements; in the others
a subset is one part, which makes the fewest signatures.

Signatures of nothing don't count. A set that has more of them than the partition has parts
to spare gets signatures of another hash as well, the last of which count as they are. What
more than GROUP sets share is a hot signature. A set with fewer hot and empty ones than parts to
spare meets each of its partners under some other signature, so hot signatures only matter for the
sets that have many; these are compared with a few typical ones of them first, so that a
large group of copies costs as many comparisons as it has sets, and then with those that are
still apart, block by block. A sketch of counts, whose differences never exceed those of the
sets, rules pairs out exactly; what is left is decided on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, release, saved, small
from .graph import components

WORDS = 5
#: Similarity of linked sets, as a fraction.
LEAST, OF = 4, 5
#: Up to so many differences, subsets of two parts or more are enumerated.
ENUMERATED = 24
#: Hash functions of partitions that a set can have.
SEEDS = 4
#: Most sets of a signature of which all pairs are looked at.
GROUP = 8
#: Signatures of a bucket, and entries that a task holds before it looks for hot signatures.
BUCKET, HELD = 1 << 17, 1 << 21
#: Members of a hot signature that are compared with typical ones, and turns of this; members of a block.
STAR_CHUNK, TURNS, CHUNK = 65_536, 32, 2048
#: Times that each component is linked with the nearest other, before all that are left are compared.
ROUNDS = 2
#: Pairs with one set that one task compares.
CENTER = 1024
#: Counts of a sketch.
COUNTS = 512
_MIX, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_ENTRY = np.dtype([("sig", "<u4"), ("node", "<i8"), ("mark", "u1")])


# ---------------------------------------------------------------- sets
def mixed(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers."""
    h = (h ^ np.uint64(seed * 0x51_7C_C1B7_2722_0A95 & 0xFFFFFFFFFFFFFFFF)) * _MIX
    h = (h ^ (h >> np.uint64(32))) * _ODD
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the distinct shingles of a text with A-Z in lower case, in order; fewer words:
    of the whole sequence; none: none."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    m = min(words, len(w))
    n = len(w) - m + 1
    out = np.full(n, m, np.uint64)
    for i in range(m):
        out = (out ^ (out >> np.uint64(31))) * _MIX + h[i : i + n]
    return np.unique(mixed(out))


def node_of(s: np.ndarray) -> int:
    """A number for a set of hashes."""
    return int((mixed(s, 1).sum(dtype=np.uint64) * _MIX + np.uint64(len(s))).view(np.int64))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if OF * min(len(a), len(b)) < LEAST * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return (LEAST + OF) * both >= LEAST * (len(a) + len(b))


def sketch(s: np.ndarray) -> np.ndarray:
    """Counts of elements by a hash, at most 255."""
    return np.minimum(np.bincount((s >> np.uint64(40)).astype(np.int64) % COUNTS, minlength=COUNTS), 255).astype(np.uint8)


def apart(sketches: np.ndarray, other: np.ndarray) -> np.ndarray:
    """By how much counts differ, which is no more than the sets do."""
    return np.abs(sketches.astype(np.int16) - other.astype(np.int16)).sum(axis=1, dtype=np.int64)


def may_link(sketches: np.ndarray, sizes: np.ndarray, one: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets that can be linked with one, as their counts differ by no more than linked sets may,
    and by how much."""
    at = np.flatnonzero(OF * np.minimum(sizes, size) >= LEAST * np.maximum(sizes, size))
    by = apart(sketches[at], one)
    fit = (LEAST + OF) * by <= (OF - LEAST) * (sizes[at] + size)
    return at[fit], by[fit]


# ---------------------------------------------------------------- partitions
@cache
def bands(most: int = 1 << 40) -> np.ndarray:
    """Greatest size of each band."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, out[-1] * OF // LEAST))
    return np.array(out)


@cache
def partition(band: int) -> tuple[int, int, int, int]:
    """(n1, n2, k2, spare) of a band: spare first-level parts have k2 differences or fewer."""
    top = int(bands()[band])
    low = int(bands()[band - 1]) + 1 if band else 1
    k = top * (OF - LEAST) // LEAST  # linked sets, the smaller of which has `top` elements, differ in no more
    if k > ENUMERATED:
        n1 = k + 1 + k // 7
        return n1, 1, 0, n1 - k
    if not k:
        return 1, 1, 0, 1
    best = None
    for k2 in range(1, min(k, 3) + 1):
        for n2 in range(k2 + 1, k2 + 5):
            n1 = k // (k2 + 1) + 1
            held = low * (n2 - k2) / (n1 * n2)  # elements of a signature
            choice = (-min(held, 4.0), n1 * comb(n2, k2), n1, n2, k2)
            best = choice if best is None or choice < best else best
    n1, n2, k2 = best[2:]
    return n1, n2, k2, n1 - k // (k2 + 1)


@cache
def _subsets(n2: int, k2: int) -> np.ndarray:
    chosen = list(combinations(range(n2), n2 - k2))
    out = np.zeros((n2, len(chosen)))
    for c, parts in enumerate(chosen):
        out[list(parts), c] = 1
    return out


def signatures(s: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(signatures, mark) of a set for its own band and the band below, for one hash after the
    other as long as too many are empty. The mark holds which of these it is, and how many
    signatures may be hot before one of them must be looked at."""
    own = int(np.searchsorted(bands(), len(s)))
    for lower in (0, 1):
        band = own - lower
        if band < 0 or lower and int(bands()[band]) < LEAST:  # no smaller set of that band is linked with this one
            continue
        n1, n2, k2, spare = partition(band)
        for seed in range(SEEDS):
            h = mixed(s, 2 + seed)
            part = (h % np.uint64(n1 * n2)).astype(np.int64)
            body = mixed(h, 7)
            few = _subsets(n2, k2)
            low, high, count = (np.bincount(part, w, n1 * n2).reshape(n1, n2) @ few for w in ((body & np.uint64(0xFFFFFFFF)).astype(np.float64), (body >> np.uint64(32)).astype(np.float64), None))
            place = np.arange(low.size, dtype=np.uint64) + np.uint64((band * SEEDS + seed) << 32)
            sig = mixed(low.ravel().astype(np.uint64) * _ODD + high.ravel().astype(np.uint64), 11) ^ mixed(place, 13)
            full = count.ravel() > 0
            left = spare - int(low.size - full.sum())
            last = seed + 1 == SEEDS
            yield mixed(sig if last else sig[full], 17), lower << 7 | seed << 5 | min(max(left, 0), 31)
            if left > 0:
                break


# ---------------------------------------------------------------- signatures of a table
def _print_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [(node_of(s), len(s)) for s in map(shingles, pdf["text"])]
        yield pd.DataFrame({"id": pdf["id"], "hash": pdf["hash"], "node": [f[0] for f in found], "n": [f[1] for f in found]})
        release()


def prints(docs: DataFrame) -> DataFrame:
    """(id, hash, node, n) of each row: its id as text, a hash of its text, a number for its set, the set's size."""
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.xxhash64("text").alias("hash"), "text")
    return saved(rows.mapInPandas(_print_batches, "id string, hash long, node long, n long"), "sets")


def entries(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, packed): the signatures of the documents' sets, packed by bucket. A task passes
    over a set that it has had before."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        had: set[int] = set()
        held, size = [], 0
        for pdf in batches:
            for text in pdf["text"]:
                s = shingles(text)
                node = node_of(s)
                if not len(s) or node in had:
                    continue
                had.add(node)
                for sig, mark in signatures(s):
                    held.append((sig, node, mark))
                    size += len(sig)
                if size > 1 << 19:
                    yield _packed(held, buckets)
                    held, size = [], 0
        if held:
            yield _packed(held, buckets)
        release()

    return docs.select("text").mapInPandas(run, "bucket int, packed binary")


def _packed(held: list[tuple[np.ndarray, int, int]], buckets: int) -> pd.DataFrame:
    sizes = np.array([len(s) for s, _, _ in held])
    sig = np.concatenate([s for s, _, _ in held])
    bucket = ((sig >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rows = np.empty(len(sig), _ENTRY)
    rows["sig"] = (sig & np.uint64(0xFFFFFFFF))[order]
    rows["node"] = np.repeat(np.array([n for _, n, _ in held], np.int64), sizes)[order]
    rows["mark"] = np.repeat(np.array([m for _, _, m in held], np.uint8), sizes)[order]
    named, first = np.unique(bucket[order], return_index=True)
    return pd.DataFrame({"bucket": named, "packed": [r.tobytes() for r in np.split(rows, first[1:])]})


class _Bucket:
    """The entries of one bucket. At most GROUP sets of a signature and HELD new entries are held."""

    def __init__(self, number: int):
        self.number, self.parts, self.size, self.hot = number, [], 0, np.zeros(0, np.uint32)

    def add(self, rows: np.ndarray) -> Iterator[tuple]:
        self.parts.append(rows)
        self.size += len(rows)
        if self.size > HELD:
            rows = self._sorted()
            sig, count = np.unique(rows["sig"], return_counts=True)
            self.hot = np.union1d(self.hot, sig[count > GROUP])
            gone = np.isin(rows["sig"], self.hot)
            yield from self._given_out(rows[gone])
            yield from self._counted(rows[gone])
            self.parts, self.size = [rows[~gone]], 0

    def _sorted(self) -> np.ndarray:
        rows = np.concatenate(self.parts)
        rows = rows[np.lexsort((rows["node"], rows["sig"]))]
        return rows[np.concatenate([[True], rows[1:] != rows[:-1]])]

    def _given_out(self, rows: np.ndarray, had: set[int] | None = None) -> Iterator[tuple]:
        """The members of hot signatures; where these are all there, those of equal members once."""
        for part in np.split(rows, np.flatnonzero(np.diff(rows["sig"])) + 1) if len(rows) else ():
            key = int(part["sig"][0]) | self.number << 32
            if had is not None:
                key = int(mixed(part["node"].copy().view(np.uint64), 23).sum(dtype=np.uint64).view(np.int64))
                if key in had:
                    continue
                had.add(key)
            for a in range(0, len(part), 4096):
                yield key, "hot", part["node"][a : a + 4096].copy(), None, None

    def _counted(self, rows: np.ndarray) -> Iterator[tuple]:
        if len(rows):
            own, times = np.unique(rows[["node", "mark"]], return_counts=True)
            for a in range(0, len(own), 4096):
                part = own[a : a + 4096]
                yield 0, "count", part["node"].copy(), part["mark"].astype(np.int16), times[a : a + 4096].astype(np.int32)

    def close(self, had: set[int]) -> Iterator[tuple]:
        rows = self._sorted()
        first = np.flatnonzero(np.concatenate([[True], rows["sig"][1:] != rows["sig"][:-1]])) if len(rows) else np.zeros(0, int)
        sizes = np.diff(np.append(first, len(rows)))
        known = np.isin(rows["sig"][first], self.hot)
        yield from self._given_out(rows[np.repeat(known, sizes)])
        yield from self._given_out(rows[np.repeat((sizes > GROUP) & ~known, sizes)], had)
        yield from self._counted(rows[np.repeat((sizes > GROUP) | known, sizes)])
        few = (sizes > 1) & (sizes <= GROUP) & ~known
        node, sizes = rows["node"][np.repeat(few, sizes)], sizes[few]
        if not len(node):
            return
        first = np.cumsum(sizes) - sizes
        group = np.add.reduceat(mixed(node.view(np.uint64), 19), first).view(np.int64)
        _, some = np.unique(group, return_index=True)
        for g in some.tolist():
            if (number := int(group[g])) not in had:
                had.add(number)
                yield number, "few", node[first[g] : first[g] + sizes[g]], None, None


def _group_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def found() -> Iterator[tuple]:
        now, had = None, set()
        for pdf in batches:
            for bucket, packed in zip(pdf["bucket"], pdf["packed"]):
                if now is None or now.number != bucket:
                    if now is not None:
                        yield from now.close(had)
                    now = _Bucket(int(bucket))
                yield from now.add(np.frombuffer(packed, _ENTRY))
                if len(had) > 1 << 20:
                    had.clear()
        if now is not None:
            yield from now.close(had)

    out, held = [], 0
    frame = lambda rows: pd.DataFrame(rows, columns=["key", "kind", "members", "marks", "times"])
    for row in found():
        out.append(row)
        held += len(row[2]) + 8
        if held > 1 << 18:
            yield frame(out)
            out, held = [], 0
    if out:
        yield frame(out)
    release()


def groups(docs: DataFrame, total: int) -> DataFrame:
    """The sets that share a signature, as (key, kind, members, marks, times): few, each group once for
    each task; the members of a hot one, in parts; and of each set how many hot ones it has in a
    bucket (count)."""
    packed = entries(docs, max(1, -(-total * 5 // (BUCKET * 8))))
    rows = packed.repartition("bucket").sortWithinPartitions("bucket")
    return saved(rows.mapInPandas(_group_batches, "key long, kind string, members array<long>, marks array<short>, times array<int>"), "groups")


def heavy_members(found: DataFrame) -> DataFrame:
    """(key, node) of hot signatures: of the sets that may have no other signature left to be found by."""
    one = found.filter("kind = 'count'").select(F.explode(F.arrays_zip("members", "marks", "times")).alias("m")).select("m.members", F.col("m.marks").cast("int").alias("mark"), "m.times")
    per = one.groupBy(F.col("members").alias("node"), F.shiftright("mark", 5).alias("which")).agg(F.sum("times").alias("n"), F.min(F.col("mark").bitwiseAND(31)).alias("spare"))
    heavy = saved(per.filter("n >= spare").select("node").distinct(), "heavy")
    rows = found.filter("kind = 'hot'").select("key", F.explode("members").alias("node"))
    return rows.join(small(heavy, heavy.count()), "node").select("key", "node").distinct()


def unlike(members: DataFrame) -> DataFrame:
    """members (key, node), of keys with two members or more that are not those of another key, with their number n."""
    per = members.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("x"))
    one = saved(per.filter("n > 1").groupBy("n", "lo", "hi", "x").agg(F.min("key").alias("key")).select("key", "n"), "keys")
    return saved(members.join(small(one, one.count()), "key"), "members")


# ---------------------------------------------------------------- sets of the wanted
def _set_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    had: set[int] = set()
    for pdf in batches:
        out, held = [], 0
        for i, text in enumerate(pdf["text"]):
            s = shingles(text)
            node = node_of(s)
            if node not in had:
                had.add(node)
                out.append((node, len(s), s.tobytes(), sketch(s).tobytes()))
                held += len(s)
            if out and (held > 1 << 19 or i + 1 == len(pdf)):
                yield pd.DataFrame(out, columns=["node", "n", "body", "sketch"])
                out, held = [], 0
        release()


def wanted_sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, n, body, sketch) of the wanted nodes, read again from one row of each."""
    one = rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct(F.col("id").isNull(), "id", "hash")).alias("r"))
    one = saved(one.select(F.col("r.id").alias("_id"), F.col("r.hash").alias("_hash")).distinct(), "wanted")
    texts = docs.select(F.col("doc_id").cast("string").alias("id"), F.xxhash64("text").alias("hash"), "text")
    texts = texts.join(small(one, one.count()), (F.col("hash") == F.col("_hash")) & F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    made = saved(texts.select("text").mapInPandas(_set_batches, "node long, n long, body binary, sketch binary"), "bodies")
    return made


# ---------------------------------------------------------------- pairs
def _runs(batches: Iterable[pd.DataFrame], keys: int) -> Iterator[pd.DataFrame]:
    """The rows that agree in the first `keys` columns, of rows sorted by these."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        new = np.flatnonzero((pdf.iloc[:, :keys].diff() != 0).any(axis=1).to_numpy())
        for a, b in zip(new[:-1].tolist(), new[1:].tolist()):
            yield pdf.iloc[a:b]
        rest = pdf.iloc[new[-1] :]
    if rest is not None:
        yield rest


def _as_rows(found: Iterable[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
    """(a, b, apart) of sets, others and how far they are apart."""
    held, size = [], 0
    frame = lambda parts: pd.DataFrame(np.concatenate(parts), columns=["a", "b", "apart"])
    for one, others, apart in found:
        if others.size:
            held.append(np.stack([np.full(others.size, one), others, apart], axis=1))
            size += others.size
            if size > 200_000:
                yield frame(held)
                held, size = [], 0
    if held:
        yield frame(held)


def _stacked(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)


def _stars(group: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Typical members, each with the members that it may be linked with and none before was."""
    node, n, rows = group["node"].to_numpy(), group["n"].to_numpy(), _stacked(group["sketch"])
    for _ in range(TURNS):
        if len(node) < 2:
            return
        center = int(np.abs(rows - np.median(rows, axis=0)).sum(axis=1).argmin())
        near, by = may_link(rows, n, rows[center], int(n[center]))
        other = near != center
        yield int(node[center]), node[near[other]], by[other]
        left = np.ones(len(node), bool)
        left[near] = left[center] = False
        node, n, rows = node[left], n[left], rows[left]


def _apart(group: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pairs of members of different roots that may be linked."""
    node, n, root, rows = group["node"].to_numpy(), group["n"].to_numpy(), group["root"].to_numpy(), _stacked(group["sketch"])
    for i in range(len(node) - 1):
        other = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
        near, by = may_link(rows[other], n[other], rows[i], int(n[i]))
        yield int(node[i]), node[other[near]], by


def _star_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    yield from _as_rows(p for group in _runs(batches, 2) for p in _stars(group))
    release()


def _apart_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    yield from _as_rows(p for group in _runs(batches, 3) for p in _apart(group))
    release()


def star_pairs(members: DataFrame, sets: DataFrame, chunk: int = STAR_CHUNK) -> DataFrame:
    """(a, b, apart) of members (key, n, node): typical members, and those around them."""
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / chunk).cast("long")).alias("part")
    rows = members.select("key", part, "node").join(sets.select("node", "n", "sketch"), "node").select("key", "part", "node", "n", "sketch")
    return rows.repartition("key", "part").sortWithinPartitions("key", "part", "node").mapInPandas(_star_batches, "a long, b long, apart long")


def apart_pairs(members: DataFrame, sets: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(a, b, apart) of members (key, n, node, root): candidates of different roots, by pairs of blocks."""
    blocks = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks.cast("long")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j")))
    rows = members.select("key", F.explode(pair).alias("p"), "node", "root").select("key", "p.i", "p.j", "node", "root")
    rows = rows.join(sets.select("node", "n", "sketch"), "node").select("key", "i", "j", "node", "root", "n", "sketch")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node").mapInPandas(_apart_batches, "a long, b long, apart long")


def plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, apart): the pairs (a, b) that sketches don't rule out."""
    @F.pandas_udf("long")
    def by(one: pd.Series, other: pd.Series) -> pd.Series:
        parts = [apart(_stacked(one.iloc[a : a + 4096]), _stacked(other.iloc[a : a + 4096])) for a in range(0, len(one), 4096)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0, np.int64))

    rows, count = pairs, sets.count()
    for c in "ab":
        rows = rows.join(small(sets.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")), count, 1 << 16), c)
    rows = rows.filter(OF * F.least("na", "nb") >= LEAST * F.greatest("na", "nb")).withColumn("apart", by("sa", "sb"))
    return rows.filter((LEAST + OF) * F.col("apart") <= (OF - LEAST) * (F.col("na") + F.col("nb"))).select("a", "b", "apart")


def _verify_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, one = None, None
    for pdf in batches:
        found = []
        for a, part, first, b, body in zip(pdf["a"], pdf["part"], pdf["first"], pdf["b"], pdf["body"]):
            s = np.frombuffer(body, np.uint64)
            if first:
                now, one = (a, part), s
            elif now == (a, part) and linked(one, s):
                found.append((a, b))
        yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)
    release()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked. A set meets its partners in parts of bounded size, to
    each of which its elements travel once."""
    many = saved(pairs.groupBy("a").agg(F.count("*").alias("m")).filter(F.col("m") > CENTER), "centers")
    part = F.coalesce(F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / CENTER).cast("long")), F.lit(0)).alias("part")
    pairs = saved(pairs.join(small(many, many.count()), "a", "left").select("a", part, "b"), "pairs")
    bodies = sets.select("node", "body")
    one = pairs.select("a", "part").distinct().join(bodies, F.col("a") == F.col("node")).select("a", "part", F.lit(True).alias("first"), F.col("a").alias("b"), "body")
    other = pairs.join(bodies, F.col("b") == F.col("node")).select("a", "part", F.lit(False).alias("first"), "b", "body")
    rows = one.unionByName(other).repartition("a", "part").sortWithinPartitions("a", "part", F.desc("first"))
    return saved(rows.mapInPandas(_verify_batches, "a long, b long"), "linked")


def links(docs: DataFrame, rows: DataFrame, star_chunk: int = STAR_CHUNK, chunk: int = CHUNK) -> DataFrame:
    """(node, root) of the sets that links connect with another one; the least node is the root."""
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    found = groups(docs.filter("text IS NOT NULL"), total)
    few = found.filter("kind = 'few'").dropDuplicates(["key"]).select(F.array_sort("members").alias("m"))
    each = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, GROUP), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    few = saved(few.select(F.explode(each).alias("p")).select("p.a", "p.b").distinct(), "few")
    heavy = unlike(heavy_members(found))
    wanted = few.select(F.explode(F.array("a", "b")).alias("node")).unionByName(heavy.select("node")).distinct()
    sets = wanted_sets(docs, rows, saved(wanted, "nodes"))

    # Each set is first linked with the typical and the other one that it seems nearest to, then
    # each component with the nearest other; pairs that this leaves apart come after.
    few = saved(plausible(few, sets), "plausible")
    stars = saved(star_pairs(heavy, sets, star_chunk), "stars")
    both = few.unionByName(few.select(F.col("b").alias("a"), F.col("a").alias("b"), "apart"))
    nearest = None
    for some in (both, stars):
        one = some.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("m")).select(F.least("b", "m.a").alias("a"), F.greatest("b", "m.a").alias("b"))
        nearest = one if nearest is None else nearest.unionByName(one)
    tried = saved(nearest.filter("a <> b").distinct(), "first")
    near = verified(tried, sets)
    roots = saved(components(near), "roots")
    count = roots.count()

    def rooted(pairs: DataFrame, node: str, root: str) -> DataFrame:
        named = pairs.join(small(roots.select(F.col("node").alias(node), F.col("root").alias("_r")), count), node, "left")
        return named.withColumn(root, F.coalesce("_r", node)).drop("_r")

    known = saved(few.unionByName(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "apart")).distinct(), "known")
    for _ in range(ROUNDS):
        left = rooted(rooted(known, "a", "ra"), "b", "rb").filter("ra <> rb").join(tried, ["a", "b"], "left_anti")
        ends = left.select(F.explode(F.array("ra", "rb")).alias("r"), F.struct("apart", "a", "b").alias("p"))
        more = saved(ends.groupBy("r").agg(F.min("p").alias("p")).select("p.a", "p.b").distinct(), "more")
        if more.isEmpty():
            break
        tried, near = tried.unionByName(more), near.unionByName(verified(more, sets))
        roots = saved(components(near), "roots")
        count = roots.count()

    rest = rooted(rooted(few.select("a", "b"), "a", "ra"), "b", "rb").filter("ra <> rb").select("a", "b")
    split = rooted(heavy.select("key", "node"), "node", "root")
    open_ = saved(split.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key"), "open")
    split = unlike(split.join(small(open_, open_.count()), "key").select("key", "node"))
    across = apart_pairs(rooted(split, "node", "root"), sets, chunk).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = rest.unionByName(across).distinct().join(tried, ["a", "b"], "left_anti")
    return components(near.unionByName(verified(saved(rest, "rest"), sets)))


def classes(docs: DataFrame, star_chunk: int = STAR_CHUNK, chunk: int = CHUNK) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles (size of its set), component_id (the
    smallest doc_id that links reach).

    Shingles are five words of a text with A-Z in lower case, fewer words are one shingle; a
    null or empty text, or one without words, has none and is linked with nothing. Copies are
    linked; repeated rows repeat. A null doc_id takes part in links and is no component_id
    unless its component has no other. Very long texts count whole. Empty in, empty out; extra
    columns don't matter.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType
    rows = prints(docs)
    full = rows.filter("n > 0")
    roots = links(docs, full, star_chunk, chunk)
    named = full.groupBy("node").agg(F.min(F.col("id").cast(kind)).alias("least"))
    named = saved(named.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "named")
    least = saved(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    (node,) = fresh(["doc_id"], "_node")
    named = saved(named.join(small(least, least.count()), "root").select(F.col("node").alias(node), "component_id"), "components")
    joined = rows.join(small(named, named.count()), (F.col("node") == F.col(node)) & (F.col("n") > 0), "left")
    own = F.col("id").cast(kind)
    return joined.select(own.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(own).alias("component_id"))


SQL = """WITH RECURSIVE w AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS r, doc_id,
  regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
o AS (SELECT r, generate_subscripts(w, 1) AS i, unnest(w) AS word, len(w) AS n FROM w),
l AS (SELECT r, i, n, word AS w0, lead(word, 1) OVER s AS w1, lead(word, 2) OVER s AS w2, lead(word, 3) OVER s AS w3, lead(word, 4) OVER s AS w4 FROM o WINDOW s AS (PARTITION BY r ORDER BY i)),
x AS (SELECT DISTINCT r, concat_ws(' ', w0, w1, w2, w3, w4) AS g FROM l WHERE i <= greatest(1, n - 4)),
n AS (SELECT r, count(*) AS n FROM x GROUP BY r),
c AS (SELECT a.r AS a, b.r AS b, count(*) AS m FROM x a JOIN x b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * m >= 80 * (na.n + nb.n - m)),
z AS (SELECT a AS u, b AS v FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT r AS u, r AS v FROM w UNION SELECT reach.u, z.v FROM reach JOIN z ON z.u = reach.v)
SELECT w.doc_id, COALESCE(any_value(n.n), 0) AS n_shingles, min(d.doc_id) AS component_id
FROM w JOIN reach ON reach.u = w.r JOIN w d ON d.r = reach.v LEFT JOIN n ON n.r = w.r GROUP BY w.r, w.doc_id"""
