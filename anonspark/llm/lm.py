"""Scoring documents by a smoothed trigram model in Elias-Fano tries.

Neither the vocabulary nor the n-grams have a size bound, so no task and no broadcast holds
the model. Documents are encoded in blocks of a million tokens or two, and n-grams belong to
shards by a hash, so that shards are even whatever is frequent. Two exchanges lie between the
blocks and the shards:

1. A block sends each shard its distinct words and pairs there with their counts in the
   training documents, and is told the totals. From these it knows the smoothed probability
   of every pair in it.
2. Of triples whose two pairs both occur in other blocks as well, a block sends the counts,
   and the probability of the pair. The shard sums them, builds its trie of smoothed, quantised
   probabilities, looks the triples up in it and answers. A triple with a pair of one block
   alone, as most are, is in no other block either, and is part of that block's own trie.

What moves are distinct n-grams of blocks, not tokens; all memory is bounded by the block and
the shard, and the driver learns two numbers: the training tokens and their distinct words.

p(w | u v) = (c(u v w) + G p(w | v)) / (c(u v) + G), p(w | v) = (c(v w) + G p(w)) / (c(v) + G),
p(w) = (c(w) + 1) / (N + V + 1). Before a document stand two end tokens.
"""

from __future__ import annotations

import gc
import math
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, release, saved, text_bytes
from .eliasfano import Trie, quantise, restore

#: Weight of the next lower order in each context, in tokens.
PRIOR = 4.0
#: Tokens of a block, and bytes of text per shard: they bound a task's memory.
BLOCK_TOKENS = 750_000
SHARD_TEXT = 12 << 20
_SLICE = 500
#: Bits of the words' hashes from which pairs are told apart: the shard by all of them, and in
#: a shard each word by 24, as the words before a pair; in a block by 32. A successor in a shard
#: shares the count of one of a thousand others of its context in six of 100,000 cases. Words by
#: themselves have 64.
_WORD_BITS = 48
_U = np.uint64
_RANK = 0x7FFFFFFF
_LOW = _U(0xFFFFFF)
_NARROW = _U(24)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


# ---------------------------------------------------------------- packing
def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of integers, sorted ones best; bytes of the same weight lie together."""
    head, body = [len(arrays)], []
    for a in arrays:
        kind = np.uint64 if a.size and int(a.max()) >> 32 else np.uint32 if a.size and int(a.max()) >> 16 else np.uint16
        a = np.ascontiguousarray(a, kind)
        head += [a.size, a.itemsize]
        body.append(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(np.array(head, np.int64).tobytes() + b"".join(body))


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(-1, 2).tolist()
    at, out = 8 + 16 * n, []
    for size, width in head:
        part = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size).T
        out.append(np.ascontiguousarray(part).view({2: np.uint16, 4: np.uint32, 8: _U}[width]).ravel())
        at += size * width
    return out


def _deltas(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=sorted_values.dtype.type(0))


# ---------------------------------------------------------------- blocks
def pair_parts(hashes: np.ndarray, keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, v << 24 | w in hashes) of pairs of words, given as v << 31 | w in ranks."""
    v, w = hashes[keys >> 31], hashes[keys & _RANK]
    x = (v * _U(0x9E3779B97F4A7C15)) ^ (w * _U(0xC2B2AE3D27D4EB4F) + _U(0x165667B19E3779F9))
    x = (x ^ (x >> _U(31))) * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    part = (x * _U(0xA0761D6478BD642F)) >> _U(64 - bits) if bits else np.zeros(len(x), _U)
    return part.astype(np.int64), ((v & _LOW) << _NARROW) | (w & _LOW)


class Block:
    """The tokens of some documents as ranks of their distinct words, and what follows from them."""

    def __init__(self, sequence: np.ndarray, sizes: np.ndarray, held: np.ndarray, hashes: np.ndarray, end: int, bits: int):
        self.sequence, self.sizes, self.held, self.hashes, self.end = sequence.astype(np.int64), sizes.astype(np.int64), held.astype(bool), hashes, end
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.train = np.repeat(~self.held, self.sizes)
        before = self.back(self.sequence)
        pairs = (before << 31) | self.sequence
        self.pairs, self.pair = np.unique(pairs, return_inverse=True)
        self.seen = np.bincount(self.pair, self.train, len(self.pairs)).astype(np.int64)
        self.part, self.key = pair_parts(hashes, self.pairs, bits)
        self.order = np.lexsort((self.key, self.part))

    def back(self, values: np.ndarray) -> np.ndarray:
        """The value of the token before; the end token's rank for the first of a document."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.starts] = self.end
        return out

    def state(self) -> bytes:
        return _pack(self.sequence, self.sizes, self.held.astype(np.int64), _deltas(self.hashes), np.array([self.end]))

    @classmethod
    def of(cls, data: bytes, bits: int) -> Block:
        sequence, sizes, held, deltas, end = _unpack(data)
        return cls(sequence, sizes, held, np.cumsum(deltas.astype(_U), dtype=_U), int(end[0]), bits)

    def check(self) -> int:
        """Of the block's pairs: an answer must meet the block that asked."""
        return xxhash.xxh32_intdigest(self.pairs.tobytes())

    def counted(self, told: list[tuple[int, bytes]], n: int, types: int) -> None:
        """Takes the shards' totals (part, data), in any order."""
        words, pairs = zip(*(self._checked(d) for _, d in sorted(told)))
        self.count = np.concatenate(words).astype(np.int64)
        marked = np.empty(len(self.pairs), np.int64)
        marked[self.order] = np.concatenate(pairs)
        self.total, self.elsewhere = marked >> 1, (marked & 1).astype(bool)
        self.base = (self.count + 1) / (n + types + 1)
        self.p2 = (self.total + PRIOR * self.base[self.pairs & _RANK]) / (self.count[self.pairs >> 31] + PRIOR)
        # triples: the place of their pair and the rank of the word before it
        older = self.back(self.back(self.sequence))
        older[self.starts] = self.end
        self.triples, first, self.triple = np.unique((self.pair << 31) | older, return_index=True, return_inverse=True)
        self.seen3 = np.bincount(self.triple, self.train, len(self.triples)).astype(np.int64)
        self.parent = self.triples >> 31
        opens = np.isin(first, self.starts)
        self.context = np.where(opens, self.count[self.end], self.total[self.pair[np.maximum(first - 1, 0)]])
        self.older = (self.hashes[self.triples & _RANK] & _LOW).astype(_U)
        known = self.total > 0
        met = known & self.elsewhere
        self.shared = met[self.parent] & (opens | met[self.pair[np.maximum(first - 1, 0)]])
        self.own = known[self.parent] & ~self.shared

    def _checked(self, data: bytes) -> list[np.ndarray]:
        *out, check = _unpack(data)
        if int(check[0]) != self.check():
            raise RuntimeError("an answer meets another block of documents; read docs from storage")
        return out

    def under(self, triples: np.ndarray, order: np.ndarray, older: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pairs, triples, the place among those pairs of each) of the chosen triples: their pairs
        in the given order of all pairs, those of a pair by the word before."""
        which = np.zeros(len(self.pairs), bool)
        which[self.parent[triples]] = True
        pairs = order[which[order]]
        place = np.empty(len(self.pairs), np.int64)
        place[pairs] = np.arange(len(pairs))
        at = np.flatnonzero(triples)
        at = at[np.lexsort((older[at], place[self.parent[at]]))]
        return pairs, at, place[self.parent[at]]

    def own_trie(self) -> tuple[Trie, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The trie of the triples that no other block has, and what to look up in it: the keys
        of their pairs, the words before; the triples, and the place among those keys of each."""
        low = self.hashes & _U(0xFFFFFFFF)
        keys = (low[self.pairs >> 31] << _U(32)) | low[self.pairs & _RANK]
        older = low[self.triples & _RANK]
        pairs, asked, place = self.under(self.own, np.argsort(keys, kind="stable"), older)
        known = self.seen3[asked] > 0
        p3 = (self.seen3[asked] + PRIOR * self.p2[self.parent[asked]]) / (self.context[asked] + PRIOR)
        trie = Trie.of(32, keys[pairs], quantise(self.p2[pairs]), place[known], older[asked[known]], quantise(p3[known]))
        return trie, keys[pairs], older[asked], asked, place


_ENCODED = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("ids", pa.list_(pa.string())), ("data", pa.binary())])


def _encoder(bits: int):
    def emit(number: int, ids: list, held: list[bool], sizes: list[int], local: list[np.ndarray], words: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), _U, len(words))
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        hashes = hashes[order]
        block = Block(rank[np.concatenate(local)], np.array(sizes), np.array(held), hashes >> _U(64 - _WORD_BITS), int(rank[0]), bits)
        counts = np.bincount(block.sequence[block.train], minlength=len(hashes))
        check = np.array([block.check()])
        word_cuts = np.searchsorted(hashes >> _U(64 - bits) if bits else np.zeros(len(hashes), _U), np.arange((1 << bits) + 1, dtype=_U))
        cuts = np.searchsorted(block.part[block.order], np.arange((1 << bits) + 1))
        rows = [(number, -1 - number, ids, block.state())]
        for part in range(1 << bits):
            lo, hi, a, b = int(word_cuts[part]), int(word_cuts[part + 1]), int(cuts[part]), int(cuts[part + 1])
            if hi > lo or b > a:
                own = block.order[a:b]
                rows.append((number, part, None, _pack(_deltas(hashes[lo:hi]), counts[lo:hi], _deltas(block.key[own]), block.seen[own], check)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ENCODED)], schema=_ENCODED)
        release()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial = TaskContext.get().partitionId() << 24, 0
        ids, held, sizes, local, words, n = [], [], [], [], {b"\n": 0}, 0  # no word has a newline: the end token
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                for key, out, text in zip(*(c.to_pylist() for c in batch.slice(at, _SLICE).columns)):
                    w = tokens(text)
                    w.append(b"\n")
                    local.append(np.fromiter((words.setdefault(x, len(words)) for x in w), np.int32, len(w)))
                    ids.append(key)
                    held.append(bool(out))
                    sizes.append(len(w))
                    n += len(w)
                    if n >= BLOCK_TOKENS:
                        yield from emit(task + serial, ids, held, sizes, local, words)
                        ids, held, sizes, local, words, n, serial = [], [], [], [], {b"\n": 0}, 0, serial + 1
        if ids:
            yield from emit(task + serial, ids, held, sizes, local, words)
    return run


def shard_bits(docs: DataFrame, shard_text: int = SHARD_TEXT) -> int:
    """The number of shards is 2 to this power: the least at which each has at most shard_text
    bytes of text on average."""
    total = docs.agg(F.coalesce(F.sum(text_bytes()), F.lit(0)).alias("b")).first()["b"]
    return max(0, math.ceil(math.log2(max(1.0, total / shard_text))))


def encode(docs: DataFrame, bits: int) -> DataFrame:
    """Blocks of documents: (block, part, ids, data). A part from 0 on is a shard, and data
    what the block sends to it; a negative part is one of its own, with the block's tokens.
    Blocks follow the order of the rows in a task, so docs should come from storage."""
    rows = docs.select(F.col("doc_id").cast("string"), held_out("doc_id", 7, 2), "text")
    return rows.mapInArrow(_encoder(bits), "block long, part long, ids array<string>, data binary")


# ---------------------------------------------------------------- the shards: counts
def totals(keys: list[np.ndarray], counts: list[np.ndarray], marked: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
    """For each list of distinct keys the totals of their counts over all lists, and those of
    all distinct keys. marked: twice the total, and one more if the key is in several lists."""
    every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, np.concatenate(counts), len(every)).astype(np.int64)
    if marked:
        total = 2 * total + (np.bincount(inverse, minlength=len(every)) > 1)
    return np.split(total[inverse], np.cumsum([len(k) for k in keys])[:-1]), total


_COUNTED = "block long, part long, n long, types long, ids array<string>, data binary"


def _count(pdf: pd.DataFrame) -> pd.DataFrame:
    part, columns = int(pdf["part"].iloc[0]), ["block", "part", "n", "types", "ids", "data"]
    if part < 0:  # a block's documents wait with the answers
        return pd.DataFrame([(pdf["block"].iloc[0], -1, 0, 0, pdf["ids"].iloc[0], pdf["data"].iloc[0])], columns=columns)
    words, counts, pairs, seen, checks = zip(*map(_unpack, pdf["data"]))
    whole = lambda deltas: [np.cumsum(d.astype(_U), dtype=_U) for d in deltas]
    told, each = totals(whole(words), counts)
    told2, _ = totals(whole(pairs), seen, marked=True)
    n, types = int(each.sum()), int((each > 0).sum())
    out = [(block, part, n, types, None, _pack(a, b, c)) for block, a, b, c in zip(pdf["block"], told, told2, checks)]
    release()
    return pd.DataFrame(out, columns=columns)


def counted(encoded: DataFrame) -> DataFrame:
    """The blocks' documents (part -1) and the totals that the shards tell each block, in the
    shared folder: (block, part, n, types, ids, data)."""
    return _stored(encoded.groupBy("part").applyInPandas(_count, _COUNTED), "counted")


def _stored(df: DataFrame, name: str) -> DataFrame:
    """saved(df). The shuffle files behind it are of no more use; Spark removes them once the
    driver has collected its garbage, first Python's and then the JVM's, so it is asked to."""
    out = saved(df, name)
    for _ in range(2):  # what Python lets go of is the JVM's garbage only a moment later
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.3)
    return out


# ---------------------------------------------------------------- the shards: probabilities
def _met(pdf: pd.DataFrame, n: int, types: int, bits: int) -> Block:
    """A block from its documents and the totals."""
    block = Block.of(pdf.loc[pdf["part"] == -1, "data"].iloc[0], bits)
    block.counted([(p, d) for p, d, a in zip(pdf["part"], pdf["data"], pdf["answer"]) if p >= 0 and not a], n, types)
    return block


def _ask(n: int, types: int, bits: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block = _met(pdf, n, types, bits)
        pairs, triples, parents = block.under(block.shared, block.order, block.older)
        number, check, rows = int(pdf["block"].iloc[0]), np.array([block.check()]), []
        cuts = np.searchsorted(block.part[pairs], np.arange((1 << bits) + 1))
        cuts3 = np.searchsorted(parents, cuts)
        for part in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            p, t = pairs[cuts[part] : cuts[part + 1]], triples[cuts3[part] : cuts3[part + 1]]
            per = np.bincount(parents[cuts3[part] : cuts3[part + 1]] - cuts[part], minlength=len(p))
            rows.append((number, part, _pack(_deltas(block.key[p]), quantise(block.p2[p]), per, block.older[t], block.seen3[t], block.context[t], check)))
        release()
        return pd.DataFrame(rows, columns=["block", "part", "data"])
    return run


def build(messages: list[list[np.ndarray]]) -> tuple[Trie, np.ndarray, np.ndarray, np.ndarray]:
    """The trie of one shard from all blocks' messages; its distinct pairs and triples (place of
    the pair << 32 | hash of the word before), and for each triple sent its place among these."""
    keys = [np.cumsum(m[0].astype(_U), dtype=_U) for m in messages]
    pairs, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    codes = np.concatenate([m[1] for m in messages])[first]
    parent = np.repeat(inverse, np.concatenate([m[2] for m in messages]).astype(np.int64))
    sent = (parent.astype(_U) << _U(32)) | np.concatenate([m[3] for m in messages]).astype(_U)
    triples, first, place = np.unique(sent, return_index=True, return_inverse=True)
    seen = np.bincount(place, np.concatenate([m[4] for m in messages]), len(triples))
    context = np.concatenate([m[5] for m in messages])[first].astype(float)
    known = seen > 0
    above = (triples >> _U(32)).astype(np.int64)
    p3 = (seen + PRIOR * restore(codes[above])) / (context + PRIOR)
    return Trie.of(24, pairs, codes, above[known], triples[known] & _U(0xFFFFFFFF), quantise(p3[known])), pairs, triples, place


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    messages = [_unpack(d) for d in pdf["data"]]
    trie, pairs, triples, place = build(messages)
    trie = Trie.mapped(trie.pack())
    at = trie.find_pairs(pairs)
    codes = np.split(trie.find(at[(triples >> _U(32)).astype(np.int64)], triples & _U(0xFFFFFFFF))[place], np.cumsum([len(m[3]) for m in messages])[:-1])
    out = pd.DataFrame({"block": pdf["block"], "part": pdf["part"], "data": [_pack(c, m[6]) for c, m in zip(codes, messages)]})
    del messages, trie
    release()
    return out


def answers(told: DataFrame, n: int, types: int, bits: int) -> DataFrame:
    """What the shards' tries tell each block about its triples, in the shared folder: (block, part, data)."""
    return _stored(asked(told, n, types, bits).groupBy("part").applyInPandas(_answer, "block long, part long, data binary"), "answers")


def asked(told: DataFrame, n: int, types: int, bits: int) -> DataFrame:
    rows = told.select("block", "part", "data", F.lit(False).alias("answer"))
    return rows.groupBy("block").applyInPandas(_ask(n, types, bits), "block long, part long, data binary")


def tries(told: DataFrame, n: int, types: int, bits: int) -> DataFrame:
    """The model itself: (shard, block, trie binary), to be kept or mapped elsewhere. The tries of
    the shards have no block, those of the blocks' own pairs no shard."""
    def of_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [pdf["part"].iloc[0]], "trie": [build([_unpack(d) for d in pdf["data"]])[0].pack()]})

    def of_block(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "trie": [_met(pdf, n, types, bits).own_trie()[0].pack()]})

    shards = asked(told, n, types, bits).groupBy("part").applyInPandas(of_shard, "shard long, trie binary")
    rows = told.select("block", "part", "data", F.lit(False).alias("answer"))
    return shards.unionByName(rows.groupBy("block").applyInPandas(of_block, "block long, trie binary"), allowMissingColumns=True)


# ---------------------------------------------------------------- scores
def _scorer(n: int, types: int, bits: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block = _met(pdf, n, types, bits)
        codes = np.zeros(len(block.triples), np.uint16)
        told = [block._checked(d)[0] for p, d in sorted(zip(pdf["part"][pdf["answer"]], pdf["data"][pdf["answer"]]))]
        if told:
            codes[block.under(block.shared, block.order, block.older)[1]] = np.concatenate(told)
        trie, keys, older, own, place = block.own_trie()
        trie = Trie.mapped(trie.pack())
        codes[own] = trie.find(trie.find_pairs(keys)[place], older)
        less = PRIOR / (block.context + PRIOR) * block.p2[block.parent]  # of a triple that training has not
        p = np.where(codes > 0, restore(codes), np.minimum(less, 1.0))
        ids = pdf.loc[pdf["part"] == -1, "ids"].iloc[0]
        out = pd.DataFrame({
            "doc_id": list(ids), "held_out": block.held, "n_tokens": block.sizes,
            "n_known": np.add.reduceat((block.count > 0)[block.sequence].astype(np.int64), block.starts),
            "base_score": np.add.reduceat(np.log10(block.base)[block.sequence], block.starts),
            "score": np.add.reduceat(np.log10(p)[block.triple], block.starts),
        })
        del block, trie
        release()
        return out
    return run


def score(docs: DataFrame, shard_text: int = SHARD_TEXT) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model is learned from the rows whose crc32 of doc_id mod 7 is not 2 (a null doc_id
    counts as empty text and is trained on) and scores all rows. A null text counts as empty:
    its only token is the end. A very long text is in one block. Repeated rows are trained on
    and returned as often as they occur. Without training rows every token has the
    probability 1. Empty in, empty out; extra columns, of whatever name, don't matter.
    """
    bits = shard_bits(docs, shard_text)
    told = counted(encode(docs, bits))
    row = told.filter("part >= 0").groupBy("part").agg(F.max("n").alias("n"), F.max("types").alias("t")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    n, types = row["n"], row["t"]
    rows = told.select("block", "part", "ids", "data", F.lit(False).alias("answer"))
    more = answers(told, n, types, bits).select("block", "part", F.lit(None).cast("array<string>").alias("ids"), "data", F.lit(True).alias("answer"))
    scored = rows.unionByName(more).groupBy("block").applyInPandas(
        _scorer(n, types, bits), "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
