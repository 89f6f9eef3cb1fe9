"""A blocked Bloom filter: a set of strings in a few bytes for each, with rare false hits."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each string, and for each block, which has eight words of 32 bits.
BITS, BLOCK_BITS, WORDS = 16, 256, 8
_ODD = np.random.default_rng(1).integers(0, 1 << 31, WORDS).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def hash_of(text: str, seed: int) -> int:
    return xxhash.xxh64_intdigest(text, seed)


def _places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash, and one bit of each of its words."""
    block = ((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    low = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return block.astype(np.int64), np.uint32(1) << ((low[:, None] * _ODD) >> np.uint32(27))


class Bloom:
    """blocks x 8 words."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, hashes: Iterable[int]) -> np.ndarray:
        h = np.fromiter(hashes, np.uint64)
        block, bits = _places(h, len(self.words))
        return ((self.words[block] & bits) == bits).all(axis=1)


def made(strings: DataFrame, hashes, count: int) -> Bloom:
    """The filter of a table of one string column; hashes(string): the numbers that a string
    adds, `count` in all. Tasks send the blocks that they fill, which Spark puts together; the
    driver gets BITS bits for each number."""
    blocks = max(1, -(-count * BITS // BLOCK_BITS))
    names = [f"w{i}" for i in range(WORDS)]

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h = np.fromiter((x for s in pdf.iloc[:, 0] if s is not None for x in hashes(s)), np.uint64)
            if not len(h):
                continue
            block, bits = _places(h, blocks)
            order = np.argsort(block, kind="stable")
            block, first = np.unique(block[order], return_index=True)
            words = np.bitwise_or.reduceat(bits[order], first, axis=0).view(np.int32)
            yield pd.DataFrame({"block": block} | {n: words[:, i] for i, n in enumerate(names)})

    rows = strings.mapInPandas(fill, "block long, " + ", ".join(f"{n} int" for n in names))
    full = rows.groupBy("block").agg(*[F.bit_or(n).alias(n) for n in names]).toPandas()
    words = np.zeros((blocks, WORDS), np.uint32)
    words[full["block"].to_numpy(np.int64)] = full[names].to_numpy(np.int32).view(np.uint32)
    return Bloom(words)
