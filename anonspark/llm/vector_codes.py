"""Compression of vectors to codes: a codebook for each part of a vector, in whole numbers.

A component becomes an integer; a vector is cut into equal parts and each part is named by
the nearest entry of its codebook. Distances come from value dictionaries: for every
dimension the distinct integers of a block of rows are numbered, the squared differences of
each of them to all entries are tabulated once, and the distances of the rows' parts are
gathers from these tables, added up over the part's dimensions. A table has as many rows as
the block has distinct integers, so that it is bounded by the block and small where values
repeat. All sums are whole numbers, so neither the order of rows nor their division into
tasks matters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, saved, small

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Largest magnitude of a scaled component: its squares, summed over a vector of up to 2^10
#: dimensions, stay whole numbers of 63 bits.
MOST = 1 << 26
#: Rows whose distances are computed together.
BLOCK = 2048


def kept_rows(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vectors, without the rows whose vector is null or holds a null or non-finite component,
    with `vector` as whole numbers floor(scale * x)."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col(vector).isNotNull() & finite)
    return rows.withColumn(vector, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def dictionary_distances(column: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared differences of each row's value to the entries (rows x entries): the block's
    distinct values are tabulated, the rows gather from the table."""
    values, code = np.unique(column, return_inverse=True)
    return np.take((values[:, None] - entries[None, :]) ** 2, code, axis=0)


def nearest(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row and part the nearest entry, ties to the lower one, and its squared distance.
    block: rows x dimensions; books: parts x entries x dimensions of a part."""
    parts, _, width = books.shape
    code = np.empty((len(block), parts), np.int64)
    least = np.empty((len(block), parts), np.int64)
    for p in range(parts):
        d = dictionary_distances(block[:, p * width], books[p, :, 0])
        for i in range(1, width):
            d += dictionary_distances(block[:, p * width + i], books[p, :, i])
        code[:, p] = d.argmin(axis=1)
        least[:, p] = np.take_along_axis(d, code[:, p, None], axis=1)[:, 0]
    return code, least


def _blocks(column: pd.Series, dims: int) -> Iterator[tuple[int, np.ndarray]]:
    for a in range(0, len(column), BLOCK):
        rows = column.iloc[a : a + BLOCK].to_list()
        if any(len(r) != dims for r in rows):
            raise ValueError(f"vectors of one table have one length, here {dims}")
        block = np.array(rows, np.int64).reshape(len(rows), dims)
        if block.size and max(block.max(), -block.min()) > MOST:
            raise ValueError(f"components beyond {MOST} after scaling")
        yield a, block


def first_books(rows: DataFrame, key: str, vector: str, parts: int, entries: int) -> np.ndarray:
    """The parts of the vectors of the least keys (a null comes last; of rows of one key the
    least vectors), as the books to begin with: at most `entries` vectors, on the driver."""
    first = rows.orderBy(F.col(key).asc_nulls_last(), vector).select(vector).limit(entries).collect()
    if not first:
        return np.zeros((parts, 0, 1), np.int64)
    dims = len(first[0][0])
    if not dims or dims % parts:
        raise ValueError(f"a vector of {dims} components can't be cut into {parts} equal parts")
    block = next(_blocks(pd.Series([r[0] for r in first]), dims))[1]
    return np.ascontiguousarray(block.reshape(len(first), parts, -1).transpose(1, 0, 2))


def updated_books(rows: DataFrame, vector: str, books: np.ndarray) -> np.ndarray:
    """Each entry as the floor of the mean of the parts that are nearest to it; an entry
    without any stays. Tasks send a sum for each used entry, never rows."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((parts, entries, width), np.int64)
        count = np.zeros((parts, entries), np.int64)
        for pdf in batches:
            for _, block in _blocks(pdf.iloc[:, 0], parts * width):
                code, _ = nearest(block, books)
                for p in range(parts):
                    np.add.at(total[p], code[:, p], block[:, p * width : (p + 1) * width])
                    count[p] += np.bincount(code[:, p], minlength=entries)
        p, e = np.nonzero(count)
        yield pd.DataFrame({"part": p, "entry": e, "n": count[p, e], "total": pd.Series(list(total[p, e]), dtype=object)})

    made = rows.select(vector).mapInPandas(sums, "part long, entry long, n long, total array<long>")
    added = made.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)])
    out = books.copy()
    for r in added.collect():  # parts x entries rows at most
        out[r["part"], r["entry"]] = [r[f"t{i}"] // r["n"] for i in range(width)]
    return out


def codebooks(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """parts x entries x width integers, learned from all rows (integer vectors)."""
    books = first_books(rows, key, vector, parts, entries)
    for _ in range(rounds if books.shape[1] else 0):
        books = updated_books(rows, vector, books)
    return books


def encode(rows: DataFrame, books: np.ndarray, vector: str = "embedding", code: str = "code", error: str = "error") -> DataFrame:
    """rows with `code` (array of an entry's number for each part) and `error` (the squared
    distances, summed over the parts)."""
    dims = books.shape[0] * books.shape[2]

    @F.pandas_udf("struct<code: array<int>, error: bigint>")
    def of(column: pd.Series) -> pd.DataFrame:
        codes, errors = [], []
        for _, block in _blocks(column, dims):
            c, d = nearest(block, books)
            codes += list(c.astype(np.int32))
            errors.append(d.sum(axis=1))
        return pd.DataFrame({"code": pd.Series(codes, dtype=object), "error": np.concatenate(errors) if errors else np.zeros(0, np.int64)})

    (both,) = fresh([*rows.columns, code, error], "_coded")
    done = rows.withColumn(both, of(vector))
    return done.withColumns({code: F.col(f"{both}.code"), error: F.col(f"{both}.error")}).drop(both)


def decode(codes: DataFrame, books: np.ndarray, code: str = "code", out: str = "vector", scale: int = SCALE) -> DataFrame:
    """codes with `out`, the vector that the entries of a code make up, in the scale of the
    original components."""
    parts, entries, width = books.shape
    table = F.lit((books / scale).reshape(parts * entries, width).tolist())
    pieces = F.transform(code, lambda c, i: F.element_at(table, i * entries + c.cast("int") + 1))
    return codes.withColumn(out, F.flatten(pieces))


def books_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def compressed(vectors: DataFrame) -> DataFrame:
    """Per kept row of embeddings (vec_id, embedding, label): vec_id, code (two hex digits for
    each part), error, label_error (the errors of all rows of its label; null is a label),
    codebooks_sha256.

    Rows with a null or incomplete vector or a non-finite component go; repeated rows stay and
    count each; ties go to the lower entry; a null vec_id comes last where the first books are
    chosen. Fewer than 64 rows make fewer entries. A vector of another length than the rest, of
    a length that 16 does not divide, or with a component of 2^18 or more is an error. Empty
    in, empty out; extra columns don't matter.
    """
    rows = saved(kept_rows(vectors.select("vec_id", "embedding", "label")), "vectors")
    books = codebooks(rows)
    coded = saved(encode(rows, books).drop("embedding"), "codes")
    per = saved(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"), "labels")
    text = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    joined = coded.join(small(per), F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", text.alias("code"), "error", "label_error", F.sha2(F.lit(books_text(books)), 256).alias("codebooks_sha256"))


def _assign_sql(n: int) -> str:
    """a{n}: per vector and part the nearest entry of b{n} and its distance."""
    return f"""d{n} AS (SELECT v.r, v.p, b.e, sum((v.x - b.x) * (v.x - b.x)) AS d FROM parts v JOIN b{n} b ON b.p = v.p AND b.i = v.i GROUP BY 1, 2, 3),
a{n} AS (SELECT r, p, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM d{n} GROUP BY 1, 2)"""


def _update_sql(n: int) -> str:
    return f"""m{n} AS (SELECT a.p, a.e, v.i, sum(v.x) AS s, count(*) AS c FROM a{n} a JOIN parts v ON v.r = a.r AND v.p = a.p GROUP BY 1, 2, 3),
b{n + 1} AS (SELECT b.p, b.e, b.i, CAST(COALESCE((m.s - ((m.s % m.c) + m.c) % m.c) // m.c, b.x) AS BIGINT) AS x FROM b{n} b LEFT JOIN m{n} m ON m.p = b.p AND m.e = b.e AND m.i = b.i)"""


SQL = f"""WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
cells AS (SELECT r, generate_subscripts(embedding, 1) - 1 AS place, unnest(embedding) AS x, len(embedding) // {PARTS} AS width FROM kept),
parts AS (SELECT r, place // width AS p, place % width AS i, CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT) AS x FROM cells),
b0 AS (SELECT p, r AS e, i, x FROM parts WHERE r < {ENTRIES}),
{_assign_sql(0)}, {_update_sql(0)}, {_assign_sql(1)}, {_update_sql(1)}, {_assign_sql(2)},
coded AS (SELECT k.vec_id, k.label, c.code, c.error FROM kept k
  JOIN (SELECT r, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY r) c USING (r))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) FROM b2) AS codebooks_sha256 FROM coded"""
