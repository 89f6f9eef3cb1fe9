"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most this many narrow rows may be broadcast (about 16 to 64 MB).
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="anonspark-")
        sc.setCheckpointDir(path)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: its lineage is cut, and a
    lost executor costs no recomputation. The files go when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(schema).parquet(path)


def small(df: DataFrame, rows: int | None = None, bound: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `bound` rows, else df itself, which
    then joins by a shuffle. Pass `rows` where the count is known already."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= bound else df


def text_bytes(column: str = "text"):
    """Bytes of a text in UTF-8; a null text has none."""
    return F.coalesce(F.octet_length(F.col(column)), F.lit(0)).cast("long")


def id_hash(column: str = "doc_id"):
    """60 bits of the MD5 of an id written as text; a null id counts as empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def held_out(column: str, modulus: int, remainder: int):
    """Whether crc32 of an id as text leaves the remainder; a null id counts as empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus == remainder


def fresh(columns: Sequence[str], *names: str) -> list[str]:
    """Names for helper columns that none of `columns` has (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def one_text(docs: DataFrame, ids: DataFrame, rows: int) -> DataFrame:
    """ids (doc_id and more; at most `rows` of them, one row each) with text: the least text
    of the documents of that id. Ids without a text go."""
    rest = [c for c in ids.columns if c != "doc_id"]
    found = docs.filter("text IS NOT NULL").select("doc_id", "text").join(small(ids, rows), "doc_id")
    return found.groupBy("doc_id", *rest).agg(F.min("text").alias("text"))


def text_key(column: str = "text"):
    """MD5 of a text, in hex; a null text has an empty key."""
    return F.coalesce(F.md5(F.col(column)), F.lit(""))


def keep_first(docs: DataFrame, rows: DataFrame, group: str) -> DataFrame:
    """docs with one row of each group. rows (doc_id, text_key, group): the rows that are
    grouped; others stay. Of a group the least doc_id stays, of these the least text_key, of
    these the one whose JSON is least, so columns of any type will do; a null doc_id comes last."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    first = rows.groupBy(group).agg(F.min(order).alias("_first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    first = saved(first, "first")  # a stored side lets the join split a large group
    is_first = F.col("doc_id").eqNullSafe(F.col("_first.doc_id")) & (F.col("text_key") == F.col("_first.text_key"))
    ranked = rows.join(small(first, first.count()), group).groupBy("doc_id", "text_key").agg(F.max(is_first).alias("first"), F.count("*").alias("n"))
    ranked = saved(ranked.filter("n > 1 OR NOT first"), "ranked")
    own, id_, key, once = fresh(docs.columns, "_own_key", "_doc_id", "_text_key", "_first")
    ranked = ranked.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), F.col("first").alias(once))
    n = ranked.count()
    if not n:
        return docs
    keyed = docs.withColumn(own, text_key())
    marked = keyed.join(small(ranked, n), F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(key)), "left")
    stay = marked.filter(F.col(once).isNull()).select(*docs.columns)
    again = marked.filter(F.col(once)).groupBy("doc_id", own).agg(F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*docs.columns))).alias(once))
    return stay.unionByName(again.select(f"{once}.*").select(*docs.columns))


def release() -> None:
    """Gives a worker's freed memory back to the system: it lives on and serves other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
