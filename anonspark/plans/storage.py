"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A table of at most so many rows and bytes may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def shared_dir(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="anonspark-")
        spark.sparkContext.setCheckpointDir(path)
    return path


_scratch: list[list] = []


@contextmanager
def scratch() -> Iterator[None]:
    """What saved() writes inside goes at the end, and not only with the session."""
    _scratch.append([])
    try:
        yield
    finally:
        for fs, path in _scratch.pop():
            fs.delete(path, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read back, so that its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if _scratch:
        _scratch[-1].append((fs, target))
    else:
        fs.deleteOnExit(target)
    return spark.read.schema(schema).parquet(path)


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


#: A scan of less than so many bytes for each of twice the cores is dealt out anew.
SPREAD_BYTES = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores. A scan that Spark's statistics call small may lie in one row group of one
    file, and so in one task; its rows are dealt out anew. A larger one, and whatever has no such
    statistics, stays as it is."""
    parts = 2 * df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(parts) if size < parts * SPREAD_BYTES else df


def _bytes_of(df: DataFrame) -> Column:
    """About how many bytes a row takes: its strings and binaries, the elements of its arrays."""
    def of(c: Column, t: T.DataType) -> Column:
        if isinstance(t, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
        if isinstance(t, T.ArrayType):
            return F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + of(x, t.elementType)), F.lit(0).cast("long"))
        if isinstance(t, T.MapType):
            return of(F.map_keys(c), T.ArrayType(t.keyType)) + of(F.map_values(c), T.ArrayType(t.valueType))
        if isinstance(t, T.StructType):
            return sum((of(c[f.name], f.dataType) for f in t.fields), F.lit(8).cast("long"))
        return F.lit(8).cast("long")

    return sum((of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(8).cast("long"))


def small(df: DataFrame, bound: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows and their bytes, both counted, allow that."""
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(_bytes_of(df)), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if row["n"] <= bound and row["b"] <= most_bytes else df
