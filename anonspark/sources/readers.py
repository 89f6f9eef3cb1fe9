"""Reading texts, tables and event logs, and writing what is scrubbed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anonspark.operators.gate import event_kind
from anonspark.plans.storage import small

#: Extensions that count as text, and the size limit of a file.
TEXT_EXTENSIONS = "txt md log json csv yaml yml conf config env ini toml xml html htm tsv sql sh bash zsh".split()
MAX_FILE = 5 * 1024 * 1024
EVENTS = "session_id string, hook_event_name string, prompt string, tool_name string, tool_input string, tool_response string, tool_result string, _corrupt string"


def read_text_corpus(spark: SparkSession, path: str, kinds: DataFrame | None = None) -> DataFrame:
    """(name, size, text, error): the files under a path; one that is too large, of another
    kind or binary is a row with an error and no text. A file is text by its extension, or by
    its MIME type where kinds (name, mime) has one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    if kinds is None:
        files = files.withColumn("mime", F.lit(None).cast("string"))
    else:
        files = files.join(small(kinds.groupBy("name").agg(F.min("mime").alias("mime"))), "name", "left")
    name = F.col("name")
    kind = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    text_like = kind.isin(TEXT_EXTENSIONS) | F.coalesce(F.col("mime").startswith("text/") | (F.col("mime") == "application/json"), F.lit(False))
    error = F.when(F.col("length") > MAX_FILE, "file too large").when(~text_like, "unsupported file type")
    error = F.coalesce(error, F.when(F.hex(F.substring("content", 1, 8192)).rlike("^(?:..)*?00"), "binary file"))
    text = F.when(error.isNull(), F.try_validate_utf8(F.col("content").cast("string")))
    rows = files.select(name.alias("name"), F.col("length").alias("size"), text.alias("text"), error.alias("error"))
    return rows.withColumn("error", F.when(F.col("error").isNull() & F.col("text").isNull(), "not UTF-8").otherwise(F.col("error")))


def read_table(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """A table of a header and rows, all cells as text; or Parquet."""
    if kind == "parquet":
        return spark.read.parquet(path)
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def write_scrubbed(df: DataFrame, path: str, kind: str = "csv") -> str:
    """Writes beside the original as <name>.scrubbed.<kind>."""
    base = path.removesuffix("/").removesuffix(f".{kind}")
    target = f"{base}.scrubbed.{kind}"
    if kind == "parquet":
        df.write.mode("overwrite").parquet(target)
    else:
        df.write.mode("overwrite").csv(target, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return target


def _with_kind(rows: DataFrame) -> DataFrame:
    kind = event_kind(F.col("hook_event_name"), F.coalesce("tool_result", "tool_response"), F.col("tool_input"), F.col("prompt"))
    return rows.filter("_corrupt IS NULL").drop("_corrupt").withColumn("kind", kind)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events from JSON lines, with their kind; lines that are no JSON go."""
    return _with_kind(spark.read.schema(EVENTS).option("columnNameOfCorruptRecord", "_corrupt").json(path))


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    return _with_kind(spark.readStream.schema(EVENTS).option("columnNameOfCorruptRecord", "_corrupt").json(path))
