"""Mixing sources to target weights by temperature, with DataFrame operations only.

The token share of each source is raised to an exponent between 0 and 1, found by
bisection: the largest one at which the mixture reaches the target entropy, but not so
small that any source would be repeated more often than the limit. The budget is the
least that reads every source in full, so nothing is dropped. It is realised in blocks of
documents: each epoch of a source is a permutation of its blocks, and the last epoch is
cut after the blocks that fit the source's budget.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, id_hash, saved

#: Share of the largest possible entropy that the mixture should reach: nearly even sources,
#: as far as the limit on repeats allows.
TARGET_ENTROPY = 0.9999
MAX_REPEATS = 4.0
BLOCK_TOKENS = 16384
SEED = "mix"
#: Bisection halves the interval of exponents so often, several steps in each query.
STEPS, AT_ONCE = 30, 5
#: Groups of blocks of one source between the two running sums.
_GROUPS_HEX = 3


def token_count(column: str = "text"):
    """Words of a text, runs of anything but white space; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_tokens(docs: DataFrame, source: str = "source") -> DataFrame:
    """(source, tokens, docs) of every source, in the shared folder; a null source is one of its own."""
    return saved(docs.groupBy(F.col(source).alias("source")).agg(F.sum(token_count()).alias("tokens"), F.count("*").alias("docs")), "sources")


def exponent(totals: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS) -> float:
    """The exponent of the shares: the largest at which the entropy of the mixture is at
    least target_entropy of ln(sources), raised as far as needed to repeat no source more
    than max_repeats times. Five steps of the bisection are one query over the sources."""
    used = totals.filter("tokens > 0")
    row = used.agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.max("tokens").alias("most"), F.min("tokens").alias("least")).first()
    if row["n"] < 2:
        return 1.0
    goal = target_entropy * math.log(row["n"])
    # the rarest source is repeated (most / least) ** (1 - a) times
    floor = 0.0 if row["most"] == row["least"] else max(0.0, 1 - math.log(max_repeats) / math.log(row["most"] / row["least"]))
    lo, hi, parts = 0.0, 1.0, 1 << AT_ONCE
    for _ in range(STEPS // AT_ONCE):
        tries = [lo + (hi - lo) * i / parts for i in range(1, parts)]
        power = F.pow(F.col("tokens") / F.lit(float(row["t"])), F.col("a"))
        at = used.select(F.explode(F.array(*map(F.lit, tries))).alias("a"), "tokens").groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.ln(power)).alias("zl"))
        enough = at.filter(F.ln("z") - F.col("zl") / F.col("z") >= goal).agg(F.count("*").alias("n")).first()["n"]  # entropy falls as a grows
        lo, hi = ([lo, *tries, hi][enough], [lo, *tries, hi][enough + 1])
    full = used.agg(F.sum(-(F.col("tokens") / row["t"]) * F.ln(F.col("tokens") / row["t"])).alias("e")).first()["e"]
    return 1.0 if full >= goal else min(1.0, max(floor, lo))


def weights(totals: DataFrame, a: float) -> DataFrame:
    """totals with weight, repeats (how often the budget reads the source) and n_blocks."""
    row = totals.filter("tokens > 0").agg(F.max("tokens").alias("most"), F.sum(F.pow(F.col("tokens").cast("double"), F.lit(a))).alias("z")).first()
    most, z = float(row["most"] or 1), float(row["z"] or 1)
    has = F.col("tokens") > 0
    return totals.select(
        "source", "tokens", "docs",
        F.when(has, F.pow(F.col("tokens").cast("double"), F.lit(a)) / z).otherwise(0.0).alias("weight"),
        F.when(has, F.pow(F.lit(most) / F.col("tokens"), F.lit(1 - a))).otherwise(1.0).alias("repeats"),
        F.greatest(F.lit(1), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("long").alias("n_blocks"),
    )


def plan_blocks(docs: DataFrame, source: str = "source", target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS) -> tuple[DataFrame, DataFrame]:
    """(mix, blocks): the weighted sources, and one row per block and epoch that is read:
    source, block, epoch, position. position orders the whole mixture: at any point of it
    the sources have been read in proportion to their weights."""
    totals = source_tokens(docs, source)
    mix = saved(weights(totals, exponent(totals, target_entropy, max_repeats)), "mix")
    keyed = docs.select(F.col(source).alias("source"), id_hash().alias("h"), token_count().alias("t"))
    sized = keyed.join(mix.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    blocks = sized.groupBy("source", (F.col("h") % F.col("n_blocks")).alias("block")).agg(F.sum("t").alias("t"))
    blocks = blocks.join(mix.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # a repeat within a millionth of a whole number is that number
    repeats = F.when(F.abs(F.col("repeats") - F.round("repeats")) < 1e-6, F.round("repeats")).otherwise(F.col("repeats"))
    blocks = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(repeats))))
    rank = F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce("source", F.lit("")), F.col("epoch").cast("string"), F.col("block").cast("string")))
    blocks = blocks.withColumn("rank", rank).withColumn("part", F.substring("rank", 1, _GROUPS_HEX))
    own = ["source", "epoch", "part"]
    sums = blocks.groupBy(*own).agg(F.sum("t").alias("pt"))
    across = Window.partitionBy("source", "epoch").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias("_" + c) for c in own], F.coalesce(F.sum("pt").over(across), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*own).orderBy("rank", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("inner", F.coalesce(F.sum("t").over(inside), F.lit(0)))
    blocks = blocks.join(sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("epoch") == F.col("_epoch")) & (F.col("part") == F.col("_part")))
    start = F.col("inner") + F.col("before")
    rest = (repeats - (F.col("epoch") - 1)) * F.col("tokens")
    fits = (F.col("epoch") <= F.floor(repeats)) | (start + F.col("t") / 2 <= rest)
    position = F.round((F.col("epoch") - 1 + F.when(F.col("tokens") > 0, start / F.col("tokens")).otherwise(0.0)) / repeats, 9)
    blocks = blocks.filter(fits).select("source", "block", "epoch", position.alias("position"))
    return mix, blocks


def mixed(docs: DataFrame, source: str = "source", target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, marks: bool = True) -> DataFrame:
    """docs with each row as often as the mixture reads it. With marks: also epoch, block and position.

    Every row is read at least once. A null source is a source of its own; a source without
    a word (null and empty texts only) is read once, with weight 0. Rows that repeat a
    doc_id share a block, so they are read equally often, and a block may exceed
    BLOCK_TOKENS by them; the budget of a source is met to within one block. Empty in,
    empty out.
    """
    mix, blocks = plan_blocks(docs, source, target_entropy, max_repeats)
    blocks = saved(blocks, "blocks")
    s, n, b = fresh(docs.columns, "_s", "_n", "_b")
    rows = docs.join(mix.select(F.col("source").alias(s), F.col("n_blocks").alias(n)), F.col(source).eqNullSafe(F.col(s))).drop(s)
    rows = rows.withColumn(b, id_hash() % F.col(n)).drop(n)
    s, block, epoch, position = fresh(rows.columns, "_s", "block", "epoch", "position")
    named = blocks.withColumnsRenamed({"source": s, "block": block, "epoch": epoch, "position": position})
    taken = rows.join(named, F.col(source).eqNullSafe(F.col(s)) & (F.col(b) == F.col(block))).drop(s, b)
    return taken if marks else taken.select(*docs.columns)


def mixture(docs: DataFrame) -> DataFrame:
    """Per read of a document: doc_id, source, epoch, block, position."""
    return mixed(docs.select("doc_id", "source", "text")).select("doc_id", "source", F.col("epoch").cast("long").alias("epoch"), F.col("block").cast("long").alias("block"), "position")


SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+')) AS t,
         ('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, SUM(t)::BIGINT AS tokens FROM d GROUP BY source),
used AS (SELECT list(tokens::DOUBLE / (SELECT SUM(tokens) FROM s)) AS p, MAX(tokens) AS most, MIN(tokens) AS least,
         {TARGET_ENTROPY} * ln(COUNT(*)) AS goal FROM s WHERE tokens > 0),
bis AS (
  SELECT 0 AS k, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT k + 1, CASE WHEN e >= goal THEN mid ELSE lo END, CASE WHEN e >= goal THEN hi ELSE mid END FROM (
    SELECT k, lo, hi, mid, goal, ln(list_sum(q)) - list_sum(list_transform(q, lambda x: x * ln(x))) / list_sum(q) AS e FROM (
      SELECT k, lo, hi, (lo + hi) / 2 AS mid, goal, list_transform(p, lambda x: pow(x, (lo + hi) / 2)) AS q
      FROM bis, used WHERE k < {STEPS}))),
a AS (
  SELECT CASE WHEN len(p) < 2 OR list_sum(list_transform(p, lambda x: -x * ln(x))) >= goal THEN 1.0
    ELSE least(1.0, greatest((SELECT lo FROM bis WHERE k = {STEPS}),
      CASE WHEN most = least THEN 0.0 ELSE greatest(0.0, 1 - ln({MAX_REPEATS}) / ln(most / least)) END)) END AS a, most FROM used),
m AS (
  SELECT source, tokens, CASE WHEN abs(r - round(r)) < 1e-6 THEN round(r) ELSE r END AS r,
         greatest(1, ceil(tokens / {BLOCK_TOKENS}))::BIGINT AS n
  FROM (SELECT source, tokens, CASE WHEN tokens > 0 THEN pow(most / tokens, 1 - a) ELSE 1.0 END AS r FROM s, a)),
b AS (
  SELECT d.source, h % n AS block, SUM(t) AS t, any_value(tokens) AS tokens, any_value(r) AS r
  FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source GROUP BY 1, 2),
e AS (SELECT *, unnest(generate_series(1, ceil(r)::BIGINT)) AS epoch FROM b),
o AS (
  SELECT *, COALESCE(SUM(t) OVER (PARTITION BY source, epoch
    ORDER BY md5('{SEED}|' || COALESCE(source, '') || '|' || epoch || '|' || block), block
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM e),
k AS (
  SELECT source, block, epoch, round((epoch - 1 + CASE WHEN tokens > 0 THEN start / tokens ELSE 0 END) / r, 9) AS position
  FROM o WHERE epoch <= floor(r) OR start + t / 2 <= (r - (epoch - 1)) * tokens)
SELECT d.doc_id, d.source, k.epoch::BIGINT AS epoch, k.block::BIGINT AS block, k.position::DOUBLE AS position
FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source
JOIN k ON d.source IS NOT DISTINCT FROM k.source AND k.block = d.h % m.n
"""
