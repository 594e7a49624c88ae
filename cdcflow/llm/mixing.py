"""Mixing sources to target weights by hash-threshold histograms.

A document's size is its number of words. Sources share all words by weight; a target stops at max_repeat times its source's size, and what is left
over is shared again by weight among the others. Full passes over a source (target // size) are taken by every document; for the rest
each document has a hash of its content, and the documents whose hash lies below the source's threshold are taken once more.

Thresholds come from sums, not from sorting: words are summed by source and the hash's first bits, the bucket where the sum passes
the budget is found, and only that bucket is refined by the next bits, LEVELS times. The scan of the texts happens once; what the
levels read is one short row a document.

Defined cases: a null text has size 0; a null source is a source of its own and comes last; rows equal in id, source and text share a hash and are
taken together; an empty table gives no rows; a source without words has target 0; other columns are carried if named, but for those named like
an output column, which it replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, bundled, table, temporaries, written

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
BITS = 10  # of the hash, for each level
LEVELS = 4
MADE = ["doc_id", "source", "size", "source_size", "target", "copies", "taken"]
#: Sources up to this number are broadcast (some tens of bytes each); more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, the hash's LEVELS parts h0, h1, ... and the other columns of docs but text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    content = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("source"), F.lit("")), text)
    digits = F.conv(F.substring(F.md5(content), 1, BITS * LEVELS // 4), 16, 10).cast("long")
    rest = [c for c in docs.columns if c not in ("doc_id", "source", "text")]
    df = docs.select("doc_id", "source", F.regexp_count(text, F.lit(f"{NOT_SPACE}+")).cast("long").alias("size"), digits.alias("h"), *rest)
    parts = [F.shiftright("h", BITS * (LEVELS - 1 - i)).bitwiseAND(2**BITS - 1).cast("int").alias(f"h{i}") for i in range(LEVELS)]
    return df.select("doc_id", "source", "size", *parts, *rest)


def targets(sources: DataFrame) -> DataFrame:
    """source, source_size -> the same with target.

    Sources stop at their cap in the order of cap / weight, so the level that the rest shares is found from running sums in that order.
    The windows hold one row a source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(rank - 1, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("long")
    df = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * MAX_REPEAT)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weights = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    df = df.withColumn("level", left.cast("double") / weights)  # what a unit of weight gets if the sources from here on share the rest
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(whole)  # levels fall from the first that fits
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("cap") / F.col("weight"))).over(whole)
    df = df.withColumn("shared", level).withColumn("from", first)
    capped = F.col("shared").isNull() | (F.col("cap") / F.col("weight") < F.col("from"))
    return df.select("source", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(F.col("shared") * F.col("weight")).alias("target"))


def _joined(docs: DataFrame, per_source: DataFrame, few: bool) -> DataFrame:
    p = per_source.withColumnRenamed("source", "p_source")
    return docs.join(F.broadcast(p) if few else p, F.col("source").eqNullSafe(F.col("p_source")), "left").drop("p_source")


def thresholds(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """source, source_size, target, passes, c0, c1, ...: documents whose (h0, h1, ...) come before (c0, c1, ...) are taken once more."""
    few = plan.count() <= BROADCAST_SOURCES
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    found = plan.withColumn("passes", passes).withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size"))
    for level in range(LEVELS):
        within = [f"c{i}" for i in range(level)]
        inside = F.lit(True)
        for i in range(level):
            inside = inside & (F.col(f"h{i}") == F.col(f"c{i}"))
        edge = _joined(sizes.select("source", "size", *[f"h{i}" for i in range(level + 1)]), found.select("source", *within), few).where(inside)
        sums = edge.groupBy("source", f"h{level}").agg(F.sum("size").alias("words"))
        so_far = F.sum("words").over(Window.partitionBy("source").orderBy(f"h{level}"))  # 2 ** BITS rows a source at most
        sums = _joined(sums.withColumn("upto", so_far), found.select("source", "budget"), few)
        fits = F.col("upto") <= F.col("budget")
        last = sums.groupBy("source").agg(
            F.min(F.when(~fits, F.col(f"h{level}"))).alias(f"c{level}"), F.max(F.when(fits, F.col("upto"))).alias("used"), F.min(F.when(~fits, F.col("upto"))).alias("over")
        )
        found = _joined(found, last, few).withColumn("over", F.col("over") - F.col("budget")).withColumn("budget", F.col("budget") - F.coalesce("used", F.lit(0)))
        found = found.withColumn(f"c{level}", F.coalesce(f"c{level}", F.lit(2**BITS)))
        if level == LEVELS - 1:  # the bucket at the edge is taken if that misses the target by less
            found = found.withColumn(f"c{level}", F.col(f"c{level}") + F.when(F.col("over") < F.col("budget"), 1).otherwise(0))
        found = written(found.drop("used", "over"), "mix", keep=level == LEVELS - 1)
    return found.drop("budget")


def mixed(docs: DataFrame, carry: list[str] = []) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (how often the mix takes the document), taken (words), and carry, for every row of docs."""
    rows, carried, kept = bundled(docs, carry, MADE)
    sizes = sized(rows)
    with temporaries(docs.sparkSession):
        small = written(sizes.drop(carried), "sizes", keep=not kept)
        plan = written(targets(small.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
        few = plan.count() <= BROADCAST_SOURCES
        cuts = thresholds(small, plan)
    sizes = sizes if kept else small
    below = F.lit(False)
    for i in reversed(range(LEVELS)):
        below = (F.col(f"h{i}") < F.col(f"c{i}")) | ((F.col(f"h{i}") == F.col(f"c{i}")) & below)
    taken = _joined(sizes, cuts, few)
    taken = taken.withColumn("copies", (F.col("passes") + F.when(below, 1).otherwise(0)).cast("int"))
    return taken.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *[F.col(f"{carried}.`{c}`").alias(c) for c in kept])


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    CAST('0x' || substr(md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(source, ''), coalesce(text, ''))), 1, 10) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3 * CAST(sum(size) AS BIGINT) AS cap,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, CAST(cap AS DOUBLE) / weight AS ratio,
    CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS DOUBLE) AS level
  FROM s WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), m AS (
  SELECT *, max(CASE WHEN level * weight <= cap THEN level END) OVER () AS shared, min(CASE WHEN level * weight <= cap THEN ratio END) OVER () AS first FROM l
), t AS (
  SELECT source, source_size, CASE WHEN shared IS NULL OR ratio < first THEN CAST(cap AS DOUBLE) ELSE shared * weight END AS target FROM m
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM t
), u AS (
  SELECT d.*, p.source_size, p.target, p.passes, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto, sum(d.size) OVER (PARTITION BY d.source, d.h) AS own,
    p.target - p.passes * p.source_size AS budget
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * (passes + CASE WHEN upto <= budget OR (upto - own <= budget AND upto - budget < budget - (upto - own)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM u
"""
