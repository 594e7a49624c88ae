"""Source against target: row counts and key-range blocks. Differences are source minus target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .apply import merged_into, row_key, until

MAX_STEP = 1_000_000
MAX_BLOCKS = 1000


ACTIVE = ("STARTING", "RUNNING", "PAUSING")


def check_standing_still(mode: str, status: str, strict: bool = True) -> None:
    """Refuses a strict check while a task still moves changes: source and target aren't at the same point. Pause it, or compare at an offset (apply.applied)."""
    if strict and mode.upper() == "FULL_CDC" and status in ACTIVE:
        raise ValueError("the task is running: source and target are not at the same point; pause it first")


def count_check(source: DataFrame, target: DataFrame) -> DataFrame:
    """source_rows, target_rows, difference, matched."""
    counts = source.agg(F.count("*").alias("source_rows"), F.lit(0).cast("long").alias("target_rows")).unionByName(target.agg(F.lit(0).cast("long").alias("source_rows"), F.count("*").alias("target_rows")))
    both = counts.agg(F.sum("source_rows").alias("source_rows"), F.sum("target_rows").alias("target_rows"))
    return both.withColumn("difference", F.col("source_rows") - F.col("target_rows")).withColumn("matched", F.col("difference") == 0)


def check_key(df: DataFrame, keys: list[str]) -> str:
    """The column to make blocks by; a key of no or several columns, or one that is no number, is refused: count the rows instead."""
    if len(keys) != 1:
        raise ValueError("blocks need a sync key of exactly one column; use the row count")
    field = next((f for f in df.schema if f.name.lower() == keys[0].lower()), None)
    if field is None or not isinstance(field.dataType, T.NumericType):
        raise ValueError(f"{keys[0]} is not a number; use the row count")
    return field.name


def key_range(df: DataFrame, key: str) -> DataFrame:
    """low, high and rows (null keys counted) of a numeric key."""
    return df.agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("rows"))


def suggested_step(low: int, high: int) -> int:
    return max(1, -(-(high - low) // MAX_BLOCKS))


def _check_blocks(low: int, high: int, step: int) -> None:
    if not 1 <= step <= MAX_STEP:
        raise ValueError(f"step must be 1 to {MAX_STEP}")
    if -(-(high - low) // step) + 1 > MAX_BLOCKS:
        raise ValueError(f"more than {MAX_BLOCKS} blocks; a larger step is needed, such as {suggested_step(low, high)}")


def _counted_blocks(source: DataFrame, target: DataFrame, key: str, step: int) -> tuple[DataFrame, int, int, Column]:
    """(block, s, t: rows of each side, block null for what is in none), number of blocks, source rows, lower bound of a block. One pass over each side once the range is known."""
    low, high, rows = key_range(source, check_key(source, [key])).first()
    n = 0
    if rows:
        low, high = low or 0, high or 0  # only null keys: one block from 0
        _check_blocks(low, high, step)
        n = int((high - low) // step) + 1
    start = F.lit(low or 0)
    block = F.floor((F.col(key) - start) / step).cast("long")
    block = F.when((F.col(key) >= start) & (F.col(key) < start + n * step), block).alias("block")
    side = lambda df, i: df.select(block, F.lit(i).alias("side"))
    count = lambda i: F.sum(F.when(F.col("side") == i, 1).otherwise(0))
    blocks = side(source, 0).unionByName(side(target, 1)).groupBy("block").agg(count(0).alias("s"), count(1).alias("t"))
    whole = isinstance(source.schema[key].dataType, T.IntegralType)
    return blocks, n, rows, (start + F.col("block") * step).cast("long" if whole else "decimal(38,10)")


def key_range_blocks(source: DataFrame, target: DataFrame, key: str, step: int) -> DataFrame:
    """block_index (from 1), lower, upper (exclusive), source_rows, target_rows, difference, matched, for blocks of `step` keys from the source's smallest.

    Empty blocks are listed. More than MAX_BLOCKS blocks are refused. Target rows before the first or behind the last block are in none; block_verdict() counts them.
    """
    blocks, n, _, lower = _counted_blocks(source, target, key, step)
    every = source.sparkSession.range(n).select(F.col("id").alias("block"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = every.join(blocks.where("block is not null"), "block", "left")
    out = out.select((F.col("block") + 1).alias("block_index"), lower.alias("lower"), (lower + step).alias("upper"), zero(F.col("s")).alias("source_rows"), zero(F.col("t")).alias("target_rows"))
    return out.withColumn("difference", F.col("source_rows") - F.col("target_rows")).withColumn("matched", F.col("difference") == 0)


def block_verdict(source: DataFrame, target: DataFrame, key: str, step: int) -> DataFrame:
    """total_blocks, matched_blocks, mismatched_blocks, source_rows, target_rows, difference, target_outside, matched.

    source_rows counts all rows, those without a key too; target_rows are those of the blocks, and target_outside the others, which the verdict doesn't look at. It is
    matched if no block differs and neither do source_rows and target_rows. An empty source has no block: the target's rows are all counted, and it is as one block.
    """
    blocks, n, rows, _ = _counted_blocks(source, target, key, step)
    inside = F.col("block").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    told = blocks.agg(F.count_if(inside & (F.col("s") != F.col("t"))).alias("differ"), zero(F.sum(F.when(inside, F.col("t")))).alias("t"), zero(F.sum(F.when(~inside, F.col("t")))).alias("outside"))
    counted = F.col("t") if n else F.col("outside")
    difference = F.lit(rows).cast("long") - counted
    differ = F.col("differ") if n else (difference != 0).cast("long")
    return told.select(
        F.lit(n).cast("long").alias("total_blocks"), (max(n, 1) - differ).cast("long").alias("matched_blocks"), differ.alias("mismatched_blocks"), F.lit(rows).cast("long").alias("source_rows"),
        counted.alias("target_rows"), difference.alias("difference"), F.col("outside").alias("target_outside"), ((difference == 0) & (differ == 0)).alias("matched"),
    )


def compare_rows(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """source_rows, target_rows, missing, extra, different, matched: rows of both sides by key, whole.

    Each side is counted by key with the sum of its rows' hashes (64 bits a row) in one aggregation, so keys may repeat and a hot one meets in no task. target: has source's columns.
    """
    side = lambda df, i: df.select(row_key(df, keys).alias("key"), F.lit(i).alias("side"), F.xxhash64(*[F.col(f"`{f.name}`").cast(f.dataType) for f in source.schema]).cast("decimal(20,0)").alias("h"))
    n = lambda i: F.count_if(F.col("side") == i)
    total = lambda i: F.sum(F.when(F.col("side") == i, F.col("h")))
    per = side(source, 0).unionByName(side(target, 1)).groupBy("key").agg(n(0).alias("s"), n(1).alias("t"), total(0).alias("hs"), total(1).alias("ht"))
    unlike = (F.col("s") > 0) & (F.col("t") > 0) & ((F.col("s") != F.col("t")) | (F.col("hs") != F.col("ht")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = per.agg(zero(F.sum("s")).alias("source_rows"), zero(F.sum("t")).alias("target_rows"), F.count_if(F.col("t") == 0).alias("missing"), F.count_if(F.col("s") == 0).alias("extra"), F.count_if(unlike).alias("different"))
    return out.withColumn("matched", (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("different") == 0))


def check_at_position(base: DataFrame, events: DataFrame, table, keys: list[str]) -> DataFrame:
    """compare_rows() of a versioned table's current version with the source at the position in the log that the version stands for: base after the events up to there.

    Changes may go on meanwhile, on both sides: the version and its position are taken together, and later events don't count.
    """
    version = table.current()
    position = table.position(version)
    if position is None:
        raise ValueError(f"version {version} doesn't tell the position that it stands for")
    return compare_rows(merged_into(base, until(events, position), keys), table.read(version), keys)


def group_check(pairs: dict[str, tuple]) -> DataFrame:
    """table_name, source_rows, target_rows, difference, status for each table; one that is absent or fails while it is read is FAILED and stops no other.

    pairs: source and target by table, each a DataFrame, a function that gives one, or None. Each table is counted when this is called.
    """
    out, spark = [], SparkSession.active()
    for name, sides in pairs.items():
        try:
            source, target = (side() if callable(side) else side for side in sides)
            c = count_check(source, target).first() if source is not None and target is not None else None
        except Exception:  # whatever a source raises while it is opened or read
            c = None
        out.append((name, None, None, None, "FAILED") if c is None else (name, c["source_rows"], c["target_rows"], c["difference"], "MATCHED" if c["matched"] else "MISMATCHED"))
    return spark.createDataFrame(out, "table_name string, source_rows long, target_rows long, difference long, status string")


def group_summary(checks: DataFrame) -> DataFrame:
    n = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0)).cast("long")
    return checks.agg(n("MATCHED").alias("matched"), n("MISMATCHED").alias("mismatched"), n("FAILED").alias("failed"))
