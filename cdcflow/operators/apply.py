"""Applying events by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.decode import json_text
from .events import DELETE

ORDER = ("run", "seq", "sub")


def latest_changes(events: DataFrame, upto: Column | None = None) -> DataFrame:
    """key, op, data of the last event of each key, at or before a position. Partial aggregation makes hot keys harmless.

    Events with a reason are an error: publishing stops at them (guards.publish_prefix), so nothing after them may be applied.
    """
    if "reason" in events.columns:
        events = events.where(F.when(F.col("reason").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("unreliable record: "), F.col("reason"))).cast("boolean")))
    events = events if upto is None else events.where(F.col("seq") <= upto)
    last = F.max_by(F.struct("op", "data"), F.struct(*[c for c in ORDER if c in events.columns])).alias("last")
    return events.groupBy("key").agg(last).select("key", "last.op", "last.data")


def until(events: DataFrame, position: dict) -> DataFrame:
    """The events at or before a position, {"run": ..., "seq": ...}."""
    here = F.struct(*[(F.col(c) if c in events.columns else F.lit(0)).cast("long").alias(c) for c in ("run", "seq")])
    return events.where(here <= F.struct(F.lit(position["run"]).cast("long").alias("run"), F.lit(position["seq"]).cast("long").alias("seq")))


def applied(events: DataFrame, upto: Column | None = None) -> DataFrame:
    """The rows that exist after the events: inserts and updates upsert, a delete of an absent key does nothing; applying twice is the same."""
    return latest_changes(events, upto).where(F.col("op") != DELETE).select("data.*")


def row_key(table: DataFrame, keys: list[str]) -> Column:
    """The key text of a table's rows, as events have it; a null part is written as null."""
    kind = T.StructType([next(f for f in table.schema if f.name.lower() == k.lower()) for k in keys])
    return json_text(F.struct(*[F.col(f"`{k}`").alias(k) for k in keys]), T.StructType([T.StructField(k, f.dataType) for k, f in zip(keys, kind)]))


def merged_into(base: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """base after events: rows whose key has an event are replaced by its outcome. One join; columns are matched by name and keep base's types."""
    last = latest_changes(events)
    kept = base.select(row_key(base, keys).alias("key"), F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("row"))
    new = F.struct(*[F.col(f"data.`{f.name}`").cast(f.dataType).alias(f.name) for f in base.schema])
    met = kept.join(last, "key", "full").where(F.col("op").isNull() | (F.col("op") != DELETE))
    return met.select(F.when(F.col("op").isNull(), F.col("row")).otherwise(new).alias("r")).select("r.*")


def topic_reconciliation(source: DataFrame, events: DataFrame) -> DataFrame:
    """source_rows, live_keys, difference, matched: rows of the source against keys that the event log leaves alive."""
    live = latest_changes(events).where(F.col("op") != DELETE)
    counts = source.agg(F.count("*").alias("n")).withColumn("side", F.lit("source")).unionByName(live.agg(F.count("*").alias("n")).withColumn("side", F.lit("log")))
    both = counts.agg(F.max(F.when(F.col("side") == "source", F.col("n"))).alias("source_rows"), F.max(F.when(F.col("side") == "log", F.col("n"))).alias("live_keys"))
    return both.withColumn("difference", F.col("source_rows") - F.col("live_keys")).withColumn("matched", F.col("difference") == 0)
