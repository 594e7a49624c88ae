"""From raw change records to ordered INSERT, UPDATE and DELETE events.

Raw log columns: raw_topic, offset, op (r, c, u, d), before, after (structs), db, tbl, ts_ms. Order is (raw_topic, offset), never arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.decode import json_text
from ..functions.text import instant_text

INSERT, UPDATE, DELETE = "INSERT", "UPDATE", "DELETE"
SNAPSHOT, CDC = "SNAPSHOT", "CDC"
#: Neighbouring records are compared within blocks of this many offsets; a block is what one window holds.
BLOCK = 65_536
#: Where a record without an offset comes in its topic: before all others.
NO_OFFSET = -(2**62)


def key_text(image: str, keys: list[str], kind: T.StructType | None = None) -> Column:
    """Ordered JSON object of the key columns; null if the image or a key is null. Keys are equal if these texts are. kind: the image's type, for keys with decimals."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(f"{image}.{k}").isNotNull()
    named = {f.name.lower(): f for f in kind or []}
    row = F.struct(*[F.col(f"{image}.{k}").alias(k) for k in keys])
    kinds = T.StructType([T.StructField(k, named[k.lower()].dataType if k.lower() in named else T.StringType()) for k in keys])
    return F.when(whole, json_text(row, kinds))


def with_changes_only(log: DataFrame) -> DataFrame:
    """Without records that change no row (no op)."""
    return log.where(F.col("op").isNotNull())


def _blocks(log: DataFrame, link: Column) -> DataFrame:
    """raw_topic, block, before, after (link of the record before and after the block), place (records of the topic before it), topic_base: a row a block of offsets."""
    counts = log.groupBy("raw_topic", "block").agg(F.count("*").alias("n"), F.min_by(link, "offset").alias("first"), F.max_by(link, "offset").alias("last"))
    w = Window.partitionBy("raw_topic").orderBy("block")
    so_far = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1))
    edges = counts.select("raw_topic", "block", F.lag("last").over(w).alias("before"), F.lead("first").over(w).alias("after"), F.coalesce(so_far, F.lit(0)).alias("place"))
    topics = counts.groupBy("raw_topic").agg(F.sum("n").alias("n"))
    base = F.sum("n").over(Window.orderBy("raw_topic").rowsBetween(Window.unboundedPreceding, -1))  # a row a topic
    return edges.join(topics.select("raw_topic", F.coalesce(base, F.lit(0)).alias("topic_base")), "raw_topic")


def with_neighbours(log: DataFrame, columns: list[str]) -> DataFrame:
    """Add place (number in the topic, from 0), seq (number in the order of topic and offset, from 0), and prev_ and next_ of the columns, from the records before and after in the topic.

    Each window holds the records of BLOCK offsets, so no key or topic, however hot, meets in one task; what lies beyond a block's ends comes from
    its summary, a row a block, so offsets may have holes of any size. Nothing is sorted as a whole or written.
    """
    link = F.struct(*columns) if columns else F.struct(F.lit(0).alias("none"))
    log = log.withColumn("block", F.floor(F.col("offset") / BLOCK))
    edges = _blocks(log, link).withColumnsRenamed({"before": "_before", "after": "_after", "place": "_place"})
    w = Window.partitionBy("raw_topic", "block").orderBy("offset")
    out = log.join(edges, ["raw_topic", "block"])
    place = F.col("_place") + F.row_number().over(w) - 1
    out = out.withColumns({"place": place, "_prev": F.coalesce(F.lag(link).over(w), "_before"), "_next": F.coalesce(F.lead(link).over(w), "_after")})
    near = {f"{side}_{c}": F.col(f"_{side}.{c}") for c in columns for side in ("prev", "next")}
    return out.withColumns({"seq": F.col("topic_base") + F.col("place"), **near}).drop("block", "topic_base", "_before", "_after", "_place", "_prev", "_next")


def dense_order(log: DataFrame) -> DataFrame:
    """Add seq: consecutive numbers in the order of (raw_topic, offset), from 0."""
    return with_neighbours(log, []).drop("place")


def blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(c) == "")


def unreliable(keys: list[str], kind: T.StructType | None = None) -> Column:
    """Why a record can't be published, or null."""
    op, before_key = F.col("op"), key_text("before", keys, kind)
    image_key = F.when(op == "d", before_key).otherwise(key_text("after", keys, kind))
    return (
        F.when(blank("op"), "missing op")
        .when(~op.isin("r", "c", "u", "d"), "unknown op")
        .when(blank("db") | blank("tbl"), "missing source")
        .when(F.col("ts_ms").isNull(), "missing time")
        .when(image_key.isNull() | ((op == "u") & F.col("before").isNotNull() & before_key.isNull()), "missing key")
    )


def projected(image: str, columns: list[str]) -> Column:
    return F.when(F.col(image).isNotNull(), F.struct(*[F.col(f"{image}.{c}").alias(c) for c in columns]))


def normalize(log: DataFrame, keys: list[str], columns: list[str] | None = None, snapshot_count: int = 0, run: int = 0, by_offset: bool = False) -> DataFrame:
    """Events of a log: raw_topic, run, seq, sub, op, key, before, data, phase, sourceDatabase, sourceTable, event_ms, sourceEventTime, reason.

    A d directly before a c of the same table and key is one UPDATE; a u whose key changes is a DELETE and an INSERT; the first
    snapshot_count records of each topic are SNAPSHOT, as is every r that isn't part of a pair. run: which run of the task wrote the log; a later run comes after.
    by_offset: seq is the offset in the topic, which stays the same however a log is cut into batches, and not the number in the order.
    A record that unreliable() names, or that has a decode_error, becomes a row with its reason and without op, key and images, and so does a d right before a c of its table
    that has no key, or of its key that has no time. A record without a topic or an offset is the first of a topic named "", or of its own. Give the result to
    guards.publish_prefix(), which stops each topic at its first such row.
    """
    log, kind = with_changes_only(log), log.schema["after"].dataType
    reason = F.when(F.col("raw_topic").isNull() | F.col("offset").isNull(), "missing position")
    reason = F.coalesce(reason, *([F.col("decode_error")] if "decode_error" in log.columns else []), unreliable(keys, kind))
    log = log.withColumn("reason", reason).withColumn("k_before", key_text("before", keys, kind)).withColumn("k_after", key_text("after", keys, kind))
    log = log.withColumn("raw_topic", F.coalesce("raw_topic", F.lit(""))).withColumn("offset", F.coalesce("offset", F.lit(NO_OFFSET)))
    log = log.withColumn("_link", F.struct("op", "db", "tbl", "k_before", "k_after", "reason", "ts_ms", "after"))
    log = with_neighbours(log, ["_link"])
    here, prev, after = F.col("_link"), F.col("prev__link"), F.col("next__link")
    sound = lambda x: x["reason"].isNull()
    pair = lambda d, c: (d["op"] == "d") & (c["op"] == "c") & (d["db"] == c["db"]) & (d["tbl"] == c["tbl"]) & sound(d)
    true = lambda c: F.coalesce(c, F.lit(False))
    log = log.withColumn("opens", true(pair(here, after) & sound(after) & (here["k_before"] == after["k_after"])))
    log = log.withColumn("closes", true(pair(prev, here) & sound(here) & (here["k_after"] == prev["k_before"]))).where("not closes")
    next_reason = F.when(after["k_after"].isNull(), "missing key").when((here["k_before"] == after["k_after"]) & after["ts_ms"].isNull(), "missing time")
    log = log.withColumn("reason", F.coalesce("reason", F.when(true(pair(here, after)), next_reason)))
    columns = columns or log.schema["after"].dataType.names
    before, data = projected("before", columns), projected("after", columns)
    next_data = F.when(F.col("opens"), F.struct(*[F.col(f"next__link.after.{c}").alias(c) for c in columns]))
    early = F.col("place") < snapshot_count
    phase = F.when(F.when(F.col("opens"), early).otherwise(early | (F.col("op") == "r")), SNAPSHOT).otherwise(CDC)
    none = F.lit(None).cast(log.select(before.alias("b")).schema["b"].dataType)

    def event(op: str | None, key: Column, was: Column, now: Column) -> Column:
        return F.struct(F.lit(op).cast("string").alias("op"), key.alias("key"), was.alias("before"), now.alias("data"))

    moved = (F.col("op") == "u") & F.col("k_before").isNotNull() & (F.col("k_before") != F.col("k_after"))
    events = (
        F.when(F.col("reason").isNotNull(), F.array(event(None, F.lit(None).cast("string"), none, none)))
        .when(F.col("opens"), F.array(event(UPDATE, F.col("k_before"), before, next_data)))
        .when(F.col("op") == "d", F.array(event(DELETE, F.col("k_before"), before, before)))
        .when(moved, F.array(event(DELETE, F.col("k_before"), before, before), event(INSERT, F.col("k_after"), none, data)))
        .when(F.col("op") == "u", F.array(event(UPDATE, F.col("k_after"), before, data)))
        .otherwise(F.array(event(INSERT, F.col("k_after"), none, data)))
    )
    ms = F.when(F.col("opens"), F.greatest("ts_ms", "next__link.ts_ms")).otherwise(F.col("ts_ms"))
    out = log.select("raw_topic", F.col("offset" if by_offset else "seq").cast("long").alias("seq"), "db", "tbl", phase.alias("phase"), ms.alias("event_ms"), "reason", F.posexplode(events).alias("sub", "e"))
    return out.select(
        "raw_topic", F.lit(run).alias("run"), "seq", "sub", "e.op", "e.key", "e.before", "e.data", "phase", F.col("db").alias("sourceDatabase"), F.col("tbl").alias("sourceTable"),
        "event_ms", instant_text(F.col("event_ms")).alias("sourceEventTime"), "reason",
    )


def snapshot_events(rows: DataFrame, keys: list[str], database: str, tbl: str, received_ms: Column, columns: list[str] | None = None, run: int = 0, topic: str = "snapshot") -> DataFrame:
    """INSERT events of the SNAPSHOT phase from plain rows; received_ms is the time that they get. topic: that of the owner's changes, if publishing shall stop both together.

    seq is -1: before every change of the same run, and after all of earlier runs. A row without its key has a reason, as in normalize().
    """
    columns = columns or rows.columns
    rows = rows.withColumn("_row", F.struct(*rows.columns))
    key = key_text("_row", keys, rows.schema["_row"].dataType)
    data = F.when(key.isNotNull(), F.struct(*columns))
    kind = rows.select(data.alias("d")).schema["d"].dataType
    return rows.select(
        F.lit(topic).alias("raw_topic"), F.lit(run).alias("run"), F.lit(-1).cast("long").alias("seq"), F.lit(0).alias("sub"), F.when(key.isNotNull(), INSERT).alias("op"), key.alias("key"),
        F.lit(None).cast(kind).alias("before"),
        data.alias("data"), F.lit(SNAPSHOT).alias("phase"), F.lit(database).alias("sourceDatabase"), F.lit(tbl).alias("sourceTable"),
        received_ms.cast("long").alias("event_ms"), instant_text(received_ms.cast("long")).alias("sourceEventTime"), F.when(key.isNull(), "missing key").alias("reason"),
    )


def snapshot_then_changes(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """Events of a snapshot and of the changes after it: a run's snapshot comes before its changes, in the order of run and seq."""
    return snapshot.unionByName(changes)
