"""Checks on what is about to be, or has been, published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes that a record takes besides key and value, and per-column and per-record allowances of the worst case.
RECORD_OVERHEAD = 128
FIELD_OVERHEAD = 32
COLUMN_OVERHEAD = 160
RECORD_BASE = 512
LARGE_COLUMN = 1 << 20
WORST_CASE_CAP = 4 << 30


def record_bytes(key: Column, value: Column) -> Column:
    return F.coalesce(F.octet_length(key), F.lit(0)) + F.coalesce(F.octet_length(value), F.lit(0)) + RECORD_OVERHEAD


def with_size_reason(events: DataFrame, producer_limit: int, topic_limit: int) -> DataFrame:
    """Add record_bytes and size_reason: why a record is too large, or null."""
    limit = min(producer_limit, topic_limit)
    size = record_bytes(F.col("key"), F.col("value"))
    return events.withColumn("record_bytes", size).withColumn("size_reason", F.when(size > limit, F.concat(F.lit("record of "), size.cast("string"), F.lit(f" bytes, limit {limit}"))))


def worst_case_sizes(columns: DataFrame, chosen: Column, cdc: bool = True) -> DataFrame:
    """table_name, raw_bytes, event_bytes, large_columns (NAME(TYPE), in the order of position) from column metadata (table_name, column_name, type_name, position, value_bytes).

    chosen: is the column selected. Of changes, the raw record has every column, both images and its schema, and the event both images; in a FULL run both have the selected columns once.
    Large columns are told whether selected or not of changes, else only if selected.
    """
    least = lambda c: F.least(c, F.lit(WORST_CASE_CAP)).cast("long")
    value = F.least(F.col("value_bytes"), F.lit(WORST_CASE_CAP)) + FIELD_OVERHEAD
    taken = F.sum(F.when(chosen, value).otherwise(0))
    raw = 2 * F.sum(value) + 2 * COLUMN_OVERHEAD * F.count("*") + RECORD_BASE if cdc else taken + RECORD_BASE
    large = (F.col("value_bytes") > LARGE_COLUMN) & (F.lit(cdc) | chosen)
    named = F.collect_list(F.when(large, F.struct("position", F.concat("column_name", F.lit("("), "type_name", F.lit(")")).alias("name"))))
    return columns.groupBy("table_name").agg(
        least(raw).alias("raw_bytes"), least((2 if cdc else 1) * taken + RECORD_BASE).alias("event_bytes"), F.transform(F.array_sort(named), lambda x: x["name"]).alias("large_columns"),
    )


#: Bytes of the largest text form of a value, by type name; types without a bound; bytes of any other type.
TEXT_BYTES = {"TINYTEXT": 255, "TEXT": 65_535, "MEDIUMTEXT": 16_777_215}
BLOB_BYTES = {"TINYBLOB": 255, "BLOB": 65_535, "MEDIUMBLOB": 16_777_215, "BIT": 8}
CHARACTER_TYPES, BINARY_TYPES = ("CHAR", "VARCHAR", "ENUM", "SET"), ("BINARY", "VARBINARY")
UNBOUNDED_TYPES = ("LONGTEXT", "LONGBLOB", "JSON", "GEOMETRY", "POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON", "GEOMETRYCOLLECTION", "GEOMCOLLECTION")
OTHER_BYTES = 40


def value_bytes(type_name: Column, size: Column) -> Column:
    """Most bytes that a column's value takes as JSON: four a character, Base64 for binary types, WORST_CASE_CAP where its type has no bound."""
    t = F.upper(F.trim(F.regexp_extract(type_name, r"^[^( ]*", 0)))
    n = F.greatest(F.coalesce(size, F.lit(0)), F.lit(1)).cast("long")
    base64 = lambda c: F.ceil(c / 3) * 4
    out = F.when(t.isin(*UNBOUNDED_TYPES), F.lit(WORST_CASE_CAP))
    for name, most in TEXT_BYTES.items():
        out = out.when(t == name, F.lit(most))
    for name, most in BLOB_BYTES.items():
        out = out.when(t == name, base64(F.lit(most)))
    out = out.when(t.isin(*CHARACTER_TYPES), 4 * n).when(t.isin(*BINARY_TYPES), base64(n)).otherwise(F.lit(OTHER_BYTES))
    return F.least(out, F.lit(WORST_CASE_CAP)).cast("long")


ORDER = ("run", "seq", "sub")


def place(events: DataFrame) -> Column:
    """Where an event stands among those of its owner: run, seq and sub, as far as there are such columns."""
    return F.struct(*[F.col(c) for c in ORDER if c in events.columns])


def first_refused(events: DataFrame, reason: str = "reason", owner: str = "raw_topic") -> DataFrame:
    """owner, first_place, first_bad (its seq), first_reason: the first refused event of each owner that has one, in the order of run, seq and sub."""
    bad = events.where(F.col(reason).isNotNull())
    first = F.min(F.struct(place(events).alias("at"), F.col(reason).alias("why"))).alias("f")
    return bad.groupBy(owner).agg(first).select(owner, F.col("f.at").alias("first_place"), F.col("f.at.seq").alias("first_bad"), F.col("f.why").alias("first_reason"))


def publish_prefix(events: DataFrame, reason: str = "reason", owner: str = "raw_topic") -> tuple[DataFrame, DataFrame]:
    """(published, held): the events before each owner's first refused one, and the rest with where and why it stopped. Nothing is discarded.

    owner: a column; a snapshot and the changes of one owner, which share it, stop together, and a run that failed holds every later run of its owner. An owner that is null is one of its own.
    """
    named = events.withColumn("_owner", F.coalesce(F.col(owner).cast("string"), F.lit("")))
    both = named.join(first_refused(named, reason, "_owner"), "_owner", "left")  # broadcast at run time, once its size is known to be small
    goes = F.col("first_place").isNull() | (place(events) < F.col("first_place"))
    return both.where(goes).drop("_owner", "first_place", "first_bad", "first_reason"), both.where(~goes).drop("_owner", "first_place")


def position_check(log: DataFrame, positions: DataFrame) -> DataFrame:
    """raw_topic, begin_offset, end_offset, position, action, start, missing.

    positions: raw_topic, position (next offset to read; null if never read), fresh. A position inside the log resumes; one never read starts at 0 if the log
    still does; a fresh run starts at the log's begin; anything else is a gap with the number of records that can't be read any more.
    """
    ends = log.groupBy("raw_topic").agg(F.min("offset").alias("begin_offset"), (F.max("offset") + 1).alias("end_offset"))
    both = ends.join(positions, "raw_topic", "left")
    p, begin, end = F.col("position"), F.col("begin_offset"), F.col("end_offset")
    action = F.when(p.isNotNull() & (p >= begin) & (p <= end), "RESUME").when(p.isNull() & (begin == 0), "START").when(F.coalesce("fresh", F.lit(False)), "BEGIN").otherwise("GAP")
    start = F.when(action == "RESUME", p).when(action == "START", F.lit(0).cast("long")).when(action == "BEGIN", begin)
    missing = F.when(action == "GAP", F.when(p > end, p - end).otherwise(begin - F.coalesce(p, F.lit(0)))).otherwise(F.lit(0).cast("long"))
    return both.select("raw_topic", "begin_offset", "end_offset", "position", action.alias("action"), start.alias("start"), missing.alias("missing"))


def holes(log: DataFrame, block: int = 65_536) -> DataFrame:
    """raw_topic, after_offset, missing: places where offsets aren't consecutive.

    Offsets are compared within blocks; the first and last offset of each block, a row a block, tell the holes between blocks.
    """
    own = F.floor(F.col("offset") / block)
    df = log.select("raw_topic", "offset", own.alias("block"))
    inside = df.withColumn("previous", F.lag("offset").over(Window.partitionBy("raw_topic", "block").orderBy("offset"))).select("raw_topic", "offset", "previous")
    edges = df.groupBy("raw_topic", "block").agg(F.min("offset").alias("low"), F.max("offset").alias("high"))
    between = edges.select("raw_topic", F.col("low").alias("offset"), F.lag("high").over(Window.partitionBy("raw_topic").orderBy("block")).alias("previous"))
    both = inside.unionByName(between).where(F.col("offset") > F.col("previous") + 1)
    return both.select("raw_topic", F.col("previous").alias("after_offset"), (F.col("offset") - F.col("previous") - 1).alias("missing"))


def backlog(ends: DataFrame, committed: DataFrame) -> DataFrame:
    """raw_topic, backlog, effective_backlog. committed: raw_topic, position, stopped, raw_backlog (counted on top while stopped)."""
    left = F.greatest(F.lit(0), F.col("end_offset") - F.coalesce("position", F.lit(0)))
    extra = F.when(F.coalesce("stopped", F.lit(False)), F.coalesce("raw_backlog", F.lit(0))).otherwise(F.lit(0))
    return ends.join(committed, "raw_topic", "left").select("raw_topic", left.alias("backlog"), (left + extra).alias("effective_backlog"))


def effective_lag(stored: Column, stopped_since_ms: Column, as_of_ms: Column) -> Column:
    """Seconds: while stopped, at least the time since the stop, which is never below 0."""
    waited = F.greatest(F.lit(0), F.floor((as_of_ms - stopped_since_ms) / 1000))
    return F.when(stopped_since_ms.isNull(), stored).otherwise(F.greatest(stored, waited))


def delivery_stats(events: DataFrame, acknowledged_ms: Column) -> DataFrame:
    """raw_topic, delivered, last_seq, last_event_ms, lag_ms (never below 0): the last is the last of the latest run."""
    last = F.max_by(F.struct("seq", "event_ms", acknowledged_ms.alias("ack")), place(events))
    out = events.groupBy("raw_topic").agg(F.count("*").alias("delivered"), last.alias("l"))
    return out.select("raw_topic", "delivered", F.col("l.seq").alias("last_seq"), F.col("l.event_ms").alias("last_event_ms"), F.greatest(F.lit(0), F.col("l.ack") - F.col("l.event_ms")).alias("lag_ms"))
