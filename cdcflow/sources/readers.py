"""Snapshots and change logs as DataFrames."""

from __future__ import annotations

import datetime as dt
import json
import re
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import DEFAULT_ZONE

MAX_PARALLELISM = 4
#: Name of a binary log file; positions before 4 lie in its header.
LOG_FILE = r"^[A-Za-z0-9._-]+$"
FIRST_POSITION = 4
#: Highest rates that a reader may ask for.
MAX_ROWS_PER_SECOND, MAX_BYTES_PER_SECOND = 100_000, 1 << 30


def snapshot(spark: SparkSession, url: str, table: str, columns: list[str], partition_column: str | None = None, bounds: tuple | None = None, parallelism: int = 1, properties: dict | None = None) -> DataFrame:
    """Bounded scan over JDBC; the selection is pushed down. With a partition column and its bounds it reads in up to MAX_PARALLELISM parts."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**(properties or {}))
    if partition_column and bounds:
        reader = reader.options(partitionColumn=partition_column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(max(1, min(parallelism, MAX_PARALLELISM))))
    return reader.load().select(*columns)


def file_log(spark: SparkSession, path: str, schema, stream: bool = False, file_format: str = "parquet", **options) -> DataFrame:
    """A raw log kept in files, as a batch or a stream."""
    return (spark.readStream if stream else spark.read).format(file_format).schema(schema).options(**options).load(path)


def kafka_log(spark: SparkSession, servers: str, topic: str, stream: bool = True, **options) -> DataFrame:
    """A raw log in Kafka: raw_topic, offset, value. Needs the Kafka connector on the classpath; lost records end the query."""
    reader = (spark.readStream if stream else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("failOnDataLoss", "true").options(**options)
    return reader.load().select(F.col("topic").alias("raw_topic"), "offset", F.col("value").cast("string").alias("value"))


def check_start(mode: str, as_of_ms: int, start_ms: int | None = None, file: str | None = None, position: int | None = None) -> None:
    """Refuses a start in the future, a file name that can't be one, and a position inside a file's header."""
    if mode == "TIMESTAMP" and (start_ms is None or start_ms > as_of_ms):
        raise ValueError("the start time is missing or in the future")
    if mode == "SPECIFIC" and (not re.match(LOG_FILE, file or "") or position is None or position < FIRST_POSITION):
        raise ValueError("the start file or position is not valid")
    if mode not in ("LATEST", "TIMESTAMP", "SPECIFIC"):
        raise ValueError(f"unknown start: {mode}")


#: Identifiers of databases, tables and columns, and names of topics, as far as they are accepted.
IDENTIFIER, TOPIC_NAME = r"^[A-Za-z0-9_$]+(\.[A-Za-z0-9_$]+)?$", r"^[A-Za-z0-9._-]{1,249}$"


def check_names(identifiers: list[str] = [], topics: list[str] = []) -> None:
    """Refuses names that can't be an identifier or a topic."""
    for kind, pattern, names in (("identifier", IDENTIFIER, identifiers), ("topic", TOPIC_NAME, topics)):
        for name in names:
            if not re.fullmatch(pattern[1:-1], name or "") or name in (".", ".."):
                raise ValueError(f"not a valid {kind}: {name!r}")


def wall_clock_ms(wall_clock: str, zone: str) -> Column:
    """Epoch milliseconds of a source's wall clock."""
    return F.unix_millis(F.to_utc_timestamp(F.to_timestamp(F.lit(wall_clock)), zone))


def log_file_number(name: Column) -> Column:
    """The number that a log file's name ends with, by which files are in order; 0 without one."""
    return F.coalesce(F.regexp_extract(name, r"(\d+)$", 1).try_cast("long"), F.lit(0))


def kafka_start(mode: str, topic: str, wall_clock: str | None = None, zone: str = DEFAULT_ZONE, offsets: dict[int, int] | None = None) -> dict[str, str]:
    """Options of a Kafka reader for a start: at the end, at a wall-clock time of the source, or at an offset of each partition. A time behind the last record starts at the end."""
    if mode == "LATEST":
        return {"startingOffsets": "latest"}
    if mode == "TIMESTAMP":
        at = dt.datetime.fromisoformat(wall_clock).replace(tzinfo=ZoneInfo(zone))
        return {"startingTimestamp": str(int(at.timestamp() * 1000)), "startingOffsetsByTimestampStrategy": "latest"}
    if mode == "SPECIFIC" and offsets:
        return {"startingOffsets": json.dumps({topic: {str(p): o for p, o in sorted(offsets.items())}})}
    raise ValueError(f"unknown start: {mode}")


def start_filter(mode: str, wall_clock: str | None = None, zone: str = DEFAULT_ZONE, file: str | None = None, position: int | None = None, end_offset: int | None = None) -> Column:
    """Which records of a file-based log an incremental run starts with: columns offset, ts_ms, and log_file (ordered by the number that it ends with), log_pos for SPECIFIC."""
    if mode == "LATEST":
        return F.col("offset") >= F.lit(end_offset)
    if mode == "TIMESTAMP":
        return F.col("ts_ms") >= wall_clock_ms(wall_clock, zone)
    mine, asked = log_file_number(F.col("log_file")), log_file_number(F.lit(file))
    later = F.when(mine != asked, mine > asked).otherwise(F.col("log_file") > file)
    return later | ((F.col("log_file") == file) & (F.col("log_pos") >= position))


def read_limits(rows_per_second: int, bytes_per_second: int, trigger_seconds: int, kafka: bool, row_bytes: int | None = None) -> dict[str, str]:
    """Options that keep a stream, triggered every trigger_seconds, within the limits.

    Kafka counts rows and files count bytes; with row_bytes, the size of a record (guards.worst_case_sizes() has an upper bound), each is held to both limits.
    """
    if not 1 <= rows_per_second <= MAX_ROWS_PER_SECOND or not 1 <= bytes_per_second <= MAX_BYTES_PER_SECOND:
        raise ValueError("read limit out of range")
    rows, size = rows_per_second * trigger_seconds, bytes_per_second * trigger_seconds
    if row_bytes:
        rows, size = max(1, min(rows, size // row_bytes)), max(1, min(size, rows * row_bytes))
    return {"maxOffsetsPerTrigger": str(rows)} if kafka else {"maxBytesPerTrigger": str(size)}


SAMPLE_KEYS = 10_000


def sql_literal(value) -> str:
    """A key's value in a predicate: numbers as they are, texts quoted, dates and times as JDBC escapes."""
    if isinstance(value, dt.datetime):
        return "{ts '" + value.isoformat(" ", "microseconds") + "'}"
    if isinstance(value, dt.date):
        return "{d '" + value.isoformat() + "'}"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def balanced_predicates(keys: DataFrame, key: str, column: str, parts: int, sample: int = SAMPLE_KEYS) -> list[str]:
    """Conditions on a database's column, each met by a like share of the rows, null keys in the last; together they meet every row once.

    keys: the key column alone, as Spark reads it. The quantiles are those of the `sample` rows that hash lowest, whatever the key's type: with 10,000 and up to
    a hundred parts they err by a few per cent. A value that has more rows than a part stays in one.
    """
    if not 1 <= parts <= sample:
        raise ValueError("parts must be 1 to the size of the sample")
    chosen = keys.select(key).where(F.col(key).isNotNull()).withColumn("_n", F.monotonically_increasing_id())
    found = sorted(r[key] for r in chosen.orderBy(F.xxhash64(key, "_n")).limit(sample).collect())
    cuts = sorted({found[i * len(found) // parts] for i in range(1, parts)} - {found[0]}) if found else []
    if not cuts:
        return ["1 = 1"]
    told = [sql_literal(c) for c in cuts]
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(told, told[1:])]
    return [f"{column} < {told[0]}", *inner, f"{column} >= {told[-1]} OR {column} IS NULL"]


def balanced_snapshot(spark: SparkSession, url: str, table: str, columns: list[str], key: str, parallelism: int, properties: dict | None = None) -> DataFrame:
    """Bounded scan over JDBC in parts of like size, also where the key is skewed, a text or a time; the key's column is read once before for its quantiles."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**(properties or {}))
    name = next(c for c in reader.load().columns if c.lower() == key.lower())
    q = "`" if url.startswith("jdbc:mysql") else '"'
    conditions = balanced_predicates(reader.load(), name, f"{q}{name}{q}", max(1, min(parallelism, MAX_PARALLELISM)))
    return spark.read.jdbc(url, table, predicates=conditions, properties={k: str(v) for k, v in (properties or {}).items()}).select(*columns)


def restored_names(df: DataFrame, canonical: list[str]) -> DataFrame:
    """df under the canonical names, in their order, where its labels were folded to upper or lower case; as it is unless every one of its columns is found so."""
    found = {}
    for name in canonical:
        label = next((c for c in (name, name.upper(), name.lower()) if c in df.columns), None)
        if label:
            found[name] = label
    if len(found) != len(df.columns) or all(name == label for name, label in found.items()):
        return df
    return df.select(*[F.col(f"`{label}`").alias(name) for name, label in found.items()])


def full_then_changes(rows: DataFrame, changes: DataFrame, topic: str, database: str, tbl: str, received_ms: int) -> DataFrame:
    """One raw log: the snapshot's rows as r, before every change. rows: the table; changes: a raw log of it."""
    kind = changes.schema["after"].dataType
    image = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kind])
    first = rows.select(
        F.lit(topic).alias("raw_topic"), (F.xxhash64(image).bitwiseAND(F.lit(2**40 - 1)) - 2**41).alias("offset"), F.lit("r").alias("op"), F.lit(None).cast(kind).alias("before"), image.alias("after"),
        F.lit(database).alias("db"), F.lit(tbl).alias("tbl"), F.lit(received_ms).cast("long").alias("ts_ms"),
    )
    return first.unionByName(changes)
