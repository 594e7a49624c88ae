"""Watching streams: progress samples, their retention, and stopping only the tables that drifted."""

from __future__ import annotations

import datetime as dt
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.schema import drift
from ..sources.sinks import VersionedTable

RETENTION_DAYS = 7
SAMPLE = "query_id string, name string, batch_id long, input_rows long, rows_per_second double, backlog_rows long, delivered long, last_seq long, last_event_ms long, lag_ms long, sampled_at timestamp, date string"
DELIVERY = "delivery"


def observed(events: DataFrame) -> DataFrame:
    """A stream of events that tells, with each batch's progress, what guards.delivery_stats() tells of a table: taken while the batch goes through, without another pass."""
    last = F.max(F.struct(*[F.col(c).cast("long").alias(c) for c in ("run", "seq", "sub")], "event_ms"))
    return events.observe(DELIVERY, F.count(F.lit(1)).alias("delivered"), last.alias("last"))


def backlog_of(sources: list[dict]) -> int | None:
    """Records that a query's sources have and it has not read, from its progress: the distance of offsets by topic and partition. None where a source doesn't tell offsets."""
    total = 0
    for s in sources:
        end, latest = (json.loads(s[k]) if isinstance(s.get(k), str) else s.get(k) for k in ("endOffset", "latestOffset"))
        if not isinstance(end, dict) or not isinstance(latest, dict) or not all(isinstance(v, dict) for v in latest.values()):
            return None
        total += sum(max(0, n - end.get(topic, {}).get(p, 0)) for topic, parts in latest.items() for p, n in parts.items())
    return total


def progress_row(progress: dict, acknowledged_ms: int) -> tuple:
    """A sample of a progress, as a dict of its JSON; lag is from the last event's time to when the batch was acknowledged, never below 0."""
    at = dt.datetime.fromisoformat(progress["timestamp"].replace("Z", "+00:00"))
    told = (progress.get("observedMetrics") or {}).get(DELIVERY) or {}
    last = told.get("last") or {}
    lag = max(0, acknowledged_ms - last["event_ms"]) if last.get("event_ms") is not None else None
    rows = (progress["batchId"], progress["numInputRows"], float(progress.get("processedRowsPerSecond") or 0), backlog_of(progress.get("sources") or []))
    return (progress["id"], progress.get("name"), *rows, told.get("delivered"), last.get("seq"), last.get("event_ms"), lag, at, at.date().isoformat())


class ProgressSamples(StreamingQueryListener):
    """Appends a row for each progress of each stream to a table by date. A failed write is dropped: samples never stop a stream."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        try:
            row = progress_row(json.loads(event.progress.json), int(time.time() * 1000))
            self.spark.createDataFrame([row], SAMPLE).write.mode("append").partitionBy("date").parquet(self.path)
        except Exception as e:
            print(f"a progress sample was not kept: {e}")


def prune_samples(spark: SparkSession, path: str, today: dt.date, days: int = RETENTION_DAYS) -> list[str]:
    """Delete the date partitions older than `days`; returns their dates."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs, gone = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), []
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        if name.startswith("date=") and name[5:] < (today - dt.timedelta(days=days)).isoformat():
            fs.delete(status.getPath(), True)
            gone.append(name[5:])
    return sorted(gone)


def stop_drifted(queries: dict[str, StreamingQuery], drifted: DataFrame) -> list[str]:
    """Stop the streams of the tables that drift() found changed, a name a table; the others go on."""
    names = [r["table_name"] for r in drifted.where(F.col("change_type").isNotNull() & F.col("table_name").isin(*queries)).select("table_name").collect()]
    for name in names:
        queries[name].stop()
    return sorted(names)


class DriftScan:
    """Looks at the tables' schemas from time to time, and stops the streams of those that changed since their baseline; the others go on.

    Baselines (column and key metadata of each table, as operators.schema has them) are versioned tables below root. A table that has none yet gets one and no event; a changed
    table keeps its old one until accept(), so it stays told as long as it differs.
    """

    def __init__(self, spark: SparkSession, root: str, read: Callable[[], tuple[DataFrame, DataFrame]], queries: dict[str, StreamingQuery]):
        self.spark, self.read, self.queries = spark, read, queries
        self.columns, self.keys = VersionedTable(spark, f"{root}/columns"), VersionedTable(spark, f"{root}/keys")

    def baseline(self, columns: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
        return tuple(t.read() if t.current() else self.spark.createDataFrame([], df.schema) for t, df in ((self.columns, columns), (self.keys, keys)))

    def _set(self, tables: DataFrame, columns: DataFrame, keys: DataFrame) -> None:
        """Take the tables' baselines from what is there now."""
        for t, old, new in zip((self.columns, self.keys), self.baseline(columns, keys), (columns, keys)):
            version = t.current() or 0
            t.overwrite(old.join(tables, "table_name", "left_anti").unionByName(new.join(tables, "table_name", "left_semi")), after=version)

    def scan(self) -> list[tuple[str, str, str]]:
        """(table, change, risk) of the tables that differ from their baseline; their streams are stopped."""
        columns, keys = self.read()
        known, known_keys = self.baseline(columns, keys)
        fresh = columns.select("table_name").distinct().join(known.select("table_name"), "table_name", "left_anti")
        changed = drift(known, known_keys, columns, keys).where("change_type is not null")
        found = sorted((r["table_name"], r["change_type"], r["risk_level"]) for r in changed.collect())  # a row a changed table
        if not fresh.isEmpty():
            self._set(fresh, columns, keys)
        stop_drifted(self.queries, self.spark.createDataFrame([f[:2] for f in found], "table_name string, change_type string"))
        return found

    def accept(self, table: str) -> None:
        """The change is dealt with: what is there now is the table's baseline."""
        self._set(self.spark.createDataFrame([(table,)], "table_name string"), *self.read())

    def start(self, seconds: int, checkpoint: str) -> StreamingQuery:
        """Scan every so many seconds until the query is stopped. A scan that fails is told and tried again."""

        def each(batch: DataFrame, number: int) -> None:
            try:
                self.scan()
            except Exception as e:
                print(f"a drift scan failed: {e}")

        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return ticks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
