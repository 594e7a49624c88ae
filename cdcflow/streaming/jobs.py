"""Structured Streaming forms: the split-update merge with held deletes, alert transitions, and apply with a checkpoint."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.apply import latest_changes
from ..operators.events import key_text, unreliable

RECORD = "raw_topic string, offset long, op string, key string, before string, after string, db string, tbl string, ts_ms long, reason string"
EVENT = "raw_topic string, offset long, op string, key string, before string, data string, event_ms long, reason string"
_HELD = "offset long, before string, db string, tbl string, ts_ms long"
#: What the merge reads of a record, packed as one JSON array of texts: in the row API every cell of a row has its price, and it is higher than that of the parsing.
_FIELDS = ("offset", "op", "before", "after", "db", "tbl", "ts_ms", "reason")
_EVENT = Row("raw_topic", "offset", "op", "key", "before", "data", "event_ms", "reason")
#: Ops of the halves of a key-changing u, which no source writes: a delete that is never held, and an insert that never makes an update of a held one.
OLD_KEY, NEW_KEY = "u-", "u+"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_records(log: DataFrame, keys: list[str]) -> DataFrame:
    """The log with images as JSON text, the key of the image that the record is about, and why it can't be published, or null."""
    text = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    kind = log.schema["after"].dataType
    key = F.when(F.col("op").isin("d", OLD_KEY), key_text("before", keys, kind)).otherwise(key_text("after", keys, kind))
    reason = F.when(~F.col("op").isin(OLD_KEY, NEW_KEY), unreliable(keys, kind))
    return log.where("op is not null").select("raw_topic", "offset", "op", key.alias("key"), text("before").alias("before"), text("after").alias("after"), "db", "tbl", "ts_ms", reason.alias("reason"))


def _values(rows: Iterator[Row]) -> Iterator[tuple]:
    """_FIELDS of packed records."""
    for r in rows:
        offset, op, before, after, db, tbl, ts_ms, reason = json.loads(r["record"])
        yield offset and int(offset), op, before, after, db, tbl, ts_ms and int(ts_ms), reason


class MergeSplitUpdates(StatefulProcessor):
    """Holds a key's last delete, as a typed value, until the key's next record or a timer comes."""

    def __init__(self, hold_ms: int):
        self.hold_ms = hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", _HELD)

    @staticmethod
    def _let_go(key: tuple, held: tuple) -> Row:
        offset, before, _, _, ts_ms = held
        return _EVENT(key[0], offset, "DELETE", key[1], before, before, ts_ms, None)

    def _forget(self) -> None:
        self.held.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # the state is another process': it is read and written once for all of a key's rows of a batch, and not for each
        was = held = self.held.get()
        topic, text = key
        for offset, op, before, after, db, tbl, ts_ms, reason in sorted(_values(rows), key=itemgetter(0)):  # they come in no order
            if held and op == "c" and not reason and offset == held[0] + 1 and (db, tbl) == (held[2], held[3]):
                yield _EVENT(topic, held[0], "UPDATE", text, held[1], after, max(held[4], ts_ms), None)
                held = None
                continue
            if held:
                yield self._let_go(key, held)
                held = None
            if reason:
                yield _EVENT(topic, offset, None, text, None, None, ts_ms, reason)
            elif op == OLD_KEY:
                yield _EVENT(topic, offset, "DELETE", text, before, before, ts_ms, None)
            elif op == "d":
                held = (offset, before, db, tbl, ts_ms)
            else:
                yield _EVENT(topic, offset, "UPDATE" if op == "u" else "INSERT", text, before, after, ts_ms, None)
        if was:
            self._forget()  # every record of its key settles it
        if held:
            self.held.update(held)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.hold_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.held.get()
        if held:
            self._forget()
            yield self._let_go(key, held)


def merge_stream(records: DataFrame, hold_ms: int = 10_000) -> DataFrame:
    """Events of a stream of keyed_records whose offsets have no holes: a d is held, across batches and restarts, until the next record of its key or hold_ms pass.

    A d whose successor in the log is a c of its key becomes one UPDATE. Key changes (u with another key before) are split by moved_apart() first. A record with a reason becomes a
    row with it and without op; streaming.publisher stops its topic there. With its timers a query goes on for ever under availableNow: run it once, or by processing time. State is kept in RocksDB, a row a key that holds a delete; the session's provider is set to it.
    """
    records.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    packed = records.select("raw_topic", "key", F.to_json(F.array(*[F.col(c).cast("string") for c in _FIELDS])).alias("record"))
    return packed.groupBy("raw_topic", "key").transformWithState(MergeSplitUpdates(hold_ms), EVENT, "append", "processingTime")


def held_deletes(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The events of the deletes that a merge_stream of this checkpoint, which has ended, still holds: at the end of input nothing can follow them."""
    state = spark.read.format("statestore").option("stateVarName", "held").load(checkpoint).select("key.raw_topic", "key.key", "value.*").where("offset is not null")
    return state.select("raw_topic", "offset", F.lit("DELETE").alias("op"), "key", "before", F.col("before").alias("data"), F.col("ts_ms").alias("event_ms"), F.lit(None).cast("string").alias("reason"))


def moved_apart(log: DataFrame, keys: list[str]) -> DataFrame:
    """Records with each key-changing u, if it can be published, replaced by an OLD_KEY and a NEW_KEY record."""
    kind = log.schema["after"].dataType
    moved = (F.col("op") == "u") & (key_text("before", keys, kind) != key_text("after", keys, kind)) & unreliable(keys, kind).isNull()
    none = F.lit(None).cast(log.schema["before"].dataType)
    parts = F.when(
        F.coalesce(moved, F.lit(False)),
        F.array(F.struct(F.lit(OLD_KEY).alias("op"), F.col("before"), none.alias("after")), F.struct(F.lit(NEW_KEY).alias("op"), none.alias("before"), F.col("after"))),
    ).otherwise(F.array(F.struct("op", "before", "after")))
    rest = [c for c in log.columns if c not in ("op", "before", "after")]
    return log.select(*rest, F.explode(parts).alias("p")).select(*rest, "p.op", "p.before", "p.after")


class AlertTransitions(StatefulProcessor):
    """Remembers which status an owner was last alerted about."""

    def __init__(self, alerting: list[str]):
        self.alerting = frozenset(alerting)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.due = handle.getValueState("due", "due string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        was = self.due.get()[0] if self.due.exists() else None
        for r in sorted(rows, key=lambda r: (r.sampled_at, r.sample_id)):  # of one batch
            due = r.status if r.status in self.alerting else None
            if due and due != was:
                yield Row(owner_id=key[0], status=r.status, sampled_at=r.sampled_at, sample_id=r.sample_id)
            was = due
        self.due.update((was,)) if was else self.due.clear()


def alert_stream(states: DataFrame, alerting: list[str]) -> DataFrame:
    """owner_id, status, sampled_at, sample_id of each entry into an alerting status, over batches, in the order of time and sample_id. states: the same columns."""
    states.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    return states.groupBy("owner_id").transformWithState(AlertTransitions(alerting), "owner_id long, status string, sampled_at timestamp, sample_id long", "append", "none")


def apply_stream(events: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Start a query that hands each batch's last change of every key, and the batch's number, to write.

    Positions are committed after write returns, so a batch may come again: write must be idempotent, by key or by batch number.
    """
    def each(batch: DataFrame, number: int) -> None:
        write(latest_changes(batch), number)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
