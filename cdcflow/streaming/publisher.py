"""Publishing a raw log that arrives in micro-batches, as the batch operators publish it whole: in order, up to the first record that can't go.

Every micro-batch is a DataFrame, so it goes through operators.events.normalize: windows over blocks of offsets, and no key or topic meets in one task. What a
batch can't know is left to the next: a trailing delete of a topic is held, as the next record may make an update of it, and an empty batch of its topic, or flush(),
lets it go. An owner that has stopped stays stopped over batches and restarts, by a table of where and why; what comes behind is held, not lost, and goes once the
owner is released. An event that stands before the stop still goes, whenever it comes.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.events import normalize, with_changes_only
from ..operators.guards import ORDER, first_refused, place
from ..sources.sinks import _fs

STATE = "owner string, run int, seq long, sub int, reason string, held_from int"


class LogPublisher:
    """Steps, each with its tables in folders of its number: work (events), published, held, carry (deletes that wait), state (a row an owner that has stopped once).

    A step counts once its marker, which has the number of the stream's batch, is written last; a batch that comes again after that is left out, and one that failed before
    is made anew from the same tables of the step before. So every batch has one effect, and a query may be restarted from its checkpoint at any point.
    """

    def __init__(self, spark: SparkSession, root: str, log_schema, keys: list[str], columns: list[str] | None = None, run: int = 0, guard: Callable[[DataFrame], DataFrame] | None = None):
        """log_schema: of the raw log. guard: adds guard_reason to events (null if one may go), and is asked again for what was held."""
        self.spark, self.root, self.log_schema, self.keys, self.columns, self.run_number, self.guard = spark, root.rstrip("/"), log_schema, keys, columns, run, guard
        empty = spark.createDataFrame([], log_schema)
        self.event_schema = normalize(empty, keys, columns, run=run, by_offset=True).schema

    # --- files

    def _path(self, table: str, step: int) -> str:
        return f"{self.root}/{table}/step={step:09d}"

    def _read(self, table: str, steps, schema) -> DataFrame:
        paths = [self._path(table, n) for n in steps]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _all(self, table: str, schema) -> DataFrame:
        """A table's rows of all steps that count, with step."""
        steps = sorted(self.steps())
        schema = T.StructType([*schema, T.StructField("step", T.IntegerType())])
        if not steps:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}").where(F.col("step") <= steps[-1])  # one that failed has the next number

    def _save(self, df: DataFrame, table: str, step: int) -> None:
        df.write.mode("overwrite").parquet(self._path(table, step))

    def steps(self) -> dict[int, int | None]:
        """Number of the stream's batch by step, of the steps that count."""
        p, fs = _fs(self.spark, f"{self.root}/steps")
        if not fs.exists(p) or not fs.listStatus(p):
            return {}
        told = self.spark.read.text(f"{self.root}/steps").collect()  # a line a step
        return {d["step"]: d["batch"] for d in (json.loads(r["value"]) for r in told if r["value"])}

    def _finish(self, step: int, batch: int | None) -> None:
        p, fs = _fs(self.spark, f"{self.root}/steps/{step:09d}")
        out = fs.create(p, True)
        out.writeBytes(json.dumps({"step": step, "batch": batch}) + "\n")
        out.close()

    # --- what is known

    def published(self) -> DataFrame:
        return self._all("published", self.event_schema).drop("step")

    def state(self) -> DataFrame:
        """owner, run, seq, sub, reason (null if it has been released), held_from: a row an owner that has stopped once."""
        return self._read("state", sorted(self.steps())[-1:], STATE)

    def stopped(self) -> DataFrame:
        return self.state().where("reason is not null").drop("held_from")

    def held(self) -> DataFrame:
        """Events that wait behind the stop of their owner."""
        return self._held_of(self.state())

    def _held_of(self, state: DataFrame) -> DataFrame:
        owners = state.select(F.col("owner").alias("raw_topic"), "held_from")
        return self._all("held", self.event_schema).join(owners, "raw_topic").where("step >= held_from").select(*self.event_schema.names)

    def release(self, owner: str) -> None:
        """The reason is dealt with: the next step asks again for what the owner holds, and goes on from there."""
        p, fs = _fs(self.spark, f"{self.root}/releases/{owner.encode().hex()}")
        fs.create(p, True).close()

    def _releases(self) -> list[str]:
        p, fs = _fs(self.spark, f"{self.root}/releases")
        return [bytes.fromhex(s.getPath().getName()).decode() for s in fs.listStatus(p)] if fs.exists(p) else []

    # --- a step

    def run(self, batch: DataFrame, number: int | None = None) -> bool:
        """Publish a batch of the raw log; False if it has been."""
        done = self.steps()
        if number is not None and number in done.values():
            return False
        last = max(done, default=-1)
        step, before = last + 1, [last] if done else []
        fresh = with_changes_only(batch.select(*self.log_schema.names))
        self._save(fresh, "fresh", step)
        fresh = self._read("fresh", [step], self.log_schema)
        log = self._read("carry", before, self.log_schema).unionByName(fresh)
        # the last record of each topic that has new ones waits if it is a delete; of the others, nothing comes after it any more
        ends = fresh.groupBy("raw_topic").agg(F.max("offset").alias("offset"))
        waits = fresh.where("op = 'd'").join(ends, ["raw_topic", "offset"], "left_semi")
        events = normalize(log, self.keys, self.columns, run=self.run_number, by_offset=True)
        waiting = events.where("op = 'DELETE' and reason is null").join(waits.select("raw_topic", F.col("offset").cast("long").alias("seq")), ["raw_topic", "seq"], "left_semi")
        self._save(waits.join(waiting.select("raw_topic", F.col("seq").alias("offset")), ["raw_topic", "offset"], "left_semi").select(*self.log_schema.names), "carry", step)
        carried = self._read("carry", [step], self.log_schema).select("raw_topic", F.col("offset").cast("long").alias("seq"))
        released = self._releases()
        state = self._read("state", before, STATE)
        again = F.col("owner").isin(*released) & F.col("reason").isNotNull()
        events = events.join(carried, ["raw_topic", "seq"], "left_anti").select(*self.event_schema.names)
        events = events.unionByName(self._held_of(state.where(again))) if released else events
        events = self.guard(events) if self.guard else events.withColumn("guard_reason", F.lit(None).cast("string"))
        work = T.StructType([*self.event_schema, T.StructField("guard_reason", T.StringType())])
        self._save(events.select(*work.names), "work", step)
        events = self._read("work", [step], work).withColumn("why", F.coalesce("reason", "guard_reason"))
        # where each owner stops: the earlier of where it stands already and of the first refused now
        new = first_refused(events, "why").select(F.col("raw_topic").alias("owner"), "first_place.*", F.col("first_reason").alias("reason"))
        old = state.select("owner", *ORDER, "reason").where(~again & F.col("reason").isNotNull())
        stops = old.unionByName(new).groupBy("owner").agg(F.min(F.struct(*ORDER, "reason")).alias("s")).select("owner", "s.*")
        since = state.select("owner", F.when(again, step).otherwise(F.col("held_from")).alias("held_from"))
        self._save(stops.join(since, "owner", "full").select("owner", *ORDER, "reason", F.coalesce("held_from", F.lit(0)).alias("held_from")), "state", step)
        stops = self._read("state", [step], STATE).where("reason is not null").select(F.col("owner").alias("raw_topic"), F.struct(*ORDER).alias("stop"))
        both = events.select(*self.event_schema.names).join(stops, "raw_topic", "left")
        goes = F.col("stop").isNull() | (place(events) < F.col("stop"))
        self._save(both.where(goes).drop("stop"), "published", step)
        # what is held has its own reason, but not the guard's, which is asked for again
        self._save(both.where(~goes).drop("stop"), "held", step)
        self._finish(step, number)
        for owner in released:
            p, fs = _fs(self.spark, f"{self.root}/releases/{owner.encode().hex()}")
            fs.delete(p, False)
        return True

    def flush(self) -> None:
        """An empty batch: deletes that wait go, and what released owners hold is asked for again."""
        self.run(self.spark.createDataFrame([], self.log_schema))

    def start(self, log: DataFrame, checkpoint: str, **trigger):
        """Start a query that publishes a stream of the raw log, whose topics arrive in order over batches."""

        def each(batch: DataFrame, number: int) -> None:
            self.run(batch, number)

        return log.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
