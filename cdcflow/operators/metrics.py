"""Run metrics: samples of owners over time. Columns: sample_id, owner_id, sampled_at and what is measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import number_from

MINUTES = (5, 60, 1440)  # least, default, most
FAILED = ("FAILED", "REINITIALIZE_REQUIRED", "DDL_BLOCKED")


def latest_per_owner(samples: DataFrame) -> DataFrame:
    """The newest sample of each owner; of equal times the larger sample_id."""
    rest = [c for c in samples.columns if c != "owner_id"]
    return samples.groupBy("owner_id").agg(F.max_by(F.struct(*rest), F.struct("sampled_at", "sample_id")).alias("s")).select("owner_id", "s.*")


#: Samples of one owner are ordered within blocks of this many seconds; a block is what one window holds.
BLOCK_SECONDS = 3600
_ORDER = ("sampled_at", "sample_id")


def _in_blocks(samples: DataFrame, link: Column) -> DataFrame:
    """samples with place (number among its owner's, from 0), n (how many the owner has) and prev (the link of the one before), in the order of time and sample_id.

    Rows are ordered within an owner's hour; the hours' counts and last rows, a row an hour, tell the rest, so no owner, however many samples it has, meets
    in one task.
    """
    df = samples.withColumns({"_block": F.floor(F.unix_seconds("sampled_at") / BLOCK_SECONDS), "_link": link})
    hours = df.groupBy("owner_id", "_block").agg(F.count("*").alias("rows"), F.max_by("_link", F.struct(*_ORDER)).alias("last"))
    w = Window.partitionBy("owner_id").orderBy("_block")
    before = F.coalesce(F.sum("rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hours = hours.select("owner_id", "_block", before.alias("_before"), F.lag("last").over(w).alias("_last"), F.sum("rows").over(Window.partitionBy("owner_id")).alias("n"))
    inside = Window.partitionBy("owner_id", "_block").orderBy(*_ORDER)
    # a null owner is an owner too
    hours = hours.withColumnsRenamed({"owner_id": "h_owner", "_block": "h_block"})
    out = df.join(hours, F.col("owner_id").eqNullSafe(F.col("h_owner")) & (F.col("_block") == F.col("h_block")))
    place = F.col("_before") + F.row_number().over(inside) - 1
    first = F.row_number().over(inside) == 1
    return out.withColumns({"place": place, "prev": F.when(first, F.col("_last")).otherwise(F.lag("_link").over(inside))}).drop("_block", "_link", "_before", "_last", "h_owner", "h_block")


def series_window(samples: DataFrame, as_of: Column, minutes: int | None = None, max_points: int = 200) -> DataFrame:
    """Samples of the last minutes (5 to 1440, 60 if not said), the first 4 * max_points of each owner by time."""
    m = min(max(minutes or MINUTES[1], MINUTES[0]), MINUTES[2])
    inside = samples.where(F.col("sampled_at") >= as_of - F.expr(f"INTERVAL {m} MINUTES"))
    return _in_blocks(inside, F.lit(0)).where(F.col("place") < 4 * max_points).drop("place", "n", "prev")


def thinned(samples: DataFrame, max_points: int) -> DataFrame:
    """Every k-th sample of an owner and the last one, k = ceil(n / max_points); all where max_points is below 2 or enough."""
    if max_points < 2:
        return samples
    stride = F.ceil(F.col("n") / max_points)
    df = _in_blocks(samples, F.lit(0))
    return df.where((F.col("n") <= max_points) | (F.pmod("place", stride) == 0) | (F.col("place") == F.col("n") - 1)).drop("n", "place", "prev")


def alert_transitions(states: DataFrame, alerting: Column) -> DataFrame:
    """Rows at which an owner enters an alerting status, or goes from one to another. states: owner_id, status, sampled_at, sample_id."""
    due = F.when(alerting, F.col("status"))
    df = _in_blocks(states, F.struct(due.alias("due"))).withColumn("due", due)
    return df.where(F.col("due").isNotNull() & ~F.col("due").eqNullSafe(F.col("prev.due"))).drop("due", "place", "n", "prev")


def latest_open_event(events: DataFrame) -> DataFrame:
    """item_id, event_id, status of the newest unresolved event of each item."""
    return events.where(F.col("resolved_at").isNull()).groupBy("item_id").agg(F.max_by(F.struct("event_id", "status"), F.struct("detected_at", "event_id")).alias("e")).select("item_id", "e.*")


def sample_figures(received: Column, committed: Column, event_ms: Column, commit_ms: Column) -> tuple[Column, Column]:
    """(backlog, lag in seconds) of a sample whose numbers may be text: null where one is missing or unreadable, lag also where the commit is before the event."""
    r, c, e, m = map(number_from, (received, committed, event_ms, commit_ms))
    backlog = F.when(r.isNotNull() & c.isNotNull(), F.greatest(F.lit(0), r - c))
    return backlog, F.when(m >= e, F.floor((m - e) / 1000))


def overview(tasks: DataFrame, items: DataFrame) -> DataFrame:
    """total, running, failed, checked_rows, avg_lag of tasks and items together. Both: status, checked_rows, lag; the average is of tasks, rounded, null without any."""
    both = tasks.select("status", "checked_rows", "lag", F.lit(True).alias("is_task")).unionByName(items.select("status", "checked_rows", "lag", F.lit(False).alias("is_task")))
    n = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")
    return both.agg(
        F.count("*").alias("total"), n(F.col("status") == "RUNNING").alias("running"), n(F.col("status").isin(*FAILED)).alias("failed"),
        F.coalesce(F.sum("checked_rows"), F.lit(0)).alias("checked_rows"), F.round(F.avg(F.when(F.col("is_task"), F.col("lag")))).cast("long").alias("avg_lag"),
    )


def counts_by_status(jobs: DataFrame) -> DataFrame:
    """status (blank is DRAFT), jobs."""
    status = F.when(F.coalesce(F.trim("status"), F.lit("")) == "", "DRAFT").otherwise(F.col("status"))
    return jobs.groupBy(status.alias("status")).agg(F.count("*").alias("jobs"))


def counts_by_target(jobs: DataFrame) -> DataFrame:
    """target_type, jobs, running; jobs whose target is unknown are left out."""
    return jobs.where("target_type is not null").groupBy("target_type").agg(F.count("*").alias("jobs"), F.sum(F.when(F.col("status") == "RUNNING", 1).otherwise(0)).cast("long").alias("running"))


def group_status(groups: DataFrame, items: DataFrame) -> DataFrame:
    """group_id, status: from the items' statuses, the first rule that fits; a group without items is a DRAFT."""
    isolated, running = F.col("status").isin(*FAILED), F.col("status") == "RUNNING"
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    every = lambda c: F.coalesce(F.every(c), F.lit(False))
    per = items.groupBy("group_id").agg(
        any_(isolated).alias("bad"), any_(running).alias("run"), any_(F.col("status") == "PAUSING").alias("pausing"), every(F.col("status") == "PAUSED").alias("paused"),
        every(F.col("status").isin("STOPPED", "FINISHED")).alias("stopped"),
    )
    status = F.when(F.col("bad") & F.col("run"), "DEGRADED").when(F.col("bad"), "FAILED").when(F.col("run"), "RUNNING").when(F.col("pausing"), "PAUSING").when(F.col("paused"), "PAUSED").when(F.col("stopped"), "STOPPED").otherwise("DRAFT")
    return groups.select("group_id").join(per, "group_id", "left").select("group_id", status.alias("status"))


#: An engine's job statuses by what the platform calls them, and the states that a job starts in.
PLATFORM = {
    "RUNNING": ("RUNNING", "STARTING", "INITIALIZING", "CREATED", "PENDING", "SCHEDULED", "RESTARTING"),
    "PAUSING": ("DOING_SAVEPOINT",),
    "PAUSED": ("SAVEPOINT_DONE",),
    "STOPPED": ("CANCELING", "CANCELLING", "CANCELED", "CANCELLED"),
    "FINISHED": ("FINISHED",),
}
STARTUP = ("INITIALIZING", "CREATED", "PENDING", "SCHEDULED", "STARTING")
#: Words of an error that means a job can't go on from where it was.
RECOVERY_WORDS = ("checkpoint", "savepoint", "binlog", "offset", "restore", "恢复", "位点", "日志已过期")


def platform_status(engine: Column) -> Column:
    """Platform status of an engine's job status; an unknown one, or none, is FAILED."""
    out = F.when(engine.isNull(), "FAILED")
    for status, names in PLATFORM.items():
        out = out.when(F.upper(engine).isin(*names), status)
    return out.otherwise("FAILED")


def needs_reinitialising(error: Column) -> Column:
    """Does an error's text say that the job can't go on from where it was?"""
    return F.coalesce(F.lower(error).rlike("|".join(RECOVERY_WORDS)), F.lit(False))


def job_phase(mode: Column, engine: Column) -> Column:
    """What a job does: FULL only takes snapshots, INCREMENTAL only follows changes, and others take a snapshot while they start and are MIXED afterwards."""
    starting = F.coalesce(F.upper(engine).isin(*STARTUP), F.lit(False))
    return F.when(F.upper(mode) == "FULL", "SNAPSHOT").when(F.upper(mode) == "INCREMENTAL", "CDC").when(starting, "SNAPSHOT").otherwise("MIXED")
