"""Lookups and audits over jobs, owners and stored objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_target_type(jobs: DataFrame, groups: DataFrame, sources: DataFrame) -> DataFrame:
    """jobs (job_id, group_id, target_id) with target_type: by its own target, or its group's."""
    g = groups.select(F.col("group_id"), F.col("target_id").alias("g_target"))
    df = jobs.join(g, "group_id", "left").withColumn("t", F.coalesce("target_id", "g_target"))
    return df.join(sources.select(F.col("data_source_id").alias("t"), "target_type"), "t", "left").drop("t", "g_target")


#: Statuses in which a group is live, and statuses of an item that are alerted.
LIVE_GROUP = ("RUNNING", "DEGRADED")
ALERTED_ITEM = ("FAILED", "DDL_BLOCKED")
BRIDGE_STOPPED = "KAFKA_BRIDGE_STOPPED"


def gated_items(items: DataFrame, groups: DataFrame) -> DataFrame:
    """items (group_id, status, stopped: does its bridge stand still) with due: the status to alert about, BRIDGE_STOPPED for a running item whose bridge stands still, or null.

    groups: group_id, status. Nothing is due while the group isn't live, or is unknown.
    """
    live = groups.where(F.col("status").isin(*LIVE_GROUP)).select("group_id", F.lit(True).alias("live"))
    due = F.when(F.col("status").isin(*ALERTED_ITEM), F.col("status")).when((F.col("status") == "RUNNING") & F.col("stopped"), BRIDGE_STOPPED)
    return items.join(live, "group_id", "left").withColumn("due", F.when(F.col("live"), due)).drop("live")


def retention_audit(registry: DataFrame, owners: DataFrame, as_of: Column, grace_hours: int) -> DataFrame:
    """topic_name, reason, due: registered raw logs that no live owner uses (OWNER_GONE, OTHER_TARGET, OTHER_VERSION); due once retired before that many hours ago.

    registry: topic_name, owner_id, data_source_id, config_version, retired_time. owners: owner_id, data_source_id, config_version.
    """
    o = owners.select("owner_id", F.col("data_source_id").alias("o_source"), F.col("config_version").alias("o_version"), F.lit(True).alias("there"))
    df = registry.join(o, "owner_id", "left")
    reason = F.when(F.col("there").isNull(), "OWNER_GONE").when(F.col("data_source_id") != F.col("o_source"), "OTHER_TARGET").when(F.col("config_version") != F.col("o_version"), "OTHER_VERSION")
    due = F.coalesce(F.col("retired_time") < as_of - F.expr(f"INTERVAL {grace_hours} HOURS"), F.lit(False))
    return df.withColumn("reason", reason).where("reason is not null").select("topic_name", "reason", due.alias("due"))


def unreferenced(checkpoints: DataFrame, task_refs: DataFrame, item_refs: DataFrame, as_of: Column, grace_hours: int) -> DataFrame:
    """checkpoint_id of those last written before grace_hours ago that neither tasks nor items name."""
    used = task_refs.select("checkpoint_id").union(item_refs.select("checkpoint_id")).distinct()
    idle = checkpoints.where(F.col("modified_at") < as_of - F.expr(f"INTERVAL {grace_hours} HOURS"))
    return idle.join(used, "checkpoint_id", "left_anti").select("checkpoint_id")
