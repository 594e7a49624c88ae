"""Normalising, serialising and applying a literal change log."""

import json

import pytest
from pyspark.sql import functions as F

from cdcflow.operators import apply, events, formats, guards
from cdcflow.plans.spec import SyncSpec, resolve_columns, resolve_key

ROW = "struct<id:bigint,name:string,note:string>"
SCHEMA = f"raw_topic string, offset long, op string, before {ROW}, after {ROW}, db string, tbl string, ts_ms long"


def log(spark, *records):
    """records: (op, before, after), rows as (id, name, note)."""
    rows = [("t", i, op, b, a, "app", "people", 1000 * i) for i, (op, b, a) in enumerate(records)]
    return spark.createDataFrame(rows, SCHEMA)


def ops(df):
    return [(r["op"], json.loads(r["key"])["id"], r["seq"], r["sub"]) for r in df.orderBy("seq", "sub").collect()]


A, A2, B = (1, "a", None), (1, "b", None), (2, "z", "n")


def test_split_update_is_one_update(spark):
    df = events.normalize(log(spark, ("d", A, None), ("c", None, A2)), ["id"])
    (r,) = df.collect()
    assert (r["op"], r["before"]["name"], r["data"]["name"], r["event_ms"]) == ("UPDATE", "a", "b", 1000)


def test_other_key_does_not_merge(spark):
    assert ops(events.normalize(log(spark, ("d", A, None), ("c", None, B)), ["id"])) == [("DELETE", 1, 0, 0), ("INSERT", 2, 1, 0)]


def test_only_the_record_just_before_merges(spark):
    df = events.normalize(log(spark, ("d", A, None), ("d", A, None), ("c", None, A2)), ["id"])
    assert [o[0] for o in ops(df)] == ["DELETE", "UPDATE"]
    df = events.normalize(log(spark, ("d", A, None), ("u", B, B), ("c", None, A2)), ["id"])
    assert [o[0] for o in ops(df)] == ["DELETE", "UPDATE", "INSERT"]


def test_trailing_delete_and_records_without_op(spark):
    df = events.normalize(log(spark, ("c", None, A), (None, None, None), ("d", A, None)), ["id"])
    assert ops(df) == [("INSERT", 1, 0, 0), ("DELETE", 1, 1, 0)]


def test_tombstone_between_does_not_part_a_pair(spark):
    assert [o[0] for o in ops(events.normalize(log(spark, ("d", A, None), (None, None, None), ("c", None, A2)), ["id"]))] == ["UPDATE"]


def test_key_change_is_delete_and_insert(spark):
    df = events.normalize(log(spark, ("u", A, B)), ["id"])
    assert ops(df) == [("DELETE", 1, 0, 0), ("INSERT", 2, 0, 1)]
    assert df.where("sub = 1").first()["before"] is None


def test_update_without_before_and_phases(spark):
    df = events.normalize(log(spark, ("r", None, A), ("u", None, A2), ("c", None, B)), ["id"], snapshot_count=2)
    assert [r["phase"] for r in df.orderBy("seq").collect()] == ["SNAPSHOT", "SNAPSHOT", "CDC"]


def test_unreliable_records_are_named(spark):
    df = log(spark, ("x", None, A), ("c", None, (None, "q", None))).withColumn("reason", events.unreliable(["id"]))
    assert [r["reason"] for r in df.orderBy("offset").collect()] == ["unknown op", "missing key"]


def test_normalize_carries_why_and_publishing_stops_there(spark):
    df = events.normalize(log(spark, ("c", None, A), ("z", None, B), ("c", None, (3, "c", None))), ["id"])
    goes, held = guards.publish_prefix(df)
    assert ops(goes) == [("INSERT", 1, 0, 0)]
    assert [(r["seq"], r["first_reason"]) for r in held.orderBy("seq").collect()] == [(1, "unknown op"), (2, "unknown op")]
    with pytest.raises(Exception, match="unreliable record"):
        apply.applied(df).collect()


@pytest.mark.parametrize("record, reason", [((" ", None, A), "missing op"), (("u", (None, "q", None), A), "missing key"), (("d", None, None), "missing key"), (("c", None, None), "missing key")])
def test_reasons(spark, record, reason):
    assert [r["reason"] for r in events.normalize(log(spark, record), ["id"]).collect()] == [reason]


def test_a_delete_before_an_insert_without_key_is_refused_too(spark):
    df = events.normalize(log(spark, ("d", A, None), ("c", None, (None, "q", None))), ["id"])
    assert [(r["seq"], r["reason"]) for r in df.orderBy("seq").collect()] == [(0, "missing key"), (1, "missing key")]


def test_snapshot_count_is_by_topic(spark):
    both = log(spark, ("c", None, A), ("c", None, B)).unionByName(log(spark, ("c", None, A), ("c", None, B)).withColumn("raw_topic", F.lit("u")).withColumn("offset", F.col("offset") + 900))
    df = events.normalize(both, ["id"], snapshot_count=1)
    assert [(r["raw_topic"], r["seq"], r["phase"]) for r in df.orderBy("seq").collect()] == [("t", 0, "SNAPSHOT"), ("t", 1, "CDC"), ("u", 2, "SNAPSHOT"), ("u", 3, "CDC")]


def test_a_later_run_comes_after_all_of_an_earlier_one(spark):
    rows = spark.createDataFrame([A], "id long, name string, note string")
    first = events.normalize(log(spark, ("u", A, A2)), ["id"])
    again = events.snapshot_events(rows, ["id"], "app", "people", F.lit(0), run=1)
    assert [tuple(r) for r in apply.applied(events.snapshot_then_changes(again, first)).collect()] == [A]
    assert [tuple(r) for r in apply.applied(events.snapshot_then_changes(events.snapshot_events(rows, ["id"], "app", "people", F.lit(0)), first)).collect()] == [A2]


def test_neighbours_reach_over_holes_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(events, "BLOCK", 4)
    far = log(spark, ("d", A, None), ("c", None, A2), ("c", None, B)).withColumn("offset", F.col("offset") * 1000 + 3)
    assert ops(events.normalize(far, ["id"])) == [("UPDATE", 1, 0, 0), ("INSERT", 2, 2, 0)]


def test_partition_count_and_blocks_do_not_matter(spark, monkeypatch):
    records = [("d", A, None), ("c", None, A2)] * 20 + [("u", A, B)] * 3
    want = ops(events.normalize(log(spark, *records), ["id"]))
    monkeypatch.setattr(events, "BLOCK", 3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert ops(events.normalize(log(spark, *records).repartition(5), ["id"])) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def value(spark, name, *records):
    df = formats.serialize(events.normalize(log(spark, *records), ["id"]), ["id"], name)
    return [r["value"] for r in df.orderBy("seq", "sub").collect()]


def test_formats(spark):
    update = (("d", A, None), ("c", None, A2))
    assert value(spark, None, *update) == [
        '{"op":"UPDATE","key":{"id":1},"data":{"id":1,"name":"b","note":null},"before":{"id":1,"name":"a","note":null},"source":{"database":"app","table":"people"},"sourceEventTime":"1970-01-01T00:00:01Z","phase":"CDC"}'
    ]
    assert value(spark, "CANAL_JSON", *update) == [
        '{"type":"UPDATE","database":"app","table":"people","es":1000,"ts":1000,"data":[{"id":1,"name":"b","note":null}],"old":[{"name":"a","note":null}],"pkNames":["id"],"isDdl":false,"sql":""}'
    ]
    assert value(spark, "COMPATIBLE_DEBEZIUM_JSON", ("r", None, A)) == [
        '{"before":null,"after":{"id":1,"name":"a","note":null},"op":"r","ts_ms":0,"source":{"db":"app","table":"people","ts_ms":0,"snapshot":"true"},"transaction":null}'
    ]
    assert value(spark, "MAXWELL_JSON", ("c", None, A)) == ['{"database":"app","table":"people","type":"insert","ts":0,"data":{"id":1,"name":"a","note":null},"primary_key_columns":["id"]}']
    assert value(spark, "OGG_JSON", ("d", A, None)) == [
        '{"table":"app.people","op_type":"D","op_ts":"1970-01-01 00:00:00.000000","before":{"id":1,"name":"a","note":null},"after":null,"primary_keys":["id"]}'
    ]
    bare = ("u", None, A)
    assert '"old":[{}]' in value(spark, "CANAL_JSON", bare)[0] and '"old":{}' in value(spark, "MAXWELL_JSON", bare)[0]
    with pytest.raises(ValueError):
        formats.chosen_format("XML")


def test_only_inserts_of_a_snapshot_are_reads(spark):
    records = (("c", None, B), ("u", A, A2), ("d", A, None))
    df = formats.serialize(events.normalize(log(spark, *records), ["id"], snapshot_count=3), ["id"], "COMPATIBLE_DEBEZIUM_JSON")
    assert [(json.loads(r["value"])["op"], json.loads(r["value"])["source"]["snapshot"]) for r in df.orderBy("seq").collect()] == [("r", "true"), ("u", "true"), ("d", "true")]


def test_apply_is_replay_safe(spark):
    e = events.normalize(log(spark, ("c", None, A), ("u", A, A2), ("c", None, B), ("d", B, None), ("d", (9, "q", None), None)), ["id"])
    assert [tuple(r) for r in apply.applied(e).collect()] == [A2] == [tuple(r) for r in apply.applied(e.unionByName(e)).collect()]
    assert [tuple(r) for r in apply.applied(e, F.lit(0)).collect()] == [A]
    base = spark.createDataFrame([(2, "old", None), (3, "kept", None)], "id long, name string, note string")
    assert sorted(tuple(r) for r in apply.merged_into(base, e, ["id"]).collect()) == [A2, (3, "kept", None)]


def test_spec():
    assert resolve_columns(["Id", "Name"], ["NAME", "name", " id "], ["id"]) == ["Name", "Id"]
    with pytest.raises(ValueError):
        resolve_columns(["Id", "Name"], ["name"], ["Id"])
    assert resolve_key([["Id"], ["A", "B"]], ["a", "b"]) == ["A", "B"]
    with pytest.raises(ValueError):
        resolve_key([["A", "B"]], ["b", "a"])
    spec = SyncSpec("app", "people", ["id"], ["id", "name"])
    assert spec.fingerprint() == SyncSpec("app", "people", ["id"], ["id", "name"], output_format="OGG_JSON").fingerprint() != SyncSpec("app", "people", ["id"], ["id"]).fingerprint()
