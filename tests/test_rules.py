"""Rules with literal cases: decoding, checks, gates, sizes, drift, publishing."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from cdcflow import queries
from cdcflow.functions import decode, text
from cdcflow.operators import events, formats, guards, metrics, reconcile, reports, schema
from cdcflow.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("given, want", [("12.50", "12.5"), ("12.00", "12"), ("0.0000", "0"), ("-0.50", "-0.5"), ("12345678901234567890123.00", "12345678901234567890123"), ("11.01", "11.01"), ("-3.00", "-3"), ("0.001", "0.001")])
def test_decimals_lose_their_zeros(spark, given, want):
    assert one(spark, decode.decimal_text(F.lit(given).cast("decimal(38,4)"))) == want


def test_decimals_in_formats(spark):
    row = "struct<id:bigint,price:decimal(12,2),name:string>"
    rows = [("t", 0, "u", (1, 12.50, "a"), (1, 12.00, "a")), ("t", 1, "d", (2, None, None), None)]
    df = spark.createDataFrame(rows, f"raw_topic string, offset long, op string, before struct<id:bigint,price:double,name:string>, after struct<id:bigint,price:double,name:string>")
    df = df.select("raw_topic", "offset", "op", F.col("before").cast(row).alias("before"), F.col("after").cast(row).alias("after"), F.lit("app").alias("db"), F.lit("p").alias("tbl"), F.lit(5).cast("long").alias("ts_ms"))
    values = [r["value"] for r in formats.serialize(events.normalize(df, ["id"]), ["id"], "MAXWELL_JSON").orderBy("seq").collect()]
    assert '"data":{"id":1,"price":12,"name":"a"},"old":{"price":12.5}' in values[0] and '"data":{"id":2,"price":null,"name":null}' in values[1]
    keyed = events.normalize(df, ["id", "price"]).where("reason is null").orderBy("seq", "sub").collect()
    assert [r["key"] for r in keyed] == ['{"id":1,"price":12.5}', '{"id":1,"price":12}']


def envelope(columns, before, after, op="u", ts=7, source_ts=0):
    fields = [{"type": t, "field": n, **({"name": logical} if logical else {}), **({"parameters": p} if p else {})} for n, t, logical, p in columns]
    body = {"schema": {"type": "struct", "fields": [{"type": "struct", "field": i, "fields": fields} for i in ("before", "after")]}, "payload": {"before": before, "after": after, "op": op, "source": {"db": "d", "table": "t", "ts_ms": source_ts}, "ts_ms": ts}}
    return json.dumps(body, separators=(",", ":"), ensure_ascii=False)


BASE = [("id", "int64", None, None), ("ok", "int16", None, {"__debezium.source.column.type": "TINYINT", "__debezium.source.column.length": "1"})]


def test_records_are_decoded_by_their_own_schema(spark):
    wide = [*BASE, ("a b", "string", None, None), ("tags", "array", None, None), ("big", "int64", None, None), ("p", "bytes", "org.apache.kafka.connect.data.Decimal", {"scale": "3"})]
    values = [
        envelope(BASE, None, {"id": 1, "ok": 1}, "c"),
        envelope(wide, {"id": 1, "ok": 0, "a b": "x\"y", "tags": ["q", 1], "big": 2**64, "p": 1.5}, {"id": 2, "ok": None}, "u", source_ts=3),
        envelope([], None, {"id": 3}, "c"),
        envelope(BASE, None, None, None),
        None,
        '{"before":null,"after":{"id":5,"x":2.50},"op":"c","source":{"database":"d","table":"t"},"ts_ms":9}',
        '{"id":6}',
    ]
    raw = spark.createDataFrame([("raw", i, v) for i, v in enumerate(values)], "raw_topic string, offset long, value string")
    got = {r["offset"]: r for r in decode.decode_by_schema(raw).collect()}
    assert set(got) == {0, 1, 2, 5, 6}
    assert (got[0]["before"], got[0]["after"], got[0]["ts_ms"]) == (None, '{"id":1,"ok":true}', 7)
    assert got[1]["before"] == '{"id":1,"ok":false,"a b":"x\\"y","tags":["q",1],"big":18446744073709551616,"p":1.5}' and got[1]["ts_ms"] == 3
    assert got[1]["after"] == '{"id":2,"ok":null,"a b":null,"tags":null,"big":null,"p":null}'
    assert got[2]["decode_error"] == "no row in the schema" and got[2]["after"] is None
    assert (got[5]["db"], json.loads(got[5]["after"])["id"], got[5]["plain"]) == ("d", 5, False)
    assert got[6]["plain"] and got[6]["op"] == "r" and json.loads(got[6]["after"]) == {"id": 6}
    unknown = decode.decode_by_schema(raw, {}).where("offset = 0").first()
    assert unknown["decode_error"] == "unknown schema"


def test_versions_of_a_table_meet_in_one_row_type(spark):
    wide = [*BASE, ("p", "bytes", "org.apache.kafka.connect.data.Decimal", {"scale": "2"})]
    values = [envelope(BASE, None, {"id": 1, "ok": 1}, "c"), envelope(wide, {"id": 1, "ok": 1, "p": None}, {"id": 1, "ok": 0, "p": 12.5}, "u"), envelope([], None, {"id": 3}, "c"), envelope(BASE, None, {"id": 4, "ok": 1}, "c")]
    raw = spark.createDataFrame([("raw", i, v) for i, v in enumerate(values)], "raw_topic string, offset long, value string")
    log = decode.typed_images(decode.decode_by_schema(raw), "struct<id:bigint,ok:boolean,p:decimal(12,2)>")
    goes, held = guards.publish_prefix(events.normalize(log, ["id"]))
    done = formats.serialize(goes, ["id"], "COMPATIBLE_DEBEZIUM_JSON").orderBy("seq").collect()
    assert [json.loads(r["value"])["after"] for r in done] == [{"id": 1, "ok": True, "p": None}, {"id": 1, "ok": False, "p": 12.5}]
    assert {r["first_reason"] for r in held.collect()} == {"no row in the schema"} and held.count() == 2  # it stops there, and nothing later goes


LOG = "raw_topic string, offset long, op string, before struct<id:bigint>, after struct<id:bigint>, db string, tbl string, ts_ms long"


def test_a_pair_without_a_time_publishes_neither(spark):
    log = spark.createDataFrame([("t", 0, "d", (1,), None, "a", "b", 5), ("t", 1, "c", None, (1,), "a", "b", None)], LOG)
    goes, held = guards.publish_prefix(events.normalize(log, ["id"]))
    assert goes.count() == 0 and [r["reason"] for r in held.orderBy("seq").collect()] == ["missing time", "missing time"]


def test_records_without_a_position_have_a_reason(spark):
    log = spark.createDataFrame([(None, 0, "c", None, (1,), "a", "b", 5), ("t", None, "c", None, (2,), "a", "b", 5), ("t", 4, "c", None, (3,), "a", "b", 5), ("u", 4, "c", None, (4,), "a", "b", 5)], LOG)
    goes, held = guards.publish_prefix(events.normalize(log, ["id"]))
    assert [r["key"] for r in goes.collect()] == ['{"id":4}'] and sorted((r["raw_topic"], r["first_reason"]) for r in held.collect()) == [("", "missing position"), ("t", "missing position"), ("t", "missing position")]


def test_owners_stop_by_run_and_with_their_snapshot(spark):
    rows = [("t", 0, 0, 0, None), ("t", 0, 5, 0, None), ("t", 1, 1, 0, "bad"), ("t", 1, 0, 0, None), ("t", 2, 0, 0, None), (None, 0, 0, 0, None)]
    df = spark.createDataFrame(rows, "raw_topic string, run int, seq long, sub int, reason string")
    goes, held = guards.publish_prefix(df)
    assert sorted((r["run"], r["seq"]) for r in goes.where("raw_topic = 't'").collect()) == [(0, 0), (0, 5), (1, 0)] and held.count() == 2 and goes.count() == 4
    table = spark.createDataFrame([(1,), (None,)], "id long")
    changes = events.normalize(spark.createDataFrame([("raw.1", 0, "c", None, (7,), "a", "b", 5), ("raw.2", 0, "c", None, (8,), "a", "b", 5)], LOG), ["id"])
    both = events.snapshot_then_changes(events.snapshot_events(table, ["id"], "a", "b", F.lit(1), topic="raw.1"), changes)
    goes, held = guards.publish_prefix(both)
    assert [r["raw_topic"] for r in goes.collect()] == ["raw.2"] and held.count() == 3
    last = guards.delivery_stats(df.where("reason is null and raw_topic = 't'").withColumn("event_ms", F.col("seq")), F.lit(9)).first()
    assert (last["delivered"], last["last_seq"]) == (4, 0)


def keys(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "k long")


@pytest.mark.parametrize(
    "source, target, step, want",
    [
        ((1, 105), (1, 105, 120), 50, (3, 2, 2, 3, -1, False)),  # the last block reaches to 151
        ((1, 2, None), (1, 2), 10, (1, 1, 3, 2, 1, False)),  # a row without a key counts at the source
        ((1, 2), (0, 1, 2, 500), 10, (1, 1, 2, 2, 0, True)),  # what lies outside isn't looked at
        ((None, None), (5,), 10, (1, 0, 2, 1, 1, False)),  # only null keys: one block from 0
        ((), (), 10, (0, 1, 0, 0, 0, True)),
        ((), (7, None), 10, (0, 0, 0, 2, -2, False)),
    ],
)
def test_block_verdicts(spark, source, target, step, want):
    v = reconcile.block_verdict(keys(spark, *source), keys(spark, *target), "k", step).first()
    assert (v["total_blocks"], v["matched_blocks"], v["source_rows"], v["target_rows"], v["difference"], v["matched"]) == want
    assert v["mismatched_blocks"] == max(want[0], 1) - want[1]


def test_checks_have_the_sign_of_the_source_and_refuse_other_keys(spark):
    c = reconcile.count_check(keys(spark, 1, 2, 3), keys(spark, 1)).first()
    assert (c["difference"], c["matched"]) == (2, False)
    rows = reconcile.key_range_blocks(keys(spark, 1, 12), keys(spark, 1), "k", 10).orderBy("block_index").collect()
    assert [(r["block_index"], r["lower"], r["upper"], r["difference"]) for r in rows] == [(1, 1, 11, 0), (2, 11, 21, 1)]
    df = spark.createDataFrame([(1, "a")], "k long, s string")
    for bad in (["k", "s"], ["s"], [], ["x"]):
        with pytest.raises(ValueError):
            reconcile.check_key(df, bad)
    assert reconcile.check_key(df, ["K"]) == "k"


def test_drift_states(spark):
    tables = [("gone", "TABLE_UNAVAILABLE", True, True, True), ("lost", "TABLE_UNAVAILABLE", True, False, False), ("new_fit", None, True, False, False), ("new_unfit", None, False, False, False), ("back", None, True, True, True),
              ("same", None, True, False, True), ("fit", "ADD_COLUMN", True, False, True), ("fit_open", "ADD_COLUMN", True, True, True), ("unfit", "DROP_COLUMN", False, False, True)]
    df = spark.createDataFrame(tables, "table_name string, change_type string, compatible boolean, open boolean, known boolean")
    got = {r["table_name"]: r["state"] for r in schema.drift_state(df.select("table_name", "change_type"), df, df.where("open").select("table_name"), df.where("known").select("table_name")).collect()}
    assert got == {"gone": "PENDING_FIX", "lost": "PENDING_FIX", "new_fit": "BASELINE_SET", "new_unfit": None, "back": "READY_TO_RESUME", "same": None, "fit": "READY_TO_RESUME", "fit_open": "READY_TO_RESUME", "unfit": "PENDING_FIX"}


COLUMNS = "table_name string, column_name string, position int, type_name string, jdbc_type int, size int, scale int, nullable boolean, default_value string"


def test_targets_without_source_key_and_with_blank_defaults(spark):
    source = spark.createDataFrame([("t", "id", 1, "int", 4, 10, 0, False, None)], COLUMNS)
    target = spark.createDataFrame([("t", "ID", 1, "int", 4, 10, 0, False, None), ("t", "extra", 2, "int", 4, 10, 0, False, " ")], COLUMNS)
    none, has = (spark.createDataFrame(rows, "table_name string, key_columns array<string>") for rows in ([], [("t", ["id"])]))
    got = schema.target_compatibility(source, target, none, has, "FULL").first()
    assert got["keys_equal"] and got["extra_required"] == "extra" and not got["compatible"]
    assert schema.target_compatibility(source, target.where("column_name = 'ID'"), none, has, "FULL").first()["compatible"]
    assert not schema.target_compatibility(source, target.where("column_name = 'ID'"), has, none, "FULL").first()["compatible"]


def test_unknown_nullability_is_a_high_risk(spark):
    base = spark.createDataFrame([("a", "id", 1, "int", 4, 10, 0, False, None)], COLUMNS)
    now = base.unionByName(spark.createDataFrame([("a", "x", 2, "text", 12, 9, 0, None, None)], COLUMNS))
    nothing = spark.createDataFrame([], "table_name string, index_name string, key_seq int, column_name string, is_primary boolean")
    assert schema.drift(base, nothing, now, nothing).first()["risk_level"] == "HIGH"
    names = lambda *n: F.array(*[F.lit(x) for x in n]).cast("array<string>")
    assert one(spark, schema.followed_selection(names("a"), names(), names("a", "b"))) == ["a"]
    assert one(spark, schema.followed_selection(names("a"), F.lit(None).cast("array<string>"), names("a", "b"))) == ["a"]


def test_sizes(spark):
    df = spark.createDataFrame([("t", "id", "BIGINT", 1, 40), ("t", "body", "LONGTEXT", 2, 4 << 30), ("u", "a", "INT", 1, 40), ("u", "b", "MEDIUMTEXT", 2, 16_777_215)], "table_name string, column_name string, type_name string, position int, value_bytes long")
    cdc = {r["table_name"]: r for r in guards.worst_case_sizes(df, F.col("column_name") != "b").collect()}
    assert (cdc["t"]["raw_bytes"], cdc["t"]["event_bytes"], cdc["t"]["large_columns"]) == (4 << 30, 4 << 30, ["body(LONGTEXT)"])
    assert (cdc["u"]["raw_bytes"], cdc["u"]["event_bytes"], cdc["u"]["large_columns"]) == (2 * (40 + 16_777_215 + 64) + 640 + 512, 2 * 72 + 512, ["b(MEDIUMTEXT)"])
    full = {r["table_name"]: r for r in guards.worst_case_sizes(df, F.col("column_name") != "b", cdc=False).collect()}
    assert (full["u"]["raw_bytes"], full["u"]["event_bytes"], full["u"]["large_columns"]) == (72 + 512, 72 + 512, [])


def test_gates(spark):
    items = spark.createDataFrame([(1, 1, "FAILED", False), (2, 2, "FAILED", False), (3, 9, "FAILED", False), (4, 1, "RUNNING", True), (5, 1, "RUNNING", False), (6, 3, "DDL_BLOCKED", True), (7, 1, "PAUSED", True)], "item_id int, group_id int, status string, stopped boolean")
    groups = spark.createDataFrame([(1, "RUNNING"), (2, "PAUSED"), (3, "DEGRADED")], "group_id int, status string")
    assert {r["item_id"]: r["due"] for r in reports.gated_items(items, groups).collect()} == {1: "FAILED", 2: None, 3: None, 4: "KAFKA_BRIDGE_STOPPED", 5: None, 6: "DDL_BLOCKED", 7: None}


def test_numbers_texts_and_zones(spark):
    for given, want in [("50.0", 50), ("1e1", 10), (" -5.9 ", -5), ("", None), ("x", None), ("0.37", 0), (None, None), ("0x1", None)]:
        assert one(spark, text.number_from(F.lit(given).cast("string"))) == want
    backlog, lag = metrics.sample_figures(F.lit("50.0"), F.lit("1e1"), F.lit("1000"), F.lit("3999.9"))
    assert (one(spark, backlog), one(spark, lag)) == (40, 2)
    assert one(spark, text.redacted(F.lit('{"x": password=abc}, passwd=1, PWD : q&r'))) == '{"x": password=******}, passwd=1, PWD : ******&r'
    assert [text.zone_id(z) for z in (None, " ", "asia/shanghai", "utc", " Etc/GMT-8 ")] == [None, "", "Asia/Shanghai", "UTC", "Etc/GMT-8"]
    for bad in ("CST", "ist", "EST", "+08:00", "Mars/Base"):
        with pytest.raises(ValueError):
            text.zone_id(bad)
    assert text.effective_zone("") == text.effective_zone(None) == "Asia/Shanghai"
    assert [one(spark, text.offset_text(F.lit(s))) for s in (28_800, -19_800, 0, -18_000)] == ["UTC+08:00", "UTC-05:30", "UTC+00:00", "UTC-05:00"]
    assert [one(spark, text.shift_hours_text(F.lit(s))) for s in (28_800, -19_800, 0, 20_700, 36_000, 1000)] == ["8", "-5.5", "0", "5.75", "10", "0.28"]


def test_names(spark):
    readers.check_names(["db.tbl", "t$1", "a" * 100], ["raw.1-x"])
    for bad in ("a.b.c", ".t", "t.", "a b", "", "a`b", "t\n"):
        with pytest.raises(ValueError):
            readers.check_names([bad])


@pytest.mark.parametrize("mode, engine, want", [("FULL", "RUNNING", "SNAPSHOT"), ("incremental", "STARTING", "CDC"), ("FULL_CDC", "pending", "SNAPSHOT"), ("FULL_CDC", "RUNNING", "MIXED"), ("FULL_CDC", None, "MIXED"), ("full", None, "SNAPSHOT")])
def test_phase_of_a_job(spark, mode, engine, want):
    assert one(spark, metrics.job_phase(F.lit(mode), F.lit(engine).cast("string"))) == want


def test_every_job_with_a_known_target_is_counted(spark):
    """Targets 0 to 9 are all in the whole nation table, so no order is missing; jobs whose target is unknown are left out."""
    sf = "/root/testdata/sf0.001"
    got = queries.q_counts_by_target(spark, sf).collect()
    names = {r["n_name"] for r in spark.read.parquet(f"{sf}/nation.parquet").where("n_nationkey < 10").collect()}
    assert {r["target_type"] for r in got} == names and len(got) == 10
    assert sum(r["jobs"] for r in got) == spark.read.parquet(f"{sf}/orders.parquet").count()
    with duckdb.connect() as con:
        for t in ("orders", "customer", "nation"):
            con.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
        assert sorted(map(tuple, got)) == sorted(con.sql(queries.ORACLES["q_counts_by_target"]).fetchall())
    jobs = spark.createDataFrame([(1, 1, 7, "RUNNING"), (2, 1, None, "FAILED"), (3, 2, None, "RUNNING"), (4, 1, 9, "RUNNING")], "job_id long, group_id long, target_id long, status string")
    groups = spark.createDataFrame([(1, 8)], "group_id long, target_id long")
    sources = spark.createDataFrame([(7, "a"), (8, "b")], "data_source_id long, target_type string")
    assert sorted(map(tuple, metrics.counts_by_target(reports.with_target_type(jobs, groups, sources)).collect())) == [("a", 1, 1), ("b", 1, 0)]
