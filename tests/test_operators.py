"""Decoding, guards, checks, schemas, metrics, masking, tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cdcflow.functions import decode, masking, text
from cdcflow.operators import guards, metrics, reconcile, schema
from cdcflow.sources import readers
from cdcflow.sources.sinks import Conflict, VersionedTable, upsert_sql


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "kind, given, want",
    [
        ("micros", -1, "1969-12-31T23:59:59.999999"), ("micros", 0, "1970-01-01T00:00:00"), ("micros", 500_000, "1970-01-01T00:00:00.5"), ("millis", 36_000_120, "1970-01-01T10:00:00.12"), ("nanos", 1_000_001, "1970-01-01T00:00:00.001000001"), ("nanos", -1, "1969-12-31T23:59:59.999999999"), ("time_ns", 1_001_001, "00:00:00.001001"), ("time_ns", 1_001, "00:00:00.000001"), ("bool", "true", True), ("bool", "0", False), ("time_us", 3020399000000, "838:59:59"), ("time_us", -5400000000, "-01:30:00"), ("time_ms", 1500, "00:00:01.5"),
        ("bool", 1, True), ("float", 1.5, 1.5), ("date", 1, dt.date(1970, 1, 2)), ("zoned", "2024-01-01T00:00:00Z", "2024-01-01T08:00:00"),
    ],
)
def test_decoded(spark, kind, given, want):
    assert one(spark, decode.decoded(F.lit(given).cast(decode.ARRIVES[kind].format(scale=10)), kind)) == want


@pytest.mark.parametrize("kind, given, want", [("millis", 253_402_300_799_999, "9999-12-31T23:59:59.999"), ("millis", 253_402_300_800_000, "10000-01-01T00:00:00"), ("micros", 509_839_245_227_500_000, "18126-03-01T04:33:47.5")])
def test_years_beyond_9999_have_no_sign(spark, kind, given, want):
    assert one(spark, decode.decoded(F.lit(given).cast("bigint"), kind)) == want


def test_text(spark):
    assert one(spark, text.within_bytes(F.lit("aé" * 10), 4)) == "aéa"
    assert one(spark, text.redacted(F.lit("user=a, password=secret;x"))) == "user=a, password=******;x"
    assert one(spark, text.comma_list(F.lit(" a, ,b,a"))) == ["a", "b", "a"]
    assert one(spark, text.byte_size_text(F.lit(1536))) == "1.5 KB"
    assert one(spark, text.number_from(F.lit("n/a"))) is None


def test_publish_stops_at_the_first_refused(spark):
    df = spark.createDataFrame([("t", 0, None), ("t", 1, "bad"), ("t", 2, None), ("u", 5, None)], "raw_topic string, seq long, reason string")
    goes, held = guards.publish_prefix(df)
    assert sorted((r["raw_topic"], r["seq"]) for r in goes.collect()) == [("t", 0), ("u", 5)]
    assert sorted((r["seq"], r["first_bad"], r["first_reason"]) for r in held.collect()) == [(1, 1, "bad"), (2, 1, "bad")]


def test_holes_across_blocks(spark):
    log = spark.createDataFrame([("t", i) for i in (0, 1, 2, 9, 10, 30)], "raw_topic string, offset long")
    assert sorted(tuple(r) for r in guards.holes(log, 4).collect()) == [("t", 2, 6), ("t", 10, 19)]


def test_key_blocks(spark):
    a, b = spark.range(0, 100).withColumnRenamed("id", "k"), spark.range(5, 120).withColumnRenamed("id", "k")
    rows = reconcile.key_range_blocks(a, b, "k", 50).orderBy("block_index").collect()
    assert [(r["source_rows"], r["target_rows"], r["matched"]) for r in rows] == [(50, 45, False), (50, 50, True)]
    v = reconcile.block_verdict(a, b, "k", 50).first()
    assert (v["target_outside"], v["matched"], v["total_blocks"]) == (20, False, 2)
    with pytest.raises(ValueError):
        reconcile.key_range_blocks(spark.range(5000).withColumnRenamed("id", "k"), b, "k", 1)
    empty = reconcile.block_verdict(a.limit(0), b.limit(0), "k", 5).first()
    assert (empty["total_blocks"], empty["matched_blocks"], empty["matched"]) == (0, 1, True)


COLUMNS = "table_name string, column_name string, position int, type_name string, jdbc_type int, size int, scale int, nullable boolean, default_value string"
KEYS = "table_name string, index_name string, key_seq int, column_name string, is_primary boolean"


def test_drift_levels(spark):
    base = spark.createDataFrame([("a", "id", 1, "int", 4, 10, 0, False, None), ("b", "id", 1, "int", 4, 10, 0, False, None), ("c", "id", 1, "int", 4, 10, 0, False, None)], COLUMNS)
    now = spark.createDataFrame([("a", "ID", 1, "int", 4, 10, 0, False, None), ("a", "x", 2, "text", 12, 9, 0, True, None), ("b", "id", 1, "bigint", -5, 19, 0, False, None)], COLUMNS)
    keys = spark.createDataFrame([("a", "P", 1, "id", True)], KEYS)
    got = {r["table_name"]: (r["change_type"], r["risk_level"]) for r in schema.drift(base, keys, now, keys).collect()}
    assert got == {"a": ("ADD_COLUMN", "LOW"), "b": ("ALTER_COLUMN", "HIGH"), "c": ("TABLE_UNAVAILABLE", "HIGH")}


def test_point_counts_as_numeric(spark):
    assert one(spark, schema.type_family(F.lit("POINT"), F.lit(1))) == "numeric"


def test_key_candidates(spark):
    cols = spark.createDataFrame([("a", c, i, "int", 4, 1, 0, n, None) for i, (c, n) in enumerate([("id", False), ("u", False), ("v", True)])], COLUMNS)
    keys = spark.createDataFrame([("a", "P", 1, "id", True), ("a", "again", 1, "id", False), ("a", "uk", 2, "id", False), ("a", "uk", 1, "u", False), ("a", "nk", 1, "v", False)], KEYS)
    assert [r["key_columns"] for r in schema.key_candidates(cols, keys).orderBy("rank").collect()] == [["id"], ["u", "id"]]


def test_group_status(spark):
    items = spark.createDataFrame([(1, "RUNNING"), (1, "FAILED"), (2, "PAUSED"), (3, "STOPPED"), (3, "FINISHED")], "group_id long, status string")
    got = {r["group_id"]: r["status"] for r in metrics.group_status(spark.range(1, 5).withColumnRenamed("id", "group_id"), items).collect()}
    assert got == {1: "DEGRADED", 2: "PAUSED", 3: "STOPPED", 4: "DRAFT"}


def test_masking(spark):
    assert one(spark, masking.high_security_mask(F.lit("abcdef"), 4, 4)) == "ab****"
    assert one(spark, masking.masked(F.lit("someone@x.org"), "EMAIL")) == "s******@x.org"
    assert one(spark, masking.masked(F.lit(None).cast("string"), "PHONE")) is None


def test_versioned_table(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    t.overwrite(spark.range(3))
    assert t.overwrite(spark.range(5)) == 2 and t.read().count() == 5


def test_versions_survive_a_crash_at_any_step(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/t"
    t = VersionedTable(spark, root)
    with pytest.raises(FileNotFoundError):
        t.read()
    t.overwrite(spark.range(3))
    with monkeypatch.context() as m:  # before the marker
        m.setattr(VersionedTable, "_mark", lambda *a: (_ for _ in ()).throw(OSError("crash")))
        with pytest.raises(OSError):
            t.overwrite(spark.range(4))
    assert t.read().count() == 3
    with monkeypatch.context() as m:  # between making the marker and writing into it
        mark = VersionedTable._mark
        m.setattr(VersionedTable, "_mark", lambda self, version, folder, position=None: mark(self, version, ""))
        t.overwrite(spark.range(5))
    assert t.current() == 1 and t.read().count() == 3
    with pytest.raises(Conflict):  # the marker may be another writer's, who is about to fill it
        t.overwrite(spark.range(6))
    assert t.repair() == [2] and t.overwrite(spark.range(6)) == 2 and t.read().count() == 6
    with pytest.raises(Exception):  # a second writer of the same version
        t._mark(2, "other")
    assert t.read().count() == 6


def test_a_table_that_breaks_on_read_stops_no_other(spark):
    broken = spark.range(3).select(F.raise_error(F.lit("gone")).alias("id"))
    got = reconcile.group_check({"a": (spark.range(2), spark.range(2)), "b": (broken.distinct(), spark.range(3)), "c": (lambda: spark.read.parquet("/no/such"), spark.range(1))}).collect()
    assert [(r["table_name"], r["status"]) for r in got] == [("a", "MATCHED"), ("b", "FAILED"), ("c", "FAILED")]


def test_sources(spark):
    with pytest.raises(ValueError):
        readers.check_start("SPECIFIC", 0, file="../x", position=10)
    with pytest.raises(ValueError):
        readers.check_start("TIMESTAMP", 10, start_ms=11)
    assert readers.restored_names(spark.range(1).toDF("ID"), ["Id"]).columns == ["Id"]
    assert readers.restored_names(spark.range(1).toDF("ID"), ["Id", "x"]).columns == ["Id"]
    assert readers.restored_names(spark.range(1).selectExpr("id AS ID", "id AS other"), ["Id"]).columns == ["ID", "other"]
    assert readers.restored_names(spark.range(1).selectExpr("id AS B", "id AS A"), ["a", "b"]).columns == ["a", "b"]
    logs = spark.createDataFrame([("bin.999999", 9), ("bin.1000000", 4), ("bin.000998", 90), ("bin.999999", 2)], "log_file string, log_pos long")
    assert sorted(tuple(r) for r in logs.where(readers.start_filter("SPECIFIC", file="bin.999999", position=4)).collect()) == [("bin.1000000", 4), ("bin.999999", 9)]
    readers.check_names(["orders", "a_1"], ["raw.app-1"])
    for bad in ({"identifiers": ["a b"]}, {"topics": [".."]}, {"topics": ["a/b"]}):
        with pytest.raises(ValueError):
            readers.check_names(**bad)
    assert upsert_sql("t", "s", ["id", "a"], ["id"], "postgresql")[1].endswith('ON CONFLICT ("id") DO UPDATE SET "a" = EXCLUDED."a"')


def test_jdbc_round_trip(spark):
    from cdcflow.sources.sinks import jdbc_overwrite

    url = "jdbc:derby:memory:cdcflow;create=true"
    jdbc_overwrite(spark.range(10).toDF("ID"), url, "T1")
    assert readers.snapshot(spark, url, "T1", ["ID"], "ID", (0, 10), 3).count() == 10


def test_changes_are_applied_over_jdbc(spark):
    from cdcflow.operators import apply, events
    from cdcflow.sources.catalog import connection, read_catalog
    from cdcflow.sources.sinks import jdbc_apply

    url = "jdbc:derby:memory:upsert;create=true"
    with connection(spark, url) as conn:
        conn.createStatement().executeUpdate('CREATE TABLE "people" ("id" BIGINT NOT NULL PRIMARY KEY, "name" VARCHAR(20) NOT NULL, "note" VARCHAR(9) DEFAULT \'x\')')
        conn.createStatement().executeUpdate('CREATE UNIQUE INDEX "by_name" ON "people" ("name", "id")')
        conn.createStatement().executeUpdate("INSERT INTO \"people\" VALUES (1, 'old', NULL), (2, 'gone', NULL), (3, 'kept', NULL)")
    row = "struct<id:bigint,name:string>"
    records = [("u", (1, "old"), (1, "new")), ("d", (2, "gone"), None), ("c", None, (4, "added")), ("c", None, (5, "brief")), ("d", (5, "brief"), None)]
    log = spark.createDataFrame([("t", i, *r, "app", "people", 0) for i, r in enumerate(records)], f"raw_topic string, offset long, op string, before {row}, after {row}, db string, tbl string, ts_ms long")
    changes = apply.latest_changes(events.normalize(log, ["id"]))
    for _ in range(2):
        jdbc_apply(changes, url, '"people"', "stage", ["id"], "standard")
        got = readers.snapshot(spark, url, '"people"', ["id", "name"]).orderBy("id").collect()
        assert [tuple(r) for r in got] == [(1, "new"), (3, "kept"), (4, "added")]
    columns, keys, errors = read_catalog(spark, url, ["people", "nowhere"])
    assert [(r["column_name"], r["nullable"], r["default_value"]) for r in columns.orderBy("position").collect()] == [("id", False, None), ("name", False, None), ("note", True, "'x'")]
    assert [tuple(r) for r in errors.collect()] == [("nowhere", "table not found")]
    assert [r["key_columns"] for r in schema.key_candidates(columns, keys).orderBy("rank").collect()] == [["id"], ["name", "id"]]


def test_check_is_refused_while_changes_flow():
    reconcile.check_standing_still("FULL_CDC", "PAUSED")
    reconcile.check_standing_still("FULL", "RUNNING")
    with pytest.raises(ValueError):
        reconcile.check_standing_still("full_cdc", "RUNNING")


def test_entry_has_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
