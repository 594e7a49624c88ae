"""Versioned and bucketed tables on files, and keyed writes over JDBC with a ledger of batches."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cdcflow.operators import events
from cdcflow.operators.apply import latest_changes, merged_into
from cdcflow.sources.catalog import connection
from cdcflow.sources.sinks import BatchLedger, BucketedTable, Conflict, VersionedTable, jdbc_apply, jdbc_overwrite, stage_columns, upsert_sql

ROW = "struct<id:bigint,name:string>"
LOG = f"raw_topic string, offset long, op string, before {ROW}, after {ROW}, db string, tbl string, ts_ms long"


def changed(spark, *records):
    return events.normalize(spark.createDataFrame([("t", i, op, b, a, "d", "t", i) for i, (op, b, a) in enumerate(records)], LOG), ["id"])


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_concurrent_version_is_not_lost(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    t.overwrite(spark.createDataFrame([(1, "a")], "id long, name string"))
    seen, change = t.current(), changed(spark, ("c", None, (3, "c")))
    mine = merged_into(t.read(), change, ["id"])
    VersionedTable(spark, t.root).apply(changed(spark, ("c", None, (2, "b"))), ["id"])  # another writer, meanwhile
    with pytest.raises(Conflict):
        t.overwrite(mine, after=seen)
    assert rows(t.read()) == [(1, "a"), (2, "b")]
    t.apply(change, ["id"])
    assert rows(t.read()) == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(t.read(1)) == [(1, "a")]


def test_an_unfinished_marker_stops_writers_until_it_is_repaired(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    t.overwrite(spark.createDataFrame([(1, "a")], "id long, name string"))
    (tmp_path / "t" / "_versions" / f"{2:012d}").touch()  # as a writer leaves it that breaks off
    assert rows(t.read()) == [(1, "a")]
    with pytest.raises(Conflict):
        t.apply(changed(spark, ("c", None, (2, "b"))), ["id"])
    assert t.repair() == [2] and t.apply(changed(spark, ("c", None, (2, "b"))), ["id"]) == 2
    assert rows(t.read()) == [(1, "a"), (2, "b")]


def test_vacuum_keeps_what_new_versions_use(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    for i in range(4):
        t.overwrite(spark.createDataFrame([(i, "a")], "id long, name string"))
    assert len(t.vacuum(keep=2)) == 2 and rows(t.read()) == [(3, "a")] and rows(t.read(3)) == [(2, "a")]
    assert t.vacuum(keep=2) == []


def test_an_apply_rewrites_only_touched_buckets(spark, tmp_path):
    t = BucketedTable(spark, f"file://{tmp_path}/b", ["id"], n_buckets=16)
    base = spark.range(400).select(F.col("id"), F.concat(F.lit("n"), "id").alias("name"))
    t.overwrite(base)
    was = t._manifest(1)
    change = changed(spark, ("u", (5, "n5"), (5, "x")), ("d", (9, "n9"), None), ("c", None, (1000, "new")), ("d", (77777, "gone"), None))
    touched = t.touched(change)
    assert 1 <= len(touched) <= 4
    assert t.apply(change) == 2
    now = t._manifest(2)
    assert {b: p for b, p in was.items() if b not in touched} == {b: p for b, p in now.items() if b not in touched}  # the same files
    assert all(now[b] != was.get(b) for b in now if b in touched)
    want = {i: f"n{i}" for i in range(400)} | {5: "x", 1000: "new"}
    want.pop(9)
    assert rows(t.read()) == sorted(want.items()) and rows(t.read(1)) == sorted((i, f"n{i}") for i in range(400))
    files = t.read(2, buckets=touched).inputFiles()
    assert len(files) == len(touched) and all("/rows/_bucket=" in f for f in files)
    assert rows(t.lookup(spark.createDataFrame([(5,), (9,), (10,)], "id long"))) == [(5, "x"), (10, "n10")]
    t.apply(changed(spark, ("d", (5, "x"), None)))
    t.vacuum(keep=1)  # folders that untouched buckets of old versions lie in stay
    assert 5 not in dict(rows(t.read())) and len(rows(t.read())) == 399
    assert rows(t.read()) == rows(merged_into(merged_into(base, change, ["id"]), changed(spark, ("d", (5, "x"), None)), ["id"]))


def test_buckets_that_become_empty_and_lost_races(spark, tmp_path):
    t = BucketedTable(spark, f"file://{tmp_path}/b", ["id"], n_buckets=4)
    t.overwrite(spark.createDataFrame([(1, "a")], "id long, name string"))
    t.apply(changed(spark, ("d", (1, "a"), None)))
    assert rows(t.read()) == [] and t.read().columns == ["id", "name"]
    t.apply(changed(spark, ("c", None, (2, None))))
    assert rows(t.read()) == [(2, None)]
    with pytest.raises(Conflict):
        t.overwrite(t.read(), after=1)


def test_merge_keeps_types_and_rows_without_a_key(spark):
    base = spark.createDataFrame([("a", 1, 1.5), ("n", None, 2.5)], "name string, id int, price double")
    log = spark.createDataFrame([("t", 0, "c", None, (7, Decimal("2.25"), "b"), "d", "t", 1)], "raw_topic string, offset long, op string, before struct<id:bigint,price:decimal(12,2),name:string>, after struct<id:bigint,price:decimal(12,2),name:string>, db string, tbl string, ts_ms long")
    out = merged_into(base, events.normalize(log, ["id"]), ["id"])
    assert out.dtypes == base.dtypes and sorted(map(tuple, out.collect())) == [("a", 1, 1.5), ("b", 7, 2.25), ("n", None, 2.5)]


URL = "jdbc:derby:memory:ledger;create=true"


def test_a_repeated_batch_has_one_effect(spark, monkeypatch):
    jdbc_overwrite(spark.createDataFrame([(1, "a")], "id long, name string"), URL, "ledger_target", "name VARCHAR(20)")
    ledger, read = BatchLedger("batches_done", "people"), lambda: rows(spark.read.format("jdbc").option("url", URL).option("dbtable", "ledger_target").load())
    first = latest_changes(changed(spark, ("u", (1, "a"), (1, "b"))))
    second = latest_changes(changed(spark, ("u", (1, "b"), (1, "c")), ("c", None, (2, "z"))))
    put = lambda changes, n: jdbc_apply(changes, URL, "ledger_target", "ledger_stage", ["id"], "standard", ledger=ledger, batch=n)
    assert put(first, 0) and put(second, 1)
    assert not put(first, 0)  # an old batch comes again, after a newer one
    assert read() == [(1, "c"), (2, "z")]
    third = latest_changes(changed(spark, ("d", (2, "z"), None)))
    from cdcflow.sources import sinks

    whole = sinks.upsert_sql
    monkeypatch.setattr(sinks, "upsert_sql", lambda *a: [*whole(*a), "DELETE FROM no_such_table"])  # fails behind the merge
    with pytest.raises(Exception):
        put(third, 2)
    assert read() == [(1, "c"), (2, "z")]  # neither the rows nor the number
    monkeypatch.setattr(sinks, "upsert_sql", whole)
    assert put(third, 2) and not put(third, 2) and read() == [(1, "c")]
    other = BatchLedger("batches_done", "other")
    with connection(spark, URL) as conn:
        assert ledger.has(conn, 2) and not other.has(conn, 2)


def test_columns_named_like_the_staging_tables_own(spark):
    kind = "struct<id:bigint,op:string,key:string,change_op:string>"
    jdbc_overwrite(spark.createDataFrame([(1, "x", "y", "z")], "id long, op string, key string, change_op string"), URL, "clash_target", "op VARCHAR(9), key VARCHAR(9), change_op VARCHAR(9)")
    log = spark.createDataFrame([("t", 0, "c", None, (2, "o", "k", "c"), "d", "t", 1), ("t", 1, "d", (1, None, None, None), None, "d", "t", 1)], f"raw_topic string, offset long, op string, before {kind}, after {kind}, db string, tbl string, ts_ms long")
    assert jdbc_apply(latest_changes(events.normalize(log, ["id"])), URL, "clash_target", "clash_stage", ["id"], "standard")
    assert rows(spark.read.format("jdbc").option("url", URL).option("dbtable", "clash_target").load()) == [(2, "o", "k", "c")]
    assert stage_columns(["ID", "Change_Key", "change_key_"]) == ("change_key__", "change_op")
    assert "`change_op` = 'DELETE'" in upsert_sql("t", "s", ["id", "op"], ["id"], "mysql")[0]
