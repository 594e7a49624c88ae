import datetime as dt

from cdcflow.operators import events
from cdcflow.plans import testlog
from cdcflow.streaming import jobs, monitor


def test_prune_and_stop(spark, tmp_path):
    for day in ("2024-01-01", "2024-01-09"):
        spark.range(1).write.parquet(f"file://{tmp_path}/s/date={day}")
    assert monitor.prune_samples(spark, f"file://{tmp_path}/s", dt.date(2024, 1, 10)) == ["2024-01-01"]

    class Query:
        stopped = False

        def stop(self):
            self.stopped = True

    queries = {"a": Query(), "b": Query()}
    drifted = spark.createDataFrame([("a", "ADD_COLUMN"), ("b", None), ("c", "ADD_COLUMN")], "table_name string, change_type string")
    assert monitor.stop_drifted(queries, drifted) == ["a"] and queries["a"].stopped and not queries["b"].stopped


def test_stream_merges_as_the_batch_does(spark, tmp_path):
    """Over batches and restarts from the checkpoint; a record that can't be published has its reason."""
    log = testlog.change_log(spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(60))
    log = events.dense_order(log).withColumn("offset", events.F.col("seq")).drop("seq").withColumn("db", events.F.when(events.F.col("offset") == 33, " ").otherwise(events.F.col("db")))
    records = jobs.keyed_records(jobs.moved_apart(log, testlog.KEYS), testlog.KEYS)
    source, check, out = (f"file://{tmp_path}/{n}" for n in ("in", "check", "out"))
    last = log.agg(events.F.max("offset")).first()[0]
    for low, high in ((0, 12), (13, 31), (32, 47), (48, last)):  # a batch and a start of the query each
        records.where(events.F.col("offset").between(low, high)).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.merge_stream(spark.readStream.schema(records.schema).parquet(source), hold_ms=10**9)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(once=True).start().awaitTermination(120)
    got = spark.read.parquet(out).unionByName(jobs.held_deletes(spark, check))
    want = events.normalize(log, testlog.KEYS, by_offset=True)
    key = lambda r: (r["seq"], r["op"] or "", r["event_ms"] or 0, r["reason"] or "")
    assert sorted(map(key, got.withColumnRenamed("offset", "seq").collect())) == sorted(map(key, want.collect()))


def test_a_timer_lets_a_held_delete_go(spark, tmp_path):
    import time

    row = "struct<user_id:bigint>"
    log = spark.createDataFrame([("t", 0, "d", (1,), None, "d", "t", 5)], f"raw_topic string, offset long, op string, before {row}, after {row}, db string, tbl string, ts_ms long")
    records = jobs.keyed_records(log, ["user_id"])
    records.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = jobs.merge_stream(spark.readStream.schema(records.schema).parquet(f"file://{tmp_path}/in"), hold_ms=200)
    q = stream.writeStream.format("memory").queryName("let_go").option("checkpointLocation", f"file://{tmp_path}/check").trigger(processingTime="1 second").start()
    try:
        end = time.time() + 90
        while not spark.table("let_go").count() and time.time() < end:
            time.sleep(0.5)
        assert [(r["op"], r["offset"]) for r in spark.table("let_go").collect()] == [("DELETE", 0)]
    finally:
        q.stop()


def test_a_moved_row_doesnt_close_a_held_delete_of_its_new_key(spark, tmp_path):
    """d of 1001, then u of 1 to 1001: a DELETE, and the two halves of the u; then a d and c of 1001, which are one UPDATE."""
    row = "struct<user_id:bigint>"
    rows = [("t", 0, "d", (1001,), None, "d", "t", 5), ("t", 1, "u", (1,), (1001,), "d", "t", 6), ("t", 2, "d", (1001,), None, "d", "t", 7), ("t", 3, "c", None, (1001,), "d", "t", 8)]
    log = spark.createDataFrame(rows, f"raw_topic string, offset long, op string, before {row}, after {row}, db string, tbl string, ts_ms long")
    records = jobs.keyed_records(jobs.moved_apart(log, ["user_id"]), ["user_id"])
    source, check, out = (f"file://{tmp_path}/{n}" for n in ("in", "check", "out"))
    records.coalesce(1).write.parquet(source)
    stream = jobs.merge_stream(spark.readStream.schema(records.schema).parquet(source), hold_ms=10**9)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(once=True).start().awaitTermination(120)
    got = spark.read.parquet(out).unionByName(jobs.held_deletes(spark, check)).select("offset", "op", "key", "event_ms", "reason").collect()
    want = events.normalize(log, ["user_id"], by_offset=True).select("seq", "op", "key", "event_ms", "reason").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want))) and [r["op"] for r in sorted(got)] == ["DELETE", "DELETE", "INSERT", "UPDATE"]


def test_the_merge_asks_the_state_once_for_all_rows_of_a_key():
    """However many rows a key has in a batch: the state is another process', and a call for each row takes most of the time."""
    import json

    from pyspark.sql import Row

    calls = []

    class Held:
        value = None

        def exists(self):
            calls.append("exists")
            return self.value is not None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def clear(self):
            calls.append("clear")
            self.value = None

    class Handle:
        def getValueState(self, *given):
            return held

        def __getattr__(self, name):
            return lambda *given: calls.append(name) or []

    class Timers:
        def getCurrentProcessingTimeInMs(self):
            return 0

    fields = ("offset", "op", "before", "after", "db", "tbl", "ts_ms", "reason")

    def row(*values):  # with the columns one by one, and packed
        packed = json.dumps([None if v is None else str(v) for v in values])
        return Row(raw_topic="t", key="k", record=packed, **dict(zip(fields, values)))

    held = Held()
    merge = jobs.MergeSplitUpdates(1)
    merge.init(Handle())
    rows = [r for i in range(0, 300, 3) for r in (row(i, "d", "b", None, "d", "t", i, None), row(i + 1, "c", None, "a", "d", "t", i + 1, None), row(i + 2, "u", "a", "b", "d", "t", i + 2, None))]
    out = list(merge.handleInputRows(("t", "k"), iter(rows[::-1]), Timers()))
    assert [r["op"] for r in out] == ["UPDATE"] * 200 and [r["offset"] for r in out] == [i for i in range(300) if i % 3 != 1]
    assert len(calls) <= 4


def test_registered_merge_gives_all_that_the_batch_does(spark):
    from cdcflow import queries

    sf = "/root/testdata/sf0.001"
    got = queries.stream_split_update_merge(spark, sf).select("seq", "op", "event_ms").collect()
    log = events.dense_order(queries._log(spark, sf)).withColumn("offset", events.F.col("seq")).drop("seq")
    want = events.normalize(log, testlog.KEYS).selectExpr("seq", "op", "event_ms").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and any(r["op"] == "DELETE" for r in got)


COLUMNS = "table_name string, column_name string, position int, type_name string, jdbc_type int, size int, scale int, nullable boolean, default_value string"
KEYS = "table_name string, index_name string, key_seq int, column_name string, is_primary boolean"


def test_a_drift_scan_stops_only_the_changed_tables_stream(spark, tmp_path):
    import time

    tables = {"a": [("a", "id", 1, "int", 4, 10, 0, False, None)], "b": [("b", "id", 1, "int", 4, 10, 0, False, None)]}
    read = lambda: (spark.createDataFrame(sum(tables.values(), []), COLUMNS), spark.createDataFrame([(t, "P", 1, "id", True) for t in tables], KEYS))
    streams = {}
    for t in ("a", "b"):
        spark.range(3).write.parquet(f"file://{tmp_path}/{t}")
        stream = spark.readStream.schema("id long").parquet(f"file://{tmp_path}/{t}")
        streams[t] = stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/out_{t}").option("checkpointLocation", f"file://{tmp_path}/check_{t}").start()
    scan = monitor.DriftScan(spark, f"file://{tmp_path}/baseline", read, streams)
    try:
        assert scan.scan() == [] == scan.scan()  # the first sets the baselines
        tables["c"] = [("c", "id", 1, "int", 4, 10, 0, False, None)]
        tables["a"] = [*tables["a"], ("a", "more", 2, "text", 12, 9, 0, True, None)]
        ticking = scan.start(1, f"file://{tmp_path}/check_scan")
        end = time.time() + 90
        while streams["a"].isActive and time.time() < end:
            time.sleep(0.5)
        ticking.stop()
        assert not streams["a"].isActive and streams["b"].isActive
        assert scan.scan() == [("a", "ADD_COLUMN", "LOW")]
        scan.accept("a")
        assert scan.scan() == [] and {r["table_name"] for r in scan.columns.read().collect()} == {"a", "b", "c"}
        spark.range(3, 5).write.mode("append").parquet(f"file://{tmp_path}/b")
        streams["b"].processAllAvailable()
        assert spark.read.parquet(f"file://{tmp_path}/out_b").count() == 5
    finally:
        for q in streams.values():
            q.stop()


def test_progress_tells_what_the_batch_form_does(spark, tmp_path):
    import json
    import time

    from cdcflow.operators import guards
    from pyspark.sql import functions as F

    rows = [("t", i // 40, i % 40, 0, 1000 + i) for i in range(60)]
    schema = "raw_topic string, run int, seq long, sub int, event_ms long"
    batch = spark.createDataFrame(rows, schema)
    batch.coalesce(1).write.parquet(f"file://{tmp_path}/e")
    listener = monitor.ProgressSamples(spark, f"file://{tmp_path}/samples")
    spark.streams.addListener(listener)
    try:
        q = monitor.observed(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/e")).writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).queryName("delivery").start()
        q.awaitTermination()
        end = time.time() + 60
        while not (tmp_path / "samples").exists() and time.time() < end:
            time.sleep(0.2)
        time.sleep(2)
    finally:
        spark.streams.removeListener(listener)
    got = spark.read.parquet(f"file://{tmp_path}/samples").where("delivered > 0").first()
    want = guards.delivery_stats(batch, F.lit(0)).first()
    assert (got["delivered"], got["last_seq"], got["last_event_ms"], got["name"]) == (want["delivered"], want["last_seq"], want["last_event_ms"], "delivery") and got["lag_ms"] > 0
    kafka = {"endOffset": json.dumps({"t": {"0": 5, "1": 7}}), "latestOffset": json.dumps({"t": {"0": 9, "1": 7}, "u": {"0": 2}})}
    assert monitor.backlog_of([kafka]) == 6 and monitor.backlog_of([{"endOffset": {"logOffset": 3}, "latestOffset": None}]) is None
    ends = spark.createDataFrame([("t0", 9), ("t1", 7), ("u", 2)], "raw_topic string, end_offset long")
    done = spark.createDataFrame([("t0", 5, False, 0), ("t1", 7, False, 0)], "raw_topic string, position long, stopped boolean, raw_backlog long")
    assert guards.backlog(ends, done).agg(F.sum("backlog")).first()[0] == 6
