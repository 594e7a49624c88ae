"""Pruned starts, balanced splits, positions of versions, ancestors from parents."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cdcflow.operators import events, reconcile, scope
from cdcflow.sources import readers
from cdcflow.sources.log_index import LogIndex
from cdcflow.sources.sinks import BucketedTable, VersionedTable, jdbc_overwrite

LOG = "raw_topic string, offset long, op string, ts_ms long, log_file string, log_pos long"


def test_starts_read_only_the_files_behind_them(spark, tmp_path):
    path = f"file://{tmp_path}/raw"
    index = LogIndex(spark, f"file://{tmp_path}/index", path, LOG)
    for part in range(6):
        rows = [("t" if i % 3 else "u", i, "c", 1_000_000 + 500 * i, f"bin.{9 + part // 2:06d}" if part < 4 else f"bin.{999_998 + part}", 4 + i) for i in range(20 * part, 20 * part + 20)]
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(path)
        if part in (2, 5):
            assert index.refresh() == 3
    assert index.refresh() == 0
    log = spark.read.schema(LOG).parquet(path)
    start = dt.datetime(1970, 1, 1, 8, 0) + dt.timedelta(milliseconds=1_000_000 + 500 * 70)
    for mode, files, how in (("LATEST", 1, {"end_offset": 105}), ("TIMESTAMP", 3, {"wall_clock": start.isoformat(" ")}), ("SPECIFIC", 2, {"file": "bin.000011", "position": 4}), ("SPECIFIC", 4, {"file": "bin.000010", "position": 60}), ("LATEST", 0, {"end_offset": 120})):
        got = index.read_from(mode, **how)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, log.where(readers.start_filter(mode, **how)).collect()))
        assert len(index.files(mode, **how)) == files == len(got.inputFiles())
    one = index.read_from("LATEST", topic="u", end_offset=60)
    assert sorted(r["offset"] for r in one.collect()) == [i for i in range(60, 120) if i % 3 == 0]


def test_kafka_starts_and_limits():
    assert readers.kafka_start("LATEST", "t") == {"startingOffsets": "latest"}
    assert readers.kafka_start("TIMESTAMP", "t", wall_clock="2024-01-01 08:00:00")["startingTimestamp"] == "1704067200000"
    assert readers.kafka_start("SPECIFIC", "t", offsets={0: 7})["startingOffsets"] == '{"t": {"0": 7}}'
    with pytest.raises(ValueError):
        readers.kafka_start("SPECIFIC", "t")
    assert readers.read_limits(1000, 1 << 20, 10, kafka=True, row_bytes=12_288) == {"maxOffsetsPerTrigger": "853"}
    assert readers.read_limits(10, 1 << 20, 10, kafka=False, row_bytes=1000) == {"maxBytesPerTrigger": "100000"}
    assert readers.read_limits(10, 1 << 20, 10, kafka=True) == {"maxOffsetsPerTrigger": "100"}


URL = "jdbc:derby:memory:split;create=true"


@pytest.mark.parametrize("kind", ["number", "text", "time"])
def test_parts_of_a_skewed_key_are_alike(spark, kind):
    i = F.col("id")
    number = F.when(i < 2700, i).otherwise(i * i * 1000)  # nine tenths lie in the first promille of the range
    key = {"number": number, "text": F.concat(F.lit("k'"), F.format_string("%012d", number)), "time": F.timestamp_seconds(number)}[kind]
    df = spark.range(3000).select((key if kind == "text" else F.when(i % 500 != 7, key)).alias("k"), i.alias("v"))  # Derby takes no null for a text that Spark writes
    jdbc_overwrite(df, URL, f"split_{kind}", "k VARCHAR(40)" if kind == "text" else None)
    back = readers.balanced_snapshot(spark, URL, f"split_{kind}", ["k", "v"], "k", 4)
    sizes = [r["n"] for r in back.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 4 and sum(sizes) == 3000 and max(sizes) < 2 * min(sizes)
    assert back.select("v").distinct().count() == 3000


def test_predicates_of_few_or_no_values(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "k long")
    assert readers.balanced_predicates(df, "k", "k", 4) == ["1 = 1"] == readers.balanced_predicates(df.limit(0), "k", "k", 4)
    two = spark.createDataFrame([(1,)] * 9 + [(2,)], "k long")
    assert readers.balanced_predicates(two, "k", "k", 10) == ["k < 2", "k >= 2 OR k IS NULL"]
    assert readers.sql_literal(dt.date(2024, 1, 2)) == "{d '2024-01-02'}" and readers.sql_literal("a'b") == "'a''b'"


ROW = "struct<id:bigint,name:string>"


def changed(spark, first, *records):
    log = [("t", first + i, op, b, a, "d", "t", i) for i, (op, b, a) in enumerate(records)]
    return events.normalize(spark.createDataFrame(log, f"raw_topic string, offset long, op string, before {ROW}, after {ROW}, db string, tbl string, ts_ms long"), ["id"], by_offset=True)


@pytest.mark.parametrize("bucketed", [False, True])
def test_a_check_holds_while_changes_go_on(spark, tmp_path, bucketed):
    base = spark.range(20).select("id", F.concat(F.lit("n"), "id").alias("name"))
    t = BucketedTable(spark, f"file://{tmp_path}/t", ["id"], 4) if bucketed else VersionedTable(spark, f"file://{tmp_path}/t")
    t.overwrite(base)
    with pytest.raises(ValueError):
        reconcile.check_at_position(base, changed(spark, 0), t, ["id"])
    first, second = [("u", (1, "n1"), (1, "x")), ("d", (2, "n2"), None)], [("c", None, (50, "y")), ("u", (1, "x"), (1, "z")), ("d", (3, "n3"), None)]
    t.apply(changed(spark, 0, *first), ["id"])
    assert t.position() == {"run": 0, "seq": 1} and t.position(1) is None
    everything = changed(spark, 0, *first, *second)
    good = reconcile.check_at_position(base, everything, t, ["id"]).first()
    assert good["matched"] and good["source_rows"] == good["target_rows"] == 19
    from cdcflow.operators.apply import merged_into

    now = reconcile.compare_rows(merged_into(base, everything, ["id"]), t.read(), ["id"]).first()
    assert (now["missing"], now["extra"], now["different"], now["matched"]) == (1, 1, 1, False)
    t.apply(changed(spark, 2, *second), ["id"])
    assert t.position()["seq"] == 4 and reconcile.check_at_position(base, everything, t, ["id"]).first()["matched"]
    t.apply(changed(spark, 9), ["id"])  # nothing new: the position stays
    assert t.position()["seq"] == 4


def test_rows_are_compared_whole_and_keys_may_repeat(spark):
    a = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (None, "n")], "id long, name string")
    same = spark.createDataFrame([(1, "b"), (None, "n"), (1, "a"), (2, None)], "id int, name string")
    assert reconcile.compare_rows(a, same, ["id"]).first()["matched"]
    other = reconcile.compare_rows(a, spark.createDataFrame([(1, "a"), (1, "a"), (2, ""), (9, None)], "id long, name string"), ["id"]).first()
    assert (other["missing"], other["extra"], other["different"]) == (1, 1, 2)
    none = reconcile.compare_rows(a.limit(0), a.limit(0), ["id"]).first()
    assert none["matched"] and none["source_rows"] == 0


def test_ancestors_from_parents(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (6, 4), (7, 99), (8, None)]
    parents = dict(rows)
    def up(n):
        out, at = [], parents.get(n)
        while at is not None:
            out.append(at)
            at = parents.get(at)
        return out
    df = spark.createDataFrame(rows, "dept_id long, parent_id long")
    got = {(r["dept_id"], r["ancestor_id"], r["distance"]) for r in scope.ancestors(df).collect()}
    assert got == {(n, a, i + 1) for n, _ in rows for i, a in enumerate(up(n))}
    line = spark.createDataFrame([(n, ",".join(map(str, [0, *reversed(up(n))]))) for n, _ in rows], "dept_id long, ancestors string")
    roots = spark.createDataFrame([(1,), (4,), (77,)], "root_id long")
    want = {tuple(r) for r in scope.descendants(line, roots).collect()}
    assert {tuple(r) for r in scope.descendants_by_parent(df, roots).collect()} == want and len(want) == 9
    for circle in ([(1, 2), (2, 3), (3, 1)], [(1, 1)]):
        with pytest.raises(ValueError):
            scope.ancestors(spark.createDataFrame(circle + [(9, 1)], "dept_id long, parent_id long")).count()
    assert scope.ancestors(df.limit(0)).count() == 0


def test_plain_rows_get_their_time_and_table_and_refuse_company(spark):
    from cdcflow.functions import decode
    from cdcflow.operators import guards

    values = [("snap", 0, '{"id":1}'), ("snap", 1, '{"id":2}'), ("mixed", 0, '{"id":3}'), ("mixed", 1, '{"before":null,"after":{"id":4},"op":"c","source":{"db":"d","table":"t","ts_ms":3},"ts_ms":9}')]
    raw = spark.createDataFrame(values, "raw_topic string, offset long, value string")
    log = decode.received_rows(decode.decode_log(raw, [decode.Field("id", "int")]), F.lit(77), " ", "people")
    goes, held = guards.publish_prefix(events.normalize(log, ["id"]))
    assert [(r["key"], r["phase"], r["event_ms"], r["sourceDatabase"], r["sourceTable"]) for r in goes.orderBy("seq").collect()] == [('{"id":1}', "SNAPSHOT", 77, "unknown", "people"), ('{"id":2}', "SNAPSHOT", 77, "unknown", "people")]
    assert {(r["raw_topic"], r["first_reason"]) for r in held.collect()} == {("mixed", "missing op")} and held.count() == 2


def test_targets_are_created_with_their_keys(spark):
    from cdcflow.sources.catalog import list_tables, read_catalog
    from cdcflow.sources.sinks import create_table_sql, jdbc_create

    schema = spark.createDataFrame([], "id long, code string NOT NULL, price decimal(12,2), at timestamp").schema
    url = "jdbc:derby:memory:made;create=true"
    jdbc_create(spark, url, create_table_sql(schema, "MADE", ["ID"], "standard", unique=[["code"]]))
    columns, keys, errors = read_catalog(spark, url, ["MADE", "NOT_THERE"])
    assert {r["column_name"]: r["nullable"] for r in columns.collect()} == {"id": False, "code": False, "price": True, "at": True}
    assert {(r["column_name"], r["is_primary"]) for r in keys.collect()} >= {("id", True), ("code", False)} and errors.count() == 1
    some = create_table_sql(schema, "t", ["id"], "postgresql", unique=[["code"]], selected=["ID", "code"])
    assert some == 'CREATE TABLE t ("id" BIGINT NOT NULL, "code" TEXT NOT NULL, PRIMARY KEY ("id"))'  # keys beside the sync key go with whole tables only
    assert "`code` VARCHAR(255) NOT NULL" in create_table_sql(schema, "t", ["code"], "mysql")
    with pytest.raises(ValueError):
        create_table_sql(schema, "t", ["id"], "mysql", selected=["code"])
    assert "MADE" in {r["table_name"] for r in list_tables(spark, url).collect()}
