"""The registered queries and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import decode, masking, predicates, text
from .operators import apply, events, formats, guards, metrics, reconcile, reports, schema, scope
from .plans import spec, testlog
from .sources import readers
from .streaming import jobs
from .streaming.publisher import LogPublisher

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testlog.change_log(_t(spark, sf_dir, "events"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.normalize(_log(spark, sf_dir), testlog.KEYS)


def _flat(df: DataFrame) -> DataFrame:
    parts = [F.col(f"{i}.{c}").alias(f"{p}_{n}") for i, p in (("before", "b"), ("data", "d")) for c, n in zip(testlog.COLUMNS, ("user", "type", "amount", "note"))]
    return df.select("seq", "sub", "op", F.get_json_object("key", "$.user_id").cast("long").alias("k"), *parts, "event_ms")


LOG = "WITH " + testlog.LOG_SQL

# --- change events


@query(LOG + "SELECT seq, sub, op, k, b_user, b_type, b_amount, b_note, d_user, d_type, d_amount, d_note, event_ms FROM ev")
def q_event_normalize(spark, sf_dir):
    return _flat(_events(spark, sf_dir))


@query(LOG + "SELECT op, 'CDC' AS phase, count(*) AS n FROM ev GROUP BY op UNION ALL SELECT 'INSERT', 'SNAPSHOT', count(*) FROM orders")
def q_event_counts_by_op_phase(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    snap = events.snapshot_events(orders, ["o_orderkey"], "shop", "orders", F.lit(0))
    both = _events(spark, sf_dir).select("op", "phase").unionByName(snap.select("op", "phase"))
    return both.groupBy("op", "phase").agg(F.count("*").alias("n"))


@query(LOG + "SELECT seq, k, b_amount, d_amount, event_ms FROM ev JOIN (SELECT seq AS s, op AS raw_op FROM raw) ON seq = s WHERE op = 'UPDATE' AND raw_op = 'd'")
def q_split_update_merge(spark, sf_dir):
    e = _flat(_events(spark, sf_dir)).where("op = 'UPDATE'")
    pairs = e.join(events.dense_order(_log(spark, sf_dir)).where("op = 'd'").select("seq"), "seq", "left_semi")
    return pairs.select("seq", "k", "b_amount", "d_amount", "event_ms")


@query(LOG + "SELECT seq, sub, op, k, event_ms FROM (SELECT *, max(sub) OVER (PARTITION BY seq) AS parts FROM ev) WHERE parts = 1")
def q_key_change_split(spark, sf_dir):
    """Both halves of each record whose key changed."""
    parts = F.max("sub").over(Window.partitionBy("seq"))  # two rows at most
    return _flat(_events(spark, sf_dir)).withColumn("parts", parts).where("parts = 1").select("seq", "sub", "op", "k", "event_ms")


def _broken_log(spark, sf_dir):
    """The log with records that have no database: every view in its second half."""
    log = _log(spark, sf_dir)
    half = log.agg(F.floor(F.max("offset") / 2).alias("half"))
    broken = (F.col("after.event_type") == "view") & (F.col("op") == "u") & (F.col("before.user_id") == F.col("after.user_id")) & (F.col("offset") >= F.col("half"))
    return log.join(F.broadcast(half)).withColumn("db", F.when(F.coalesce(broken, F.lit(False)), F.lit(" ")).otherwise(F.col("db"))).drop("half")  # half: one row


@query(
    LOG
    + """, bad AS (SELECT min(seq) AS s FROM raw WHERE event_type = 'view' AND "offset" >= (SELECT max("offset") // 2 FROM raw))
SELECT seq, sub, op, k FROM ev WHERE seq < (SELECT s FROM bad) UNION ALL SELECT s, NULL, 'missing source', NULL FROM bad"""
)
def q_publish_stops_at_unreliable(spark, sf_dir):
    """Events up to the first record without a database, and why it stopped there; every view in the second half of the log is such a record."""
    goes, held = guards.publish_prefix(events.normalize(_broken_log(spark, sf_dir), testlog.KEYS))
    why = held.groupBy("raw_topic").agg(F.min("first_bad").alias("seq"), F.min("first_reason").alias("op"))
    return _flat(goes).select("seq", "sub", "op", "k").unionByName(why.select("seq", F.lit(None).cast("int").alias("sub"), "op", F.lit(None).cast("long").alias("k")))


@query(
    LOG
    + """SELECT 't' || coalesce(d_user, b_user) % 3 AS topic, count(*) FILTER (p < 50) AS early, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(a_user, b_user) % 3 ORDER BY "offset") - 1 AS p, coalesce(a_user, b_user) AS d_user FROM raw WHERE op <> 'd' AND (b_user IS NULL OR a_user = b_user)) GROUP BY 1"""
)
def q_snapshot_phase_by_topic(spark, sf_dir):
    """How many of each topic's records, of those that stay single, come as the snapshot's: the first 50 of every topic."""
    log = _log(spark, sf_dir).where("op <> 'd' and (before.user_id is null or after.user_id = before.user_id)")
    log = log.withColumn("raw_topic", F.concat(F.lit("t"), F.col("after.user_id") % 3))
    e = events.normalize(log, testlog.KEYS, snapshot_count=50)
    return e.groupBy(F.col("raw_topic").alias("topic")).agg(F.count_if(F.col("phase") == "SNAPSHOT").alias("early"), F.count("*").alias("n"))


@query(
    LOG
    + """, snap AS (SELECT DISTINCT user_id FROM events)
SELECT CAST(-1 AS BIGINT) AS seq, 0 AS sub, 'INSERT' AS op, user_id AS k, 'SNAPSHOT' AS phase FROM snap UNION ALL SELECT seq, sub, op, k, 'CDC' FROM ev"""
)
def q_snapshot_then_changes(spark, sf_dir):
    none = F.lit(None)
    rows = _t(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("user_id")).distinct().select("user_id", none.cast("string").alias("event_type"), none.cast("long").alias("amount"), none.cast("string").alias("note"))
    snap = events.snapshot_events(rows, testlog.KEYS, testlog.DATABASE, testlog.TABLE, F.lit(0))
    both = events.snapshot_then_changes(snap, _events(spark, sf_dir))
    return both.select("seq", "sub", "op", F.get_json_object("key", "$.user_id").cast("long").alias("k"), "phase")


@query(LOG + "SELECT seq, sub, b_amount AS before_amount, d_user AS data_user, d_amount AS data_amount FROM ev")
def q_project_images(spark, sf_dir):
    e = events.normalize(_log(spark, sf_dir), testlog.KEYS, columns=["user_id", "amount"])
    return e.select("seq", "sub", F.col("before.amount").alias("before_amount"), F.col("data.user_id").alias("data_user"), F.col("data.amount").alias("data_amount"))


SNAPSHOT_RECORDS = 200  # of the log that the format queries take as the snapshot's: inserts, updates and deletes


def _format(name: str):
    def run(spark, sf_dir):
        return formats.serialize(events.normalize(_log(spark, sf_dir), testlog.KEYS, snapshot_count=SNAPSHOT_RECORDS), testlog.KEYS, name)

    return run


_J = lambda c, path: F.get_json_object("value", path).alias(c)
_TIME_SQL = "strftime(make_timestamp(event_ms * 1000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_ms % 1000 = 0 THEN 'Z' ELSE '.' || lpad(CAST(event_ms % 1000 AS VARCHAR), 3, '0') || 'Z' END"


@query(
    LOG
    + f"""SELECT seq, sub, op, CAST(k AS VARCHAR) AS key_user, CAST(d_user AS VARCHAR) AS data_user, d_note AS data_note, CAST(b_amount AS VARCHAR) AS before_amount, 'app' AS db, 'accounts' AS tbl,
    {_TIME_SQL} AS at, CASE WHEN seq < {SNAPSHOT_RECORDS} THEN 'SNAPSHOT' ELSE 'CDC' END AS phase FROM ev"""
)
def q_fmt_envelope(spark, sf_dir):
    return _envelope_fields(_format("ENVELOPE")(spark, sf_dir))


def _envelope_fields(v: DataFrame) -> DataFrame:
    return v.select(
        "seq", "sub", _J("op", "$.op"), _J("key_user", "$.key.user_id"), _J("data_user", "$.data.user_id"), _J("data_note", "$.data.note"), _J("before_amount", "$.before.amount"), _J("db", "$.source.database"),
        _J("tbl", "$.source.table"), _J("at", "$.sourceEventTime"), _J("phase", "$.phase"),
    )


_OLD_SQL = "CASE WHEN op = 'UPDATE' AND (d_amount IS NULL OR b_amount IS DISTINCT FROM d_amount) THEN CAST(b_amount AS VARCHAR) END"


@query(
    LOG
    + f"""SELECT seq, sub, op AS type, CAST(event_ms AS VARCHAR) AS es, CAST(d_amount AS VARCHAR) AS amount, {_OLD_SQL} AS old_amount, op = 'UPDATE' AS has_old, '["user_id"]' AS keys, 'false' AS ddl FROM ev"""
)
def q_fmt_canal(spark, sf_dir):
    v = _format("CANAL_JSON")(spark, sf_dir)
    return v.select("seq", "sub", _J("type", "$.type"), _J("es", "$.es"), _J("amount", "$.data[0].amount"), _J("old_amount", "$.old[0].amount"), F.col("value").contains('"old":').alias("has_old"), _J("keys", "$.pkNames"), _J("ddl", "$.isDdl"))


@query(
    LOG
    + f"""SELECT seq, sub, CASE op WHEN 'INSERT' THEN CASE WHEN seq < {SNAPSHOT_RECORDS} THEN 'r' ELSE 'c' END WHEN 'UPDATE' THEN 'u' ELSE 'd' END AS op, CAST(b_user AS VARCHAR) AS before_user, CASE WHEN op <> 'DELETE' THEN CAST(d_user AS VARCHAR) END AS after_user,
    CAST(event_ms AS VARCHAR) AS ts_ms, CAST(event_ms AS VARCHAR) AS sent_ms, 'accounts' AS tbl, CASE WHEN seq < {SNAPSHOT_RECORDS} THEN 'true' END AS snapshot FROM ev"""
)
def q_fmt_debezium(spark, sf_dir):
    v = _format("COMPATIBLE_DEBEZIUM_JSON")(spark, sf_dir)
    return v.select("seq", "sub", _J("op", "$.op"), _J("before_user", "$.before.user_id"), _J("after_user", "$.after.user_id"), _J("ts_ms", "$.source.ts_ms"), _J("sent_ms", "$.ts_ms"), _J("tbl", "$.source.table"), _J("snapshot", "$.source.snapshot"))


@query(LOG + f"SELECT seq, sub, lower(op) AS type, CAST(event_ms // 1000 AS VARCHAR) AS ts, CAST(d_user AS VARCHAR) AS data_user, {_OLD_SQL} AS old_amount FROM ev")
def q_fmt_maxwell(spark, sf_dir):
    v = _format("MAXWELL_JSON")(spark, sf_dir)
    return v.select("seq", "sub", _J("type", "$.type"), _J("ts", "$.ts"), _J("data_user", "$.data.user_id"), _J("old_amount", "$.old.amount"))


@query(
    LOG
    + """SELECT seq, sub, 'app.accounts' AS tbl, left(op, 1) AS op_type, strftime(make_timestamp(event_ms * 1000), '%Y-%m-%d %H:%M:%S.%f') AS op_ts, CASE WHEN op <> 'DELETE' THEN CAST(d_amount AS VARCHAR) END AS after_amount FROM ev"""
)
def q_fmt_ogg(spark, sf_dir):
    v = _format("OGG_JSON")(spark, sf_dir)
    return v.select("seq", "sub", _J("tbl", "$.table"), _J("op_type", "$.op_type"), _J("op_ts", "$.op_ts"), _J("after_amount", "$.after.amount"))


_LIVE = LOG + ", last AS (SELECT k, arg_max(op, seq * 2 + sub) AS op, arg_max({a: d_amount, t: d_type}, seq * 2 + sub) AS d FROM ev {where} GROUP BY k)"


@query(_LIVE.replace("{where}", "") + "SELECT k AS user_id, d.t AS event_type, d.a AS amount FROM last WHERE op <> 'DELETE'")
def q_apply_changelog(spark, sf_dir):
    return apply.applied(_events(spark, sf_dir)).select("user_id", "event_type", "amount")


@query(_LIVE.replace("{where}", "WHERE seq <= (SELECT max(seq) // 2 FROM raw)") + "SELECT k AS user_id, d.t AS event_type, d.a AS amount FROM last WHERE op <> 'DELETE'")
def q_state_at_offset(spark, sf_dir):
    e = _events(spark, sf_dir)
    half = _log(spark, sf_dir).agg(F.floor((F.count("*") - 1) / 2).alias("half"))
    upto = e.join(F.broadcast(half)).where("seq <= half").drop("half")  # one row
    return apply.applied(upto).select("user_id", "event_type", "amount")


@query(
    LOG
    + """, last AS (SELECT k, arg_max(op, seq * 2 + sub) AS op, arg_max({a: d_amount}, seq * 2 + sub) AS d FROM ev GROUP BY k)
SELECT c_custkey AS user_id, CAST(NULL AS BIGINT) AS amount FROM customer WHERE c_custkey NOT IN (SELECT k FROM last) UNION ALL SELECT k, d.a FROM last WHERE op <> 'DELETE'"""
)
def q_merge_into_base(spark, sf_dir):
    none = F.lit(None)
    base = _t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("user_id"), none.cast("string").alias("event_type"), none.cast("long").alias("amount"), none.cast("string").alias("note"))
    return apply.merged_into(base, _events(spark, sf_dir), testlog.KEYS).select("user_id", "amount")


@query(
    _LIVE.replace("{where}", "")
    + "SELECT (SELECT count(DISTINCT user_id) FROM events) AS source_rows, count(*) AS live_keys, (SELECT count(DISTINCT user_id) FROM events) - count(*) AS difference, (SELECT count(DISTINCT user_id) FROM events) = count(*) AS matched FROM last WHERE op <> 'DELETE'"
)
def q_topic_reconcile(spark, sf_dir):
    return apply.topic_reconciliation(_t(spark, sf_dir, "events").select("user_id").distinct(), _events(spark, sf_dir))


@query(
    LOG
    + ", last AS (SELECT k, arg_max(op, seq * 2 + sub) AS op, arg_max({t: d_type, a: d_amount}, seq * 2 + sub) AS d FROM ev GROUP BY k) SELECT d.t AS status, count(*) AS accounts, CAST(sum(d.a) AS BIGINT) AS amount FROM last WHERE op <> 'DELETE' GROUP BY d.t"
)
def q_flagship(spark, sf_dir):
    """Net state after the change log, by the status of the last change."""
    live = apply.applied(_events(spark, sf_dir))
    return live.groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("accounts"), F.sum("amount").alias("amount"))


# --- checks of source against target


def _orders_copy(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    return orders, orders.where("o_orderkey % 97 <> 0")


@query("SELECT count(*) AS source_rows, count(*) FILTER (o_orderkey % 97 <> 0) AS target_rows, count(*) FILTER (o_orderkey % 97 = 0) AS difference, count(*) FILTER (o_orderkey % 97 = 0) = 0 AS matched FROM orders")
def q_count_check(spark, sf_dir):
    return reconcile.count_check(*_orders_copy(spark, sf_dir))


#: The source has rows without a key, the target rows before and behind the source's keys, some of them in the last block.
_BLOCKS = """WITH src AS (SELECT CASE WHEN o_orderkey % 5000 = 7 THEN NULL ELSE o_orderkey END AS k FROM orders), r AS (SELECT min(k) AS lo, max(k) AS hi, greatest(1, CAST(ceil((max(k) - min(k)) / 50.0) AS BIGINT)) AS step FROM src),
tgt AS (SELECT k FROM src WHERE k % 97 <> 0 UNION ALL SELECT -k FROM src WHERE k % 500 = 0 UNION ALL SELECT hi + k % 1000 FROM src, r WHERE k % 700 = 1),
b AS (SELECT CAST(i AS BIGINT) AS i, lo + i * step AS lower, lo + i * step + step AS upper FROM (SELECT unnest(range(0, (hi - lo) // step + 1)) AS i, lo, step FROM r)),
x AS (SELECT i + 1 AS block_index, lower, upper, (SELECT count(*) FROM src WHERE k >= lower AND k < upper) AS source_rows, (SELECT count(*) FROM tgt WHERE k >= lower AND k < upper) AS target_rows FROM b)
"""


def _keyed_sides(spark, sf_dir):
    k = F.col("o_orderkey")
    source = _t(spark, sf_dir, "orders").select(F.when(k % 5000 != 7, k).alias("o_orderkey"))
    low, high, _ = reconcile.key_range(source, "o_orderkey").first()
    target = source.where(k % 97 != 0).unionByName(source.where(k % 500 == 0).select((-k).alias("o_orderkey"))).unionByName(source.where(k % 700 == 1).select((high + k % 1000).alias("o_orderkey")))
    return source, target, "o_orderkey", max(1, -(-(high - low) // 50))


@query(_BLOCKS + "SELECT *, source_rows - target_rows AS difference, target_rows = source_rows AS matched FROM x")
def q_key_range_blocks(spark, sf_dir):
    return reconcile.key_range_blocks(*_keyed_sides(spark, sf_dir))


@query(
    _BLOCKS
    + """, v AS (SELECT count(*) AS total_blocks, count(*) FILTER (source_rows = target_rows) AS matched_blocks, (SELECT count(*) FROM src) AS source_rows, CAST(sum(target_rows) AS BIGINT) AS target_rows, (SELECT count(*) FROM tgt) - CAST(sum(target_rows) AS BIGINT) AS target_outside FROM x)
SELECT *, total_blocks - matched_blocks AS mismatched_blocks, source_rows - target_rows AS difference, source_rows = target_rows AND matched_blocks = total_blocks AS matched FROM v"""
)
def q_block_verdict(spark, sf_dir):
    return reconcile.block_verdict(*_keyed_sides(spark, sf_dir))


def _group(spark, sf_dir):
    orders, part = _orders_copy(spark, sf_dir)
    c = _t(spark, sf_dir, "customer")
    return reconcile.group_check({"orders": (orders, part), "customer": (c, c), "lost": (lambda: _t(spark, sf_dir, "no_such_table"), c)})


@query(
    """SELECT 'orders' AS table_name, count(*) AS source_rows, count(*) FILTER (o_orderkey % 97 <> 0) AS target_rows, count(*) FILTER (o_orderkey % 97 = 0) AS difference, 'MISMATCHED' AS status FROM orders
UNION ALL SELECT 'customer', count(*), count(*), 0, 'MATCHED' FROM customer UNION ALL SELECT 'lost', NULL, NULL, NULL, 'FAILED'"""
)
def q_group_check(spark, sf_dir):
    return _group(spark, sf_dir)


@query("SELECT CAST(1 AS BIGINT) AS matched, CAST(count(*) FILTER (n) AS BIGINT) AS mismatched, CAST(1 AS BIGINT) AS failed FROM (SELECT count(*) FILTER (o_orderkey % 97 = 0) > 0 AS n FROM orders)")
def q_group_check_summary(spark, sf_dir):
    return reconcile.group_summary(_group(spark, sf_dir))


# --- delivery guards


def _sized(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.concat_ws(".", F.lit("raw"), "source").alias("raw_topic"), F.col("doc_id").alias("seq"), F.lit(0).alias("sub"), F.to_json(F.struct("doc_id")).alias("key"), F.col("text").alias("value"))
    return guards.with_size_reason(docs, 16_000, 12_000)


_SIZED = """WITH s AS (SELECT 'raw.' || source AS raw_topic, doc_id AS seq, octet_length(encode('{"doc_id":' || CAST(doc_id AS VARCHAR) || '}')) + coalesce(octet_length(encode(text)), 0) + 128 AS record_bytes FROM documents),
b AS (SELECT raw_topic, min(seq) AS first_bad, arg_min(record_bytes, seq) AS bytes FROM s WHERE record_bytes > 12000 GROUP BY 1)
"""


@query(_SIZED + "SELECT raw_topic, seq, CAST(record_bytes AS BIGINT) AS record_bytes, record_bytes > 12000 AS refused FROM s")
def q_size_guard(spark, sf_dir):
    return _sized(spark, sf_dir).select("raw_topic", "seq", F.col("record_bytes").cast("long"), F.col("size_reason").isNotNull().alias("refused"))


@query(_SIZED + "SELECT s.raw_topic, seq, FALSE AS held, CAST(NULL AS BIGINT) AS first_bad FROM s LEFT JOIN b USING (raw_topic) WHERE first_bad IS NULL OR seq < first_bad UNION ALL SELECT s.raw_topic, seq, TRUE, first_bad FROM s JOIN b USING (raw_topic) WHERE seq >= first_bad")
def q_publish_prefix(spark, sf_dir):
    goes, held = guards.publish_prefix(_sized(spark, sf_dir), "size_reason")
    return goes.select("raw_topic", "seq", F.lit(False).alias("held"), F.lit(None).cast("long").alias("first_bad")).unionByName(held.select("raw_topic", "seq", F.lit(True).alias("held"), "first_bad"))


_WORST = """WITH c AS (SELECT c_mktsegment AS table_name, c_custkey AS k, least(CASE WHEN c_custkey % 300 = 0 THEN 5000000000 WHEN c_custkey % 200 = 0 THEN 2000000 ELSE c_custkey END, 4294967296) AS b, c_nationkey % 2 = 0 AS chosen FROM customer WHERE c_custkey % 100 < 40 OR c_mktsegment <> 'BUILDING')
SELECT table_name, CAST(least({raw}, 4294967296) AS BIGINT) AS raw_bytes, CAST(least({event}, 4294967296) AS BIGINT) AS event_bytes, coalesce(string_agg('C' || k || '(text)', ',' ORDER BY k) FILTER (b > 1048576 AND {told}), '') AS large FROM c GROUP BY 1"""
_TAKEN = "sum(CASE WHEN chosen THEN b + 32 ELSE 0 END)"


def _worst(spark, sf_dir, cdc: bool):
    k = F.col("c_custkey")
    size = F.when(k % 300 == 0, 5_000_000_000).when(k % 200 == 0, 2_000_000).otherwise(k)
    cols = _t(spark, sf_dir, "customer").where("c_custkey % 100 < 40 or c_mktsegment <> 'BUILDING'")
    cols = cols.select(F.col("c_mktsegment").alias("table_name"), F.concat(F.lit("C"), k).alias("column_name"), F.lit("text").alias("type_name"), k.alias("position"), size.alias("value_bytes"), "c_nationkey")
    return guards.worst_case_sizes(cols, F.col("c_nationkey") % 2 == 0, cdc).select("table_name", "raw_bytes", "event_bytes", F.array_join("large_columns", ",").alias("large"))


@query(_WORST.format(raw="2 * sum(b + 32) + 320 * count(*) + 512", event=f"2 * {_TAKEN} + 512", told="TRUE"))
def q_worst_case_size(spark, sf_dir):
    return _worst(spark, sf_dir, True)


@query(_WORST.format(raw=f"{_TAKEN} + 512", event=f"{_TAKEN} + 512", told="chosen"))
def q_worst_case_size_full(spark, sf_dir):
    """The sizes of a run that only reads the tables: one image, of the selected columns."""
    return _worst(spark, sf_dir, False)


def _holed(spark, sf_dir):
    return _t(spark, sf_dir, "events").where("event_id % 97 <> 0").select(F.concat(F.lit("t"), F.col("user_id") % 5).alias("raw_topic"), F.col("event_id").alias("offset"))


@query("SELECT * FROM (SELECT 't' AS raw_topic, lag(event_id) OVER (ORDER BY event_id) AS after_offset, event_id - lag(event_id) OVER (ORDER BY event_id) - 1 AS missing FROM events WHERE event_id % 97 <> 0) WHERE missing > 0")
def q_offset_gaps(spark, sf_dir):
    return guards.holes(_holed(spark, sf_dir).withColumn("raw_topic", F.lit("t")), 1024)


_ENDS = "WITH e AS (SELECT 't' || CAST(user_id % 5 AS VARCHAR) AS raw_topic, min(event_id) AS b, max(event_id) + 1 AS n FROM events WHERE event_id % 97 <> 0 GROUP BY 1), p AS (SELECT raw_topic, CASE raw_topic WHEN 't0' THEN n - 10 WHEN 't1' THEN NULL WHEN 't2' THEN n + 5 ELSE b END AS position, raw_topic = 't1' AS fresh FROM e)"


def _positions(spark, sf_dir):
    ends = _holed(spark, sf_dir).groupBy("raw_topic").agg(F.min("offset").alias("b"), (F.max("offset") + 1).alias("n"))
    t = F.col("raw_topic")
    position = F.when(t == "t0", F.col("n") - 10).when(t == "t1", None).when(t == "t2", F.col("n") + 5).otherwise(F.col("b"))
    return ends.select("raw_topic", position.alias("position"), (t == "t1").alias("fresh"), F.col("n").alias("end_offset"))


@query(
    _ENDS
    + """SELECT raw_topic, b AS begin_offset, n AS end_offset, position, CASE WHEN position BETWEEN b AND n THEN 'RESUME' WHEN position IS NULL AND b = 0 THEN 'START' WHEN fresh THEN 'BEGIN' ELSE 'GAP' END AS action,
CASE WHEN position BETWEEN b AND n THEN position WHEN position IS NULL AND b = 0 THEN 0 WHEN fresh THEN b END AS start, CASE WHEN position > n THEN position - n WHEN position < b THEN b - position ELSE 0 END AS missing FROM e JOIN p USING (raw_topic)"""
)
def q_position_check(spark, sf_dir):
    return guards.position_check(_holed(spark, sf_dir), _positions(spark, sf_dir).drop("end_offset"))


@query(_ENDS + "SELECT raw_topic, greatest(0, n - coalesce(position, 0)) AS backlog, greatest(0, n - coalesce(position, 0)) + CASE WHEN fresh THEN 7 ELSE 0 END AS effective_backlog FROM e JOIN p USING (raw_topic)")
def q_backlog(spark, sf_dir):
    p = _positions(spark, sf_dir)
    return guards.backlog(p.select("raw_topic", "end_offset"), p.select("raw_topic", "position", F.col("fresh").alias("stopped"), F.lit(7).cast("long").alias("raw_backlog")))


@query(LOG + "SELECT 'raw.events' AS raw_topic, count(*) AS delivered, max(seq) AS last_seq, arg_max(event_ms, seq * 2 + sub) AS last_event_ms, CAST(1500 AS BIGINT) AS lag_ms FROM ev")
def q_publish_stats_lag(spark, sf_dir):
    return guards.delivery_stats(_events(spark, sf_dir), F.col("event_ms") + 1500)


# --- schemas: parts stand for columns, 40 tables of them


def _columns(spark, sf_dir, now: bool):
    p = _t(spark, sf_dir, "part")
    k = F.col("p_partkey")
    kinds = F.array(*[F.lit(x) for x in ("int", "varchar", "datetime", "blob", "tinyint", "decimal", "point", "json")])
    base = F.element_at(kinds, (k % 8 + 1).cast("int"))
    changed = (k % 40) % 4 == 1
    kind = F.when(changed & (k % 13 == 0), F.lit("text")).otherwise(base) if now else base
    keep = ~(changed & (k % 11 == 0)) if now else ~((k % 40) % 4 == 2) | (k % 17 != 0)
    return p.where(keep).select(
        F.concat(F.lit("tbl_"), k % 40).alias("table_name"), F.concat(F.lit("C"), k).alias("column_name"), k.alias("position"), kind.alias("type_name"), (k % 8).cast("int").alias("jdbc_type"),
        F.col("p_size").alias("size"), F.lit(0).alias("scale"), ((k % 40) % 4 != 2).__or__(k % 2 == 0).alias("nullable"), F.when(k % 3 == 0, F.lit("0")).alias("default_value"),
    )


def _keys(spark, sf_dir, now: bool):
    k = F.col("p_partkey")
    p = _t(spark, sf_dir, "part").where(k % 16 < 3)  # about a fifth of each table's columns are its key
    seq = F.when(F.lit(now) & ((k % 40) % 4 == 3), -k).otherwise(k)
    return p.select(F.concat(F.lit("tbl_"), k % 40).alias("table_name"), F.lit("PRIMARY").alias("index_name"), seq.alias("key_seq"), F.concat(F.lit("C"), k).alias("column_name"), F.lit(True).alias("is_primary"))


_META = """WITH p AS (SELECT p_partkey AS k, p_partkey % 40 AS t, (p_partkey % 40) % 4 AS m, p_size AS size, ['int', 'varchar', 'datetime', 'blob', 'tinyint', 'decimal', 'point', 'json'][p_partkey % 8 + 1] AS kind, ((p_partkey % 40) % 4 <> 2 OR p_partkey % 2 = 0) AS nullable FROM part),
b AS (SELECT *, kind AS type FROM p WHERE NOT (m = 2) OR k % 17 <> 0), n AS (SELECT *, CASE WHEN m = 1 AND k % 13 = 0 THEN 'text' ELSE kind END AS type FROM p WHERE NOT (m = 1 AND k % 11 = 0)),
j AS (SELECT coalesce(b.t, n.t) AS t, coalesce(b.m, n.m) AS m, b.k AS bk, n.k AS nk, b.type AS bt, n.type AS nt, n.nullable AS nn, coalesce(b.k, n.k) AS k FROM b FULL JOIN n ON b.k = n.k),
g AS (SELECT t, m, bool_or(bk IS NULL) AS added, bool_or(nk IS NULL) AS gone, bool_or(bk IS NOT NULL AND nk IS NOT NULL AND bt <> nt) AS altered, bool_or(bk IS NULL AND NOT nn) AS added_required, m = 3 AND count(*) FILTER (k % 16 < 3) > 1 AS rekeyed FROM j GROUP BY t, m)
"""


@query(
    _META
    + """SELECT 'tbl_' || t AS table_name, nullif(concat_ws(',', CASE WHEN added THEN 'ADD_COLUMN' END, CASE WHEN gone THEN 'DROP_COLUMN' END, CASE WHEN altered THEN 'ALTER_COLUMN' END, CASE WHEN rekeyed THEN 'KEY_CHANGED' END), '') AS change_type,
CASE WHEN NOT (added OR gone OR altered OR rekeyed) THEN NULL WHEN added AND NOT (gone OR altered OR rekeyed OR added_required) THEN 'LOW' ELSE 'HIGH' END AS risk_level FROM g"""
)
def q_schema_drift(spark, sf_dir):
    return schema.drift(_columns(spark, sf_dir, False), _keys(spark, sf_dir, False), _columns(spark, sf_dir, True), _keys(spark, sf_dir, True))


@query(_META + "SELECT 'tbl_' || t AS table_name, NOT (added OR gone OR altered OR rekeyed) AS same FROM g")
def q_schema_hash(spark, sf_dir):
    a, b = (schema.snapshots(_columns(spark, sf_dir, n), _keys(spark, sf_dir, n)) for n in (False, True))
    return a.join(b.select("table_name", F.col("hash").alias("h")), "table_name").select("table_name", (F.col("hash") == F.col("h")).alias("same"))


@query(_META + "SELECT 'tbl_' || t AS table_name, count(*) FILTER (bk IS NULL) AS added, count(*) FILTER (nk IS NULL) AS removed, count(*) FILTER (bk IS NOT NULL AND nk IS NOT NULL) AS common FROM j GROUP BY 1")
def q_column_sets(spark, sf_dir):
    s = schema.column_sets(_columns(spark, sf_dir, False), _columns(spark, sf_dir, True))
    return s.select("table_name", *[F.size(c).cast("long").alias(c) for c in ("added", "removed", "common")])


_FAMILY = "CASE WHEN {0} IN ('int', 'tinyint', 'decimal', 'point') THEN 'numeric' WHEN {0} IN ('varchar', 'text', 'json') THEN 'string' WHEN {0} = 'datetime' THEN 'temporal' ELSE 'binary' END"


@query(_META + f"SELECT 'C' || k AS column_name, type AS type_name, {_FAMILY.format('type')} AS family FROM n")
def q_type_family(spark, sf_dir):
    return _columns(spark, sf_dir, True).select("column_name", "type_name", schema.type_family(F.col("type_name"), F.col("jdbc_type")).alias("family"))


@query(
    _META
    + f""", c AS (SELECT t, m, string_agg('c' || bk, ',' ORDER BY 'c' || bk) FILTER (nk IS NULL) AS missing, string_agg('c' || bk, ',' ORDER BY 'c' || bk) FILTER (bk IS NOT NULL AND nk IS NOT NULL AND {_FAMILY.format('bt')} <> {_FAMILY.format('nt')}) AS incompatible,
string_agg('c' || nk, ',' ORDER BY 'c' || nk) FILTER (bk IS NULL AND NOT nn AND nk % 3 <> 0) AS extra_required FROM j GROUP BY t, m), r AS (SELECT t, rekeyed FROM g)
SELECT 'tbl_' || t AS table_name, coalesce(missing, '') AS missing, coalesce(incompatible, '') AS incompatible, coalesce(extra_required, '') AS extra_required, NOT rekeyed AS keys_equal,
missing IS NULL AND incompatible IS NULL AND extra_required IS NULL AND NOT rekeyed AS compatible FROM c JOIN r USING (t)"""
)
def q_target_compat(spark, sf_dir):
    keys = [schema.key_candidates(_columns(spark, sf_dir, n).withColumn("nullable", F.lit(False)), _keys(spark, sf_dir, n)).where("rank = 1") for n in (False, True)]
    # a key column that was dropped stays listed in the key, as it does in the database's own catalog
    return schema.target_compatibility(_columns(spark, sf_dir, False), _columns(spark, sf_dir, True), *keys, "FULL_CDC").select("table_name", "missing", "incompatible", "extra_required", "keys_equal", "compatible")


@query("SELECT table_name, row_number() OVER (ORDER BY table_name) <= 10 AS taken FROM (SELECT DISTINCT 'T_' || p_brand AS table_name FROM part) WHERE lower(table_name) NOT IN (SELECT DISTINCT lower('T_' || p_brand) FROM part WHERE p_size <= 1)")
def q_new_tables(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    name = F.concat(F.lit("T_"), "p_brand").alias("table_name")
    return schema.new_tables(p.select(name).distinct(), p.where("p_size <= 1").select(F.lower(name).alias("table_name")).distinct(), 10)


# --- run metrics: events are samples, users their owners


def _samples(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("sample_id"), F.col("user_id").alias("owner_id"), F.col("ts").cast("timestamp").alias("sampled_at"), F.col("event_type").alias("status"), F.floor(F.col("value") * 100).cast("long").alias("amount"))


_S = "WITH s AS (SELECT event_id AS sample_id, user_id AS owner_id, ts AS sampled_at, event_type AS status, CAST(floor(value * 100) AS BIGINT) AS amount FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY sampled_at, sample_id) AS rn, count(*) OVER (PARTITION BY owner_id) AS n FROM s)"


@query(_S + "SELECT owner_id, sample_id, status, amount FROM r WHERE rn = n")
def q_latest_per_owner(spark, sf_dir):
    return metrics.latest_per_owner(_samples(spark, sf_dir)).select("owner_id", "sample_id", "status", "amount")


@query(_S + "SELECT sample_id, owner_id FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY sampled_at, sample_id) AS p FROM s WHERE sampled_at >= (SELECT max(ts) FROM events) - INTERVAL 1440 MINUTE) WHERE p <= 20")
def q_series_window(spark, sf_dir):
    s = _samples(spark, sf_dir)
    s = s.join(F.broadcast(s.agg(F.max("sampled_at").alias("now"))))  # one row
    return metrics.series_window(s, F.col("now"), 100_000, 5).select("sample_id", "owner_id")


@query(_S + "SELECT sample_id, owner_id FROM r WHERE n <= 10 OR (rn - 1) % CAST(ceil(n / 10.0) AS BIGINT) = 0 OR rn = n")
def q_thin(spark, sf_dir):
    return metrics.thinned(_samples(spark, sf_dir), 10).select("sample_id", "owner_id")


@query(_S + ", a AS (SELECT *, CASE WHEN status IN ('error', 'purchase') THEN status END AS due FROM s), l AS (SELECT *, lag(due) OVER (PARTITION BY owner_id ORDER BY sampled_at, sample_id) AS was FROM a) SELECT sample_id, owner_id, status FROM l WHERE due IS NOT NULL AND due IS DISTINCT FROM was")
def q_alert_transitions(spark, sf_dir):
    return metrics.alert_transitions(_samples(spark, sf_dir), F.col("status").isin("error", "purchase")).select("sample_id", "owner_id", "status")


@query("SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN greatest(0, CAST(floor(value * 100) AS BIGINT) - 500) END AS backlog, CASE WHEN event_id % 5 <> 0 THEN (event_id % 9000) // 1000 END AS lag FROM events")
def q_sample_backlog_lag(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    i = F.col("event_id")
    got = F.when(i % 7 == 0, F.lit("n/a")).otherwise(F.floor(F.col("value") * 100).cast("long").cast("string"))
    commit = F.when(i % 5 == 0, -i - 1).otherwise(i % 9000)
    b, lag = metrics.sample_figures(got, F.lit(500), F.lit(0), commit)
    return e.select("event_id", b.alias("backlog"), lag.alias("lag"))


_STATUS = "CASE o_orderkey % 9 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'PAUSED' WHEN 3 THEN '' WHEN 4 THEN 'FINISHED' WHEN 5 THEN 'DDL_BLOCKED' WHEN 6 THEN 'PAUSING' WHEN 7 THEN 'STOPPED' ELSE NULL END"


def _jobs(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    names = F.array(*[F.lit(x) for x in ("RUNNING", "FAILED", "PAUSED", "", "FINISHED", "DDL_BLOCKED", "PAUSING", "STOPPED", None)])
    k = F.col("o_orderkey")
    return o.select(k.alias("job_id"), F.col("o_custkey").alias("group_id"), F.element_at(names, (k % 9 + 1).cast("int")).alias("status"), (k % 100).alias("checked_rows"), (k % 37).alias("lag"), F.when(k % 3 == 0, k % 10).alias("target_id"))


@query(f"SELECT count(*) AS total, count(*) FILTER (s = 'RUNNING') AS running, count(*) FILTER (s IN ('FAILED', 'REINITIALIZE_REQUIRED', 'DDL_BLOCKED')) AS failed, CAST(sum(k % 100) AS BIGINT) AS checked_rows, CAST(round(avg(CASE WHEN k % 2 = 0 THEN k % 37 END)) AS BIGINT) AS avg_lag FROM (SELECT o_orderkey AS k, {_STATUS} AS s FROM orders)")
def q_overview(spark, sf_dir):
    j = _jobs(spark, sf_dir)
    return metrics.overview(j.where("job_id % 2 = 0"), j.where("job_id % 2 = 1"))


@query(f"SELECT coalesce(nullif(s, ''), 'DRAFT') AS status, count(*) AS jobs FROM (SELECT {_STATUS} AS s FROM orders) GROUP BY 1")
def q_counts_by_status(spark, sf_dir):
    return metrics.counts_by_status(_jobs(spark, sf_dir))


_TARGET = f"WITH j AS (SELECT o_orderkey AS job_id, {_STATUS} AS s, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 10 ELSE (o_custkey + 1) % 10 END AS t FROM orders), k AS (SELECT j.*, n_name AS target_type FROM j LEFT JOIN nation ON n_nationkey = t)"


def _typed(spark, sf_dir):
    groups = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("group_id"), ((F.col("c_custkey") + 1) % 10).alias("target_id"))
    sources = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("data_source_id"), F.col("n_name").alias("target_type"))
    return reports.with_target_type(_jobs(spark, sf_dir), groups, sources)


@query(_TARGET.replace("(o_custkey + 1) % 10", "(SELECT (c_custkey + 1) % 10 FROM customer WHERE c_custkey = o_custkey)") + "SELECT target_type, count(*) AS jobs, count(*) FILTER (s = 'RUNNING') AS running FROM k WHERE target_type IS NOT NULL GROUP BY 1")
def q_counts_by_target(spark, sf_dir):
    return metrics.counts_by_target(_typed(spark, sf_dir))


@query(
    f"""WITH i AS (SELECT o_custkey AS g, {_STATUS} AS s FROM orders), a AS (SELECT g, bool_or(s IN ('FAILED', 'REINITIALIZE_REQUIRED', 'DDL_BLOCKED')) AS bad, bool_or(s = 'RUNNING') AS run, bool_or(s = 'PAUSING') AS pausing, bool_and(s = 'PAUSED') AS paused, bool_and(s IN ('STOPPED', 'FINISHED')) AS stopped FROM i GROUP BY g)
SELECT c_custkey AS group_id, CASE WHEN bad AND run THEN 'DEGRADED' WHEN bad THEN 'FAILED' WHEN run THEN 'RUNNING' WHEN pausing THEN 'PAUSING' WHEN paused THEN 'PAUSED' WHEN stopped THEN 'STOPPED' ELSE 'DRAFT' END AS status FROM customer LEFT JOIN a ON g = c_custkey"""
)
def q_group_status(spark, sf_dir):
    return metrics.group_status(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("group_id")), _jobs(spark, sf_dir).select("group_id", "status"))


@query("SELECT 'log-' || o_orderkey AS topic_name, CASE WHEN c_custkey IS NULL THEN 'OWNER_GONE' WHEN o_orderkey % 3 <> c_custkey % 3 THEN 'OTHER_TARGET' ELSE 'OTHER_VERSION' END AS reason, o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 24 HOUR AS due FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) ON c_custkey = o_custkey WHERE c_custkey IS NULL OR o_orderkey % 3 <> c_custkey % 3 OR o_orderkey % 2 <> c_custkey % 2")
def q_retention_audit(spark, sf_dir):
    o, c = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer")
    registry = o.select(F.concat(F.lit("log-"), "o_orderkey").alias("topic_name"), F.col("o_custkey").alias("owner_id"), (F.col("o_orderkey") % 3).alias("data_source_id"), (F.col("o_orderkey") % 2).alias("config_version"), F.col("o_orderdate").cast("timestamp").alias("retired_time"))
    owners = c.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("owner_id"), (F.col("c_custkey") % 3).alias("data_source_id"), (F.col("c_custkey") % 2).alias("config_version"))
    return reports.retention_audit(registry, owners, F.lit("1998-01-01").cast("timestamp"), 24)


@query("SELECT o_orderkey AS checkpoint_id FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 1 HOUR AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25) AND o_orderkey NOT IN (SELECT c_custkey FROM customer)")
def q_orphans(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("checkpoint_id"), F.col("o_orderdate").cast("timestamp").alias("modified_at"))
    tasks = _t(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("checkpoint_id"))
    return reports.unreferenced(o, tasks, _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("checkpoint_id")), F.lit("1998-01-01").cast("timestamp"), 1)


# --- protection, scope and labels


@query("SELECT c_custkey, left(c_name, 1) || repeat('*', length(c_name) - 1) AS name, CASE WHEN length(c_name) <= 7 THEN repeat('*', length(c_name)) ELSE left(c_name, 3) || repeat('*', length(c_name) - 7) || right(c_name, 4) END AS phone, CASE WHEN length(c_mktsegment) <= 4 THEN repeat('*', length(c_mktsegment)) WHEN length(c_mktsegment) <= 8 THEN left(c_mktsegment, 4) || repeat('*', length(c_mktsegment) - 4) ELSE left(c_mktsegment, 4) || '****' || right(c_mktsegment, 4) END AS segment, CASE WHEN length(c_mktsegment) <= 4 THEN repeat('*', length(c_mktsegment)) WHEN length(c_mktsegment) <= 8 THEN left(c_mktsegment, length(c_mktsegment) - 4) || '****' ELSE left(c_mktsegment, 4) || repeat('*', length(c_mktsegment) - 8) || right(c_mktsegment, 4) END AS secret FROM customer")
def q_masking(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    m = lambda col, s, n: masking.masked(F.col(col), s).alias(n)
    return c.select("c_custkey", m("c_name", "NAME", "name"), m("c_name", "PHONE", "phone"), m("c_mktsegment", "STRING", "segment"), m("c_mktsegment", "HIGH_SECURITY", "secret"))


def _depts(spark, sf_dir):
    c = F.col("c_custkey")
    return _t(spark, sf_dir, "customer").select(c.alias("dept_id"), F.concat_ws(",", F.lit("0"), F.when(c > 10, (c % 10 + 1).cast("string")), F.when(c > 100, (c % 90 + 11).cast("string"))).alias("ancestors"))


_DEPTS = "WITH d AS (SELECT c_custkey AS dept_id, string_split(concat_ws(',', '0', CASE WHEN c_custkey > 10 THEN CAST(c_custkey % 10 + 1 AS VARCHAR) END, CASE WHEN c_custkey > 100 THEN CAST(c_custkey % 90 + 11 AS VARCHAR) END), ',') AS a FROM customer)"


@query(_DEPTS + "SELECT r.dept_id AS root_id, d.dept_id FROM d r JOIN d ON d.dept_id = r.dept_id OR list_contains(d.a, CAST(r.dept_id AS VARCHAR))")
def q_descendants(spark, sf_dir):
    d = _depts(spark, sf_dir)
    return scope.descendants(d, d.select(F.col("dept_id").alias("root_id")))


@query(
    """WITH RECURSIVE d AS (SELECT c_custkey AS dept_id, CASE WHEN c_custkey >= 4 THEN c_custkey // 4 END AS parent_id FROM customer), r AS (SELECT dept_id AS root_id, dept_id FROM d UNION ALL SELECT r.root_id, d.dept_id FROM r JOIN d ON d.parent_id = r.dept_id)
SELECT root_id, dept_id FROM r"""
)
def q_descendants_by_parent(spark, sf_dir):
    """Departments below each department, from their parents alone."""
    c = F.col("c_custkey")
    d = _t(spark, sf_dir, "customer").select(c.alias("dept_id"), F.when(c >= 4, F.floor(c / 4)).alias("parent_id"))
    return scope.descendants_by_parent(d, d.select(F.col("dept_id").alias("root_id")))


@query(_DEPTS + "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT dept_id FROM d WHERE dept_id = 3 OR list_contains(a, '3')) OR o_custkey IN (5, 6) OR o_orderkey = 77")
def q_row_scope(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("dept_id"), F.col("o_orderkey").alias("owner_id"))
    scopes = [{"kind": "DEPT_AND_CHILDREN_OR_SELF", "depts": [3]}, {"kind": "CUSTOM", "depts": [5, 6]}]
    return scope.visible_rows(rows, scopes, _depts(spark, sf_dir), 77).select("o_orderkey")


@query("SELECT o_orderkey, concat_ws(',', (SELECT n_name FROM nation WHERE n_nationkey = o_orderkey % 30), (SELECT n_name FROM nation WHERE n_nationkey = o_custkey % 30)) AS labels FROM orders WHERE o_orderkey % 30 < 25 OR o_custkey % 30 < 25 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 30 >= 25 AND o_custkey % 30 >= 25")
def q_dict_labels(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    d = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("label"))
    codes = F.concat_ws(",", (F.col("o_orderkey") % 30).cast("string"), (F.col("o_custkey") % 30).cast("string"))
    return scope.with_labels(o, ["o_orderkey"], codes, d, "labels").select("o_orderkey", "labels")


# --- relational verbs


def _sql(name: str, spark_sql: str, duck: str | None = None):
    """A plain query that both engines run; the tables are those of sf_dir."""

    def run(spark, sf_dir):
        q = spark_sql
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
            q = q.replace("{" + t + "}", f"parquet.`{sf_dir}/{t}.parquet`")
        return spark.sql(q)

    run.__name__ = name
    plain = duck or spark_sql
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        plain = plain.replace("{" + t + "}", t)
    query(plain)(run)


_sql("q_left_join_chain", "SELECT o.o_orderkey, c.c_name, n.n_name, r.r_name FROM {orders} o LEFT JOIN {customer} c ON c.c_custkey = o.o_custkey LEFT JOIN {nation} n ON n.n_nationkey = c.c_nationkey LEFT JOIN {region} r ON r.r_regionkey = n.n_regionkey AND r.r_regionkey < 3")
_sql("q_self_join", "SELECT a.o_orderkey, min(b.o_orderkey) AS next_order, count(b.o_orderkey) AS later_orders FROM {orders} a LEFT JOIN {orders} b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey GROUP BY a.o_orderkey")
_sql("q_exists", "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
_sql("q_in_subquery", "SELECT o_orderkey FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_acctbal > 5000)")
_sql("q_not_in", "SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_custkey IS NOT NULL)")
_sql("q_scalar_sub", "SELECT c.c_custkey, (SELECT count(*) FROM {orders} o WHERE o.o_custkey = c.c_custkey) AS n_orders FROM {customer} c WHERE c.c_acctbal = (SELECT max(c_acctbal) FROM {customer}) OR c.c_custkey % 10 = 0")
_sql("q_having", "SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first_order, max(o_orderkey) AS last_order, round(avg(o_orderkey), 3) AS mean_key, sum(o_orderkey) AS sum_key FROM {orders} GROUP BY o_custkey HAVING count(*) > 8", "SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first_order, max(o_orderkey) AS last_order, round(avg(o_orderkey), 3) AS mean_key, CAST(sum(o_orderkey) AS BIGINT) AS sum_key FROM {orders} GROUP BY o_custkey HAVING count(*) > 8")
_sql("q_count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(*) AS orders FROM {orders} GROUP BY o_orderstatus")
_sql("q_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM {lineitem}")
_sql("q_find_in_set", "SELECT c_custkey, find_in_set(cast(c_nationkey AS string), '1,5,9,13') AS place FROM {customer} WHERE find_in_set(cast(c_nationkey AS string), '1,5,9,13') > 0", "SELECT c_custkey, CAST(list_position(['1', '5', '9', '13'], CAST(c_nationkey AS VARCHAR)) AS INTEGER) AS place FROM {customer} WHERE c_nationkey IN (1, 5, 9, 13)")
_sql("q_page", "SELECT o_orderkey, o_custkey FROM {orders} ORDER BY o_custkey DESC, o_orderkey ASC LIMIT 20 OFFSET 40")
_sql("q_list_filter", "SELECT c_custkey, c_name FROM {customer} WHERE c_name LIKE '%1%' AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal BETWEEN 0 AND 8000 AND NOT c_name LIKE '%9'")
_sql("q_union_bag", "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}")
_sql("q_union_set", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
_sql("q_except", "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT s_nationkey FROM {supplier} WHERE s_suppkey % 3 = 0")


@query("SELECT l_orderkey % 50 AS shard, CAST(sum(l_linenumber) AS BIGINT) AS part FROM lineitem GROUP BY 1 UNION ALL SELECT NULL, CAST(sum(l_linenumber) AS BIGINT) FROM lineitem")
def q_split_and_sum(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem")
    shards = l.groupBy((F.col("l_orderkey") % 50).alias("shard")).agg(F.sum("l_linenumber").alias("part"))
    return shards.unionByName(l.agg(F.lit(None).cast("long").alias("shard"), F.sum("l_linenumber").alias("part")))


# --- decoding and functions


def _envelopes(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    i = F.col("event_id")
    row = lambda up: F.struct(i.alias("id"), (i % 2).cast("int").alias("flag"), (F.floor(F.col("value") * 100).cast("long") * 250_000 + up * 1_500_000).alias("at"), ((i * 7919) % 200_000_000 - 80_000_000).alias("t"), (i % 20000).cast("int").alias("day"))
    op = F.element_at(F.array(*[F.lit(x) for x in "rcud"]), (i % 4 + 1).cast("int"))
    payload = F.struct(
        F.when(op.isin("u", "d"), row(0)).alias("before"), F.when(op != "d", row(1)).alias("after"), op.alias("op"), F.struct(F.lit("app").alias("db"), F.lit("t").alias("table"), (i % 3).alias("ts_ms")).alias("source"), (i + 5).alias("ts_ms")
    )
    body = F.to_json(payload, {"ignoreNullFields": "false"})
    value = F.when(i % 5 == 0, F.to_json(row(1))).when(i % 5 == 1, body).otherwise(F.concat(F.lit('{"schema":{"type":"struct"},"payload":'), body, F.lit("}")))
    return e.select(F.lit("raw").alias("raw_topic"), i.alias("offset"), F.when(i % 11 != 0, value).alias("value"))


FIELDS = [decode.Field("id", "int"), decode.Field("flag", "bool"), decode.Field("at", "micros"), decode.Field("t", "time_ms"), decode.Field("day", "date")]


@query(
    """WITH e AS (SELECT event_id AS i, ['r', 'c', 'u', 'd'][event_id % 4 + 1] AS o, event_id % 5 = 0 AS plain, (event_id * 7919) % 200000000 - 80000000 AS t, CAST(floor(value * 100) AS BIGINT) * 250000 + 1500000 AS us FROM events WHERE event_id % 11 <> 0)
SELECT i AS "offset", CASE WHEN plain THEN 'r' ELSE o END AS op, plain, CASE WHEN plain THEN NULL WHEN i % 3 > 0 THEN i % 3 ELSE i + 5 END AS ts_ms, CASE WHEN plain OR o <> 'd' THEN CAST(i % 2 = 1 AS VARCHAR) END AS flag, CASE WHEN plain OR o <> 'd' THEN CAST(DATE '1970-01-01' + CAST(i % 20000 AS INTEGER) AS VARCHAR) END AS day,
CASE WHEN plain OR o <> 'd' THEN CASE WHEN t < 0 THEN '-' ELSE '' END || lpad(CAST(abs(t) // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(abs(t) // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(abs(t) // 1000 % 60 AS VARCHAR), 2, '0') || CASE WHEN abs(t) % 1000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(abs(t) % 1000 AS VARCHAR), 3, '0'), '0') END END AS t,
CASE WHEN NOT plain AND o IN ('u', 'd') THEN i END AS before_id,
CASE WHEN plain OR o <> 'd' THEN strftime(make_timestamp(us - us % 1000000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN us % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(us % 1000000 AS VARCHAR), 6, '0'), '0') END END AS at FROM e"""
)
def q_decode_types(spark, sf_dir):
    d = decode.decode_log(_envelopes(spark, sf_dir), FIELDS)
    return d.select("offset", "op", "plain", "ts_ms", F.col("after.flag").cast("string").alias("flag"), F.col("after.day").cast("string").alias("day"), "after.t", F.col("before.id").alias("before_id"), "after.at")


#: Columns of three versions of one table: name, connect type, logical type, parameters. Every type of a source is among them.
_VERSIONS = (
    (("id", "int64", None, {}), ("flag", "int16", None, {"type": "TINYINT", "length": "1"}), ("amount", "bytes", "org.apache.kafka.connect.data.Decimal", {"scale": "2"}), ("name", "string", None, {"type": "VARCHAR"})),
    (("id", "int64", None, {}), ("flag", "boolean", None, {"type": "BIT"}), ("amount", "bytes", "org.apache.kafka.connect.data.Decimal", {"scale": "4"}), ("at6", "int64", "io.debezium.time.MicroTimestamp", {}), ("at3", "int64", "io.debezium.time.Timestamp", {}), ("day", "int32", "io.debezium.time.Date", {})),
    (
        ("id", "int64", None, {}), ("at9", "int64", "io.debezium.time.NanoTimestamp", {}), ("z", "string", "io.debezium.time.ZonedTimestamp", {}), ("t3", "int32", "io.debezium.time.Time", {}), ("t6", "int64", "io.debezium.time.MicroTime", {}),
        ("t9", "int64", "io.debezium.time.NanoTime", {}), ("f", "float", None, {"type": "FLOAT UNSIGNED"}), ("d", "double", None, {"type": "DOUBLE"}), ("small", "int16", None, {"type": "TINYINT", "length": "4"}), ("b", "bytes", None, {"type": "BLOB"}),
        ("g", "struct", None, {}), ("none", "string", None, {}),
    ),
)


def _versions_log(spark, sf_dir):
    """Envelopes of three versions of a table, as text; those of events divisible by 50 tell of no row, as the schema of their row is missing."""
    import json

    def schema_of(columns) -> str:
        def column(name, kind, logical, told):
            more = {"parameters": {(k if k == "scale" else f"__debezium.source.column.{k}"): v for k, v in told.items()}} if told else {}
            return {"type": kind, "field": name, **({"name": logical} if logical else {}), **more, **({"fields": [{"type": "bytes", "field": "wkb"}, {"type": "int32", "field": "srid"}]} if kind == "struct" else {})}

        row = [column(*c) for c in columns]
        return json.dumps({"type": "struct", "fields": [{"type": "struct", "field": "before", "fields": row}, {"type": "struct", "field": "after", "fields": row}]}, separators=(",", ":"))

    i = F.col("event_id").cast("long")
    text_ = lambda c: c.cast("string")
    t = (i * 7919) % 200_000_000 - 80_000_000
    values = {
        "id": text_(i), "name": F.concat(F.lit('"n'), text_(i % 7), F.lit("\\u00e9\\n\"")), "at6": text_(i * 7_919_000_500 - 40_000_000_000_000), "at3": text_(i * 86_413_500 - 400_000_000_000), "day": text_(i % 20_000 - 5000),
        "at9": text_(i * 123_456_789_010 - 5_000_000_000_000), "z": F.format_string('"2020-01-01T10:%02d:00%sZ"', i % 60, F.when(i % 2 == 0, ".5").otherwise("")), "t3": text_(t), "t6": text_(t * 1000 + i % 7), "t9": text_((t * 1000 + i % 7) * 1000 + 1),
        "f": F.concat(text_(i % 1000), F.lit(".1")), "d": F.concat(text_(i % 1000), F.lit(".25")), "small": text_(i % 128), "b": F.lit('"AAE="'), "g": F.lit('{"wkb":"AQ==","srid":null}'), "none": F.lit("null"),
    }
    amounts = [F.format_string("%d.%02d", F.floor(i / 100), i % 100), F.when(i % 2 == 0, F.lit("12345678901234567890.0000")).otherwise(F.format_string("-0.%04d", i % 1000 + 1000)), F.lit("")]
    flags = [text_(i % 3), F.when(i % 4 < 2, F.lit("true")).otherwise(F.lit("false")), F.lit("")]
    op = F.get(F.array(*[F.lit(x) for x in "rcud"]), (F.floor(i / 3) % 4).cast("int"))
    value = None
    for v, columns in enumerate(_VERSIONS):
        known = values | {"amount": amounts[v], "flag": flags[v]}
        row = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{c[0]}":'), known[c[0]]) for c in columns]), F.lit("}"))
        before, after = F.when(op.isin("u", "d"), row).otherwise("null"), F.when(op != "d", row).otherwise("null")
        schema_text = F.when(i % 50 == 0, F.lit('{"type":"struct","fields":[]}')).otherwise(F.lit(schema_of(columns)))
        one = F.concat(F.lit('{"schema":'), schema_text, F.lit(',"payload":{"before":'), before, F.lit(',"after":'), after, F.lit(',"op":"'), op, F.lit('","source":{"db":"app","table":"t","ts_ms":'), text_(i % 3), F.lit('},"ts_ms":'), text_(i + 5), F.lit("}}"))
        value = F.when(i % 3 == v, one).otherwise(value)
    return _t(spark, sf_dir, "events").select(F.lit("raw").alias("raw_topic"), i.alias("offset"), value.alias("value"))


def _local_sql(n: str, per_second: int, digits: int) -> str:
    part = f"(({n}) % {per_second} + {per_second}) % {per_second}"
    return f"""strftime(make_timestamp((({n}) - {part}) // {per_second} * 1000000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN {part} = 0 THEN '' ELSE '.' || rtrim(lpad(CAST({part} AS VARCHAR), {digits}, '0'), '0') END"""


def _time_sql(us: str) -> str:
    n = f"abs({us})"
    whole = " || ':' || ".join(f"lpad(CAST({x} AS VARCHAR), 2, '0')" for x in (f"{n} // 3600000000", f"{n} // 60000000 % 60", f"{n} // 1000000 % 60"))
    return f"CASE WHEN {us} < 0 THEN '-' ELSE '' END || {whole} || CASE WHEN {n} % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST({n} % 1000000 AS VARCHAR), 6, '0'), '0') END"


@query(
    f"""WITH e AS (SELECT event_id AS i, ['r', 'c', 'u', 'd'][event_id // 3 % 4 + 1] AS op, (event_id * 7919) % 200000000 - 80000000 AS t FROM events),
v AS (SELECT *, CASE i % 3
WHEN 0 THEN '{{"id":' || i || ',"flag":' || CASE WHEN i % 3 = 0 THEN 'false' ELSE 'true' END || ',"amount":' || CAST(i // 100 AS VARCHAR) || CASE WHEN i % 100 = 0 THEN '' ELSE rtrim('.' || lpad(CAST(i % 100 AS VARCHAR), 2, '0'), '0') END || ',"name":"n' || i % 7 || 'é\\n"}}'
WHEN 1 THEN '{{"id":' || i || ',"flag":' || CASE WHEN i % 4 < 2 THEN 'true' ELSE 'false' END || ',"amount":' || CASE WHEN i % 2 = 0 THEN '12345678901234567890' ELSE rtrim('-0.' || CAST(i % 1000 + 1000 AS VARCHAR), '0') END
  || ',"at6":"' || {_local_sql('i * 7919000500 - 40000000000000', 1000000, 6)} || '","at3":"' || {_local_sql('i * 86413500 - 400000000000', 1000, 3)} || '","day":"' || CAST(DATE '1970-01-01' + CAST(i % 20000 - 5000 AS INTEGER) AS VARCHAR) || '"}}'
ELSE '{{"id":' || i || ',"at9":"' || {_local_sql('i * 123456789010 - 5000000000000', 1000000000, 9)} || '","z":"2020-01-01T18:' || lpad(CAST(i % 60 AS VARCHAR), 2, '0') || ':00' || CASE WHEN i % 2 = 0 THEN '.5' ELSE '' END || '","t3":"' || {_time_sql('(t * 1000)')}
  || '","t6":"' || {_time_sql('(t * 1000 + i % 7)')} || '","t9":"' || {_time_sql('(t * 1000 + i % 7)')} || '","f":' || i % 1000 || '.1,"d":' || i % 1000 || '.25,"small":' || i % 128 || ',"b":"AAE=","g":"AQ==","none":null}}' END AS row FROM e)
SELECT i AS "offset", op, CASE WHEN i % 3 > 0 THEN i % 3 ELSE i + 5 END AS ts_ms, CASE WHEN op IN ('u', 'd') AND i % 50 <> 0 THEN row END AS before, CASE WHEN op <> 'd' AND i % 50 <> 0 THEN row END AS after, CASE WHEN i % 50 = 0 THEN 'no row in the schema' END AS decode_error FROM v"""
)
def q_decode_by_schema(spark, sf_dir):
    """One log with three versions of a table, each record decoded by the schema that it brings."""
    return decode.decode_by_schema(_versions_log(spark, sf_dir)).select("offset", "op", "ts_ms", "before", "after", "decode_error")


@query("SELECT event_id, CAST(epoch_us(ts) // 1000 + 8 * 3600000 AS BIGINT) AS shanghai_ms, CAST(8 AS DOUBLE) AS shift FROM events")
def q_zone_shift(spark, sf_dir):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    e = _t(spark, sf_dir, "events")
    return e.select("event_id", F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(ms), "Asia/Shanghai")).alias("shanghai_ms"), text.zone_shift_hours(ms, "Asia/Shanghai").alias("shift"))


@query("SELECT p_partkey, left(regexp_replace('db ' || p_brand || '_' || p_name, '[^A-Za-z0-9._-]', '_', 'g'), 249) AS topic, sha256(p_name) AS hash, CAST(ceil(p_size / 3.0) * 4 AS BIGINT) AS base64_bytes FROM part")
def q_names_and_hashes(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return p.select("p_partkey", text.default_target_name(F.concat(F.lit("db "), "p_brand"), F.col("p_name")).alias("topic"), F.sha2("p_name", 256).alias("hash"), text.base64_length(F.col("p_size")).cast("long").alias("base64_bytes"))


# --- streams, run over the given data

STATE_PARTITIONS = 8


def _stream(spark, frame: DataFrame, name: str, out, rest=None):
    """frame, written to the shared folder, read as a stream through out; the result is read when all is processed.

    rest(spark, checkpoint): rows that the state still holds then, which are added.
    """
    from .sources.shared import materialised, shared_path

    source = materialised(frame, name)
    path = "/".join(source.inputFiles()[0].split("/")[:-1])
    target, checkpoint = shared_path(spark, name), shared_path(spark, name)
    stream = out(spark.readStream.schema(frame.schema).parquet(path))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(int(before), STATE_PARTITIONS)))  # a stream keeps the number that it starts with
    try:
        q = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(once=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    result = spark.read.schema(stream.schema).parquet(target)
    return result.unionByName(rest(spark, checkpoint)) if rest else result


@query(LOG + "SELECT seq, op, k, event_ms FROM ev")
def stream_split_update_merge(spark, sf_dir):
    """The events of the whole log by the stream: what its state still holds when the input has ended is added."""
    log = events.dense_order(_log(spark, sf_dir)).withColumn("offset", F.col("seq")).drop("seq")
    records = jobs.keyed_records(jobs.moved_apart(log, testlog.KEYS), testlog.KEYS)
    out = _stream(spark, records, "merge", jobs.merge_stream, jobs.held_deletes)
    return out.select(F.col("offset").alias("seq"), "op", F.get_json_object("key", "$.user_id").cast("long").alias("k"), "event_ms")


@query(
    LOG
    + """, bad AS (SELECT seq AS s, "offset" AS o FROM raw WHERE event_type = 'view' AND "offset" >= (SELECT max("offset") // 2 FROM raw) ORDER BY seq LIMIT 1)
SELECT raw."offset" AS seq, ev.sub, ev.op, ev.k FROM ev JOIN raw ON raw.seq = ev.seq WHERE ev.seq < (SELECT s FROM bad) UNION ALL SELECT o, NULL, 'missing source', NULL FROM bad"""
)
def stream_ordered_publish(spark, sf_dir):
    """The log of q_publish_stops_at_unreliable in four batches: what goes out, and where and why its owner stands then."""
    from .sources.shared import shared_path

    log = _broken_log(spark, sf_dir)
    low, high = log.agg(F.min("offset"), F.max("offset")).first()
    path, step = shared_path(spark, "raw"), (high - low) // 4 + 1
    for i in range(4):  # files in the order that a log has
        log.where(F.col("offset").between(low + i * step, low + (i + 1) * step - 1)).coalesce(2).write.mode("append").parquet(f"{path}/part={i}")
    publisher = LogPublisher(spark, shared_path(spark, "published"), log.schema, testlog.KEYS)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/part=*")
    publisher.start(stream, shared_path(spark, "checkpoint")).awaitTermination()
    publisher.flush()
    why = publisher.stopped().select("seq", F.lit(None).cast("int").alias("sub"), F.col("reason").alias("op"), F.lit(None).cast("long").alias("k"))
    return _flat(publisher.published()).select("seq", "sub", "op", "k").unionByName(why)


@query(ORACLES["q_alert_transitions"])
def stream_alert_transitions(spark, sf_dir):
    s = _samples(spark, sf_dir).select("sample_id", "owner_id", "status", "sampled_at")
    out = _stream(spark, s.repartitionByRange(4, "sampled_at"), "alerts", lambda df: jobs.alert_stream(df, ["error", "purchase"]))
    return out.select("sample_id", "owner_id", "status")


# --- more of the inventory, over the given tables


_PAIRS = [("json", 1, 9), ("text", 12, 9), ("varchar", 12, 9), ("tinyint", -6, 4), ("tinyint", -6, 1), ("bit", -7, 1), ("bit", -7, 8), ("int", 4, 10), ("bool", 16, 1), ("jsonb", 1111, 9), ("boolean", -7, 1), ("datetime", 93, 0), ("uuid", 1111, 16), ("blob", -4, 9), ("point", 1111, 9), ("geometry", 1111, 9)]
_PAIRS_SQL = "[" + ", ".join(f"{{n: '{n}', j: {j}, z: {z}}}" for n, j, z in _PAIRS) + "]"


def _family_sql(x: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({x}.n, '{pattern}') THEN '{name}'" for name, pattern in schema.FAMILIES)
    return f"CASE {cases} ELSE CAST({x}.j AS VARCHAR) END"


@query(
    f"""WITH p AS (SELECT p_partkey, {_PAIRS_SQL}[p_partkey % 16 + 1] AS a, {_PAIRS_SQL}[p_partkey // 16 % 16 + 1] AS b, p_partkey // 256 % 2 = 0 AS pg FROM part),
f AS (SELECT *, {_family_sql('a')} AS fa, {_family_sql('b')} AS fb, (a.j = -7 AND a.z = 1) OR (a.n LIKE '%tinyint%' AND a.z <= 1) AS truth, b.j = 16 OR b.n IN ('bool', 'boolean') AS bool FROM p)
SELECT p_partkey, fa AS source_family, fb AS target_family, CASE WHEN pg AND a.n = 'json' AND b.n IN ('json', 'jsonb') THEN FALSE ELSE (truth AND bool) OR fa = fb OR (fa = 'numeric' AND fb = 'boolean' AND a.n LIKE '%tinyint%') END AS fits FROM f"""
)
def q_type_pairs(spark, sf_dir):
    """Whether a target type takes a source type, for every pair of some types, with and without PostgreSQL as the target."""
    kinds = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(j).alias("jdbc"), F.lit(z).alias("size")) for n, j, z in _PAIRS])
    k = F.col("p_partkey")
    p = _t(spark, sf_dir, "part").select(k, F.get(kinds, (k % 16).cast("int")).alias("a"), F.get(kinds, (F.floor(k / 16) % 16).cast("int")).alias("b"), (F.floor(k / 256) % 2 == 0).alias("pg"))
    a, b = ({c: F.col(f"{x}.{c}") for c in ("name", "jdbc", "size")} for x in "ab")
    fits = F.when(F.col("pg"), schema.types_compatible(a, b, True)).otherwise(schema.types_compatible(a, b, False))
    return p.select("p_partkey", schema.type_family(a["name"], a["jdbc"]).alias("source_family"), schema.type_family(b["name"], b["jdbc"]).alias("target_family"), fits.alias("fits"))


@query(
    """WITH c AS (SELECT c_custkey AS k, c_custkey % 4 = 0 AS same, c_custkey % 11 = 0 AS gone, c_custkey % 3 = 0 AS fits, c_custkey % 5 = 0 AS opened, c_custkey % 7 <> 0 AS known FROM customer)
SELECT 't' || k AS table_name, CASE WHEN gone THEN 'PENDING_FIX' WHEN NOT known AND fits THEN 'BASELINE_SET' WHEN known AND same AND opened THEN 'READY_TO_RESUME' WHEN known AND NOT same AND fits THEN 'READY_TO_RESUME' WHEN known AND NOT same THEN 'PENDING_FIX' END AS state FROM c"""
)
def q_drift_state(spark, sf_dir):
    k = F.col("c_custkey")
    c = _t(spark, sf_dir, "customer").select(k, F.concat(F.lit("t"), k).alias("table_name"))
    drifted = c.select("table_name", F.when(k % 11 == 0, "TABLE_UNAVAILABLE").when(k % 4 != 0, "ADD_COLUMN").alias("change_type"))
    fits = c.select("table_name", (k % 3 == 0).alias("compatible"))
    return schema.drift_state(drifted, fits, c.where(k % 5 == 0).select("table_name"), c.where(k % 7 != 0).select("table_name"))


@query("SELECT 't' || p_partkey % 40 AS table_name, 'c' || p_partkey AS column_name FROM part WHERE p_partkey % 3 = 0 AND p_size > 8")
def q_time_precision(spark, sf_dir):
    k = F.col("p_partkey")
    return schema.time_precision_risks(_t(spark, sf_dir, "part").select(F.concat(F.lit("t"), k % 40).alias("table_name"), F.concat(F.lit("c"), k).alias("column_name"), F.when(k % 3 == 0, "TIME").otherwise("DATETIME").alias("type_name"), F.col("p_size").alias("size")))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN event_id % 50 END WHEN event_id % 2 = 0 THEN greatest(event_id % 50, (event_id % 90000) // 1000) WHEN event_id % 3 = 1 THEN (event_id % 90000) // 1000 ELSE 0 END AS lag FROM events")
def q_effective_lag(spark, sf_dir):
    """Lags of owners that publish, that stopped, and whose stop is told to be in the future; odd ones have no stored lag."""
    i = F.col("event_id").cast("long")
    stopped = F.when(i % 3 == 0, F.lit(None)).when((i % 3 == 2) & (i % 2 == 1), i + 5000).otherwise(F.lit(0)).cast("long")
    return _t(spark, sf_dir, "events").select("event_id", guards.effective_lag(F.when(i % 2 == 0, i % 50), stopped, i % 90_000).alias("lag"))


@query(
    """WITH g AS (SELECT c_custkey, ['RUNNING', 'DEGRADED', 'PAUSED', 'FAILED'][c_custkey % 4 + 1] AS s FROM customer WHERE c_custkey % 5 <> 0), i AS (SELECT o_orderkey, o_custkey, ['RUNNING', 'FAILED', 'DDL_BLOCKED', 'PAUSED', 'REINITIALIZE_REQUIRED'][o_orderkey % 5 + 1] AS s FROM orders)
SELECT o_orderkey AS item_id, o_custkey AS group_id, CASE WHEN g.s = 'RUNNING' OR g.s = 'DEGRADED' THEN CASE WHEN i.s = 'FAILED' OR i.s = 'DDL_BLOCKED' THEN i.s WHEN i.s = 'RUNNING' AND o_orderkey % 3 = 0 THEN 'KAFKA_BRIDGE_STOPPED' END END AS due FROM i LEFT JOIN g ON c_custkey = o_custkey"""
)
def q_alert_gate(spark, sf_dir):
    pick = lambda n, *names: F.get(F.array(*[F.lit(x) for x in names]), (n % len(names)).cast("int"))
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    status = pick(o, "RUNNING", "FAILED", "DDL_BLOCKED", "PAUSED", "REINITIALIZE_REQUIRED")
    items = _t(spark, sf_dir, "orders").select(o.alias("item_id"), F.col("o_custkey").alias("group_id"), status.alias("status"), (o % 3 == 0).alias("stopped"))
    groups = _t(spark, sf_dir, "customer").where(k % 5 != 0).select(k.alias("group_id"), pick(k, "RUNNING", "DEGRADED", "PAUSED", "FAILED").alias("status"))
    return reports.gated_items(items, groups).select("item_id", "group_id", "due")


@query("SELECT item_id, event_id, status FROM (SELECT user_id AS item_id, event_id, event_type AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS p FROM events WHERE event_id % 4 <> 0) WHERE p = 1")
def q_latest_open_event(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp")
    opened = e.select(F.col("user_id").alias("item_id"), "event_id", F.col("event_type").alias("status"), at.alias("detected_at"), F.when(F.col("event_id") % 4 == 0, at).alias("resolved_at"))
    return metrics.latest_open_event(opened).select("item_id", "event_id", "status")


_ENGINE = {"RUNNING": "RUNNING", "created": "RUNNING", "PENDING": "RUNNING", "DOING_SAVEPOINT": "PAUSING", "SAVEPOINT_DONE": "PAUSED", "CANCELING": "STOPPED", "CANCELED": "STOPPED", "FINISHED": "FINISHED", "FAILING": "FAILED", "what": "FAILED"}


@query(f"SELECT status, count(*) AS jobs FROM (SELECT [{', '.join(repr(v) for v in _ENGINE.values())}][o_orderkey % {len(_ENGINE)} + 1] AS status FROM orders) GROUP BY 1")
def q_platform_status(spark, sf_dir):
    told = F.get(F.array(*[F.lit(k) for k in _ENGINE]), (F.col("o_orderkey") % len(_ENGINE)).cast("int"))
    return _t(spark, sf_dir, "orders").groupBy(metrics.platform_status(told).alias("status")).agg(F.count("*").alias("jobs"))


@query("SELECT event_id, event_id % 4 IN (0, 2) AS lost FROM events")
def q_recovery_errors(spark, sf_dir):
    texts = F.array(*[F.lit(x) for x in ("Checkpoint 7 expired", "connection refused", "binlog position is gone", " ")])
    return _t(spark, sf_dir, "events").select("event_id", metrics.needs_reinitialising(F.get(texts, (F.col("event_id") % 4).cast("int"))).alias("lost"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND contains(c_name, '1') AND c_acctbal <= 8000")
def q_filter_if_present(spark, sf_dir):
    """Only the conditions that have values count; the others are gone."""
    wanted = predicates.list_filter({"c_nationkey": None, "c_phone": " "}, {"c_name": "1"}, {"c_mktsegment": ["BUILDING", "MACHINERY"], "c_custkey": []}, {"c_acctbal": (None, 8000)})
    return _t(spark, sf_dir, "customer").where(wanted).select("c_custkey")


@query(
    """SELECT 'tbl_' || p_partkey % 40 AS table_name, CAST(least(2 * sum(b + 32) + 320 * count(*) + 512, 4294967296) AS BIGINT) AS raw_bytes, CAST(least(2 * sum(CASE WHEN p_partkey % 2 = 0 THEN b + 32 ELSE 0 END) + 512, 4294967296) AS BIGINT) AS event_bytes, coalesce(string_agg(p_partkey || '(' || CASE p_partkey % 8 WHEN 4 THEN 'mediumblob' ELSE 'json' END || ')', ',' ORDER BY p_partkey) FILTER (b > 1048576), '') AS large
FROM (SELECT p_partkey, CASE p_partkey % 8 WHEN 1 THEN 4 * p_size WHEN 2 THEN 40 WHEN 3 THEN CAST(ceil(p_size / 3.0) * 4 AS BIGINT) WHEN 4 THEN CASE WHEN p_partkey % 40 < 8 THEN 22369620 ELSE 340 END WHEN 5 THEN 65535 WHEN 6 THEN 12 WHEN 7 THEN CASE WHEN p_partkey % 40 = 7 THEN 4294967296 ELSE 255 END ELSE 40 END AS b FROM part) GROUP BY 1"""
)
def q_bytes_by_type(spark, sf_dir):
    k = F.col("p_partkey")
    few = k % 40
    kinds = F.array(F.lit("int"), F.lit("varchar(9)"), F.lit("datetime"), F.lit("varbinary"), F.when(few < 8, "mediumblob").otherwise("tinyblob"), F.lit("text"), F.lit("bit"), F.when(few == 7, "json").otherwise("TINYTEXT"))
    kind = F.get(kinds, (k % 8).cast("int"))
    columns = _t(spark, sf_dir, "part").select(k, k.cast("string").alias("column_name"), k.alias("position"), kind.alias("type_name"), F.concat(F.lit("tbl_"), few).alias("table_name"), guards.value_bytes(kind, F.col("p_size")).alias("value_bytes"))
    return guards.worst_case_sizes(columns, k % 2 == 0).select("table_name", "raw_bytes", "event_bytes", F.array_join("large_columns", ",").alias("large"))


@query(
    """SELECT p_partkey, '{password=******}, passwd=x, Pwd : ****** ' || p_partkey AS hidden, regexp_replace(p_name, '^.* ', '') AS last_word, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_brand || '.x' END AS qualified, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_brand END AS db, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'x' END AS tbl,
CASE WHEN p_size * 100 >= 1024 THEN printf('%.1f KB', p_size * 100 / 1024.0) ELSE CAST(p_size * 100 AS VARCHAR) || ' B' END AS size_text, left(p_name, 7) AS cut, [3 + p_partkey % 2, p_partkey // 10, -5, 20, NULL][p_partkey % 5 + 1] AS number, 3 + p_partkey % 2 AS n_items FROM part"""
)
def q_text_functions(spark, sf_dir):
    k, brand = F.col("p_partkey"), F.col("p_brand")
    qualified = F.when(k % 2 == 0, brand).otherwise(F.concat(brand, F.lit(".x")))
    return _t(spark, sf_dir, "part").select(
        "p_partkey", text.redacted(F.concat(F.lit("{password=p"), k, F.lit("}, passwd=x, Pwd : a "), k)).alias("hidden"), F.element_at(text.comma_list(F.regexp_replace("p_name", " ", " ,, ")), -1).alias("last_word"), qualified.alias("qualified"),
        text.database_of(qualified).alias("db"), text.table_of(qualified).alias("tbl"), text.byte_size_text(F.col("p_size") * 100).alias("size_text"), text.within_bytes(F.col("p_name"), 7).alias("cut"),
        text.number_from(F.get(F.array(F.concat((3 + k % 2).cast("string"), F.lit(".9")), F.concat((k * 1).cast("string"), F.lit("e-1")), F.lit(" -5.99 "), F.lit("2e1"), F.lit("n/a")), (k % 5).cast("int"))).alias("number"),
        F.size(text.comma_list(F.when(k % 2 == 0, "a, b,,a").otherwise("a,b,a, a ,"))).cast("long").alias("n_items"),
    )


@query("SELECT c_mktsegment AS segment, CASE WHEN c_nationkey % 3 = 0 THEN ['a', 'b', 'c', 'd'] WHEN c_nationkey % 3 = 1 THEN ['a', 'b'] ELSE ['b'] END AS columns, count(*) AS n FROM customer GROUP BY ALL")
def q_followed_selection(spark, sf_dir):
    """Selections that covered a baseline of two columns follow it to four; subsets stay."""
    k = F.col("c_nationkey") % 3
    names = lambda *n: F.array(*[F.lit(x) for x in n])
    chosen = F.when(k == 0, names("A", "B")).when(k == 1, names("a", "b")).otherwise(names("b"))
    baseline = F.when(k == 1, names("a", "b", "e")).otherwise(names("a", "b"))
    c = _t(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), schema.followed_selection(chosen, baseline, names("a", "b", "c", "d")).alias("columns"))
    return c.groupBy("segment", "columns").agg(F.count("*").alias("n"))


def _order_changes(o: DataFrame, third: int, seventh: int, eleventh: int) -> DataFrame:
    """A log that gives some orders another status, deletes some, and adds some under the negative key."""
    k, image = F.col("o_orderkey"), F.struct("o_orderkey", "o_orderstatus")
    changed = F.struct("o_orderkey", F.concat("o_orderstatus", F.lit("2")).alias("o_orderstatus"))
    added = F.struct((-k).alias("o_orderkey"), F.lit("new").alias("o_orderstatus"))
    record = lambda op, before, after: F.struct(F.lit(op).alias("op"), before.alias("before"), after.alias("after"))
    none = F.lit(None).cast("struct<o_orderkey:bigint,o_orderstatus:string>")
    records = F.array_compact(F.array(F.when(k % third == 0, record("u", image, changed)), F.when(k % seventh == 0, record("d", image, none)), F.when(k % eleventh == 0, record("c", none, added))))
    return o.select(k.alias("n"), F.posexplode(records).alias("i", "r")).select(F.lit("raw").alias("raw_topic"), (3 * F.col("n") + F.col("i")).alias("offset"), "r.*", F.lit("shop").alias("db"), F.lit("orders").alias("tbl"), F.lit(0).cast("long").alias("ts_ms"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus || '2' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT -o_orderkey, 'new' FROM orders WHERE o_orderkey % 11 = 0")
def q_versioned_table(spark, sf_dir):
    """orders written as a table's first version, changed by events into the second, and read back."""
    from .sources.shared import shared_path
    from .sources.sinks import VersionedTable

    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    t = VersionedTable(spark, shared_path(spark, "orders"))
    t.overwrite(o)
    t.apply(events.normalize(_order_changes(o, 3, 7, 11), ["o_orderkey"]), ["o_orderkey"])
    return t.read()


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 300 = 0 THEN o_orderstatus || '2' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 700 <> 0 UNION ALL SELECT -o_orderkey, 'new' FROM orders WHERE o_orderkey % 1100 = 0")
def q_merge_by_bucket(spark, sf_dir):
    """orders in buckets by key; changes of one order in some hundred rewrite the buckets that hold one, and the version is read from new and old files."""
    from .sources.shared import shared_path
    from .sources.sinks import BucketedTable

    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    t = BucketedTable(spark, shared_path(spark, "orders"), ["o_orderkey"], n_buckets=64)
    t.overwrite(o)
    t.apply(events.normalize(_order_changes(o, 300, 700, 1100), ["o_orderkey"]))
    return t.read()


_STATE = "arg_max({o: op, u: d_user, t: d_type, m: d_amount, n: d_note}, seq * 2 + sub) AS r"


@query(
    LOG
    + f""", h AS (SELECT max(seq) // 2 AS s FROM ev), a AS (SELECT k, r FROM (SELECT k, {_STATE} FROM ev, h WHERE seq <= s GROUP BY k) WHERE r.o <> 'DELETE'), b AS (SELECT k, r FROM (SELECT k, {_STATE} FROM ev GROUP BY k) WHERE r.o <> 'DELETE')
SELECT 'at its position' AS checked, count(*) AS source_rows, count(*) AS target_rows, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra, CAST(0 AS BIGINT) AS different, TRUE AS matched FROM a
UNION ALL SELECT 'against now', count(b.k), count(a.k), count(*) FILTER (a.k IS NULL), count(*) FILTER (b.k IS NULL), count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL AND [a.r.u, a.r.m] || [hash(a.r.t), hash(a.r.n)] <> [b.r.u, b.r.m] || [hash(b.r.t), hash(b.r.n)]),
  count(*) FILTER (a.k IS NULL OR b.k IS NULL OR [a.r.u, a.r.m] || [hash(a.r.t), hash(a.r.n)] <> [b.r.u, b.r.m] || [hash(b.r.t), hash(b.r.n)]) = 0 FROM a FULL JOIN b ON a.k = b.k"""
)
def q_check_at_position(spark, sf_dir):
    """A table that has the first half of the log, checked while the source is at its end: at the position that it stands for, and against what is there now."""
    from .sources.shared import shared_path
    from .sources.sinks import VersionedTable

    ev = _events(spark, sf_dir)
    half = ev.agg(F.floor(F.max("seq") / 2).alias("half"))
    none = spark.createDataFrame([], ev.schema["data"].dataType)
    t = VersionedTable(spark, shared_path(spark, "accounts"))
    t.overwrite(none)
    t.apply(ev.join(F.broadcast(half)).where("seq <= half").drop("half"), testlog.KEYS)  # half: one row
    now = reconcile.compare_rows(apply.applied(ev), t.read(), testlog.KEYS).withColumn("checked", F.lit("against now"))
    return reconcile.check_at_position(none, ev, t, testlog.KEYS).withColumn("checked", F.lit("at its position")).unionByName(now)


@query(LOG + """, s AS (SELECT ts_ms AS since FROM raw WHERE seq = (SELECT max(seq) * 3 // 4 FROM raw)) SELECT "offset", op, ts_ms FROM raw, s WHERE ts_ms >= since""")
def q_start_by_time(spark, sf_dir):
    """What an incremental run reads that starts three quarters through the log, by time: the log's files are indexed, and those before the start aren't opened."""
    from .sources.log_index import LogIndex
    from .sources.shared import shared_path

    log, path = events.dense_order(_log(spark, sf_dir)), shared_path(spark, "raw")
    log.repartitionByRange(16, "offset").write.parquet(path)
    index = LogIndex(spark, shared_path(spark, "index"), path, log.schema)
    index.refresh()
    last = spark.read.schema(log.schema).parquet(path).agg(F.floor(F.max("seq") * 3 / 4).alias("s")).first()["s"]
    at = spark.read.schema(log.schema).parquet(path).where(F.col("seq") == last).select(F.timestamp_millis("ts_ms").cast("string").alias("at")).first()["at"]
    return index.read_from("TIMESTAMP", wall_clock=at, zone="UTC").select("offset", "op", "ts_ms")


@query(
    """WITH p AS (SELECT p_partkey AS k, p_partkey % 40 AS t, p_partkey % 3 AS i, p_partkey % 3 = 2 AND p_partkey % 7 = 0 AS nullable FROM part), x AS (SELECT t, i, string_agg('C' || k, ',' ORDER BY k) AS columns, bool_or(nullable) AS open FROM p GROUP BY ALL)
SELECT 'tbl_' || t AS table_name, columns, CAST(row_number() OVER (PARTITION BY t ORDER BY i) AS INTEGER) AS rank FROM x WHERE i = 0 OR NOT open"""
)
def q_sync_keys(spark, sf_dir):
    """Keys to sync each table by: the primary key, then unique indexes without nullable columns."""
    k = F.col("p_partkey")
    p = _t(spark, sf_dir, "part")
    columns = p.select(F.concat(F.lit("tbl_"), k % 40).alias("table_name"), F.concat(F.lit("c"), k).alias("column_name"), ((k % 3 == 2) & (k % 7 == 0)).alias("nullable"))
    listed = p.select(F.concat(F.lit("tbl_"), k % 40).alias("table_name"), F.concat(F.lit("I"), k % 3).alias("index_name"), k.alias("key_seq"), F.concat(F.lit("C"), k).alias("column_name"), (k % 3 == 0).alias("is_primary"))
    return schema.key_candidates(columns, listed).select("table_name", F.array_join("key_columns", ",").alias("columns"), "rank")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def q_column_selection(spark, sf_dir):
    """orders as an engine returns it, in upper case, under its own names again, and the columns that a task asks for, by any case, once each and in its order."""
    o = _t(spark, sf_dir, "orders")
    folded = o.toDF(*[c.upper() for c in o.columns])
    named = readers.restored_names(folded, o.columns)
    return named.select(*spec.resolve_columns(named.columns, [" O_OrderKey", "o_totalprice", "O_TOTALPRICE", "", "o_orderstatus "], spec.resolve_key([["o_orderkey"]], ["O_ORDERKEY"])))


@query(ORACLES["q_fmt_envelope"])
def q_fmt_chosen(spark, sf_dir):
    """A task that names no format publishes envelopes."""
    return _envelope_fields(_format(" ")(spark, sf_dir))
