"""A change log with every kind of record, made from the events table, for queries and tests.

Key user_id; offset 2 * event_id (+ 1). signup: c; view: u; click: d and c of the same key right after it (a split update); error: u that moves user_id by 1000 (a
key change); purchase: d.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["user_id"]
COLUMNS = ["user_id", "event_type", "amount", "note"]
TOPIC, DATABASE, TABLE = "raw.events", "app", "accounts"


def change_log(events: DataFrame) -> DataFrame:
    amount = F.floor(F.col("value") * 100).cast("long")
    note = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("n"), (F.col("event_id") % 7).cast("string")))

    def row(user, value):
        return F.struct(user.cast("long").alias("user_id"), F.col("event_type").alias("event_type"), value.alias("amount"), note.alias("note"))

    now, was, moved = row(F.col("user_id"), amount), row(F.col("user_id"), amount - 1), row(F.col("user_id") + 1000, amount)
    kind = F.col("event_type")
    record = lambda step, op, before, after: F.struct(F.lit(step).alias("step"), F.lit(op).alias("op"), before.alias("before"), after.alias("after"))
    none = F.lit(None).cast("struct<user_id:bigint,event_type:string,amount:bigint,note:string>")
    records = (
        F.when(kind == "signup", F.array(record(0, "c", none, now)))
        .when(kind == "view", F.array(record(0, "u", was, now)))
        .when(kind == "click", F.array(record(0, "d", was, none), record(1, "c", none, now)))
        .when(kind == "error", F.array(record(0, "u", was, moved)))
        .otherwise(F.array(record(0, "d", now, none)))
    )
    df = events.select((2 * F.col("event_id")).alias("base"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.explode(records).alias("r"))
    return df.select(
        F.lit(TOPIC).alias("raw_topic"), (F.col("base") + F.col("r.step")).alias("offset"), "r.op", "r.before", "r.after", F.lit(DATABASE).alias("db"), F.lit(TABLE).alias("tbl"), "ts_ms",
    )


#: The same log, and its events, in DuckDB SQL: raw (offset order in seq) and ev.
LOG_SQL = """
base AS (
  SELECT event_id, user_id, event_type, CAST(floor(value * 100) AS BIGINT) AS amount, CASE WHEN event_id % 3 <> 0 THEN 'n' || CAST(event_id % 7 AS VARCHAR) END AS note, epoch_us(ts) // 1000 AS ts_ms FROM events
), raw0 AS (
  SELECT 2 * event_id AS "offset", CASE event_type WHEN 'signup' THEN 'c' WHEN 'view' THEN 'u' WHEN 'click' THEN 'd' WHEN 'error' THEN 'u' ELSE 'd' END AS op,
    CASE WHEN event_type <> 'signup' THEN user_id END AS b_user, CASE WHEN event_type = 'purchase' THEN amount WHEN event_type <> 'signup' THEN amount - 1 END AS b_amount,
    CASE WHEN event_type = 'error' THEN user_id + 1000 WHEN event_type IN ('signup', 'view') THEN user_id END AS a_user, CASE WHEN event_type IN ('signup', 'view', 'error') THEN amount END AS a_amount,
    event_type, note, ts_ms FROM base
  UNION ALL
  SELECT 2 * event_id + 1, 'c', NULL, NULL, user_id, amount, event_type, note, ts_ms FROM base WHERE event_type = 'click'
), raw AS (SELECT *, row_number() OVER (ORDER BY "offset") - 1 AS seq FROM raw0),
near AS (
  SELECT *, lead(op) OVER w AS n_op, lead(a_user) OVER w AS n_user, lead(a_amount) OVER w AS n_amount, lead(event_type) OVER w AS n_type, lead(note) OVER w AS n_note, lead(ts_ms) OVER w AS n_ts,
    lag(op) OVER w AS p_op, lag(b_user) OVER w AS p_user FROM raw WINDOW w AS (ORDER BY seq)
), marked AS (
  SELECT *, op = 'd' AND coalesce(n_op, '') = 'c' AND b_user = n_user AS opens, op = 'c' AND coalesce(p_op, '') = 'd' AND p_user = a_user AS closes FROM near
), ev AS (
  SELECT seq, 0 AS sub, 'UPDATE' AS op, b_user AS k, b_user, b_amount, event_type AS b_type, note AS b_note, n_user AS d_user, n_amount AS d_amount, n_type AS d_type, n_note AS d_note, greatest(ts_ms, n_ts) AS event_ms
    FROM marked WHERE coalesce(opens, FALSE)
  UNION ALL SELECT seq, 0, 'DELETE', b_user, b_user, b_amount, event_type, note, b_user, b_amount, event_type, note, ts_ms FROM marked WHERE op = 'd' AND NOT coalesce(opens, FALSE)
  UNION ALL SELECT seq, 0, 'UPDATE', a_user, b_user, b_amount, event_type, note, a_user, a_amount, event_type, note, ts_ms FROM marked WHERE op = 'u' AND a_user = b_user
  UNION ALL SELECT seq, 0, 'DELETE', b_user, b_user, b_amount, event_type, note, b_user, b_amount, event_type, note, ts_ms FROM marked WHERE op = 'u' AND a_user <> b_user
  UNION ALL SELECT seq, 1, 'INSERT', a_user, NULL, NULL, NULL, NULL, a_user, a_amount, event_type, note, ts_ms FROM marked WHERE op = 'u' AND a_user <> b_user
  UNION ALL SELECT seq, 0, 'INSERT', a_user, NULL, NULL, NULL, NULL, a_user, a_amount, event_type, note, ts_ms FROM marked WHERE op = 'c' AND NOT coalesce(closes, FALSE)
)
"""
