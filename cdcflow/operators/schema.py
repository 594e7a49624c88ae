"""Table metadata: keys, drift, and whether a target can take a source.

Column metadata: table_name, column_name, position, type_name, jdbc_type, size, scale, nullable, default_value. Key metadata: table_name, index_name,
key_seq, column_name, is_primary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Databases of the server itself.
SYSTEM_SCHEMAS = ("information_schema", "mysql", "performance_schema", "sys", "pg_catalog", "pg_toast")
#: Families of type names; the first pattern that is found wins, so a name that merely contains "int" is numeric.
FAMILIES = (
    ("numeric", "tinyint|smallint|mediumint|int|integer|bigint|decimal|numeric|float|double|real|serial|money"),
    ("string", "char|varchar|string|text|clob|json|enum|set"),
    ("temporal", "date|time|year|timestamp"),
    ("binary", "blob|binary|bytea|bit"),
    ("boolean", "bool"),
)
#: Java.sql.Types of truth values.
JDBC_BIT, JDBC_BOOLEAN = -7, 16


def type_family(type_name: Column, jdbc_type: Column) -> Column:
    out = F.when(F.lower(type_name).rlike(FAMILIES[0][1]), FAMILIES[0][0])
    for name, pattern in FAMILIES[1:]:
        out = out.when(F.lower(type_name).rlike(pattern), name)
    return out.otherwise(jdbc_type.cast("string"))


def holds_truth(column: dict[str, Column]) -> Column:
    """Source types that hold a truth value: BIT(1), and tinyint of one digit."""
    return F.coalesce(((column["jdbc"] == JDBC_BIT) & (column["size"] == 1)) | (F.lower(column["name"]).contains("tinyint") & (column["size"] <= 1)), F.lit(False))


def is_boolean(column: dict[str, Column]) -> Column:
    """Target types that are boolean by name or by JDBC type."""
    return F.coalesce(column["jdbc"] == JDBC_BOOLEAN, F.lit(False)) | F.coalesce(F.lower(column["name"]).isin("bool", "boolean"), F.lit(False))


def types_compatible(source: dict[str, Column], target: dict[str, Column], postgres: bool) -> Column:
    """Can the target's column take the source's? Both map name (type_name), jdbc, size to columns. A JSON source has no cast to PostgreSQL's json types."""
    name = lambda x: F.coalesce(F.lower(x["name"]), F.lit(""))
    families = [type_family(name(x), x["jdbc"]) for x in (source, target)]
    refused = F.lit(postgres) & (name(source) == "json") & name(target).isin("json", "jsonb")
    small = (families[0] == "numeric") & (families[1] == "boolean") & name(source).contains("tinyint")
    return F.when(refused, False).otherwise((holds_truth(source) & is_boolean(target)) | families[0].eqNullSafe(families[1]) | small)


def user_databases(databases: DataFrame) -> DataFrame:
    return databases.where(~F.lower("database_name").isin(*SYSTEM_SCHEMAS))


def key_candidates(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """table_name, index_name, is_primary, key_columns (in order), rank: the keys to sync by. Primary first, then unique indexes without nullable columns; an index with the primary key's columns is dropped."""
    known = columns.select("table_name", F.lower("column_name").alias("k"), "nullable")
    joined = keys.withColumn("k", F.lower("column_name")).join(known, ["table_name", "k"], "left")
    listed = joined.groupBy("table_name", "index_name", "is_primary").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("key_seq", "column_name"))), lambda x: x["column_name"]).alias("key_columns"),
        F.every(~F.coalesce("nullable", F.lit(True))).alias("solid"),
    )
    listed = listed.where(F.col("is_primary") | F.col("solid"))
    w = Window.partitionBy("table_name", "key_columns").orderBy(F.desc("is_primary"), "index_name")
    listed = listed.withColumn("again", F.row_number().over(w)).where("again = 1")
    return listed.select("table_name", "index_name", "is_primary", "key_columns", F.row_number().over(Window.partitionBy("table_name").orderBy(F.desc("is_primary"), "index_name")).alias("rank"))


def requested_tables(columns: DataFrame, wanted: DataFrame) -> DataFrame:
    """table_name, n_columns, error for each wanted table: one that is missing is a row with an error and hides no other."""
    n = columns.groupBy(F.lower("table_name").alias("t")).agg(F.count("*").alias("n_columns"))
    both = wanted.withColumn("t", F.lower("table_name")).join(n, "t", "left")
    return both.select("table_name", F.coalesce("n_columns", F.lit(0)).alias("n_columns"), F.when(F.col("n_columns").isNull(), "table not found").alias("error"))


def snapshots(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """table_name, snapshot (JSON: columns by lower-cased name, primary key in order), hash (SHA-256)."""
    col = F.struct(F.lower("column_name").alias("name"), F.col("type_name").alias("typeName"), F.col("jdbc_type").alias("jdbcType"), "size", "scale", "nullable")
    c = columns.groupBy("table_name").agg(F.array_sort(F.collect_list(col)).alias("columns"))
    k = keys.where("is_primary").groupBy("table_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("key_seq", "column_name"))), lambda x: F.lower(x["column_name"])).alias("primaryKeys"))
    both = c.join(k, "table_name", "left").withColumn("primaryKeys", F.coalesce("primaryKeys", F.array().cast("array<string>")))
    out = both.withColumn("snapshot", F.to_json(F.struct("columns", "primaryKeys"), {"ignoreNullFields": "false"}))
    return out.select("table_name", "snapshot", F.sha2("snapshot", 256).alias("hash"), "primaryKeys")


def drift(base_columns: DataFrame, base_keys: DataFrame, now_columns: DataFrame, now_keys: DataFrame) -> DataFrame:
    """table_name, change_type (comma list, null without changes), risk_level for each table of the baseline.

    Only tables whose hashes differ are compared column by column. LOW only if every change is an added nullable column.
    """
    was, now = snapshots(base_columns, base_keys), snapshots(now_columns, now_keys).select("table_name", F.col("hash").alias("now_hash"), F.col("primaryKeys").alias("now_keys"))
    tables = was.select("table_name", "hash", "primaryKeys").join(now, "table_name", "left")
    changed = tables.where(F.col("now_hash").isNotNull() & (F.col("hash") != F.col("now_hash")))
    spec = F.struct("type_name", "jdbc_type", "size", "scale", "nullable")
    names = changed.select("table_name")
    a = base_columns.join(names, "table_name", "left_semi").select("table_name", F.lower("column_name").alias("c"), spec.alias("was"))
    b = now_columns.join(names, "table_name", "left_semi").select("table_name", F.lower("column_name").alias("c"), spec.alias("is"))
    both = a.join(b, ["table_name", "c"], "full")
    has = lambda cond: F.bool_or(F.coalesce(cond, F.lit(False)))
    parts = both.groupBy("table_name").agg(
        has(F.col("was").isNull()).alias("added"), has(F.col("is").isNull()).alias("gone"), has(F.col("was").isNotNull() & F.col("is").isNotNull() & ~F.col("was").eqNullSafe(F.col("is"))).alias("altered"),
        has(F.col("was").isNull() & ~F.coalesce("is.nullable", F.lit(False))).alias("added_required"),
    )
    out = tables.join(parts, "table_name", "left").withColumn("rekeyed", F.col("now_keys").isNotNull() & (F.col("primaryKeys") != F.col("now_keys")))
    missing = F.col("now_hash").isNull()
    say = lambda c, text: F.when(F.coalesce(F.col(c), F.lit(False)), F.lit(text))
    change = F.concat_ws(",", say("added", "ADD_COLUMN"), say("gone", "DROP_COLUMN"), say("altered", "ALTER_COLUMN"), say("rekeyed", "KEY_CHANGED"))
    change = F.when(missing, "TABLE_UNAVAILABLE").when(change != "", change)
    low = F.coalesce(F.col("added") & ~F.col("gone") & ~F.col("altered") & ~F.col("rekeyed") & ~F.col("added_required"), F.lit(False))
    return out.select("table_name", change.alias("change_type"), F.when(change.isNull(), None).when(low, "LOW").otherwise("HIGH").alias("risk_level"))


def column_sets(base_columns: DataFrame, now_columns: DataFrame) -> DataFrame:
    """table_name, added, removed, common: sorted arrays of lower-cased column names."""
    sets = lambda df, n: df.groupBy("table_name").agg(F.collect_set(F.lower("column_name")).alias(n))
    both = sets(base_columns, "was").join(sets(now_columns, "is"), "table_name", "full")
    empty = F.array().cast("array<string>")
    a, b = F.coalesce("was", empty), F.coalesce("is", empty)
    return both.select("table_name", F.sort_array(F.array_except(b, a)).alias("added"), F.sort_array(F.array_except(a, b)).alias("removed"), F.sort_array(F.array_intersect(a, b)).alias("common"))


def followed_selection(selected: Column, baseline: Column, current: Column) -> Column:
    """A selection that covered the whole baseline becomes the current columns; an explicit subset stays, as does any selection where no baseline is known."""
    lower = lambda c: F.transform(c, lambda x: F.lower(x))
    known = F.coalesce(F.size(baseline) > 0, F.lit(False))
    return F.when(known & (F.size(F.array_except(lower(baseline), lower(selected))) == 0), current).otherwise(selected)


def drift_state(drifted: DataFrame, compatible: DataFrame, open_events: DataFrame, baselines: DataFrame) -> DataFrame:
    """table_name, state: BASELINE_SET (none was known, and the target fits), PENDING_FIX, READY_TO_RESUME or null (nothing to do).

    A table that can't be read is pending, whatever else is known of it. A change is ready to resume once the target fits, and so is an open event whose table is back at its baseline.
    """
    df = drifted.join(compatible.select("table_name", "compatible"), "table_name", "left").join(open_events.select("table_name", F.lit(True).alias("open")), "table_name", "left")
    df = df.join(baselines.select("table_name", F.lit(True).alias("known")), "table_name", "left")
    fits, opened = F.coalesce("compatible", F.lit(False)), F.coalesce("open", F.lit(False))
    state = (
        F.when(F.coalesce(F.col("change_type") == "TABLE_UNAVAILABLE", F.lit(False)), "PENDING_FIX")
        .when(F.col("known").isNull(), F.when(fits, "BASELINE_SET"))
        .when(F.col("change_type").isNull(), F.when(opened, "READY_TO_RESUME"))
        .otherwise(F.when(fits, "READY_TO_RESUME").otherwise("PENDING_FIX"))
    )
    return df.select("table_name", state.alias("state"))


def target_compatibility(source: DataFrame, target: DataFrame, source_keys: DataFrame, target_keys: DataFrame, mode: str, postgres: bool = False) -> DataFrame:
    """table_name, missing, incompatible, extra_required (comma lists), keys_equal, target_exists, compatible for each source table.

    source_keys and target_keys: table_name, key_columns. A source without a key asks for none. A required column without a default, or with a blank one, must come from the source.
    An absent target passes when the mode is FULL or the source has a key.
    """
    s = source.select("table_name", F.lower("column_name").alias("c"), F.struct("type_name", "jdbc_type", "size").alias("s"))
    t = target.select("table_name", F.lower("column_name").alias("c"), F.struct("type_name", "jdbc_type", "size", "nullable", "default_value").alias("t"))
    both = s.join(t, ["table_name", "c"], "full")
    side = lambda x: {"name": F.col(f"{x}.type_name"), "jdbc": F.col(f"{x}.jdbc_type"), "size": F.col(f"{x}.size")}
    named = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col("c")))), ",")
    in_both = F.col("s").isNotNull() & F.col("t").isNotNull()
    per = both.groupBy("table_name").agg(
        named(F.col("t").isNull()).alias("missing"), named(in_both & ~types_compatible(side("s"), side("t"), postgres)).alias("incompatible"),
        named(F.col("s").isNull() & ~F.col("t.nullable") & (F.trim(F.coalesce("t.default_value", F.lit(""))) == "")).alias("extra_required"), F.bool_or(F.col("t").isNotNull()).alias("target_exists"),
        F.bool_or(F.col("s").isNotNull()).alias("has_source"),
    ).where("has_source")
    lower = lambda c: F.transform(c, lambda x: F.lower(x))
    keys = per.join(source_keys.select("table_name", lower("key_columns").alias("sk")), "table_name", "left").join(target_keys.select("table_name", lower("key_columns").alias("tk")), "table_name", "left")
    keyed = F.coalesce(F.size("sk") > 0, F.lit(False))
    equal = ~keyed | F.coalesce(F.col("sk") == F.col("tk"), F.lit(False))
    absent_ok = F.lit(mode.upper() == "FULL") | keyed
    fits = (F.col("missing") == "") & (F.col("incompatible") == "") & (F.col("extra_required") == "") & equal
    return keys.select(
        "table_name", F.when(F.col("target_exists"), F.col("missing")).otherwise("").alias("missing"), "incompatible", "extra_required", equal.alias("keys_equal"), "target_exists",
        F.when(F.col("target_exists"), fits).otherwise(absent_ok).alias("compatible"),
    )


def new_tables(catalog: DataFrame, known: DataFrame, room: int) -> DataFrame:
    """table_name, taken: tables that aren't known yet (ignoring case, within the catalog too), the first `room` by name taken. The catalog lists tables, not rows."""
    fresh = catalog.groupBy(F.lower("table_name")).agg(F.min("table_name").alias("table_name")).select("table_name").join(known.select(F.lower("table_name").alias("k")), F.lower("table_name") == F.col("k"), "left_anti")
    return fresh.withColumn("taken", F.row_number().over(Window.orderBy("table_name")) <= room)


def time_precision_risks(columns: DataFrame) -> DataFrame:
    """TIME columns with a fraction (size over 8), whose digits a target may lose."""
    return columns.where((F.lower("type_name") == "time") & (F.col("size") > 8)).select("table_name", "column_name")
