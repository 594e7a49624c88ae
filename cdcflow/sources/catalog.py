"""A database's own catalog as tables: columns and keys in the form that operators.schema takes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..operators.schema import user_databases

COLUMNS = "table_name string, column_name string, position int, type_name string, jdbc_type int, size int, scale int, nullable boolean, default_value string"
KEYS = "table_name string, index_name string, key_seq int, column_name string, is_primary boolean"
NULLABLE = 1  # fixed value: java.sql.DatabaseMetaData.columnNullable


@contextmanager
def connection(spark: SparkSession, url: str, properties: dict | None = None):
    """A JDBC connection of the driver, for metadata and single statements; data goes through Spark's reader and writer."""
    jvm = spark.sparkContext._jvm
    said = jvm.java.util.Properties()
    for k, v in (properties or {}).items():
        said.setProperty(k, str(v))
    conn = jvm.java.sql.DriverManager.getConnection(url, said)
    try:
        yield conn
    finally:
        conn.close()


def _rows(found) -> Iterator:
    try:
        while found.next():
            yield found
    finally:
        found.close()


def _one(meta, schema: str | None, table: str) -> tuple[list, list]:
    columns = []
    for r in _rows(meta.getColumns(None, schema, table, None)):
        columns.append((table, r.getString("COLUMN_NAME"), r.getInt("ORDINAL_POSITION"), r.getString("TYPE_NAME"), r.getInt("DATA_TYPE"), r.getInt("COLUMN_SIZE"), r.getInt("DECIMAL_DIGITS"), r.getInt("NULLABLE") == NULLABLE, r.getString("COLUMN_DEF")))
    if not columns:
        raise LookupError("table not found")
    keys = [(table, r.getString("PK_NAME") or "PRIMARY", r.getInt("KEY_SEQ"), r.getString("COLUMN_NAME"), True) for r in _rows(meta.getPrimaryKeys(None, schema, table))]
    for r in _rows(meta.getIndexInfo(None, schema, table, True, True)):
        if r.getString("COLUMN_NAME"):
            keys.append((table, r.getString("INDEX_NAME"), r.getInt("ORDINAL_POSITION"), r.getString("COLUMN_NAME"), False))
    return columns, keys


def list_tables(spark: SparkSession, url: str, properties: dict | None = None) -> DataFrame:
    """database_name, table_name of all tables of a server but its own: of databases where it has them, else of schemas."""
    found = []
    with connection(spark, url, properties) as conn:
        kinds = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.java.lang.String, 1)
        kinds[0] = "TABLE"
        for r in _rows(conn.getMetaData().getTables(None, None, None, kinds)):
            found.append((r.getString("TABLE_CAT") or r.getString("TABLE_SCHEM"), r.getString("TABLE_NAME")))
    return user_databases(spark.createDataFrame(found, "database_name string, table_name string"))


def read_catalog(spark: SparkSession, url: str, tables: list[str], schema: str | None = None, properties: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(columns, keys, errors) of some tables over one connection. A table that is missing or fails is a row of errors (table_name, error) and hides no other."""
    columns, keys, errors = [], [], []
    with connection(spark, url, properties) as conn:
        meta = conn.getMetaData()
        for table in tables:
            try:
                c, k = _one(meta, schema, table)
            except Exception as e:  # whatever the driver raises for this table
                errors.append((table, str(e).splitlines()[0]))
                continue
            columns += c
            keys += k
    return spark.createDataFrame(columns, COLUMNS), spark.createDataFrame(keys, KEYS), spark.createDataFrame(errors, "table_name string, error string")
