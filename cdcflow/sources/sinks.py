"""Events and tables out: versioned tables with an atomic pointer, appends, keyed writes, event logs."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.apply import ORDER, merged_into, row_key
from .catalog import connection


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Conflict(RuntimeError):
    """Another writer made the version that this one was about to make."""


class VersionedTable:
    """A table on files: each version is a folder of its own, and a marker, made once and never changed, names it.

    The newest marker that names a folder is the current version. A marker is created only where there is none, after its folder is complete, so readers see
    the old version until that moment and a write that fails at any step leaves the old version current. A writer makes exactly the successor of the version that it
    started from: if another has made that meanwhile, it fails with Conflict and nothing is lost. A marker that a writer left empty (it broke off between
    creating and naming) stops later writers until repair() takes it away.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _markers(self) -> list[int]:
        p, fs = _fs(self.spark, f"{self.root}/_versions")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p)) if fs.exists(p) else []

    def _lines(self, version: int) -> list[str]:
        """Of a marker: the folder, and the position in the log that the version stands for."""
        return [r["value"] for r in self.spark.read.text(f"{self.root}/_versions/{version:012d}", wholetext=True).collect() if r["value"]]

    def _folder(self, version: int) -> str | None:
        lines = "".join(self._lines(version)).splitlines()
        return lines[0] if lines else None

    def position(self, version: int | None = None) -> dict | None:
        """Run and seq of the last event that a version has, as {"run": ..., "seq": ...}; None if it was written otherwise."""
        lines = "".join(self._lines(self._current() if version is None else version)).splitlines()
        return json.loads(lines[1]) if len(lines) > 1 else None

    def current(self) -> int | None:
        """Number of the newest version; a marker that a writer left empty counts for nothing."""
        return next((n for n in reversed(self._markers()) if self._folder(n)), None)

    def _current(self) -> int:
        version = self.current()
        if version is None:
            raise FileNotFoundError(f"{self.root} has no version yet")
        return version

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self._folder(self._current() if version is None else version)}")

    def overwrite(self, df: DataFrame, after: int | None = None, position=None) -> int:
        """Write df as the folder of the version behind `after` (the current one, if not given) and, once it is complete, mark it, with the position in the log that it stands for."""
        base, folder = (self.current() or 0) if after is None else after, f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        self._mark(base + 1, folder, position)
        return base + 1

    def _mark(self, version: int, folder: str, position=None) -> None:
        p, fs = _fs(self.spark, f"{self.root}/_versions/{version:012d}")
        if any(n >= version for n in self._markers()):
            raise Conflict(f"version {version} of {self.root} has been made, or is being made, by another writer")
        try:
            out = fs.create(p, False)  # fails if another writer has made it
        except Exception as e:
            raise Conflict(f"version {version} of {self.root} has been made by another writer") from e
        said = position() if callable(position) else position
        out.writeBytes(folder + (f"\n{json.dumps(said)}" if said else ""))
        out.close()

    def repair(self) -> list[int]:
        """Take away the markers that name nothing; only while nobody writes."""
        gone = [n for n in self._markers() if not self._folder(n)]
        for n in gone:
            p, fs = _fs(self.spark, f"{self.root}/_versions/{n:012d}")
            fs.delete(p, False)
        return gone

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete the folders that none of the newest `keep` versions uses; only while nobody writes or reads an older one. Returns their names."""
        kept = {f for n in self._markers()[-keep:] for f in self._used(n)}
        p, fs = _fs(self.spark, self.root)
        gone = [s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("data-") and s.getPath().getName() not in kept]
        for name in gone:
            fs.delete(_fs(self.spark, f"{self.root}/{name}")[0], True)
        return gone

    def _used(self, version: int) -> set[str]:
        return {f for f in [self._folder(version)] if f}

    def apply(self, events: DataFrame, keys: list[str]) -> int:
        """The next version: the one read here after the events. Its position is the last event's, or the old one without any."""
        version = self._current()
        return self.overwrite(merged_into(self.read(version), events, keys), after=version, position=self._reached(events, version))

    def _reached(self, events: DataFrame, version: int) -> Callable[[], dict | None]:
        was = self.position(version)
        place = F.struct(*[(F.col(c) if c in events.columns else F.lit(0)).cast("long").alias(c) for c in ("run", "seq")])

        def last() -> dict | None:
            found = events.agg(F.max(place).alias("last")).first()["last"]
            new = {"run": found["run"], "seq": found["seq"]} if found else None
            return max((p for p in (was, new) if p), key=lambda p: (p["run"], p["seq"]), default=None)

        return last


class BucketedTable(VersionedTable):
    """A versioned table whose rows lie in buckets by the hash of their key, a file each: an apply rewrites only the buckets that hold a changed key.

    A version is a list of buckets and the folders that hold them (bucket, path: a row a bucket); it shares the folders of unchanged buckets with the version
    before. Choose as many buckets as give files of some hundred MB: with b buckets, an apply of k changed keys reads and writes at most k / b of the table.
    Bucket numbers (at most n_buckets) are all that the driver gathers.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], n_buckets: int = 1024):
        super().__init__(spark, root)
        self.keys, self.n_buckets = keys, n_buckets

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.n_buckets)).cast("int")

    def _manifest(self, version: int) -> dict[int, str]:
        rows = self.spark.read.schema("bucket int, path string").parquet(f"{self.root}/{self._folder(version)}/buckets").collect()
        return {r["bucket"]: r["path"] for r in rows}

    def _used(self, version: int) -> set[str]:
        folder = self._folder(version)
        return {folder, *(p.split("/")[0] for p in self._manifest(version).values())} if folder else set()

    def _schema(self, version: int) -> T.StructType:
        return self.spark.read.parquet(f"{self.root}/{self._folder(version)}/empty").schema

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The table, or some of its buckets, whose files are all that is read."""
        version = self._current() if version is None else version
        paths = [p for b, p in sorted(self._manifest(version).items()) if buckets is None or b in buckets]
        schema = self._schema(version)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], schema)

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """Rows of the table whose key is among wanted (the key columns); reads only the buckets that may hold them."""
        buckets = [r["b"] for r in wanted.select(self._bucket(row_key(wanted, self.keys)).alias("b")).distinct().collect()]
        return self.read(buckets=buckets).join(wanted.select(*self.keys).distinct(), self.keys, "left_semi")

    def _write(self, df: DataFrame, kept: dict[int, str], after: int, position=None) -> int:
        folder = f"data-{uuid.uuid4().hex}"
        named = df.withColumn("_bucket", self._bucket(row_key(df, self.keys)))
        named.repartition("_bucket").sortWithinPartitions("_bucket", *self.keys).write.partitionBy("_bucket").parquet(f"{self.root}/{folder}/rows")
        p, fs = _fs(self.spark, f"{self.root}/{folder}/rows")
        made = {int(n.partition("=")[2]): f"{folder}/rows/{n}" for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.startswith("_bucket=")}
        self.spark.createDataFrame(sorted((kept | made).items()), "bucket int, path string").coalesce(1).write.parquet(f"{self.root}/{folder}/buckets")
        self.spark.createDataFrame([], df.schema).write.parquet(f"{self.root}/{folder}/empty")
        self._mark(after + 1, folder, position)
        return after + 1

    def overwrite(self, df: DataFrame, after: int | None = None, position=None) -> int:
        return self._write(df, {}, (self.current() or 0) if after is None else after, position)

    def touched(self, events: DataFrame) -> list[int]:
        """Buckets of the keys that have an event."""
        return sorted(r["b"] for r in events.select(self._bucket(F.col("key")).alias("b")).distinct().collect())

    def apply(self, events: DataFrame, keys: list[str] | None = None) -> int:
        """The next version: the touched buckets after the events, the others as they are."""
        version = self._current()
        buckets = self.touched(events)
        kept = {b: p for b, p in self._manifest(version).items() if b not in set(buckets)}
        return self._write(merged_into(self.read(version, buckets), events, self.keys), kept, version, self._reached(events, version))


def append(df: DataFrame, path: str, partition_by: list[str] = []) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def events_by_key(events: DataFrame, partitions: int) -> DataFrame:
    """key, value in stable partitions by key, each in order: what an event sink is given."""
    return events.repartition(partitions, "key").sortWithinPartitions(*[c for c in ORDER if c in events.columns]).select("key", "value")


def write_kafka(events: DataFrame, servers: str, topic: str, partitions: int) -> None:
    """Publish to Kafka; needs the connector on the classpath."""
    events_by_key(events, partitions).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def jdbc_overwrite(df: DataFrame, url: str, table: str, column_types: str | None = None, properties: dict | None = None) -> None:
    """Create or replace a table from df's schema."""
    writer = df.write.format("jdbc").mode("overwrite").option("url", url).option("dbtable", table).options(**(properties or {}))
    (writer.option("createTableColumnTypes", column_types) if column_types else writer).save()


#: Types of a created table by dialect, where they aren't Spark's own names.
_TYPES = {
    "standard": {"string": "VARCHAR({n})", "double": "DOUBLE PRECISION", "float": "REAL", "binary": "VARCHAR({n}) FOR BIT DATA", "timestamp_ntz": "TIMESTAMP", "tinyint": "SMALLINT"},
    "postgresql": {"string": "TEXT", "double": "DOUBLE PRECISION", "float": "REAL", "binary": "BYTEA", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMPTZ", "tinyint": "SMALLINT"},
    "mysql": {"string": "LONGTEXT", "binary": "LONGBLOB", "timestamp_ntz": "DATETIME(6)", "timestamp": "TIMESTAMP(6)", "key": "VARCHAR(255)"},
}


def create_table_sql(schema: T.StructType, table: str, keys: list[str], dialect: str, unique: list[list[str]] = [], selected: list[str] | None = None, text_length: int = 2000) -> str:
    """The statement that creates a target for a source's schema: the selected columns, the sync key as primary key.

    The source's other unique keys (`unique`) are cloned only if all of its columns are selected. Key columns are NOT NULL.
    """
    q, types = "`" if dialect == "mysql" else '"', _TYPES[dialect]
    name = lambda c: f"{q}{c}{q}"
    chosen = {c.lower() for c in selected or schema.names}
    if missing := [k for k in keys if k.lower() not in chosen]:
        raise ValueError(f"key columns must be selected: {', '.join(missing)}")
    whole = all(f.name.lower() in chosen for f in schema)
    solid = {k.lower() for k in keys}
    parts = []
    for f in schema:
        if f.name.lower() in chosen:
            kind = types.get(f.dataType.simpleString(), f.dataType.simpleString().upper())
            if f.name.lower() in solid and f.dataType.simpleString() == "string":
                kind = types.get("key", kind)
            parts.append(f"{name(f.name)} {kind.format(n=text_length)}{' NOT NULL' if f.name.lower() in solid or not f.nullable else ''}")
    listed = lambda cs: ", ".join(name(next(f.name for f in schema if f.name.lower() == c.lower())) for c in cs)
    parts += [f"PRIMARY KEY ({listed(keys)})"] if keys else []
    parts += [f"UNIQUE ({listed(u)})" for u in unique if whole and [c.lower() for c in u] != [k.lower() for k in keys]]
    return f"CREATE TABLE {table} ({', '.join(parts)})"


def jdbc_create(spark: SparkSession, url: str, statement: str, properties: dict | None = None) -> None:
    with connection(spark, url, properties) as conn:
        conn.createStatement().executeUpdate(statement)


def stage_columns(columns: list[str]) -> tuple[str, str]:
    """Names that a staging table has for a change's key and op, apart from the columns in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in ("change_key", "change_op"):
        while name in taken:
            name += "_"
        out.append(name)
    return out[0], out[1]


def jdbc_stage_changes(changes: DataFrame, url: str, stage_table: str, batch_size: int = 100, properties: dict | None = None) -> None:
    """Write the last change of each key to a staging table, from which the database upserts and deletes in one statement of its dialect."""
    key, op = stage_columns(changes.schema["data"].dataType.names)
    flat = changes.select(F.col("key").alias(key), F.col("op").alias(op), "data.*")
    flat.write.format("jdbc").mode("overwrite").option("createTableColumnTypes", f"`{op}` VARCHAR(8)").option("url", url).option("dbtable", stage_table).option("batchsize", batch_size).options(**(properties or {})).save()


def upsert_sql(target: str, stage: str, columns: list[str], keys: list[str], dialect: str) -> list[str]:
    """Statements that bring a staging table of last changes into the target: deletes first, then upserts; one MERGE in the standard dialect."""
    q = "`" if dialect == "mysql" else '"'
    name = lambda c: f"{q}{c}{q}"
    op = name(stage_columns(columns)[1])
    listed, on = ", ".join(map(name, columns)), " AND ".join(f"t.{name(k)} = s.{name(k)}" for k in keys)
    rest = [c for c in columns if c not in keys]
    if dialect == "standard":
        put = f"WHEN NOT MATCHED AND s.{op} <> 'DELETE' THEN INSERT ({listed}) VALUES ({', '.join(f's.{name(c)}' for c in columns)})"
        change = f" WHEN MATCHED THEN UPDATE SET {', '.join(f'{name(c)} = s.{name(c)}' for c in rest)}" if rest else ""
        return [f"MERGE INTO {target} t USING {stage} s ON {on} WHEN MATCHED AND s.{op} = 'DELETE' THEN DELETE{change} {put}"]
    gone = f"DELETE FROM {target} t USING {stage} s WHERE {on} AND s.{op} = 'DELETE'" if dialect == "postgresql" else f"DELETE t FROM {target} t JOIN {stage} s ON {on} WHERE s.{op} = 'DELETE'"
    put = f"INSERT INTO {target} ({listed}) SELECT {listed} FROM {stage} WHERE {op} <> 'DELETE'"
    if dialect == "postgresql":
        tail = "DO UPDATE SET " + ", ".join(f"{name(c)} = EXCLUDED.{name(c)}" for c in rest) if rest else "DO NOTHING"
        return [gone, f"{put} ON CONFLICT ({', '.join(map(name, keys))}) {tail}"]
    return [gone, f"{put} ON DUPLICATE KEY UPDATE " + ", ".join(f"{name(c)} = VALUES({name(c)})" for c in rest or keys)]


class BatchLedger:
    """Which batches of which query a target has taken: a table beside it, written in the transaction that applies the batch."""

    def __init__(self, table: str, query: str):
        self.table, self.query = table, query

    def create(self, conn) -> None:
        if not conn.getMetaData().getTables(None, None, self.table.split(".")[-1].upper(), None).next() and not conn.getMetaData().getTables(None, None, self.table.split(".")[-1], None).next():
            conn.createStatement().executeUpdate(f"CREATE TABLE {self.table} (query_name VARCHAR(200) NOT NULL, batch_number BIGINT NOT NULL, PRIMARY KEY (query_name, batch_number))")

    def has(self, conn, batch: int) -> bool:
        asked = conn.prepareStatement(f"SELECT 1 FROM {self.table} WHERE query_name = ? AND batch_number = ?")
        asked.setString(1, self.query)
        asked.setLong(2, batch)
        return asked.executeQuery().next()

    def add(self, conn, batch: int) -> None:
        put = conn.prepareStatement(f"INSERT INTO {self.table} VALUES (?, ?)")  # its key refuses a batch that another writer has applied
        put.setString(1, self.query)
        put.setLong(2, batch)
        put.executeUpdate()


def jdbc_apply(
    changes: DataFrame, url: str, target: str, stage: str, keys: list[str], dialect: str, properties: dict | None = None, ledger: BatchLedger | None = None, batch: int | None = None
) -> bool:
    """Bring the last change of each key (apply.latest_changes) into a target table: staged in parallel, then applied in one transaction. False if the ledger has the batch already.

    Without a ledger, applying the same changes again leaves the same rows; but an old batch that comes again after a newer one would bring old rows back. With a
    ledger, its number is written in the same transaction, and a batch that it has is left out whole: use it as jobs.apply_stream's write.
    """
    spark = changes.sparkSession
    with connection(spark, url, properties) as conn:
        if ledger:
            ledger.create(conn)
            if ledger.has(conn, batch):
                return False
    jdbc_stage_changes(changes, url, stage, properties=properties)
    with connection(spark, url, properties) as conn:
        conn.setAutoCommit(False)
        try:
            if ledger:
                ledger.add(conn, batch)
            for statement in upsert_sql(target, stage, changes.schema["data"].dataType.names, keys, dialect):
                conn.createStatement().executeUpdate(statement)
            conn.commit()
        except Exception:
            conn.rollback()
            raise
    return True
