"""An index of a file log: which offsets, times and log positions each file holds, so that a start reads only the files behind it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import DEFAULT_ZONE
from .readers import log_file_number, start_filter, wall_clock_ms

INDEX = "file string, raw_topic string, first_offset long, last_offset long, first_ms long, last_ms long, last_file_number long, last_log_file string, last_log_pos long"


class LogIndex:
    """A row a file and topic, appended as files come; a file, once written, must not change."""

    def __init__(self, spark: SparkSession, path: str, log_path: str, schema):
        self.spark, self.path, self.log_path = spark, path.rstrip("/"), log_path
        self.schema = spark.createDataFrame([], schema).schema

    def rows(self) -> DataFrame:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        there = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        return self.spark.read.schema(INDEX).parquet(self.path) if there else self.spark.createDataFrame([], INDEX)

    def refresh(self) -> int:
        """Index the files that aren't yet; how many those were. Only they are read."""
        known = {r["file"] for r in self.rows().select("file").distinct().collect()}  # names of files, which Spark's own listing has on the driver as well
        fresh = sorted(set(self.spark.read.schema(self.schema).parquet(self.log_path).inputFiles()) - known)
        if fresh:
            log = self.spark.read.schema(self.schema).parquet(*fresh)
            positioned = "log_file" in self.schema.names
            last = F.max(F.struct(log_file_number(F.col("log_file")).alias("n"), F.col("log_file").alias("f"), F.col("log_pos").alias("p"))) if positioned else F.lit(None).cast("struct<n:bigint,f:string,p:bigint>")
            found = log.groupBy(F.input_file_name().alias("file"), "raw_topic").agg(
                F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), last.alias("last")
            )
            told = found.select("file", "raw_topic", "first_offset", "last_offset", "first_ms", "last_ms", F.col("last.n").alias("last_file_number"), F.col("last.f").alias("last_log_file"), F.col("last.p").alias("last_log_pos"))
            told.coalesce(1).write.mode("append").parquet(self.path)
        return len(fresh)

    def files(self, mode: str, topic: str | None = None, wall_clock: str | None = None, zone: str = DEFAULT_ZONE, file: str | None = None, position: int | None = None, end_offset: int | None = None) -> list[str]:
        """Files that may hold a record at or behind a start; arguments as of readers.start_filter()."""
        if mode == "LATEST":
            may = F.col("last_offset") >= F.lit(end_offset)
        elif mode == "TIMESTAMP":
            may = F.col("last_ms") >= wall_clock_ms(wall_clock, zone)
        else:
            at = F.struct(log_file_number(F.lit(file)).alias("n"), F.lit(file).alias("f"), F.lit(position).cast("long").alias("p"))
            may = F.struct(F.col("last_file_number").alias("n"), F.col("last_log_file").alias("f"), F.col("last_log_pos").alias("p")) >= at
        found = self.rows().where(may)
        found = found if topic is None else found.where(F.col("raw_topic") == topic)
        return sorted(r["file"] for r in found.select("file").distinct().collect())

    def read_from(self, mode: str, topic: str | None = None, **start) -> DataFrame:
        """The records of the log at or behind a start, of one topic or of all; what start_filter() leaves of the whole log, read from its last files alone."""
        files = self.files(mode, topic, **start)
        log = self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)
        log = log.where(start_filter(mode, **start))
        return log if topic is None else log.where(F.col("raw_topic") == topic)
