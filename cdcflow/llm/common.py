"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import contextvars
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a regular expression class.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """Array of the maximal runs of characters that aren't white space; empty for a null text."""
    return F.coalesce(F.array_remove(F.split(text, f"{SPACE}+"), ""), F.array().cast("array<string>"))


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fenced(df: DataFrame, *columns: Column) -> DataFrame:
    """df.select(*columns), made once a row: filters on them aren't pushed below, which would make them again for each mention."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def bundled(docs: DataFrame, carry: list[str], made: list[str]) -> tuple[DataFrame, str, list[str]]:
    """docs (doc_id, text, source where it has them) with the carried columns as one struct, its name, and which they are: those not named like what is made."""
    (name,) = spare(docs, "carried")
    kept = [c for c in carry if c.lower() not in {m.lower() for m in made}]
    own = [c for c in ("doc_id", "text", "source") if c in docs.columns]
    return docs.select(*own, F.struct(F.lit(0).alias("none_"), *[F.col(f"`{c}`") for c in kept]).alias(name)), name, kept


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share, spark.checkpoint.dir; below /tmp only where that is unset and all run on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file:///tmp/checkpoints"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Folders that written() made inside the innermost temporaries().
_made: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df, written to the shared folder and read again: its lineage is cut and it survives lost executors.

    Inside temporaries() it goes when that ends, unless keep is set, as for what a result that isn't computed yet reads.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    if _made.get() is not None and not keep:
        _made.get().append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_written(*frames: DataFrame) -> None:
    """Delete the files of frames that written() made, once nothing reads them any more."""
    for df in frames:
        for file in df.inputFiles()[:1]:
            _delete(df.sparkSession, file.rpartition("/")[0])


def release(spark: SparkSession) -> None:
    """Have the driver's JVM look for shuffles that nothing refers to any more, so that Spark removes their files now."""
    spark.sparkContext._jvm.System.gc()


FILTER_BITS = 1 << 24
_PART_BITS = 1 << 15  # of a bitmap as bitmap_construct_agg makes it


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """part, bits: a bitmap with the slots of all keys, in 512 rows of 4 KB at most; written. For maybe_in()."""
    slot = F.pmod(F.col(key), F.lit(FILTER_BITS))
    parts = keys.select(F.floor(slot / _PART_BITS).cast("int").alias("part"), F.pmod(slot, F.lit(_PART_BITS)).alias("at"))
    return written(parts.groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits")), "filter")


def maybe_in(df: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """Rows of df whose key (a long) is one of those of key_filter(), and few others unless they were many."""
    slot = F.pmod(F.col(key), F.lit(FILTER_BITS))
    names = spare(df, "part", "bits")
    part, bits = names
    at = F.pmod(slot, F.lit(_PART_BITS))
    byte = F.ascii(F.decode(F.substring(F.col(bits), F.floor(at / 8).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
    met = df.withColumn(part, F.floor(slot / _PART_BITS).cast("int")).join(F.broadcast(found.toDF(*names)), part)  # 2 MB at most
    return met.where(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1).drop(*names)


@contextlib.contextmanager
def temporaries(spark: SparkSession):
    """What written() makes inside is deleted at the end, but for what it is told to keep; each use stands by itself."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for path in made:
            _delete(spark, path)


def spare(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as tell it from all columns of docs."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_key() -> list[Column]:
    """Two columns that tell rows of a document table apart, also where ids are null or repeated; equal rows stay equal."""
    return [F.coalesce(F.col("doc_id"), F.lit(-(2**62))).alias("k_id"), F.xxhash64(F.col("text")).alias("k_text")]
