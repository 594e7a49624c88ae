"""From raw documents to token ids: quality rules, line dedup, near dedup, mixing, byte-level BPE.

Each stage reads what its predecessor kept, whole. Documents that lose every line to line dedup go, as do all but one of a near-duplicate
group; mixing repeats or leaves out whole documents. Empty documents give empty results at every stage. Operators delete their temporary tables but for
small ones that a result still reads.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cdcflow.llm.byte_bpe import coded_digests
from cdcflow.llm.common import table, written
from cdcflow.llm.line_dedup import dedup_lines
from cdcflow.llm.mixing import mixed
from cdcflow.llm.near_dedup import near_duplicates
from cdcflow.llm.quality_rules import quality_rules

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SIMILAR_PERCENT = 80


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts have no words and go; null ids and repeated rows are judged by their text, each row by itself."""
    judged = quality_rules(docs, table(spark, sf_dir, "labels"), carry=COLUMNS[2:])
    return judged.where("kept").select(*COLUMNS)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that another occurrence stands for; those that lose all their lines go. n_chars follows the text.

    Null texts and texts without a word have no lines to lose and stay; rows equal in id and text are treated alike.
    """
    left = dedup_lines(docs.select(*COLUMNS)).where("n_dropped = 0 or n_dropped < n_lines")
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.select(*COLUMNS[:-1], n_chars.alias("n_chars"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id; documents without an id stay, as do different texts of a kept id.

    Of rows equal in id and text one stays; null texts and texts without a word are in no group and stay.
    """
    kept = near_duplicates(docs, SIMILAR_PERCENT).where("kept and doc_id is not null").select("doc_id").distinct()
    one = F.row_number().over(Window.partitionBy("doc_id", F.md5("text")).orderBy("source", "lang"))  # of rows that repeat an id and its text
    known = docs.select(*COLUMNS).join(kept, "doc_id", "left_semi").withColumn("one", one).where("one = 1").select(*COLUMNS)
    return known.unionByName(docs.select(*COLUMNS).where("doc_id is null"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Null texts have size 0; a null source is a source of its own; equal rows are taken alike."""
    taken = mixed(docs, carry=["text", "lang", "n_chars"]).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids (unsigned 32-bit, little-endian), their number and digest, and the digest of the decoded bytes; a null text is empty."""
    return coded_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, carry=["lang", "source"], keep=["ids"])


STAGES = [
    ("quality_rules", rules_stage),
    ("line_dedup", lines_stage),
    ("minhash_near_dedup", near_stage),
    ("mix_sources", mix_stage),
    ("byte_bpe", bpe_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
