"""Statistics of whole texts as Spark SQL expressions; op2 and op6 build on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, fenced, let, words

WINDOW = 8


def _after(items: Column, i: Column, step: int) -> Column:
    return F.get(items, i + F.lit(step))


def _doubled(hashes: Column, step: int) -> Column:
    return F.transform(hashes, lambda x, i: F.xxhash64(x, _after(hashes, i, step)))


def _covered(hashes: Column) -> Column:
    """How many words lie in a window whose hash occurs twice or more; hashes: of the windows, by start."""
    in_order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    starts = let(
        in_order,
        lambda s: F.sort_array(
            F.transform(
                F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (_after(s, j, 1)["h"] == x["h"])),
                lambda x: x["i"],
            )
        ),
    )
    gaps = let(starts, lambda p: F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(_after(p, j, 1) - x, F.lit(WINDOW)))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)


def with_base_stats(docs: DataFrame) -> DataFrame:
    """Add w (words), w_hash and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words to docs; a null text counts as empty.

    Windows of eight words are compared by a 64-bit hash that three doublings build from the words' hashes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    df = docs.withColumn("w", words(text))
    df = df.withColumn("w_hash", F.transform("w", lambda x: F.xxhash64(x)))
    for step, have, made in ((1, "w_hash", "_p2"), (2, "_p2", "_p4"), (4, "_p4", "_p8")):
        df = df.withColumn(made, _doubled(F.col(have), step))
    df = df.withColumn("n_words", F.size("w").cast("long"))
    df = df.withColumn("_win", F.slice("_p8", F.lit(1), F.greatest(F.col("n_words").cast("int") - (WINDOW - 1), F.lit(0))))
    df = df.withColumn("_lines", lines)
    return fenced(
        df,
        *[F.col(c) for c in docs.columns],
        F.col("w"),
        F.col("w_hash"),
        F.col("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_win")) < F.size("_win"), _covered(F.col("_win"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


#: Names of the statistics that with_base_stats() adds.
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Names of the ratios that with_ratios() adds.
RATIOS = ["mean_word", "symbols", "dup_lines", "repeats", "distinct", "upper", "marks", "digits", "stops"]


def with_ratios(stats: DataFrame) -> DataFrame:
    """Add the ratios that the quality models learn from (doubles, never null) and drop the word arrays."""
    text = F.coalesce(F.col("text"), F.lit(""))
    per_word = F.greatest(F.col("n_words"), F.lit(1))

    def only(chars: str) -> Column:
        return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))

    return fenced(
        stats,
        *[F.col(c) for c in stats.columns if c not in ("w", "w_hash")],
        (F.col("word_chars") / per_word).alias("mean_word"),
        (F.col("n_symbols") / per_word).alias("symbols"),
        (F.col("n_dup_lines") / (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)).alias("dup_lines"),
        (F.col("n_repeat_words") / per_word).alias("repeats"),
        (F.size(F.array_distinct("w_hash")) / per_word).alias("distinct"),
        (only(r"\p{Lu}") / F.greatest(F.col("word_chars"), F.lit(1))).alias("upper"),
        (only("!?") / per_word).alias("marks"),
        (only("0-9") / per_word).alias("digits"),
        (only(".,;:") / per_word).alias("stops"),
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, where: Column | None = None) -> DataFrame:
    """At most max_rows rows of docs that carry a label, as k_label: those whose id hashes lowest. Ids labelled twice take the smaller label, and of rows that share an id one counts, that of the smallest text."""
    chosen = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("k_label")).where("doc_id is not null and k_label is not null")
    if where is not None:
        chosen = chosen.where(where)
    chosen = chosen.groupBy("doc_id").agg(F.min("k_label").alias("k_label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # max_rows bounds what is broadcast
    return met.groupBy("doc_id", "k_label").agg(F.min("text").alias("text")).select("doc_id", "text", "k_label")
