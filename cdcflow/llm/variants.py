"""Groups spelling variants: words one edit apart, found by one-edit neighbourhoods over a reduced alphabet.

Letters are hashed to a few symbols, so that a word becomes a reduced word. Two words one edit apart have reduced words that are equal or one edit apart,
and over a few symbols the full one-edit neighbourhood of a reduced word is short. Each distinct reduced word generates its neighbourhood (as 64-bit
hashes, in numpy), the neighbourhoods join the reduced vocabulary, and the words behind both ends are compared as they are, by code point. Hashes only
propose pairs: equal hashes of different reduced words cost a comparison and can't lose or make a link.

Defined cases: a null text has no words, a null doc_id counts as empty text; repeated rows count again; ties of the largest n go to the smallest word in code-point
order; a word without near words has n_near 0 and is its own root; no words give no rows; other columns aren't read. Texts of any length are cut into
segments that end outside words, so memory goes with a segment.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, key_filter, maybe_in, table, temporaries, written

#: What a word consists of, and the share of occurrences that lose a code point.
RUN = r"[A-Za-zÀ-ÿ]+"
ONE_IN = 97
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SYMBOLS = 8
SEGMENT = 65_536
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so powers of it stay apart


def lower_ascii(word: Column) -> Column:
    """word with A-Z in lower case and all else as it is."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def word_counts(docs: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """word, n: the words of docs (doc_id, text) of some length and number of occurrences.

    A word is a run of letters with A-Z in lower case; where ONE_IN divides the crc32 of `<doc_id>:<word>`, the code point at crc32 % length is taken out.
    """
    cut = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{SEGMENT}}}{RUN[:-1]}*+"), F.lit(0))
    segments = docs.select("doc_id", F.explode(F.when(F.length("text") > 16 * SEGMENT, cut).otherwise(F.array("text"))).alias("segment"))
    runs = segments.select("doc_id", F.explode(F.regexp_extract_all("segment", F.lit(RUN), F.lit(0))).alias("run")).where(F.length("run") >= least_length)
    runs = runs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), lower_ascii(F.col("run")).alias("w"))
    runs = runs.select("w", F.crc32(F.concat("id", F.lit(":"), "w").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("w")).cast("int")
    left = F.when(F.col("h") % ONE_IN == 0, F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w")))).otherwise(F.col("w"))
    counts = runs.select(left.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least_count)


def symbol_of(k: int) -> str:
    """The symbol of each of LETTERS: characters 1 to k, by a hash of the letter."""
    return "".join(chr(1 + zlib.crc32(c.encode()) % k) for c in LETTERS)


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, BASE)]))


def _hashes(symbols: np.ndarray) -> np.ndarray:
    """Of the first i symbols, for i from 0 to all: one row a word, modulo 2^64."""
    out = np.zeros((len(symbols), symbols.shape[1] + 1), np.uint64)
    for i in range(symbols.shape[1]):
        out[:, i + 1] = out[:, i] * BASE + symbols[:, i]
    return out


def neighbourhood(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the reduced words themselves (first) and of all that are one edit away: one row a word, all of one length."""
    n = symbols.shape[1]
    power, head = _powers(n + 1), _hashes(symbols)
    tail = head[:, -1:] - head * power[n - np.arange(n + 1)]  # of the symbols from i on
    signs = np.arange(1, k + 1, dtype=np.uint64)
    gone = head[:, :n] * power[n - 1 - np.arange(n)] + tail[:, 1:]
    stem = head[:, :n] * power[n - np.arange(n)] + tail[:, 1:]
    swapped = stem[:, :, None] + power[n - 1 - np.arange(n)][None, :, None] * signs
    stem = head * power[n + 1 - np.arange(n + 1)] + tail
    put = stem[:, :, None] + power[n - np.arange(n + 1)][None, :, None] * signs
    return np.concatenate([head[:, -1:], gone, swapped.reshape(len(symbols), -1), put.reshape(len(symbols), -1)], axis=1)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the words of each length, and their symbols as a matrix."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, np.frombuffer("".join(words[i] for i in at).encode(), np.uint8).reshape(len(at), n).astype(np.uint64)


def _hash_of(reduced: str) -> np.uint64:
    return _hashes(next(_by_length([reduced]))[1])[0, -1]


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = np.zeros(batch.num_rows, np.uint64)
        for at, symbols in _by_length(batch.column("reduced").to_pylist()):
            keys[at] = _hashes(symbols)[:, -1]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("word", "n", "reduced")), pa.array(keys.view(np.int64))], names=["word", "n", "reduced", "key"])


def _generated(k: int, cells: int = 1 << 20):
    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = batch.column("reduced").to_pylist()
            for some in (f for f in forms if len(f) > 1):
                near = np.unique(np.concatenate([neighbourhood(symbols, k).ravel() for _, symbols in _by_length(some)]).view(np.int64))
                own = np.full(len(near), _hash_of(some[0]).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(own[near >= own]), pa.array(near[near >= own])], names=["key", "near"])
            for at, symbols in _by_length([f[0] for f in forms if len(f) == 1]):
                width = 1 + symbols.shape[1] * (k + 1) + (symbols.shape[1] + 1) * k
                step = max(1, cells // width)
                for start in range(0, len(at), step):
                    near = neighbourhood(symbols[start : start + step], k).view(np.int64)
                    own = np.repeat(near[:, :1], near.shape[1], axis=1)
                    ordered = np.sort(np.where(near >= own, near, own), axis=1)  # the other half is found from its other end; own words are there anyway
                    first = np.ones(ordered.shape, bool)
                    first[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
                    yield pa.RecordBatch.from_arrays([pa.array(own[first]), pa.array(ordered[first])], names=["key", "near"])

    return generate


def near_words(vocabulary: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """a, a_n, b, b_n: every pair of words of vocabulary (word, n; words are distinct) that differ by one code point, once. More symbols mean longer neighbourhoods and fewer pairs to compare."""
    reduced = vocabulary.select("word", "n", F.translate("word", LETTERS, symbol_of(symbols)).alias("reduced"))
    keyed = written(reduced.mapInArrow(_keyed, "word string, n long, reduced string, key long"), "keyed")
    forms = keyed.groupBy("key").agg(F.collect_set("reduced").alias("reduced"))  # one, or as many as share a 64-bit hash
    edges = forms.select("reduced").mapInArrow(_generated(symbols), "key long, near long")
    edges = maybe_in(edges, "near", key_filter(keyed, "key"))
    a = keyed.select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = keyed.select(F.col("key").alias("near"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    pairs = edges.join(b, "near").join(a, "key").where("key <> near or a < b")
    close = (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
    return pairs.where(close).select("a", "a_n", "b", "b_n")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms (word, form) that starts at each word. Steps double, so the rounds grow with the logarithm of the longest chain."""
    chain = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = chain.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = written(chain.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        drop_written(chain)
        chain = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return chain


def spelling_variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, factor: int = 2, symbols: int = SYMBOLS) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of docs. form is the near word of largest n, if that is factor times the word's n or more."""
    if factor < 2:
        raise ValueError("factor must be 2 or more, so that forms lead to an end")
    with temporaries(docs.sparkSession):
        vocabulary = written(word_counts(docs, least_length, least_count), "vocabulary", keep=True)
        ends = F.array(*[F.struct(F.col(x).alias("word"), F.col(f"{x}_n").alias("n"), F.col(y).alias("near"), F.col(f"{y}_n").alias("near_n")) for x, y in ("ab", "ba")])
        best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
        found = near_words(vocabulary, symbols).select(F.inline(ends)).groupBy("word").agg(F.count("*").alias("n_near"), best, F.first("n").alias("n"))
        form = F.when(-F.col("best.less") >= factor * F.col("n"), F.col("best.near"))
        found = written(found.select("word", "n_near", form.alias("form"), F.when(form.isNotNull(), -F.col("best.less")).alias("form_n")), "found", keep=True)
        ends = written(roots(found.where("form is not null")), "ends", keep=True)
    out = vocabulary.join(found, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP12_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(CAST(b AS BIGINT), CAST(range(8) AS BIGINT[])),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) GROUP BY ALL
), bytes AS (
  SELECT w, times, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS b
  FROM runs WHERE length(w) >= 5
), hashed AS (
  SELECT w, times, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS h FROM bytes, crc_table
), words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, times FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3
), holes AS (
  SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM holes a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM holes a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, n, count(*) AS n_near, max(near_n) AS most, min(near) FILTER (near_n = top) AS near
  FROM (SELECT *, max(near_n) OVER (PARTITION BY word) AS top FROM pairs) GROUP BY word, n
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.most >= 2 * w.n THEN b.near END AS form, CASE WHEN b.most >= 2 * w.n THEN b.most END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), chain AS (
  SELECT word, word AS root FROM forms WHERE form IS NULL
  UNION ALL SELECT f.word, c.root FROM forms f JOIN chain c ON f.form = c.word
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON f.word = c.word
"""
