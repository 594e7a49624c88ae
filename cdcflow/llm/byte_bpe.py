"""Byte-level BPE encoding and decoding by the ranks of a tiktoken file.

A text is cut into chunks of CHUNK characters that reach OVERLAP characters into the next one, and each chunk is pre-tokenised by itself. Matches depend
only on what follows a boundary, so from a boundary that a chunk and the next one both have in their overlap, both go on alike: the text is stitched
there. If two chunks never agree (a single pre-token longer than the overlap), the rest of that text is pre-tokenised as one, so ids are
exact for any text. Boundaries at a chunk's end, where more text could change a match, aren't used. The pre-tokens that this gives are the pieces
that are encoded; a process remembers those that it has seen lately.

Texts of up to SPREAD characters have their chunks stitched in the task that reads them. Those above are first cut by the same rule into large
chunks that are dealt to tasks, and the ids of the pieces between their stitches are put together in order.

Decoding joins the raw bytes of the ids.

Defined cases: a null text is empty and has no ids; null and repeated ids are kept row by row; an empty table gives no rows; columns of docs other
than doc_id and text are carried only if named, whatever their names but doc_id and ids.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spare, table, temporaries, written
from .token_files import in_slices

CHUNK, OVERLAP = 2_000, 200
SPREAD, SPREAD_OVERLAP = 1 << 20, 4_096
LOOKAHEAD = 4  # characters at a chunk's end whose matches could still change
REMEMBERED = 200_000  # pre-tokens


def rank_table(vocabulary: str) -> list[bytes]:
    """Bytes of each id."""
    with open(vocabulary, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


def encoding(vocabulary: str, pattern: str):
    import tiktoken

    ranks = {token: i for i, token in enumerate(rank_table(vocabulary)) if token}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def stitched(text: str, pretokens, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[list[str]]:
    """The pre-tokens of a text, chunk by chunk. pretokens: those of a string, which they fill without a gap."""
    found = pretokens(text[: chunk + overlap])
    ends = list(accumulate(map(len, found), initial=0))
    first = 0  # of found, that isn't given yet
    for start in range(chunk, len(text) - overlap, chunk):
        following = pretokens(text[start : start + chunk + overlap])
        following_ends = list(accumulate(map(len, following), initial=start))
        sure = bisect_right(ends, start + overlap - LOOKAHEAD)
        head = set(following_ends[: bisect_left(following_ends, start + overlap)])
        meet = next((i for i in range(bisect_left(ends, start), sure) if ends[i] in head), None)
        if meet is None or meet < first:
            yield pretokens(text[ends[first] :])
            return
        yield found[first:meet]
        first = bisect_left(following_ends, ends[meet])
        found, ends = following, following_ends
    yield found[first:]


class Coder(dict):
    """Ids, as bytes, of pre-tokens; those that it hasn't seen are encoded when they are looked up."""

    def __init__(self, vocabulary: str, pattern: str):
        import regex

        self.encoder = encoding(vocabulary, pattern)
        compiled = regex.compile(pattern)
        self.pretokens = (lambda text: [m[0] for m in compiled.finditer(text)]) if compiled.groups else compiled.findall

    def __missing__(self, token: str) -> bytes:
        ids = self[token] = np.array(self.encoder.encode_ordinary(token), "<u4").tobytes()
        return ids

    def ids(self, text: str, chunk: int, overlap: int) -> bytes:
        """Ids of a text as unsigned 32-bit integers, little-endian."""
        out = []
        for pieces in stitched(text, self.pretokens, chunk, overlap):
            if len(self) > REMEMBERED:
                self.clear()
            out.append(b"".join(map(self.__getitem__, pieces)))
        return b"".join(out)


_coders: dict[tuple[str, str], Coder] = {}


def coder_of(vocabulary: str, pattern: str) -> Coder:
    """This process's coder; what it remembers serves later tasks too."""
    if (vocabulary, pattern) not in _coders:
        _coders[vocabulary, pattern] = Coder(vocabulary, pattern)
    return _coders[vocabulary, pattern]


def _encode(vocabulary: str, pattern: str, chunk: int, overlap: int):
    """Replaces the last column, a text, by ids (unsigned 32-bit integers, little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(vocabulary, pattern)
        for batch in batches:
            columns, names = batch.columns, batch.schema.names
            for start, texts in in_slices(columns[-1].to_pylist(), 4_000_000):
                ids = [coder.ids(t, chunk, overlap) for t in texts]
                yield pa.RecordBatch.from_arrays([*(c.slice(start, len(ids)) for c in columns[:-1]), pa.array(ids, pa.binary())], names=[*names[:-1], "ids"])

    return run


def boundaries(text: str, pretokens, whole: bool) -> np.ndarray:
    """Starts and ends of the pre-tokens of a chunk that later text can't change; of all if the chunk ends the text."""
    ends = np.array(list(accumulate(map(len, pretokens(text)), initial=0)))
    return ends if whole else ends[ends <= len(text) - LOOKAHEAD]


def _pretokenise(vocabulary: str, pattern: str, chunk: int, overlap: int):
    """uid, n, text, whole -> uid, n, head and tail: boundaries, as places in the text, in the first overlap and in the one with the next chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pretokens = coder_of(vocabulary, pattern).pretokens
        for batch in batches:
            heads, tails = [], []
            for n, text, whole in zip(*(batch.column(c).to_pylist() for c in ("n", "text", "whole"))):
                found = boundaries(text, pretokens, whole)
                heads.append(found[found < overlap] + n * chunk)
                tails.append(found[(found >= chunk) & (found < chunk + overlap)] + n * chunk)
            arrays = [batch.column("uid"), batch.column("n"), *(pa.array([x.tolist() for x in y], pa.list_(pa.int64())) for y in (heads, tails))]
            yield pa.RecordBatch.from_arrays(arrays, names=["uid", "n", "head", "tail"])

    return run


def pieces_of(long: DataFrame, vocabulary: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """uid, text -> uid, piece, text: the texts cut where chunks resynchronise."""
    size = F.length("text")
    chunks = long.select("uid", "text", F.explode(F.sequence(F.lit(0), F.floor((size - 1) / chunk).cast("int"))).alias("n"))
    chunks = chunks.select("uid", "n", F.substring(F.col("text"), F.col("n") * chunk + 1, F.lit(chunk + overlap)).alias("text"), (size <= F.col("n") * chunk + chunk + overlap).alias("whole"))
    found = chunks.repartition("uid", "n").mapInArrow(_pretokenise(vocabulary, pattern, chunk, overlap), "uid long, n int, head array<long>, tail array<long>")
    following = F.lead("head").over(Window.partitionBy("uid").orderBy("n"))
    meets = found.select("uid", "n", F.array_min(F.array_intersect("tail", following)).alias("cut"), following.isNull().alias("last")).where("not last")
    # a cut counts only while all before it in its text were found
    broken = F.min(F.when(F.col("cut").isNull(), F.col("n"))).over(Window.partitionBy("uid"))
    cuts = meets.withColumn("broken", broken).where("broken is null or n < broken").groupBy("uid").agg(F.sort_array(F.collect_list("cut")).alias("cuts"))
    parts = long.join(cuts, "uid", "left")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.coalesce("cuts", F.array().cast("array<long>")))
    parts = parts.select("uid", "text", F.posexplode(F.arrays_zip(starts.alias("s"), F.concat(F.coalesce("cuts", F.array().cast("array<long>")), F.array(size.cast("long"))).alias("e"))))
    return parts.select("uid", F.col("pos").alias("piece"), F.substring(F.col("text"), (F.col("col.s") + 1).cast("int"), (F.col("col.e") - F.col("col.s")).cast("int")).alias("text"))


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def bpe_encode(docs: DataFrame, vocabulary: str, pattern: str, carry: list[str] = [], chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD, spread_overlap: int = SPREAD_OVERLAP) -> DataFrame:
    """doc_id, the columns in carry and ids for every row of docs."""
    coded, (text, uid) = _encode(vocabulary, pattern, chunk, overlap), spare(docs, "text_", "uid")
    rows = docs.select("doc_id", *carry, F.coalesce("text", F.lit("")).alias(text))
    short = rows.where(F.length(text) <= spread).mapInArrow(coded, _schema(rows.drop(text)) + ", ids binary")
    with temporaries(docs.sparkSession):
        long = written(rows.where(F.length(text) > spread).withColumn(uid, F.monotonically_increasing_id()), "long", keep=True)
        if long.isEmpty():
            return short
        pieces = pieces_of(long.select(F.col(uid).alias("uid"), F.col(text).alias("text")), vocabulary, pattern, spread, spread_overlap)
        made = written(pieces.repartition("uid", "piece").mapInArrow(coded, "uid long, piece int, ids binary"), "pieces", keep=True)
    in_order = F.sort_array(F.collect_list(F.struct("piece", F.hex("ids").alias("ids"))))
    joined = made.groupBy(F.col("uid").alias(uid)).agg(F.unhex(F.array_join(F.transform(in_order, lambda p: p["ids"]), "")).alias("ids"))
    return short.unionByName(long.drop(text).join(joined, uid).drop(uid))


def _decode(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = rank_table(vocabulary)
        for batch in batches:
            names = batch.schema.names
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                raw = [b"".join(map(tokens.__getitem__, np.frombuffer(i, "<u4").tolist())) for i in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], names=[*names, "decoded"])

    return run


def bpe_decode(coded: DataFrame, vocabulary: str) -> DataFrame:
    """coded (with a column ids) and decoded: the bytes of the ids."""
    return coded.mapInArrow(_decode(vocabulary), _schema(coded) + ", decoded binary")


def coded_digests(docs: DataFrame, vocabulary: str, pattern: str, carry: list[str] = [], keep: list[str] = []) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, carry and what keep names of ids and decoded, for every row of docs."""
    both = bpe_decode(bpe_encode(docs, vocabulary, pattern, carry), vocabulary)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *carry, *keep)


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return coded_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
