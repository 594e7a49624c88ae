"""Token-ID output: documents are encoded with a tokenizers vocabulary and written, in ascending order of id, to seekable files.

Ids are dealt by range, so each partition writes one file, file by file in order. A file goes to the shared folder under a name of
its own for each attempt; only the files that the manifest (one row a file) names count, so a task that runs again leaves no harm.
Reading starts from the manifest: a file's offset is the sum of the ids before it, and each task reads its files' frames.

If the vocabulary's file says that it lower-cases, splits at white space and lets nothing reach across (splits_at_space), a text's ids are those of its
white-space-separated pieces in order, and each process encodes a piece that it has seen lately only once; else whole texts are encoded.

Defined cases: a null text is empty and gets the end id alone; null ids come first; rows with equal ids are ordered by a hash of their text and each
keep their place; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import itertools
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, table, written
from .seekable import Reader, Writer

END_ID = 1
MAX_PIECES = 1_000_000  # remembered at a time


#: The normaliser and the splits of vocabularies that can be encoded piece by piece.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def splits_at_space(vocabulary: str) -> bool:
    """Does the file describe a vocabulary whose ids of a text are those of its white-space-separated, lower-cased pieces?"""
    with open(vocabulary, encoding="utf-8") as f:
        j = json.load(f)
    own = [t for t in j["added_tokens"] if not t["special"]]
    return j["normalizer"] == NORMALIZER and j["pre_tokenizer"] == PRE_TOKENIZER and j["model"]["type"] == "BPE" and not j["model"].get("dropout") and not own


class PieceEncoder:
    """Encodes texts piece by piece and remembers pieces.

    A piece of ASCII letters and then other ASCII signs is at most two pre-tokens that nothing normalises further, so the model
    itself tokenises them; any other piece goes through the whole tokenizer.
    """

    PLAIN = re.compile(rb"([a-z]*)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        self.by_piece = splits_at_space(vocabulary)
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _made(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of pieces that aren't remembered."""
        tokenize, parts = self.tokenizer.model.tokenize, {}
        out, others = [], []
        for piece in pieces:
            if not (m := self.PLAIN.fullmatch(piece)):
                others.append(len(out))
                out.append(piece.decode())
                continue
            ids = []
            for part in m.groups():
                if part:
                    if (made := parts.get(part)) is None:
                        at = self.place.get(part, -1)
                        if 0 <= at < len(self.sizes):
                            made = self.ids[self.starts[at] : self.starts[at] + self.sizes[at]].tolist()
                        else:
                            made = [t.id for t in tokenize(part.decode())]
                        parts[part] = made
                    ids += made
            out.append(ids)
        for at, e in zip(others, self.tokenizer.encode_batch([out[i] for i in others], add_special_tokens=False)):
            out[at] = e.ids
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if not self.by_piece:
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        if len(self.place) > MAX_PIECES:
            self.forget()
        place, known = self.place, len(self.place)
        split = [text.encode().lower().split() for text in texts]  # at ASCII white space; A-Z are lower-cased, as the normaliser would
        fresh = [p for p in dict.fromkeys(itertools.chain.from_iterable(split)) if p not in place]
        if fresh:
            made = self._made(fresh)
            place.update(zip(fresh, range(known, known + len(fresh))))
            sizes = np.fromiter(map(len, made), np.int64, len(made))
            starts = len(self.ids) + np.cumsum(sizes) - sizes
            self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(made), np.uint32, int(sizes.sum()))])
            self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])
        counts = np.fromiter(map(len, split), np.int64, len(split))
        rows = np.fromiter(map(place.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(counts.sum()))
        sizes = self.sizes[rows]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.ids[np.repeat(self.starts[rows] - ends[:-1], sizes) + np.arange(ends[-1])]
        return np.split(flat, ends[np.cumsum(counts)][:-1])


_encoders: dict[str, PieceEncoder] = {}


def encoder_of(vocabulary: str) -> PieceEncoder:
    """This process's encoder; what it remembers serves later tasks too."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = PieceEncoder(vocabulary)
    return _encoders[vocabulary]


def in_slices(column: list, most: int = 1_000_000) -> Iterator[tuple[int, list[str]]]:
    """Slices of a batch's texts of some characters each, with the first row's number."""
    start = size = 0
    for i, text in enumerate(column):
        size += len(text or "")
        if size > most:
            yield start, [t or "" for t in column[start : i + 1]]
            start, size = i + 1, 0
    if start < len(column):
        yield start, [t or "" for t in column[start:]]


def _write_partition(folder: str, vocabulary: str, width: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part = TaskContext.get().partitionId()
        uri = f"{folder}/{part:06d}-{uuid.uuid4().hex}.zst"
        writer, encoder, n = None, None, 0
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            if texts and writer is None:
                writer, encoder = Writer(uri, width), encoder_of(vocabulary)
            for start, some in in_slices(texts):
                for i, tokens in enumerate(encoder.encode(some)):
                    writer.add(ids[start + i], np.append(tokens, END_ID))
                    n += len(tokens) + 1
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [uri], "n_docs": [len(writer.ids)], "n_ids": [n]})

    return write


def vocabulary_width(vocabulary: str) -> int:
    """Bytes that an id takes: 2 or 4."""
    with open(vocabulary, encoding="utf-8") as f:
        j = json.load(f)
    return 2 if max([0, *j["model"]["vocab"].values(), *[t["id"] for t in j["added_tokens"]]]) < 2**16 else 4


def write_token_files(docs: DataFrame, vocabulary: str, folder: str | None = None) -> DataFrame:
    """Write docs (doc_id, text) to token files; returns the manifest: part, path, n_docs, n_ids, first (ids before the file)."""
    folder = folder or shared_dir(docs.sparkSession, "tokens")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")
    made = rows.select("doc_id", "text").mapInArrow(_write_partition(folder, vocabulary, vocabulary_width(vocabulary)), "part long, path string, n_docs long, n_ids long")
    manifest = written(made, "manifest")  # one row a file; the window below reads no more
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.withColumn("first", F.coalesce(before, F.lit(0)))


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist()):
            reader = Reader(path)
            for start in range(0, reader.n, 1000):
                out = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                for i in range(start, min(start + 1000, reader.n)):
                    ids = reader.tokens(i)
                    out["doc_id"].append(None if reader.nulls[i] else int(reader.ids[i]))
                    out["start"].append(first)
                    out["n_tokens"].append(len(ids))
                    out["ids_crc32"].append(zlib.crc32(ids.tobytes()))
                    first += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], names=list(out))
            reader.close()


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files that a manifest names."""
    n = max(1, manifest.count())
    return manifest.select("part", "path", "first").repartition(n, "part").mapInArrow(_read_files, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_output(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return read_token_files(write_token_files(docs, public_tokenizers.path("word_bpe_49k.json")))
