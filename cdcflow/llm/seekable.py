"""Files of independent zstandard frames: one frame a document, then an index frame, then the trailing seek table.

Layout (little-endian):
  frames       one zstandard frame for each document, with its content checksum; inside, the ids as unsigned integers of `width` bytes
  index frame  a skippable frame with: width, number of documents, their ids (int64), and a byte for each that is 1 where the id is null
  seek table   a skippable frame with an entry (compressed size, size, low half of xxh64 of the content) for each frame, the index last, and
               a footer (number of entries, descriptor, magic number), as the public seekable format has it
A reader takes the last bytes first and then only the frames of the documents that it wants.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow.fs as pafs
import xxhash
import zstandard

#: Fixed values of the zstandard formats.
INDEX_MAGIC = 0x184D2A50
TABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class Writer:
    """Writes one file; nothing but the sizes and ids of its documents stays in memory."""

    def __init__(self, uri: str, width: int, level: int = 3):
        fs, path = opened(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.file, self.width = fs.open_output_stream(path, compression=None), width
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = ids.astype(f"<u{self.width}").tobytes()
        frame = self.zstd.compress(raw)
        self.file.write(frame)
        self.entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.ids.append(doc_id)

    def close(self) -> None:
        nulls = np.array([i is None for i in self.ids], dtype=np.uint8)
        ids = np.array([i or 0 for i in self.ids], dtype="<i8")
        body = struct.pack("<IQ", self.width, len(ids)) + ids.tobytes() + nulls.tobytes()
        self.file.write(struct.pack("<II", INDEX_MAGIC, len(body)) + body)
        self.entries.append((len(body) + 8, 0, 0))
        table = np.array(self.entries, dtype="<u4").tobytes() + struct.pack("<IBI", len(self.entries), HAS_CHECKSUMS, SEEKABLE_MAGIC)
        self.file.write(struct.pack("<II", TABLE_MAGIC, len(table)) + table)
        self.file.close()


class Reader:
    """Reads the ids of single documents, by position or id."""

    def __init__(self, uri: str):
        fs, path = opened(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or flags != HAS_CHECKSUMS:
            raise ValueError(f"{uri} has no seek table")
        self.entries = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), dtype="<u4").reshape(n, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.entries[:, 0])])
        index = self._at(int(self.starts[n - 1]) + 8, int(self.entries[n - 1, 0]) - 8)
        self.width, self.n = struct.unpack_from("<IQ", index)
        self.ids = np.frombuffer(index, "<i8", self.n, 12)
        self.nulls = np.frombuffer(index, "u1", self.n, 12 + 8 * self.n)
        self.zstd = zstandard.ZstdDecompressor()

    def _at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def tokens(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the file, its frame's checksum verified."""
        packed, size, checksum = self.entries[i]
        raw = self.zstd.decompress(self._at(int(self.starts[i]), int(packed)), max_output_size=int(size)) if size else b""
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
            raise ValueError(f"document {i} fails its checksum")
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")

    def find(self, doc_id: int) -> list[int]:
        """Positions of a document id; the ids of a file ascend."""
        return [int(i) for i in np.flatnonzero((self.ids == doc_id) & (self.nulls == 0))]

    def close(self) -> None:
        self.file.close()
