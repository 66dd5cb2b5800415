"""Token-id files: independent zstandard frames, checksums, and a trailing seek table.

A shard holds the documents of one contiguous range of ids, in order. Layout::

    frame ... frame | document table (a skippable frame) | seek table (a skippable frame)

A frame's content is the ids of whole documents, little-endian, 2 bytes wide
where every id of the shard fits and else 4. The document table lists
(doc_id or none, ids, frame) for each document. The seek table follows the
zstandard seekable format: for each frame its compressed and content size and
the low 32 bits of the content's xxHash64; then the number of frames, a
descriptor and a magic number. A reader opens the file at its end, finds the
frames that hold the documents asked for, and decompresses only those.

Defined results: a null text is empty and has only the end id; a null id comes
first; rows of one id keep an order by their text. Any 64-bit ids will do; a
text of any length is a frame by itself. Extra columns go, whatever their names.
An empty table writes no file and gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.llm.common import Cells, filesystem, id_and_text, lean, scratch, write_file
from meshloom.llm.word_columns import blocks, column_ids
from meshloom.llm.word_tokens import default_vocabulary

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Ids after which a frame ends with the document.
FRAME_IDS = 1 << 16
_DOC, _FRAME = np.dtype([("id", "<i8"), ("null", "<u1"), ("ids", "<u8"), ("frame", "<u4")]), np.dtype([("packed", "<u4"), ("content", "<u4"), ("sum", "<u4")])


def encode_shard(docs: Iterable[tuple[int | None, bytes]], frame_ids: int = FRAME_IDS, level: int = 3) -> Iterator[bytes]:
    """The file's bytes for (doc_id, packed 32-bit ids) in order; a frame is held at a time."""
    table: list[tuple] = []
    frames: list[tuple] = []
    held: list[bytes] = []
    size = 0
    press = zstandard.ZstdCompressor(level=level, write_checksum=True)

    def frame() -> bytes:
        content = b"".join(held)
        ids = np.frombuffer(content, dtype="<u4")
        narrow = not len(ids) or int(ids.max()) < 1 << 16
        content = bytes([2 if narrow else 4]) + (ids.astype("<u2").tobytes() if narrow else content)
        packed = press.compress(content)
        frames.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        held.clear()
        return packed

    for i, ids in docs:
        table.append((i or 0, i is None, len(ids) // 4, len(frames)))
        held.append(ids)
        size += len(ids)
        if size >= 4 * frame_ids:
            yield frame()
            size = 0
    if held:
        yield frame()
    rows = press.compress(np.array(table, dtype=_DOC).tobytes())
    yield struct.pack("<III", SKIPPABLE, len(rows) + 4, len(table)) + rows
    seek = np.array([*frames, (len(rows) + 12, 0, 0)], dtype=_FRAME).tobytes()
    yield struct.pack("<II", SKIPPABLE, len(seek) + 9) + seek + struct.pack("<IBI", len(frames) + 1, 0x80, SEEKABLE)


class ShardReader:
    """Documents of one file; frames are read, checked and decompressed as they are asked for."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        n, kind, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE or kind != 0x80:
            raise ValueError(f"{uri} has no seek table")
        self.frames = np.frombuffer(self._at(end - 9 - 12 * n, 12 * n), dtype=_FRAME)
        self.starts = np.concatenate([[0], np.cumsum(self.frames["packed"].astype(np.int64))])
        rows = self._at(int(self.starts[n - 1]), int(self.frames["packed"][-1]))[12:]
        self.docs = np.frombuffer(zstandard.ZstdDecompressor().decompress(rows), dtype=_DOC)
        self.offsets = np.cumsum(self.docs["ids"]) - self.docs["ids"]
        self.held: tuple[int, np.ndarray] = (-1, np.empty(0, "<u4"))

    def _at(self, start: int, n: int) -> bytes:
        return self.file.read_at(n, start)

    def frame(self, k: int) -> np.ndarray:
        if self.held[0] != k:
            content = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[k]), int(self.frames["packed"][k])))
            if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != int(self.frames["sum"][k]):
                raise ValueError(f"frame {k} is damaged")
            self.held = (k, np.frombuffer(content, dtype=f"<u{content[0]}", offset=1).astype("<u4"))
        return self.held[1]

    def document(self, row: int) -> np.ndarray:
        """The ids of the document in a row of the document table."""
        k = int(self.docs["frame"][row])
        first = int(np.searchsorted(self.docs["frame"], k))
        at = int(self.offsets[row] - self.offsets[first])
        return self.frame(k)[at : at + int(self.docs["ids"][row])]

    def rows_of(self, doc_id: int) -> np.ndarray:
        return np.flatnonzero((self.docs["id"] == doc_id) & (self.docs["null"] == 0))

    def __iter__(self):
        for row in range(len(self.docs)):
            yield (None if self.docs["null"][row] else int(self.docs["id"][row])), self.document(row)


def _write(folder: str, vocabulary: str, end_id: int, frame_ids: int):
    def run(batches):
        end = end_id.to_bytes(4, "little")
        cells = _runs(batches, column_ids(vocabulary).encode)
        out: list[tuple] = []
        for cell, docs in cells:
            count = [0, 0]

            def encoded(docs=docs, count=count):
                for i, ids in docs:
                    ids += end
                    count[0] += 1
                    count[1] += len(ids) // 4
                    yield i, ids

            path = f"{folder}/cell-{cell:010d}.ids.zst"
            write_file(path, encode_shard(encoded(), frame_ids))
            out.append((cell, path, *count))
        names = ["cell", "path", "docs", "ids"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=names)

    return run


def _runs(batches, encode):
    """(cell, its rows with their ids) for batches of (cell, id, text) in order of the cell; rows are read as they are used."""
    rows = ((c, i, ids) for b in blocks(batches, 2) for c, i, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), encode(b.column(2)), strict=True))
    held = next(rows, None)

    def own(cell):
        nonlocal held
        while held is not None and held[0] == cell:
            yield held[1:]
            held = next(rows, None)

    while held is not None:
        cell = held[0]
        part = own(cell)
        yield cell, part
        for _ in part:  # what the caller has left
            pass


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, vocabulary: str | None = None, frame_ids: int = FRAME_IDS) -> list[tuple[int, str, int, int]]:
    """Write the shards; returns their manifest (cell, path, documents, ids) in order of the ids.

    The manifest has a row for each file; their number follows the bytes, up
    to a bound.
    """
    cells = Cells(docs, id_col, text_col)
    rows = id_and_text(docs, id_col, text_col)
    dealt = rows.select(F.shiftright(cells.of(F.col("id")), 1).alias("cell"), "id", "text").repartition(len(cells), "cell").sortWithinPartitions("cell", "id", "text")
    made = dealt.mapInArrow(lean(_write(folder, vocabulary or default_vocabulary(), end_id, frame_ids)), "cell long, path string, docs long, ids long")
    return sorted(tuple(r) for r in made.collect())


def read_token_files(spark, manifest) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    before, rows = 0, []
    for _, path, _, ids in manifest:
        rows.append((path, before))
        before += ids

    def run(batches):
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader, at = ShardReader(path), base
                out: list[list] = [[], [], [], []]
                for i, ids in reader:
                    for c, v in zip(out, (i, at, len(ids), zlib.crc32(ids.tobytes())), strict=True):
                        c.append(v)
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(rows, "path string, base long")
    return files.repartition(max(1, len(rows)), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, vocabulary: str | None = None, folder: str | None = None) -> DataFrame:
    """Write the files and read them back."""
    spark = docs.sparkSession
    return read_token_files(spark, write_token_files(docs, folder or scratch(spark, "token-files"), id_col, text_col, end_id, vocabulary))
