"""Exact deduplication over an extendible-hash index on shared files.

Texts are equal when their bytes are, after white space is deleted. Each scan
task collapses the copies that it meets, so that of a text with many copies
each task sends few. The top bits of a 64-bit key give the owner, more of them
the more rows there are; its key range is dealt to one task; it merges each of its rows into its extendible-hash
index: a directory over the key's leading bits that doubles when an overfull
bucket of full depth splits. ``merge`` goes through the chain of the row's key,
compares bytes, and adds to the entry of an equal text or chains a new one. Rows
come in order of the key, so only the texts of the key in hand are held. The
owner writes its index to the shared folder, from which
``ExtendibleIndex.load`` opens it.

Defined results: a null text is empty, and empty texts are one group. Of
repeated rows that tie for the place, one stays. A null id ranks after all
others. Long texts and extra columns make no difference; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshloom.llm.common import SPACES, filesystem, id_and_text, scratch, write_file

#: Texts that an owner's index has on the average at most, and the least bits of the key that name an owner.
OWNER_TEXTS, OWNER_BITS = 50_000, 10
#: Bytes of texts that a scan task remembers to collapse its copies.
LOCAL_BYTES = 24 << 20
#: A group's row is copied to this many salts, so that a large group's members meet it in many tasks.
SALTS = 16

PARTIAL = "owner int, key long, sha string, norm binary, best_n long, best_id long, copies long"
GROUP = "key long, sha string, keep_id long, keep_n long, group_size long"


class ExtendibleIndex:
    """Extendible hashing of 64-bit keys to entries; ``depth`` leading bits pick the directory slot."""

    def __init__(self, capacity: int = 64, skip: int = 0):
        self.capacity, self.skip, self.depth = capacity, skip, 0
        self.directory: list[int] = [0]
        self.buckets: list[tuple[int, dict[int, list]]] = [(0, {})]  # local depth, key -> chain
        self.texts: tuple[int | None, list[bytes]] = (None, [])  # the key that was merged last, and the texts of its chain

    def _slot(self, key: int, depth: int) -> int:
        return ((key << self.skip) & 0xFFFFFFFFFFFFFFFF) >> (64 - depth) if depth else 0

    def chain(self, key: int) -> list:
        return self.buckets[self.directory[self._slot(key, self.depth)]][1].get(key, [])

    def insert(self, key: int, entry) -> None:
        b = self.directory[self._slot(key, self.depth)]
        held = self.buckets[b][1]
        held.setdefault(key, []).append(entry)
        while len(held) > self.capacity:
            b = self._split(b, key)
            held = self.buckets[b][1]

    def merge(self, key: int, text: bytes, entry: tuple) -> None:
        """Add (best length, best id, copies, digest) to the entry of an equal text, or chain it; a key's rows come on end."""
        last, texts = self.texts
        if last != key:
            assert not self.chain(key), "the rows of a key come on end"
            self.texts = last, texts = key, []
        chain = self.chain(key)
        for k, own in enumerate(texts):
            if own == text:
                n, i, copies, sha = chain[k]
                chain[k] = (*_better((n, i), entry[:2]), copies + entry[2], sha)
                return
        texts.append(text)
        self.insert(key, entry)

    def _split(self, b: int, key: int) -> int:
        local, held = self.buckets[b]
        if local == self.depth:  # the directory doubles
            self.directory = [x for x in self.directory for _ in (0, 1)]
            self.depth += 1
        low = {k: v for k, v in held.items() if not self._slot(k, local + 1) & 1}
        high = {k: v for k, v in held.items() if self._slot(k, local + 1) & 1}
        self.buckets[b] = (local + 1, low)
        self.buckets.append((local + 1, high))
        first = self._slot(key, local) << (self.depth - local)
        half = 1 << (self.depth - local - 1)
        for s in range(first + half, first + 2 * half):
            self.directory[s] = len(self.buckets) - 1
        return self.directory[self._slot(key, self.depth)]

    def entries(self):
        for _, held in self.buckets:
            for key, chain in held.items():
                for e in chain:
                    yield key, e

    def dump(self) -> bytes:
        """Header, directory, then buckets of (key, best length, best id or none, copies, digest)."""
        out = [struct.pack("<4sIIII", b"XHI1", self.depth, self.skip, self.capacity, len(self.buckets)), struct.pack(f"<{len(self.directory)}I", *self.directory)]
        for local, held in self.buckets:
            rows = [(k, *e) for k, chain in held.items() for e in chain]
            out.append(struct.pack("<II", local, len(rows)))
            out += [struct.pack("<Qq?qq32s", k, n, i is None, i or 0, c, bytes.fromhex(sha)) for k, n, i, c, sha in rows]
        return b"".join(out)

    @classmethod
    def load(cls, data: bytes) -> ExtendibleIndex:
        magic, depth, skip, capacity, n = struct.unpack_from("<4sIIII", data)
        assert magic == b"XHI1"
        new, at = cls(capacity, skip), 20
        new.depth, new.directory, new.buckets = depth, list(struct.unpack_from(f"<{1 << depth}I", data, at)), []
        at += 4 << depth
        for _ in range(n):
            local, rows = struct.unpack_from("<II", data, at)
            held: dict[int, list] = {}
            at += 8
            for _ in range(rows):
                k, size, null, i, c, sha = struct.unpack_from("<Qq?qq32s", data, at)
                held.setdefault(k, []).append((size, None if null else i, c, sha.hex()))
                at += struct.calcsize("<Qq?qq32s")
            new.buckets.append((local, held))
        return new


def open_index(uri: str) -> ExtendibleIndex:
    fs, path = filesystem(uri)
    with fs.open_input_stream(path) as f:
        return ExtendibleIndex.load(f.read())


def _better(a, b):
    """Of two (n_chars, id), the one that stays: longer, then the smaller id, a null id last."""
    return min(a, b, key=lambda x: (-x[0], x[1] is None, x[1] or 0))


def owner_bits(rows: int) -> int:
    """The leading bits of the key that name an owner, so that its index stays small at any size of the table."""
    return max(OWNER_BITS, (rows // OWNER_TEXTS).bit_length())


def _collapse(bits: int):
    """Rows of texts to partial entries, one for each text that a task remembers."""
    return lambda batches: _collapsed(batches, bits)


def _collapsed(batches, bits: int):
    kept: dict[bytes, list] = {}
    size = 0
    schema = pa.schema([("owner", pa.int32()), ("key", pa.int64()), ("sha", pa.string()), ("norm", pa.binary()), ("best_n", pa.int64()), ("best_id", pa.int64()), ("copies", pa.int64())])

    def flush():
        rows = [(int.from_bytes(d[:8], "big") >> (64 - bits), int.from_bytes(d[:8], "big", signed=True), d.hex(), norm, *best, n) for d, entries in kept.items() for norm, best, n in entries]
        kept.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    for batch in batches:
        for i, text, n in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            norm = text.translate(None, SPACES.encode())
            entries = kept.setdefault(hashlib.sha256(norm).digest(), [])
            for e in entries:
                if e[0] == norm:
                    e[1], e[2] = _better(e[1], (n, i)), e[2] + 1
                    break
            else:
                entries.append([norm, (n, i), 1])
                size += len(norm) + 400
            if size > LOCAL_BYTES:
                yield flush()
                size = 0
    if kept:
        yield flush()


def _owner(folder: str, capacity: int, bits: int):
    """Rows in order of owner and key to groups of two or more, through each owner's index."""
    schema = pa.schema([("key", pa.int64()), ("sha", pa.string()), ("keep_id", pa.int64()), ("keep_n", pa.int64()), ("group_size", pa.int64())])

    def close(owner, index):
        write_file(f"{folder}/owner-{owner:08d}.xhi", [index.dump()])
        rows = [(k - (1 << 64) if k >= 1 << 63 else k, sha, i, n, c) for k, (n, i, c, sha) in index.entries() if c > 1]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(schema.types)], schema=schema)

    def run(batches):
        owner, index, unsigned = None, None, 0xFFFFFFFFFFFFFFFF
        for batch in batches:
            for o, k, sha, norm, n, i, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if o != owner:
                    if index is not None:
                        yield close(owner, index)
                    owner, index = o, ExtendibleIndex(capacity, bits)
                index.merge(k & unsigned, norm, (n, i, copies, sha))
        if index is not None:
            yield close(owner, index)

    return run


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 64, index_dir: str | None = None) -> DataFrame:
    """(key, sha, keep_id, keep_n, group_size) of each text that two or more rows have."""
    rows = id_and_text(docs, id_col, text_col)
    bits = owner_bits(docs.count())
    partial = rows.select("id", "text", F.length("text").cast("long").alias("n")).mapInArrow(_collapse(bits), PARTIAL)
    owned = partial.repartition("owner").sortWithinPartitions("owner", "key")
    return owned.mapInArrow(_owner(index_dir or scratch(docs.sparkSession, "exact-index"), capacity, bits), GROUP)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 64, index_dir: str | None = None) -> DataFrame:
    """One row for each of ``docs``: its id, keep_id, group_size, kept and text_sha256."""
    groups = duplicate_groups(docs, id_col, text_col, capacity, index_dir)
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = id_and_text(docs, id_col, text_col)
    member = rows.select(
        "id",
        F.length("text").cast("long").alias("n"),
        F.sha2(F.translate("text", SPACES, "").cast("binary"), 256).alias("sha"),
        F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"),
    )
    found = member.join(spread, ["sha", "salt"], "left")
    best = F.col("group_size").isNull() | (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n")))
    place = F.row_number().over(Window.partitionBy("sha", "id").orderBy(F.desc("n")))
    return found.select(
        F.col("id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (best & (place == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
