"""Best-fit packing of token pieces into sequences by minimum bin slack.

Only the number of pieces of each length matters to the packing, so the driver
holds at most one counter for each length up to the capacity, at any input
size. A bin takes the largest piece left; a bitset subset-sum over the
lengths that are left finds the fullest feasible combination beside it. That
pattern is then removed as often as the counters allow, so the number of
patterns is bounded by the lengths too. A piece's rank among those of its
length, taken in two levels, tells its bin and its place there.

Defined results: a null text is empty and makes one piece, the end id. Rows
that repeat are packed each for itself. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshloom.llm.common import id_and_text, lean, spool
from meshloom.llm.word_columns import blocks, column_ids
from meshloom.llm.word_tokens import default_vocabulary

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, times) of a combination of the counted lengths whose sum is the largest that ``room`` holds.

    Longer lengths come first, so that short pieces stay for later bins.
    """
    if room <= 0:
        return []
    mask, bits = (1 << (room + 1)) - 1, 1
    stages: list[tuple[int, int, int]] = []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left = most = min(counts[length], room // length)
        if not most:
            continue
        stages.append((length, most, bits))
        step = 1
        while left:
            take = min(step, left)
            bits |= (bits << (length * take)) & mask
            left -= take
            step *= 2
        if bits >> room & 1:
            break
    at, found = bits.bit_length() - 1, []
    for length, most, before in reversed(stages):
        times = 0
        while not before >> at & 1:
            at -= length
            times += 1
        assert times <= most
        if times:
            found.append((length, times))
    return found


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, [(length, times)]) patterns that use up all counted pieces."""
    left = {k: v for k, v in counts.items() if v > 0}
    out = []
    while left:
        first = max(left)
        rest = {k: v - (k == first) for k, v in left.items()}
        pattern: dict[int, int] = {first: 1}
        for length, times in fullest(rest, capacity - first):
            pattern[length] = pattern.get(length, 0) + times
        bins = min(left[k] // n for k, n in pattern.items())
        for k, n in pattern.items():
            left[k] -= bins * n
            if not left[k]:
                del left[k]
        out.append((bins, list(pattern.items())))
    return out


class Places:
    """Bin and offset of the piece of a rank among those of a length, from a plan."""

    def __init__(self, patterns):
        runs: list[tuple[int, int, int, int, int]] = []  # length, first rank, first bin, times in a bin, offset
        used: dict[int, int] = {}
        base = 0
        for bins, pattern in patterns:
            at = 0
            for length, times in pattern:
                runs.append((length, used.get(length, 0), base, times, at))
                used[length] = used.get(length, 0) + bins * times
                at += length * times
            base += bins
        runs.sort()
        self.bins = base
        self.length, self.rank, self.base, self.times, self.at = (np.array([r[j] for r in runs], dtype=np.int64) for j in range(5))
        self.starts = {int(x): int(k) for x, k in zip(*np.unique(self.length, return_index=True), strict=True)}
        self.ends = {x: int(np.searchsorted(self.length, x, side="right")) for x in self.starts}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        where = np.empty(len(length), dtype=np.int64)
        for x in np.unique(length).tolist():
            own = length == x
            a, b = self.starts[x], self.ends[x]
            where[own] = a + np.searchsorted(self.rank[a:b], rank[own], side="right") - 1
        k = rank - self.rank[where]
        times = self.times[where]
        return self.base[where] + k // times, self.at[where] + k % times * length


def cut(ids: bytes, capacity: int):
    """(piece, start, length, crc32) of a document's packed ids."""
    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
        part = ids[at : at + 4 * capacity]
        yield piece, at // 4, len(part) // 4, zlib.crc32(part)


def _pieces(vocabulary: str, capacity: int, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        encode, end, task = column_ids(vocabulary).encode, end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in blocks(batches, 1):
            out: list[list] = [[] for _ in range(7)]
            for i, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                for piece, start, length, crc in cut(ids + end, capacity):
                    for c, v in zip(out, (i, piece, start, length, crc, task, seen[length]), strict=True):
                        c.append(v)
                    seen[length] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, vocabulary: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col)
    # The written table fixes each piece's task and rank, whatever becomes of the executors.
    pieces = spool(rows.mapInArrow(lean(_pieces(vocabulary or default_vocabulary(), capacity, end_id)), PIECES), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = by_task.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    places = spark.sparkContext.broadcast(Places(plan(counts, capacity)))

    def assign(batches):
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            sequence, offset = places.value.find(length, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(before, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("rank"))
    return ranked.mapInArrow(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
