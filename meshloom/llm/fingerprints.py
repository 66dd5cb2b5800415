"""Document fingerprints by content-defined chunking.

A gear hash, of the last 64 bytes at each place, picks the boundaries, with a
stricter mask before the normal chunk size and a looser one after it, so that
sizes gather round the normal one and a shift of the text moves only the
boundaries beside the change. A fingerprint is the set of the chunks' digests
with their lengths; containment weighs each digest by its bytes.

Defined results: a null text is empty; an empty text has the empty
fingerprint, alike (1) to another empty one and unlike (0) to any other. A null
id comes first; rows of one id are in order of their text. The next of the last
is the first, so a table's only row is its own next. Any 64-bit ids will do, and
texts of any length, one at a time. Extra columns go, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.llm.common import Cells, id_and_text
from meshloom.llm.shingles import span_hashes

LEAST, NORMAL, MOST = 16, 48, 256
#: Bits that must be zero at a boundary before and after the normal size.
STRICT, LOOSE = 6, 4
_GEAR = np.random.default_rng(64).integers(0, 2**64, 256, dtype=np.uint64)
_BLOCK = 1 << 16


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i-j]] << j for j < 64, by doubling the window."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16, 32):
        h[step:] += h[:-step] << np.uint64(step)
    return h


def boundaries(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of chunks that the strict and the loose mask allow, over texts on end."""
    strict, loose = [], []
    for lo in range(0, len(data), _BLOCK):
        before = min(lo, 63)
        top = gear(data[lo - before : lo + _BLOCK])[before:] >> np.uint64(64 - STRICT)
        at = np.flatnonzero(top < 1 << (STRICT - LOOSE))
        loose.append(at + lo + 1)
        strict.append(at[top[at] == 0] + lo + 1)
    return (np.concatenate(strict), np.concatenate(loose)) if strict else (np.empty(0, np.int64),) * 2


def chunk_ends(start: int, end: int, strict: list[int], loose: list[int], s: int, l: int) -> list[int]:
    """The ends of a text's chunks; s and l are where its boundaries begin."""
    out, at = [], start
    while at < end:
        stop = min(at + MOST, end)
        s = bisect_left(strict, at + LEAST, s)
        cut = strict[s] if s < len(strict) else stop
        if cut > at + NORMAL:
            l = bisect_left(loose, at + NORMAL, l)
            cut = loose[l] if l < len(loose) else stop
        at = min(cut, stop)
        out.append(at)
    return out


def chunks(texts: list[bytes]) -> list[dict[int, int]]:
    """For each text its chunks' digests and the bytes that each covers."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    # The hash of a text's first 63 places must not see the text before it: such boundaries are found anew.
    strict, loose = (x.tolist() for x in boundaries(data))
    ends: list[int] = []
    count: list[int] = []
    at = s = l = 0
    for t in texts:
        stop = at + len(t)
        head = np.frombuffer(t[:63], dtype=np.uint8)
        top = gear(head) >> np.uint64(64 - STRICT)
        own = np.flatnonzero(top < 1 << (STRICT - LOOSE))
        hl, hs = (own + at + 1).tolist(), (own[top[own] == 0] + at + 1).tolist()
        l, s = bisect_left(loose, at + 64, l), bisect_left(strict, at + 64, s)
        l2, s2 = bisect_left(loose, stop + 1, l), bisect_left(strict, stop + 1, s)
        got = chunk_ends(at, stop, hs + strict[s:s2], hl + loose[l:l2], 0, 0)
        ends += got
        count.append(len(got))
        at, s, l = stop, s2, l2
    e = np.array(ends, dtype=np.int64)
    b = np.concatenate([[0], e[:-1]]).astype(np.int64) if len(e) else e
    digests = span_hashes(data, b, e).tolist()
    sizes = (e - b).tolist()
    out, k = [], 0
    for n in count:
        own: dict[int, int] = {}
        for d, size in zip(digests[k : k + n], sizes[k : k + n], strict=True):
            own[d] = own.get(d, 0) + size
        out.append(own)
        k += n
    return out


def fingerprint(own: dict[int, int]) -> str:
    """The digests in order with their bytes: ``digest:bytes`` in hexadecimal, comma-joined."""
    return ",".join([f"{d:x}:{own[d]:x}" for d in sorted(own)])


def parse(text: str) -> dict[int, int]:
    return {int(d, 16): int(n, 16) for d, n in (x.split(":") for x in text.split(",") if x)}


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """The share of a's bytes whose chunks b has too."""
    if not a:
        return float(not b)
    return sum(min(n, b[d]) for d, n in a.items() if d in b) / sum(a.values())


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """The smaller of the containments either way: a small text inside a large one isn't like it."""
    return min(containment(a, b), containment(b, a))


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the first characters of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
#: Texts' bytes that are chunked at a time.
GROUP = 1 << 20


def _compare(rows):
    """Result rows for consecutive (cell, ahead, id, text), the last of a cell being the next cell's first."""
    own = chunks([r[3].encode() for r in rows])
    pairs = [k for k in range(len(rows) - 1) if rows[k][0] == rows[k + 1][0] and not rows[k][1]]
    texts = [edited(rows[k][3], rows[k + 1][3]).encode() for k in pairs]
    out = []
    for k, t, e in zip(pairs, texts, chunks(texts), strict=True):
        out.append((rows[k][2], len(rows[k][3]), hashlib.sha256(t).hexdigest(), fingerprint(own[k]), fingerprint(e), likeness(own[k], e), likeness(own[k], own[k + 1])))
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(_TYPES)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def _run(batches):
    held, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append(row)
            size += len(row[3])
            if size > GROUP and len(held) > 1:
                yield _compare(held)
                held, size = held[-1:], len(held[-1][3])
    if held:
        yield _compare(held)


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(cell, ahead, id, text) dealt by cell and in order; each cell ends with the first row of the next cell."""
    cells = Cells(docs, id_col, text_col)
    rows = id_and_text(docs, id_col, text_col).withColumn("code", cells.of(F.col("id")))
    cell, head, last = F.shiftright("code", 1), F.col("code").bitwiseAND(1) == 1, len(cells) - 1
    # A cell's head also goes to the cell before its own, the table's to the last. Of rows that share its id, all go; the first in order counts.
    first = F.col("id").isNull() if cells.nulls else head & (cell == 0)
    before = F.when(first, F.lit(last)).when(head & (cell > 0), cell - 1)
    own = F.struct(cell.cast("long").alias("cell"), F.lit(False).alias("ahead"))
    extra = F.when(before.isNotNull(), F.array(own, F.struct(before.cast("long").alias("cell"), F.lit(True).alias("ahead")))).otherwise(F.array(own))
    spread = rows.select(F.explode(extra).alias("to"), "id", "text").select("to.cell", "to.ahead", "id", "text")
    return spread.repartition(len(cells), "cell").sortWithinPartitions("cell", "ahead", "id", "text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each of ``docs`` with its fingerprint, that of its edited text, and their likeness."""
    return in_order(docs, id_col, text_col).mapInArrow(_run, SCHEMA)
