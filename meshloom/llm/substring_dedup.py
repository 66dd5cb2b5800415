"""Repeated substrings removed by suffix arrays over distributed, locally chosen anchors.

A byte goes when a string of ``WINDOW`` bytes that covers it also starts
earlier: in a smaller id, or before in the same document.

1. Each window of that length belongs to one anchor, the place of its leftmost
   least ``GRAM``-byte key, which equal windows share. An anchor's context is
   the union of its windows. Scan tasks collapse equal contexts, then rows are
   dealt by the anchor's key: of equal contexts all but the first are removed.
   A key with ``MANY`` contexts or more in one scan task is dealt by context
   from there, and a marker tells the key's own task that it has several; so
   a task gets fewer than ``MANY`` rows of a key from each scan task.
2. Keys with several contexts are contested. Their contexts are read from the
   texts and dealt by key. The bytes at which contexts of a key part, to the
   left and right of the anchor, cut them into blocks; inside a block contexts
   agree on all bytes or differ at once, so blocks are the symbols of a text
   for which ``gsaca.suffix_array`` is built, many keys at a time. A window is
   a run of blocks; suffixes that share that run have the same window, and
   all but the first lose it. A key with over ``HOT`` contexts is taken window
   by window instead: tasks that read the texts collapse equal windows (by 128
   bits of hash), the rest are dealt by window, and all but the first go; no
   task holds a key's rows together.
3. A document's removed spans are united and its remaining bytes digested.

Defined results: a null text is empty; texts below ``WINDOW`` bytes keep all.
A null id comes first. Rows that share an id count as one document: each gets
the spans found under that id. Extra columns go; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.llm.common import id_and_text, spool
from meshloom.llm.gsaca import suffix_array
from meshloom.llm.shingles import mix, span_hashes, texts_of

WINDOW, GRAM = 100, 24
SPAN = WINDOW - GRAM + 1
#: Contexts that one suffix array takes of a key; contexts of a key in one scan task from which they are dealt one by one.
HOT, MANY = 2_000, 16
#: Parts of a hot key's rows as they learn that it is hot.
SALTS = 64
#: Anchors that a scan task collapses at a time; symbols of one suffix array; bytes hashed at a time.
COLLAPSE, SYMBOLS, CHUNK = 1 << 20, 1 << 16, 1 << 16
NULL_ID = -(1 << 63)
_BYTE = np.random.default_rng(100).integers(0, 2**64, 256, dtype=np.uint64)
_LOW = np.uint64((1 << 20) - 1)
#: Bytes drawn in another order, for a second hash.
_OTHER = np.random.default_rng(101).permutation(256).astype(np.uint8)
#: c is -1 in spans that go and MARKER in markers; s deals a key's contexts.
ROW = "gh long, xh long, id long, a int, b int, c int, s int"
CONTEXT = "gh long, xh long, id long, a int, b int, c int, context binary"
MARKER = -2
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]


def _join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = x * np.uint64(0x9E3779B97F4A7C15)
    z += y * np.uint64(0xC2B2AE3D27D4EB4F)
    z ^= z >> np.uint64(29)
    return z


def _grams(data: np.ndarray) -> np.ndarray:
    """A key of the GRAM bytes from each place."""
    h = _BYTE[data]
    for n in (1, 2, 4):
        h = _join(h[:-n], h[n:])
    eight, sixteen = h, _join(h[:-8], h[8:])
    return mix(_join(sixteen[: len(eight) - 16], eight[16:]))


def anchors(data: np.ndarray, offsets: np.ndarray):
    """(document, place, key, first window, last window) of each anchor of texts on end, in order."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) + (np.empty(0, np.int64),) * 2
    at, key = np.empty(n, np.int64), np.empty(n, np.uint64)
    for lo in range(0, n, CHUNK):
        hi = min(lo + CHUNK, n)
        grams = _grams(data[lo : hi + WINDOW - 1])
        m = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        size = 1
        while size * 2 <= SPAN:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        if size < SPAN:
            m = np.minimum(m[: len(m) - (SPAN - size)], m[SPAN - size :])
        own = (m & _LOW).astype(np.int64)
        at[lo:hi], key[lo:hi] = own + lo, grams[own]
    doc = np.searchsorted(offsets, np.arange(n), side="right") - 1
    whole = np.flatnonzero(np.arange(n) + WINDOW <= offsets[doc + 1])
    a = at[whole]
    new = np.ones(len(whole), bool)
    new[1:] = (a[1:] != a[:-1]) | (whole[1:] != whole[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(whole)) - 1 if len(first) else first
    return doc[whole[first]], a[first], key[whole[first]], whole[first], whole[last]


def _batch(gh, xh, ids, a, b, c, s=None):
    s = np.zeros(len(gh), np.int32) if s is None else s
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((gh, xh, ids, a, b, c, s), _TYPES, strict=True)], names=["gh", "xh", "id", "a", "b", "c", "s"])


def _removal(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Rows of spans, united where they touch; c is -1, and the key deals them by document."""
    order = np.lexsort((starts, ids))
    i, s, e = ids[order], starts[order].astype(np.int64), ends[order].astype(np.int64)
    if not len(i):
        return _batch(i, i, i, i.astype(np.int32), i.astype(np.int32), i.astype(np.int32))
    new = np.ones(len(i), bool)
    own = np.cumsum(np.concatenate([[True], i[1:] != i[:-1]]))
    reach = np.maximum.accumulate(e + own * (1 << 40)) - own * (1 << 40)
    new[1:] = (own[1:] != own[:-1]) | (s[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(i)) - 1
    ids = i[first]
    return _batch(mix(ids.astype(np.uint64)).view(np.int64), np.zeros(len(ids), np.int64), ids, s[first].astype(np.int32), reach[last].astype(np.int32), np.full(len(ids), -1, np.int32))


def _later(gh, xh, ids, a):
    """Of rows in order of key, hash, id and place: which are the first of their key and hash, and which another place than the first's."""
    new = np.ones(len(gh), bool)
    new[1:] = (gh[1:] != gh[:-1]) | (xh[1:] != xh[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return new, ~new & ((ids != ids[first]) | (a != a[first]))


def _collapsed(held: list[tuple]):
    """The distinct contexts of held columns in order, and spans of their later copies."""
    gh, xh, ids, a, b, c = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((a, ids, xh, gh))
    gh, xh, ids, a, b, c = (x[order] for x in (gh, xh, ids, a, b, c))
    new, later = _later(gh, xh, ids, a)
    return [x[new] for x in (gh, xh, ids, a, b, c)], _removal(ids[later], (a - c)[later], (a - b + WINDOW)[later])


def _scan(batches, many: int):
    """(id, text) to one row for each distinct context of the task, spans of its later copies, and markers of keys with ``many``."""
    held: list[tuple] = []
    size = 0

    def flush():
        kept, spans = _collapsed(held)
        held.clear()
        gh, xh = kept[:2]
        first = np.flatnonzero(np.concatenate([[True], gh[1:] != gh[:-1]]))
        count = np.diff(np.append(first, len(gh)))
        yield _batch(*kept, np.where(np.repeat(count, count) >= many, (xh >> 1 & 0x3FFFFFFF) + 1, 0).astype(np.int32))
        marked = gh[first[count >= many]]
        none = np.zeros(len(marked), np.int64)
        yield _batch(marked, none, none, none.astype(np.int32), none.astype(np.int32), np.full(len(marked), MARKER, np.int32))
        yield spans

    for batch in batches:
        for lo in range(0, len(batch), 500):
            part = batch.slice(lo, 500)
            data, offsets = texts_of(part.column(1))
            ids = part.column(0).to_numpy(zero_copy_only=False)
            doc, at, key, w0, w1 = anchors(data, offsets)
            if len(doc):
                a, c, b = at - offsets[doc], at - w0, at - w1
                xh = mix(span_hashes(data, w0, w1 + WINDOW) + (b * 1000 + c).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)  # a marker's is 0
                held.append((key.view(np.int64), xh.view(np.int64), ids[doc], a.astype(np.int32), b.astype(np.int32), c.astype(np.int32)))
                size += len(doc)
            if size > COLLAPSE:
                yield from flush()
                size = 0
    if held:
        yield from flush()


def _contested(batches):
    """Rows in order of key, context and place to spans of later equal contexts, and contexts of keys that have several.

    Of the last key only one context is carried over, so a key's rows are never held together.
    """
    carry, several = None, False

    def columns(batch):
        return [c.to_numpy(zero_copy_only=False) for c in batch.columns]

    def emit(gh, xh, ids, a, b, c, s, close):
        nonlocal carry, several
        new, later = _later(gh, xh, ids, a)
        spans = _removal(ids[later], (a - c)[later], (a - b + WINDOW)[later])
        gh, xh, ids, a, b, c, s = (x[new] for x in (gh, xh, ids, a, b, c, s))
        group = np.cumsum(np.concatenate([[True], gh[1:] != gh[:-1]])) - 1
        count = np.bincount(group)
        count[0] += several
        out = ((count[group] > 1) | (s > 0)) & (c >= 0)
        several = bool(count[-1] > 1)
        carry = None if close else [x[-1:] for x in (gh, xh, ids, a, b, c, s)]
        if not close:
            out[-1] = False
        yield from (spans, _batch(*(x[out] for x in (gh, xh, ids, a, b, c))))

    for batch in batches:
        cols = columns(batch)
        span = cols[5] == -1
        if span.any():
            yield _batch(*(x[span] for x in cols))
            cols = [x[~span] for x in cols]
        if not len(cols[0]):
            continue
        if carry is not None:
            if carry[0][0] != cols[0][0] and not several and not carry[6][0]:
                carry = None
            else:
                cols = [np.concatenate(x) for x in zip(carry, cols, strict=True)]
        else:
            several = False
        if carry is None:
            several = False
        yield from emit(*cols, False)
    if carry is not None:
        yield from emit(*carry, True)


def _windows(data, offsets, ids, doc, rows):
    """Columns as a scan's, a context for each window of anchors (key, place, least and most left) of texts."""
    gh, a, b, c = rows
    count = c - b + 1
    own = np.repeat(np.arange(len(a)), count)
    left = b[own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    doc, start = doc[own], offsets[doc[own]] + a[own] - left
    inside = np.flatnonzero(start + WINDOW <= offsets[doc + 1])  # others are of another row of this id
    inside = inside[np.argsort(start[inside], kind="stable")]
    own, left, doc, start = own[inside], left[inside], doc[inside], start[inside]
    one, two = span_hashes(data, start, start + WINDOW), span_hashes(_OTHER[data], start, start + WINDOW)
    salt = gh[own].view(np.uint64) + left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    left = left.astype(np.int32)
    return one.view(np.int64), mix(two + salt).view(np.int64), ids[doc], a[own].astype(np.int32), left, left


def _contexts(batches):
    """(id, text, anchors) to rows CONTEXT: the contexts of anchors, or of hot ones the distinct windows and spans of later copies."""
    held: list[tuple] = []
    size = 0

    def flush():
        kept, spans = _collapsed(held)
        held.clear()
        for x in (kept, [spans.column(k) for k in range(6)]):
            yield _context_batch([*x, pa.nulls(len(x[0]), pa.binary())])

    for batch in batches:
        for lo in range(0, len(batch), 500):
            part = batch.slice(lo, 500)
            lists = part.column(2)
            rows = lists.flatten()
            per = np.diff(lists.offsets.to_numpy())
            doc = np.repeat(np.arange(len(part)), per)
            gh, a, b, c, hot = (rows.field(k).to_numpy(zero_copy_only=False) for k in range(5))
            ids = part.column(0).to_numpy(zero_copy_only=False)
            data, offsets = texts_of(part.column(1))
            if hot.any():
                docs, wide = doc[hot], [x[hot].astype(np.int64) for x in (gh, a, b, c)]
                for at in range(0, len(docs), CHUNK // SPAN):
                    own = slice(at, at + CHUNK // SPAN)
                    held.append(_windows(data, offsets, ids, docs[own], [x[own] for x in wide]))
                    size += len(held[-1][0])
                    if size > COLLAPSE:
                        yield from flush()
                        size = 0
            lefts, ends = offsets[doc] + a - c, offsets[doc] + a - b + WINDOW
            plain = np.flatnonzero(~hot & (ends <= offsets[doc + 1]))
            whole = data.tobytes()
            context = [whole[x:y] for x, y in zip(lefts[plain].tolist(), ends[plain].tolist(), strict=True)]
            yield _context_batch([gh[plain], np.zeros(len(plain), np.int64), ids[doc[plain]], a[plain], b[plain], c[plain], context])
    if held:
        yield from flush()


def _context_batch(out):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [*_TYPES[:6], pa.binary()], strict=True)], names=["gh", "xh", "id", "a", "b", "c", "context"])


def _lcp(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    x, y = x[:n], y[:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


def _partings(sides: list[bytes]) -> tuple[list[int], set[int]]:
    """For each string the longest prefix that another shares, and all lengths at which neighbours in order part."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    most, cuts = [0] * len(sides), set()
    for j, k in zip(order, order[1:], strict=False):
        n = _lcp(sides[j], sides[k])
        cuts.add(n)
        if n > most[j]:
            most[j] = n
        if n > most[k]:
            most[k] = n
    return most, cuts


class Blocks:
    """The text of symbols of many keys' contexts, and the windows asked of it."""

    def __init__(self):
        self.text: list[int] = []
        self.asked: list[tuple] = []  # place in the text, symbols, order, id, anchor, least left, most left
        self.symbols = 0

    def add(self, rows: list[tuple]) -> None:
        """Rows (id, anchor, least left, most left, context) of one key, in order."""
        left = [r[4][: r[3]][::-1] for r in rows]
        right = [r[4][r[3] :] for r in rows]
        (ml, _), (mr, _) = _partings(left), _partings(right)
        span = [(max(r[2], WINDOW - mr[k]), min(r[3], ml[k])) for k, r in enumerate(rows)]
        kept = [k for k, (lo, hi) in enumerate(span) if lo <= hi]
        if len(kept) < 2:
            return
        _, cl = _partings([left[k] for k in kept])
        _, cr = _partings([right[k] for k in kept])
        el, er = [0, *sorted(x for x in cl if x)], [0, *sorted(x for x in cr if x)]
        el.append(WINDOW + SPAN)
        er.append(WINDOW + SPAN)
        ids: dict = {}
        base = self.symbols + 1
        for n, k in enumerate(kept):
            i, a, _, _, _ = rows[k]
            lo, hi = span[k]
            own, other = left[k], right[k]
            nl = 0
            while el[nl] < hi:
                nl += 1
            nr = 0
            while er[nr] < WINDOW - lo:
                nr += 1
            at = len(self.text)
            self.text += [base + ids.setdefault((t, own[el[t] : el[t + 1]]), len(ids)) for t in range(nl - 1, -1, -1)]
            self.text += [base + ids.setdefault((-1 - t, other[er[t] : er[t + 1]]), len(ids)) for t in range(nr)]
            self.text.append(0)
            steps = sorted({lo, hi + 1, *(x + 1 for x in el if lo < x + 1 <= hi), *(WINDOW - x for x in er if lo < WINDOW - x <= hi)})
            for l0, l1 in zip(steps, steps[1:], strict=False):
                p = q = 0
                while el[p] < l0:
                    p += 1
                while er[q] < WINDOW - l0:
                    q += 1
                self.asked.append((at + nl - p, p + q, n, i, a, l0, l1 - 1))
        self.symbols += len(ids)

    def removed(self):
        """The ids and spans of windows that an earlier place has too."""
        asked = self.asked
        if not asked:
            return None
        text = np.array(self.text, dtype=np.int64)
        order = np.array(suffix_array(text), dtype=np.int64)
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        place, m, n, ids, a, l0, l1 = (np.array(c, dtype=np.int64) for c in zip(*asked, strict=True))
        # The symbols that each suffix shares with the one before it.
        shared = np.zeros(len(order), dtype=np.int64)
        live = np.arange(1, len(order))
        for d in range(int(m.max())):
            x, y = order[live - 1] + d, order[live] + d
            inside = (x < len(text)) & (y < len(text))
            live, x, y = live[inside], x[inside], y[inside]
            live = live[(text[x] == text[y]) & (text[x] != 0)]
            shared[live] += 1
        kind = np.empty(len(m), dtype=np.int64)
        for k in np.unique(m):
            own = m == k
            kind[own] = np.cumsum(shared < k)[rank[place[own]]]
        sort = np.lexsort((n, kind, m))
        m, kind, ids, a, l0, l1 = (x[sort] for x in (m, kind, ids, a, l0, l1))
        new = np.ones(len(m), bool)
        new[1:] = (m[1:] != m[:-1]) | (kind[1:] != kind[:-1])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = ~new & ((ids != ids[first]) | (a != a[first]))
        return ids[later], (a - l1)[later], (a - l0 + WINDOW)[later]


def _decide(batches):
    """Rows CONTEXT in order of key, hash, id and place to the spans that go; of windows only the first in hand is held."""
    key, rows, blocks, carry = None, [], Blocks(), None

    def settle():
        nonlocal blocks
        got, blocks = blocks.removed(), Blocks()
        if got is not None and len(got[0]):
            yield _removal(*got)

    for batch in batches:
        hot = batch.column(6).is_null().to_numpy(zero_copy_only=False)
        if hot.any():
            cols = [batch.column(k).to_numpy()[hot] for k in range(6)]
            span = cols[5] < 0
            yield _batch(*(x[span] for x in cols))
            cols = [x[~span] for x in cols]
            if len(cols[0]):
                cols = cols if carry is None else [np.concatenate(x) for x in zip(carry, cols, strict=True)]
                gh, xh, ids, a, b, c = cols
                new, later = _later(gh, xh, ids, a)
                yield _removal(ids[later], (a - c)[later], (a - b + WINDOW)[later])
                last = np.flatnonzero(new)[-1]
                carry = [x[last : last + 1] for x in cols]
        whole = batch.filter(pa.array(~hot)) if hot.any() else batch
        for g, *row in zip(*(whole.column(k).to_pylist() for k in (0, 2, 3, 4, 5, 6)), strict=True):
            if g != key:
                if len(rows) > 1:
                    blocks.add(rows)
                    if len(blocks.text) > SYMBOLS:
                        yield from settle()
                key, rows = g, []
            rows.append(tuple(row))
    if len(rows) > 1:
        blocks.add(rows)
    yield from settle()


def _finish(batches):
    """(id, text, spans) to the contract's rows."""
    for batch in batches:
        out: list[list] = [[] for _ in range(5)]
        for i, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            kept, at, gone, runs = [], 0, 0, 0
            end = -1
            for s, e in sorted((x["a"], x["b"]) for x in spans or ()):
                s, e = min(s, len(text)), min(e, len(text))
                if s > end:
                    runs += s < e
                    kept.append(text[at:s])
                if e > max(at, end):
                    gone += e - max(s, end)
                    at = end = e
            kept.append(text[at:])
            for c, v in zip(out, (i, len(text), gone, runs, hashlib.sha256(b"".join(kept)).hexdigest()), strict=True):
                c.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removed_spans(texts: DataFrame) -> DataFrame:
    """(id, a, b): spans of bytes that go, of texts (id, text) without null ids."""
    found = texts.mapInArrow(partial(_scan, many=MANY), ROW).repartition("gh", "s").sortWithinPartitions("gh", "xh", "id", "a")
    rows = spool(found.mapInArrow(_contested, ROW), "contested")
    open_ = rows.where("c >= 0").select("gh", "id", "a", "b", "c")
    hot = open_.groupBy("gh").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("gh", F.lit(True).alias("hot"))
    if hot.isEmpty():
        open_ = open_.withColumn("hot", F.lit(False))
    else:
        salted = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("id", "a"), F.lit(SALTS)).cast("int")
        open_ = open_.withColumn("salt", salt).join(salted, ["gh", "salt"], "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    lists = open_.groupBy("id").agg(F.collect_list(F.struct("gh", "a", "b", "c", "hot")).alias("anchors"))
    contexts = texts.join(lists, "id").select("id", "text", "anchors").mapInArrow(_contexts, CONTEXT)
    dealt = contexts.repartition("gh", "xh").sortWithinPartitions("gh", "xh", "id", "a")
    decided = dealt.mapInArrow(_decide, ROW)
    return rows.where("c < 0").select("id", "a", "b").unionByName(decided.select("id", "a", "b"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of ``docs``: doc_id, n_bytes, n_removed, n_spans and kept_sha256."""
    texts = id_and_text(docs, id_col, text_col).withColumn("id", F.coalesce("id", F.lit(NULL_ID)))
    spans = removed_spans(texts).groupBy("id").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    out = texts.join(spans, "id", "left").select("id", "text", "spans")
    made = out.mapInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return made.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))
