"""SentencePiece encoding and decoding by suffix-array matching.

A text's spaces become the space mark and one is put before it; it falls into
units at each run of marks and at each line end, across which no piece of the
vocabulary goes (that is checked). Units repeat, so each is encoded once and
kept in a bounded cache. The units of a batch that aren't known are one text on
end: its suffix array is built, every piece is looked up in it by binary
search, and each occurrence is an edge from its first to its last byte. The
edges, sorted by position and length, are what the merges are relaxed over: in
each round every unit merges its best pair of neighbours that an edge spans,
the leftmost of equals, until none is left. That is the order of a vocabulary
of kind BPE. One of kind unigram takes the best-scored path over the same edges.
Characters that no piece covers become bytes.

Between two characters that no occurrence spans no merge can go, so units fall
into segments there, each relaxed by itself; a unit without spaces, however
long, is matched in runs of bounded bytes that end at such places. Encoding,
decoding and digests share one Python stage, and a worker's cache is bounded by
the sizes its objects really have.

Defined results: a null or empty text has no ids and decodes to the empty
text. Repeated rows get equal results, a null id stays null; extra columns go,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
import zlib
from array import array
from bisect import bisect_left
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meshloom.llm.common import id_and_text
from meshloom.llm.shingles import texts_of
from meshloom.llm.word_tokens import WordIds

MARK = "▁"
_UNIT = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
#: Units of more characters are merged each by itself, with a queue.
SHORT = 40
#: Texts whose units are matched together, and units of a long text that are looked up at a time.
GROUP, UNITS = 600, 100_000
#: Bytes of units, and suffixes, that are matched at a time.
PART, SUFFIXES = 1 << 19, 1 << 18
_NONE = np.int64(1 << 62)


class Pieces:
    """A vocabulary: its pieces in order of their bytes, with ranks (the best score first) and ids."""

    def __init__(self, pieces: list[tuple[bytes, float, int]], byte_ids: dict[int, int], unigram: bool = False):
        self.unigram = unigram
        order = sorted(pieces)
        self.longest = max(len(p) for p, _, _ in order)
        self.texts = np.array([p for p, _, _ in order], dtype=f"S{self.longest}")
        self.tops = np.array([p + b"\xff" * (self.longest - len(p)) for p, _, _ in order], dtype=f"S{self.longest}")
        self.lengths = np.array([len(p) for p, _, _ in order], dtype=np.int64)
        self.ids = np.array([i for _, _, i in order], dtype=np.int64)
        self.scores = np.array([s for _, s, _ in order], dtype=np.float64)
        self.ranks = np.unique(-self.scores, return_inverse=True)[1].astype(np.int64)
        self.byte_ids = np.array([byte_ids[b] for b in range(256)], dtype=np.int64)
        mark = MARK.encode()
        for p, _, _ in order:
            body = p
            while body.startswith(mark):
                body = body[len(mark) :]
            if mark in body or (b"\n" in p and len(p) > 1):
                raise ValueError("a piece goes across units")
        self.of_id = {i: p for p, _, i in order} | {i: bytes([b]) for b, i in byte_ids.items()}

    @classmethod
    def load(cls, path: str, unigram: bool = False) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [(model.id_to_piece(i).encode(), model.get_score(i), i) for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        return cls(plain, {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}, unigram)

    def edges(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start * 64 + length, place of the piece) of every occurrence of a piece, sorted by position and length."""
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        wide = np.concatenate([data, np.full(self.longest, 0xFF, np.uint8)])
        windows = np.lib.stride_tricks.sliding_window_view(wide, self.longest)
        found = [self._occurrences(windows, starts[k : k + SUFFIXES]) for k in range(0, len(starts), SUFFIXES)]
        keys, piece = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
        return keys, piece

    def _occurrences(self, windows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The edges from these starts: their suffixes in order, and every piece's range among them."""
        suffixes = np.ascontiguousarray(windows[starts]).view(f"S{self.longest}").ravel()
        order = np.argsort(suffixes, kind="stable")
        suffixes = suffixes[order]
        low, high = np.searchsorted(suffixes, self.texts, "left"), np.searchsorted(suffixes, self.tops, "right")
        count = high - low
        piece = np.repeat(np.arange(len(count)), count)
        at = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        keys = starts[order[at]] * 64 + self.lengths[piece]
        sort = np.argsort(keys, kind="stable")
        return keys[sort], piece[sort]

    @staticmethod
    def _clean(chars: np.ndarray, size: int, keys: np.ndarray) -> np.ndarray:
        """Whether no edge spans the place before each character, the first one's included."""
        inside = np.zeros(size + 1, np.int64)
        np.add.at(inside, (keys >> 6) + 1, 1)
        np.subtract.at(inside, (keys >> 6) + (keys & 63), 1)
        return np.cumsum(inside)[chars] == 0

    def encode(self, units: list[bytes]) -> list[np.ndarray]:
        """The ids of each unit, in parts of bounded bytes."""
        out, k = [], 0
        while k < len(units):
            j, size = k, 0
            while j < len(units) and (j == k or size + len(units[j]) <= PART):
                size += len(units[j]) + 1
                j += 1
            out += [self._encode_long(units[k])] if size > 2 * PART else self._encode(units[k:j])
            k = j
        return out

    def _encode_long(self, unit: bytes) -> np.ndarray:
        """One unit in runs that end where nothing spans; a run without such a place is made longer."""
        out, at, width = [], 0, PART
        while at < len(unit):
            stop = min(at + width, len(unit))
            while stop < len(unit) and unit[stop] & 0xC0 == 0x80:
                stop -= 1
            cut = stop - at
            if stop < len(unit):
                data = np.frombuffer(unit[at:stop], np.uint8)
                chars = np.flatnonzero((data & 0xC0) != 0x80)
                # What spans a place ends within the longest piece after it.
                clean = chars[self._clean(chars, len(data), self.edges(data)[0]) & (chars <= len(data) - self.longest)]
                cut = int(clean[-1]) if len(clean) else 0
            if cut:
                out += self._encode([unit[at : at + cut]])
                at, width = at + cut, PART
            else:
                width *= 2
        return np.concatenate(out)

    def _encode(self, units: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b"\xff".join(units) + b"\xff", dtype=np.uint8)
        keys, piece = self.edges(data)

        def find(start: np.ndarray, end: np.ndarray) -> np.ndarray:
            """The place of the piece that spans each [start, end), or -1."""
            want = start * 64 + (end - start)
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            return np.where((end - start < 64) & (keys[at] == want), piece[at], -1) if len(keys) else np.full(len(want), -1)

        chars = np.flatnonzero(((data & 0xC0) != 0x80) & (data != 0xFF))
        ends = np.append(chars[1:], len(data) - 1)
        ends -= data[ends - 1] == 0xFF  # before a separator
        unit = np.searchsorted(np.flatnonzero(data == 0xFF), chars)
        first = np.flatnonzero(self._clean(chars, len(data), keys))  # a separator is never spanned
        size = np.diff(np.append(first, len(chars)))
        alive = np.ones(len(chars), bool)
        if self.unigram:
            self._best_paths(chars, ends, alive, first, size, keys, piece)
        else:
            self._merge(chars, ends, alive, first, size, find)
            for u in np.flatnonzero(size > SHORT).tolist():
                self._merge_long(chars, ends, alive, int(first[u]), int(size[u]), keys, piece)
        s, e, u = chars[alive], ends[alive], unit[alive]
        got = find(s, e)
        n = np.where(got >= 0, 1, e - s)
        ids = np.empty(int(n.sum()), dtype=np.int64)
        at = np.cumsum(n) - n
        known = got >= 0
        ids[at[known]] = self.ids[got[known]]
        for k in np.flatnonzero(~known).tolist():
            ids[at[k] : at[k] + n[k]] = self.byte_ids[data[s[k] : e[k]]]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(u, weights=n, minlength=len(units)).astype(np.int64))])
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def _merge(self, chars, ends, alive, first, size, find) -> None:
        """Rounds over all short units at once; changes ends and alive."""
        n = len(chars)
        after = np.arange(1, n + 1)
        last = (first + size - 1)[size > 0]
        after[last] = -1
        before = np.arange(-1, n - 1)
        before[first[size > 0]] = -1
        value = np.full(n, _NONE)
        short = np.repeat(size <= SHORT, size)

        def rate(c):
            c = c[(after[c] >= 0)]
            got = find(chars[c], ends[after[c]])
            value[c] = np.where(got >= 0, (self.ranks[got] << 32) | c, _NONE)

        rate(np.flatnonzero(short))
        units = np.flatnonzero((size > 1) & (size <= SHORT))
        while len(units):
            # The best pair of each unit that still has one.
            lanes = np.repeat(np.cumsum(size[units]) - size[units], size[units])
            places = np.arange(len(lanes)) - lanes + np.repeat(first[units], size[units])
            best = np.minimum.reduceat(value[places], np.cumsum(size[units]) - size[units])
            units, best = units[best < _NONE], best[best < _NONE]
            c = best & 0xFFFFFFFF
            d = after[c]
            ends[c], after[c], alive[d], value[d], value[c] = ends[d], after[d], False, _NONE, _NONE
            follow = after[c]
            before[follow[follow >= 0]] = c[follow >= 0]
            b = before[c]
            value[b[b >= 0]] = _NONE
            rate(np.concatenate([c, b[b >= 0]]))

    def _merge_long(self, chars, ends, alive, first, size, keys, piece) -> None:
        """One segment, with a queue of pairs; what it holds for a character is a few machine words."""
        last = first + size
        lo, hi = np.searchsorted(keys, [chars[first] * 64, ends[last - 1] * 64])
        edge, rank = array("q", keys[lo:hi].tobytes()), array("q", self.ranks[piece[lo:hi]].tobytes())
        after, before = array("q", range(1, size + 1)), array("q", range(-1, size - 1))
        s, e, queue = array("q", chars[first:last].tobytes()), array("q", ends[first:last].tobytes()), []

        def push(c):
            if 0 <= c and after[c] < size:
                d = after[c]
                n = e[d] - s[c]
                if n < 64:
                    want = s[c] * 64 + n
                    at = bisect_left(edge, want)
                    if at < len(edge) and edge[at] == want:
                        heapq.heappush(queue, (rank[at] << 52) | (c << 12) | ((e[c] - s[c]) << 6) | n)

        for c in range(size):
            push(c)
        dead = bytearray(size)
        while queue:
            best = heapq.heappop(queue)
            c, mid, n = (best >> 12) & 0xFFFFFFFFFF, (best >> 6) & 63, best & 63
            if dead[c] or e[c] - s[c] != mid or after[c] >= size or e[after[c]] - s[c] != n:
                continue
            d = after[c]
            dead[d], e[c], after[c] = 1, e[d], after[d]
            if after[c] < size:
                before[after[c]] = c
            push(before[c])
            push(c)
        ends[first:last] = np.frombuffer(e, dtype=np.int64)
        alive[first:last] = ~np.frombuffer(dead, dtype=np.uint8).astype(bool)

    def _best_paths(self, chars, ends, alive, first, size, keys, piece) -> None:
        """Each unit's path of the best sum of scores; a character without a piece costs ten below the worst."""
        worst = float(self.scores.min()) - 10
        for a, n in zip(first.tolist(), size.tolist(), strict=True):
            if not n:
                continue
            place = {int(p): k for k, p in enumerate(chars[a : a + n])} | {int(ends[a + n - 1]): n}
            best, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
            lo, hi = np.searchsorted(keys, [chars[a] * 64, ends[a + n - 1] * 64])
            by: dict[int, list] = {}
            for key, p in zip(keys[lo:hi].tolist(), piece[lo:hi].tolist(), strict=True):
                by.setdefault(key // 64, []).append((key // 64 + key % 64, float(self.scores[p])))
            for k in range(n):
                out = by.get(int(chars[a + k]), [])
                end = int(ends[a + k])
                for stop, score in [*out, *([] if any(x == end for x, _ in out) else [(end, worst)])]:
                    j = place.get(stop)
                    if j is not None and best[k] + score > best[j]:
                        best[j], back[j] = best[k] + score, k
            alive[a : a + n] = False
            j = n
            while j:
                k = back[j]
                alive[a + k] = True
                ends[a + k] = ends[a + j - 1]
                j = k

    def decode(self, ids) -> bytes:
        """The text of ids, its space marks as spaces, without the one put before it."""
        out = b"".join(map(self.of_id.__getitem__, ids)).replace(MARK.encode(), b" ")
        return out[1:] if out[:1] == b" " else out


class PieceIds(WordIds):
    """Units to packed ids, with the same two bounded generations; ``limit`` is in bytes of the objects held."""

    def __init__(self, pieces: Pieces, limit: int = 40 << 20):
        self.pieces, self.limit, self.size = pieces, limit, 0
        self.young, self.old = {}, {}

    def _keep(self, unit: str, ids: bytes) -> None:
        self.young[unit] = ids
        self.size += sys.getsizeof(unit) + sys.getsizeof(ids) + 110  # and the place in the table

    def learn(self, words: set) -> None:
        if self.size > self.limit:
            self.old, self.young, self.size = self.young, {}, 0
        new = list(self._unknown(words))
        for unit, ids in zip(new, self.pieces.encode([u.encode() for u in new]), strict=True):
            self._keep(unit, ids.astype("<u4").tobytes())

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text; a text of many units by itself, in runs of them."""
        if len(texts) == 1:
            units, out = (m.group() for m in _UNIT.finditer(MARK + texts[0].replace(" ", MARK))) if texts[0] else iter(()), []
            while run := list(islice(units, UNITS)):
                self.learn(set(run))
                out.append(b"".join(map(self.young.__getitem__, run)))
            return [b"".join(out)]
        units = [_UNIT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        known: set = set()
        known.update(*units)
        self.learn(known)
        return [b"".join(map(self.young.__getitem__, u)) for u in units]


_kept: dict[tuple, PieceIds] = {}


def piece_ids(path: str, unigram: bool = False) -> PieceIds:
    """This Python worker's encoder for a vocabulary file."""
    if (path, unigram) not in _kept:
        _kept[path, unigram] = PieceIds(Pieces.load(path, unigram))
    return _kept[path, unigram]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _groups(batches):
    """Slices of bounded rows and bytes."""
    for batch in batches:
        sizes = np.diff(texts_of(batch.column(1))[1])
        lo = total = 0
        for k, n in enumerate(sizes.tolist()):
            if k > lo and (k - lo >= GROUP or total + n > 1 << 20):
                yield batch.slice(lo, k - lo)
                lo, total = k, 0
            total += n
        if lo < len(batch):
            yield batch.slice(lo)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id and ids, packed as little-endian unsigned 32-bit integers, of each of ``docs``."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        coder = piece_ids(path)
        for part in _groups(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(coder.encode_all(part.column(1).to_pylist()), pa.binary())], names=["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids and the text that they stand for."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        pieces = piece_ids(path).pieces
        for batch in batches:
            for lo in range(0, len(batch), GROUP):
                part = batch.slice(lo, GROUP)
                texts = [pieces.decode(np.frombuffer(x, "<u4").tolist()).decode("utf-8", "replace") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """For each of ``docs``: doc_id, n_ids, ids_crc32, and the digest of the text decoded from the ids; one Python stage."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        coder = piece_ids(path)
        for part in _groups(batches):
            ids = coder.encode_all(part.column(1).to_pylist())
            texts = (coder.pieces.decode(np.frombuffer(x, "<u4").tolist()) for x in ids)
            columns = [[len(x) // 4 for x in ids], [zlib.crc32(x) for x in ids], [hashlib.sha256(t.decode("utf-8", "replace").encode()).hexdigest() for t in texts]]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string")
