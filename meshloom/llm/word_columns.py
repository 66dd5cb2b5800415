"""Token ids of whole columns of texts, by arrays.

``word_tokens`` takes a text's words one by one, as Python objects. Here a
column's words are told apart by Arrow's hash table, a word is parted from the
signs behind it once for all its places, plain words are merged together, and
the ids of all texts are gathered from those of the distinct words. What isn't
a plain word, or a plain word with signs, is left to ``word_tokens``; so is
every word of a vocabulary whose steps aren't the known ones.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from meshloom.llm.common import SPACES
from meshloom.llm.word_tokens import SIGNS, WordIds, plain_encoders, word_ids

#: White space as spaces; and A-Z as a-z too.
SPACED = bytes(0x20 if chr(b) in SPACES else b for b in range(256))
LOWER = SPACED.lower()
_SIGN = np.isin(np.arange(256), list(SIGNS))
#: Two-byte characters of plain words, by both bytes: U+00C0 to U+024F without the two signs and U+0130.
_PAIR = np.zeros(1 << 16, bool)
_PAIR[[b[0] << 8 | b[1] for c in range(0xC0, 0x250) if c not in (0xD7, 0xF7, 0x130) for b in [chr(c).encode()]]] = True
#: Longer words are left to the library, whose time grows less with a word's length.
LONGEST = 64


def spans(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What lies in ``flat`` from each start on, so many values each, in turn; and the bounds of each."""
    ends = np.zeros(len(start) + 1, np.int64)
    np.cumsum(count, out=ends[1:])
    out = np.empty(int(ends[-1]), flat.dtype)
    for k in range(0, len(start), 1 << 17):  # so that the places of a long column aren't all held
        lo, hi = int(ends[k]), int(ends[min(k + (1 << 17), len(start))])
        own = slice(k, k + (1 << 17))
        at = np.repeat(start[own] - (ends[:-1][own] - lo), count[own])
        at += np.arange(hi - lo)
        np.take(flat, at, out=out[lo:hi], mode="clip")
    return out, ends


def _binary(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, "<i4")), pa.py_buffer(flat)])


def _bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary array without nulls, and its bounds in them."""
    _, ends, flat = words.buffers()
    ends = np.frombuffer(ends, "<i4")[words.offset : words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
    flat = np.frombuffer(flat, np.uint8)[ends[0] : ends[-1]] if flat is not None else np.empty(0, np.uint8)
    return flat, ends - ends[0]


def _sums(marks: np.ndarray) -> np.ndarray:
    """How many marks lie before each place."""
    out = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=out[1:])
    return out


class Merges:
    """Byte pair merges of many words at a time, each by its least rank, leftmost first, as the library does it."""

    NONE = 0xFFFF << 8

    @classmethod
    def of(cls, encoder) -> Merges | None:
        """None where the vocabulary is not of the kind whose merges these are."""
        if not plain_encoders(encoder):
            return None
        model = json.loads(encoder.to_str())["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix")
        if model["type"] != "BPE" or not suffix or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            return None
        if max(vocab.values()) >= 1 << 16 or len(model["merges"]) >= 0xFFFF:
            return None
        shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or 174 <= b]
        char = dict(zip([*shown, *(b for b in range(256) if b not in shown)], [*map(chr, shown), *map(chr, range(256, 512))], strict=False))
        if any(char[b] + x not in vocab for b in range(256) for x in ("", suffix)):
            return None
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        inner, last = ([vocab[char[b] + x] for b in range(256)] for x in ("", suffix))
        return cls(inner, last, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])

    def __init__(self, inner: list[int], last: list[int], merges: list[tuple[int, int, int]]):
        self.inner, self.last = np.array(inner, np.uint16), np.array(last, np.uint16)
        self.made = np.array([m[2] for m in merges], np.uint16)
        # A table of pairs by a hash of 18 bits, the next free place where that is taken.
        ranks = {a << 16 | b: k for k, (a, b, _) in enumerate(merges)}  # of a pair that repeats the last, as in the library
        self.pair, self.rank = np.full((1 << 18) + 64, 0xFFFFFFFF, np.uint32), np.full((1 << 18) + 64, 0xFFFF, np.uint16)
        slots = self._slot(np.array(list(ranks), np.uint32)).tolist()
        self.steps = 1
        for (key, k), at in zip(ranks.items(), slots, strict=True):
            step = next(j for j in range(64) if self.pair[at + j] == 0xFFFFFFFF)
            self.pair[at + step], self.rank[at + step] = key, k
            self.steps = max(self.steps, step + 1)
        every = np.arange(256)
        first = [self.ranks(np.repeat(self.inner, 256), then[np.tile(every, 256)]) for then in (self.inner, self.last)]
        self.first = np.concatenate(first).astype(np.int32) << 8

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key * np.uint32(0x9E3779B1)) >> np.uint32(14)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, 0xFFFF where it has none."""
        key = a.astype(np.uint32) << np.uint32(16) | b
        at = self._slot(key).astype(np.int64)
        there = self.pair[at]
        out = np.where(there == key, self.rank[at], np.uint16(0xFFFF))
        more = np.flatnonzero((there != key) & (there != 0xFFFFFFFF))
        for _ in range(1, self.steps):
            if not len(more):
                break
            at[more] += 1
            there = self.pair[at[more]]
            hit = there == key[more]
            out[more[hit]] = self.rank[at[more[hit]]]
            more = more[~hit & (there != 0xFFFFFFFF)]
        return out

    def encode(self, flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words that begin at ``start`` in ``flat``, so many bytes each, in turn; and how many each has."""
        count, done = np.zeros(len(start), np.int64), []
        order = np.argsort(length, kind="stable")
        for k in range(0, len(order), 1 << 14):  # few enough that their symbols stay in a processor's cache
            self._merge(flat, start, length, order[k : k + (1 << 14)], done)
        for own, symbols in done:
            count[own] = len(symbols)
        ends = _sums(count)
        out = np.empty(int(ends[-1]), np.uint32)
        for own, symbols in done:
            out[ends[own] + np.arange(len(symbols))[:, None]] = symbols
        return out, count

    def _merge(self, flat, start, length, order, done) -> None:
        """Symbols and ranks of pairs have a row for each place in a word and a column for each word; a round makes each word one symbol shorter."""
        sizes = length[order]
        wide = int(sizes[-1])
        own, symbols, ranks = order[:0], np.empty((wide, 0), np.uint16), np.empty((max(0, wide - 1), 0), np.int32)
        for w in range(wide, 0, -1):
            # Words that are so long join those that have become so short.
            new = order[np.searchsorted(sizes, w) : np.searchsorted(sizes, w, side="right")]
            if len(new):
                text = flat[start[new] + np.arange(w)[:, None]]
                first = self.inner[text]
                first[-1] = self.last[text[-1]]
                pair = text[:-1].astype(np.int32) << 8 | text[1:]
                if w > 1:
                    pair[-1] += 1 << 16
                own, symbols = np.concatenate([own, new]), np.concatenate([symbols, first], axis=1)
                ranks = np.concatenate([ranks, self.first[pair] | np.arange(w - 1, dtype=np.int32)[:, None]], axis=1)
            if w == 1:
                done.append((own, symbols))
                return
            best = ranks.min(axis=0)
            over = best >= self.NONE
            if over.any():
                done.append((own[over], symbols[:, over]))
                more = np.flatnonzero(~over)
                own, symbols, ranks, best = own[more], symbols.take(more, axis=1), ranks.take(more, axis=1), best[more]
            at, column = (best & 255).astype(np.int64), np.arange(len(own))
            made = self.made[best >> 8]
            behind = np.arange(w - 1, dtype=np.int32)[:, None] > best & 255
            symbols = np.where(behind, symbols[1:], symbols[:-1])
            symbols[at, column] = made
            ranks = np.where(behind[:-1], ranks[1:] - 1, ranks[:-1])
            some = np.flatnonzero(at > 0)
            left = at[some] - 1
            ranks[left, some] = self.ranks(symbols[left, some], made[some]).astype(np.int32) << 8 | left
            some = np.flatnonzero(at < w - 2)
            here = at[some]
            ranks[here, some] = self.ranks(made[some], symbols[here + 1, some]).astype(np.int32) << 8 | here


class ColumnIds:
    """A column's texts to their ids, packed as little-endian unsigned 32-bit integers.

    The distinct words of late columns are kept with their ids; beyond
    ``limit`` bytes those of the last column alone stay, or none.
    """

    def __init__(self, words: WordIds, limit: int = 24 << 20):
        self.words, self.limit, self.merges = words, limit, Merges.of(words.encoder)
        self._keep(pa.array([], pa.binary()), np.empty(0, np.uint32), np.zeros(1, np.int64))

    def _keep(self, known: pa.Array, ids: np.ndarray, ends: np.ndarray) -> None:
        self.known, self.ids, self.ends = known, ids, ends

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; a null is empty."""
        texts = texts.cast(pa.binary())
        if texts.null_count:
            texts = texts.fill_null(b"")
        if self.merges is None:
            return self.words.encode_all(texts.to_pylist())
        flat, bounds = _bytes(texts)
        raw = flat.tobytes()
        low = np.frombuffer(raw.translate(LOWER), np.uint8)
        if b"<|" in raw:  # a special token's string must not arise from other letters
            low = low.copy()
            for k in np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)).tolist():
                a, b = bounds[k], bounds[k + 1]
                low[a:b] = np.frombuffer(raw[a:b].translate(SPACED), np.uint8)
        # A word goes up to the next word's start, with the spaces between.
        space = low == 0x20
        begins = np.ones(len(low), bool)
        begins[1:] = space[:-1]
        begins[bounds[bounds < len(low)]] = True
        begins &= ~space
        starts = np.flatnonzero(begins)
        if not len(starts):
            return [b""] * len(texts)
        coded = _binary(low, np.append(starts, len(low))).dictionary_encode()
        codes = coded.indices.to_numpy()
        ids, ends = self._distinct(coded.dictionary)
        out, at = spans(ids, ends[:-1][codes], np.diff(ends)[codes])
        packed, cut = out.astype("<u4", copy=False).tobytes(), (4 * at[np.searchsorted(starts, bounds)]).tolist()
        return [packed[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words with spaces behind them, in turn, and their bounds."""
        flat, bounds = _bytes(words)
        start, stop = bounds[:-1], bounds[1:]
        space, sign = flat == 0x20, _SIGN[flat]
        spaces = _sums(space)
        length = stop - start - np.diff(spaces[bounds])
        # A word's core goes up to its last byte that is no sign.
        core = ~(space | sign)
        cores, places = _sums(core), np.append(np.flatnonzero(core), -1)
        before = cores[stop]
        size = np.where(before > cores[start], places[before - 1] + 1 - start, 0)
        two = np.zeros(len(flat) + 1, bool)  # bytes with which a two-byte character of plain words ends
        two[1:-1] = _PAIR[flat[:-1].astype(np.int32) << 8 | flat[1:]]
        two[start] = False
        letter = (flat - np.uint8(0x61) < 26) | two[:-1] | two[1:]
        others = _sums(~letter)
        plain = (size > 0) & (others[start + size] == others[start])
        special = np.flatnonzero((flat[:-1] == 0x3C) & (flat[1:] == 0x7C))
        plain[np.searchsorted(start, special, side="right") - 1] = False
        size = np.where(plain, size, length)
        # Cores and the signs behind them in turn: the words' bytes without the spaces.
        parts = _binary(flat[~space], _sums(np.column_stack([size, length - size]).ravel())).dictionary_encode()
        own = np.zeros(len(parts.dictionary), bool)
        codes = parts.indices.to_numpy()
        own[codes[::2]] = plain
        at = self._look_up(parts.dictionary, own)[codes]
        ids, ends = spans(self.ids, self.ends[at], np.diff(self.ends)[at])
        self._forget(parts.dictionary, codes, at)
        return ids, ends[::2]

    def _look_up(self, keys: pa.Array, plain: np.ndarray) -> np.ndarray:
        """The place of each key among the known ones; the new ones become known."""
        found = pc.index_in(keys, value_set=self.known)
        at = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = len(self.known) + np.arange(len(new))
            words = keys.take(pa.array(new))
            ids, ends = self._encode(words, plain[new])
            self._keep(pa.concat_arrays([self.known, words]), np.concatenate([self.ids, ids]), np.concatenate([self.ends, self.ends[-1] + ends[1:]]))
        return at

    def _forget(self, keys: pa.Array, codes: np.ndarray, at: np.ndarray) -> None:
        if self.known.nbytes + self.ids.nbytes + self.ends.nbytes <= self.limit:
            return
        own = np.empty(len(keys), np.int64)
        own[codes] = at
        ids, ends = spans(self.ids, self.ends[own], np.diff(self.ends)[own])
        self._keep(keys, ids, ends)
        if keys.nbytes + ids.nbytes + ends.nbytes > self.limit:
            self._keep(keys[:0], ids[:0].copy(), ends[:1].copy())

    def _encode(self, words: pa.Array, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words in turn, and their bounds."""
        flat, bounds = _bytes(words)
        length = np.diff(bounds)
        plain = plain & (length <= LONGEST)
        own, count = np.flatnonzero(plain), np.zeros(len(words), np.int64)
        start, size = bounds[own], length[own]
        if len(flat) and flat.max() > 127:
            # Capitals beyond A-Z: the lower case of some is shorter or longer.
            wide = np.flatnonzero(np.diff(_sums(flat > 127)[bounds])[own])
            lower = b" ".join(words.take(pa.array(own[wide])).to_pylist()).decode().lower().encode() + b" "
            text = np.frombuffer(lower, np.uint8)
            stops = np.flatnonzero(text == 0x20)[: len(wide)]
            start[wide] = len(flat) + np.append(0, stops + 1)[: len(wide)]
            size[wide] = stops - (start[wide] - len(flat))
            flat = np.concatenate([flat, text])
        merged, count[own] = self.merges.encode(flat, start, size)
        rest = np.flatnonzero(~plain)
        others = words.take(pa.array(rest)).to_pylist()
        packed = [x for k in range(0, len(others), 50_000) for x in self.words.encode_all(others[k : k + 50_000])]
        count[rest] = [len(x) // 4 for x in packed]
        ends = _sums(count)
        out = np.empty(int(ends[-1]), np.uint32)
        of = np.repeat(plain, count)
        out[of] = merged
        out[~of] = np.frombuffer(b"".join(packed), "<u4")
        return out, ends


_kept: dict[str, ColumnIds] = {}


def column_ids(path: str) -> ColumnIds:
    """This Python worker's encoder of columns for a vocabulary file."""
    if path not in _kept:
        _kept[path] = ColumnIds(word_ids(path))
    return _kept[path]


def blocks(batches, column: int, size: int = 4 << 20):
    """The batches in slices of about so many bytes of texts in a column; a longer text is a slice by itself."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        lo = 0
        while lo < len(batch):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
