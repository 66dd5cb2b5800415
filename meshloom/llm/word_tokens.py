"""Token ids of whole texts with the tokenizers library, one word at a time.

The vocabulary's pre-tokenizer never joins characters across white space, so
the ids of a text are those of its words in turn. Words repeat, so each word
is encoded once by the library and kept, packed, in a bounded cache.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: A character that this vocabulary encodes as one id; words that hold it are encoded alone.
MARK = "\x01"
#: Signs that the pre-tokenizer parts from a letter before them; an apostrophe may join to what follows.
SIGNS = b"!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"
#: Words of letters a-z and from U+00C0 to U+024F, which neither the normalizer nor the pre-tokenizer parts; not U+0130, whose lower case has a mark.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|[\xc5-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+")

#: The pre-tokenizer's pattern, which leaves a plain word whole.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def plain_encoders(encoder) -> tuple:
    """Encoders of plain words in lower case between spaces, of ASCII alone and of others, without the steps that leave those as they are; none where the steps aren't those known."""
    from tokenizers import Tokenizer, pre_tokenizers

    if getattr(encoder, "normalizer", None) is None or getattr(encoder, "pre_tokenizer", None) is None:
        return ()
    first, then = (json.loads(x.__getstate__()) for x in (encoder.normalizer, encoder.pre_tokenizer))
    before, steps = first.get("normalizers", []), then.get("pretokenizers", [])
    if [x["type"] for x in before] != ["NFC", "Replace", "Lowercase"] or before[1]["pattern"] != {"Regex": r"\s+"} or before[1]["content"] != " ":
        return ()
    split = {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}
    if len(steps) != 2 or steps[0] != split or not {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}.items() <= steps[1].items():
        return ()
    ascii_, other = Tokenizer(encoder.model), Tokenizer(encoder.model)
    ascii_.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    other.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return ascii_, other


class WordIds:
    """Word (bytes) to its ids, packed as little-endian unsigned 32-bit integers.

    Two generations bound the memory: when the young one exceeds ``limit``
    bytes it becomes the old one, and the old one goes.
    """

    def __init__(self, path: str, limit: int = 40 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.encoder, self.limit, self.size = Tokenizer.from_file(path), limit, 0
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.plain_of, self.plain = self.encoder, plain_encoders(self.encoder)
        mark = self._ids(MARK)
        self.mark = int(mark[0]) if len(mark) == 1 else None
        # Ids that end a word, where the vocabulary has a suffix for them.
        suffix, known = getattr(self.encoder.model, "end_of_word_suffix", None), self.encoder.get_vocab()
        self.ends = np.zeros(max(known.values(), default=-1) + 1, bool)
        if suffix:
            self.ends[[i for token, i in known.items() if token.endswith(suffix)]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.encoder.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def learn(self, words: set[bytes]) -> None:
        """Encode the words that aren't known; afterwards all given ones are.

        A word that ends in ASCII signs after an ASCII letter, or after a plain
        word, is put together from its parts: the pre-tokenizer parts them too.
        """
        if self.size > self.limit:
            self.old, self.young, self.size = self.young, {}, 0
        new = self._unknown(words)
        parts = {}
        for w in new:
            core = w.rstrip(SIGNS)
            if core and core != w and (core[-1:].isalpha() or PLAIN.fullmatch(core)) and b"<|" not in w:
                parts[w] = (core, w[len(core) :])
        lone = new.difference(parts)
        lone.update(x for pair in parts.values() for x in pair)
        self._encode(self._unknown(lone))
        for w, (core, signs) in parts.items():
            self._keep(w, self.young[core] + self.young[signs])

    def _unknown(self, words: set[bytes]) -> set[bytes]:
        """Those that neither generation has; what the old one has goes to the young one."""
        new, old = words.difference(self.young), self.old
        known = [w for w in new if w in old]
        for w in known:
            self._keep(w, old[w])
        return new.difference(known) if known else new

    def _encode(self, words: set[bytes]) -> None:
        if self.plain_of is not self.encoder:
            self.plain_of, self.plain = self.encoder, plain_encoders(self.encoder)
        plain = list(filter(PLAIN.fullmatch, words)) if self.ends.any() else []
        # Plain words are parted by their last ids; should those not tell them apart, they go with the others.
        rest = words.difference(plain)
        kinds = [([w for w in plain if w.isascii()], self.plain[0]), ([w for w in plain if not w.isascii()], self.plain[1])] if self.plain else [(plain, self.encoder)]
        for own, encoder in kinds:
            for part, ids in self._batches(own, " ", encoder):
                cut = np.flatnonzero(self.ends[ids]) + 1
                if len(cut) == len(part) and int(cut[-1]) == len(ids):
                    self._cut(part, ids, cut, cut)
                else:
                    rest.update(part)
        together = [w for w in rest if b"\x01" not in w and b"<|" not in w] if self.mark is not None else []
        for w in rest.difference(together):
            self._keep(w, self._ids(w.decode("utf-8", "replace")).tobytes())
        for part, ids in self._batches(together, f" {MARK} ", self.encoder):
            cut = np.flatnonzero(ids == self.mark)
            assert len(cut) == len(part) - 1, "the mark must stand alone"
            cut = np.append(cut, len(ids))
            self._cut(part, ids, cut, cut + 1)

    def _batches(self, words: list[bytes], between: str, encoder, size: int = 500):
        """(words, their ids in turn) of some words at a time, encoded as one text."""
        parts = [words[k : k + size] for k in range(0, len(words), size)]
        texts = [between.join([w.decode("utf-8", "replace") for w in part]) for part in parts]
        if encoder in self.plain:
            texts = [t.lower() for t in texts]
        for part, found in zip(parts, encoder.encode_batch_fast(texts, add_special_tokens=False) if texts else (), strict=True):
            yield part, np.array(found.ids, dtype="<u4")

    def _cut(self, words: list[bytes], ids: np.ndarray, end: np.ndarray, after: np.ndarray) -> None:
        """Keep each word's ids, up to its end and from after the one before."""
        packed, at = ids.tobytes(), 0
        for w, a, b in zip(words, (4 * end).tolist(), (4 * after).tolist(), strict=True):
            self._keep(w, packed[at:a])
            at = b

    def _keep(self, word: bytes, ids: bytes) -> None:
        self.young[word] = ids
        self.size += len(word) + len(ids) + 150

    def encode(self, text: bytes) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text; the new words of all are encoded together."""
        # The vocabulary knows lower case only; a special token's string must not arise here, though.
        split = [(text if b"<|" in text else text.lower()).split() for text in texts]
        out, late = [b""] * len(texts), []
        for k, words in enumerate(split):
            try:
                out[k] = b"".join(map(self.young.__getitem__, words))
            except KeyError:
                late.append(k)
        if late:
            self.learn(set().union(*(split[k] for k in late)))
            for k in late:
                out[k] = b"".join(map(self.young.__getitem__, split[k]))
        return out


_kept: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """This Python worker's encoder for a vocabulary file."""
    if path not in _kept:
        _kept[path] = WordIds(path)
    return _kept[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
