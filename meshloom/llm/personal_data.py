"""Personal data, plain and disguised, with spans in the source text.

Plain kinds are found by pattern in the text itself. For disguises, three
transducers rewrite the text and keep, for each character that they emit, the
source characters that it stands for: one maps homoglyphs to the ASCII
characters they look like and drops invisible characters, one maps spelled
digits to digits, one maps at/dot disguises to ``@`` and ``.``. The patterns
run over the output, and each match is mapped back to the span of its source
characters. A mapped span counts where a disguise lies in it and it
overlaps no plain span of its kind.

Defined results: a null text is empty and has no spans. Texts are taken whole,
at any length; repeated rows get equal results; extra columns go.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.llm.common import id_and_text, lean, slices

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns of the plain kinds; an e-mail address is one or more of LOCAL, @, and HOST.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]+)")  # a match begins where its digits do, so a long run is read once
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# English number words of digits, and what at and dot are disguised as.
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
# Cyrillic and Greek letters beside the Latin letters that they look like.
LOOKALIKES = (
    ("АВСЕНІЈКМОРЅТХУасеіјорѕхуԁһԛԝ", "ABCEHIJKMOPSTXYaceijopsxydhqw"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοινυκρ", "ABEZHIKMNOPTYXoivukp"),
    ("‐‑‒–—−﹣－。．｡․﹒＠﹫", "--------.....@@"),
)
INVISIBLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"


def _homoglyphs() -> dict[str, str]:
    table = {a: b for odd, plain in LOOKALIKES for a, b in zip(odd, plain, strict=True)}
    table |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}  # full-width forms
    for first in (0x1D400, 0x1D434, 0x1D468, 0x1D5A0, 0x1D5D4, 0x1D670):  # mathematical letters
        table |= {chr(first + k): chr((0x41 if k < 26 else 0x47) + k) for k in range(52)}
    table |= {chr(first + k): str(k) for first in (0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6, 0x0660, 0x06F0, 0x0966) for k in range(10)}
    return table


HOMOGLYPHS = _homoglyphs()
_ODD = re.compile("[" + re.escape("".join(HOMOGLYPHS) + INVISIBLE) + "]")
_ODD_SET = frozenset(HOMOGLYPHS) | frozenset(INVISIBLE)
_PLACE = r"[\x20\t]{0,3}"
_OPEN, _CLOSE = rf"{_PLACE}[\[({{<]{_PLACE}", rf"{_PLACE}[\])}}>]{_PLACE}"
_AT = re.compile(rf"{_OPEN}(?:at|@){_CLOSE}|[\x20\t]{{1,3}}(?:at|@)[\x20\t]{{1,3}}", re.IGNORECASE)
_DOT = re.compile(rf"{_OPEN}(?:dot|\.){_CLOSE}|[\x20\t]{{1,3}}dot[\x20\t]{{1,3}}", re.IGNORECASE)
_WORD = "|".join(sorted(DIGITS, key=len, reverse=True))
#: Two spelled digits or more in a row, a plus before them or not.
_SPELLED = re.compile(rf"(?<![A-Za-z])(?:plus[\x20\t-]{{1,3}})?(?:{_WORD})(?:[\x20\t-]{{1,3}}(?:{_WORD}))+(?![A-Za-z])", re.IGNORECASE)
_ONE = re.compile(rf"(plus|{_WORD})([\x20\t-]{{0,3}})", re.IGNORECASE)
#: A spelled digit beside a numeral, and a run of both, a plus before it or not.
_LONE = rf"(?<![A-Za-z])(?:{_WORD})(?![A-Za-z])"
_MIXED = re.compile(rf"[0-9][\x20\t-]{{0,3}}{_LONE}|{_LONE}[\x20\t-]{{0,3}}[0-9]", re.IGNORECASE | re.ASCII)
_RUN = re.compile(rf"(?:(?<![A-Za-z])plus[\x20\t-]{{1,3}})?(?:{_LONE}|[0-9]++)(?:[\x20\t-]{{0,3}}(?:{_LONE}|[0-9]++))+", re.IGNORECASE | re.ASCII)
_ITEM = re.compile(r"[A-Za-z]+|[0-9]+")
_HOST_SO_FAR = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str):
    """Spans of e-mail addresses, found from each @ outwards, so that long runs are read once."""
    done, at = 0, text.find("@")
    while at >= 0:
        host, a = HOST.match(text, at + 1), at
        if host:
            while a > done and text[a - 1] in LOCAL:
                a -= 1
            if a < at:
                done = host.end()
                yield a, done
        at = text.find("@", max(at + 1, done))


def _octet(digits: str) -> bool:
    own = digits.lstrip("0")
    return len(own) <= 3 and int(own or 0) <= 255


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the plain kinds, leftmost and non-overlapping for each kind."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(_octet, m.group().split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


class Tape:
    """A text with, for each character, the source span it stands for and whether that is disguised."""

    def __init__(self, text: str):
        self.text = text
        self.spans: list[tuple[int, int, bool]] | None = None  # none while nothing is rewritten

    def rewrite(self, changes: list[tuple[int, int, str]]) -> None:
        """Replace [start, end) of this tape by strings, in order; a string's characters all stand for that source."""
        if not changes:
            return
        if self.spans is None:
            self.spans = [(k, k + 1, False) for k in range(len(self.text))]
        text, spans, at = [], [], 0
        for a, b, new in changes:
            text += [self.text[at:a], new]
            spans += self.spans[at:a]
            spans += [(self.spans[a][0], self.spans[b - 1][1], True)] * len(new)
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.spans = spans + self.spans[at:]


def homoglyphs(tape: Tape) -> None:
    if not tape.text.isascii() and not _ODD_SET.isdisjoint(tape.text):
        tape.rewrite([(m.start(), m.end(), HOMOGLYPHS.get(m.group(), "")) for m in _ODD.finditer(tape.text)])


def spelled_digits(tape: Tape) -> None:
    """Spelled digits in a row become digits on end; a digit stands for its word and what joins it to the next."""
    changes = []
    for m in _SPELLED.finditer(tape.text):
        ones = list(_ONE.finditer(tape.text, m.start(), m.end()))
        for k, x in enumerate(ones):
            changes.append((x.start(), x.end() if k + 1 < len(ones) else x.end(1), DIGITS.get(x.group(1).lower(), "+")))
    tape.rewrite(changes)


def mixed_digits(tape: Tape) -> None:
    """Spelled digits among numerals or each other become digits on end; what joins a word to its neighbour goes, what joins two numerals stays."""
    changes = []
    for m in _RUN.finditer(tape.text):
        items = list(_ITEM.finditer(tape.text, m.start(), m.end()))
        for x, y in zip(items, [*items[1:], None], strict=True):
            if x.group().isalpha():
                changes.append((x.start(), y.start() if y else x.end(), DIGITS.get(x.group().lower(), "+")))
            elif y and y.group().isalpha() and x.end() < y.start():
                changes.append((x.end(), y.start(), ""))
    tape.rewrite(changes)


def disguised_signs(tape: Tape) -> None:
    """``at`` and ``dot`` in brackets are signs anywhere; bare, ``at`` only where a bare or bracketed ``dot`` follows in the same address, after plain dots or none."""
    dots = [(m.start(), m.end()) for m in _DOT.finditer(tape.text)]
    changes = []
    for a, b in dots:
        if a and b < len(tape.text) and tape.text[a - 1].isalnum() and tape.text[b].isalnum():
            changes.append((a, b, "."))
    starts = {a for a, _, _ in changes}
    for m in _AT.finditer(tape.text):
        a, b = m.span()
        if not a or b >= len(tape.text) or not (tape.text[a - 1].isalnum() and tape.text[b].isalnum()):
            continue
        plain = tape.text[a:b].strip().lower() == "at"
        host = _HOST_SO_FAR.match(tape.text, b)
        if plain and not (host and host.end() in starts):
            continue
        changes.append((a, b, "@"))
    changes.sort()
    tape.rewrite([c for k, c in enumerate(changes) if not k or c[0] >= changes[k - 1][1]])


#: Two readings: numerals beside spelled digits apart, or in one number with them.
READINGS = ((homoglyphs, spelled_digits, disguised_signs), (homoglyphs, mixed_digits, disguised_signs))


def shown(tape: Tape, plain: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans in the source of identifiers that only the rewritten text shows; none where no transducer changed it."""
    if tape.spans is None:
        return []
    out = []
    for kind, a, b in find(tape.text):
        own = tape.spans[a:b]
        start, end = min(s for s, _, _ in own), max(e for _, e, _ in own)
        if end - start == b - a and not any(odd for _, _, odd in own):
            continue
        if not any(k == kind and s < end and start < e for k, s, e in plain):
            out.append((kind, start, end))
    return out


def disguised(text: str, plain: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of both readings; of a kind's that overlap the first reading's stay, but a longer card or phone replaces what it holds."""
    out: list[tuple[str, int, int]] = []
    for steps in READINGS:
        tape = Tape(text)
        for step in steps:
            if step is mixed_digits and not _MIXED.search(tape.text):
                return out
            step(tape)
        for kind, a, b in shown(tape, plain):
            over = [x for x in out if x[0] == kind and x[1] < b and a < x[2]]
            if kind in ("card", "phone") and all(a <= s and e <= b for _, s, e in over):
                out = [x for x in out if x not in over]
            elif over:
                continue
            out.append((kind, a, b))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def detect(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Plain spans and those that the transducers add."""
    plain = find(text)
    return plain, disguised(text, plain)


def mask(text: str) -> str:
    """The text with every identifier, plain or disguised, replaced by its kind in brackets; overlapping ones become the first."""
    plain, more = detect(text)
    out, at = [], 0
    for kind, a, b in sorted(plain + more, key=lambda x: (x[1], -x[2], KINDS.index(x[0]))):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _run(batches):
    for batch in batches:
        out: list[list] = [[] for _ in range(8)]
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            plain, more = detect(text)
            count = [sum(k == kind for k, _, _ in plain) for kind in KINDS]
            for c, v in zip(out, (i, *count, hashlib.sha256(joined(plain).encode()).hexdigest(), joined(plain + more), len(more)), strict=True):
                c.append(v)
        kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each of ``docs`` the counts of plain spans, their digest, all spans, and the number of added ones."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_run, SCHEMA)


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every identifier in the text replaced by its kind; a null text stays null."""

    def run(batches):
        for batch in slices(batches):
            k = batch.schema.get_field_index(text_col)
            texts = [None if t is None else mask(t) for t in batch.column(k).to_pylist()]
            yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))

    return docs.mapInArrow(lean(run), docs.schema)
