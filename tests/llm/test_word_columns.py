"""Ids of whole columns against the library's, and that plain words don't go through the library."""

import random

import numpy as np
import pyarrow as pa
import pytest

from meshloom.llm import packing, token_files, word_columns, word_tokens

VOCABULARY = word_tokens.default_vocabulary()


@pytest.fixture(scope="module")
def encoder():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def odd_texts(seed):
    draw = random.Random(seed)
    letters = [c for c in map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250)])]
    word = lambda: "".join(draw.choices(letters[: draw.choice([52, None])], k=draw.randint(1, 14)))
    behind = ["", "", "", ".", ",", "!?", "&&&", "'", "'s", "(", "<|", "|", "́", "\\", "1", "\x1c"]
    texts = [draw.choice(["", " ", "\n"]) + "".join(word() + draw.choice(behind) + draw.choice([" ", " ", "\t\n", "\r", "\x0b", "  "]) for _ in range(draw.randint(0, 60))) + draw.choice(["", "end", "end."]) for _ in range(60)]
    texts += ["".join(draw.choice("aB ,.'-!\n\té中́\u0085\x1c<|>1É×÷İΣ") for _ in range(80)) for _ in range(150)]
    texts += [c + s for c in letters for s in ("", ".")] + [f"a{c}b{c}" for c in letters]
    return texts + ["", " \t\n", "q" * 5000, "ab" * 33, "a" * 64, "a" * 65, "é" * 32 + ".", "é" * 33, "Ⱥ" * 9, "<|ENDOFTEXT|> A B", "abc<|endoftext|>.", "x", "\x01 \x00 ▁ x", "one", "one", "...", "word.", ".word", "it's they'll WE'RE don't"]


@pytest.mark.parametrize("limit", [24 << 20, 20_000, 200])
def test_columns_equal_the_library(encoder, limit):
    coder = word_columns.ColumnIds(word_tokens.WordIds(VOCABULARY), limit=limit)
    assert coder.merges is not None
    for seed in (1, 2, 3):
        texts = odd_texts(seed)
        want = [encoder.encode(t, add_special_tokens=False).ids for t in texts]
        for kind in (pa.string(), pa.binary()):
            got = coder.encode(pa.array(["before", *texts, "behind"], pa.string()).cast(kind)[1:-1])
            for t, a, b in zip(texts, got, want, strict=True):
                assert np.frombuffer(a, "<u4").tolist() == b, repr(t)
        assert coder.known.nbytes <= limit
    assert coder.encode(pa.array([], pa.string())) == [] and coder.encode(pa.array([None, ""], pa.string())) == [b"", b""]
    assert coder.encode(pa.array([None, "a"], pa.string()))[1] == word_tokens.WordIds(VOCABULARY).encode(b"a")


def test_bytes_that_are_no_text_are_as_before():
    draw = random.Random(5)
    texts = [bytes(draw.choices(b"ab \xc3\xa9\x80\xff.<|\xc4", k=draw.randint(0, 40))) for _ in range(2000)]
    words = word_tokens.WordIds(VOCABULARY)
    assert word_columns.ColumnIds(words).encode(pa.array(texts, pa.binary())) == [words.encode(t) for t in texts]


def test_another_vocabulary_goes_through_the_library(encoder):
    words = word_tokens.WordIds(VOCABULARY)
    words.encoder = type("Other", (), {"encode_batch_fast": encoder.encode_batch_fast, "encode": encoder.encode})()
    coder, texts = word_columns.ColumnIds(words), odd_texts(4)
    assert coder.merges is None
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(pa.array(texts))] == [encoder.encode(t, add_special_tokens=False).ids for t in texts]


def test_blocks_hold_every_row_once():
    batch = pa.RecordBatch.from_pydict({"id": list(range(50)), "text": ["x" * (k * 37 % 400) for k in range(49)] + [None]})
    for size in (1, 500, 1 << 20):
        parts = list(word_columns.blocks([batch, batch[:0]], 1, size))
        assert [i for b in parts for i in b.column(0).to_pylist()] == list(range(50))
        assert all(len(b) == 1 or sum(len(t or "") + 64 for t in b.column(1).to_pylist()) <= size for b in parts)


def plain_texts():
    draw = random.Random(6)
    return [" ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyzäéñß", k=draw.randint(1, 12))) + draw.choice(["", ".", ","]) for _ in range(100)) for _ in range(100)]


def learned_by(monkeypatch, run):
    """The words that ``run`` gives to the library."""
    seen, learn = set(), word_tokens.WordIds.learn
    monkeypatch.setattr(word_tokens.WordIds, "learn", lambda self, words: seen.update(words) or learn(self, words))
    word_tokens._kept.clear()
    word_columns._kept.clear()
    run()
    return seen


def test_token_files_leave_plain_words_to_arrays(monkeypatch, tmp_path):
    texts = plain_texts()
    batch = pa.RecordBatch.from_pydict({"cell": [k // 30 for k in range(100)], "id": list(range(100)), "text": texts})
    made = []
    seen = learned_by(monkeypatch, lambda: made.extend(token_files._write(f"file://{tmp_path}", VOCABULARY, 1, 4096)([batch])))
    assert seen <= {b"", b".", b","}
    words = word_tokens.WordIds(VOCABULARY)
    got = [(i, ids.tolist()) for path in made[0].column(1).to_pylist() for i, ids in token_files.ShardReader(path)]
    assert got == [(k, np.frombuffer(words.encode(t.encode()), "<u4").tolist() + [1]) for k, t in enumerate(texts)]


def test_packing_leaves_plain_words_to_arrays(monkeypatch):
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("Task", (), {"partitionId": lambda self: 7})())
    texts = plain_texts()
    batch = pa.RecordBatch.from_pydict({"id": list(range(100)), "text": texts})
    made = []
    seen = learned_by(monkeypatch, lambda: made.extend(packing._pieces(VOCABULARY, 64, 1)([batch])))
    assert seen <= {b"", b".", b","}
    words, want = word_tokens.WordIds(VOCABULARY), []
    for k, t in enumerate(texts):
        want += [(k, *piece) for piece in packing.cut(words.encode(t.encode()) + b"\1\0\0\0", 64)]
    assert [tuple(r.values())[:5] for b in made for r in b.to_pylist()] == want
