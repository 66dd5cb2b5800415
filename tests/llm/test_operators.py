"""The training-data operators on small tables against plain versions, with odd rows in every column."""

import hashlib
import os
import random
import re
import subprocess
import sys
import warnings
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from meshloom.llm import exact_dedup, fingerprints, gsaca, html_text, language_id, minhash, packing, page_blocks, personal_data, piece_matching, substring_dedup, token_files, word_tokens
from meshloom.llm.components import components

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Extra columns whose names the operators use too.
        T.StructField("id", T.StringType()),
        T.StructField("keep_id", T.LongType()),
        T.StructField("sha", T.StringType()),
        T.StructField("part", T.IntegerType()),
    ]
)


def documents(spark, rows):
    """A table of documents from (doc_id, text)."""
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), "x", 1, None, 0) for i, t in rows], SCHEMA)


def odd_rows(seed=0):
    draw = random.Random(seed)
    words = ["the", "of", "straße", "été", "niño", "und", "12", "x,y", "A", "É!", "日本", "ing"]
    make = lambda n: " ".join(draw.choice(words) for _ in range(n))
    rows = [(k, make(draw.randint(0, 60))) for k in range(3, 40)]
    base = make(300)
    rows += [(50, base), (51, base), (52, base + " "), (53, base[:700] + " new " + base[700:]), (54, make(20) + base + make(20)), (55, "ab" * 400), (56, make(9000)), (57, "q" * 5000)]
    return rows + [(0, None), (1, ""), (2, " \t\n"), (None, "null id"), (60, "one"), (61, "one"), (62, "O ne"), (63, "a b"), (64, "<|endoftext|> it's <|END|>"), (65, "\x01 \x00 ▁ x")]


# Exact copies -----------------------------------------------------------------------


def test_extendible_index_splits_and_round_trips():
    index = exact_dedup.ExtendibleIndex(capacity=4, skip=2)
    draw, want = random.Random(1), {}
    for k in range(300):
        key = draw.getrandbits(62)
        entry = (k, None if k % 7 == 0 else k, 1, f"{k:064x}")
        index.insert(key, entry)
        want.setdefault(key, []).append(entry)
    index.insert(key, (1, 2, 3, "0" * 64))  # a collision is chained
    want[key].append((1, 2, 3, "0" * 64))
    assert index.depth > 5 and len(index.directory) == 1 << index.depth
    again = exact_dedup.ExtendibleIndex.load(index.dump())
    for x in (index, again):
        assert all(x.chain(k) == v for k, v in want.items()) and x.chain(12345) == []
        assert all(len(held) <= 4 for _, held in x.buckets)


def test_extendible_index_merges_equal_texts_by_their_bytes():
    index = exact_dedup.ExtendibleIndex(capacity=2)
    draw, want = random.Random(14), {}
    for key in sorted(draw.getrandbits(64) for _ in range(50)):
        for _ in range(draw.randint(1, 9)):
            text, n, i, copies = draw.choice([b"a", b"b", b""]), draw.randint(0, 3), draw.choice([None, 1, 2]), draw.randint(1, 3)
            index.merge(key, text, (n, i, copies, text.hex()))  # texts that share a key are told apart
            held = want.setdefault((key, text.hex()), [(n, i), 0])
            held[0] = min(held[0], (n, i), key=lambda x: (-x[0], x[1] is None, x[1] or 0))
            held[1] += copies
    got = {(k, sha): [(n, i), copies] for k, (n, i, copies, sha) in index.entries()}
    assert got == want and sum(1 for _ in index.entries()) == len(want)


def test_owners_follow_the_rows():
    assert [exact_dedup.owner_bits(n) for n in (0, 10**6, 10**9, 10**12)] == [10, 10, 15, 25]


def test_exact_dedup(spark, tmp_path):
    rows = odd_rows()
    rows += [(70, "twin"), (70, "twin"), (71, None), (None, "twin")]
    got = exact_dedup.exact_dedup(documents(spark, rows), index_dir=f"file://{tmp_path}/index").collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, len(t or "")))
    best = {k: min(v, key=lambda x: (-x[1], x[0] is None, x[0] or 0))[0] for k, v in groups.items()}
    want = sorted(((i, best[k], len(v), hashlib.sha256(k.encode()).hexdigest()) for k, v in groups.items() for i, _ in v), key=str)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == want
    kept = [(r["doc_id"], r["text_sha256"]) for r in got if r["kept"]]
    assert len(kept) == len(set(kept)) == len(groups)
    files = [p for p in (tmp_path / "index").iterdir() if p.suffix == ".xhi"]
    entries = [e for p in files for e in exact_dedup.open_index(f"file://{p}").entries()]
    assert len(entries) == len(groups) and sum(e[2] for _, e in entries) == len(rows)


# Tokens -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_tokens.default_vocabulary())


def ids_of(encoder, text):
    return encoder.encode(text or "", add_special_tokens=False).ids + [1]


def test_word_cache_equals_the_library(encoder):
    cache = word_tokens.WordIds(word_tokens.default_vocabulary(), limit=2000)  # so small that generations go
    texts = [t for _, t in odd_rows() + odd_rows(4) if t]
    draw = random.Random(2)
    texts += ["".join(draw.choice("aB ,.'-!\n\té中́\u0085\x1c<|>1") for _ in range(80)) for _ in range(200)]
    texts += ["it's they'll WE'RE don't", "a,'s b.'t", "ＦＵＬＬ ﬁ İ ß", "<|ENDOFTEXT|>x"]
    for t in texts:
        assert np.frombuffer(cache.encode(t.encode()), "<u4").tolist() == encoder.encode(t, add_special_tokens=False).ids, repr(t)


def test_plain_words_skip_the_pattern():
    """Plain words go to encoders without the pattern, which give the ids of the whole library."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(word_tokens.default_vocabulary())
    letters = [c for c in map(chr, [*range(0x61, 0x7B), *range(0xC0, 0x250)]) if word_tokens.PLAIN.fullmatch(c.encode())]
    draw = random.Random(4)
    words = letters + ["".join(draw.choices(letters[: 26 if k % 2 else None], k=draw.randint(1, 20))) for k in range(20000)]
    cache, given = word_tokens.WordIds(word_tokens.default_vocabulary()), []
    kept = cache._batches
    cache._batches = lambda words, between, encoder, *a: given.append((len(words), encoder)) or kept(words, between, encoder, *a)
    cache.learn({w.encode() for w in words})
    assert all(encoder is not cache.encoder for n, encoder in given if n) and len(given) == 3
    for w in words:
        assert np.frombuffer(cache.young[w.encode()], "<u4").tolist() == whole.encode(w, add_special_tokens=False).ids, w


def test_plain_words_need_no_mark(encoder):
    cache, draw, read = word_tokens.WordIds(word_tokens.default_vocabulary()), random.Random(8), []
    letters = "".join(map(chr, range(0xC0, 0x250)))
    plain = sorted({"".join(draw.choice("abcdefghijklmnopqrstuvwxyzäéñß") for _ in range(draw.randint(1, 12))) for _ in range(3000)})
    text = " ".join(plain)

    class Counting:
        def encode_batch_fast(self, texts, **how):
            found = encoder.encode_batch_fast(texts, **how)
            read.extend(len(x.ids) for x in found)
            return found

    cache.encoder = Counting()
    want = encoder.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(cache.encode(text.encode()), "<u4").tolist() == want
    assert sum(read) == len(want)  # nothing is encoded beside the words
    cache.encoder = encoder
    odd = [*letters, *(f"a{c}b{s}" for c in letters for s in ("", ".", "'", ",-", "\u0301", "s's"))]
    for t in (" ".join(odd), *odd[::7], " ".join(w + draw.choice([".", "!?", "'", "&&&"]) for w in plain)):
        assert np.frombuffer(cache.encode(t.encode()), "<u4").tolist() == encoder.encode(t, add_special_tokens=False).ids, repr(t)


def test_new_words_of_several_texts_are_encoded_together(encoder):
    texts = [t for _, t in odd_rows(5) if t] + ["", "known words", "known words", "<|endoftext|> A", "\x01 b"]
    cache, learn, learned = word_tokens.WordIds(word_tokens.default_vocabulary(), limit=2000), word_tokens.WordIds.learn, []
    cache.learn = lambda words: learned.append(len(words)) or learn(cache, words)
    for some in (texts, texts[::-1]):
        want = [encoder.encode(t, add_special_tokens=False).ids for t in some]
        assert [np.frombuffer(x, "<u4").tolist() for x in cache.encode_all([t.encode() for t in some])] == want
    assert len(learned) <= 2
    assert cache.encode_all([]) == []


def test_word_cache_is_small_beside_an_executor():
    cache = word_tokens.word_ids(word_tokens.default_vocabulary())
    most = 0
    for k in range(300):
        cache.encode(" ".join(f"w{j}x" for j in range(k * 2000, k * 2000 + 2000)).encode())
        most = max(most, sum(len(w) + len(v) + 150 for held in (cache.young, cache.old) for w, v in held.items()) if k % 20 == 19 else 0)
    word_tokens._kept.clear()
    assert most < 90 << 20


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory is read from /proc")
def test_a_task_gives_its_memory_back():
    code = """
import re
import pyarrow as pa
from meshloom.llm import common
anon = lambda: int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) >> 10
def run(batches):
    held = []
    for batch in batches:
        own = [pa.array([bytes(50_000)] * 200) for _ in range(20)]
        blocks = [bytearray(60_000) for _ in range(4000)]
        held.append(blocks[-1])
        yield batch
    keep.extend(held)
keep, before = [], anon()
list(common.lean(run)([1]))
print(anon() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    assert int(out.stdout) < 100


def test_packing_is_exact_and_tight(spark, encoder):
    rows = odd_rows()
    got = packing.pack(documents(spark, rows), capacity=64).collect()
    want = []
    for i, t in rows:
        ids = np.array(ids_of(encoder, t), "<u4")
        want += [(i, k, a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64].tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(x[3] for x in want)
    assert len(bins) <= -(-total // 64) + 1


def test_minimum_slack_takes_the_fullest_combination():
    draw = random.Random(3)
    for _ in range(50):
        counts = {draw.randint(1, 30): draw.randint(1, 3) for _ in range(6)}
        room = draw.randint(1, 60)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= room}
        found = packing.fullest(counts, room)
        assert sum(a * b for a, b in found) == max(sums) and all(b <= counts[a] for a, b in found)
    plan = packing.plan({5: 1000, 3: 7, 2: 1}, 8)
    used = {}
    for bins, pattern in plan:
        for length, times in pattern:
            used[length] = used.get(length, 0) + bins * times
    assert used == {5: 1000, 3: 7, 2: 1}


def test_token_files_round_trip(spark, encoder, tmp_path):
    rows = odd_rows()
    docs = documents(spark, rows)
    manifest = token_files.write_token_files(docs, f"file://{tmp_path}/ids", frame_ids=256)
    got = token_files.read_token_files(spark, manifest).collect()
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(ids_of(encoder, t), "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    path = next(p for _, p, n, _ in manifest if n > 1)
    reader = token_files.ShardReader(path)
    row = len(reader.docs) - 1
    doc = int(reader.docs["id"][row])
    assert reader.document(int(reader.rows_of(doc)[-1])).tolist() == ids_of(encoder, dict(rows)[doc])
    local = path.removeprefix("file://")
    data = bytearray(open(local, "rb").read())
    data[12] ^= 0xFF
    open(local, "wb").write(data)
    with pytest.raises(Exception):  # noqa: B017  the library's or ours
        list(token_files.ShardReader(path))


# Pieces -----------------------------------------------------------------------------


def test_pieces_equal_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_matching.default_vocabulary())
    coder = piece_matching.PieceIds(piece_matching.Pieces.load(piece_matching.default_vocabulary()), limit=3000)
    draw = random.Random(5)
    texts = [t or "" for _, t in odd_rows()] + ["".join(draw.choice("abc the in  ing\n\t▁éß😀") for _ in range(120)) for _ in range(60)] + ["a" * 500, "  x", "日本語テキスト" * 30]
    for t in texts:
        ids = np.frombuffer(coder.encode_all([t])[0], "<u4").tolist()
        assert ids == model.encode(t), repr(t)
        assert coder.pieces.decode(ids).decode() == model.decode(ids)
    rows = odd_rows()
    got = {(r["doc_id"], r["decoded_sha256"]): r for r in piece_matching.round_trip(documents(spark, rows)).collect()}
    for i, t in rows:
        ids = model.encode(t or "")
        r = got[i, hashlib.sha256(model.decode(ids).encode()).hexdigest()]
        assert r["n_ids"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_long_units_are_matched_in_runs(monkeypatch):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_matching.default_vocabulary())
    vocabulary = piece_matching.Pieces.load(piece_matching.default_vocabulary())
    draw = random.Random(15)
    units = ["".join(draw.choice("abcdeghiklmnorstuéß日本xq09") for _ in range(3000)), "a" * 1500, "the" * 700, "x"]
    want = [model.encode(u) for u in units]
    for part, suffixes in ((200, 64), (1 << 19, 1000), (5000, 1 << 18)):
        monkeypatch.setattr(piece_matching, "PART", part)
        monkeypatch.setattr(piece_matching, "SUFFIXES", suffixes)
        got = vocabulary.encode([("▁" + u).encode() for u in units])
        assert [x.tolist() for x in got] == want
    monkeypatch.setattr(piece_matching, "UNITS", 7)
    text = " ".join(draw.choice(["ab", "the", "ing\n", "  x", "日本"]) for _ in range(400))
    assert np.frombuffer(piece_matching.PieceIds(vocabulary).encode_all([text])[0], "<u4").tolist() == model.encode(text)


def test_a_text_of_two_million_letters_without_spaces():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_matching.default_vocabulary())
    vocabulary = piece_matching.Pieces.load(piece_matching.default_vocabulary())
    text = "".join(random.Random(16).choices("abcdefghijklmnopqrstuvwxyz", k=2_000_000))
    assert np.frombuffer(piece_matching.PieceIds(vocabulary).encode_all([text])[0], "<u4").tolist() == model.encode(text)


def test_unigram_takes_the_best_path():
    pieces = [(b"\xe2\x96\x81a", -1.0, 0), (b"b", -2.0, 1), (b"ab", -2.7, 2), (b"\xe2\x96\x81", -0.5, 3), (b"\xe2\x96\x81ab", -4.0, 4), (b"c", -3.0, 5)]
    vocabulary = piece_matching.Pieces(pieces, {b: 100 + b for b in range(256)}, unigram=True)
    unit = "▁ab".encode()
    assert [x.tolist() for x in vocabulary.encode([unit, "▁cc".encode(), b"z"])] == [[0, 1], [3, 5, 5], [100 + ord("z")]]


# Repeated substrings ----------------------------------------------------------------


def test_suffix_array():
    draw = random.Random(6)
    for _ in range(500):
        s = [draw.randint(0, draw.choice([0, 1, 3, 20])) for _ in range(draw.randint(0, 40))]
        assert gsaca.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def plain_substrings(rows):
    seen, out = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        d = (t or "").encode()
        gone = bytearray(len(d))
        for j in range(len(d) - 99):
            if d[j : j + 100] in seen:
                gone[j : j + 100] = b"\1" * 100
            else:
                seen[d[j : j + 100]] = True
        runs = [x for x in bytes(gone).split(b"\0") if x]
        out.append((i, len(d), sum(gone), len(runs), hashlib.sha256(bytes(c for c, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(("hot", "many"), [(20_000, 16), (2, 16), (20_000, 2), (2, 2), (4, 1)])
def test_substring_dedup(spark, monkeypatch, hot, many):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "MANY", many)
    draw = random.Random(7)
    rows = odd_rows()
    passage = "".join(draw.choice("abcdefgh ij") for _ in range(400))
    for k in range(100, 130):
        a, b = draw.randint(0, 250), draw.randint(90, 150)
        rows.append((k, "".join(draw.choice("xyzw ") for _ in range(draw.randint(0, 90))) + passage[a : a + b] + "".join(draw.choice("xyzw ") for _ in range(draw.randint(0, 90))) + passage[a : a + 120]))
    got = sorted(map(tuple, substring_dedup.substring_dedup(documents(spark, rows)).collect()), key=str)
    assert got == sorted(plain_substrings(rows), key=str)


# Near copies ------------------------------------------------------------------------


def test_components(spark):
    draw = random.Random(8)
    edges = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


@pytest.mark.parametrize("small", [64, 5])
def test_near_duplicates(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL_NODES", small)
    monkeypatch.setattr(minhash, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(minhash, "BLOCK_NODES", 16)
    draw = random.Random(9)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = odd_rows()
    for size in (30, 12, 3):
        base = [draw.choice(vocabulary) for _ in range(150)]
        for _ in range(size):
            w = list(base)
            for _ in range(draw.randint(0, 9)):
                w[draw.randrange(150)] = draw.choice(vocabulary)
            rows.append((200 + len(rows), " ".join(w)))
    draw.shuffle(rows)
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
    ids = sorted(i for i in sets if i is not None)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(documents(spark, rows), words=3, threshold=(85, 100)).collect()}
    assert len(got) == len(rows)
    for i in ids:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), find(i), find(i) == i), i
    assert got[None]["component_id"] is None and got[None]["kept"]


def test_links_at_the_threshold_share_a_band():
    draw = np.random.default_rng(10)
    missed = 0
    for num, shared in (([80, 100], 8), ([50, 100], 2)):
        bands, rows = minhash.banding(tuple(num))
        for _ in range(8 if num[0] == 80 else 1):
            x = draw.integers(0, 2**64, (10_000, shared + 2), dtype=np.uint64)
            a, b = (minhash.band_keys(minhash.minima(list(np.delete(x, k, axis=1)), bands * rows), bands, rows) for k in (0, 1))
            missed += int((a != b).all(axis=1).sum())
    assert not missed
    assert minhash.banding((85, 100)) == (32, 6) and minhash.banding((80, 100)) == (38, 5) and minhash.banding((1, 1)) == (32, 6)
    assert (1 - 0.8**5) ** 38 < minhash.MISS


def test_only_like_signatures_tie_members_of_a_bucket():
    import pyarrow as pa

    draw = np.random.default_rng(19)
    base = draw.integers(0, 256, 192, dtype=np.uint8)
    near = base.copy()
    near[:20] = draw.integers(0, 256, 20)
    sigs = [base, near, draw.integers(0, 256, 192, dtype=np.uint8), base, draw.integers(0, 256, 192, dtype=np.uint8)]
    rows = [(b, k, s.tobytes()) for b in (1, 2) for k, s in enumerate(sigs)] + [(3, 9, base.tobytes())]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])], names=["bucket", "id", "sig"])
    got = [tuple(e.values()) for out in minhash._ties(85, 100)([batch.slice(0, 3), batch.slice(3)]) for e in out.to_pylist()]
    assert sorted(got) == [(0, 1), (0, 1), (0, 3), (0, 3)]


def test_signatures_of_links_at_the_threshold_agree():
    draw = np.random.default_rng(20)
    for num, shared in ((85, 17), (80, 8)):
        bands, rows = minhash.banding((num, 100))
        x = draw.integers(0, 2**64, (5000, (20 if num == 85 else 10) * 3), dtype=np.uint64)
        own = shared * 3  # of both; the rest is halved between the two
        a = np.concatenate([x[:, :own], x[:, own : (own + x.shape[1]) // 2]], axis=1)
        b = np.concatenate([x[:, :own], x[:, (own + x.shape[1]) // 2 :]], axis=1)
        least = [minhash.minima(list(s), bands * rows) for s in (a, b)]
        sa, sb = (minhash.signature(m) for m in least)
        assert ((sa == sb).mean(axis=1) >= num / 100 - minhash.SLACK).all()
        assert (minhash.band_keys(least[0], bands, rows) == minhash.band_keys(least[1], bands, rows)).any(axis=1).all()


# Personal data ----------------------------------------------------------------------


def test_plain_spans_equal_the_patterns():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    draw = random.Random(10)
    for _ in range(3000):
        t = "".join(draw.choice("a1.@-+ 9(%") for _ in range(draw.randint(0, 40)))
        got = personal_data.find(t)
        assert [(a, b) for k, a, b in got if k == "email"] == [m.span() for m in email.finditer(t)], t
        assert [(a, b) for k, a, b in got if k == "ip"] == [m.span() for m in ip.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))], t
    personal_data.detect("a" * 200_000 + "@" + "1" * 200_000 + "." * 1000 + " " * 100_000 + "+1" + "(" * 100_000)  # long runs are read once


@pytest.mark.parametrize(
    ("text", "kind", "shown"),
    [
        ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
        ("joe at example dot com", "email", "joe at example dot com"),
        ("to аdmin@exаmple.com!", "email", "аdmin@exаmple.com"),
        ("x a@b​.com y", "email", "a@b​.com"),
        ("call +1 five five five one two three four five six seven", "phone", "+1 five five five one two three four five six seven"),
        ("card ４１１１ １１１１ １１１１ １１１１.", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("at 192[.]168(dot)0 dot 1", "ip", "192[.]168(dot)0 dot 1"),
    ],
)
def test_disguises_map_back(text, kind, shown):
    plain, more = personal_data.detect(text)
    assert [(k, text[a:b]) for k, a, b in more] == [(kind, shown)] and not plain
    assert shown not in personal_data.mask(text) and f"[{kind.upper()}]" in personal_data.mask(text)


@pytest.mark.parametrize("beside", ["", "look, a dot. ", "four one, "])
@pytest.mark.parametrize(
    ("kind", "shown"),
    [
        ("email", "joe [at] example.com"),
        ("email", "joe(at)example.com"),
        ("email", "joe @ example.com"),
        ("email", "joe [ @ ] example.com"),
        ("email", "joe{AT}mail.example.com"),
        ("ip", "1 [ . ] 2.3.4"),
        ("ip", "1.2.3 ( dot ) 4"),
    ],
)
def test_a_single_disguised_sign_is_found_whatever_stands_beside_it(kind, shown, beside):
    text = f"{beside}to {shown}, now"
    plain, more = personal_data.detect(text)
    assert [(k, text[a:b]) for k, a, b in more] == [(kind, shown)] and not plain
    assert personal_data.mask(text) == f"{beside}to [{kind.upper()}], now"


@pytest.mark.parametrize(
    ("text", "kind", "shown"),
    [
        ("joe at mail.example dot com", "email", "joe at mail.example dot com"),
        ("to joe at a.b-c.example (dot) com now", "email", "joe at a.b-c.example (dot) com"),
        ("call +1 five 5 five 1 two 3 four 5 six", "phone", "+1 five 5 five 1 two 3 four 5 six"),
        ("plus 1 five five 5 one 2 three four 5 six now", "phone", "plus 1 five five 5 one 2 three four 5 six"),
        ("+1 five five five 1 2 3 4 5 6 seven", "phone", "+1 five five five 1 2 3 4 5 6 seven"),
        ("card 4 one 1-one 1111 1111 one 1-1 one", "card", "4 one 1-one 1111 1111 one 1-1 one"),
        ("host one 9 two[.]16eight dot 0(dot)1", "ip", "one 9 two[.]16eight dot 0(dot)1"),
        # Beside a number that is whole without it, a word takes nothing away.
        ("10[.]0[.]0[.]255 one of them", "ip", "10[.]0[.]0[.]255"),
        ("10[.]0[.]0[.]1 one of them", "ip", "10[.]0[.]0[.]1"),
        ("４１１１ １１１１ １１１１ １１１１ one", "card", "４１１１ １１１１ １１１１ １１１１"),
    ],
)
def test_disguises_among_plain_signs_and_numerals(text, kind, shown):
    plain, more = personal_data.detect(text)
    assert [(k, text[a:b]) for k, a, b in more] == [(kind, shown)] and not plain


def test_numerals_beside_words_add_nothing():
    for text in ("look at mail.example one dot", "chapter 5 five of 2 two", "12 one-off " * 2000, "1 one " * 20_000 + "x", "1" * 100_000 + " one"):
        assert personal_data.detect(text)[1] == []


def test_personal_data_query(spark):
    rows = odd_rows() + [(80, "a@b.co x 1.2.3.4 x 4111 1111 1111 1111 x +1 (487) 555-7209 x 1.2.3.400"), (81, "look at one dot"), (82, "four one")]
    got = {(r["doc_id"], r["spans"]): r for r in personal_data.personal_data(documents(spark, rows)).collect()}
    r = next(v for (i, _), v in got.items() if i == 80)
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["n_added"]) == (1, 1, 1, 1, 0)
    assert r["spans"] == "email:0:6,ip:9:16,card:19:38,phone:41:58" and r["base_sha256"] == hashlib.sha256(r["spans"].encode()).hexdigest()
    assert got[81, ""]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[0, ""]["n_email"] == 0


# Fingerprints -----------------------------------------------------------------------


def test_fingerprints(spark):
    rows = odd_rows() + [(90, "same text " * 40), (91, "same text " * 40)]
    got = {(r["doc_id"], r["edited_sha256"]): r for r in fingerprints.fingerprints(documents(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    prints = {}
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        r = got[i, hashlib.sha256(fingerprints.edited(t, following).encode()).hexdigest()]
        assert r["n_chars"] == len(t) and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert sum(fingerprints.parse(r["fingerprint"]).values()) == len(t.encode())
        if len(t) > 2000 and len(set(t)) > 5:
            assert r["near_edited"] > 0.6
    assert next(v for (i, _), v in got.items() if i == 90)["near_next"] == 1.0


@pytest.mark.parametrize("least", [1 << 20, 300])
def test_cells_of_far_off_ids(spark, encoder, monkeypatch, tmp_path, least):
    from meshloom.llm import common

    monkeypatch.setattr(common, "LEAST_BYTES", least)
    rows = [(k, f"text {k} " * 20) for k in range(200)] + [(-(1 << 63), "least"), ((1 << 63) - 1, "greatest " * 9), (1 << 62, None), (None, "none"), (None, "none too")]
    random.Random(17).shuffle(rows)
    docs = documents(spark, rows)
    cells = common.Cells(docs)
    sizes = docs.select(cells.of(docs["doc_id"]).alias("c")).selectExpr("shiftright(c, 1) AS c").groupBy("c").count().collect()
    assert len(cells) == 1 if least > 300 else len(cells) > 4 and max(r["count"] for r in sizes) < len(rows) / 2
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = fingerprints.fingerprints(docs).collect()
    want = [(i, hashlib.sha256(fingerprints.edited(t or "", order[(k + 1) % len(order)][1] or "").encode()).hexdigest()) for k, (i, t) in enumerate(order)]
    assert sorted(((r["doc_id"], r["edited_sha256"]) for r in got), key=str) == sorted(want, key=str)
    start = 0
    found = sorted(map(tuple, token_files.round_trip(docs, folder=f"file://{tmp_path}/ids").collect()), key=lambda r: r[1])
    for (i, t), r in zip(order, found, strict=True):
        ids = ids_of(encoder, t)
        assert r == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def plain_chunks(data):
    """The chunks' ends, byte by byte: the gear hash of up to 64 bytes, a stricter mask below the normal size."""
    out, start, mask = [], 0, (1 << 64) - 1
    top = [sum(int(fingerprints._GEAR[data[k - j]]) << j for j in range(min(64, k + 1))) & mask for k in range(len(data))]
    while start < len(data):
        end = min(start + fingerprints.MOST, len(data))
        for k in range(start + fingerprints.LEAST, end + 1):
            bits = fingerprints.STRICT if k < start + fingerprints.NORMAL else fingerprints.LOOSE
            if top[k - 1] >> (64 - bits) == 0:
                end = k
                break
        out.append(end)
        start = end
    return out


def test_chunks_equal_a_plain_chunker():
    draw = random.Random(18)
    texts = [bytes(draw.choice(b"abcdefghijklmnop ,.") for _ in range(n)) for n in (0, 1, 15, 63, 64, 65, 200, 1500, 3000)] + [b"x" * 700, "straße été ".encode() * 50]
    for t, own in zip(texts, fingerprints.chunks(texts), strict=True):
        want, a = {}, 0
        for e in plain_chunks(t):
            d = int(fingerprints.span_hashes(np.frombuffer(t, np.uint8), np.array([a]), np.array([e]))[0])
            want[d] = want.get(d, 0) + e - a
            a = e
        assert own == want


def test_chunks_resist_shifts():
    draw = random.Random(11)
    text = bytes(draw.choice(b"abcdefghijklmnop ") for _ in range(6000))
    a, b = fingerprints.chunks([text, b"new start " + text])
    assert fingerprints.containment(a, b) > 0.95 and fingerprints.containment({}, {}) == 1 and fingerprints.containment({}, a) == 0
    assert fingerprints.chunks([b"x" * 50, text]) == [fingerprints.chunks([b"x" * 50])[0], a]


# Language ---------------------------------------------------------------------------


def test_gradients_of_the_language_network():
    net = language_id.ByteGru(["a", "b"], width=4, embed=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = np.frombuffer(b"abcbca", np.uint8).reshape(2, 3), np.array([0, 1])
    _, g = net.gradients(x, y)
    for name in net.p:
        at = tuple(np.argwhere(np.abs(g[name]) == np.abs(g[name]).max())[0])
        step, old = 1e-3, net.p[name][at]
        losses = []
        for sign in (1, -1):
            net.p[name][at] = old + sign * step
            losses.append(net.gradients(x, y)[0])
        net.p[name][at] = old
        assert abs((losses[0] - losses[1]) / (2 * step) - g[name][at]) < 2e-3, name


def test_language_reader_runs_over_whole_texts(monkeypatch):
    net = language_id.ByteGru(["a", "b", "c"], seed=3)
    for d in "fb":
        net.p[f"a{d}"][net.width : 2 * net.width] = 5  # states that last, which must neither end at a window of a text nor reach the next text
    draw = np.random.default_rng(4)
    texts = [draw.integers(32, 123, 300).astype(np.uint8).tobytes() for _ in range(1500)]
    x = np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), -1)
    y = np.concatenate([net._states(x, "f"), net._states(x[:, ::-1], "b")[::-1]], axis=2) @ net.p["V"] + net.p["c"]
    y = np.exp(y - y.max(axis=2, keepdims=True))
    letter = ((x | 32) >= 97) & ((x | 32) <= 122)
    want = (y / y.sum(axis=2, keepdims=True) * letter.T[:, :, None]).sum(axis=0)
    read, positions = [], language_id.Reader.positions
    monkeypatch.setattr(language_id.Reader, "positions", lambda self, x: read.append(x.size) or positions(self, x))
    got = net.reader().pooled(texts)
    assert (got[:, -1] == letter.sum(axis=1)).all()
    near = np.abs(got[:, :-1] - want).max(axis=1) < 1e-3
    assert near.mean() > 0.75  # the others lie across a window's bound
    assert sum(read) < 1.1 * x.size


def test_language_reader_on_a_text_of_many_windows(monkeypatch):
    net, draw = language_id.ByteGru(["a", "b"], seed=5), np.random.default_rng(6)
    texts = [draw.integers(97, 123, n).astype(np.uint8).tobytes() for n in (1, 40, 5000, 2, 31, 700)]
    whole = net.reader().pooled(texts)
    monkeypatch.setattr(language_id, "LANES", 3)
    monkeypatch.setattr(language_id, "HELD", 1000)
    cut = net.reader().pooled(texts)
    assert (cut[:, -1] == [len(t) for t in texts]).all()
    assert np.allclose(whole, cut, rtol=1e-3, atol=1e-3)
    assert np.allclose(cut[:, :-1].sum(axis=1), cut[:, -1], rtol=1e-5)


def test_language_reader_work_for_a_byte(monkeypatch):
    net, draw = language_id.ByteGru(list("abcd"), seed=7), np.random.default_rng(8)
    texts = [draw.integers(97, 123, 1000).astype(np.uint8).tobytes() for _ in range(300)]
    reader, done, matmul = net.reader(), [], np.matmul
    monkeypatch.setattr(np, "matmul", lambda a, b, out: done.append(out.size * a.shape[-1]) or matmul(a, b, out=out))
    got = reader.pooled(texts)
    monkeypatch.undo()
    # Each way a state takes part in two gates, a new state and the labels; what a byte adds is looked up.
    assert sum(done) < 1.1 * 300_000 * 2 * (3 * net.width**2 + net.width * 4)
    assert np.allclose(got[:, :-1].sum(axis=1), 1000, rtol=1e-5)


def test_language_reader_with_shut_and_open_gates():
    net, draw = language_id.ByteGru(["a", "b"], seed=9), np.random.default_rng(10)
    for d in "fb":
        net.p[f"W{d}"] *= 200  # exponentials overflow
    x = draw.integers(97, 123, (40, 60)).astype(np.uint8)
    y = np.concatenate([net._states(x, "f"), net._states(x[:, ::-1], "b")[::-1]], axis=2) @ net.p["V"] + net.p["c"]
    y = np.exp(y - y.max(axis=2, keepdims=True))
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        got = np.concatenate([net.reader().pooled([t.tobytes()]) for t in x])
    assert np.allclose(got[:, :-1], (y / y.sum(axis=2, keepdims=True)).sum(axis=0), atol=1e-3)


def test_language_id(spark):
    draw = random.Random(12)
    kinds = {"aa": ["katalo", "kimono", "takoma", "mokita"], "bb": ["frühst", "größe", "straße", "schüh"]}
    rows = [(k, " ".join(draw.choice(kinds[lang]) for _ in range(30)), lang) for k in range(200) for lang in (["aa", "bb"][k % 2],)]
    rows += [(300, None, "aa"), (301, "", "bb"), (302, "123 !!", "aa"), (303, "straße " * 2000, None), (None, "kimono", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language_id.learn(docs, per_language=60, per_document=20)
    got = {r["doc_id"]: r for r in language_id.identify(docs, net).collect()}
    for i, _, lang in rows[:200]:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i]["lang_pred"] == lang and 0.5 < got[i]["score"] <= 1
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (300, 301, 302)] == [("und", 0.0)] * 3
    assert got[303]["lang_pred"] == "bb" and got[None]["held_out"] is False
    kept = {r["doc_id"] for r in language_id.accepted(docs, net).collect()}
    assert kept == set(range(200)) | {303, None}


def test_texts_in_no_one_language_go(spark):
    draw = random.Random(13)
    kinds = {"aa": ["katalo", "kimono", "takoma", "mokita"], "bb": ["wespen", "hunger", "felder", "spuren"], "cc": ["divvzy", "ziggyv", "vyzzid", "gyvvix"]}
    rows = [(k, " ".join(draw.choice(kinds[lang]) for _ in range(30)), lang) for k in range(180) for lang in (list(kinds)[k % 3],)]
    for langs in (("aa", "bb"), ("aa", "bb", "cc"), ("aa",)):
        own = [r for r in rows if r[2] in langs]
        odd = [(1000 + k, " ".join(draw.choice(kinds[lang]) for _ in range(20) for lang in langs), None) for k in range(20)]
        docs = spark.createDataFrame(own + odd, "doc_id long, text string, lang string")
        kept = {r["doc_id"] for r in language_id.accepted(docs, language_id.learn(docs, per_language=60, per_document=20)).collect()}
        assert kept == {r[0] for r in own + odd * (len(langs) == 1)}


# Pages ------------------------------------------------------------------------------


def test_blocks_of_tag_soup():
    html = "<html><body><nav><ul><li><a href='x'>A&amp;B</a><li>two</ul></nav><p>one <b>bo<i>ld</b> &eacute;<br>line<p>next&nbsp;par<div hidden>no</div><script>if (a<b) '</p>'</script><!-- <p>no --><table><tr><td>x<td>y</table>tail"
    got = page_blocks.blocks(html)
    assert [b.text for b in got] == ["A&B", "two", "one bold é line", "next par", "x", "y", "tail"]
    assert got[0].linked > 0 and [x[0] for x in got[2].path] == ["html", "body", "p"]
    assert page_blocks.blocks("") == [] and page_blocks.blocks("<p") != [None] and page_blocks.blocks("<" * 3000) is not None


@pytest.mark.parametrize(
    ("attributes", "want"),
    [
        ('href="/hidden-gems"', ((), False)),
        ("href=/hidden", ((), False)),
        ('title="the hidden style=display:none"', ((), False)),
        ('data-hidden="false" data-class="x" data-style="display:none"', ((), False)),
        ('aria-hidden="true" class="icon"', (("icon",), False)),
        ("hidden", ((), True)),
        ("class='mainText' HIDDEN=''", (("main", "text"), True)),
        ('id = side style = "color:red; display : none"', (("side",), True)),
        ("style='visibility:hidden'role=menu", (("menu",), True)),
    ],
)
def test_attributes_are_read_by_name(attributes, want):
    assert page_blocks._names(" " + attributes) == want
    assert [b.text for b in page_blocks.blocks(f"<p>a</p><p {attributes}>b</p><p>c</p>")] == (["a", "c"] if want[1] else ["a", "b", "c"])


def test_gradients_of_the_block_network():
    net = html_text.BlockLstm(inputs=3, width=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    draw = np.random.default_rng(1)
    x, live = html_text.padded([draw.normal(size=(4, 3)).astype(np.float32), draw.normal(size=(2, 3)).astype(np.float32)])
    y = np.zeros(live.shape, bool)
    y[1] = True
    _, g = net.gradients(x, live, y & live)
    for name in net.p:
        at = tuple(np.argwhere(np.abs(g[name]) == np.abs(g[name]).max())[0])
        old, losses = net.p[name][at], []
        for sign in (1, -1):
            net.p[name][at] = old + sign * 1e-3
            losses.append(net.gradients(x, live, y & live)[0])
        net.p[name][at] = old
        assert abs((losses[0] - losses[1]) / 2e-3 - g[name][at]) < 2e-3, name


def test_html_text(spark):
    net = html_text.trained()
    held = [(f, y) for f, y in html_text.sample(80, seed=77)]
    right = sum(((net.probabilities(*html_text.padded([f]))[:, 0] >= 0.5) == y).sum() for f, y in held)
    assert right / sum(len(y) for _, y in held) > 0.96
    page = "<html><body><nav><ul><li><a href=/a>home</a></li><li><a href=/b>news</a></li></ul></nav><article><h1>A title here.</h1><p>The first paragraph says something, at length, of the matter.</p><p>The second&nbsp;one ends it.</p></article><footer>&copy; example.com all rights reserved</footer></body></html>"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "v", ""), (None, "w", "<p>"), (4, "x", "<div>" * 3000)]
    got = html_text.extract(spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, text string"), net=net).collect()
    text = "A title here. The first paragraph says something, at length, of the matter. The second one ends it."
    assert [(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in got][:4] == [(1, "u", text, len(text))] * 2 + [(2, None, "", 0), (3, "v", "", 0)]
    assert len(got) == 6


SAID = " Some words of a longer paragraph that says something of the matter, at length, and then ends."


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<article><h1>T here</h1><p>one" + SAID + "</p", ["T here", "one" + SAID]),
        ("<article><p>one" + SAID + "<a href='x", ["one" + SAID]),
        ("<article><p>one" + SAID + '<a title="x>two</a> more', ["one" + SAID + "two more"]),
        ("<article><p>one" + SAID + "<!-- rest", ["one" + SAID]),
        ("<article><p>Text." + SAID + "</p><datalist id=x><option value=a>Alpha<option>Beta</datalist></article>", ["Text." + SAID]),
        ("<nav class=menu><a href=/a>Home</a> <a href=/b>News</a></nav><div class=article><br>First." + SAID * 2 + "<br><br>Second." + SAID * 2 + "</div><div class=footer>Copyright all rights reserved</div>", ["First." + SAID * 2 + " Second." + SAID * 2]),
        ("<div id=nav><a href=/a>Home</a> <a href=/b>News</a></div><div>First." + SAID * 2 + "<br><br>Second." + SAID * 2 + "</div><div class=footer>Copyright all rights reserved</div>", ["First." + SAID * 2 + " Second." + SAID * 2]),
        ("<table><tr><td><a href=/a>Home</a><br><a href=/b>News</a></td><td><h1>The title of it</h1><p>First." + SAID * 2 + "</p><p>Second." + SAID + "</p></td></tr><tr><td>Copyright all rights reserved</td></tr></table>", ["The title of it", "First." + SAID * 2, "Second." + SAID]),
        ('<header id="masthead"><a href=/>Site</a></header><main id="main"><article class="post"><h1 class="entry-title">The title</h1><div class="entry-content"><p>First.' + SAID * 2 + "</p><p>Second." + SAID * 2 + '</p></div></article><div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts on The title</h2><ol class="comment-list"><li class="comment"><div class="comment-author">Ann says:</div><div class="comment-content"><p>I liked this.' + SAID + "</p></div></li></ol></div></main>", ["The title", "First." + SAID * 2, "Second." + SAID * 2]),
        ("<div class=contenido><h1>El título</h1><p>Primero." + SAID * 2 + "</p><p>Luego." + SAID * 2 + "</p></div><div class=comentarios><h3>Comentarios</h3><p>Me gusta mucho esto." + SAID + "</p></div>", ["El título", "Primero." + SAID * 2, "Luego." + SAID * 2]),
    ],
)
def test_main_text_of_pages_labelled_by_hand(html, want):
    assert html_text.main_texts(html_text.trained(), [f"<html><body>{html}"]) == [" ".join(" ".join(want).split())]


def test_a_page_of_very_many_blocks_is_read_whole():
    html = "<html><body><article>" + "".join(f"<p>Paragraph {k}.{SAID}</p>" for k in range(20_000)) + "</article></body></html>"
    text = html_text.main_texts(html_text.trained(), [html])[0]
    assert text.count("Paragraph") > 19_900


# Empty tables -----------------------------------------------------------------------


def test_empty_tables(spark):
    docs = documents(spark, [])
    assert language_id.learn(docs) is None
    for made in (
        exact_dedup.exact_dedup(docs), packing.pack(docs), token_files.round_trip(docs), substring_dedup.substring_dedup(docs), minhash.near_duplicates(docs),
        personal_data.personal_data(docs), fingerprints.fingerprints(docs), piece_matching.round_trip(docs), language_id.identify(docs, None),
    ):
        assert made.count() == 0
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
