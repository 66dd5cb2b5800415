"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a text both ways and labels every position; a
document's probabilities are the mean over the positions of all its letters (a
byte above 127 counts as one). Texts are laid out one after the other, both states
beginning anew between them, and read in windows of up to ``SPAN`` labelled
positions, many side by side: the forward state enters a window from ``CONTEXT``
bytes before it, the backward state from as many after it, so that both run on
across words and across windows' bounds, and a text is never cut short.

It is trained here, by backpropagation through time in numpy, on a bounded
sample of the labelled rows: ``per_language`` documents of each language, the
first by a hash of their id, and ``per_document`` passages of each, of the
lengths ``PASSAGES``, drawn by the id, and half as many more in which words of
two of them take turns, each position keeping its label, so that a label says
what stands there and not what stood before. Rows whose crc32(id as text) mod 4
is 2 are held out and never read.

Defined results: a text that is null or has no letter, or any text where
nothing could be learned, is ``und`` with score 0. Of labels that tie the first
in their order is predicted. A null id is neither held out nor learned from; of
rows that share an id and a label the least text is learned from. Repeated rows
get equal results; extra columns go, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.llm.common import id_and_text, lean, slices

UNKNOWN = "und"
WIDTH, EMBED = 24, 16
PER_LANGUAGE, PER_DOCUMENT, EPOCHS = 400, 8, 3
#: Bytes of the passages that are learned from: half are of the last length, where a text has so many.
PASSAGES = (12, 32, 96)
#: Positions that a window labels at most, and bytes on both sides from which the states enter it.
SPAN, CONTEXT = 2048, 32
#: Windows that are read side by side, and bytes of texts that are laid out at a time; a longer text is laid out whole.
LANES, HELD = 256, 512 << 10
#: A text stays from this share of the way between an even score of all labels and 1 on.
LEAST = 0.12
#: The byte that stands for none, between texts, at which a state begins anew.
NONE = 256
_LETTER = np.zeros(NONE + 1, np.float32)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_HAS_LETTER = re.compile(r"[^\W\d_]")
_WORD = re.compile(rb"\s*\S+|\s+")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class ByteGru:
    """Embedding, a gated recurrent layer each way, and a softmax at every position."""

    def __init__(self, labels: list[str], width: int = WIDTH, embed: int = EMBED, seed: int = 1):
        draw = np.random.default_rng(seed)
        f = np.float32
        self.labels, self.width = list(labels), width
        self.p = {"E": draw.normal(0, 0.5, (256, embed)).astype(f), "V": draw.normal(0, 0.2, (2 * width, len(labels))).astype(f), "c": np.zeros(len(labels), f)}
        for d in "fb":
            self.p |= {f"W{d}": draw.normal(0, embed**-0.5, (embed, 3 * width)).astype(f), f"U{d}": draw.normal(0, width**-0.5, (width, 3 * width)).astype(f), f"a{d}": np.zeros(3 * width, f)}

    def _states(self, x: np.ndarray, d: str, keep: bool = False):
        """(positions, words, width) of the layer that reads the columns of x in order."""
        n, u = self.width, self.p[f"U{d}"]
        table = self.p["E"] @ self.p[f"W{d}"] + self.p[f"a{d}"]
        h = np.zeros((len(x), n), np.float32)
        out = np.empty((x.shape[1], len(x), n), np.float32)
        steps = []
        for t in range(x.shape[1]):
            g, own = table[x[:, t]], h @ u
            rz = _sigmoid(g[:, : 2 * n] + own[:, : 2 * n])
            r, z = rz[:, :n], rz[:, n:]
            new = np.tanh(g[:, 2 * n :] + r * own[:, 2 * n :])
            if keep:
                steps.append((h, r, z, new, own[:, 2 * n :]))
            h = new + z * (h - new)
            out[t] = h
        return (out, steps) if keep else out

    def reader(self) -> Reader:
        return Reader(self)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean loss over positions and its gradients, back through time; y has a label for each row of x or each of its positions."""
        n, p = self.width, self.p
        y = np.broadcast_to(y if y.ndim == 2 else y[:, None], x.shape).T
        sf, kf = self._states(x, "f", True)
        sb, kb = self._states(x[:, ::-1], "b", True)
        both = np.concatenate([sf, sb[::-1]], axis=2)
        logits = both @ p["V"] + p["c"]
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        count = x.size
        at = np.arange(x.shape[1])[:, None], np.arange(len(x)), y
        loss = float(-np.log(prob[at] + 1e-9).sum() / count)
        prob[at] -= 1
        prob /= count
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["V"] = both.reshape(-1, 2 * n).T @ prob.reshape(-1, prob.shape[2])
        g["c"] = prob.sum(axis=(0, 1))
        down = prob @ p["V"].T
        for d, steps, up, seq in (("f", kf, down[:, :, :n], x), ("b", kb, down[::-1, :, n:], x[:, ::-1])):
            u, w = p[f"U{d}"], p[f"W{d}"]
            dh = np.zeros((len(x), n), p["c"].dtype)
            inputs = np.empty((x.shape[1], len(x), 3 * n), p["c"].dtype)
            for t in range(x.shape[1] - 1, -1, -1):
                h, r, z, new, own = steps[t]
                dh = dh + up[t]
                dnew = dh * (1 - z) * (1 - new * new)
                dr = dnew * own * r * (1 - r)
                dz = dh * (h - new) * z * (1 - z)
                gates = np.concatenate([dr, dz, dnew * r], axis=1)
                np.concatenate([dr, dz, dnew], axis=1, out=inputs[t])
                g[f"U{d}"] += h.T @ gates
                dh = dh * z + gates @ u.T
            # What the positions of a byte add up to is its row's share of the table E @ W + a.
            order = np.argsort(seq.T, axis=None, kind="stable")
            found, first = np.unique(seq.T.ravel()[order], return_index=True)
            rows = np.add.reduceat(inputs.reshape(-1, 3 * n)[order], first)
            g[f"a{d}"] = rows.sum(axis=0)
            g[f"W{d}"] = p["E"][found].T @ rows
            g["E"][found] += rows @ w.T
        return loss, g

    def train(self, passages: list[bytes], labels: list, epochs: int = EPOCHS, batch: int = 256, rate: float = 0.01, seed: int = 2) -> list[float]:
        """Adam over batches of passages of one length, each with a label or one for each position; returns the losses."""
        draw, groups = np.random.default_rng(seed), defaultdict(list)
        for w, y in zip(passages, labels, strict=True):
            groups[len(w)].append((w, y))
        first, second, t, losses = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0, []
        for epoch in range(epochs):
            todo = []
            for own in groups.values():
                order = draw.permutation(len(own))
                todo += [[own[k] for k in order[a : a + batch]] for a in range(0, len(own), batch)]
            for k in draw.permutation(len(todo)):
                x = np.frombuffer(b"".join(w for w, _ in todo[k]), np.uint8).reshape(len(todo[k]), -1)
                loss, g = self.gradients(x, np.array([np.broadcast_to(y, len(w)) for w, y in todo[k]]))
                losses.append(loss)
                norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                t += 1
                step = rate * (0.4**epoch) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                for name, v in g.items():
                    v *= min(1.0, 1 / (norm + 1e-9))
                    first[name] += 0.1 * (v - first[name])
                    second[name] += 0.001 * (v * v - second[name])
                    self.p[name] -= (step * first[name] / (np.sqrt(second[name]) + 1e-8)).astype(np.float32)
        return losses


class Reader:
    """A network's weights as its recurrence reads them, with a row for no byte, and the labels of whole texts.

    Arrays have both directions one after the other, a row for each window and a
    column for each unit, so that what a byte adds to a window's units is one row of
    a table, copied at once, and what a step touches lies together.
    """

    def __init__(self, net: ByteGru):
        n, f, self.net = net.width, np.float32, net
        w, u = np.zeros((2, NONE + 1, 3 * n), f), np.stack([net.p[f"U{d}"] for d in "fb"])
        w[:, :NONE] = [net.p["E"] @ net.p[f"W{d}"] + net.p[f"a{d}"] for d in "fb"]
        # No byte shuts both gates, so that the state is 0.
        w[:, NONE, : 2 * n] = -1000
        # A gate is 1 / (1 + exp(-x)), a new state 1 - 2 / (1 + exp(2 x)), which is quicker than by tanh; the factors are in the weights.
        factor = np.array([-1, -1, 2], f)[:, None, None, None]
        self.bytes, self.own = (np.ascontiguousarray(x.reshape(2, -1, 3, n).transpose(2, 0, 1, 3) * factor, f) for x in (w, u))
        self.bytes = self.bytes.reshape(-1, n)
        self.out = np.ascontiguousarray(net.p["V"].reshape(2, n, -1).transpose(0, 2, 1), f)
        # Windows of many labels are shorter.
        self.span = max(8 * CONTEXT, 4 * SPAN // max(4, len(net.labels)))

    def positions(self, x: np.ndarray) -> np.ndarray:
        """(positions, labels, windows): the probabilities at the positions between both contexts of windows, x (bytes, windows)."""
        n, lanes, steps, f = self.net.width, x.shape[1], len(x) - 2 * CONTEXT, np.float32
        h, own, read = np.zeros((2, lanes, n), f), np.empty((3, 2, lanes, n), f), np.empty((3, 2, lanes, n), f)
        (r, z, add), new, gates, gates_read, columns = own, read[2], own[:2], read[:2], h.swapaxes(1, 2)
        y, some = np.empty((steps, self.out.shape[1], lanes), f), np.empty((CONTEXT, 2, self.out.shape[1], lanes), f)
        y[:] = self.net.p["c"][:, None]
        table, rows = np.arange(6).reshape(3, 2, 1) * (NONE + 1), np.empty((CONTEXT, 3, 2, lanes), np.intp)
        # An exponential may be infinite: its gate is 0, its new state 1.
        with np.errstate(over="ignore"):
            for at in range(-CONTEXT, steps, CONTEXT):
                found, a = some[: min(CONTEXT, steps - at)], at + CONTEXT
                np.add(np.stack([part[a : a + len(found)] for part in (x, x[::-1])], axis=1)[:, None], table, out=rows[: len(found)])
                for k in range(len(found)):
                    self.bytes.take(rows[k], axis=0, out=read, mode="clip")
                    np.matmul(h, self.own, out=own)
                    np.add(gates, gates_read, out=gates)
                    np.exp(gates, out=gates)
                    np.add(gates, 1, out=gates)
                    np.divide(add, r, out=add)
                    np.add(new, add, out=new)
                    np.exp(new, out=new)
                    np.add(new, 1, out=new)
                    np.divide(-2, new, out=new)
                    np.add(new, 1, out=new)
                    np.subtract(h, new, out=h)
                    np.divide(h, z, out=h)
                    np.add(h, new, out=h)
                    np.matmul(self.out, columns, out=found[k])
                if at >= 0:
                    y[at : at + len(found)] += found[:, 0]
                    y[steps - at - len(found) : steps - at] += found[::-1, 1]
        for part in np.split(y, range(CONTEXT, len(y), CONTEXT)):
            part -= part.max(axis=1, keepdims=True)
            np.exp(part, out=part)
            part /= part.sum(axis=1, keepdims=True)
        return y

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """(texts, labels + 1): the sums over the positions of each text's letters, and their number."""
        out, held, total = np.zeros((len(texts), len(self.net.labels) + 1)), 0, 0
        for k, t in enumerate(texts):
            if k > held and total + len(t) > HELD:
                self._pool(texts[held:k], out[held:k])
                held, total = k, 0
            total += len(t)
        if held < len(texts):
            self._pool(texts[held:], out[held:])
        return out

    def _pool(self, texts: list[bytes], out: np.ndarray) -> None:
        size = np.array([len(t) + 1 for t in texts])
        total, end = int(size.sum()), np.cumsum(size)
        first = end - size
        n = min(self.span, max(8 * CONTEXT, -(-total // LANES)))
        count = -(-total // n)
        data = np.full(count * n + 2 * CONTEXT, NONE, np.uint16)
        data[CONTEXT : CONTEXT + total - 1] = np.frombuffer(b" ".join(texts), np.uint8)
        data[CONTEXT - 1 + end] = NONE
        windows = np.lib.stride_tricks.sliding_window_view(data, n + 2 * CONTEXT)[::n]
        for k in range(0, count, LANES):
            x = np.ascontiguousarray(windows[k : k + LANES].T, dtype=np.intp)
            seen, letter = self.positions(x), _LETTER[x[CONTEXT:-CONTEXT]]
            seen *= letter[:, None]
            # The texts of these windows, and where each begins in them.
            lo, hi = k * n, k * n + letter.size
            own = slice(int(np.searchsorted(first, lo, "right")) - 1, int(np.searchsorted(first, hi)))
            cuts = np.maximum(first[own] - lo, 0)
            for label in range(seen.shape[1]):
                out[own, label] += np.add.reduceat(seen[:, label].T.ravel(), cuts, dtype=np.float64)
            out[own, -1] += np.add.reduceat(letter.T.ravel(), cuts, dtype=np.float64)


def mixed(pairs: list[tuple[int, bytes]], seed: int = 5) -> list[tuple[bytes, np.ndarray]]:
    """Half as many passages in which runs of words of two labels take turns, with the label of each byte."""
    draw, out = np.random.default_rng(seed), []
    for k in draw.permutation(len(pairs))[: len(pairs) // 2].tolist():
        other = int(draw.integers(len(pairs)))
        sides, labels = [_WORD.findall(pairs[j][1]) for j in (k, other)], (pairs[k][0], pairs[other][0])
        if labels[0] == labels[1]:
            continue
        most, parts, marks, side, at = int(draw.choice([1, 2, 8])), [], [], 0, [0, 0]
        while any(a < len(words) for a, words in zip(at, sides, strict=True)):
            n = int(draw.integers(1, most + 1))
            run = b"".join(sides[side][at[side] : at[side] + n])
            at[side] += n
            parts.append(run)
            marks.append(np.full(len(run), labels[side]))
            side = 1 - side
        n = max(x for x in PASSAGES if x <= max(PASSAGES[0], sum(map(len, parts))))
        text = b"".join(parts)[:n]
        out.append((text, np.concatenate(marks)[:n]))
    return out


def held_out(i: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(i.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, per_document: int = PER_DOCUMENT, epochs: int = EPOCHS) -> ByteGru | None:
    """A network fitted on the bounded sample; none where no row is labelled."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    rows = rows.where(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("id").alias("n")).collect()}
    if not counts:
        return None
    # Ids below a bound of their hash, about twice as many as are wanted, so that none but these meet.
    place, most = F.pmod(F.xxhash64("id"), F.lit(1 << 40)), 1 << 40
    bound = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, most if n <= 2 * per_language + 200 else most * (2 * per_language + 200) // n)])[F.col("lang")]
    near = rows.select("id", "lang", place.alias("place")).where(F.col("place") < bound).distinct().collect()
    by_lang: dict[str, list] = defaultdict(list)
    for r in near:
        by_lang[r["lang"]].append((r["place"], r["id"]))
    chosen = sorted({i for own in by_lang.values() for _, i in sorted(own)[:per_language]})

    def draw_passages(batches):
        for batch in batches:
            langs, passages = [], []
            for i, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not _HAS_LETTER.search(text):
                    continue
                own, draw = text.encode(), np.random.default_rng(i % (1 << 63))
                for k in range(per_document):
                    n = min(len(own), PASSAGES[-1] if k % 2 == 0 else PASSAGES[k // 2 % (len(PASSAGES) - 1)])
                    a = 0 if k == 0 else int(draw.integers(len(own) - n + 1))
                    langs.append(lang)
                    passages.append(own[a : a + n])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(passages, pa.binary())], names=["lang", "passage"])

    sample = rows.where(F.col("id").isin(chosen)).groupBy("id", "lang").agg(F.min("text").alias("text")).mapInArrow(draw_passages, "lang string, passage binary").collect()
    pairs = sorted((r["lang"], bytes(r["passage"])) for r in sample)
    if not pairs:
        return None
    labels = sorted({lang for lang, _ in pairs})
    place_of = {x: k for k, x in enumerate(labels)}
    net = ByteGru(labels)
    own = [(place_of[x], w) for x, w in pairs]
    more = mixed(own)
    net.train([w for _, w in own] + [w for w, _ in more], [y for y, _ in own] + [y for _, y in more], epochs)
    return net


def predict(reader: Reader | None, texts: list[str]) -> list[tuple[str, float]]:
    """The label and its share of each text."""
    spoken = [k for k, t in enumerate(texts) if t and _HAS_LETTER.search(t)] if reader else []
    out = [(UNKNOWN, 0.0)] * len(texts)
    if spoken:
        for k, own in zip(spoken, reader.pooled([texts[k].encode() for k in spoken]), strict=True):
            p = own[:-1] / own[-1]
            best = int(p.argmax())
            out[k] = (reader.net.labels[best], float(min(1.0, p[best])))
    return out


def identify(docs: DataFrame, net: ByteGru | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of each of ``docs``; only the text is read for a prediction."""

    def run(batches):
        reader = net.reader() if net else None
        for batch in batches:
            got = predict(reader, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = id_and_text(docs, id_col, text_col).select("id", held_out(F.col("id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def threshold(labels: int, least: float = LEAST) -> float:
    """The score that lies ``least`` of the way from what pure chance gives among so many labels to 1."""
    return 1 / labels + least * (1 - 1 / labels) if labels > 1 else 0.0


def accepted(docs: DataFrame, net: ByteGru | None, least: float = LEAST, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with a score of ``threshold`` or more; of one label, all with letters."""
    bound = threshold(len(net.labels), least) if net else 0.0

    def run(batches):
        reader = net.reader() if net else None
        for batch in slices(batches):
            keep = [x != UNKNOWN and s >= bound for x, s in predict(reader, batch.column(batch.schema.get_field_index(text_col)).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
