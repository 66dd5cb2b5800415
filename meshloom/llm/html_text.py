"""Main text of web pages by a recurrent block labeller.

A page's leaf blocks, in order, are the steps of a bidirectional long
short-term memory network in numpy. A step reads the hashed names along the
block's tag path, its hashed words, and a few sizes; both directions carry the
context of the whole page to each block's label. The blocks labelled as the
article's are joined.

No table has labels for blocks, so the network is trained here, by
backpropagation through time, on pages that ``draw_page`` makes from a fixed
seed: page layouts (with elements that say what they are, with names alone, in
tables, with line breaks for paragraphs), the names that sites give to the parts
of a page, and words that are the signs of such parts, with each block's label.
The number of pages is a parameter; no row of the input is learned from, though
some of the shapes drawn, such as words in capitals, were seen in the tables that
this was tried on.

Defined results: a null or empty page, or one without an article, has an empty
text; of a page that is cut off in a tag or comment that rest is no text. A page
of any length is read whole, by itself if it has many blocks. Repeated rows get
equal results; extra columns go, whatever their names. An empty table gives an
empty result.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.llm.page_blocks import Block, blocks

PATHS, WORDS, SIZES, WIDTH = 128, 64, 8, 24
PAGES, EPOCHS = 1300, 9
#: Blocks that are labelled at a time.
STEPS = 1 << 14

# Names that sites give to parts of a page, by whether the part is the article's, and words of parts that aren't.
ARTICLE_NAMES = "article content main post entry story body text page-content post-content entry-content article-body story-body main-content blog-post single markdown prose".split()
OTHER_NAMES = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topnav main-menu site-nav pagination pager toc".split(),
    "header": "header masthead site-header top-bar topbar banner branding logo page-header".split(),
    "footer": "footer site-footer page-footer bottom colophon copyright legal".split(),
    "sidebar": "sidebar side aside widget widget-area rail right-column related recommended popular trending tags tag-cloud more-stories".split(),
    "notice": "cookie cookies consent cookie-banner gdpr notice alert popup modal overlay newsletter subscribe subscription paywall promo".split(),
    "advert": "ad ads advert advertisement sponsored sponsor banner-ad adslot promo-box dfp".split(),
    "form": "form search search-form login signup contact-form newsletter-form comment-form respond".split(),
    "comments": "comments comment comment-list commentlist comment-body comment-content comment-respond reply replies discussion disqus responses user-comment reader-comments thread comentarios comentario commentaires kommentare kommentar commenti reacties comentários".split(),
    "share": "share social sharing social-links share-bar follow buttons byline meta author-bio".split(),
}
OTHER_WORDS = {
    "menu": "home about contact news sports products services blog archive categories login register next previous".split(),
    "header": "welcome menu search login sign in your account language".split(),
    "footer": "copyright all rights reserved privacy policy terms of use imprint contact sitemap powered by ©".split(),
    "sidebar": "related articles popular posts recent trending tags archives categories read more see also".split(),
    "notice": "we use cookies accept agree consent privacy settings subscribe newsletter this site uses continue please disable".split(),
    "advert": "advertisement sponsored buy now sale offer discount free shipping click here shop".split(),
    "form": "name email message submit search subscribe password sign up send your address".split(),
    "comments": "reply said says posted ago comments comment like report thanks great post agree user at am pm comentarios commentaires kommentare responses thoughts leave responder antworten répondre dijo schrieb dit".split(),
    "share": "share tweet facebook twitter email print follow us by posted on author".split(),
}


def _bucket(word: str, n: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % n


@lru_cache(1 << 16)
def _word(word: str) -> int:
    return _bucket(word.strip(".,:;!?()\"'").lower(), WORDS)


@lru_cache(1 << 12)
def _path_vector(path: tuple) -> tuple[int, ...]:
    """The buckets of a path's tags and names; the innermost tag counts once more by itself."""
    out = [_bucket(f"tag {name}", PATHS) for name, _, _ in path]
    out += [_bucket(f"name {w}", PATHS) for _, words, _ in path for w in words]
    return tuple(out) + ((_bucket(f"leaf {path[-1][0]}", PATHS),) if path else ())


def features(page: list[Block]) -> np.ndarray:
    """(blocks, inputs)."""
    out = np.zeros((len(page), PATHS + WORDS + SIZES), np.float32)
    total = sum(len(b.text) for b in page) + 1
    before = 0
    for k, b in enumerate(page):
        row = out[k]
        for j in _path_vector(b.path):
            row[j] = min(row[j] + 1.0, 2.0)
        words = b.text.split()
        part = np.bincount([_word(w) for w in words], minlength=WORDS)
        row[PATHS : PATHS + WORDS] = part / max(1.0, float(np.sqrt((part * part).sum())))
        n = len(b.text)
        row[-SIZES:] = (
            np.log1p(n) / 5,
            np.log1p(len(words)) / 4,
            b.linked / n,
            (b.text[-1] in ".!?:\"”)»…"),
            before / total,
            n / total * 3,
            min(1.0, (b.text.count(",") + b.text.count(".") + b.text.count(";")) / (len(words) + 1) * 2),
            len(b.path) / 8,
        )
        before += n
    return out


class BlockLstm:
    """A long short-term memory layer each way and a logistic label for each step."""

    def __init__(self, inputs: int = PATHS + WORDS + SIZES, width: int = WIDTH, seed: int = 3):
        draw, f = np.random.default_rng(seed), np.float32
        self.width = width
        self.p = {"V": draw.normal(0, 0.2, 2 * width).astype(f), "c": np.zeros(1, f)}
        for d in "fb":
            bias = np.zeros(4 * width, f)
            bias[width : 2 * width] = 1  # remember at first
            self.p |= {f"W{d}": draw.normal(0, inputs**-0.5, (inputs, 4 * width)).astype(f), f"U{d}": draw.normal(0, width**-0.5, (width, 4 * width)).astype(f), f"a{d}": bias}

    def _states(self, x: np.ndarray, live: np.ndarray, d: str, keep: bool = False):
        """x (steps, pages, inputs), live (steps, pages): the states of a reader of the steps, d being f forwards or b backwards; where a page has none, they stand."""
        n, u = self.width, self.p[f"U{d}"]
        drive = (x.reshape(-1, x.shape[2]) @ self.p[f"W{d}"] + self.p[f"a{d}"]).reshape(*x.shape[:2], -1)
        if d == "b":
            drive, live = drive[::-1], live[::-1]
        h = np.zeros((x.shape[1], n), np.float32)
        c = np.zeros_like(h)
        out, steps = np.empty((len(x), *h.shape), np.float32), []
        for t in range(len(x)):
            g = drive[t] + h @ u
            s = 1 / (1 + np.exp(-np.clip(g[:, : 3 * n], -30, 30)))
            i, f, o, new = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :], np.tanh(g[:, 3 * n :])
            on = live[t][:, None]
            c2 = f * c + i * new
            tc = np.tanh(c2)
            if keep:
                steps.append((h, c, i, f, o, new, tc, on))
            c = np.where(on, c2, c)
            h = np.where(on, o * tc, h)
            out[t] = h
        return (out, steps) if keep else out

    def probabilities(self, x: np.ndarray, live: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._states(x, live, "f"), self._states(x, live, "b")[::-1]], axis=2)
        return 1 / (1 + np.exp(-np.clip(both @ self.p["V"] + self.p["c"], -30, 30)))

    def gradients(self, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """The mean loss over live steps and its gradients, back through time."""
        n, p = self.width, self.p
        sf, kf = self._states(x, live, "f", True)
        sb, kb = self._states(x, live, "b", True)
        both = np.concatenate([sf, sb[::-1]], axis=2)
        prob = 1 / (1 + np.exp(-np.clip(both @ p["V"] + p["c"], -30, 30)))
        count = live.sum()
        loss = float(-(np.log(np.where(y, prob, 1 - prob) + 1e-7) * live).sum() / count)
        delta = ((prob - y) * live / count).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["V"], g["c"] = np.einsum("tbh,tb->h", both, delta), np.array([delta.sum()])
        down = delta[:, :, None] * p["V"]
        for d, steps, up in (("f", kf, down[:, :, :n]), ("b", kb, down[::-1, :, n:])):
            u = p[f"U{d}"]
            dh = np.zeros((x.shape[1], n), np.float32)
            dc = np.zeros_like(dh)
            gates = np.zeros((len(x), x.shape[1], 4 * n), np.float32)
            for t in range(len(x) - 1, -1, -1):
                h, c, i, f, o, new, tc, on = steps[t]
                dh = dh + up[t]
                own, dcell = np.where(on, dh, 0), np.where(on, dc, 0)
                dcell = dcell + own * o * (1 - tc * tc)
                gate = np.concatenate([dcell * new * i * (1 - i), dcell * c * f * (1 - f), own * tc * o * (1 - o), dcell * i * (1 - new * new)], axis=1)
                gates[t] = gate
                g[f"U{d}"] += h.T @ gate
                dh = np.where(on, gate @ u.T, dh)
                dc = np.where(on, dcell * f, dc)
            own = np.ascontiguousarray(gates if d == "f" else gates[::-1])
            g[f"W{d}"] = x.reshape(-1, x.shape[2]).T @ own.reshape(-1, 4 * n)
            g[f"a{d}"] = gates.sum(axis=(0, 1))
        return loss, g

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, batch: int = 32, rate: float = 0.01, seed: int = 4) -> list[float]:
        """Adam over batches of pages of like length; returns the losses."""
        draw = np.random.default_rng(seed)
        order = sorted(range(len(pages)), key=lambda k: len(pages[k][0]))
        groups = [order[a : a + batch] for a in range(0, len(order), batch)]
        first, second, t, losses = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0, []
        for epoch in range(epochs):
            for k in draw.permutation(len(groups)):
                x, live = padded([pages[j][0] for j in groups[k]])
                y = np.zeros(live.shape, bool)
                for j, own in enumerate(groups[k]):
                    y[: len(pages[own][1]), j] = pages[own][1]
                loss, g = self.gradients(x, live, y)
                losses.append(loss)
                norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                t += 1
                step = rate * 0.7**epoch * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                for name, v in g.items():
                    v = v * min(1.0, 1 / (norm + 1e-9))
                    first[name] += 0.1 * (v - first[name])
                    second[name] += 0.001 * (v * v - second[name])
                    self.p[name] = (self.p[name] - step * first[name] / (np.sqrt(second[name]) + 1e-8)).astype(np.float32)
        return losses


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(steps, pages, inputs) and which steps each page has."""
    x = np.zeros((max(len(p) for p in pages), len(pages), pages[0].shape[1]), np.float32)
    live = np.zeros(x.shape[:2], bool)
    for k, p in enumerate(pages):
        x[: len(p), k], live[: len(p), k] = p, True
    return x, live


def draw_page(draw: np.random.Generator) -> tuple[str, list[tuple[str, bool]]]:
    """A page and its blocks' (text, whether it is the article's), in order."""
    letters = "etaoinshrdlucmfwygpbvkéèüöäßñóçí"
    vocabulary = ["".join(letters[int(k)] for k in np.minimum(draw.geometric(0.12, draw.integers(1, 10)) - 1, len(letters) - 1)) for _ in range(120)]
    if draw.random() < 0.15:  # few words, over and over
        vocabulary = vocabulary[: int(draw.integers(1, 6))]
    if draw.random() < 0.1:
        vocabulary = [w.upper() + "!!" if draw.random() < 0.9 else w for w in vocabulary]
    elif draw.random() < 0.1:
        vocabulary = [w + "#$%|*&"[int(draw.integers(6))] * int(draw.integers(1, 4)) for w in vocabulary]
    out: list[str] = []
    truth: list[tuple[str, bool]] = []
    plain = draw.random() < 0.25  # names that say nothing

    def pick(items):
        return items[int(draw.integers(len(items)))]

    def prose(n: int) -> str:
        words = [pick(vocabulary) for _ in range(max(1, n))]
        for k in range(0, len(words), int(draw.integers(4, 14))):
            words[k] = words[k].capitalize()
            if k:
                words[k - 1] += pick([".", ".", ",", "!", "?"])
        return " ".join(words) + pick([".", ".", ".", "", "!"])

    def name(words) -> str:
        if plain or draw.random() < 0.15:
            return pick(["", f' class="c{int(draw.integers(99))}"', f' id="x{int(draw.integers(99))}"'])
        return f' {pick(["class", "class", "id"])}="{pick(words)}{pick(["", "", " wide", " box", " col-8"])}"'

    def say(tag: str, text: str, main: bool, link: bool = False, extra: str = "") -> None:
        shown = text.replace("&", "&amp;")
        out.append(f"<{tag}{extra}>" + (f'<a href="/{int(draw.integers(999))}">{shown}</a>' if link else shown) + (f"</{tag}>" if tag != "p" or draw.random() < 0.7 else ""))
        truth.append((" ".join(text.split()), main))

    def other(kind: str) -> None:
        tags = {"menu": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "sidebar": ["aside", "div", "section"], "form": ["form", "div"], "comments": ["section", "div", "ol"]}
        tag = pick(tags.get(kind, ["div", "div", "section", "aside"]))
        out.append(f"<{tag}{'' if tag in ('nav', 'footer', 'header', 'aside', 'form') and draw.random() < 0.5 else name(OTHER_NAMES[kind])}>")
        if kind in ("menu", "sidebar", "share"):
            if kind == "sidebar" or draw.random() < 0.2:
                say(pick(["h2", "h3", "h4", "div"]), " ".join(pick(OTHER_WORDS[kind]) for _ in range(int(draw.integers(1, 4)))).capitalize(), False)
            out.append("<ul>")
            for _ in range(int(draw.integers(2, 9))):
                say("li", pick(OTHER_WORDS[kind]).capitalize() if draw.random() < 0.4 else prose(int(draw.integers(1, 6))).rstrip("."), False, draw.random() < 0.9)
            out.append("</ul>")
        elif kind == "comments":
            heading = [f"{int(draw.integers(1, 99))} {pick(['comments', 'responses', 'replies', 'comentarios', 'commentaires', 'Kommentare', 'thoughts'])}", pick(["Comments", "Comentarios", "Commentaires", "Kommentare", "Discussion", "Leave a reply"])]
            if draw.random() < 0.85:
                say(pick(["h2", "h3", "h4"]), pick(heading) + (f" {pick(['on', 'to'])} {prose(int(draw.integers(1, 8)))}" if draw.random() < 0.2 else ""), False)
            for _ in range(int(draw.integers(1, 6))):
                out.append(f"<{'li' if tag == 'ol' else 'div'}{name(OTHER_NAMES[kind])}>")
                if draw.random() < 0.7:
                    say("div", f"{pick(vocabulary).capitalize()} {pick(['says', 'said', 'wrote', 'posted', 'dijo', 'schrieb', 'a écrit', 'says:'])}", False)
                for _ in range(int(draw.integers(1, 3))):
                    say("p", prose(int(draw.integers(4, 60))), False)
                if draw.random() < 0.5:
                    say("div", pick(["Reply", "Reply", "Responder", "Antworten", "Répondre"]), False, True)
                out.append(f"</{'li' if tag == 'ol' else 'div'}>")
        elif kind == "form":
            for _ in range(int(draw.integers(1, 4))):
                say(pick(["label", "p", "div"]) if draw.random() < 0.7 else "p", " ".join(pick(OTHER_WORDS[kind]) for _ in range(int(draw.integers(1, 5)))).capitalize(), False)
                out.append(pick(['<input type="text">', "<br>", "<div></div>"]))
        else:
            for _ in range(int(draw.integers(1, 4))):
                words = OTHER_WORDS[kind]
                text = " ".join(pick(words) if draw.random() < 0.6 else pick(vocabulary) for _ in range(int(draw.integers(2, 25)))) if draw.random() < 0.6 else prose(int(draw.integers(2, 25)))
                say(pick(["p", "div", "span", "p"]) if draw.random() < 0.8 else "div", text.capitalize(), False, draw.random() < 0.25)
                out.append("<hr>")
        out.append(f"</{tag}>")

    def bare(kind: str) -> None:
        """Text right inside the part's own element."""
        tag = {"footer": "footer", "header": "header"}.get(kind, "div")
        text = prose(int(draw.integers(2, 20))) if draw.random() < 0.6 else " ".join(pick(OTHER_WORDS[kind]) for _ in range(int(draw.integers(2, 9))))
        if kind == "footer" and draw.random() < 0.5:
            text = f"© {pick(vocabulary)}.com {pick(['·', '|', '-', ''])} {text}"
        say(tag, text, False, extra=name(OTHER_NAMES[kind]) if tag == "div" else "")

    def article() -> None:
        tag = pick(["article", "article", "div", "main", "section", "td", "div"])
        out.append(f"<{tag}{'' if tag in ('article', 'main') and draw.random() < 0.6 else name(ARTICLE_NAMES)}>")
        inner = draw.random() < 0.3
        if draw.random() < 0.85:
            say(pick(["h1", "h1", "h2"]), prose(int(draw.integers(1, 14))), True)
        if draw.random() < 0.15:
            other("share")
        if inner:
            out.append(f"<div{name(ARTICLE_NAMES)}>")
        long = draw.random() < 0.85
        broken = draw.random() < 0.2  # paragraphs are parted by line breaks
        if broken:
            parts = [prose(int(draw.geometric(0.025)) + 5) for _ in range(int(draw.integers(2, 9)))]
            cut = pick(["<br><br>", "<br/><br/>\n", "<br>"])
            if draw.random() < 0.5:  # right inside the article's own element
                out.append(pick(["", "<br>"]) + cut.join(parts))
            else:
                out.append("<div>" + cut.join(parts) + "</div>")
            truth.append((" ".join(" ".join(parts).split()), True))
        for _ in range(0 if broken else int(draw.integers(1, 14)) if long else int(draw.integers(1, 3))):
            r = draw.random()
            if r < 0.75:
                say("p", prose(int(draw.geometric(0.025)) if long else int(draw.integers(1, 12))), True)
            elif r < 0.82:
                say(pick(["h2", "h3"]), prose(int(draw.integers(1, 8))), True)
            elif r < 0.88:
                out.append(pick(["<ul>", "<ol>"]))
                for _ in range(int(draw.integers(1, 6))):
                    say("li", prose(int(draw.integers(1, 15))), True, draw.random() < 0.1)
                out.append("</ul></ol>")
            elif r < 0.93:
                say(pick(["blockquote", "pre", "div"]), prose(int(draw.integers(3, 40))), True)
            else:
                other(pick(["advert", "advert", "sidebar", "notice"]))
        if inner:
            out.append("</div>")
        if draw.random() < 0.25:
            other(pick(["share", "comments", "comments"]))
        out.append(f"</{tag}>")

    def table() -> None:
        """A page laid out in a table: links, an article, and a last row, mostly without names."""
        nonlocal plain
        plain = plain or draw.random() < 0.8
        out.append(f'<table{pick(["", " width=100%", " border=0"])}><tr>')

        def links(n: int) -> None:
            out.append("<td>")
            if draw.random() < 0.5:
                for _ in range(n):
                    say("p", pick(OTHER_WORDS["menu"]).capitalize() if draw.random() < 0.6 else prose(int(draw.integers(1, 4))).rstrip("."), False, True)
            else:
                own = [pick(OTHER_WORDS["menu"]).capitalize() for _ in range(n)]
                out.append("<br>".join(f'<a href="/{w}">{w}</a>' for w in own))
                truth.append((" ".join(own), False))
            out.append("</td>")

        if draw.random() < 0.5:
            links(int(draw.integers(2, 7)))
            out.append("</tr><tr>")
        if draw.random() < 0.7:
            links(int(draw.integers(2, 9)))
        out.append("<td>")
        if draw.random() < 0.7:
            say(pick(["h1", "h2"]), prose(int(draw.integers(1, 10))), True)
        if draw.random() < 0.5:
            parts = [prose(int(draw.geometric(0.025)) + 5) for _ in range(int(draw.integers(1, 8)))]
            out.append(pick(["<br><br>", "<br>"]).join(parts))
            truth.append((" ".join(" ".join(parts).split()), True))
        else:
            for _ in range(int(draw.integers(1, 9))):
                say("p", prose(int(draw.geometric(0.025)) + 2), True)
        out.append("</td>")
        if draw.random() < 0.3:
            links(int(draw.integers(2, 6)))
        out.append("</tr>")
        if draw.random() < 0.6:
            out.append("<tr>")
            say("td", " ".join(pick(OTHER_WORDS["footer"]) for _ in range(int(draw.integers(2, 9)))).capitalize(), False)
            out.append("</tr>")
        out.append("</table>")

    def some(chance: float, *kinds: str) -> None:
        for kind in kinds:
            if draw.random() < chance:
                bare(kind) if kind in ("footer", "advert", "notice", "header") and draw.random() < 0.5 else other(kind)

    out.append("<html><head><title>t</title></head><body>")
    if draw.random() < 0.12:
        table()
        out.append("</body></html>")
        return "".join(out), truth
    some(0.25, "notice")
    some(0.6, "header", "menu")
    some(0.3, "advert", "notice", "form")
    side = draw.random() < 0.4
    if side:
        some(0.6, "sidebar", "menu")
    if draw.random() < 0.97:
        article()
    some(0.35, "share", "comments", "form", "advert")
    if not side:
        some(0.5, "sidebar")
    some(0.85, "footer")
    some(0.15, "notice")
    out.append("</body></html>")
    return "".join(out), truth


def sample(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and labels of drawn pages whose blocks the reader finds as they were made."""
    draw, out = np.random.default_rng(seed), []
    while len(out) < n:
        html, truth = draw_page(draw)
        page = blocks(html)
        labels = _labels_of(page, truth)
        if page and labels is not None:
            out.append((features(page), labels))
    return out


def _labels_of(page: list[Block], truth: list[tuple[str, bool]]) -> np.ndarray | None:
    """Each block's label; a block of several drawn texts (inline tags) has theirs if they agree."""
    out, k = [], 0
    for b in page:
        held, kinds = "", set()
        while k < len(truth) and len(held) < len(b.text.replace(" ", "")):
            held += truth[k][0].replace(" ", "")
            kinds.add(truth[k][1])
            k += 1
        if held != b.text.replace(" ", "") or len(kinds) != 1:
            return None
        out.append(kinds.pop())
    return np.array(out, bool) if k == len(truth) else None


@lru_cache(2)
def trained(pages: int = PAGES, epochs: int = EPOCHS) -> BlockLstm:
    net = BlockLstm()
    net.train(sample(pages, seed=5), epochs)
    return net


def label(net: BlockLstm, pages: list[list[Block]]) -> list[np.ndarray]:
    """For each page the probabilities that its blocks are the article's; pages of like length go together."""
    out: list[np.ndarray] = [np.empty(0, np.float32)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and len(pages[order[b]]) * (b - a + 1) <= STEPS:
            b += 1
        x, live = padded([features(pages[k]) for k in order[a:b]])
        p = net.probabilities(x, live)
        for j, k in enumerate(order[a:b]):
            out[k] = p[: len(pages[k]), j]
        a = b
    return out


def main_texts(net: BlockLstm, htmls: list[str], least: float = 0.5) -> list[str]:
    pages = [blocks(h) for h in htmls]
    return [" ".join(b.text for b, p in zip(page, own, strict=True) if p >= least) for page, own in zip(pages, label(net, pages), strict=True)]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", net: BlockLstm | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each of ``pages``."""
    net = net or trained()

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                texts = main_texts(net, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
