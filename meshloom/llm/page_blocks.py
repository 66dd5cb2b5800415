"""HTML to its leaf blocks: text, tag path and link share, in page order.

A tolerant reader of tag soup: a stack of open elements, where a closing tag
closes up to the nearest open element of its name and a block tag closes an
open paragraph. Text between block tags is one block; inline tags don't part it.
"""

from __future__ import annotations

import re
from html import unescape

# Fixed values of HTML: elements without content, without rendered text, and those that don't part a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript title head svg math iframe object canvas audio video textarea select datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: An element that starts closes these open ones.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: An open element beyond which nothing is closed by the start of another.
FENCES = frozenset("ul ol dl table article section div aside main nav header footer form body td th blockquote".split())

#: A comment, a tag, a tag with a quote that nothing closes, a declaration; one that the page's end cuts off counts as well.
_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</?\Z", re.DOTALL)
#: One attribute after another, a name and its value or none, so that a value is never read as a name.
_ATTRIBUTE = re.compile(r"([^\s/>=\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?|\"[^\"]*\"|'[^']*'")
_NAMED = frozenset(("class", "id", "role"))
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def _names(attributes: str) -> tuple[tuple[str, ...], bool]:
    """The words of class, id and role, and whether the element is hidden; what is hidden from readers aloud alone is shown."""
    words, hidden = [], False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = (m.group(1) or "").lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if name == "hidden":
            hidden = True
        elif name == "style":
            hidden = hidden or bool(_HIDDEN.search(value))
        elif name in _NAMED:
            words += [x.lower() for x in _TOKEN.findall(unescape(value))]
    return tuple(words), hidden


def blocks(html: str) -> list[Block]:
    """The rendered leaf blocks of a page that hold text."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], bool]] = []  # name, words, hidden
    held: list[str] = []
    linked = at = links = unseen = 0
    begun = False  # whether the block has a character yet: its path is that of the first
    path: tuple = ()

    def flush():
        nonlocal linked, begun
        begun = False
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text:
                out.append(Block(path, text, min(linked, len(text))))
            held.clear()
        linked = 0

    def pop():
        nonlocal links, unseen
        name, _, hidden = stack.pop()
        links -= name == "a"
        unseen -= hidden

    def trace():
        return tuple(x for x in stack if x[0] not in INLINE)

    n = len(html)
    while at < n:
        m = _PIECE.search(html, at)
        text = html[at : m.start() if m else n]
        if text and not unseen:
            if not begun and not text.isspace():
                path, begun = trace(), True
            held.append(text)
            if links:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        closing, name, attributes = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
        if name is None:
            continue
        name = name.lower()
        if closing:
            if name == "br":
                held.append(" ")
                continue
            where = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), -1)
            if name not in INLINE:
                flush()
            elif where >= 0 and any(x[0] not in INLINE for x in stack[where + 1 :]):
                where = -1  # an inline end tag doesn't close blocks
            if where >= 0:
                while len(stack) > where:
                    pop()
            continue
        if name in SILENT:
            if name in ("script", "style", "textarea", "title", "noscript", "template", "svg", "math", "select", "datalist", "object", "video", "audio", "canvas", "iframe"):
                end = re.compile(f"</{name}\\s*>", re.IGNORECASE).search(html, at)
                at = end.end() if end else n if name in ("script", "style", "textarea", "title") else at
            continue
        if name in VOID:
            if name == "br":
                held.append(" ")
            elif name == "hr":
                flush()
            continue
        if attributes.endswith("/"):
            continue
        if name not in INLINE:
            flush()
            closes = CLOSES.get(name, ()) if name in CLOSES else ("p", "h1", "h2", "h3", "h4", "h5", "h6")
            k = len(stack) - 1
            while k >= 0 and (stack[k][0] in closes or stack[k][0] not in FENCES):
                if stack[k][0] in closes:
                    while len(stack) > k:
                        pop()
                    break
                k -= 1
        words, hidden = _names(attributes) if attributes else ((), False)
        stack.append((name, words, hidden))
        links += name == "a"
        unseen += hidden
    flush()
    return out
