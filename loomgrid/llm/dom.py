"""Leaf blocks of an HTML page: the runs of inline text between block boundaries, with the elements they stand in."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

#: Elements that begin and end a block. Fixed values, after the HTML standard's list of block-level elements.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
HIDDEN = frozenset("script style template noscript iframe object svg math canvas audio video head title textarea".split())
#: Of these, the ones whose content is not markup at all.
RAW = frozenset("script style iframe title textarea noscript".split())
#: An element of the key is closed by the start of one of the values. Fixed values, after the standard's optional end tags.
_CLOSE_P = BLOCKS - frozenset("body html li dd dt td th tr tbody thead tfoot caption option optgroup legend summary button label".split())
CLOSED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "thead", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
    "p": _CLOSE_P,
}
#: Elements that keep an open one inside from being closed by what stands outside.
SCOPES = frozenset("table td th li dd ul ol dl select button object".split())

#: Elements that hold the blocks of one part of a page.
HOLDERS = frozenset("html body div article main section aside nav header footer form table td center".split())

#: Attributes of a tag: a quote counts only where it opens a value and is closed again; else the tag ends at the next >.
_ATTRIBUTES = r"""(?:[\s/]+|[^\s/>][^\s/>=]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)?)?)*+"""
TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>\x00]*)({_ATTRIBUTES})(?:>|\Z)""", re.S)
NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
PARTS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")


class Element:
    """An element that text stands in: its tag, the words of its class, id and role, and its parent. Children of one element with
    one tag and the same words are one, so that what is computed of an element can be kept with it, in memo."""

    __slots__ = ("below", "memo", "parent", "tag", "words")

    def __init__(self, parent: Element | None, tag: str, words: frozenset):
        self.parent, self.tag, self.words = parent, tag, words
        self.below: dict[tuple[str, frozenset], Element] = {}
        self.memo = None

    def child(self, tag: str, words: frozenset) -> Element:
        key = (tag, words)
        if (found := self.below.get(key)) is None:
            found = self.below[key] = Element(self, tag, words)
        return found


class Part:
    """One of HOLDERS on the page: the unlinked signs of the blocks right in it, and of those right in the parts inside it."""

    __slots__ = ("below", "outer", "prose")

    def __init__(self, outer: Part | None):
        self.outer, self.prose, self.below = outer, 0, 0


class Block:
    """text: unescaped, white space squeezed and trimmed. inside: the element it begins in. linked: its signs inside links. share
    and around: of the page's unlinked signs those in its part, and those in all parts that stand in one with it."""

    __slots__ = ("around", "inside", "linked", "part", "share", "text")

    def __init__(self, text: str, inside: Element, part: Part, linked: int):
        self.text, self.inside, self.part, self.linked, self.share, self.around = text, inside, part, linked, 0.0, 0.0


def _attributes(raw: str) -> tuple[frozenset, bool]:
    """Words of class, id and role; and whether the element is hidden."""
    if not raw or raw == "/":
        return frozenset(), False
    words, hidden = set(), False
    for m in NAMED.finditer(raw):
        value = (m[2] or m[3] or m[4] or "").lower()
        name = m[1].lower()
        if name == "hidden":
            hidden = True
        elif name == "style":
            hidden = hidden or re.search(r"display\s*:\s*none", value) is not None
        else:
            words.update(PARTS.findall(value))
    return frozenset(words), hidden


def blocks(html: str) -> list[Block]:
    """Blocks with text, in page order. The time is linear in the page, however deep it is nested."""
    found: list[Block] = []
    root = Element(None, "", frozenset())
    whole = Part(None)  # the page
    stack: list[tuple[Element, bool, Part]] = []  # element, hidden, the part it is or stands in
    marks: list[int] = []  # places in the stack of what can be closed by a start tag or shields from it
    opened: Counter[str] = Counter()  # open elements by tag
    pieces: list[str] = []
    linked = hidden = links = 0
    inside: Element | None = None  # where the text begins
    part = whole

    def end_block() -> None:
        nonlocal linked, inside
        if pieces:
            text = SPACE.sub(" ", unescape("".join(pieces))).strip()
            if text:
                found.append(Block(text, inside or root, part, linked))
            pieces.clear()
        linked, inside = 0, None

    def text_piece(raw: str) -> None:
        nonlocal linked, inside, part
        if hidden or not raw:
            return
        if inside is None:
            if raw.isspace():
                return
            inside, _, part = stack[-1] if stack else (root, False, whole)
        pieces.append(raw)
        if links:
            linked += len(raw.strip())

    def pop() -> None:
        nonlocal hidden, links
        element, is_hidden, _ = stack.pop()
        tag = element.tag
        opened[tag] -= 1
        if marks and marks[-1] == len(stack):
            marks.pop()
        hidden -= is_hidden
        links -= tag == "a"
        if tag in BLOCKS:
            end_block()

    at, end = 0, len(html)
    while at < end:
        m = TOKEN.search(html, at)
        if m is None:
            text_piece(html[at:])
            break
        if m.start() > at:
            text_piece(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                text_piece(m[0][9:-3].replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                text_piece(" ") if inside is not None else None
            elif opened[tag]:
                while stack[-1][0].tag != tag:
                    pop()
                pop()
            elif tag in BLOCKS:
                end_block()
            continue
        if tag == "br":
            if inside is not None:
                pieces.append(" ")
            continue
        if tag in BLOCKS:
            for k in reversed(marks):
                t = stack[k][0].tag
                if tag in CLOSED_BY.get(t, ()):
                    while len(stack) > k:
                        pop()
                    break
                if t in SCOPES:
                    break
            end_block()
        if tag in VOID:
            continue
        words, is_hidden = _attributes(m[3])
        is_hidden = is_hidden or tag in HIDDEN
        if tag in RAW:
            close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
            stop = end if close is None else close.start()
            gap = html.find(">", stop)
            at = end if gap < 0 or close is None else gap + 1
            continue
        if m[3].endswith("/") and tag in ("svg", "path"):
            continue
        if tag in SCOPES or tag in CLOSED_BY:
            marks.append(len(stack))
        above, _, outer = stack[-1] if stack else (root, False, whole)
        stack.append((above.child(tag, words), is_hidden, Part(outer) if tag in HOLDERS else outer))
        opened[tag] += 1
        hidden += is_hidden
        links += tag == "a"
    end_block()
    total = 1
    for b in found:
        prose = max(0, len(b.text) - b.linked)
        total += prose
        b.part.prose += prose
        if b.part.outer is not None:
            b.part.outer.below += prose
    for b in found:
        b.share = b.part.prose / total
        b.around = b.part.outer.below / total if b.part.outer is not None else b.share
    return found
