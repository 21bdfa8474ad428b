"""Labelled pages to train the extraction on: eight layouts, each laid out at random, and the label of every block.

The layouts are those that pages commonly have: sectioning elements, a bare body, layout tables, boxes with meaningless
names, a blog, a news site, a wiki and a manual. Words are random syllables, so that a model can only learn layout and form.
Headline, standfirst, byline, captions, lists and tables of the article belong to it.
"""

from __future__ import annotations

import random
import re

SYLLABLES = "an be co da el fi go ha in ju ka lo ma no or pa qua re si ta un vi wo ya zu ße é ño ție".split()


class Maker:
    def __init__(self, rng: random.Random):
        self.rng = rng
        self.out: list[str] = []
        self.labels: list[tuple[str, bool]] = []

    def word(self) -> str:
        return "".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.choice((1, 1, 2, 2, 3, 4))))

    def phrase(self, low: int, high: int) -> str:
        words = " ".join(self.word() for _ in range(self.rng.randint(low, high)))
        return words if self.rng.random() < 0.12 else words.capitalize()

    def prose(self) -> str:
        if self.rng.random() < 0.25:  # short paragraphs are prose too
            return self.phrase(1, 6) + self.rng.choice((".", ".", "?", "!", ""))
        return " ".join(self.phrase(2, 18) + self.rng.choice((".", ".", ",", "?")) for _ in range(self.rng.randint(1, 9)))

    def leaf(self, tag: str, text: str, good: bool, inner: str | None = None, attrs: str = "") -> None:
        shown = inner or text.replace("&", "&amp;")
        self.out.append(f"<{tag}{attrs}>{shown}</{tag}>")
        self.labels.append((" ".join(text.split()), good))

    def links(self, n: int, wrap: str = "li", good: bool = False, list_tag: str | None = "ul") -> None:
        self.out.append(f"<{list_tag}>" if list_tag else "")
        for _ in range(n):
            t = self.phrase(1, 4)
            self.leaf(wrap, t, good, f'<a href="/{self.word()}">{t}</a>')
        self.out.append(f"</{list_tag}>" if list_tag else "")

    def box(self, tag: str, names: tuple[str, ...]) -> str:
        """Opens an element that may name its purpose."""
        name = self.rng.choice((*names, "")) if tag not in ("div", "section") else self.rng.choice(names)
        self.out.append(f'<{tag} {self.rng.choice(("class", "class", "id"))}="{name}">' if name else f"<{tag}>")
        return f"</{tag}>"


def rights(m: Maker) -> str:
    """What a footer says of its owner."""
    r = m.rng
    year = r.choice(("", f"{r.randint(1990, 2030)} ", f"{r.randint(1990, 2010)}-{r.randint(2011, 2030)} "))
    said = r.choice(("© ", "Copyright ", "Copyright © ", "(c) ")) + year + m.phrase(1, 6)
    return said + r.choice(("", ".", " All rights reserved.", f" · {m.phrase(1, 4)}", f" | {m.phrase(1, 4)}", f" - {m.phrase(2, 7)}."))


def furniture(m: Maker, kind: str) -> None:
    """One piece of what isn't the article."""
    r = m.rng
    if kind == "nav":
        close = m.box(r.choice(("nav", "nav", "div")), ("nav", "menu", "main-menu", "navbar", "breadcrumb", "site-navigation"))
        if r.random() < 0.25:  # without a list
            loose(m, r.choice((run_of_links(m, r.randint(1, 7)), m.phrase(1, 6))), False)
        else:
            m.links(r.randint(2, 9))
    elif kind == "header":
        close = m.box(r.choice(("header", "div")), ("header", "masthead", "site-header", "topbar"))
        m.leaf(r.choice(("div", "p", "h2")), m.phrase(1, 5), False)
        if r.random() < 0.5:
            m.leaf("p", m.phrase(3, 9), False)
    elif kind == "footer":
        close = m.box(r.choice(("footer", "footer", "div")), ("footer", "site-footer", "copyright", "colophon"))
        m.leaf(r.choice(("p", "div")), rights(m), False)
        if r.random() < 0.5:
            m.links(r.randint(1, 5))
        if r.random() < 0.3:
            m.leaf("p", m.prose(), False)
    elif kind == "plain footer":
        m.leaf("footer", rights(m), False)
        return
    elif kind == "sidebar":
        close = m.box(r.choice(("aside", "aside", "div")), ("sidebar", "related", "widget", "popular", "more-stories", "recommended"))
        m.leaf(r.choice(("h3", "h4", "p")), m.phrase(1, 4), False)
        if r.random() < 0.6:
            m.links(r.randint(1, 6))
        for _ in range(r.randint(0, 3)):
            m.leaf("p", m.prose(), False)
    elif kind == "ad":
        if r.random() < 0.5:
            name = r.choice(("ad", "ads", "advert", "sponsored", "banner", "promo", "advertisement"))
            m.leaf("div", m.phrase(2, 14) + ".", False, attrs=f' class="{name}"')
            return
        close = m.box(r.choice(("div", "aside")), ("ad", "advert", "advertisement", "sponsored", "promo", "banner"))
        for _ in range(r.randint(1, 3)):
            m.leaf("p", m.prose(), False)
    elif kind == "notice":
        close = m.box(r.choice(("div", "section")), ("cookie", "cookie-notice", "consent", "gdpr", "alert", "notice", "paywall", "subscribe"))
        for _ in range(r.randint(1, 2)):
            m.leaf("p", m.prose(), False)
        m.leaf("button", m.phrase(1, 2), False)
    elif kind == "form":
        close = m.box("form", ("search", "newsletter", "login", "contact", "signup"))
        m.leaf("label", m.phrase(1, 4), False)
        m.out.append('<input type="text" name="q">')
        m.leaf("button", m.phrase(1, 2), False)
        if r.random() < 0.4:
            m.leaf("p", m.prose(), False)
    elif kind == "share":
        close = m.box("div", ("share", "social", "tags", "toolbar", "sharing"))
        m.links(r.randint(2, 5))
    else:
        close = m.box(r.choice(("section", "div", "div")), ("comments", "comment-list", "replies", "responses", "discussion", "reader-comments"))
        m.leaf(r.choice(("h2", "h3")), m.phrase(1, 3), False)
        inner = r.choice(("article", "div", "li"))
        for _ in range(r.randint(1, 7)):
            m.out.append(f'<{inner} class="{r.choice(("comment", "reply", "comment-body"))}">')
            if r.random() < 0.6:
                m.leaf("div", m.phrase(1, 3), False)
            for _ in range(r.randint(1, 3)):
                m.leaf("p", m.prose(), False)
            m.out.append(f"</{inner}>")
    m.out.append(close)


def article(m: Maker) -> None:
    r = m.rng
    tag = r.choice(("article", "article", "article", "main", "div", "div", "section", ""))
    if tag == "article":
        m.out.append(r.choice(("<article>", "<article>", '<article class="post">', '<article id="story">')))
    elif tag:
        m.out.append(f'<{tag} {r.choice(("class", "id"))}="{r.choice(("content", "post", "entry-content", "article-body", "story", "main", "text"))}">')
    inner = tag and r.random() < 0.2
    if inner:
        m.out.append('<div class="body">')
    if r.random() < 0.85:
        m.leaf("h1", m.phrase(2, 11), True)
    for n in range(r.choice((1, 1, 2, 3, 5, 8, 13, 21, 60))):
        x = r.random()
        if x < 0.7 or not n:
            t = m.prose()
            if r.random() < 0.25:
                w = r.choice(("b", "i", "em", "strong", "span"))
                words = t.split()
                k = r.randint(0, len(words) - 1)
                shown = " ".join([*words[:k], f"<{w}>{words[k]}</{w}>", *words[k + 1 :]])
                m.leaf("p", t, True, shown)
            else:
                m.leaf(r.choice(("p",) * 8 + ("div",)), t, True)
        elif x < 0.78:
            m.leaf(r.choice(("h2", "h3")), m.phrase(1, 7), True)
        elif x < 0.83:
            m.out.append("<ul>")
            for _ in range(r.randint(1, 5)):
                m.leaf("li", m.phrase(2, 14), True)
            m.out.append("</ul>")
        elif x < 0.86:
            m.out.append("<blockquote>")
            m.leaf("p", m.prose(), True)
            m.out.append("</blockquote>")
        elif x < 0.88:
            m.out.append("<table><tr>")
            for _ in range(r.randint(1, 4)):
                m.leaf("td", m.phrase(1, 4), True)
            m.out.append("</tr></table>")
        elif x < 0.90:
            m.out.append('<figure><img src="x.png">')
            m.leaf("figcaption", m.phrase(2, 9), True)
            m.out.append("</figure>")
        elif x < 0.92:
            m.leaf("pre", m.phrase(2, 9), True)
        elif x < 0.97 and tag:
            furniture(m, r.choice(("ad", "share", "form", "sidebar", "notice")))
        else:
            t = m.prose()
            words = t.split()
            k = r.randint(0, len(words) - 1)
            m.leaf("p", t, True, " ".join([*words[:k], f'<a href="/x">{words[k]}</a>', *words[k + 1 :]]))
    if inner:
        m.out.append("</div>")
    if tag and r.random() < 0.12:
        furniture(m, "comments")
    if tag:
        m.out.append(f"</{tag}>")


def paragraphs(m: Maker, low: int = 1, high: int = 9, tags: tuple[str, ...] = ("p",)) -> None:
    """Plain running text, with what stands between it."""
    r = m.rng
    for _ in range(r.randint(low, high)):
        x = r.random()
        if x < 0.8:
            m.leaf(r.choice(tags), m.prose(), True)
        elif x < 0.9:
            m.leaf(r.choice(("h2", "h3")), m.phrase(1, 6), True)
        else:
            m.out.append("<ul>")
            for _ in range(r.randint(2, 4)):
                m.leaf("li", m.phrase(2, 12), True)
            m.out.append("</ul>")


def semantic(m: Maker) -> None:
    r = m.rng
    x = r.random()
    if x < 0.1:  # the article alone
        article(m)
        return
    if x < 0.15:  # no article
        furniture(m, r.choice(("nav", "header", "form", "notice", "footer")))
        return
    for kind, often in (("notice", 0.15), ("header", 0.45), ("nav", 0.85), ("form", 0.15), ("ad", 0.55), ("sidebar", 0.12)):
        if r.random() < often:
            furniture(m, kind)
    article(m)
    for kind, often in (("share", 0.2), ("ad", 0.2), ("comments", 0.35), ("sidebar", 0.35), ("form", 0.2), ("nav", 0.1), ("footer", 0.45), ("plain footer", 0.45), ("notice", 0.15)):
        if r.random() < often:
            furniture(m, kind)


def run_of_links(m: Maker, n: int) -> str:
    """A line of links, as it stands in running text."""
    return m.rng.choice((" | ", " ", " - ", " [x] ")).join(f'<a href="{m.word()}.html">{m.phrase(1, 2)}</a>' for _ in range(n))


def shown_text(html: str) -> str:
    return " ".join(re.sub("<[^>]*>", " ", html).split())


def loose(m: Maker, html: str, good: bool) -> None:
    """Text that stands in no element of its own; white space around tags is not told apart."""
    m.out.append(html)
    m.labels.append((shown_text(html), good))


def bare(m: Maker) -> None:
    """Text right in the body, parted by hr, headings or centred lines."""
    r = m.rng
    if r.random() < 0.15:  # nothing but the text
        loose(m, m.prose(), True)
        return
    if r.random() < 0.7:
        loose(m, run_of_links(m, r.randint(2, 7)), False)
        m.out.append("<hr>")
    m.leaf(r.choice(("h1", "h2", "center")), m.phrase(2, 9), True)
    for n in range(r.randint(1, 4)):
        if n:
            m.leaf(r.choice(("h2", "h3", "p")), m.phrase(2, 9), True)
        loose(m, f" {r.choice(('<br>', '<br><br>', '<br /><br />'))} ".join(m.prose() for _ in range(r.randint(1, 5))), True)
    if r.random() < 0.6:
        m.out.append("<hr>")
        loose(m, r.choice((run_of_links(m, r.randint(1, 5)), f"<small>{rights(m)}</small>", f"<i>{rights(m)}</i> {run_of_links(m, 1)}")), False)


def tables(m: Maker) -> None:
    """A layout table: a row for the site's name, links in the first or last column, the article in another, a row at the foot."""
    r = m.rng
    m.out.append('<table width="100%" cellpadding="0"><tbody>' if r.random() < 0.5 else '<table border="0">')
    if r.random() < 0.7:
        m.out.append("<tr>")
        m.leaf("td", m.phrase(1, 4), False, attrs=' colspan="2"')
        m.out.append("</tr>")
    m.out.append('<tr valign="top">')
    left = r.random() < 0.7

    def links() -> None:
        if r.random() < 0.5:
            m.out.append('<td width="150">')
            loose(m, run_of_links(m, r.randint(2, 9)), False)
            m.out.append("</td>")
        else:
            m.out.append('<td width="150"><table>')
            for _ in range(r.randint(2, 7)):
                m.out.append("<tr>")
                t = m.phrase(1, 3)
                m.leaf("td", t, False, f'<a href="{m.word()}.html">{t}</a>')
                m.out.append("</tr>")
            m.out.append("</table></td>")

    if left:
        links()
    m.out.append("<td>")
    if r.random() < 0.8:
        m.leaf(r.choice(("h1", "h2")), m.phrase(2, 9), True)
    if r.random() < 0.4:
        loose(m, " <br><br> ".join(m.prose() for _ in range(r.randint(1, 5))), True)
    else:
        paragraphs(m, 1, 7)
    m.out.append("</td>")
    if not left:
        links()
    m.out.append("</tr>")
    if r.random() < 0.6:
        m.out.append("<tr>")
        m.leaf("td", rights(m), False, attrs=' colspan="2" align="center"')
        m.out.append("</tr>")
    m.out.append("</table>")


def soup(m: Maker) -> None:
    """Boxes whose names tell nothing."""
    r = m.rng
    name = lambda: r.choice((f' class="c{r.randint(1, 99)}"', f' class="css-{m.word()}{r.randint(1, 99)}"', "", f' id="b{r.randint(1, 30)}"'))
    m.out.append(f"<div{name()}>")
    for _ in range(r.randint(0, 2)):
        m.out.append(f"<div{name()}>")
        if r.random() < 0.4:
            loose(m, run_of_links(m, r.randint(2, 8)), False)
        else:
            m.links(r.randint(2, 8), r.choice(("div", "li")), list_tag=None)
        m.out.append("</div>")
    if r.random() < 0.4:
        m.leaf("div", m.phrase(1, 4), False, attrs=name())
    depth = r.randint(1, 3)
    m.out.append("".join(f"<div{name()}>" for _ in range(depth)))
    if r.random() < 0.85:
        m.leaf(r.choice(("h1", "h1", "h2", "div")), m.phrase(2, 9), True, attrs=name())
    paragraphs(m, 2, 9, r.choice((("p",), ("div",), ("p", "div"))))
    m.out.append("</div>" * depth)
    for _ in range(r.randint(0, 2)):
        m.out.append(f"<div{name()}>")
        m.leaf(r.choice(("div", "h3", "h4")), m.phrase(1, 3), False)
        m.links(r.randint(2, 6), r.choice(("div", "li")), list_tag=None)
        m.out.append("</div>")
    if r.random() < 0.7:
        m.leaf("div", rights(m), False, attrs=name())
    m.out.append("</div>")


def blog(m: Maker) -> None:
    r = m.rng
    m.out.append('<div id="page"><div id="header" role="banner">')
    m.leaf("h1", t := m.phrase(1, 4), False, f'<a href="/">{t}</a>')
    if r.random() < 0.6:
        m.leaf("div", m.phrase(3, 8), False, attrs=' class="description"')
    m.out.append("</div>")
    if r.random() < 0.6:
        furniture(m, "nav")
    m.out.append('<div id="content"><div class="post hentry">')
    m.leaf("h2", m.phrase(2, 9), True, attrs=' class="entry-title"')
    if r.random() < 0.6:
        m.leaf("div", f"Posted on {r.randint(1, 28)} {m.phrase(1, 1)} {r.randint(1999, 2025)} by {m.phrase(1, 2)}", True, attrs=' class="entry-meta"')
    m.out.append('<div class="entry-content">' if r.random() < 0.6 else '<div class="entry">')
    paragraphs(m, 1, 9)
    m.out.append("</div>")
    if r.random() < 0.5:
        m.out.append('<div class="postmetadata tags">')
        loose(m, run_of_links(m, r.randint(1, 5)), False)
        m.out.append("</div>")
    m.out.append("</div>")
    if r.random() < 0.5:
        m.out.append('<div class="navigation">')
        m.links(2, "div", list_tag=None)
        m.out.append("</div>")
    if r.random() < 0.6:
        furniture(m, "comments")
    if r.random() < 0.3:
        furniture(m, "form")
    m.out.append('</div><div id="sidebar" role="complementary">')
    for _ in range(r.randint(1, 3)):
        m.out.append('<div class="widget">')
        m.leaf(r.choice(("h2", "h3", "h4")), m.phrase(1, 3), False)
        if r.random() < 0.3:
            m.leaf("p", m.prose(), False)
        else:
            m.links(r.randint(2, 6))
        m.out.append("</div>")
    m.out.append('</div><div id="footer">')
    m.leaf("p", rights(m), False)
    m.out.append("</div></div>")


def news(m: Maker) -> None:
    r = m.rng
    furniture(m, "header")
    furniture(m, "nav")
    if r.random() < 0.4:
        furniture(m, r.choice(("notice", "ad")))
    m.out.append(r.choice(("<main><article>", '<main id="main-content">', '<div class="page"><div class="article">')))
    if r.random() < 0.3:
        m.out.append('<div class="breadcrumbs">')
        loose(m, run_of_links(m, r.randint(2, 4)), False)
        m.out.append("</div>")
    m.out.append("<header>" if (inner := r.random() < 0.4) else "")
    m.leaf("h1", m.phrase(3, 11), True)
    if r.random() < 0.6:
        m.leaf("p", m.phrase(6, 20) + ".", True, attrs=' class="standfirst"')
    if r.random() < 0.7:
        m.leaf(r.choice(("div", "p", "address")), f"By {m.phrase(2, 2)}", True, attrs=' class="byline"')
    if r.random() < 0.4:
        m.leaf("div", f"{r.randint(1, 28)} {m.phrase(1, 1)} {r.randint(1999, 2025)}", True, attrs=' class="dateline"')
    m.out.append("</header>" if inner else "")
    if r.random() < 0.5:
        furniture(m, "share")
    m.out.append('<div class="body">' if (body := r.random() < 0.6) else "")
    for _ in range(r.randint(1, 3)):
        paragraphs(m, 1, 5)
        if r.random() < 0.4:
            furniture(m, r.choice(("ad", "sidebar", "form")))
        if r.random() < 0.3:
            m.out.append('<figure><img src="a.jpg">')
            m.leaf("figcaption", m.phrase(3, 12) + ".", True)
            m.out.append("</figure>")
    m.out.append("</div>" if body else "")
    if r.random() < 0.4:
        furniture(m, "comments")
    for end in ("article", "div", "div", "main"):
        m.out.append(f"</{end}>")
    if r.random() < 0.7:
        furniture(m, "sidebar")
    furniture(m, r.choice(("footer", "plain footer")))


def wiki(m: Maker) -> None:
    r = m.rng
    m.out.append('<div id="content" class="body" role="main">')
    m.leaf("h1", m.phrase(1, 5), True, attrs=' id="firstHeading"')
    m.out.append('<div id="bodyContent">')
    if r.random() < 0.4:
        m.out.append('<div class="notice metadata">')
        m.leaf("p", m.prose(), False)
        m.out.append("</div>")
    paragraphs(m, 1, 2)
    if r.random() < 0.6:
        m.out.append('<div id="toc" class="toc">')
        m.leaf("h2", m.phrase(1, 1), False)
        m.links(r.randint(2, 7))
        m.out.append("</div>")
    for _ in range(r.randint(1, 4)):
        m.leaf("h2", m.phrase(1, 4), True)
        paragraphs(m, 1, 4)
        if r.random() < 0.2:
            m.out.append('<table class="wikitable"><tr>')
            for _ in range(r.randint(2, 5)):
                m.leaf(r.choice(("td", "th")), m.phrase(1, 4), True)
            m.out.append("</tr></table>")
    m.out.append("</div>")
    if r.random() < 0.6:
        m.out.append('<div id="catlinks" class="catlinks">')
        m.links(r.randint(2, 5))
        m.out.append("</div>")
    m.out.append('</div><div id="navigation" role="navigation">')
    for _ in range(r.randint(1, 3)):
        m.leaf("h3", m.phrase(1, 2), False)
        m.links(r.randint(2, 6))
    m.out.append('</div><div id="footer" role="contentinfo"><ul>')
    m.leaf("li", rights(m), False)
    m.links(r.randint(1, 4), list_tag=None)
    m.out.append("</ul></div>")


def manual(m: Maker) -> None:
    r = m.rng
    m.out.append('<div class="layout"><div class="sidebar toc-tree"><ul>')
    for _ in range(r.randint(2, 5)):
        t = m.phrase(1, 3)
        m.leaf("li", t, False, f'<a href="#{m.word()}">{t}</a>')
        if r.random() < 0.5:
            m.links(r.randint(1, 4))
    m.out.append(f'</ul></div><div class="{r.choice(("document", "content", "doc-body", "markdown-body"))}">')
    m.leaf("h1", m.phrase(1, 5), True)
    for _ in range(r.randint(1, 4)):
        paragraphs(m, 1, 3)
        if r.random() < 0.6:
            m.leaf("pre", m.phrase(2, 15), True)
        if r.random() < 0.3:
            m.out.append("<dl>")
            m.leaf("dt", m.phrase(1, 2), True)
            m.leaf("dd", m.prose(), True)
            m.out.append("</dl>")
    m.out.append("</div>")
    m.out.append('<div class="pager related">')
    m.links(2, "div", list_tag=None)
    m.out.append("</div>")
    if r.random() < 0.6:
        furniture(m, r.choice(("footer", "plain footer")))
    m.out.append("</div>")


LAYOUTS = (semantic, bare, semantic, tables, soup, blog, news, wiki, manual)


def page(seed: int, layouts=LAYOUTS) -> tuple[str, list[tuple[str, bool]]]:
    """HTML and the text and label of each block, in page order."""
    m = Maker(random.Random(seed))
    if m.rng.random() < 0.8:
        m.out.append(f"<!DOCTYPE html><html><head><title>{m.phrase(2, 8)}</title><script>var a='<p>';</script></head><body>")
    layouts[seed % len(layouts)](m)
    m.out.append("</body></html>" if m.rng.random() < 0.8 else "")
    return "".join(m.out), m.labels
