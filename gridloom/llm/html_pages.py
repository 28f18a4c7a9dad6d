"""Small pages whose article is known: the labelled table of the HTML operator.

Pages are put together by a rule from the layouts and parts below. Every text block
of the article starts with MARK, no other does, so a block's label is read off its
text; no feature looks at the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count, product

MARK = "article:"

#: Around all parts ({before}, {article} and {after} stand for them).
LAYOUTS = (
    "<body>{before}<article>{article}</article>{after}</body>",
    "<body>{before}<main>{article}</main>{after}</body>",
    '<body>{before}<div class="post-content">{article}</div>{after}</body>',
    '<body>{before}<div id="main">{article}{after}</div></body>',
    '<body>{before}<div role="main"><div>{article}</div></div>{after}</body>',
    "<body>{before}{article}{after}</body>",
    "<body>{before}<div>{article}</div>{after}</body>",
    '<body><div id="page" class="has-sidebar">{before}<div>{article}</div>{after}</div></body>',
    '<body class="with-menu">{before}<div class="columns"><div>{article}</div></div>{after}</body>',
    '<body><div class="sidebar-layout">{before}<div>{article}</div>{after}</div></body>',
    '<body><div id="banner-page">{before}{article}{after}</div></body>',
    '<body><div class="widget-columns"><div>{before}</div><div>{article}</div></div>{after}</body>',
    '<body><div class="promo-theme"><div><div>{article}</div></div></div>{before}{after}</body>',
    '<body><section id="menu-and-text">{before}<section>{article}</section></section>{after}</body>',
    "<body><table><tr><td>{before}</td><td>{article}</td></tr></table>{after}</body>",
)


def _words(n: int, link: int = 0, mark: str = "") -> str:
    """n words, the last `link` of them inside a link."""
    words = [mark] * bool(mark) + ["word"] * (n - bool(mark))
    plain, linked = words[: n - link], words[n - link :]
    return " ".join(plain) + (f' <a href="/x">{" ".join(linked)}</a>' if linked else "")


def _text(tag: str, n: int, link: int = 0) -> str:
    return f"<{tag}>{_words(max(1, n), link, MARK)}</{tag}>"


def _links(n: int, words: int, tag: str = "ul") -> str:
    return f"<{tag}>" + "".join(f'<li><a href="/{i}">{_words(words)}</a></li>' for i in range(n)) + f"</{tag}>"


#: Names that only have a word of CHROME_WORDS, and elements that name the article.
HINTS = ('id="reviews-of-books"', 'class="search-engines-history"', 'class="social-theory chapter"', 'id="the-modal-verb"')
NAMED = ("<article>{}</article>", "<main>{}</main>", '<div role="main">{}</div>', '<div class="post">{}</div>')

#: Articles, from one paragraph to many, with headings, lists, short lines, quotes and links among the text.
ARTICLES = (
    _text("p", 60),
    _text("p", 24),
    _text("div", 75) + _text("div", 35),
    _text("h1", 8) + _text("p", 60) + _text("p", 60),
    _text("h1", 5) + _text("p", 30) + _text("p", 22) + _text("p", 14) + _text("p", 45) + _text("p", 18),
    _text("h1", 11) + _text("p", 90, 6) + _text("h2", 3) + _text("p", 120, 10) + _text("p", 4, 4) + _text("p", 70) + _text("h2", 4) + _text("p", 38, 3) + _text("p", 16),
    _text("h1", 7) + _text("p", 40) + "<ul>" + _text("li", 12) + _text("li", 5) + _text("li", 9, 2) + _text("li", 16) + "</ul>" + _text("p", 52) + _text("blockquote", 28) + _text("p", 6, 6) + _text("p", 33),
    _text("p", 48) + _text("p", 10) + _text("p", 80, 20) + _text("p", 9, 9) + _text("p", 65) + _text("p", 26, 12) + _text("p", 31),
    _text("h1", 3) + _text("p", 25) + _text("h2", 2) + _text("p", 41) + _text("h2", 1) + _text("p", 36) + _text("h3", 2) + _text("p", 19),
    _text("h1", 9, 9) + _text("h2", 12) + _text("p", 150) + _text("p", 2, 2) + _text("p", 44) + _text("p", 7) + _text("p", 95) + _text("p", 58),
    "".join(_text("p", n) for n in (35, 20, 17, 28, 55, 12, 40, 23, 15, 62)),
)

#: Parts before the article; those with a name first.
BEFORE = (
    "<nav>" + _links(5, 1) + "</nav>",
    '<header><div>' + _words(3) + "</div></header><nav>" + _links(7, 2) + '</nav><div class="ad">' + _words(14) + "</div>",
    '<div class="cookie-notice"><p>' + _words(32, 2) + "</p></div>" + _links(6, 1),
    '<div class="menu">' + _links(4, 2) + '</div><div id="breadcrumb">' + _words(5, 4) + "</div>",
    "<div>" + _links(9, 1) + "</div>",
    "<div>" + _words(3, 3) + "</div>" + _links(30, 2),
    "<div>" + _words(2, 2) + "</div><div>" + _words(1, 1) + "</div><div>" + _words(3, 3) + "</div>",
    '<form><p>' + _words(4) + "</p></form><aside><h3>" + _words(2) + "</h3><p>" + _words(45) + "</p>" + _links(4, 6) + "</aside>",
    "<div>" + _words(6) + "</div>" + _links(5, 1),
    "<div>" + _words(2) + "</div><p>" + _words(28) + "</p>" + _links(6, 2),
    "",
)

#: Parts after the article.
AFTER = (
    "<footer>" + _words(9) + "</footer>",
    '<section class="comments"><h3>' + _words(2) + "</h3>" + "".join(f"<p>{_words(n)}</p>" for n in (22, 60, 9, 35, 110, 48)) + "</section><footer>" + _words(6, 2) + "</footer>",
    '<div class="related"><h3>' + _words(2) + "</h3>" + _links(5, 8) + '</div><div id="footer"><p>' + _words(16, 3) + "</p>" + _links(6, 1) + "</div>",
    "<div>" + _links(8, 7) + "</div><div>" + _words(4, 3) + "</div>",
    "<h3>" + _words(2) + "</h3>" + _links(6, 9) + "<div>" + _links(5, 2) + "</div>",
    '<div class="share">' + _words(3) + _links(4, 1) + '</div><div class="newsletter"><p>' + _words(25) + "</p><form>" + _words(3) + "</form></div>",
    "<aside><p>" + _words(80, 4) + "</p></aside>" + _links(12, 1),
    "<div>" + _words(8) + "</div>",
    _links(4, 1) + "<p>" + _words(36) + "</p>",
    _links(5, 2) + "<div>" + _words(11) + "</div><div>" + _words(4) + "</div>",
    "",
)


def pages() -> Iterator[str]:
    """Every layout with every article; the parts around them take turns, so each meets each in time."""
    turn = count()
    for layout, article in product(LAYOUTS, ARTICLES):
        i = next(turn)
        yield "<html>" + layout.format(before=BEFORE[i % len(BEFORE)], article=article, after=AFTER[(i // 2) % len(AFTER)]) + "</html>"
    # A list of links in a part that is named like an article, and one inside an article between its paragraphs.
    for n in (5, 12, 30):
        yield f'<html><body><div class="main">{_links(n, 2)}</div><div class="main">{_text("p", 50)}{_text("p", 28)}</div></body></html>'
        yield f'<html><body><div class="content"><h2>{_words(2)}</h2>{_links(n, 3)}</div></body></html>'
        yield f"<html><body><article>{_text('p', 40)}<div>{_links(n, 1)}</div>{_text('p', 55)}{_text('p', 33)}</article></body></html>"
    # Comments and notices inside the article's element, and a header of its own.
    for n in (8, 30, 90):
        yield f'<html><body><article><header>{_text("h1", 7)}<p>{_words(6, 1)}</p></header>{_text("p", 45)}{_text("p", 60)}<div class="comment"><p>{_words(n)}</p><p>{_words(12)}</p></div></article></body></html>'
        yield f'<html><body><article>{_text("h1", 4)}{_text("p", 70)}<div class="promo">{_words(n, 2)}</div>{_text("p", 25)}{_text("p", 3)}</article><footer>{_words(n)}</footer></body></html>'
    # Parts of a named article whose names only have a word of menus and the like: text if they read as text, else not.
    for name, layout in product(HINTS, NAMED):
        for a, b, c in ((60, 70, 0), (50, 26, 40), (18, 33, 120), (110, 9, 260), (14, 4, 30)):
            rest = _text("p", c) if c else ""
            yield f'<html><body><nav>{_links(5, 1)}</nav>{layout.format(f"""<div {name}>{_text("p", a)}{_text("p", b)}</div>{rest}""")}<footer>{_words(7)}</footer></body></html>'
            yield f'<html><body>{layout.format(f"""{_text("h1", 6)}{rest}{_text("p", a)}<section {name}>{_text("h2", 3)}{_text("p", b)}</section>{_text("p", a)}""")}</body></html>'
            yield f'<html><body>{layout.format(f"""{_text("p", a)}<div {name}>{_links(6, 3)}</div>{_text("p", b)}{rest}<div {name}><p>{_words(5, 5)}</p></div>""")}</body></html>'
            yield f'<html><body><div {name}>{_links(4, 2)}{layout.format(_text("p", a) + _text("p", b) + rest)}</div></body></html>'
    # Articles of very short paragraphs or words alone.
    for tag, layout in product(("p", "div", "li"), ("<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>')):
        yield "<html><body><nav>" + _links(5, 1) + "</nav>" + layout.format("".join(_text(tag, n) for n in (1, 1, 1, 2, 1, 3, 1, 1, 12, 1, 5))) + "<footer>" + _words(5) + "</footer></body></html>"
    # Paragraphs of nothing but a link, and very short ones, among and after others.
    for n, layout in product((1, 2, 4, 7, 12), ("<article>{}</article>", "<main>{}</main>", '<div class="entry">{}</div>')):
        for around in (18, 30, 64):
            yield "<html><body>" + layout.format(_text("p", around) + _text("p", n, n) + _text("p", around - 9) + _text("p", n, n) + _text("h2", n + 1) + _text("p", around)) + "</body></html>"
            yield "<html><body>" + layout.format(_text("p", around) + _text("p", n, n) + _text("p", around - 12)) + "</body></html>"
            yield "<html><body>" + layout.format(_text("p", n) * 3 + _text("p", around) + _text("p", n)) + _links(n + 2, 1) + "</body></html>"
    # Pages of one block or two and nothing else.
    for tag, n in product(("p", "div", "section"), (1, 3, 5, 8, 12, 15, 28, 36, 60, 110, 300)):
        yield f"<html>{_text(tag, n)}</html>"
        yield f"<html><body><article>{_text(tag, n)}</article></body></html>"
        yield f"<html><body><main>{_text(tag, 1)}{_text(tag, n)}{_text(tag, 2)}</main></body></html>"
        yield f"<html><body>{_text('p', n)}{_text('p', 310 - n)}</body></html>"
        yield f"<html><body>{_text('h1', 6)}{_text('p', n)}</body></html>"
