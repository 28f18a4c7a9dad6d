"""HTML extraction: flat text blocks, classified by a decision tree.

A page is cut into blocks at block-level tags. A block is described by its own
words and link density, those of its two neighbours, and by where it stands: in a
named article or beside one, in a part that its tag or its name tells to be no
article, and what share of the page such a named part holds. The tree is trained on
the blocks of small pages whose article is known (html_pages), and then evaluated by
Spark as one conditional expression.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import html_pages
from gridloom.llm.common import free_name

#: Elements whose content is never text of the page.
SILENT = {"script", "style", "noscript", "template", "head", "title", "svg", "math", "iframe", "object", "canvas", "audio", "video", "select", "option", "textarea", "button", "datalist"}
#: Of these the content runs to the end tag, whatever stands between.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rb", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that stay open until their end tag or that of an element around them.
CONTAINERS = {"address", "article", "aside", "body", "details", "dialog", "div", "dl", "fieldset", "figure", "footer", "form", "header", "main", "menu", "nav", "ol", "section", "table", "ul"} | (SILENT - RAW)
CHROME_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset", "address"}
MAIN_TAGS = {"article", "main"}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar"}
#: Words of class and id attributes that name parts beside the article.
CHROME_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "copyright", "discussion", "disqus", "feedback", "footer", "gdpr",
    "header", "login", "masthead", "menu", "meta", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "overlay", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related", "replies", "respond", "reviews",
    "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "tags", "toolbar", "topbar", "widget",
}
MAIN_WORDS = {"article", "content", "entry", "main", "post", "story", "text"}
#: Words that say of what kind an element is or where it stands; with one of CHROME_WORDS they name a part, as in comment-list.
STRUCTURE_WORDS = {
    "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "card", "col", "column", "container", "cta", "foot", "form", "global", "group", "head", "heading", "holder", "icon", "icons", "inline", "inner", "item", "items", "left",
    "link", "links", "list", "local", "mobile", "module", "outer", "page", "pane", "panel", "posts", "primary", "region", "right", "row", "secondary", "section", "site", "slot", "strip", "thread", "title", "top", "unit", "wrap", "wrapper", "wp", "zone",
}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_STATE = re.compile(r"(?:has|have|with|without|no|not|is|js)(?:[-_]|(?=[A-Z]))")
_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}

BLOCK = T.StructType([
    T.StructField("text", T.StringType(), False), T.StructField("words", T.IntegerType(), False), T.StructField("link", T.DoubleType(), False),
    T.StructField("place", T.IntegerType(), False), T.StructField("heading", T.IntegerType(), False), T.StructField("share", T.DoubleType(), False),
])
#: A menu, footer and the like, by tag or role, or by its whole name on a page with a named article; outside that article;
#: in a part that a name alone tells to be beside the article, where none is named; no such name; inside the named article.
#: A hint is no place: share alone, which is 0 in parts without one, and the words and links speak there.
BESIDE, OUTSIDE, NAMED_BESIDE, UNNAMED, INSIDE = range(5)
FEATURES = ("words", "link", "words_before", "link_before", "words_after", "link_after", "place", "heading", "share")


def _marks(tag: str, attributes: str) -> tuple[bool, int, bool]:
    """Whether an element names the article; 2 if its tag or role says that it stands beside it, 1 if a class or id does; whether one hints at it.

    A name tells what an element is if all its words name parts or structure, as
    comment-list does. reviews-of-books only has such a word: a hint. Names such as
    has-sidebar tell the state of a page, not what the element is.
    """
    chrome, main, hint = 2 * (tag in CHROME_TAGS), tag in MAIN_TAGS, False
    if attributes and tag not in ("body", "main"):
        for name, *value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), entities.unescape("".join(value))
            if name == "role":
                chrome = max(chrome, 2 * (value.lower() in CHROME_ROLES))
                main |= value.lower() in MAIN_TAGS
            elif name in ("class", "id"):
                names = [{w.lower() for w in _NAME_PART.findall(part)} for part in value.split() if not _STATE.match(part)]
                words = set().union(*names)
                chrome = max(chrome, int(any(n & CHROME_WORDS and n <= CHROME_WORDS | MAIN_WORDS | STRUCTURE_WORDS for n in names)))
                hint |= bool(words & CHROME_WORDS)
                main |= bool(words & MAIN_WORDS) and not words & CHROME_WORDS
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                chrome = 2
    return main, chrome, hint


def blocks(page: str | None) -> list[tuple[str, int, float, int, int, float]]:
    """The text blocks of a page in order, as BLOCK has them; none for null or empty pages.

    Character references are decoded and blanks inside a block become one space.
    place rises with what speaks for an article: BESIDE, OUTSIDE, NAMED_BESIDE,
    UNNAMED, INSIDE. share is the part of the page's words that the outermost element
    around the block holds which _marks() takes for no article, or hints at it. End tags without a
    start, and starts without an end, are tolerated.
    """
    found: list[tuple[str, int, float, int, int, int, int]] = []
    if not page:
        return []
    # Tag, in the article, beside it, number of the part beside it, whether that is a header of the article (whose headings are its own), silent, hinted at.
    stack: list[tuple[str, bool, int, int, bool, bool, bool]] = [("", False, 0, 0, False, False, False)]
    part_words = [0]
    pieces: list[str] = []
    linked: list[str] = []
    in_link = heading = 0

    def flush() -> None:
        if not pieces:
            return
        text = _SPACE.sub(" ", "".join(pieces)).strip()
        if text:
            n = text.count(" ") + 1
            link = sum(len(x.split()) for x in linked)
            _, in_main, in_chrome, part, own_head, _, _ = stack[-1]
            part_words[part] += n
            found.append((text, n, min(1.0, link / n), int(in_main), 0 if own_head and heading else in_chrome, int(heading), part))
        pieces.clear()
        linked.clear()

    def say(raw: str) -> None:
        if raw and not stack[-1][5]:
            text = entities.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if in_link:
                linked.append(text)

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW and not closing:
            end = _END[tag].search(page, at)
            at = end.end() if end else len(page)
            if tag not in INLINE:
                flush()
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            continue
        if tag == "br":
            say(" ")
            continue
        flush()
        in_link = 0
        heading = 0 if closing or tag not in ("h1", "h2", "h3", "h4", "h5", "h6") else 1
        if tag in CONTAINERS and tag not in VOID:
            if closing:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            elif not attributes.endswith("/"):
                main, chrome, hint = _marks(tag, attributes)
                _, in_main, in_chrome, part, own_head, silent, hinted = stack[-1]
                if tag in MAIN_TAGS and hinted or tag == "main":
                    part, own_head, hinted = 0, False, False  # what surrounds the article by its tag is no part of it
                if tag == "main":
                    in_chrome = 0
                elif chrome and not in_chrome or hint and not (in_chrome or hinted or chrome):
                    part_words.append(0)
                    part, own_head = len(part_words) - 1, tag == "header" and in_main
                in_chrome = max(in_chrome, chrome) if tag != "main" else 0
                stack.append((tag, in_main or main and not in_chrome, in_chrome, part, own_head, silent or tag in SILENT, hinted or hint and tag not in MAIN_TAGS))
    flush()
    named, total = any(b[3] for b in found), sum(b[1] for b in found)

    def place(main: int, chrome: int) -> int:
        if chrome == 2 or chrome and named:
            return BESIDE
        return INSIDE if main else OUTSIDE if named else NAMED_BESIDE if chrome else UNNAMED

    return [(*b[:3], place(b[3], b[4]), b[5], part_words[b[6]] / total if b[6] else 0.0) for b in found]


def page_blocks(pages: DataFrame, html: str = "html", out: str = "blocks") -> DataFrame:
    """pages with the array column `out` of BLOCK (replaced if there) instead of the html column."""
    pages = pages.drop(out)
    carried = [c for c in pages.columns if c != html]
    kind = T.ArrayType(BLOCK, False)
    struct = pa.struct([("text", pa.string()), ("words", pa.int32()), ("link", pa.float64()), ("place", pa.int32()), ("heading", pa.int32()), ("share", pa.float64())])
    names = [f.name for f in struct]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = [[dict(zip(names, b)) for b in blocks(p)] for p in batch.column(batch.schema.get_field_index(html)).to_pylist()]
                columns = [batch.column(batch.schema.get_field_index(c)) for c in carried]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, pa.list_(struct))], names=[*carried, out])

    return pages.mapInArrow(run, T.StructType([*(pages.schema[c] for c in carried), T.StructField(out, kind)]))


def labelled_blocks() -> pd.DataFrame:
    """FEATURES, label (1 for text of the article) and the number of its page, of every block of the labelled pages."""
    rows = []
    for number, page in enumerate(html_pages.pages()):
        found = blocks(page)
        sizes = [(0.0, 0.0), *[(float(b[1]), b[2]) for b in found], (0.0, 0.0)]
        for i, (text, n, link, place, heading, share) in enumerate(found):
            rows.append((n, link, *sizes[i], *sizes[i + 2], place, heading, share, text.startswith(html_pages.MARK), number))
    return pd.DataFrame(rows, columns=[*FEATURES, "label", "page"]).astype(float)


def train_tree(spark: SparkSession, labelled: pd.DataFrame | None = None, max_depth: int = 12):
    rows = spark.createDataFrame(labelled_blocks() if labelled is None else labelled).coalesce(1)
    prepared = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    return DecisionTreeClassifier(maxDepth=max_depth, minInstancesPerNode=2, maxBins=128, seed=7).fit(prepared)


def tree_expression(model, features: dict[str, Column]) -> Column:
    """The model's prediction as nested conditions over the columns of its features."""

    def of(node) -> Column:
        if node.subtreeDepth() == 0:
            return F.lit(node.prediction())
        split = node.split()
        value = features[FEATURES[split.featureIndex()]].cast("double")
        return F.when(value <= split.threshold(), of(node.leftChild())).otherwise(of(node.rightChild()))

    return of(model._java_obj.rootNode())


def main_text(blocks_: Column, model) -> Column:
    """The texts of the blocks that the tree takes for the article, joined by one space; empty if none."""

    def keep(block: Column, i: Column) -> Column:
        before, after = F.get(blocks_, i - 1), F.get(blocks_, i + 1)
        neighbour = lambda b, name: F.coalesce(b[name].cast("double"), F.lit(0.0))
        features = {n: block[n] for n in ("words", "link", "place", "heading", "share")}
        features |= {"words_before": neighbour(before, "words"), "link_before": neighbour(before, "link"), "words_after": neighbour(after, "words"), "link_after": neighbour(after, "link")}
        return tree_expression(model, features) == 1.0

    return F.array_join(F.transform(F.filter(blocks_, keep), lambda b: b["text"]), " ")


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """pages with the main text of the html column in its place, named `out` (replaced if there).

    Null and empty pages, and pages without an article, have an empty text. Rows
    are handled alone, so repeated rows and ids give a row each.
    """
    model = train_tree(pages.sparkSession)
    name = free_name(pages, "blocks")
    pages = pages.drop(*[c for c in pages.columns if c.lower() == out.lower() and c != html])
    rows = page_blocks(pages, html, name)
    return rows.withColumn(out, main_text(F.col(name), model)).drop(name)
