"""Main text of web pages by consensus host paths.

1. Every page is read once as a stream of tags and text.  Its blocks carry the path of the containers around them, each
   generalised to tag and classes with digits blanked.  Menus, headers, footers, sidebars, notices, adverts, forms,
   comments and the like, by element or by class, id and role words, are left out.
   Words that article text has in its classes too, and ids of headings, paragraphs and sections, count outside the main
   container only.  A form with most of the page's text is kept.
2. A container's score is the text below it that is not link text.  The page votes for an article or main element with most
   of it, else for the smallest container with all article-like blocks: what it leaves behind is links, notes or scraps.
3. Votes are counted per host and path in Spark, combined before the shuffle; a host's winner is the path with most votes.
4. Every page is read again and the text below its host's winning path is its main text; a page without that container,
   with no text in it, or with article-like blocks around it takes its own best.  Winners are broadcast within a checked size, else joined; the pages
   themselves move only in the latter case.

Cases: null and empty pages have no text (empty string); urls without host vote together under the empty host; equal
votes go to the higher score, then the lower path; pages that repeat are worked on one by one; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, Window  # noqa: F401
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.functions.joins import bounded
from tallyscope.llm.common import small_batches, stage
from tallyscope.llm.url_filters import url_host

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(hidden)\b""")
# Elements whose content is not markup: skipped to their end tag.
RAW = frozenset(("script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
INLINE = frozenset((
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img", "picture", "ruby", "rb", "rt", "rp",
    "math", "semantics", "annotation", "annotation-xml", "mrow", "mi", "mn", "mo", "ms", "mtext", "mspace", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot",
    "mover", "munder", "munderover", "mtable", "mtr", "mtd", "mstyle", "mpadded", "mphantom", "menclose", "mmultiscripts",
))
CONTAINERS = frozenset(("html", "body", "div", "article", "main", "section", "center", "td", "th", "figure", "dd"))
LEFT_OUT = frozenset((
    "head", "nav", "footer", "aside", "form", "button", "select", "svg", "template", "menu", "dialog", "object", "canvas", "audio", "video", "annotation", "annotation-xml",
))
LEFT_OUT_WORDS = frozenset((
    "nav", "navbar", "navigation", "menu", "menubar", "header", "masthead", "topbar", "footer", "sidebar", "aside", "complementary", "contentinfo",
    "rail", "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "sponsors", "promo", "promotion", "banner",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "dialog",
    "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "discussion", "share", "sharing", "social", "related", "recommended",
    "newsletter", "subscribe", "subscription", "signup", "login", "signin", "search", "breadcrumb", "breadcrumbs", "pagination", "pager",
    "toolbar", "widget", "widgets", "copyright", "disclaimer", "hidden",
))
# Of these, the words that also stand in classes of article text: they count outside the main container only.
WEAK_WORDS = frozenset((
    "menu", "header", "masthead", "footer", "aside", "rail", "banner", "promotion", "notice", "notices", "notification", "alert", "overlay", "dialog",
    "reply", "replies", "respond", "discussion", "social", "related", "recommended", "search", "toolbar", "widget", "widgets", "copyright", "disclaimer",
    "login", "signin", "signup", "subscription", "consent", "complementary", "contentinfo", "navigation", "modal", "advertising", "sponsors", "sponsor",
))
BY_CLASS = frozenset(("p", "section", "h1", "h2", "h3", "h4", "h5", "h6"))  # their ids are made from headings
# Words that say nothing of the content: a class of these and words left out still marks a paragraph, heading or section.
PLAIN_WORDS = frozenset((
    "area", "block", "body", "box", "button", "buttons", "container", "content", "count", "form", "inner", "item", "items", "label", "link", "links", "list",
    "section", "slot", "text", "thread", "title", "unit", "wrap", "wrapper", "js", "is", "the", "a", "",
))
NOTE = re.compile(r"(?i)\W*(?:©|\(c\)|copyright\b|all rights reserved)")
KEPT_WORDS = frozenset(("has", "with", "without", "no"))
OWN_CLOSES = {  # a start tag that ends an open element of these kinds, up to the nearest container
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
SCOPE = frozenset(("ul", "ol", "dl", "table", "article", "section", "div", "main", "body", "html", "td", "th", "aside", "nav", "form", "footer", "header", "blockquote"))
LEAST_WORDS = 5  # of a block that is taken for article text


HARD, WEAK = 2, 1


def _attributes(tag: str, raw: str) -> tuple[str, int]:
    """(class words, HARD if to be left out anywhere by class, id, role or being hidden, WEAK if outside the main container).

    A paragraph, heading or section of the article is not left out for one word of a longer name (share-price, ad-hoc).
    """
    classes, names, mark = "", [], 0
    for m in ATTR.finditer(raw):
        k, v = (m[1] or m[5]).lower(), next((x for x in m.group(2, 3, 4) if x is not None), "")
        if k == "class":
            classes = v
            names.append((v, False))
        elif k in ("id", "role"):
            names.append((v, tag in BY_CLASS))
        elif k == "hidden" or k == "aria-hidden" and v == "true" and tag != "math" or k == "style" and re.search(r"display\s*:\s*none", v):
            mark = HARD
    for value, weak in names:
        for name in value.split():
            words = [w.strip("0123456789").lower() for w in re.split(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])", name)]
            if not KEPT_WORDS.intersection(words) and (found := LEFT_OUT_WORDS.intersection(words)):
                other = tag in BY_CLASS and not LEFT_OUT_WORDS.union(PLAIN_WORDS).issuperset(words)
                mark = max(mark, WEAK if weak or other or found <= WEAK_WORDS else HARD)
    return classes, mark


def _label(tag: str, classes: str) -> str:
    return ".".join([tag, *sorted({re.sub(r"\d+", "#", c) for c in classes.split()})])


def blocks_of(html: str, by_words: bool = True) -> list[tuple[tuple[str, ...], str, int, int | None, bool]]:
    """(container path, text, characters of link text, mark, is headline) of the blocks in page order, without what is left out.

    The mark is the number of containers around the outermost element marked WEAK outside an article, None without one.  The
    text of a form is left out unless it is most of the page's.
    """
    out = []
    stack: list[list] = []  # [tag, is left out, is container, is marked WEAK]
    path: list[str] = []
    marks: list[int] = []  # containers around the open WEAK elements outside an article
    weak = forms = heads = 0  # open WEAK elements in an article, forms, headlines
    in_form: list[bool] = []
    hidden = links = 0  # open elements left out; open anchors
    text: list[str] = []
    linked = 0
    inside = 0  # open article or main elements

    def flush():
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            of_links = min(linked, len(joined))
            # Below a WEAK mark in an article, lists of links are no text.
            if joined and not (weak and 2 * of_links > len(joined)):
                out.append((tuple(path), joined, of_links, marks[0] if marks else None, heads > 0))
                in_form.append(forms > 0)
            text.clear()
            linked = 0

    def pop():
        nonlocal hidden, links, inside, weak, forms, heads
        tag, gone, box, marked = stack.pop()
        hidden -= gone
        if marked == "outside":
            marks.pop()
        weak -= marked == "inside"
        forms -= tag == "form"
        heads -= tag == "h1"
        if box:
            path.pop()
        if tag == "a":
            links -= 1
        elif tag in ("article", "main"):
            inside -= 1

    at, n = 0, len(html)
    while at < n:
        m = TAG.search(html, at)
        piece = html[at : m.start()] if m else html[at:]
        if piece and not hidden:
            piece = unescape(piece) if "&" in piece else piece
            text.append(piece)
            if links:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0].startswith("<![CDATA[") and not hidden:
                text.append(m[0][9:-3] if m[0].endswith("]]>") else m[0][9:])
            continue
        tag, closing, attrs = name.lower(), m[1] or m[4], m[3] if m[2] else m[6]
        if closing:
            if tag not in INLINE:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    while len(stack) > i:
                        pop()
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break  # an inline end tag does not reach out of its block
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in INLINE:
            flush()
            # A block ends an open paragraph with all its inline elements, and a list item or cell its like.
            ends = ("p", *OWN_CLOSES.get(tag, ()))
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    while len(stack) > i:
                        pop()
                    if stack and tag in OWN_CLOSES:
                        continue
                    break
                if stack[i][0] in SCOPE:
                    break
        if tag in VOID or attrs.endswith("/") and tag not in CONTAINERS:
            continue
        classes, mark = _attributes(tag, attrs) if attrs.strip() else ("", 0)
        if not by_words or tag in ("html", "body", "article", "main"):
            mark = 0
        if tag == "header" and not inside:
            mark = max(mark, WEAK)
        gone = mark == HARD or tag in LEFT_OUT and tag != "form"
        box = tag in CONTAINERS
        marked = "" if mark != WEAK else "inside" if inside else "outside"
        stack.append([tag, gone, box, marked])
        hidden += gone
        if marked == "outside":
            marks.append(len(path))
        weak += marked == "inside"
        forms += tag == "form"
        heads += tag == "h1"
        if box:
            path.append(_label(tag, classes))
        if tag == "a":
            links += 1
        elif tag in ("article", "main"):
            inside += 1
    flush()
    sizes = [len(x[1]) - x[2] if x[3] is None else 0 for x in out]
    if any(in_form) and 2 * sum(n for n, f in zip(sizes, in_form) if f) <= sum(sizes):
        out = [x for x, f in zip(out, in_form) if not f]
    return out


def page_blocks(html: str | None):
    """Blocks of a page; if the words of classes leave nothing, those of the elements alone."""
    if not html:
        return []
    blocks = blocks_of(html)
    if any(b[3] is None for b in blocks):
        return blocks
    return [(*b[:3], None, b[4]) for b in blocks_of(html, by_words=False)]


def _article_like(text: str, linked: int, headline: bool) -> bool:
    return 2 * linked <= len(text) and not NOTE.match(text) and (headline or len(text.split()) >= LEAST_WORDS)


def best_container(blocks) -> tuple[tuple[str, ...], int] | None:
    """(path, score) of the page's main container: an article or main element with most of the text, else the smallest container
    that holds all article-like blocks."""
    score: dict = defaultdict(int)
    likes: dict = defaultdict(int)
    for path, text, linked, mark, headline in blocks:
        if mark is None:
            like = _article_like(text, linked, headline)
            for i in range(len(path) + 1):
                score[path[:i]] += len(text) - linked
                likes[path[:i]] += like
    if not score:
        return None
    top = max(score.values())
    article = [p for p in score if p and p[-1].split(".")[0] in ("article", "main") and 2 * score[p] > top]
    if article:
        best = max(article, key=lambda p: (score[p], -len(p), p))
    else:
        # Without article-like blocks, the one with the best score.
        best = max((p for p in score if likes[p] == likes[()]), key=lambda p: (len(p), score[p], p) if likes[()] else (score[p], len(p), p))
    return best, score[best]


def text_below(blocks, path: tuple[str, ...]) -> str:
    """Text of the blocks below `path`.  WEAK marks inside it do not count, unless it is the page as a whole or the block is links."""
    n = len(path)
    whole = not path or path[-1].split(".")[0] in ("html", "body")
    return "\n\n".join(
        t for p, t, linked, mark, _ in blocks if p[:n] == path and (mark is None or not whole and mark >= n and 2 * linked <= len(t)))


VOTE = T.StructType([T.StructField("path", T.StringType()), T.StructField("score", T.LongType())])


@F.pandas_udf(VOTE)
def vote(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for html in pages:
        best = [best_container(page_blocks(h)) for h in html]
        yield pd.DataFrame({"path": ["/".join(b[0]) if b else None for b in best], "score": [b[1] if b else 0 for b in best]})


@F.pandas_udf(T.StringType())
def main_text(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for pages, paths in parts:
        out = []
        for html, path in zip(pages, paths):
            blocks = page_blocks(html)
            host = (tuple(path.split("/")) if path else ()) if path is not None else None
            text = text_below(blocks, host) if host is not None else ""
            best = best_container(blocks)
            # A page that has more article text around its host's container takes all of it.
            if best and (not text or len(best[0]) < len(host) and host[: len(best[0])] == best[0]):
                text = text_below(blocks, best[0])
            out.append(text)
        yield pd.Series(out, dtype=object)


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the container path with most votes per host."""
    votes = pages.select(url_host(F.col("url")).alias("host"), vote("html").alias("v")).filter("v.path IS NOT NULL")
    counts = votes.groupBy("host", F.col("v.path").alias("path")).agg(F.count(F.lit(1)).alias("n"), F.sum("v.score").alias("score"))
    # Least of the negated figures: most votes, then the higher score, then the lower path.
    best = counts.groupBy("host").agg(F.min(F.struct((-F.col("n")).alias("n"), (-F.col("score")).alias("s"), "path")).alias("b"))
    return best.select("host", F.col("b.path").alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)
    winners = stage(host_paths(pages), "host-paths")
    d = pages.select("page_id", "url", "html", url_host(F.col("url")).alias("host")).join(bounded(winners), "host", "left")
    return d.select("page_id", "url", main_text("html", "path").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
