"""Main text of web pages by tree scoring.

Each text block of a page (a paragraph, heading, list item, cell, or the text
that stands directly in a container) earns points for its length and commas and
passes them to its ancestors, fewer the farther they are. A container's points
are discounted by its link density. The best container, widened to the article
or main element around it, is kept whole, and so are its siblings that hold a
heading or a paragraph and are not mostly links, however short, and a main
heading before it.

What never counts: scripts, forms' fields, menus, footers, sidebars by element
or role, hidden elements, a page's header, menu cells of a table that lays out a
page, and what follows a heading that says "3 comments" or the like. Classes and
ids with words of adverts, notices, menus, comments and the like drop a container
unless it holds an article or main element, or a main heading with a paragraph.
A box's word (share, widget, sidebar, ...) needs a second sign (fields, mostly
links, no sentence) where other words stand beside it, as in ``share-price`` and
``elementor-widget``, or where the box is a headed part of an article with
sentences; and a widget or the like that holds far more prose than the rest of
the page is none. ``with-sidebar``,
``tag-search``, ``comments-open`` and the like say nothing. An article or main
element is dropped by words of comments, adverts and teasers only, and never
where nothing else is left. Dropped elements inside a paragraph don't split it.

Character references are decoded, white space inside a block becomes one space,
blocks are joined by a line feed in page order. Nothing else is dropped.

Nulls, ties, edges: a null or empty page, or one without text, gives an empty
text. Where words drop all text of a page, they are not heeded. Markup that no
rule of HTML covers is read as a comment; a page that the parser gives up on is
cut at its tags from there on. Of containers with equal scores the first in the
page wins. Repeated rows are extracted one by one; deep nesting is no recursion.
Columns named as an output are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.llm.common import prepare

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr
    html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul""".split()
)
DROPPED = frozenset("head script style noscript template iframe svg canvas object embed nav footer aside button select textarea input label fieldset dialog menu audio video search".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar status".split())
# Words of classes and ids. Those of a page's frame drop what holds a main heading, too.
FRAME_WORDS = frozenset("banner breadcrumb breadcrumbs cookie cookies consent gdpr menu navbar nav navigation pagination pager footer masthead topbar toolbar skip login".split())
TEASER_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promos promoted promotion comment comments commentlist disqus replies
    respond related recommended recommendations""".split()
)
BOX_WORDS = frozenset("notice notices notification notifications alert sidebar aside share sharing social newsletter subscribe signup popup modal overlay widget widgets search".split())
INLINE_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo share sharing social".split())
# Words beside which a box's word still says all: "share-buttons" is a box, "share-price" and "elementor-widget" are names of something else.
PLAIN_WORDS = frozenset(
    """area article bar block body bottom box btn button buttons card col column container content entry footer form head header icons inline inner item js left link links list main message
    nav of on outer page panel post primary right row secondary section site text the this title to top us wrap wrapper""".split()
)
HOLDING_WORDS = frozenset("widget widgets share sharing social search overlay modal popup alert".split())  # may name what holds an article
HOLDS_MORE = 4
NO_WORDS = frozenset("with without has no is category cat tag open closed enabled disabled".split())  # what such a name says is another thing
HEADER_WORDS = frozenset({"header", "hdr"})
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
PARAGRAPHS = frozenset({"p", "pre", "li", "td", "th", "dd", "dt", "blockquote", "figcaption", "caption", "summary", *HEADINGS})
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset({"table", "ul", "ol", "dl", "body", "html", "article", "section", "div", "main"})
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_NO_WORD = re.compile(r"[^a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_TAG = re.compile(r"<(script|style)\b.*?(?:</\1\s*>|$)|<[!/?a-zA-Z][^>]*>?", re.I | re.S)
_SENTENCE = re.compile(r"\w\W*\s\W*\w.*[.!?…。！？]", re.S)
_COMMENTS = re.compile(r"(\d[\d.,]*\s+)?(reader\s+|user\s+)?(comments?|replies|responses)(\s*\(\d[\d.,]*\))?\s*:?", re.I)
_RIGHTS = re.compile(r"(©|\(c\)\s|copyright\b)", re.I)
MOST_LINKS = 0.5


def _words(attrs: list[tuple[str, str | None]]) -> tuple[set[str], int]:
    """The words of all classes and ids that say what an element is, and whether they say that it is a box: 2, or 1 if other words are beside."""
    out: set[str] = set()
    box = 0
    for name in " ".join(v for k, v in attrs if k in ("class", "id") and v).split():
        said = set(_NO_WORD.split(_CAMEL.sub(" ", name).lower())) - {""}
        if not said & NO_WORDS:
            out |= said
            if said & BOX_WORDS:
                box = max(box, 2 if said <= BOX_WORDS | FRAME_WORDS | TEASER_WORDS | PLAIN_WORDS else 1)
    return out, box


class _Page(HTMLParser):
    """Nodes of a page in page order, as parallel lists, and its text blocks outside of what never counts."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.dropped, self.words, self.box, self.fields = [-1], ["#"], [False], [frozenset()], [0], [False]
        self.open = [0]
        self.links = 0
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters in links
        self.pieces: list[str] = []
        self.linked = 0

    def parse_html_declaration(self, i: int) -> int:
        """A marked section is a comment up to the next ">", as in browsers."""
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)

    def _flush(self) -> None:
        if self.pieces:
            if text := " ".join("".join(self.pieces).split()):
                at = next(i for i in reversed(self.open) if i == 0 or self.tag[i] in BLOCKS)
                self.blocks.append((at, text, min(self.linked, len(text))))
            self.pieces, self.linked = [], 0

    def _close_to(self, place: int) -> None:
        for i in self.open[place:]:
            self.links -= self.tag[i] == "a"
        del self.open[place:]

    def _close_last(self, tags: tuple[str, ...], scopes: frozenset[str]) -> None:
        for place in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[place]]
            if tag in tags:
                self._close_to(place)
                return
            if tag in scopes:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.pieces.append(" ")
            return
        block = tag in BLOCKS
        if block:
            self._flush()
            if tag in ENDS_P:
                self._close_last(("p",), SCOPES)
            if tag in CLOSES:
                self._close_last(CLOSES[tag], SCOPES - {"div", "section"})
            if tag == "body":
                self._close_last(("head",), frozenset())
        if tag in VOID:
            self.fields[self.open[-1]] |= tag == "input"
            return
        up = self.open[-1]
        role = next((v.lower() for k, v in attrs if k == "role" and v), "")
        hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and _HIDDEN.search(v) for k, v in attrs)
        words, box = _words(attrs) if attrs else (set(), 0)
        root = tag in ("html", "body")
        gone = tag in DROPPED or hidden or role in DROPPED_ROLES or not block and words & INLINE_WORDS and not any(self.tag[i] in ("pre", "code") for i in self.open)
        self.parent.append(up)
        self.tag.append(tag)
        self.dropped.append(self.dropped[up] or not root and bool(gone))
        self.words.append(frozenset() if root or not block else frozenset(words))
        self.box.append(box if block and not root else 0)
        self.fields.append(tag in ("form", "input", "textarea", "select"))
        self.open.append(len(self.tag) - 1)
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for place in range(len(self.open) - 1, 0, -1):
            if self.tag[self.open[place]] == tag:
                if tag in BLOCKS:
                    self._flush()
                elif any(self.tag[i] in BLOCKS for i in self.open[place:]):
                    return  # an inline end tag doesn't close the blocks inside
                self._close_to(place)
                return

    def handle_data(self, data: str) -> None:
        if self.dropped[self.open[-1]]:
            return
        self.pieces.append(data)
        if self.links:
            self.linked += len(data)

    def read(self, html: str) -> None:
        try:
            self.feed(html)
            self.close()
        except AssertionError:  # the parser's own way to say that it is lost
            self.pieces.append(unescape(_TAG.sub(" ", self.rawdata)))
        self._flush()


def _boxes(page: _Page, article: list[bool], headed: list[bool]) -> list[bool]:
    """Whether each node is a box by its words, and by a second sign where these leave doubt.

    Doubtful are names with other words in them, and parts of an article with a
    heading of their own and a sentence. Signs are fields to fill in, a text that
    is mostly links, or one without a sentence.
    """
    parent = page.parent
    n = len(parent)
    length, links, prose, fields = [0] * n, [0] * n, [0] * n, list(page.fields)
    for node, text, linked in page.blocks:
        length[node] += len(text)
        links[node] += linked
        prose[node] += (len(text) - linked) * bool(_SENTENCE.search(text))
    for i in range(n - 1, 0, -1):
        for x in (length, links, prose):
            x[parent[i]] += x[i]
        fields[parent[i]] |= fields[i]
    named = [False] * n
    for i in range(1, n):
        if page.box[i]:
            sure = page.box[i] == 2 and not (article[parent[i]] and headed[i] and prose[i])
            named[i] = sure or fields[i] or not prose[i] or links[i] >= MOST_LINKS * length[i]
    # What holds far more prose than all outside of boxes is no box, but for those that never hold an article.
    inside = [False] * n
    for i in range(1, n):
        inside[i] = inside[parent[i]] or named[i] or page.dropped[i]
    rest = sum((len(text) - linked) * bool(_SENTENCE.search(text)) for node, text, linked in page.blocks if not inside[node])
    return [x and not (page.words[i] & HOLDING_WORDS and not page.words[i] & (BOX_WORDS - HOLDING_WORDS) and not fields[i] and prose[i] > HOLDS_MORE * rest) for i, x in enumerate(named)]


def _outside(page: _Page, heed_words: bool) -> list[bool]:
    """Whether each node is outside of what counts: by its words, in a page's header, or as readers' comments."""
    parent, tag, words = page.parent, page.tag, page.words
    n = len(tag)
    whole, title, prose = [False] * n, [False] * n, [False] * n  # holds an article or main element, a main heading, a paragraph
    headed, article = [False] * n, [False] * n
    for i in range(1, n):
        article[i] = article[parent[i]] or tag[i] in ("article", "main")
    for i in range(n - 1, 0, -1):
        headed[i] |= tag[i] in HEADINGS
        headed[parent[i]] |= headed[i]
    boxes = _boxes(page, article, headed) if heed_words else [False] * n
    named = [heed_words and bool(words[i] & TEASER_WORDS) if tag[i] in ("article", "main") else heed_words and (tag[i] == "form" or boxes[i] or bool(words[i] & (FRAME_WORDS | TEASER_WORDS))) for i in range(n)]
    for i in range(n - 1, 0, -1):
        if page.dropped[i]:
            continue
        whole[i] |= tag[i] in ("article", "main") and not named[i]
        title[i] |= tag[i] == "h1"
        prose[i] |= tag[i] == "p"
        for x in (whole, title, prose):
            x[parent[i]] |= x[i]
    out, header = [False] * n, [False] * n
    for i in range(1, n):
        up = parent[i]
        kept = whole[i] or title[i] and prose[i] and not words[i] & FRAME_WORDS
        header[i] = header[up] or (tag[i] == "header" or bool(words[i] & HEADER_WORDS)) and not (article[up] and headed[i]) and not whole[i]
        out[i] = out[up] or named[i] and not kept or header[i]
    said = {node: text for node, text, _ in page.blocks}
    children: dict[int, list[int]] = {}
    for i in range(1, n):
        children.setdefault(parent[i], []).append(i)
    for i in range(1, n):
        if tag[i] in HEADINGS and tag[i] != "h1" and _COMMENTS.fullmatch(said.get(i, "")):
            # The comments go on to the next heading of that rank.
            for j in [x for x in children[parent[i]] if x >= i]:
                if j > i and tag[j] in HEADINGS and tag[j] <= tag[i] or whole[j]:
                    break
                out[j] = True
    for i in range(1, n):
        out[i] = out[i] or out[parent[i]]
    return out


def _menu_cells(page: _Page, blocks: list[tuple[int, str, int]]) -> set[int]:
    """Cells of a table that lays out a page, one that holds paragraphs or a main heading, whose text is links alone."""
    parent, tag = page.parent, page.tag
    lays: set[int] = set()
    for node, _, _ in blocks:
        if tag[node] in ("p", "h1"):
            at = parent[node]
            while at > 0 and tag[at] != "table":
                at = parent[at]
            lays.add(at)
    length: dict[int, list[int]] = {}
    for node, text, linked in blocks:
        at = node
        while at > 0 and tag[at] not in ("td", "th"):
            at = parent[at]
        if at > 0:
            sums = length.setdefault(at, [0, 0])
            sums[0] += len(text)
            sums[1] += linked
    out = set()
    for cell, (n, linked) in length.items():
        at = parent[cell]
        while at > 0 and tag[at] != "table":
            at = parent[at]
        if at in lays and linked >= n:
            out.add(cell)
    return out


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    page = _Page()
    page.read(html)
    parent, tag = page.parent, page.tag
    n = len(tag)
    for heed_words in (True, False):
        out = _outside(page, heed_words)
        blocks = [(i, text, linked) for i, text, linked in page.blocks if not out[i]]
        if "table" in tag and (cells := _menu_cells(page, blocks)):
            for i in range(1, n):
                out[i] = out[i] or out[parent[i]] or i in cells
            blocks = [b for b in blocks if not out[b[0]]] or blocks
        if blocks:
            break
    else:
        return ""
    points, length, links = [0.0] * n, [0] * n, [0] * n
    reads = [False] * n  # holds a heading or a paragraph
    for node, text, linked in blocks:
        worth = 1 + text.count(",") + min(len(text) / 100, 3)
        at, level = (parent[node], 0) if tag[node] in PARAGRAPHS else (node, 0)
        while at >= 0 and level < 6:
            points[at] += worth / (1 if level == 0 else 2 * level)
            at, level = parent[at], level + 1
        length[node] += len(text)
        links[node] += linked
        reads[node] |= tag[node] in PARAGRAPHS and not (_RIGHTS.match(text) and tag[node] not in HEADINGS)
    for i in range(n - 1, 0, -1):
        length[parent[i]] += length[i]
        links[parent[i]] += links[i]
        reads[parent[i]] |= reads[i]
    score = [points[i] * (1 - links[i] / length[i]) if length[i] else 0.0 for i in range(n)]
    best = max((i for i in range(n) if (i == 0 or tag[i] in BLOCKS) and tag[i] not in PARAGRAPHS), key=lambda i: (score[i], -i))
    at = best
    while at > 0:
        if tag[at] in ("article", "main"):
            best = at
        at = parent[at]
    while best > 0 and length[parent[best]] == length[best]:
        best = parent[best]  # what only wraps it has no siblings of its own to give
    kept = [False] * n
    kept[best] = True
    if best > 0:
        for i in range(1, n):
            if parent[i] == parent[best] and reads[i] and links[i] < MOST_LINKS * length[i]:
                kept[i] = True
        # A paragraph between these is part of the text, even if it is one link.
        run = [i for i in range(1, n) if kept[i]]
        for i in range(run[0], run[-1]):
            kept[i] |= parent[i] == parent[best] and tag[i] in PARAGRAPHS
    for i in range(1, n):
        kept[i] = kept[i] or kept[parent[i]] or tag[i] == "h1" and i < best and not out[i]
    return "\n".join(text for i, text, _ in blocks if kept[i])


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without ``html``, with ``text`` and ``n_chars``, its code points."""
    prepare(pages.sparkSession)
    rest = pages.drop(html, "text", "n_chars")
    schema = T.StructType([*rest.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*batch.schema.names[:-1], "text", "n_chars"])

    return pages.select(*rest.columns, F.col(html).alias("__html")).mapInArrow(run, schema)


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    """The main text of every page of ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
