"""Main text of web pages as the maximum-scoring contiguous region of words and tags.

A page is a sequence of words and tags. Words score positive, by the container
they stand in, tags negative; the weights come from labelled pages, those that
mark their content with one ``article`` or ``main`` element: the log odds of words
and tags in and outside of it, over all their text, menus and adverts included.
One linear scan finds the region of the highest sum; a content element that it
touches is taken whole. Containers that can't be content (menus, forms, scripts,
adverts and so on) score nothing for their words and are left out of the text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import whole

#: Distinct labelled pages that weights are fitted on, at most: those of the smallest hashes.
MAX_LABELLED = 2_000
#: Times as many hashes are expected under the limit that goes before their ordering.
SPARE = 4
#: Element names.
CONTENT = {"article", "main"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
LEFT_OUT = {
    "head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "template", "svg", "math",
    "object", "canvas", "audio", "video", "map", "fieldset", "datalist", "figcaption",
}
#: Of these, what an article can show as its own.
KEPT_INSIDE = {"figcaption", "math", "svg", "object", "fieldset", "map", "canvas", "audio", "video"}
#: Elements without a meaning of their own, whose id counts inside an article too.
GROUPS = {"div", "ul", "ol"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
    "mark", "q", "rp", "rt", "ruby", "s", "samp", "script", "small", "style", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LISTS = {"ul", "ol", "menu"}
#: Start tags that end an open paragraph.
ENDS_P = HEADINGS | LISTS | {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form",
    "header", "hr", "main", "nav", "p", "pre", "section", "table",
}
KEPT = {"html", "body", "article", "main"}
#: Parts of class, id and role values that name what isn't content.
NAMED = re.compile(
    r"(?:^|[-_])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|cookies?|consent|"
    r"notices?|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|comments?|replies|reply|disqus|"
    r"widget|toolbar|pagination|pager|copyright|disclaimer|contentinfo|complementary|search)(?:$|[-_])"
)
HAVING = re.compile(r"^(?:has|with|no|is|without)[-_]")
#: Element names that have weights of their own; all others share one.
NAMES = CONTENT | RAW | VOID | LEFT_OUT | INLINE | ENDS_P | KEPT | {
    "body", "caption", "center", "col", "colgroup", "dd", "dt", "html", "legend", "li", "optgroup", "option", "output", "picture", "progress",
    "script", "search", "style", "summary", "tbody", "td", "tfoot", "th", "thead", "tr", "track",
}
CUSTOM = "custom element"
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
TAG_PART = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
HIDDEN_NAME = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.IGNORECASE)
HIDDEN_VALUE = re.compile(r"(?<![\w-])(?:aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"']?[^\"'>]*display\s*:\s*none)", re.IGNORECASE)

#: Weights where there are no labelled pages: of words by container, of tags.
WORDS = {"p": 1.0, "heading": 0.6, "li": 0.3, "other": 0.4}
TAGS = {"p": -0.3, "br": -0.1, "h1": -0.5, "h2": -0.5, "h3": -0.5, "li": -1.5, "div": -1.5, "article": -8.0, "main": -8.0}
OTHER_TAG, INLINE_TAG = -1.0, -0.2


def _named_out(name: str, rest: str, inside: bool) -> str:
    """"out" where attributes say that an element isn't content, "doubted" where they may; inside a content element only whole names say so."""
    if name in KEPT or not rest:
        return ""
    if HIDDEN_VALUE.search(rest) or HIDDEN_NAME.search(QUOTED.sub("", rest)):
        return "out"
    if inside and name in HEADINGS:
        return ""
    said = ""
    for m in ATTRIBUTE.finditer(rest):
        if inside and m[1].lower() == "id" and name not in GROUPS:
            continue
        for part in (m[2] or m[3] or m[4] or "").lower().split():
            if NAMED.fullmatch(part) or not inside and NAMED.search(part) and not HAVING.match(part):
                return "out"
            if inside and m[1].lower() != "id" and NAMED.search(part) and not HAVING.match(part):
                said = "doubted"
    return said


def _ends(open_name: str, name: str, slash: str, lists: int) -> bool:
    """Whether a tag ends an open ``p`` or ``li`` that has no end tag of its own; ``lists`` are open inside it."""
    if open_name == "p":
        return name in ENDS_P and not (slash and name == "p") or bool(slash) and name in ("li", "td", "th", "body", "html")
    return open_name == "li" and not lists and (name in LISTS if slash else name == "li")


class _Reader:
    """Tags and texts of a page in order, in time linear in its length."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True
        self.unclosed: set[str] = set()

    def tag_end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag, beyond quoted values; -1 if there is none."""
        first = seen = at
        while self.quotes and (m := TAG_PART.search(self.page, at)):
            if m[0] == ">":
                return m.start()
            at = m.end()
            if self.page[seen : m.start()].rstrip()[-1:] == "=":
                at = self.page.find(m[0], at) + 1
                if not at:
                    break
            seen = at
        # A quote that nothing closes: from here on there are none, else each tag would be read to the page's end.
        self.quotes = False
        return self.page.find(">", first)

    def raw_end(self, name: str, at: int) -> int:
        """Where the end tag of a raw element stands; -1 if there is none."""
        if name in self.unclosed:
            return -1
        m = re.compile(rf"</{re.escape(name)}[\s/>]", re.IGNORECASE).search(self.page, at)
        if not m:
            self.unclosed.add(name)
        return m.start() if m else -1

    def tokens(self) -> Iterator[tuple[str, str, str, str]]:
        """(slash, name, rest, "") of tags and ("", "", "", text) of texts; what raw elements hold isn't there."""
        page, at, size = self.page, 0, len(self.page)
        while at < size:
            start = page.find("<", at)
            if start < 0:
                yield "", "", "", page[at:]
                return
            if start > at:
                yield "", "", "", page[at:start]
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = size if end < 0 else end + 3
                continue
            slash = "/" if page.startswith("/", start + 1) else ""
            name = NAME.match(page, start + 1 + len(slash))
            marked = not name and page[start + 1 : start + 2] in ("!", "?")
            end = (self.tag_end(name.end()) if name else page.find(">", start)) if name or marked else -1
            if end < 0:  # a sign of its own
                yield "", "", "", "<"
                at = start + 1
                if name or marked:  # and no tag ends after it either
                    yield "", "", "", page[at:]
                    return
                continue
            at = end + 1
            if not name:
                continue
            low = name[0].lower()
            yield slash, low, page[name.end() : end], ""
            if not slash and low in RAW:
                closed = self.raw_end(low, at)
                if closed >= 0:
                    at = closed
                elif low in ("script", "style"):
                    return


def events(page: str, everything: bool = False) -> list[tuple[str, str, str, bool]]:
    """(kind, name or container, text, inside a content element) of a page, in order.

    kind is "tag" or "text"; text of what is left out isn't there, unless ``everything``
    is asked for. An element that is left out ends with its own end tag; without one
    only its tag is meant, but for paragraphs and list items, which then end where
    the next block does. Text inside a content element counts as a paragraph's
    where its container is none, unless the element is doubted.
    """
    tokens = list(_Reader(page).tokens())
    ends = Counter(name for slash, name, _, _ in tokens if slash)
    out: list[tuple[str, str, str, bool]] = []
    skipped, depth, lists, content, last = "", 0, 0, 0, "other"
    doubted, doubts = "", 0
    for slash, name, rest, text in tokens:
        if name:
            if slash:
                ends[name] -= 1
            if skipped and _ends(skipped, name, slash, lists):
                skipped = ""
            if skipped:
                if name == skipped:
                    depth += -1 if slash else 1
                    if not depth:
                        skipped = ""
                elif name in LISTS:
                    lists += -1 if slash else 1
                continue
            out.append(("tag", name if name in NAMES else CUSTOM, "", content > 0))
            if name == doubted:
                doubts += -1 if slash else 1
                doubted = doubted if doubts else ""
            if not slash and name in RAW:
                continue
            if name in CONTENT:
                content = max(0, content + (-1 if slash else 1))
            if not everything and not slash and name not in VOID and not rest.endswith("/"):
                header = name == "header" and not content
                named = _named_out(name, rest, content > 0)
                left_out = name in LEFT_OUT and not (content and name in KEPT_INSIDE)
                if named == "doubted" and not doubted and ends[name] > 0:
                    doubted, doubts = name, 1
                if (left_out or header or named == "out") and (ends[name] > 0 or name in ("p", "li")):
                    skipped, depth, lists = name, 1, 0
            if name == "p" or name in HEADINGS or name == "li":
                last = ("heading" if name in HEADINGS else name) if not slash else "other"
            elif name in ENDS_P:
                last = "other"
        elif not skipped:
            plain = last == "other" and content and not doubted and not everything
            out.append(("text", "p" if plain else last, text, content > 0))
    return out


def words_in(text: str) -> int:
    return len(text.split())


def learned(counts: dict[tuple[str, str], tuple[int, int]]) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of words and tags from (count inside, count outside) over labelled pages."""
    words, tags = dict(WORDS), dict(TAGS)
    for (kind, name), (inside, outside) in counts.items():
        odds = math.log((inside + 1) / (outside + 1))
        if kind == "text":
            words[name] = min(4.0, max(0.1, odds))
        else:
            tags[name] = -min(12.0, max(0.1, 0.3 - odds))
    return words, tags


def label_counts(page: str) -> Counter:
    """What a labelled page says: (kind, name, inside) of all its words and tags; empty if it isn't labelled."""
    found = events(page, everything=True)
    if sum(1 for kind, name, *_ in found if kind == "tag" and name in CONTENT) != 2:
        return Counter()
    out: Counter = Counter()
    for kind, name, text, inside in found:
        out[kind, name, inside and name not in CONTENT] += words_in(text) if kind == "text" else 1
    return out


def main_text(page: str | None, weights: tuple[dict[str, float], dict[str, float]] = (WORDS, TAGS)) -> str:
    """The text of the maximum-scoring region, and of the content elements that it touches.

    On a page without a content element tags weigh no more than by default: that
    they stand outside of articles elsewhere doesn't tell where its content ends.
    """
    words, tags = weights
    found = events(page or "")
    labelled = any(inside for *_, inside in found)
    best, best_from, best_to, total, begin = 0.0, 0, 0, 0.0, 0
    for at, (kind, name, text, _) in enumerate(found):
        if kind == "text":
            total += words[name] * words_in(text)
        else:
            default = INLINE_TAG if name in INLINE else OTHER_TAG
            weight = tags.get(name, default)
            total += weight if labelled else max(weight, TAGS.get(name, default))
        if total > best:
            best, best_from, best_to = total, begin, at + 1
        if total <= 0:
            total, begin = 0.0, at + 1
    if best_to and found[best_from][3]:
        while best_from and found[best_from - 1][3]:
            best_from -= 1
    if best_to and found[best_to - 1][3]:
        while best_to < len(found) and found[best_to][3]:
            best_to += 1
    pieces = [text if kind == "text" else "" if name in INLINE else " " for kind, name, text, _ in found[best_from:best_to]]
    # A reference never reaches over a tag, so pieces are decoded one by one.
    return " ".join("".join(html.unescape(p) if "&" in p else p for p in pieces).split())


def fit(pages: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[dict[str, float], dict[str, float]]:
    """Weights from labelled pages; one row for each of ``NAMES`` comes to the driver.

    ``max_labelled`` distinct pages at most, those of the smallest hashes; each counts
    as often as it occurs. The classifier of words and tags is fitted on this bounded
    sample; every page is scored.
    """
    ship(pages.sparkSession)
    hashes = pages.where(F.col("html").rlike("(?i)<(article|main)[\\s>]")).select(F.xxhash64("html").alias("h"))
    # Only hashes under a limit that some times ``max_labelled`` pages are expected to meet go to the one task that orders them.
    known = hashes.agg(F.approx_count_distinct("h")).first()[0] or 0
    limit = min(2**63 - 1, 2**63 * SPARE * max_labelled // max(known, 1))
    some = hashes.where(F.shiftrightunsigned("h", 1) <= limit).distinct().orderBy("h").limit(max_labelled)
    rows = pages.where(F.col("html").isNotNull()).select("html").join(F.broadcast(some), F.xxhash64("html") == F.col("h"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for page in batch.column(0):
                counts += label_counts(page.as_py())
            rows = [(kind, name, n if inside else 0, 0 if inside else n) for (kind, name, inside), n in counts.items()]
            types = [pa.string(), pa.string(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["kind", "name", "i", "o"])

    counted = rows.mapInArrow(run, "kind string, name string, i long, o long").groupBy("kind", "name").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    return learned({(r.kind, r.name): (r.i, r.o) for r in counted.collect()})


def extract(pages: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages``: the main text and its code points.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
    markup and comments are left out. Character references are decoded, white space
    becomes one space, blocks are joined by one space. Null and empty pages have
    the empty text. Equal rows stay separate rows; ids and urls may be null, an empty
    table stays empty. Without labelled pages the weights are defaults. Of equally
    good regions the first, and of these the shortest, is taken. A page is read in
    time linear in its length, malformed or not: a tag without an end is text.
    """
    weights = fit(pages, max_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), weights) for page in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), whole(F.col("html")).alias("html"))
    found = rows.mapInArrow(run, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
