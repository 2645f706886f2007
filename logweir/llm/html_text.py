"""Main text of web pages by scoring their element tree.

Paragraphs pass points for their length and commas to their ancestors, half as many each
level up; a container's points are discounted by the share of its text that is in links. The
best container is kept, as the article it belongs to if there is one, else with those
siblings that score near it. Menus, page headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments never take part; they are told by element,
role, or the words of class and id. A word alone does not lose an article: words after
``no``, ``has``, ``with`` say nothing, and an element that turns out to be the wrapper of
the article (see ``Tree._leave_out``) stays.

A null or empty page has an empty text, as has a page without any text of its own. Broken
markup is read as browsers do: open elements end with their parent, an unclosed comment
or script reaches to the end. Pages of any length and depth are read whole, in one pass over
the tags and one over the elements.
Repeated rows and null ids and urls are passed on as they are; other columns are not looked at.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, up to their end tag.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg object".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | frozenset("p li td th pre blockquote dd dt figcaption caption summary address".split())
#: Elements that an open one of the same kind ends before.
ENDS = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
#: What an implied end does not reach beyond.
SCOPES = frozenset("ul ol dl table article section div body html menu select main td th".split())
DROPPED = frozenset("nav footer aside form head button select dialog menu fieldset".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class or id of what is never the article's: fixed values.
FIRM_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsored navigation nav navbar breadcrumb breadcrumbs pagination "
    "pager footer cookie cookies consent gdpr newsletter comment comments commentlist disqus replies respond".split()
)
#: Words that wrappers of articles have as well: fixed values.
LOOSE_WORDS = frozenset(
    "sponsor sponsors promo promotion banner menu menus toolbar masthead foot sidebar aside rail widget widgets notice notices notification alert "
    "popup modal overlay subscribe subscription signup login social share sharing related recommended recommendations teaser form search hidden".split()
)
CARD_WORDS = frozenset("comment comments reply teaser ad sponsored related".split())
#: Words that turn the next one into something about another element.
NEGATIONS = frozenset("no not non has have with without".split())
PAGE_HEADERS = frozenset("header".split())
PARAGRAPH_LENGTH = 25
KEEP, LOOSE, FIRM, GONE = range(4)


def class_words(value: str) -> set[str]:
    """Words of a class or id that say what the element is."""
    found = set()
    for name in value.split():
        before = ""
        for word in WORDS.findall(name):
            word = word.lower()
            if before not in NEGATIONS and word not in NEGATIONS:
                found.add(word)
            before = word
    return found


def marked(tag: str, attributes: str, inside_article: bool) -> int:
    """Whether an element is none of the article's: ``GONE`` for sure, ``FIRM`` or ``LOOSE`` by its words, or ``KEEP``."""
    if tag in DROPPED or (tag in PAGE_HEADERS and not inside_article):
        return GONE
    level = KEEP
    if not attributes or tag in ("html", "body"):
        return level
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next(filter(None, values), "")
        if name in ("class", "id"):
            found = class_words(value)
            if tag == "article" and found & CARD_WORDS:
                return GONE
            if tag in ("article", "main"):
                continue
            if found & FIRM_WORDS:
                level = FIRM
            elif found & LOOSE_WORDS or (found & PAGE_HEADERS and not inside_article and tag not in HEADINGS):
                level = max(level, LOOSE)
        elif name == "role" and value.lower() in DROPPED_ROLES:
            return GONE
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return GONE
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return GONE
    # The text of an element inside a line is part of that line, so it is decided at once.
    return level if tag in BLOCKS else GONE if level else KEEP


class Tree:
    """Elements of a page by number (``tags``, ``parents``) and its text blocks in order: (element, text, characters in links)."""

    def __init__(self, page: str):
        self.tags, self.parents, self.dropped, self.marks = ["#page"], [-1], [False], [KEEP]
        self.blocks: list[tuple[int, str, int]] = []
        self._parts: list[str] = []
        self._linked = 0
        self._read(page)
        self._leave_out()

    def _flush(self, owner: int) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                self.blocks.append((owner, text, min(self._linked, len(text))))
            self._parts, self._linked = [], 0

    def _read(self, page: str) -> None:
        # ``links``: places of the open links in the stack; ``opened``: how many of a tag are open.
        stack, owners, articles, links, at = [0], [0], 0, [], 0
        opened: Counter[str] = Counter()
        end = len(page)

        def text(start: int, stop: int) -> None:
            if start < stop and not self.dropped[stack[-1]]:
                piece = html.unescape(page[start:stop])
                self._parts.append(piece)
                if links:
                    self._linked += len(piece.strip())

        def close(depth: int) -> None:
            """End every element from this place of the stack on."""
            nonlocal articles
            while len(stack) > depth:
                tag = self.tags[stack.pop()]
                opened[tag] -= 1
                if tag in BLOCKS:
                    self._flush(owners.pop())
                articles -= tag in ("article", "main")
                if tag == "a":
                    links.pop()

        while at < end:
            found = TAG.search(page, at)
            if found is None:
                break
            text(at, found.start())
            at = found.end()
            tag = (found[2] or "").lower()
            if not tag:
                continue
            if found[1]:
                for depth in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                    if self.tags[stack[depth]] == tag:
                        close(depth)
                        break
                continue
            if tag in RAW:
                if not found[3].endswith("/"):
                    stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                    at = stop.end() if stop else end
                continue
            if tag in BLOCKS:
                self._flush(owners[-1])
                for depth in range(len(stack) - 1, 0, -1):
                    open_tag = self.tags[stack[depth]]
                    if open_tag == "p" or open_tag in ENDS.get(tag, ()) or (tag in HEADINGS and open_tag in HEADINGS):
                        close(depth)
                        break
                    if open_tag in SCOPES and open_tag not in ENDS.get(tag, ()):
                        break
            elif tag == "br":
                self._parts.append(" ")
            if tag in VOID:
                continue
            # A link ends the one before, unless a block lies between.
            if tag == "a" and links and owners[-1] < stack[links[-1]]:
                close(links[-1])
            number = len(self.tags)
            mark = marked(tag, found[3], articles > 0)
            self.tags.append(tag)
            self.parents.append(stack[-1])
            self.dropped.append(self.dropped[stack[-1]] or mark == GONE)
            self.marks.append(mark)
            opened[tag] += 1
            if tag == "a":
                links.append(len(stack))
            stack.append(number)
            if tag in BLOCKS:
                owners.append(number)
            articles += tag in ("article", "main")
        text(at, end)
        close(1)
        self._flush(0)

    def _spread(self) -> None:
        """What is in a dropped element is dropped, its text with it."""
        for node in range(1, len(self.tags)):
            self.dropped[node] = self.dropped[node] or self.dropped[self.parents[node]]
        self.blocks = [block for block in self.blocks if not self.dropped[block[0]]]

    def _sums(self, *own: list[int]) -> None:
        """Add the numbers of every element to those of all that it is in."""
        for node in range(len(self.tags) - 1, 0, -1):
            for numbers in own:
                numbers[self.parents[node]] += numbers[node]

    def _leave_out(self) -> None:
        """Drop the elements marked by their words, but not the wrapper of the article.

        One with a firm word stays for a main element, or an article with its title (h1), in it.
        One with a loose word stays if it has more than half of the page's text outside links and
        is what the article is in, or all that is in the article: either an article or a heading
        is in it and no unmarked article elsewhere, or it is in an unmarked article that has no
        paragraph outside marked elements.
        """
        size = len(self.tags)
        article = [tag in ("article", "main") for tag in self.tags]
        if FIRM in self.marks:
            titles = [int(tag == "h1") for tag in self.tags]
            self._sums(titles)
            holds = [int(self.tags[node] == "main" or (article[node] and titles[node] > 0)) for node in range(size)]
            self._sums(holds)
            for node in range(size):
                if self.marks[node] == FIRM and not holds[node]:
                    self.dropped[node] = True
            self._spread()
        if LOOSE not in self.marks:
            return
        under, home = [False] * size, [0] * size
        for node in range(1, size):
            up = self.parents[node]
            under[node] = under[up] or self.marks[node] == LOOSE
            home[node] = node if article[node] and not under[node] and not self.dropped[node] else home[up]
        prose, paragraphs = [0] * size, [0] * size
        for owner, text, in_links in self.blocks:
            prose[owner] += len(text) - in_links
            if self.tags[owner] not in HEADINGS and not under[owner] and len(text) - in_links >= PARAGRAPH_LENGTH:
                paragraphs[owner] += 1
        self._sums(prose, paragraphs)
        clear = any(home[node] == node and prose[node] for node in range(1, size))
        heads = [int((article[node] or tag in ("h1", "h2", "h3")) and prose[node] > 0) for node, tag in enumerate(self.tags)]
        self._sums(heads)
        for node in range(1, size):
            if self.marks[node] == LOOSE:
                alone = not paragraphs[home[node]] if home[node] else heads[node] > 0 and not clear
                self.dropped[node] = self.dropped[node] or not (alone and 2 * prose[node] > prose[0])
        self._spread()

    def kept(self) -> set[int]:
        """The best container, and the siblings that belong to it."""
        size = len(self.tags)
        points, length, linked = [0.0] * size, [0] * size, [0] * size
        for owner, text, in_links in self.blocks:
            length[owner] += len(text)
            linked[owner] += in_links
            if len(text) >= PARAGRAPH_LENGTH:
                node = self.parents[owner] if self.tags[owner] in PARAGRAPHS else owner
                points[node] += 1 + text.count(",") + min(len(text) / 100, 3)
        for node in range(size - 1, 0, -1):
            length[self.parents[node]] += length[node]
            linked[self.parents[node]] += linked[node]
            points[self.parents[node]] += points[node] / 2
        points[0] = 0.0
        worth = [p * (1 - l / n) if n else 0.0 for p, l, n in zip(points, linked, length)]
        best = max(range(size), key=worth.__getitem__)
        if not worth[best]:
            with_text = [node for node in range(size) if length[node] and not self.dropped[node]]
            for tag in ("article", "main"):
                for node in with_text:
                    if self.tags[node] == tag:
                        return {node}
            return {0}
        for tag in ("article", "main"):
            node = best
            while node > 0:
                if self.tags[node] == tag:
                    return {node}
                node = self.parents[node]
        found, least = {best}, max(10.0, 0.2 * worth[best])
        for node in range(1, size):
            if self.parents[node] == self.parents[best] and node != best and length[node]:
                density = linked[node] / length[node]
                heading = self.tags[node] in ("h1", "h2") and density < 0.5
                if worth[node] >= least or heading or (self.tags[node] == "p" and length[node] > 80 and density < 0.25):
                    found.add(node)
        return found


def main_text(page: str | None) -> str:
    """Blocks of the main text of one page, one to a line."""
    if not page:
        return ""
    tree = Tree(page)
    kept = tree.kept()
    inside = [False] * len(tree.tags)
    for node in range(len(inside)):
        inside[node] = node in kept or (node > 0 and inside[tree.parents[node]])
    return "\n".join(text for owner, text, _ in tree.blocks if inside[owner])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page, in one pass and without a shuffle."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts = [main_text(page.as_py()) for page in batch.column(2)]
                sizes = pa.array([len(text) for text in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    kinds = {name: rows.schema[name].dataType.simpleString() for name in ("page_id", "url")}
    return rows.mapInArrow(read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
