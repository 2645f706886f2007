from __future__ import annotations

import random
import time
from html.parser import HTMLParser

import pytest

from logweir.llm.html_text import extract, main_text

LONG = "A first sentence, with commas, that goes on for long enough to count as a paragraph of the text."
SECOND = "And then another one, also long enough, that says some more about the very same matter."


@pytest.mark.parametrize(
    "body",
    [
        f"<nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{LONG}<p>{SECOND}</article><footer>foot</footer>",
        f"<div id=sidebar><p>{LONG}</p></div><div class='post'><h1>Title</h1><p>{LONG}</p><p>{SECOND}</p></div><div class='comments'><p>{LONG}</p></div>",
        f"<header><h1>Site</h1></header><main><h1>Title</h1><p>{LONG}</p><form><p>{LONG}</p></form><p>{SECOND}</p></main>",
        f"<div><h1>Title</h1><div><p>{LONG}</p><div class='ad box'>Buy, buy, buy this thing that is so good</div><p>{SECOND}</p></div></div><ul><li><a href=x>{LONG}</a></ul>",
        f"<div class='cookie-notice'>{LONG}</div><article><h1>Title</h1><aside>{LONG}</aside><p>{LONG}</p>\n<p>{SECOND}</p><section class=comments><article><p>{LONG}</p></article></section></article>",
        f"<script>document.write('<p>{LONG}</p>')</script><style>p{{}}</style><article><h1>Title</h1><p>{LONG}<!-- <p>no</p> --></p><p hidden>{LONG}</p><p>{SECOND}",
    ],
)
def test_only_the_article_is_left(body):
    assert main_text(f"<!DOCTYPE html><html><head><title>T</title></head><body>{body}</body></html>") == f"Title\n{LONG}\n{SECOND}"


def test_text_of_blocks():
    page = "<article><p>a &amp; b&nbsp;&#233;\n  <b>c</b>d<br>e &lt;p&gt; &unknown; 1 < 2</p><pre> x \n y </pre><ul><li>one<li>two</ul>tail</article>"
    assert main_text(page) == "a & b é cd e <p> &unknown; 1 < 2\nx y\none\ntwo\ntail"


@pytest.mark.parametrize("page", [None, "", "<html></html>", "<!-- open", "<script>x", "<p", "</p></p>", "<nav>only a menu</nav>"])
def test_pages_without_text(page):
    assert main_text(page) == ""


def test_deep_and_long_pages():
    assert main_text("<div>" * 20_000 + LONG + "</div>" * 20_000) == LONG
    assert main_text(f"<article>{f'<p>{LONG}</p>' * 5_000}</article>").count("\n") == 4_999


def test_rows_are_kept(spark):
    rows = [(1, "u", f"<p>{LONG}</p>", "t"), (1, "u", f"<p>{LONG}</p>", "t"), (None, None, None, None), (2, "v", "plain ä", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, extract(pages).collect()), key=repr)
    assert got == sorted([(1, "u", LONG, len(LONG))] * 2 + [(None, None, "", 0), (2, "v", "plain ä", 7)], key=repr)
    assert extract(pages.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["class='layout has-sidebar'", "class=no-sidebar", "class=search-results", "class=share-price", "class=col-widget", "id=form-guide", "class='ad-box'"])
def test_wrappers_of_an_article_stay(name):
    assert main_text(f"<body><div {name}><article><h1>Title</h1><p>{LONG}</p><p>{SECOND}</p></article></div><p>{SECOND}</p></body>") == f"Title\n{LONG}\n{SECOND}"


def test_marked_elements_beside_an_article_go():
    for name in ("ad", "comments", "sidebar", "related-posts", "share", "notice"):
        assert main_text(f"<article><h1>Title</h1><p>{LONG}</p></article><div class={name}><h2>More</h2><p>{SECOND} {LONG}</p></div>") == f"Title\n{LONG}"
        assert main_text(f"<article><h1>Title</h1><p>{LONG}</p><div class={name}><p>{SECOND} {LONG}</p></div></article>") == f"Title\n{LONG}"
    assert main_text(f"<div class=cookie-notice><h2>Cookies</h2><p>{LONG}</p></div>") == ""


def test_formulas_and_notes_of_the_article_stay():
    assert main_text(f"<article><p>{LONG}</p><div role=note>Note <math><mi>x</mi><mo>=</mo><mn>1</mn></math></div></article>") == f"{LONG}\nNote x=1"


def test_deep_pages_take_time_by_their_length():
    def seconds(depth):
        started = time.perf_counter()
        assert main_text("".join(f"<div class=widget><p>{LONG}</p>" for _ in range(depth)) + "</span>" * depth) == ""
        assert main_text("".join(f"<div><p>{LONG}</p>" for _ in range(depth)) + "</span>" * depth).count("\n") >= depth - 1
        return time.perf_counter() - started

    seconds(100)
    assert seconds(16_000) < 40 * max(seconds(1_000), 0.01)


class Plain(HTMLParser):
    """Nested lists [tag, class, children], children being elements or texts."""

    def __init__(self, page):
        super().__init__()
        self.open = [["#page", "", []]]
        self.feed(page)
        self.root = self.open[0]

    def handle_starttag(self, tag, attrs):
        self.open[-1][2].append([tag, dict(attrs).get("class", ""), []])
        self.open.append(self.open[-1][2][-1])

    def handle_endtag(self, tag):
        assert self.open.pop()[0] == tag

    def handle_data(self, data):
        self.open[-1][2].append(data)


def plainly(page: str) -> str:
    """The definition on a well-formed page, every figure taken anew from the whole tree below an element."""
    root = Plain(page).root
    nodes, parent, inline = [], {}, ("a", "b")
    words = lambda node: set(node[1].split("-")) if "has" not in node[1] else set()

    def walk(node, up):
        nodes.append(node)
        parent[id(node)] = up
        for child in node[2]:
            if isinstance(child, list) and child[0] not in inline:
                walk(child, node)

    walk(root, None)
    gone: set[int] = set()

    def above(node):
        while node is not None:
            yield node
            node = parent[id(node)]

    def runs(node):
        """Blocks in order: (element, text, characters in links)."""
        found, parts = [], []

        def end():
            text = " ".join("".join(part for part, _ in parts).split())
            if text:
                found.append((node, text, min(sum(len(part.strip()) for part, linked in parts if linked), len(text))))
            parts.clear()

        def line(items, linked):
            for item in items:
                if isinstance(item, str):
                    parts.append((item, linked))
                elif item[0] in inline:
                    if not words(item) & {"sidebar", "ad"}:
                        line(item[2], linked or item[0] == "a")
                else:
                    end()
                    found.extend(runs(item) if id(item) not in gone else [])

        line(node[2], False)
        end()
        return found

    below = lambda node: [other for other in nodes if any(up is node for up in above(other)) and not any(id(up) in gone for up in above(other))]
    prose = lambda node: sum(len(text) - linked for _, text, linked in runs(node)) if below(node) else 0
    roots = ("article", "main")
    gone |= {id(node) for node in nodes if node[0] in ("nav", "aside") or (node[0] == "article" and "ad" in words(node))}
    firm = [node for node in nodes if "ad" in words(node) and node[0] not in roots]
    gone |= {
        id(node) for node in firm
        if not any(o[0] == "main" or (o[0] == "article" and any(x[0] == "h1" for x in nodes if any(u is o for u in above(x)))) for o in nodes if any(u is node for u in above(o)))
    }
    loose = [node for node in nodes if "sidebar" in words(node) and node[0] not in roots]
    is_loose = lambda node: any(node is other for other in loose)
    under = lambda node: any(is_loose(up) for up in above(node))
    home = lambda node: next((up for up in above(node) if up[0] in roots and not under(up) and id(up) not in gone), None)
    clear = any(node[0] in roots and not under(node) and prose(node) for node in below(root))
    judged = set()
    for node in loose:
        own = home(node)
        if own is not None:
            alone = not any(o[0] not in ("h1", "h2") and not under(o) and len(t) - n >= 25 for o, t, n in runs(own))
        else:
            alone = not clear and any(o[0] in (*roots, "h1", "h2") and prose(o) for o in below(node))
        if not (alone and 2 * prose(node) > prose(root)):
            judged.add(id(node))
    gone |= judged

    def density(node):
        size = sum(len(text) for _, text, _ in runs(node))
        return sum(linked for *_, linked in runs(node)) / size if size else None

    def worth(node):
        total = 0.0
        for owner, text, _ in runs(node):
            start = parent[id(owner)] if owner[0] in ("p", "h1", "h2", "li") else owner
            level = next((n for n, up in enumerate(above(start)) if up is node), None)
            if len(text) >= 25 and level is not None:
                total += (1 + text.count(",") + min(len(text) / 100, 3)) / 2**level
        return total * (1 - density(node)) if total else 0.0

    values = [0.0] + [worth(node) if not any(id(up) in gone for up in above(node)) else 0.0 for node in nodes[1:]]
    best = nodes[values.index(max(values))]
    if not max(values):
        kept = next(([node] for tag in roots for node in below(root) if node[0] == tag and runs(node)), [root])
    else:
        kept = next(([up] for tag in roots for up in above(best) if up[0] == tag), None)
        if kept is None:
            kept = [best]
            for node, value in zip(nodes, values):
                if parent[id(node)] is parent[id(best)] and node is not best and id(node) not in gone and runs(node):
                    near = value >= max(10.0, 0.2 * max(values))
                    size = sum(len(text) for _, text, _ in runs(node))
                    if near or (node[0] in ("h1", "h2") and density(node) < 0.5) or (node[0] == "p" and size > 80 and density(node) < 0.25):
                        kept.append(node)
    return "\n".join(text for owner, text, _ in runs(root) if any(up is own for up in above(owner) for own in kept))


def random_page(draw: random.Random) -> str:
    vocabulary = ["one", "two,", "three", "four", "five,", "sixteen", "nine"]
    line = lambda: " ".join(draw.choice(vocabulary) for _ in range(draw.choice([1, 3, 8, 40])))
    name = lambda: draw.choice(["", "", "", "", " class=sidebar", " class=ad", " class=has-sidebar", " class=my-sidebar", " class=text"])

    def inside():
        return "".join(draw.choice([line() + " ", f"<a href=x>{line()}</a> ", f"<b{name()}>{line()}</b> "]) for _ in range(draw.choice([1, 1, 2])))

    def element(depth):
        tag = draw.choice(["p", "p", "p", "h1", "h2", "ul"] if depth > 4 else ["p", "p", "p", "h2", "div", "div", "section", "article", "main", "nav", "aside"])
        if tag in ("p", "h1", "h2"):
            return f"<{tag}{name()}>{inside()}</{tag}>"
        if tag == "ul":
            return "<ul>" + "".join(f"<li>{inside()}</li>" for _ in range(draw.choice([1, 3]))) + "</ul>"
        return f"<{tag}{name()}>" + draw.choice(["", "", line()]) + "".join(element(depth + draw.choice([1, 2])) for _ in range(draw.choice([1, 2, 3]))) + f"</{tag}>"

    return "<div>" + "".join(element(0) for _ in range(draw.choice([1, 2, 4]))) + "</div>"


def test_random_pages_against_the_definition():
    draw, empty = random.Random(7), 0
    for _ in range(400):
        page = random_page(draw)
        got = main_text(page)
        assert got == plainly(page), page
        empty += not got
    assert empty < 200
