"""Main text of web pages by tree scoring.

A page becomes a tree of elements. Every paragraph-like block with enough text
earns points for its length and its commas and passes them to its parent in
full and to its grandparent by half; a container's points shrink with the share
of its text that stands in links. From the best container the way leads up as
long as what stands beside it isn't mostly links, and all of that belongs to
the main text, whatever its length. Where a page names its articles, all of
them are taken with their headlines. Menus, scripts and the like are cut off
before; so are forms, unless one wraps most of the page, and reader comments.
Every step is linear in the page, also for tags and quotes that never end.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame

# Names of elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math".split())
DROPPED = RAW | frozenset("head nav header footer aside button select label legend datalist dialog menu object canvas audio video".split())
ARTICLES = ("article", "main")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table caption thead tbody tfoot "
    "tr td th figure figcaption address details summary fieldset center hr hgroup form header".split()
)
PARAGRAPHS = frozenset("p pre blockquote td li dd h2 h3 h4 h5 h6 div section article main body".split())
#: An opening tag closes elements of these names that are still open, up to the nearest of the second set.
CLOSES = {
    "li": ({"li", "p"}, {"ul", "ol"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}),
}
CLOSE_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
INLINE = frozenset("a b i u s em strong small span font code tt big mark sub sup q cite abbr time label".split())
#: Words in class names and ids of parts that are no main text, and of parts that are.
UNLIKELY = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal newsletter "
    "subscribe signup share sharing social sidebar side aside widget widgets related recommended recommendations menu nav navbar navigation breadcrumb breadcrumbs "
    "pagination pager header masthead footer comment comments disqus reply replies respond login toolbar skip hidden".split()
)
LIKELY = frozenset("article content main post entry story body text page".split())
#: Parts whose header holds the headline.
WITH_HEADLINE = frozenset("article content post entry story".split())
#: Two of these words written as one, as in "commentlist".
JOINED = re.compile(
    "(?:comments?|sidebar|related|share|social|promo|newsletter|menu|nav|footer|advert|ads?|cookie)"
    "(?:lists?|box|boxes|form|area|section|bar|links?|wrap|wrapper|container|thread|block|panel|items?|buttons?)"
)
#: Headings of reader comments, with or without their number.
COMMENTS = re.compile(
    r"\W*(?:[0-9]+\s+)?(?:(?:reader|user|leave a|post a|add a)\s+)?(?:comments?|reply|replies|responses?|kommentare?|commentaires?|comentarios?)(?:\s*\(?[0-9]+\)?)?\W*", re.I
)
#: Words in class names from which on they speak of other parts of the page.
ABOUT_OTHERS = frozenset("has with no without".split())
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
TAG_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*+)")
#: What stands between a tag's name and its end. A quote opens a value after "=" only, and only if it is closed again.
TAG_END = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
ATTRIBUTES = frozenset("class id role hidden aria-hidden style".split())
LONG_ZEROS, LONG_NUMBER = re.compile(r"&#0{8,}+(?=[0-9])"), re.compile(r"&#[0-9]{9,}+;?")
SPACE = re.compile(r"\s+")
LEAST_PARAGRAPH = 25


class Element:
    __slots__ = ("name", "parent", "items", "weight", "score", "chars", "linked")

    def __init__(self, name: str, parent: Element | None, weight: int = 0):
        self.name, self.parent, self.weight = name, parent, weight
        self.items: list[Element | str] = []
        self.score, self.chars, self.linked = 0.0, 0, 0


def judged(name: str) -> int:
    """-1 if a class name or id starts or ends with a word for no main text, 1 if it has a word for main text, else 0."""
    parts = [p.lower() for p in NAME_PARTS.findall(name)]
    parts = parts[: next((i for i, p in enumerate(parts) if p in ABOUT_OTHERS), None)]
    if not parts:
        return 0
    if parts[-1] == "header" and parts[0] in WITH_HEADLINE:
        return 0
    if any(p in UNLIKELY or JOINED.fullmatch(p) for p in (parts[0], parts[-1])):
        return -1
    return int(not LIKELY.isdisjoint(parts))


def described(attributes: str) -> tuple[bool, int]:
    """Whether an element's attributes say that it is no main text, and what they add to its score."""
    weight = 0
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name not in ATTRIBUTES:
            continue
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True, 0
        if name == "role" and value in ("complementary", "contentinfo", "search", "dialog", "navigation", "banner"):
            return True, 0
        if name in ("class", "id"):
            verdicts = [judged(x) for x in value.split()]
            if -1 in verdicts:
                return True, 0
            weight += 25 * max(verdicts, default=0)
    return False, weight


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of each tag; comments and declarations have an empty name.

    A `<` that no `>` follows is text. If the values of a tag run to the end of
    the page, quotes count no more from there on. Inside scripts and the like
    nothing is a tag but their own end, which comes out with them as one.
    """
    at, last, quotes = 0, page.rfind(">"), True
    while 0 <= (start := page.find("<", at)) < last or page.startswith("<!--", start):
        if start < 0:
            return
        at = start + 1
        if page.startswith("<!--", start):
            end = page.find("-->", start + 2)
            at = len(page) if end < 0 else end + 3
            yield start, at, False, "", ""
        elif page[at] in "!?":
            at = page.index(">", at) + 1
            yield start, at, False, "", ""
        elif found := TAG_NAME.match(page, at):
            end = TAG_END.match(page, found.end()) if quotes else None
            if quotes and end is None:
                quotes = False
            at = end.end() if end else page.index(">", found.end() - 1 if page[found.end() - 1] == ">" else found.end()) + 1
            closing, name = page[start + 1] == "/", found[1].lower()
            attributes = page[found.end() : at - 1]
            if name in RAW and not closing:
                at = _raw_end(page, name, at)
            yield start, at, closing, name, attributes


class Path:
    """The open elements from the root down, and at which depths each name is open."""

    def __init__(self, root: Element):
        self.nodes, self.depths, self.blocks = [root], defaultdict(list), []

    def open(self, child: Element) -> None:
        self.nodes[-1].items.append(child)
        self.depths[child.name].append(len(self.nodes))
        if child.name in BLOCKS:
            self.blocks.append(len(self.nodes))
        self.nodes.append(child)

    def close(self, depth: int) -> None:
        """Close the element at `depth` and all inside it."""
        while len(self.nodes) > depth:
            node = self.nodes.pop()
            self.depths[node.name].pop()
            if node.name in BLOCKS:
                self.blocks.pop()

    def deepest(self, names: Iterator[str]) -> int:
        return max((self.depths[x][-1] for x in names if self.depths[x]), default=0)

    def end_tag(self, name: str) -> None:
        """A stray end tag does nothing, and one of an inline element doesn't close blocks."""
        depth = self.deepest((name,))
        if depth and not (name in INLINE and self.blocks and self.blocks[-1] > depth):
            self.close(depth)

    def make_room(self, name: str) -> None:
        """Close what a block of this name can't stand in."""
        shut, until = CLOSES.get(name, ({"p"} if name in CLOSE_P else set(), {"td", "th", "li", "button"}))
        bound = self.deepest(until)
        inside = [depths[k] for x in shut if (depths := self.depths[x]) and (k := bisect_right(depths, bound)) < len(depths)]
        if inside:
            self.close(min(inside))


def parsed(page: str) -> Element:
    """The tree of a page without dropped parts. Tags that are open at the end count as closed there."""
    root = Element("html", None)
    path = Path(root)
    at, skipped, depth = 0, "", 0  # inside a dropped element: its name, and how many of that name are open
    for start, end, closing, name, attributes in tags(page):
        if not skipped and start > at:
            path.nodes[-1].items.append(page[at:start])
        at = end
        if not name:
            continue
        if skipped:
            if name == skipped:
                depth += -1 if closing else 1
                if depth == 0:
                    skipped = ""
            continue
        if closing:
            path.end_tag(name)
            continue
        if name in RAW:
            continue
        if name in VOID:
            path.nodes[-1].items.append(Element(name, path.nodes[-1]))
            continue
        if name in BLOCKS or name in DROPPED:
            path.make_room(name)
        unlikely, weight = described(attributes) if attributes else (False, 0)
        inside = bool(path.deepest(ARTICLES))
        kept = name in ("html", "body", "main") or name == "article" and not inside
        if name in DROPPED and not (name == "header" and inside) or unlikely and not kept:
            if not attributes.endswith("/"):
                skipped, depth = name, 1
            continue
        if name in ("html", "body") and len(path.nodes) == 1:
            continue
        path.open(Element(name, path.nodes[-1], weight))
    if not skipped and at < len(page):
        path.nodes[-1].items.append(page[at:])
    return root


def _raw_end(page: str, name: str, at: int) -> int:
    end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
    return end.end() if end else len(page)


def measured(root: Element) -> list[Element]:
    """All elements, each before those inside it, with their lengths and lengths in links filled in."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in node.items if isinstance(x, Element)]
    for node in reversed(order):
        inside = [x for x in node.items if isinstance(x, Element)]
        node.chars = sum(x.chars for x in inside) + sum(len(x.strip()) for x in node.items if isinstance(x, str))
        node.linked = node.chars if node.name == "a" else sum(x.linked for x in inside)
    return order


def trimmed(root: Element) -> None:
    """Cut off forms, but not one that holds a paragraph and most of the page, and comments under a heading of their own.

    Comments run from their heading to the end of its parent; a part that
    begins with the heading goes as a whole.
    """
    order = measured(root)
    wide = set()  # elements with a paragraph inside
    for node in reversed(order):
        if id(node) in wide or node.name in PARAGRAPHS and sum(len(x) for x in node.items if isinstance(x, str)) >= LEAST_PARAGRAPH:
            wide.update((id(node), id(node.parent)))
    for node in order:
        if node.name == "form" and not (id(node) in wide and 2 * node.chars > root.chars):
            node.items = []
    for node in reversed(order):
        ends = [i for i, x in enumerate(node.items) if isinstance(x, Element) and x.name in HEADINGS]
        if not ends or not 0 < node.items[ends[-1]].chars <= 60:
            continue
        at = ends[-1]
        if COMMENTS.fullmatch(" ".join(blocks_of([node.items[at]]))) and (at != 0 or node.name not in ARTICLES):
            node.items = node.items[:at]


def scored(root: Element) -> Element:
    """Give points from the leaves up, and return the best container."""
    order = measured(root)
    for node in reversed(order):
        own = commas = 0
        for item in node.items:
            if isinstance(item, str):
                own += len(item.strip())
                commas += item.count(",")
            elif item.name not in BLOCKS:
                own += item.chars
        node.score += node.weight
        if node.name in PARAGRAPHS and own >= LEAST_PARAGRAPH:
            points = 1 + commas + min(own // 100, 30)
            for share, up in ((1.0, node.parent), (0.5, node.parent and node.parent.parent)):
                if up is not None:
                    up.score += share * points
    for node in order:
        node.score *= 1 - node.linked / max(1, node.chars)
    boxes = [x for x in order if x.name in BLOCKS and x.name not in ("p", *HEADINGS)]
    return max(boxes, key=lambda x: x.score, default=root)


def decoded(text: str) -> str:
    """Character references decoded; numbers beyond all characters give the replacement character, however long they are."""
    return html.unescape(LONG_NUMBER.sub("\ufffd", LONG_ZEROS.sub("&#", text))) if "&" in text else text


def blocks_of(nodes: list[Element]) -> list[str]:
    """Texts of the blocks in page order: references decoded, white space inside a block turned into one space."""
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        text = SPACE.sub(" ", decoded("".join(held))).strip()
        held.clear()
        if text:
            out.append(text)

    stack: list[Element | str | None] = list(reversed(nodes))
    while stack:
        item = stack.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            held.append(item)
        elif item.name == "br":
            held.append(" ")
        else:
            block = item.name in BLOCKS
            if block:
                close()
                stack.append(None)
            stack += reversed(item.items)
    close()
    return out


def main_text(page: str | None) -> str:
    """The main text of a page; empty for a null or empty page and for one without text."""
    root = parsed(page or "")
    trimmed(root)
    best = scored(root)
    return "\n".join(blocks_of(_articles(root, best) or _around(best)))


def _plain(item: Element | str) -> bool:
    """Whether a part beside main text is main text as well: it has text, and less than a third of it in links."""
    return isinstance(item, str) or item.name in VOID or 0 < item.chars and 3 * item.linked < item.chars


def _articles(root: Element, best: Element) -> list[Element | str]:
    """What a page itself names as its articles, if that has the best container or most of its text."""
    tops, stack = [], [(root, False)]
    inside_best = 0
    while stack:
        node, within = stack.pop()
        within = within or node is best
        if node.name in ARTICLES and node.chars >= LEAST_PARAGRAPH:
            tops.append(node)
            inside_best += node.chars if within else 0
        else:
            stack += [(x, within) for x in reversed(node.items) if isinstance(x, Element)]
    if not tops or 0 < 2 * inside_best < best.chars:
        return []
    known, up = {id(x): x for x in tops}, best
    while up is not None and id(up) not in known:
        up = up.parent
    chosen = up or max(tops, key=lambda x: x.chars)
    if chosen.name == "main":
        named = sum(x.chars for x in chosen.items if isinstance(x, Element) and x.name == "article")
        return [x for x in chosen.items if _plain(x)] if 2 * named >= chosen.chars else [chosen]
    return [x for x in tops if x is chosen or x.parent is chosen.parent and _plain(x)]


def _around(best: Element) -> list[Element | str]:
    """The best container and what stands beside it, up to the first ancestor whose other parts are mostly links."""
    chosen: list[Element | str] = [best]
    node = best
    while (above := node.parent) is not None:
        other = above.chars - node.chars
        if node is not best and 3 * (above.linked - node.linked) >= other > 0:
            break
        at = next(i for i, x in enumerate(above.items) if x is node)
        chosen = [x for x in above.items[:at] if _plain(x)] + chosen + [x for x in above.items[at + 1 :] if _plain(x)]
        node = above
    return chosen


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of `pages`.

    A null html counts as empty, and a page without main text has an empty
    text; null ids and urls stay; equal rows are done each on its own; other
    columns are not read; an empty table gives no row. Pages don't depend on
    each other, so nothing is shuffled.
    """

    def extract(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = [main_text(page) for page in part.column("html").to_pylist()]
                columns = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(extract, "page_id LONG, url STRING, text STRING, n_chars LONG")
