"""Main text of web pages by tree scoring.

Each run of text in a block passes points for its length and its commas to its container and half of them to the next one up; a
container's points are discounted by the share of its characters that stand in links. The best container is kept, widened
to the article around it, with those siblings that score well or are plain paragraphs, headings or lists. Menus, headers,
footers, sidebars, notices, adverts, forms, comments of readers, scripts and styles give no text anywhere; an element counts
as such by its tag or by a word of its class or id, unless it also bears a name of the text itself. A form that wraps most
of a page's text is a container like others. If nothing is left of a page, it is read again without regard to class and id.
A page takes time in proportion to its length, whatever its markup.

Edge cases. A null or empty page has an empty text. Markup that is cut off or badly nested is read as far as it goes.
Pages of any length are read whole. Of equal scores the container that begins first is taken. Repeated rows give equal
rows; a table without rows gives none. Extra columns are ignored by main_text(), whose columns are fixed.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm import textarrays as ta

OPEN = re.compile(r"<(?=[!?/a-zA-Z])")
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
#: Attributes up to the end of a tag; without an end, or with a quote left open, nothing is tried twice.
REST = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
MARK = re.compile("""[>"']""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
PARAGRAPHS = frozenset("p pre td th blockquote li dd dt figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that never hold main text.
DROPPED = frozenset("head script style noscript template nav footer aside button select option input textarea iframe svg canvas object embed audio video map dialog menu title".split())
#: Parts of class and id names of page furniture; those in FURNITURE don't count beside a name of the text itself.
NEVER = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promos promoted sidebar breadcrumb breadcrumbs comment comments commentlist disqus respond replies cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations outbrain taboola pagination pager".split()
)
FURNITURE = frozenset("menu nav navbar navigation footer header masthead banner widget widgets toolbar alert copyright legal skip search topbar".split())
CONTROLS = frozenset("button input select textarea".split())
#: Parts of names that tell a state of an element, not what it is.
STATES = frozenset("has is no with without enabled disabled open closed on off".split())
TEXT_NAMES = frozenset("article content entry post story text body main headline".split())
#: What the start of an element closes when it is still open.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
BOUNDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "body": {"html"}}


class Node:
    __slots__ = ("tag", "parent", "dropped", "points", "chars", "linked", "place", "in_link", "in_text", "controls", "kept", "block", "container")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, place: int):
        self.tag, self.parent, self.dropped, self.place = tag, parent, dropped, place
        self.points, self.chars, self.linked, self.controls, self.kept = 0.0, 0, 0, 0, False
        self.in_link = tag == "a" or parent is not None and parent.in_link
        self.in_text = tag in ("article", "main") or parent is not None and parent.in_text
        #: The nearest element, from this one up, that is no inline element; and the nearest that is no paragraph or the like.
        self.block: Node = self if parent is None or tag not in INLINE else parent.block
        self.container: Node = self if parent is None or tag not in PARAGRAPHS else parent.container

    def up(self) -> Iterator[Node]:
        at: Node | None = self
        while at is not None:
            yield at
            at = at.parent


def _named_furniture(names: list[list[str]]) -> bool:
    """Whether class and id names, in their parts, are those of page furniture."""
    names = [parts for parts in names if parts and not STATES.intersection((parts[0], parts[-1]))]
    if any(NEVER.issuperset(parts) for parts in names):
        return True
    of_text = any(TEXT_NAMES.issuperset(parts) for parts in names)
    words = {x for parts in names for x in parts}
    return not of_text and bool(words & NEVER or words & FURNITURE and not words & TEXT_NAMES)


def _furniture(tag: str, attributes: str, in_text: bool, by_name: bool) -> bool:
    """Whether an element's own tag and attributes say that it isn't main text."""
    if tag in DROPPED or tag == "header" and not in_text:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    names: list[list[str]] = []
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if name in ("class", "id"):
            names += [[x.lower() for x in NAME_PART.findall(one)] for one in value.split()]
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        elif name == "role" and value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "menubar", "form"):
            return True
    return by_name and _named_furniture(names)


class TagEnds:
    """Where tags end, for pages in which a quote is left open. All ends are found once, from the last mark back."""

    def __init__(self, page: str):
        self.marks = [m.start() for m in MARK.finditer(page)]
        self.ends = [0] * (len(self.marks) + 1)
        following = {'"': len(self.marks), "'": len(self.marks)}
        for k in range(len(self.marks) - 1, -1, -1):
            mark = page[self.marks[k]]
            if mark == ">":
                self.ends[k] = self.marks[k] + 1
            else:
                self.ends[k] = self.ends[min(following[mark] + 1, len(self.marks))]
                following[mark] = k

    def after(self, at: int) -> int:
        """The end of a tag from a place behind its name; 0 if there is none."""
        return self.ends[bisect_left(self.marks, at)]


def read_page(page: str, by_name: bool = True) -> tuple[list[Node], list[tuple[Node, int, str]]]:
    """The elements, parents first, and the texts outside dropped elements as (element, number of the block, text)."""
    root = Node("html", None, False, 0)
    nodes, stack, texts = [root], [root], []
    places: defaultdict[str, list[int]] = defaultdict(list)  # where in the stack the elements of a tag are
    blocks = [0]  # where those are that are no inline elements
    ends: TagEnds | None = None
    block, at, shown = 0, 0, 0
    size, last_end = len(page), page.rfind(">")

    def close_to(depth: int) -> None:
        nonlocal block
        for node in stack[depth:]:
            block += node.tag not in INLINE
            places[node.tag].pop()
        del stack[depth:]
        while blocks[-1] >= depth:
            blocks.pop()

    def nearest(tags: set[str]) -> int:
        """Where the latest open element of some tags is; 0 if there is none."""
        return max((places[x][-1] for x in tags if places[x]), default=0)

    def show(to: int) -> None:
        if to > shown and not stack[-1].dropped:
            texts.append((stack[-1], block, html.unescape(page[shown:to])))

    while at < size:
        m = OPEN.search(page, at)
        if not m or m.start() > last_end and not page.startswith("<!--", m.start()):
            break
        begin = m.start()
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            show(begin)
            at = shown = size if end < 0 else end + 3
            continue
        name = NAME.match(page, begin + 1)
        if not name:  # a declaration, or a stray mark
            end = -1 if page[begin + 1] == "/" else page.find(">", begin)
            if end < 0:
                at = begin + 1
            else:
                show(begin)
                at = shown = end + 1
            continue
        rest = REST.match(page, name.end()) if ends is None else None
        if rest is None and ends is None:
            ends = TagEnds(page)
        end = rest.end() if rest else ends.after(name.end()) or page.find(">", name.end()) + 1
        attributes = page[name.end() : end - 1]
        show(begin)
        at = shown = end
        tag = name[2].lower()
        if name[1]:
            if places[tag]:
                close_to(places[tag][-1])
            continue
        if tag in CONTROLS:
            stack[-1].controls += 1
        if tag == "br":
            if not stack[-1].dropped:
                texts.append((stack[-1], block, "\n"))
            continue
        if tag == "html":
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(page, at, last_end + 1)
            at = shown = end.end() if end else size
            continue
        if tag not in INLINE:
            block += 1
            open_block = stack[blocks[-1]].tag  # a block ends an open paragraph, and a head that was not closed
            if open_block == "p" or open_block == "head" and tag not in VOID and tag not in DROPPED:
                close_to(blocks[-1])
        if tag in CLOSES:
            while (depth := nearest(CLOSES[tag])) > nearest(BOUNDS[tag]):
                close_to(depth)
                if tag != "tr":
                    break
        if tag in VOID:
            continue
        parent = stack[-1]
        node = Node(tag, parent, parent.dropped or _furniture(tag, attributes, parent.in_text, by_name), len(nodes))
        nodes.append(node)
        if not attributes.rstrip().endswith("/") or tag not in INLINE | {"svg"}:
            places[tag].append(len(stack))
            if tag not in INLINE:
                blocks.append(len(stack))
            stack.append(node)
    show(size)
    return nodes, texts


def extract(page: str) -> str:
    """The main text of one page."""
    return _extract(page, True) or _extract(page, False)


def _extract(page: str, by_name: bool) -> str:
    nodes, texts = read_page(page, by_name)
    runs: list[tuple[Node, list[str]]] = []
    last = -1
    for node, block, text in texts:
        if block == last:
            runs[-1][1].append(text)
        else:
            runs.append((node, [text]))
            last = block
        n = len(text.strip())
        node.chars += n
        node.linked += n * node.in_link
    for x in reversed(nodes[1:]):  # children first
        x.parent.chars += x.chars
        x.parent.linked += x.linked
        x.parent.controls += x.controls
    for x in nodes:  # a form is furniture unless it wraps most of the page's text
        if x.tag == "form" and (2 * x.chars <= nodes[0].chars or x.chars < 100 * (x.controls + 1)):
            x.dropped = True
        elif x.parent is not None and x.parent.dropped:
            x.dropped = True
    runs = [(node, clean) for node, parts in runs if not node.dropped and (clean := " ".join("".join(parts).split()))]
    for node, text in runs:
        node = node.block
        if node.tag in HEADINGS:
            continue
        points = (1.0 if len(text) >= 25 else len(text) / 25) + text.count(",") + min(len(text) / 100, 3.0)
        node = node.container
        node.points += points
        if node.parent is not None:
            node.parent.points += points / 2
    value = lambda x: x.points * (1 - x.linked / x.chars) if x.chars else 0.0
    scored = [x for x in nodes if x.points and not x.dropped]
    loose = None
    if not scored:
        best = next((x for x in nodes if x.tag in ("article", "main") and x.chars), nodes[0])
        best.kept = True
    else:
        best = max(scored, key=lambda x: (value(x), -x.place))
        top = next((x for x in best.up() if x.tag == "article"), None) or next((x for x in best.up() if x.tag == "main"), None) or best
        top.kept = True
        if top.parent is not None and top.tag != "main":
            for x in nodes:
                if x.parent is top.parent and x is not top and not x.dropped and x.chars:
                    dense = x.linked / x.chars
                    if value(x) >= 0.2 * value(best) or x.tag in PARAGRAPHS | HEADINGS | {"ul", "ol", "table", "figure", "dl"} and dense < 0.25:
                        x.kept = True
        loose = top.parent if top.tag not in ("article", "main", "body", "html") else None
    for x in nodes[1:]:
        x.kept |= x.parent.kept
    return " ".join(text for node, text in runs if node.kept or node is loose)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in ta.blocks(batches, "html"):
            out = [extract(page or "") for page in block.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column("page_id"), block.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(work, "page_id long, url string, text string, n_chars long")
