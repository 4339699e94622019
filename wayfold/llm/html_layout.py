"""HTML extraction by layout-aware rendering.

A tolerant tokeniser feeds a tree builder that supplies what authors leave out (``html``, ``head`` and ``body``, end tags of
paragraphs, list items, table rows and cells, options and definitions). The tree is then rendered as text the way a page
shows it: hidden elements are left out, blocks stand on lines of their own with blank lines where margins would be, lists
get their markers and indents, preformatted text keeps its white space, and table cells are padded into aligned columns.

No depth or length of markup loses text, and what layout adds is bounded: tables inside more than ``ALIGNED`` others are shown
as blocks, columns are not aligned beyond ``MOST_WIDTH`` characters or after ``MOST_COLUMNS``, and indents end at
``MOST_INDENT``.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.plans.scratch import bounded_batches

# Sets of HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
UNSEEN = frozenset("head script style template title noscript iframe noembed noframes object video audio canvas svg math datalist meta link param source track embed applet textarea".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul xmp".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul".split())
CLOSES_P = BLOCK - {"body", "html", "legend"}
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
TABLE_PARTS = frozenset("td th tr tbody thead tfoot caption colgroup".split())
SCOPE = frozenset("applet caption html table td th marquee object template".split())

ALIGNED = 16
MOST_WIDTH = 512
MOST_COLUMNS = 1000
MOST_INDENT = 128

# A quote opens a value only after an equals sign, and only if it is closed; else the tag ends with the next ">".
TOKEN = re.compile(r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>=]+|=)*)(?:>|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)|</>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
UNDISPLAYED = re.compile(r"display\s*:\s*none")
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)")
SPACES = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: str = ""):
        self.name, self.attributes, self.children = name, attributes, []

    def attribute(self, name: str) -> str | None:
        for key, *values in ATTRIBUTE.findall(self.attributes):
            if key.lower() == name:
                return html.unescape(next((v for v in values if v), ""))
        return None


class TreeBuilder:
    """Builds the tree of one page. ``stack`` holds the open elements, ``html`` first.

    ``names`` has their names, empty for an element that was closed while others in it stay open; ``places`` has the places of
    each name in the stack, so that no step walks over the open elements.
    """

    def __init__(self) -> None:
        self.root = Node("html")
        self.stack, self.names, self.places = [self.root], ["html"], {"html": [0]}
        self.body: Node | None = None

    def _innermost(self, names) -> int:
        """The place of the innermost open element of ``names``, 0 if there is none above ``html``."""
        return max((at[-1] for name in names if (at := self.places.get(name))), default=0)

    def _open(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.stack))
        self.stack.append(node)
        self.names.append(node.name)

    def _cut(self, k: int) -> None:
        """Closes the elements from place ``k`` on, and those below that are closed already."""
        k = max(k, 1)
        while len(self.stack) > k or (len(self.stack) > 1 and not self.names[-1]):
            self.stack.pop()
            if name := self.names.pop():
                self.places[name].pop()

    def parse(self, page: str) -> Node:
        at = 0
        while at < len(page):
            m = TOKEN.search(page, at)
            self.text(page[at : m.start()] if m else page[at:])
            if not m:
                break
            at = m.end()
            if m[1] is not None:
                self.text(m[1], raw=True)
            elif m[3]:
                name = m[3].lower()
                if m[2]:
                    self.end(name)
                else:
                    self.start(name, m[4])
                    if name in RAW:
                        at = self._raw(page, at, name)
        return self.root

    def _raw(self, page: str, at: int, name: str) -> int:
        """Text up to the element's own end tag, whatever stands in it."""
        close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at) if name != "plaintext" else None
        end = close.start() if close else len(page)
        inside = page[at:end]
        if inside:
            self.stack[-1].children.append(html.unescape(inside) if name in ("title", "textarea") else inside)
        if self.stack[-1].name == name:
            self._cut(len(self.stack) - 1)
        return close.end() if close else len(page)

    def text(self, text: str, raw: bool = False) -> None:
        if not text:
            return
        if not raw and "&" in text:
            text = html.unescape(text)
        if self.body is None and self.stack[-1].name in ("html", "head"):
            if not text.strip(" \t\n\f\r"):
                return
            self._body()
        self.stack[-1].children.append(text)

    def _body(self) -> None:
        """What follows the head goes into a body, whether or not a tag says so."""
        if self.body is None:
            self._cut(1)
            self.body = Node("body")
            self.root.children.append(self.body)
            self._open(self.body)

    def _close_upto(self, names: frozenset[str] | set[str], within: frozenset[str] | set[str]) -> None:
        """Closes the innermost open element of ``names`` and what is open in it, unless one of ``within`` stands between."""
        k = self._innermost(names)
        if k and k >= self._innermost(within):
            self._cut(k)

    def start(self, name: str, attributes: str) -> None:
        if name == "html":
            self.root.attributes += " " + attributes
            return
        if name == "head":
            if self.body is None and len(self.stack) == 1:
                self._push(name, attributes)
            return
        if name == "body":
            self._body()
            self.body.attributes += " " + attributes
            return
        if self.body is None:
            if name in HEAD:
                if len(self.stack) == 1:
                    self._push("head", "")
                self._push(name, attributes)
                return
            if self.stack[-1].name not in HEAD:
                self._body()
        if name in CLOSES_P:
            self._close_upto({"p"}, SCOPE | {"button"})
        if name == "li":
            self._close_upto({"li"}, SCOPE | {"ul", "ol", "menu", "dir"})
        elif name in ("dd", "dt"):
            self._close_upto({"dd", "dt"}, SCOPE | {"dl"})
        elif name in ("option", "optgroup"):
            self._close_upto({"option"}, SCOPE | {"select"} | ({"optgroup"} if name == "option" else set()))
        elif name in ("td", "th"):
            self._close_upto({"td", "th"}, {"tr", "table"})
            self._within_table("tr")
        elif name == "tr":
            self._close_upto({"tr"}, {"table"})
            self._within_table("tbody")
        elif name in ("tbody", "thead", "tfoot", "caption", "colgroup"):
            self._close_upto({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"})
        elif name == "a":
            self._close_upto({"a"}, SCOPE)
        elif re.fullmatch("h[1-6]", name) and re.fullmatch("h[1-6]", self.stack[-1].name):
            self._cut(len(self.stack) - 1)
        self._push(name, attributes)

    def _within_table(self, name: str) -> None:
        """Opens the row, or the row's section, that a cell or row needs but the page does not write."""
        table = self._innermost({"table"})
        if not table:
            return
        if name == "tr" and self._innermost({"tr"}) < table:
            self._within_table("tbody")
            self._push("tr", "")
        elif name == "tbody" and self._innermost({"tbody", "thead", "tfoot"}) < table:
            self._close_upto({"caption", "colgroup"}, {"table"})
            self._push("tbody", "")

    def _push(self, name: str, attributes: str) -> None:
        node = Node(name, attributes)
        self.stack[-1].children.append(node)
        if name not in VOID:
            self._open(node)

    def end(self, name: str) -> None:
        if name in ("html", "body"):
            return
        if name == "head":
            self._close_upto({"head"}, set())
            return
        if name == "br":
            self.start("br", "")
            return
        if name == "p" and not self._innermost({"p"}):
            self.start("p", "")
        if name in FORMATTING:
            # A formatting element that is closed late does not take the blocks in it along.
            k = self._innermost({name})
            if k > 1 and k >= self._innermost(SCOPE):
                self.places[name].pop()
                self.names[k] = ""
                self._cut(len(self.stack))
            return
        names = {"h1", "h2", "h3", "h4", "h5", "h6"} if re.fullmatch("h[1-6]", name) else {name}
        if name == "table":
            self._close_upto(names, set())
        else:  # an end tag in a cell does not end what the table stands in
            self._close_upto(names, {"table"} if name in TABLE_PARTS else {"table", "td", "th", "caption"})


def displayed(node: Node) -> bool:
    if node.name in UNSEEN:
        return False
    if not node.attributes or node.attributes.isspace():
        return True
    if node.name == "input" or "hidden" in node.attributes.lower():
        if node.attribute("hidden") is not None or node.name == "input":
            return False
    if "style" in node.attributes.lower() and UNDISPLAYED.search((node.attribute("style") or "").lower()):
        return False
    return not (node.name == "dialog" and node.attribute("open") is None)


def shown_in(node: Node, shown: bool) -> bool:
    """Whether text of the node itself shows, by its own visibility or else that of what it stands in."""
    if "style" not in node.attributes.lower():
        return shown
    own = VISIBILITY.findall((node.attribute("style") or "").lower())
    return own[-1] == "visible" if own else shown


class Page:
    """Lines of text under construction: the current line, and how many blank lines the next one needs before it.

    ``tables`` is how many tables the page stands in, ``shown`` whether text shows where the walk is now.
    """

    def __init__(self, tables: int = 0, shown: bool = True) -> None:
        self.tables, self.shown = tables, shown
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0
        self.indent = ""
        self.marker = ""
        self.space = False

    def words(self, text: str) -> None:
        if not text or not self.shown:
            return
        parts = SPACES.split(text)
        if parts[0] == "" and self.now:
            self.space = True
        for k, word in enumerate(p for p in parts if p):
            if self.now and (k or self.space):
                self.now.append(" ")
            self.space = False
            self._begin()
            self.now.append(word)
        if parts[-1] == "" and self.now:
            self.space = True

    def _begin(self) -> None:
        if not self.now:
            if self.gap and self.lines:
                self.lines += [""] * (self.gap - 1)
            self.gap = 0
            self.now.append(self.indent[: len(self.indent) - len(self.marker)] + self.marker if self.marker else self.indent)
            self.marker = ""

    def line(self, text: str) -> None:
        """A line as it is, under the indent."""
        self._begin()
        self.now.append(text)
        self.lines.append("".join(self.now).rstrip())
        self.now, self.space = [], False

    def flush(self) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip())
            self.now = []
        self.space = False

    def ask(self, blank: int) -> None:
        """Ends the line; the next one comes after at least so many blank lines."""
        self.flush()
        self.gap = max(self.gap, blank + 1)

    def text(self) -> str:
        self.flush()
        return "\n".join(self.lines).strip("\n")


def render(node: Node, page: Page | None = None) -> Page:
    """Renders an element and what is in it. The walk keeps its own stack, so that depth is no limit."""
    page = page or Page()
    todo: list = [node]
    while todo:
        at = todo.pop()
        if callable(at):
            at()
        elif isinstance(at, str):
            page.words(at)
        elif displayed(at):
            shown = shown_in(at, page.shown)
            if shown != page.shown:
                todo.append(lambda was=page.shown: setattr(page, "shown", was))
                page.shown = shown
            _element(at, page, todo)
    return page


def _element(node: Node, page: Page, todo: list) -> None:
    name = node.name
    if name == "br":
        if page.now:
            page.flush()
        else:
            page.gap = max(page.gap, 2) if page.lines else 0
        return
    if name == "hr":
        page.ask(0)
        if page.shown:
            page.line("---")
        page.ask(0)
        return
    if name == "img":
        page.words(node.attribute("alt") or "")
        return
    if name in ("pre", "xmp"):
        page.ask(1)
        for line in _plain(node, page.shown).removeprefix("\n").split("\n"):
            page.line(line)
        page.ask(1)
        return
    if name == "table" and page.tables < ALIGNED:
        page.ask(1)
        for line in table_lines(node, page.tables, page.shown):
            page.line(line)
        page.ask(1)
        return
    if name not in BLOCK and name not in ("tr", "td", "th", "tbody", "thead", "tfoot", "caption"):
        todo += reversed(node.children)
        return
    blank = int(name in SPACED)
    nested = name in ("ul", "ol", "menu", "dir") and page.indent
    page.ask(0 if nested else blank)
    before = page.indent
    if name in ("ul", "ol", "menu", "dir"):
        todo.append(lambda: (page.ask(0 if nested else 1), setattr(page, "indent", before)))
        number = int(start) if name == "ol" and re.fullmatch(r"-?\d{1,9}", start := node.attribute("start") or "1") else 1
        steps: list = []
        for child in node.children:
            if isinstance(child, Node) and child.name == "li" and displayed(child):
                inner = Node("span", child.attributes)
                inner.children = child.children
                steps += [_item(page, before, f"{number}. " if name == "ol" else "- "), inner, lambda: (page.ask(0), setattr(page, "marker", ""))]  # an item without text leaves no marker
                number += 1
            else:
                steps.append(child)
        todo += reversed(steps)
        return
    if name in ("dd", "blockquote"):
        page.indent = (page.indent + "  ")[:MOST_INDENT]
    todo.append(lambda: (page.ask(blank), setattr(page, "indent", before)))
    todo += reversed(node.children)


def _item(page: Page, indent: str, marker: str):
    def begin() -> None:
        page.ask(0)
        page.indent, page.marker = (indent + " " * len(marker))[:MOST_INDENT], marker

    return begin


def _plain(node: Node, shown: bool) -> str:
    """Text with its white space as written."""
    out, todo = [], [(node, shown)]
    while todo:
        at, shown = todo.pop()
        if isinstance(at, str):
            out.append(at if shown else "")
        elif at.name == "br":
            out.append("\n")
        elif displayed(at):
            inside = shown_in(at, shown)
            todo += [(child, inside) for child in reversed(at.children)]
    return "".join(out)


def _rows(table: Node, shown: bool) -> tuple[list[tuple], list[list[tuple]]]:
    """Captions and other loose content; the cells of each row; each with whether it shows. Head rows come first and foot rows
    last, as they are shown."""
    loose, parts = [], {"thead": [], "tbody": [], "tfoot": []}
    for child in table.children:
        if isinstance(child, Node) and displayed(child):
            if child.name in parts:
                inside = shown_in(child, shown)
                for row in child.children:
                    if not (isinstance(row, Node) and row.name == "tr"):
                        loose.append((row, inside))
                    elif displayed(row):
                        parts[child.name].append((row, shown_in(row, inside)))
            elif child.name == "tr":
                parts["tbody"].append((child, shown_in(child, shown)))
            else:
                loose.append((child, shown))
        elif isinstance(child, str):
            loose.append((child, shown))
    rows = []
    for row, inside in (*parts["thead"], *parts["tbody"], *parts["tfoot"]):
        rows.append([(c, shown_in(c, inside)) for c in row.children if isinstance(c, Node) and c.name in ("td", "th") and displayed(c)])
        loose += [(c, inside) for c in row.children if not (isinstance(c, Node) and c.name in ("td", "th"))]
    return loose, rows


def _span(cell: Node, name: str, most: int) -> int:
    value = cell.attribute(name) or "1"
    return max(1, min(most, int(value))) if re.fullmatch(r"\d{1,6}", value) else 1


def table_lines(table: Node, depth: int = 0, shown: bool = True) -> list[str]:
    """The lines of a table that stands in ``depth`` others: cells in columns as wide as their widest line, two spaces apart;
    spans take up their columns."""
    loose, rows = _rows(table, shown)
    out: list[str] = []
    for node, inside in loose:
        out += [x for x in render(node, Page(depth + 1, inside)).text().split("\n") if x]
    grid: list[list[tuple[int, int, list[str]]]] = []
    taken = np.zeros(MOST_COLUMNS + 1, dtype=np.int64)  # the row from which a column is free again; the last place always is
    spanned = False
    widths: dict[int, int] = {}
    for number, row in enumerate(rows):
        cells, column = [], 0
        for cell, inside in row:
            if spanned and taken[column] > number:
                column += int(np.argmax(taken[column:] <= number))
            across, down = _span(cell, "colspan", MOST_COLUMNS), _span(cell, "rowspan", 65534)
            inner = Node("div")
            inner.children = cell.children
            lines = render(inner, Page(depth + 1, inside)).text().split("\n")
            end = min(column + across, MOST_COLUMNS)
            cells.append((column, end - column, lines))
            if across == 1:
                widths[column] = max(widths.get(column, 0), *map(len, lines))
            if down > 1:
                spanned = True
                taken[column:end] = np.maximum(taken[column:end], number + down)
            column = end
        grid.append(cells)
    places, at = {}, 0
    for column in range(max((c + n for row in grid for c, n, _ in row), default=0) + 1):
        places[column] = at
        at += widths.get(column, 0) + 2 if column in widths else 0
    for cells in grid:
        for k in range(max((len(lines) for _, _, lines in cells), default=0)):
            line: list[str] = []
            length = 0
            for column, _, lines in cells:
                if k < len(lines) and lines[k]:
                    place = places[column]
                    gap = place - length if length <= place <= MOST_WIDTH else 2 if length else 0
                    line.append(" " * gap + lines[k])
                    length += gap + len(lines[k])
            if length:
                out.append("".join(line))
    return out


def extract(page: str | None) -> tuple[str, str]:
    """(title, visible text) of a page; both empty for null."""
    if not page:
        return "", ""
    root = TreeBuilder().parse(page)
    title, todo = "", [root]
    while todo:
        node = todo.pop()
        if node.name == "title":
            title = " ".join("".join(c for c in node.children if isinstance(c, str)).split())
            break
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return title, render(root).text()


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, title, text, n_lines for every page.

    Null and empty pages give empty strings and no lines. Markup that is never closed ends with the page, a quote in a tag that
    is never closed with the tag; each row is rendered on its own; an empty table gives no rows; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [extract(x.as_py()) for x in batch.column(1)]
            columns = [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.string()), pa.array([m[1].count("\n") + bool(m[1]) for m in made], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["page_id", "title", "text", "n_lines"])

    bounded_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(run, "page_id long, title string, text string, n_lines long")
