"""HTML extraction (operator 5): layout-aware rendering of all visible text.

A tree builder reads tags with implied ends and starts (paragraphs, list items,
rows, cells, options), raw-text elements and unquoted attributes; it never fails
on broken markup.  The renderer walks the tree: what a browser would not show
(head, scripts, styles, templates, `hidden`, display:none, visibility:hidden, the
closed part of details, definitions of drawings, annotations of formulas) gives no
text; formulas, texts of drawings, text areas and all options of a choice do.  Blocks stand on lines of their own with
empty lines where a browser leaves a margin, list items have their mark and
indent, preformatted text keeps its spaces, and cells of tables are aligned in
columns, also under and beside cells that span several.  Columns are padded to
WIDE characters at most (wider cells push on what follows), and padding makes no
run of spaces longer than GAP: what lies farther on in its row stands GAP spaces
on.  Both are told by the row and its columns, whatever the size of the table, and
keep the text in proportion to the page.  What is `visibility: visible` within
something hidden is shown.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from hydroframe.llm import textkit

# Elements by what they do, as the HTML standard has them.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
UNSEEN = {"head", "script", "style", "template", "noscript", "title", "meta", "link", "iframe", "noembed", "noframes", "object", "audio", "video", "canvas", "datalist", "area", "param", "base", "colgroup", "col"}
BLOCK = {"address", "article", "aside", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul", "blockquote", "search", "xmp", "caption"}
SPACED = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "blockquote", "pre", "table", "figure", "hr", "menu", "xmp", "fieldset"}
ENDS_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul", "li", "dd", "dt", "search"}
#: What stands before each line of a block.
INDENT = {"dd": "    ", "blockquote": "  ", "pre": "", "xmp": "", "textarea": ""}
#: svg and math: what isn't drawn, where HTML begins again, and the start tags that end a drawing or formula.
UNDRAWN = {"defs", "symbol", "desc", "metadata", "clippath", "mask", "pattern", "marker", "lineargradient", "radialgradient", "filter", "annotation", "annotation-xml", "mphantom"}
POINTS = {"foreignobject", "desc", "title", "mi", "mo", "mn", "ms", "mtext", "annotation-xml"}
BREAKOUT = {"b", "big", "blockquote", "body", "br", "center", "code", "dd", "div", "dl", "dt", "em", "embed", "h1", "h2", "h3", "h4", "h5", "h6", "head", "hr", "i", "img", "li", "listing", "menu", "meta", "nobr", "ol", "p", "pre", "ruby", "s", "small", "span", "strong", "strike", "sub", "sup", "table", "tt", "u", "ul", "var"}
#: Formulas whose parts stand over, under or beside one another, and those of which the first part alone is shown.
PLACED = {"mfrac", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mroot", "mmultiscripts"}
FIRST = {"maction", "semantics"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What a start tag ends, and the elements beyond which it doesn't look.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"optgroup", "option"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
}
#: What a part of a table stands in: its start tag closes all that is open within that, such as a form around rows.
CONTEXT = {"tr": {"table", "thead", "tbody", "tfoot"}} | {name: {"table", "thead", "tbody", "tfoot", "tr"} for name in ("td", "th")} | {name: {"table"} for name in ("thead", "tbody", "tfoot", "caption", "colgroup")}
#: An end tag doesn't close anything outside these.
SCOPES = {"table", "td", "th", "caption", "html", "template"}
TABLE_PARTS = {"table", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "html", "body", "template"}

TAG = re.compile(r"""<(?:!--(?:>|->|[\s\S]*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*)((?>[^>"'=]|=\s*+"[^"]*"|=\s*+'[^']*'|["'=])*+)>|[!?/][^>]*>)""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
WANTED = re.compile(r"hidden|style|open|type|colspan|rowspan|start|value|label|display|visibility", re.I)
UNQUOTED = re.compile(r"""=\s*[^\s"']+/\Z""")
NUMBER = re.compile(r"[ \t\n\r\f]*\+?([0-9]+)")
BLANK = re.compile(r"[ \t\n\r\f]+")
GONE = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
#: The widest padding of a column, and the longest run of spaces that padding makes: two such columns.
WIDE, GAP = 80, 160


class Node:
    """An element; its space is svg, text (within an svg's text), math, or none for HTML."""

    __slots__ = ("name", "attributes", "children", "space")

    def __init__(self, name: str, attributes: dict[str, str] | None = None, space: str = "") -> None:
        self.name, self.attributes, self.space = name, attributes or {}, space
        self.children: list[Node | str] = []


def _space(node: Node) -> str:
    """The space of a node's children."""
    if not node.space or node.name in POINTS:
        return ""
    return "text" if node.space == "svg" and node.name == "text" else node.space


def parse(source: str) -> Node:
    """The tree of a page; its root is an element html without name-giving rules of its own."""
    root = Node("html")
    stack = [root]
    at, n = 0, len(source)

    def text(value: str) -> None:
        if value:
            stack[-1].children.append(entities.unescape(value) if "&" in value else value)

    closes = source.rfind(">")
    while at < n:
        m = TAG.search(source, at) if at <= closes or "<!--" in source[at:] else None
        if m is None:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        name = m[2]
        space = _space(stack[-1])
        if not name:
            if space and source.startswith("<![CDATA[", m.start()):
                end = source.find("]]>", m.start())
                stack[-1].children.append(source[m.start() + 9 : end if end >= 0 else n])
                at = end + 3 if end >= 0 else n
            continue
        name = name.lower()
        if space and (name in ("br", "p") if m[1] else name in BREAKOUT or name == "font" and re.search(r"\s(?:color|face|size)\b", m[3], re.I)):
            while _space(stack[-1]):
                stack.pop()
            space = ""
        if m[1]:
            if name == "br":
                stack[-1].children.append(Node("br"))
            elif name == "p" and not any(x.name == "p" for x in stack):
                stack[-1].children.append(Node("p"))
            else:
                _end(stack, name)
            continue
        node = Node(name, _attributes(m[3]) if WANTED.search(m[3]) or name == "tspan" else None, name if name in ("svg", "math") else space)
        if name in ("html", "body"):
            if name == "body":
                _end(stack, "head")
                if all(x.name != "body" for x in stack) and len(stack) == 1:
                    stack[-1].children.append(node)
                    stack.append(node)
            continue
        if not space:
            _imply(stack, name)
        stack[-1].children.append(node)
        if name in VOID or node.space and m[3].endswith("/") and not UNQUOTED.search(m[3]):
            continue
        if name in RAW and not space:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>|\Z", re.I).search(source, at)
            inner = source[at : close.start()]
            at = close.end()
            if name == "textarea":
                inner = re.sub(r"\A\r?\n", "", inner)
            if inner and name in ("textarea", "title", "xmp"):
                node.children.append(entities.unescape(inner) if name != "xmp" else inner)
            continue
        if name == "plaintext":
            node.children.append(source[at:])
            break
        stack.append(node)
    return root


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for key, a, b, c in ATTRIBUTE.findall(source):
        out.setdefault(key.lower(), entities.unescape(a or b or c))
    return out


def _imply(stack: list[Node], name: str) -> None:
    """Close what a start tag ends, and open the rows and lists that it needs."""
    if name in ENDS_P:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name == "p":
                del stack[i:]
                break
            if stack[i].name in SCOPES or stack[i].name in BLOCK and stack[i].name != "p":
                break
    if name in HEADINGS and stack[-1].name in HEADINGS:
        stack.pop()
    if name in IMPLIED:
        ended, limits = IMPLIED[name]
        i = len(stack) - 1
        while i > 0 and stack[i].name not in limits:
            if stack[i].name in ended:
                del stack[i:]
            i -= 1
    if name in CONTEXT:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in CONTEXT[name]:
                del stack[i + 1 :]
                break
            if stack[i].name == "template":
                break
    if stack[0].name == "html" and len(stack) > 1 and stack[1].name == "head" and name not in ("meta", "link", "title", "script", "style", "base", "noscript", "template"):
        del stack[1:]
    if name in ("td", "th") and stack[-1].name in ("table", "thead", "tbody", "tfoot"):
        row = Node("tr")
        stack[-1].children.append(row)
        stack.append(row)


def _end(stack: list[Node], name: str) -> None:
    for i in range(len(stack) - 1, 0, -1):
        here = stack[i].name
        if here == name or here in HEADINGS and name in HEADINGS:
            del stack[i:]
            return
        if here in SCOPES and name not in TABLE_PARTS:
            return


def hidden(node: Node) -> bool:
    a = node.attributes
    if node.space and (node.name in UNDRAWN or a.get("display", "").strip().lower() == "none"):
        return True
    return node.name in UNSEEN or bool(a) and ("hidden" in a or GONE.search(a.get("style", "")) is not None or node.name == "input" and a.get("type", "").lower() == "hidden")


def seen(node: Node, before: bool) -> bool:
    """Whether the text of a node shows, by its own visibility or what it inherits."""
    if not node.attributes:
        return before
    said = VISIBILITY.findall(node.attributes.get("style", "")) or ([node.attributes["visibility"].strip()] if node.space and node.attributes.get("visibility") else [])
    return {"visible": True, "hidden": False, "collapse": False}.get(said[-1].lower(), before) if said else before


class Renderer:
    """Lines of text, and whether what comes shows."""

    def __init__(self, shows: bool = True, in_item: bool = False) -> None:
        self.shows, self.in_item = shows, in_item  # of a list
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.empty_before = 0

    def word(self, text: str) -> None:
        if not self.shows:
            return
        if not self.now:
            self.space = False
        if self.space:
            self.now.append(" ")
        self.now.append(text)
        self.space = False

    def inline(self, text: str) -> None:
        parts = BLANK.split(text)
        if len(parts) == 1:
            if text:
                self.word(text)
            return
        if parts[0]:
            self.word(parts[0])
        for part in parts[1:]:
            self.space = True
            if part:
                self.word(part)

    def line(self) -> None:
        """End the line, if there is text on it."""
        if self.now:
            if self.empty_before and self.lines:
                self.lines.append("")
            self.lines.append("".join(self.now))
            self.now, self.empty_before = [], 0
        self.space = False

    def gap(self) -> None:
        self.line()
        self.empty_before = 1

    def blank(self) -> None:
        """A forced line end."""
        if self.now:
            self.line()
        else:
            self.empty_before = 1

    def block(self, lines: list[str], first: str = "", rest: str = "") -> None:
        self.line()
        for i, text in enumerate(lines):
            self.now = [(first if not i else rest) + text if text or not i else ""]
            if not text and i:
                self.empty_before = max(self.empty_before, 0)
                self.lines.append("")
                self.now = []
            else:
                self.line()

    def finish(self) -> list[str]:
        self.line()
        return self.lines


def _run(work: Iterator) -> None:
    """Run a walk, which yields the walks that must end before it goes on; an explicit stack, so depth doesn't matter."""
    stack = [work]
    while stack:
        for inner in stack[-1]:
            stack.append(inner)
            break
        else:
            stack.pop()


def _walk(node: Node, out: Renderer, kept: bool) -> Iterator:
    for child in node.children:
        if isinstance(child, str):
            if kept:
                first, *rest = child.replace("\r\n", "\n").split("\n")
                if first:
                    out.word(first)
                for x in rest:
                    if out.now:
                        out.line()
                    else:
                        out.lines.append("")
                    if x:
                        out.word(x)
            else:
                out.inline(child)
        elif not hidden(child):
            if (inner := _element(child, out, kept)) is not None:
                yield inner


def _element(node: Node, out: Renderer, kept: bool) -> Iterator | None:
    """The walk of an element, if there is more to do."""
    return _plain(node, out, kept) if (shows := seen(node, out.shows)) == out.shows else _turned(node, out, kept, shows)


def _turned(node: Node, out: Renderer, kept: bool, shows: bool) -> Iterator:
    """An element that shows where what is around it doesn't, or the other way round."""
    before, out.shows = out.shows, shows
    if (inner := _plain(node, out, kept)) is not None:
        yield inner
    out.shows = before


def _plain(node: Node, out: Renderer, kept: bool) -> Iterator | None:
    name = node.name
    if node.space:
        return _drawn(node, out)
    if name == "br":
        out.blank()
    elif name == "wbr":
        pass
    elif name == "input" and node.attributes.get("value") and node.attributes.get("type", "").lower() in ("submit", "button", "reset"):
        out.inline(f" {node.attributes['value']} ")
    elif name == "table":
        return _table(node, out)
    elif name in ("ul", "ol", "menu", "dir"):
        return _list(node, out)
    elif name in INDENT:
        return _indented(node, out, kept)
    elif name == "details" and "open" not in node.attributes:
        return _closed(node, out, kept)
    elif name in ("option", "optgroup") and node.attributes.get("label", "").strip():
        return _labelled(node, out)
    elif name in ("select", "option", "optgroup"):
        return _between(node, out, False, out.line)
    elif name in SPACED:
        return _between(node, out, kept, out.gap)
    elif name in BLOCK or name in ("tr", "td", "th"):  # rows and cells outside a table
        return _between(node, out, kept, out.line)
    else:
        return _walk(node, out, kept)
    return None


def _between(node: Node, out: Renderer, kept: bool, end: Callable[[], None]) -> Iterator:
    end()
    yield _walk(node, out, kept)
    end()


def _indented(node: Node, out: Renderer, kept: bool) -> Iterator:
    end, indent = (out.line if node.name in ("dd", "textarea") else out.gap), INDENT[node.name]
    end()
    inner = Renderer(out.shows)
    yield _walk(node, inner, kept or node.name in ("pre", "xmp", "textarea"))
    out.block(inner.finish(), indent, indent)
    if node.name not in ("dd", "textarea"):
        end()


def _labelled(node: Node, out: Renderer) -> Iterator:
    """An option's label in place of its text, a group's before its options."""
    out.line()
    out.inline(node.attributes["label"].strip())
    out.line()
    if node.name == "optgroup":
        yield _walk(node, out, False)
        out.line()


def _drawn(node: Node, out: Renderer) -> Iterator:
    """Elements of svg and math: texts of a drawing stand apart, of a formula its parts that don't stand in a row."""
    name, apart = node.name, lambda: out.inline(" ")
    if node.space == "text":
        moved = name == "tspan" and not node.attributes.keys().isdisjoint(("x", "y", "dx", "dy"))
        return _between(node, out, False, apart) if moved else _walk(node, out, False)
    if name == "text" or name == "mtd":
        return _between(node, out, False, apart)
    if name in ("foreignobject", "mtr", "mlabeledtr", "mtable") or name == "math" and node.attributes.get("display", "").strip().lower() == "block":
        return _between(node, out, False, out.line)
    if node.space == "svg" or name in PLACED or name in FIRST:
        return _nodes(node, out)
    return _between(node, out, False, apart) if name == "mspace" else _walk(node, out, False)


def _nodes(node: Node, out: Renderer) -> Iterator:
    """The elements of a drawing or formula; strings between them aren't shown in a drawing."""
    for child in node.children:
        if isinstance(child, str):
            if node.space == "math":
                out.inline(child)
            continue
        if not hidden(child):
            if node.name in PLACED:
                out.inline(" ")
            if (inner := _element(child, out, False)) is not None:
                yield inner
            if node.name in PLACED:
                out.inline(" ")
        if node.name in FIRST:
            break


def _closed(node: Node, out: Renderer, kept: bool) -> Iterator:
    """Of closed details the first summary alone."""
    out.line()
    for child in node.children:
        if isinstance(child, Node) and child.name == "summary" and not hidden(child):
            before, out.shows = out.shows, seen(child, out.shows)
            yield _walk(child, out, kept)
            out.shows = before
            break
    out.line()


def _list(node: Node, out: Renderer) -> Iterator:
    out.line() if out.in_item else out.gap()
    number = int(node.attributes.get("start", "1")) if re.fullmatch("-?[0-9]{1,9}", node.attributes.get("start", "1")) else 1
    for child in node.children:
        if isinstance(child, str):
            out.inline(child)
        elif hidden(child):
            continue
        elif child.name == "li":
            mark = f"{number}. " if node.name == "ol" else "- "
            number += 1
            item = Renderer(seen(child, out.shows), True)
            yield _walk(child, item, False)
            lines = item.finish()
            if lines:
                out.block(lines, mark, " " * len(mark))
        elif (inner := _element(child, out, False)) is not None:
            yield inner
    out.line() if out.in_item else out.gap()


def _parts(node: Node, shows: bool) -> Iterator[tuple[Node | str, Node, bool]]:
    """Rows and all else that stands in a table or its sections, outside of rows; with the section, and whether it shows."""
    for child in node.children:
        if isinstance(child, str):
            yield child, node, shows
        elif not hidden(child):
            if child.name in ("thead", "tbody", "tfoot"):
                yield from _parts(child, seen(child, shows))
            else:
                yield child, node, shows


def _span(node: Node, name: str, most: int) -> int:
    """How many columns or rows a cell spans; 0 rows are all that follow in the section."""
    found = NUMBER.match(node.attributes.get(name, "1"))
    n = 1 if not found else min(int(found[1]), most) if len(found[1]) < 10 else most
    return n or (most if name == "rowspan" else 1)


class Taken:
    """Columns that cells of earlier rows span, as intervals that don't touch."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.until: list[tuple[int, int, int]] = []  # a heap: the row from which columns are free again, and the columns
        self.crossed = False

    def free(self, column: int) -> int:
        """The first column from this one on that isn't taken."""
        i = bisect_right(self.starts, column) - 1
        return max(column, self.ends[i]) if i >= 0 else column

    def _cover(self, start: int, end: int) -> bool:
        """Take columns; whether some of them were taken already."""
        i, j = bisect_left(self.ends, start), bisect_right(self.starts, end)
        crossed = any(a < end and b > start for a, b in zip(self.starts[i:j], self.ends[i:j], strict=True))
        if i < j:
            start, end = min(start, self.starts[i]), max(end, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [start], [end]
        return crossed

    def take(self, start: int, end: int, until: int) -> None:
        heappush(self.until, (until, start, end))
        self.crossed |= self._cover(start, end)

    def row(self, row: int) -> None:
        """Free what ends before this row."""
        while self.until and self.until[0][0] <= row:
            _, start, end = heappop(self.until)
            i, j = bisect_right(self.ends, start), bisect_left(self.starts, end)
            left = [(a, b) for a, b in ((self.starts[i], start), (end, self.ends[j - 1])) if a < b] if i < j else []
            self.starts[i:j], self.ends[i:j] = [a for a, _ in left], [b for _, b in left]
            if self.crossed:  # some of it may still be under another cell
                self.starts, self.ends, self.crossed = [], [], False
                self.until = [x for x in self.until if x[0] > row]
                heapify(self.until)
                for _, a, b in sorted(self.until, key=lambda x: x[1:]):
                    self.crossed |= self._cover(a, b)


def _table(node: Node, to: Renderer) -> Iterator:
    """Cells of a row side by side, two spaces between, in columns; what stands outside of rows comes first."""
    to.gap()
    out, grid, rows = [], [], []
    for child, section, shows in _parts(node, to.shows):
        if isinstance(child, str):
            if child.strip() and shows:
                out.append(BLANK.sub(" ", child).strip())
        elif child.name == "tr":
            rows.append((child, section, seen(child, shows)))
        else:
            inner = Renderer(shows)
            if (more := _element(child, inner, False)) is not None:
                yield more
            out.extend(inner.finish())
    taken, before, at = Taken(), None, 0  # at: the row's number in its section
    for row, section, shows in rows:
        if section is not before:
            taken, before, at = Taken(), section, 0
        taken.row(at)
        cells: dict[int, list[str]] = {}
        column = 0
        for child in row.children:
            wide = high = 1
            if isinstance(child, str):
                lines = [BLANK.sub(" ", child).strip()] if child.strip() and shows else []
            elif hidden(child):
                continue
            else:
                inner = Renderer(seen(child, shows))
                if child.name in ("td", "th"):
                    wide, high = _span(child, "colspan", 1000), _span(child, "rowspan", 65534)
                    yield _walk(child, inner, False)
                elif (more := _element(child, inner, False)) is not None:
                    yield more
                lines = inner.finish()
            if not lines and (isinstance(child, str) or child.name not in ("td", "th")):
                continue  # an empty form is no cell
            column = taken.free(column)
            if lines:
                cells[column] = lines
            if high > 1:
                taken.take(column, column + wide, at + high)
            column += wide
        at += 1
        grid.append(cells)
    out.extend(_aligned(grid))
    to.block(out)
    to.gap()


def _aligned(grid: list[dict[int, list[str]]]) -> Iterator[str]:
    """The lines of rows of cells (column: lines)."""
    used = sorted({c for cells in grid for c in cells})
    place = {c: i for i, c in enumerate(used)}  # columns without text take no room, but for one gap
    widths = [0] * len(used)
    for cells in grid:
        for c, lines in cells.items():
            widths[place[c]] = max(widths[place[c]], min(WIDE, max(map(len, lines))))
    start = [0]
    for i, width in enumerate(widths):
        start.append(start[-1] + width + 2 * (1 if i + 1 == len(used) else min(2, used[i + 1] - used[i])))
    for cells in grid:
        ordered = sorted(cells)
        for k in range(max(map(len, cells.values()), default=0)):
            line = ""
            for c in ordered:
                text = cells[c][k] if k < len(cells[c]) else ""
                if text:
                    least = 2 if line else 0
                    line += " " * max(least, min(start[place[c]] - len(line), GAP - len(text) + len(text.lstrip(" ")))) + text
            yield line


def render(source: str | None) -> str:
    """The visible text of a page; empty for an empty or missing one."""
    if not source:
        return ""
    out = Renderer()
    _run(_walk(parse(source.replace("\x00", "")), out, False))
    return "\n".join(x.rstrip() for x in out.finish()).strip("\n")


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Every row of pages, without its markup, with the text that a browser would show and its length in code points.

    Null and empty pages have an empty text; broken markup is read as far as it
    goes.  Rows that repeat stay repeated; columns of pages named like the new ones
    (text, n_chars) are replaced.
    """
    textkit.bounded_batches(pages.sparkSession)
    keep = [c for c in pages.columns if c not in (html, text, "n_chars")]
    schema = pages.select(*keep).schema.add(text, "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                made = [render(x) for x in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(made, pa.string()), pa.array(map(len, made), pa.int64())], [*keep, text, "n_chars"])

    return pages.select(*keep, html).mapInArrow(textkit.trimming(run), schema)
