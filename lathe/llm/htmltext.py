"""Layout-aware rendering of HTML to plain text.

A tokenizer feeds a tree builder that knows void elements, implied end tags and
raw-text elements; visibility rules prune the tree; what is left is laid out:
blocks on lines of their own with blank lines where browsers leave a margin,
list items with markers and indentation, table cells in aligned columns, line by
line, with spans over columns and rows.

Shape at scale: one map over the pages, no shuffle. Neither the parser nor the
layout recurses, and both look up open elements by name instead of searching for
them, so nesting of any depth takes time linear in the page.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import pick

#: Indentation grows up to this column; deeper blocks stand there.
MAX_INDENT = 64
#: Lines of table cells are wrapped at blanks to this width, if the table has
#: columns. Words, preformatted lines and inner tables are never cut; they widen
#: their column up to WIDE and run over it beyond.
WRAP, WIDE = 80, 200
#: Cells of tables in so many others stand one below the other.
ALIGNED_TABLES = 8
#: The window for which a style sheet's media rules are read.
SCREEN_WIDTH = 1280

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes template noscript textarea title".split())
HIDDEN = set("head script style template noscript title meta link datalist iframe noembed noframes object audio video canvas desc defs metadata symbol clippath mask annotation annotation-xml".split())
MARGIN = dict.fromkeys("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl table pre figure hr fieldset menu".split(), 2) | dict.fromkeys(
    "html body div section article header footer nav main aside address li dt dd tr td th thead tbody tfoot caption form figcaption details summary "
    "legend option optgroup select textarea dialog center hgroup search".split(),
    1,
)
# an opening tag closes these open elements, looked for up to a boundary
_LIST, _TABLE = {"ul", "ol", "menu"}, {"table"}
CLOSES = {
    "li": ({"li"}, _LIST),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, _TABLE),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, _TABLE),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, _TABLE),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, _TABLE),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
_ENDS_P = {t for t, m in MARGIN.items() if t not in ("html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "option", "optgroup", "select", "textarea", "legend")}
_SCOPE = {"table", "td", "th", "caption", "html", "button"}

_TAG = re.compile(r"<(?:!--(?P<comment>)|(?P<other>[!?])|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*))")
_REST = re.compile(r"""(?:[^>"']+|"[^"]*"|'[^']*')*+>""")
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_NO_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_BREAK = "\v"
_CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_SELECTOR = re.compile(r"[\w-]+|[\w-]*[.#][\w-]+")
_FEATURE = re.compile(r"\(\s*(min|max)-width\s*:\s*(\d+)px\s*\)")
#: What stands between the children of these formula elements.
BETWEEN = {"mfrac": "/", "msup": "^", "msub": "_", "mover": "^", "munder": "_"}
_LISTS = {"ul", "ol", "menu"}


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs = tag, attrs
        self.children: list[Node | str] = []


class _Open:
    """The open elements, with the places of each name."""

    def __init__(self, root: Node) -> None:
        self.stack = [root]
        self.at: dict[str, list[int]] = defaultdict(list)

    def push(self, node: Node) -> None:
        self.at[node.tag].append(len(self.stack))
        self.stack.append(node)

    def close_to(self, index: int) -> None:
        while len(self.stack) > index:
            self.at[self.stack.pop().tag].pop()

    def last(self, names: set[str]) -> int:
        """Place of the innermost of these elements, 0 if none is open."""
        return max([self.at[x][-1] for x in names if self.at.get(x)], default=0)

    def close(self, names: set[str], boundary: set[str]) -> None:
        """Close the outermost of these elements that is inside the innermost boundary, and all in it."""
        inside = self.last(boundary)
        found = [self.at[x][k] for x in names if self.at.get(x) and (k := bisect_right(self.at[x], inside)) < len(self.at[x])]
        if found:
            self.close_to(min(found))


def _on_screen(query: str) -> bool:
    """Whether a media query list holds for a screen of SCREEN_WIDTH pixels."""

    def holds(one: str) -> bool:
        widths = all(int(n) <= SCREEN_WIDTH if which == "min" else int(n) >= SCREEN_WIDTH for which, n in _FEATURE.findall(one))
        words = _FEATURE.sub(" ", one).replace("only ", " ").split()
        return widths and all(x in ("screen", "all", "and") for x in words)

    return any(holds(one) for one in query.lower().split(","))


def hidden_selectors(css: str) -> set[str]:
    """Simple selectors whose rules hide on a screen: names, classes, ids, and names with one of those."""
    out: set[str] = set()
    # of the open braces: whether rules inside apply, and the selectors of a rule
    blocks: list[tuple[bool, str]] = []
    at = 0
    css = _CSS_COMMENT.sub(" ", css)
    for m in re.finditer("[{}]", css):
        text, at = css[at : m.start()], m.end()
        if m.group() == "}":
            applies, selectors = blocks.pop() if blocks else (False, "")
            if applies and selectors and _NO_DISPLAY.search(text):
                named = (x.strip() for x in selectors.split(","))
                out.update(x if x[0] in ".#" else x.lower() for x in named if _SELECTOR.fullmatch(x))
            continue
        prelude = text.rpartition(";")[2].strip()
        applies = not blocks or blocks[-1][0]
        if prelude.startswith("@"):
            name, _, rest = prelude[1:].partition(" ")
            blocks.append((applies and (name in ("supports", "layer", "container", "scope") or name == "media" and _on_screen(rest)), ""))
        else:
            blocks.append((applies, prelude))
    return out


def parse(source: str) -> tuple[Node, set[str]]:
    """The tree of a page, and the simple selectors that its style sheets hide."""
    root = Node("html", {})
    opened = _Open(root)
    stack = opened.stack
    hidden: set[str] = set()
    at, n = 0, len(source)
    quotes = True  # until an attribute's quote turns out to be unclosed

    while at < n:
        m = _TAG.search(source, at)
        if m is None:
            stack[-1].children.append(html.unescape(source[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(html.unescape(source[at : m.start()]))
        if m["comment"] is not None:
            end = source.find("-->", m.start() + 2)
            at = n if end < 0 else end + 3
            continue
        if m["other"]:
            end = source.find(">", m.end())
            at = n if end < 0 else end + 1
            continue
        rest = _REST.match(source, m.end()) if quotes else None
        if rest is None:
            quotes = False
            end = source.find(">", m.end())
            if end < 0:
                break
            at = end + 1
        else:
            at = rest.end()
        name = m["name"].lower()
        if m["close"]:
            place = opened.last({name})
            # inline elements do not end outside a table cell or the like
            if place and (name in MARGIN or name in _SCOPE or opened.last(_SCOPE) < place):
                opened.close_to(place)
            continue
        if name == "html":
            continue
        attrs = {}
        raw = source[m.end() : at - 1]
        if raw:
            for a in _ATTR.finditer(raw):
                attrs.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
        if name in CLOSES:
            opened.close(*CLOSES[name])
        if name in _ENDS_P:
            opened.close({"p"}, _SCOPE)
        if name not in HIDDEN and name != "base" and stack[-1].tag == "head":
            opened.close_to(len(stack) - 1)
        node = Node(name, attrs)
        stack[-1].children.append(node)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
            stop = n if end is None else end.start()
            body = source[at:stop]
            if name == "style":
                hidden |= hidden_selectors(body)
            elif name not in HIDDEN:
                node.children.append(html.unescape(body) if name == "textarea" else body)
            close_at = source.find(">", stop)
            at = n if close_at < 0 else close_at + 1
        elif name not in VOID and (not raw.endswith("/") or name in MARGIN):
            opened.push(node)
    return root, hidden


def visible(node: Node, hidden: set[str]) -> bool:
    attrs = node.attrs
    if node.tag in HIDDEN:
        return False
    if attrs:
        if "hidden" in attrs or _NO_DISPLAY.search(attrs.get("style", "")):
            return False
        if hidden:
            named = ["#" + attrs["id"]] if attrs.get("id") else []
            named += ["." + c for c in attrs.get("class", "").split()]
            if any(x in hidden or node.tag + x in hidden for x in named):
                return False
    return node.tag not in hidden and not (node.tag == "dialog" and "open" not in attrs)


def _trimmed(lines: list[str]) -> list[str]:
    """The lines without empty ones at the end."""
    n = len(lines)
    while n and not lines[n - 1]:
        n -= 1
    return lines[:n]


class _Block:
    """An open block: its margin, what stands before its first and its other lines, and the margin below its last child."""

    __slots__ = ("margin", "mark", "indent", "rest", "started", "gap", "number", "tag")

    def __init__(self, tag: str, margin: int, mark: str, indent: str, rest: str) -> None:
        self.tag, self.margin, self.mark, self.indent, self.rest = tag, margin, mark, indent, rest
        self.started, self.gap, self.number = False, 0, 1


class _Page:
    """Lines of a page or cell; text gathers in ``inline`` until a block or the end flushes it."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.fixed: list[bool] = []
        self.inline: list[str] = []
        self.blocks = [_Block("", 0, "", "", "")]
        self.blocks[0].started = True

    def open(self, tag: str, margin: int, mark: str = "", indent: str = "") -> None:
        self.flush()
        outer = self.blocks[-1].rest
        if len(outer) >= MAX_INDENT:
            indent = ""
        self.blocks.append(_Block(tag, margin, mark or indent, indent, outer + indent if indent else outer))

    def close(self) -> None:
        self.flush()
        block, outer = self.blocks.pop(), self.blocks[-1]
        outer.gap = block.margin if block.started else max(outer.gap, block.margin)

    def add(self, lines: list[str], fixed: bool = False) -> None:
        """Lines of the innermost block."""
        if not lines:
            return
        k = len(self.blocks) - 1
        while not self.blocks[k].started:
            k -= 1
        base = self.blocks[k]
        new = self.blocks[k + 1 :]
        below = max(base.gap, new[0].margin if new else 0)
        if below > 1 and self.lines and self.lines[-1] and (k or self.lines):
            self._put("", True)
        first = base.rest + "".join(b.mark for b in new)
        for b in new:
            b.started = True
        self.blocks[-1].gap = 0
        rest = self.blocks[-1].rest
        for n, line in enumerate(lines):
            self._put((rest if n else first) + line if line or not n and first else "", fixed)

    def _put(self, line: str, fixed: bool) -> None:
        self.lines.append(line.rstrip(" ") if not line.strip(" ") else line)
        self.fixed.append(fixed)

    def flush(self) -> None:
        if not self.inline:
            return
        text = _SPACES.sub(" ", "".join(self.inline))
        self.inline = []
        lines = _trimmed([x.strip(" ") for x in text.split(_BREAK)])
        while lines and not lines[0]:
            lines.pop(0)
        self.add(lines)


class _Table:
    """Cells of a table: (row, column, columns, rows, node), filled in with their lines as they are laid out."""

    def __init__(self, node: Node, hidden: set[str]) -> None:
        self.around: list[Node | str] = []
        self.cells: list[tuple[int, int, int, int, Node]] = []
        self.pages: list[_Page] = []
        self.rows = 0
        self.taken: dict[int, int] = {}  # column: first row that is free again
        for child in node.children:
            if isinstance(child, Node) and child.tag in ("thead", "tbody", "tfoot"):
                if visible(child, hidden):
                    for inner in child.children:
                        self._place(inner, hidden)
            else:
                self._place(child, hidden)

    def _place(self, child: Node | str, hidden: set[str]) -> None:
        if isinstance(child, str):
            if child.strip():
                self.around.append(child)
        elif not visible(child, hidden) or child.tag in ("colgroup", "col"):
            return
        elif child.tag == "tr":
            self._row(child.children, hidden)
        elif child.tag in ("td", "th"):  # the row's tag is implied
            self._row([child], hidden)
        else:
            self.around.append(child)

    def _row(self, children: list[Node | str], hidden: set[str]) -> None:
        column = 0
        row = self.rows
        for cell in children:
            if isinstance(cell, str):
                if cell.strip():
                    self.around.append(cell)
            elif visible(cell, hidden):
                if cell.tag not in ("td", "th"):
                    self.around.append(cell)
                    continue
                while self.taken.get(column, 0) > row:
                    column += 1
                # the bounds are the standard's own
                wide = min(max(_number(cell.attrs.get("colspan"), 1), 1), 1000)
                tall = min(_number(cell.attrs.get("rowspan"), 1), 65534) or 65534
                self.cells.append((row, column, wide, tall, cell))
                if tall > 1:
                    self.taken.update(dict.fromkeys(range(column, column + wide), row + tall))
                column += wide
        self.rows += 1

    def lines(self) -> list[str]:
        starts = sorted({c[1] for c in self.cells})
        if len(starts) < 2:
            return [line for page in self.pages for line in page.lines]
        # columns in which some cell starts; a cell spans those up to the next start behind it
        spans = [(bisect_left(starts, c), bisect_left(starts, c + wide)) for _, c, wide, _, _ in self.cells]
        texts = [_wrapped(page) for page in self.pages]
        widths = [0] * len(starts)
        sizes = [max([len(x) for x in text if len(x) <= WIDE], default=0) for text in texts]
        for (a, b), size in sorted(zip(spans, sizes), key=lambda x: x[0][1] - x[0][0]):
            has = sum(widths[a:b]) + 2 * sum(1 for w in widths[a : b - 1] if w)
            if size > has:
                widths[b - 1] += size - has
        left = [0]
        for w in widths:
            left.append(left[-1] + (w + 2 if w else 0))
        out: list[str] = []
        flowing: list[tuple[int, list[str], int]] = []  # column, lines to come, last row
        k = 0
        for row in range(self.rows):
            while k < len(self.cells) and self.cells[k][0] == row:
                if texts[k]:
                    flowing.append((left[spans[k][0]], texts[k], min(row + self.cells[k][3], self.rows) - 1))
                k += 1
            height = max([len(text) for _, text, last in flowing if last == row], default=0)
            if not height and any(last > row for _, _, last in flowing):
                height = 1
            flowing.sort(key=lambda x: x[0])
            for n in range(height):
                line = ""
                for x, text, _ in flowing:
                    if n < len(text) and text[n]:
                        line = (line.ljust(x) if len(line) <= x - 2 or not line else line + "  ") + text[n]
                out.append(line.rstrip(" "))
            flowing = [(x, text[height:], last) for x, text, last in flowing if last > row and text[height:]]
        return out


def _number(value: str | None, default: int) -> int:
    return int(value) if value and re.fullmatch(r"\d{1,9}", value) else default


def _wrapped(page: _Page) -> list[str]:
    """The lines of a cell, those of running text wrapped."""
    out = []
    for line, fixed in zip(page.lines, page.fixed):
        indent = " " * min(len(line) - len(line.lstrip(" ")), WRAP // 2)
        while not fixed and len(line) > WRAP:
            cut = line.rfind(" ", len(indent) + 1, WRAP + 1)
            cut = cut if cut > 0 else line.find(" ", WRAP)
            if cut < 0:
                break
            out.append(line[:cut].rstrip(" "))
            line = indent + line[cut + 1 :].lstrip(" ")
        out.append(line)
    return out


def _preformatted(node: Node, hidden: set[str]) -> list[str]:
    parts: list[str] = []
    todo: list[Node | str] = list(reversed(node.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x.tag == "br":
            parts.append("\n")
        elif visible(x, hidden):
            todo += reversed(x.children)
    return _trimmed([x.rstrip() for x in "".join(parts).removeprefix("\n").split("\n")])


def render(source: str | None) -> str | None:
    """The visible text of a page, laid out; None for None."""
    if source is None:
        return None
    root, hidden = parse(source)
    pages, tables = [_Page()], []
    # what is to come: text and elements, each with whether it is drawn only inside text (svg), and ends of blocks, cells and tables
    todo: list[tuple[object, bool]] = [(x, False) for x in reversed(root.children)]
    while todo:
        x, drawn = todo.pop()
        page = pages[-1]
        if isinstance(x, str):
            if not drawn:
                page.inline.append(x.replace(_BREAK, " "))
            continue
        if x is _END_BLOCK:
            page.close()
            continue
        if x is _END_CELL:
            page.flush()
            tables[-1].pages.append(pages.pop())
            continue
        if x is _END_TABLE:
            table = tables.pop()
            page.add(table.lines(), fixed=True)
            page.close()
            continue
        if isinstance(x, _Cell):
            pages.append(_Page())
            todo.append((_END_CELL, False))
            todo += [(c, False) for c in reversed(x.node.children)]
            continue
        tag = x.tag
        if tag == "br":
            page.inline.append(_BREAK)
        elif tag == "wbr" or not visible(x, hidden):
            continue
        elif tag == "pre":
            page.open(tag, 2)
            page.add(_preformatted(x, hidden), fixed=True)
            page.close()
        elif tag == "table" and len(tables) < ALIGNED_TABLES:
            page.open(tag, 2)
            table = _Table(x, hidden)
            tables.append(table)
            todo.append((_END_TABLE, False))
            todo += [(_Cell(c[4]), False) for c in reversed(table.cells)]
            if table.around:
                page.open("div", 1)
                todo.append((_END_BLOCK, False))
                todo += [(c, False) for c in reversed(table.around)]
        elif tag in MARGIN or drawn and tag in ("text", "foreignobject"):
            mark = indent = ""
            if tag == "li" and page.blocks[-1].tag in _LISTS:
                outer = page.blocks[-1]
                mark = f"{outer.number}. " if outer.tag == "ol" else "- "
                outer.number += 1
                indent = " " * len(mark)
            elif tag in ("blockquote", "dd"):
                indent = "  "
            page.open(tag, MARGIN.get(tag, 1), mark, indent)
            if tag == "ol":
                start = x.attrs.get("start", "1")
                page.blocks[-1].number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
            todo.append((_END_BLOCK, False))
            todo += [(c, False) for c in reversed(x.children)]
        elif tag == "input":
            if x.attrs.get("type", "").lower() in ("submit", "button", "reset"):
                page.inline.append(html.unescape(x.attrs.get("value", "")))
        elif tag in BETWEEN:
            parts = [c for c in x.children if isinstance(c, Node)]
            for k in range(len(parts) - 1, -1, -1):
                todo.append((parts[k], drawn))
                if k:
                    todo.append((BETWEEN[tag], drawn))
        else:
            todo += [(c, drawn or tag == "svg") for c in reversed(x.children)]
    pages[0].flush()
    return "\n".join(pages[0].lines)


class _Cell:
    __slots__ = ("node",)

    def __init__(self, node: Node) -> None:
        self.node = node


_END_BLOCK, _END_CELL, _END_TABLE = object(), object(), object()


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [render(x) for x in batch.column("html").to_pylist()]
        yield pa.record_batch([batch.column("page_id"), pa.array(texts, pa.string())], names=["page_id", "text"])


def rendered(pages: DataFrame) -> DataFrame:
    """(page_id, text) for every page.

    Null html gives null text, empty html and pages without visible text give
    an empty one. A null page_id stays null; repeated rows give repeated results;
    markup may be broken in any way, nested to any depth and of any length. All
    visible text is kept; only its placing has bounds: indentation ends at
    MAX_INDENT, columns are aligned up to WIDE, tables nested in ALIGNED_TABLES
    others are laid out as one column, and spans are at most 1,000 columns and
    65,534 rows, as the HTML standard has it. Extra columns are ignored. An empty
    table gives no rows.
    """
    rows = pick(pages, "page_id", "html").select(F.col("page_id").cast("long"), "html")
    return rows.mapInArrow(_render, "page_id long, text string")
