"""HTML to plain text as a page would lay it out.

A small tree builder supplies the end tags that HTML lets authors leave out; visibility rules drop what a reader would not
see; and a renderer writes the rest with blank lines between blocks, list markers, preserved ``pre`` and aligned cells.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_slices

#: Where markup starts; a tag's name; and its attributes up to the end of the tag. A quote only opens a value after ``=``.
OPENING = re.compile(r"<(?:!--|[!?]|/?(?=[a-zA-Z]))")
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
ATTRS = re.compile(r"""((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""")
ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
SPACE = re.compile(r"[ \t\n\f\r]+")
SIMPLE = re.compile(r"[a-zA-Z][\w-]*|[a-zA-Z]?[\w-]*[.#][\w-]+")
STYLE_NONE = re.compile(r"display\s*:\s*none", re.I)
STYLE_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)

# fixed values of HTML: which elements are void, raw, blocks, and end which open ones
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPED_RAW = frozenset("title textarea".split())
UNSEEN = frozenset("head script style template noscript title iframe object embed applet audio video canvas svg math datalist select noembed noframes meta link base param source track area map".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td textarea tfoot th thead tr ul xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre xmp ul ol menu dir dl table figure fieldset hr".split())
ENDS_P = BLOCKS - frozenset("body html caption dd dt li tbody td tfoot th thead tr legend textarea".split()) | {"li", "dd", "dt"}
#: An opening tag ends these open elements, looked for up to the nearest of those.
CELL = ("td", "th")
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "td": (CELL, ("tr", "table")), "th": (CELL, ("tr", "table")), "tr": (("tr", *CELL, "caption", "colgroup"), ("table",)),
    **{t: (("thead", "tbody", "tfoot", "tr", *CELL, "caption", "colgroup"), ("table",)) for t in ("thead", "tbody", "tfoot", "caption", "colgroup")},
    "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)),
    "body": (("head",), ("html",)), **{t: ((t,), ()) for t in ("a", "button")},
}
SCOPE = frozenset(("table", "td", "th", "caption", "button", "object", "html"))
TABLE_TAGS = frozenset("table thead tbody tfoot tr td th caption".split())
#: Elements nested deeper than this become siblings, as in browsers. A cell beside others is wrapped to WIDE characters. No cell
#: spans more columns than MOST_SPAN, as the HTML standard has it.
DEPTH, WIDE, MOST_SPAN, BLANKS = 300, 60, 1000, 32


class Node:
    __slots__ = ("tag", "attrs", "children", "hidden")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children, self.hidden = tag, attrs, [], False

    def attr(self, name: str) -> str | None:
        """The attribute's value, empty if it has none, None if it is absent."""
        if name in self.attrs.lower():
            for m in ATTR.finditer(self.attrs):
                if m[1].lower() == name:
                    return unescape(next((g for g in m.groups()[1:] if g is not None), ""))
        return None

    def number(self, name: str, default: int) -> int:
        value = (self.attr(name) or "").strip()
        return int(value) if re.fullmatch(r"-?[0-9]{1,9}", value) else default


def tokens(html: str, at: int, quotes: bool) -> tuple[int, int, str, str, str | None, bool]:
    """The next markup from ``at``: where it starts and ends, its kind (start, end, other or none), name and attributes, and
    whether quotes still count. Each character is looked at a fixed number of times over all calls for a text.

    Markup that is not closed hides the rest if it is a comment, and is text otherwise. After a first tag whose quotes run to
    the end of the text, tags end at the next ``>``."""
    m = OPENING.search(html, at)
    if m is None:
        return len(html), len(html), "none", "", None, quotes
    start, mark = m.start(), m[0]
    if mark == "<!--":
        end = html.find("-->", start + 2)
        return start, end + 3 if end >= 0 else len(html), "other", "", None, quotes
    if mark in ("<!", "<?"):
        return start, html.find(">", start) + 1 or len(html), "other", "", None, quotes
    name = NAME.match(html, m.end())
    attrs = ATTRS.match(html, name.end()) if quotes else None
    if attrs is None:
        end = html.find(">", name.end())
        if end < 0:
            return len(html), len(html), "none", "", None, False
        return start, end + 1, "end" if mark == "</" else "start", name[0].lower(), html[name.end() : end], False
    return start, attrs.end(), "end" if mark == "</" else "start", name[0].lower(), attrs[1], quotes


def _rules(sheet: str) -> Iterator[tuple[str, str]]:
    """(selectors, body) of the rules of a style sheet that are not within another block."""
    first, *others = sheet.split("/*")
    sheet = first + "".join(" " + x.partition("*/")[2] for x in others)
    depth = start = opened = 0
    for m in re.finditer("[{};]", sheet):
        if m[0] == "{":
            opened = m.start() if depth == 0 else opened
            depth += 1
        elif m[0] == "}" and depth:
            depth -= 1
            if depth == 0:
                yield sheet[start:opened], sheet[opened + 1 : m.start()]
        start = m.end() if depth == 0 else start


def hiding(sheets: list[str]) -> set[str]:
    """Selectors of one tag, class or id, or a tag with one of these, that style sheets give ``display: none``."""
    found: set[str] = set()
    for sheet in sheets:
        for selectors, body in _rules(sheet):
            if not selectors.lstrip().startswith("@") and STYLE_NONE.search(body):
                found.update(x.strip() for x in selectors.split(",") if SIMPLE.fullmatch(x.strip()))
    return found


def _hide(root: Node, selectors: set[str]) -> None:
    todo = [root]
    while todo:
        node = todo.pop()
        keys = [node.tag]
        if node.attrs:
            keys += [k for c in (node.attr("class") or "").split() for k in (f".{c}", f"{node.tag}.{c}")]
            keys += [k for i in (node.attr("id") or "").split() for k in (f"#{i}", f"{node.tag}#{i}")]
        node.hidden = not selectors.isdisjoint(keys)
        todo.extend(c for c in node.children if not isinstance(c, str))


def parse(html: str) -> Node:
    root = Node("#root")
    stack, sheets = [root], []

    def close(names: tuple, until: tuple | frozenset) -> None:
        last = 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                last = i
            elif stack[i].tag in until:
                break
        if last:
            del stack[last:]

    at, size, quotes = 0, len(html), True
    unseen, inside = "", 0  # an unseen element below DEPTH, and how many elements of its name are open
    while at < size:
        start, end, kind, name, attrs, quotes = tokens(html, at, quotes)
        if start > at and not inside:
            stack[-1].children.append(unescape(html[at:start]))
        at = end
        if inside:
            inside += (name == unseen) * ((kind == "start") - (kind == "end"))
            continue
        if kind == "end":
            if name == "br":
                stack[-1].children.append(Node("br"))
            elif name not in ("body", "html"):  # what follows them still belongs to the body
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == name:
                        del stack[i:]
                        break
                    if stack[i].tag in SCOPE and name not in TABLE_TAGS:
                        break
            continue
        if kind != "start" or name in ("html", "body") and any(n.tag == name for n in stack[:4]):
            continue
        if name in ENDS:
            close(*ENDS[name])
        if name in BLOCKS and stack[-1].tag == "head" or name == "body":
            close(("head",), ())
        if name in ENDS_P:
            close(("p",), SCOPE)
        node = Node(name, attrs)
        stack[-1].children.append(node)
        if name in RAW or name in ESCAPED_RAW:
            found = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
            text = html[at : found.start() if found else size]
            node.children.append(unescape(text) if name in ESCAPED_RAW else text)
            if name == "style":
                sheets.append(text)
            at = (html.find(">", found.start()) + 1 or size) if found else size
        elif name not in VOID and not attrs.endswith("/") or name not in VOID and name in BLOCKS:
            if len(stack) < DEPTH:
                stack.append(node)
            elif not visibility(node, True)[0]:
                unseen, inside = name, 1
    if selectors := hiding(sheets):
        _hide(root, selectors)
    return root


def visibility(node: Node, shown: bool) -> tuple[bool, bool]:
    """(is it laid out, are its texts seen)."""
    if node.tag in UNSEEN or node.hidden:
        return False, False
    if node.attrs:
        low = node.attrs.lower()
        if "hidden" in low and (node.attr("hidden") not in (None, "until-found") or node.tag == "input"):
            return False, False
        if "style" in low and (style := node.attr("style")):
            if STYLE_NONE.search(style):
                return False, False
            if found := STYLE_VISIBILITY.search(style):
                shown = found[1].lower() == "visible"
    if node.tag == "dialog" and node.attr("open") is None:
        return False, False
    return True, shown


def _append(out: list[str], lines: list[str]) -> None:
    """Margins are empty lines at either end of a block's lines; adjacent ones collapse into one."""
    out.extend(lines[1:] if out and lines and out[-1] == lines[0] == "" else lines)


def _spaced(lines: list[str]) -> list[str]:
    return lines and [*([""] if lines[0] else []), *lines, *([""] if lines[-1] else [])]


def _bare(lines: list[str]) -> list[str]:
    start, end = 0, len(lines)
    while start < end and not lines[start]:
        start += 1
    while end > start and not lines[end - 1]:
        end -= 1
    return lines[start:end]


def flow(node: Node, shown: bool, pre: bool = False, only: str | None = None) -> list[str]:
    """The lines of a node's children. ``only``: leave out elements and texts other than this element."""
    out: list[str] = []
    inline: list[str] = []

    def flush() -> None:
        if not inline:
            return
        text = "".join(inline)
        inline.clear()
        lines = text.split("\n") if pre else [SPACE.sub(" ", line).strip(" ") for line in text.split("\0")]
        _append(out, _bare([line.replace("\xa0", " ").rstrip() for line in lines]))

    def walk(parent: Node, seen: bool) -> None:
        for child in parent.children:
            if isinstance(child, str):
                if seen and only is None:
                    inline.append(child if pre else child.replace("\0", ""))
                continue
            if only is not None and child.tag != only:
                continue
            if child.tag == "br":
                inline.append("\n" if pre else "\0")
                continue
            laid, visible = visibility(child, seen)
            if not laid:
                continue
            if child.tag in BLOCKS:
                flush()
                lines = block(child, visible, pre)
                nested = node.tag in ("li", "dd") and child.tag in ("ul", "ol", "menu", "dir")
                _append(out, _spaced(lines) if child.tag in SPACED and not nested else lines)
            else:
                walk(child, visible)

    walk(node, shown)
    flush()
    return out


def block(node: Node, shown: bool, pre: bool) -> list[str]:
    tag = node.tag
    if tag == "hr":
        return ["---"] if shown else []
    if tag in ("ul", "ol", "menu", "dir"):
        return listed(node, shown)
    if tag == "table":
        return tabled(node, shown)
    if tag in ("pre", "textarea", "xmp"):
        return flow(node, shown, True)
    if tag == "details" and node.attr("open") is None:
        return flow(node, shown, pre, only="summary")
    lines = flow(node, shown, pre)
    if tag in ("blockquote", "dd"):
        return [("  " + line).rstrip() for line in lines]
    return lines


def listed(node: Node, shown: bool) -> list[str]:
    out: list[str] = []
    number = node.number("start", 1)
    for child in node.children:
        if isinstance(child, str):
            if shown and child.strip():
                _append(out, [SPACE.sub(" ", child).strip()])
            continue
        laid, visible = visibility(child, shown)
        if not laid:
            continue
        lines = _bare(block(child, visible, False) if child.tag in BLOCKS else flow(child, visible))
        if child.tag == "li":
            number = child.number("value", number)
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            lines = [(mark if i == 0 else " " * len(mark)) + line for i, line in enumerate(lines)]
        _append(out, [line.rstrip() for line in lines])
    return out


def _wrapped(lines: list[str]) -> list[str]:
    """Lines of at most WIDE characters, but for longer words."""
    out = []
    for line in lines:
        while len(line) > WIDE:
            cut = line.rfind(" ", 0, WIDE + 1)
            cut = cut if line[: max(cut, 0)].strip() else line.find(" ", WIDE)
            if cut < 0:
                break
            out.append(line[:cut].rstrip())
            line = line[cut + 1 :]
        out.append(line)
    return out


class Places:
    """The columns that a table's next row has free: those that no cell from above takes up, as intervals, and all from ``width`` on."""

    def __init__(self):
        self.free: list[tuple[int, int]] = []  # a heap of intervals below width
        self.width, self.row = 0, 0
        self.ending: dict[int, list[tuple[int, int]]] = {}  # by row, what is free again from there on
        self.used: list[tuple[int, int]] = []

    def take(self, span: int, height: int) -> int:
        """The column of a row's next cell. A height of 0 is to the end of the table."""
        start = self.free[0][0] if self.free else self.width
        end, own = start + span - 1, []
        while self.free and self.free[0][0] <= end:
            low, high = heapq.heappop(self.free)
            if high > end:
                heapq.heappush(self.free, (end + 1, high))
            own.append((low, min(high, end)))
        if end >= self.width:
            own.append((max(start, self.width), end))
            self.width = end + 1
        if height == 1:
            self.used += own
        elif height:
            self.ending.setdefault(self.row + height, []).extend(own)
        return start

    def next_row(self) -> None:
        merged: list[tuple[int, int]] = []
        for low, high in self.used:
            if merged and merged[-1][1] + 1 == low:
                merged[-1] = (merged[-1][0], high)
            else:
                merged.append((low, high))
        self.row += 1
        for interval in (*merged, *self.ending.pop(self.row, ())):
            heapq.heappush(self.free, interval)
        self.used = []


def tabled(node: Node, shown: bool) -> list[str]:
    """Captions, then rows with their cells side by side; each column as wide as its widest cell. Columns without any text, and
    the places that a cell of several rows or columns takes up, are not seen. A table that would be mostly blanks, over BLANKS
    times its text, is not aligned: its rows are their cells one after another."""
    captions: list[str] = []
    rows: list[dict[int, list[str]]] = []
    places = Places()

    def place(row: Node, seen: bool) -> dict[int, list[str]]:
        cells: dict[int, list[str]] = {}
        for cell in row.children:
            if isinstance(cell, str):
                if seen and cell.strip():
                    captions.append(SPACE.sub(" ", cell).strip())
                continue
            laid, visible = visibility(cell, seen)
            if not laid:
                continue
            height = cell.number("rowspan", 1)
            at = places.take(max(min(cell.number("colspan", 1), MOST_SPAN), 1), height if height >= 0 else 1)
            cells[at] = _bare(block(cell, visible, False) if cell.tag in BLOCKS and cell.tag not in CELL else flow(cell, visible))
        places.next_row()
        return cells

    def gather(parent: Node, seen: bool) -> None:
        for child in parent.children:
            if isinstance(child, str):
                if seen and child.strip():
                    captions.append(SPACE.sub(" ", child).strip())
                continue
            laid, visible = visibility(child, seen)
            if not laid:
                continue
            if child.tag in ("thead", "tbody", "tfoot", "colgroup"):
                gather(child, visible)
            elif child.tag == "tr":
                rows.append(place(child, visible))
            else:
                captions.extend(block(child, visible, False) if child.tag in BLOCKS else flow(child, visible))

    gather(node, shown)
    rows = [{c: lines for c, lines in row.items() if lines} for row in rows]
    columns = sorted({c for row in rows for c in row})
    if len(columns) > 1:
        rows = [{c: _wrapped(lines) for c, lines in row.items()} for row in rows]
    widths = _widths(rows)
    edges = [0, *itertools.accumulate(widths[c] + 2 for c in columns)]
    shape = [(row, max(row), max(map(len, row.values()))) for row in rows if row]
    letters = sum(len(line) + 2 for row in rows for lines in row.values() for line in lines)
    aligned = sum(height * edges[bisect.bisect_left(columns, last)] for _, last, height in shape) <= BLANKS * letters + 4096
    out = list(captions)
    for row, last, height in shape:
        if aligned:
            mine = columns[: bisect.bisect_right(columns, last)]
            for i in range(height):
                out.append("  ".join((row[c][i] if c in row and i < len(row[c]) else "").ljust(widths[c] if c != last else 0) for c in mine).rstrip())
        else:
            beside: list[list[str]] = [[] for _ in range(height)]
            for c in sorted(row):
                for i, line in enumerate(row[c]):
                    beside[i].append(line)
            out += ["  ".join(parts).rstrip() for parts in beside]
    return out


def _widths(rows: list[dict[int, list[str]]]) -> dict[int, int]:
    widths: dict[int, int] = {}
    for row in rows:
        for c, lines in row.items():
            widths[c] = max(widths.get(c, 0), *(min(len(line), WIDE) for line in lines), 0)
    return widths


def render(html: str | None) -> str:
    return "\n".join(_bare(flow(parse(html), True))) if html else ""


def extract_text(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id and ``text``, the visible text of every row's HTML laid out as plain lines.

    Null and empty HTML give an empty text; text without tags is one paragraph; damaged markup never fails, and the time for a
    page grows with its length only. Pages are read whole. Of style sheets only rules that hide a tag, a class or an id are
    followed, of scripts nothing. Repeated rows give a row each; an empty table gives an empty result; other columns of ``df``, whatever their
    names, are left out.
    """
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "html"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([render(h) for h in batch.column("html").to_pylist()], pa.string())], [id_col, "text"])

    return df.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInArrow(run, schema)
