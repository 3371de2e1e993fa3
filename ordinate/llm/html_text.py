"""Layout-aware rendering of HTML pages to text.

A tokenizer and a tree builder with implied tags (a paragraph ends where a block
begins, list items, table cells and options end where the next begins) make a
tree; a renderer writes all visible text of it: blocks on lines of their own,
paragraphs apart by an empty line, list items with bullets or numbers and
indented, table cells aligned in columns, preformatted text as it is.

Invisible are comments, head, script, style, template, noscript, media
fallbacks, titles and descriptions inside drawings, annotations of formulas,
elements with ``hidden`` or a style of ``display:none``, text whose nearest
``visibility`` is hidden, closed dialogs, and all but the summary of closed
details. Null and empty pages give the empty text. Repeated rows give repeated
results; other columns are left out. Elements deeper than ``MAX_DEPTH`` become
siblings at that depth, and their text stays.

Cells wider than ``WIDE`` don't widen their column, and columns in which no cell
begins take no room. A table whose alignment would still take more than ``ROOM``
times its text (very long or very ragged ones) is written with its cells one
after another, unaligned: no text is lost, and the text of a page of any size
stays in proportion to the page.
"""

from __future__ import annotations

import bisect
import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_batch, sliced

MAX_DEPTH, MAX_SPAN = 200, 1000
#: Widest cell that a column is aligned to; most room of an aligned table, by its text; most cells that reach down at a time.
WIDE, ROOM, HELD = 60, 6, 1000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes title textarea".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas datalist title desc metadata defs annotation annotation-xml area base link meta param source track col colgroup".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure hr fieldset".split())
BLOCKS = PARAGRAPHS | frozenset("address article aside body center dd details dialog div dt figcaption footer form header hgroup html legend li main menu nav option optgroup section summary tr tbody thead tfoot caption".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt summary".split())
#: An element's start ends these, unless one of the second set is nearer.
_CELL, _ROW, _GROUP = frozenset(("td", "th")), frozenset(("tr",)), frozenset(("tbody", "thead", "tfoot"))
_TABLE = frozenset(("table", "template"))
_LISTS = frozenset(("ul", "ol", "menu", "table", "template"))
IMPLIED = {"li": (frozenset(("li",)), _LISTS), "dt": (frozenset(("dt", "dd")), frozenset(("dl", "table"))), "dd": (frozenset(("dt", "dd")), frozenset(("dl", "table"))), "option": (frozenset(("option",)), frozenset(("select", "optgroup", "datalist"))), "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))), "td": (_CELL | {"caption"}, _TABLE | _ROW), "th": (_CELL | {"caption"}, _TABLE | _ROW), "tr": (_CELL | _ROW | {"caption"}, _TABLE | _GROUP), "tbody": (_CELL | _ROW | _GROUP | {"caption"}, _TABLE), "thead": (_CELL | _ROW | _GROUP | {"caption"}, _TABLE), "tfoot": (_CELL | _ROW | _GROUP | {"caption"}, _TABLE), "body": (frozenset(("head",)), frozenset(("body",)))}

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*?)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_GONE = re.compile(r"(?<![\w-])display\s*:\s*none", re.I)
_SHOWN = re.compile(r"(?<![\w-])visibility\s*:\s*(visible|hidden|collapse)", re.I)


class Node:
    """``shown``: whether text directly inside is visible, as far as
    ``visibility`` says, which children inherit unless they have their own."""

    __slots__ = ("tag", "attrs", "children", "shown")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, shown: bool = True):
        self.tag, self.attrs, self.children, self.shown = tag, attrs or {}, [], shown
        if own := _SHOWN.findall(self.attrs.get("style", "")):
            self.shown = own[-1].lower() == "visible"


def tokens(page: str):
    """("text", text), ("start", tag, attributes, self-closing) and ("end", tag)."""
    at = 0
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            yield "text", html.unescape(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            yield "end", tag
            continue
        attrs = {a[1].lower(): html.unescape(a[2] or a[3] or a[4] or "") for a in _ATTRIBUTE.finditer(m[3])} if m[3] else {}
        yield "start", tag, attrs
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            inner = page[at : end.start()] if end else page[at:]
            if inner:
                yield "text", html.unescape(inner) if tag in ("title", "textarea") else inner
            yield "end", tag
            at = end.end() if end else len(page)
    if at < len(page):
        yield "text", html.unescape(page[at:])


def parse(page: str) -> Node:
    """The page's tree, under a node named ``html``."""
    root = Node("html")
    stack = [root]

    def close(tags: frozenset, until: frozenset) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in until:
                return
            if stack[i].tag in tags:
                del stack[i:]
                if not any(n.tag in tags for n in stack[1:]):
                    return
                return close(tags, until)

    for token in tokens(page):
        if token[0] == "text":
            if stack[-1].shown:
                stack[-1].children.append(token[1])
        elif token[0] == "start":
            tag, attrs = token[1], token[2]
            if tag == "html":
                root.attrs = attrs | root.attrs
                root.shown = Node("html", root.attrs).shown
                continue
            if tag in CLOSES_P:
                close(frozenset(("p",)), frozenset(("table", "td", "th", "caption", "button", "object")))
            if stack[-1].tag == "head" and (tag in BLOCKS or tag in ("a", "span", "b", "i", "img", "br")):
                stack.pop()
            if tag in IMPLIED:
                close(*IMPLIED[tag])
            if tag in _CELL and stack[-1].tag in ("table", *_GROUP):
                row = Node("tr", shown=stack[-1].shown)
                stack[-1].children.append(row)
                stack.append(row)
            node = Node(tag, attrs, stack[-1].shown)
            stack[-1].children.append(node)
            if tag not in VOID and len(stack) < MAX_DEPTH:
                stack.append(node)
        else:
            tag = token[1]
            if tag == "br":
                stack[-1].children.append(Node("br"))
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag == "p" and stack[i].tag in ("td", "th", "table", "caption", "button", "object"):
                    stack[-1].children.append(Node("p"))
                    break
                if tag not in _TABLE and stack[i].tag in ("td", "th", "table") and tag not in (*_CELL, *_ROW, *_GROUP):
                    break
            else:
                if tag == "p":  # an end without a start is an empty paragraph
                    stack[-1].children.append(Node("p"))
    return root


def visible(node: Node) -> bool:
    if node.tag in HIDDEN or "hidden" in node.attrs or (node.tag == "dialog" and "open" not in node.attrs):
        return False
    return not ("style" in node.attrs and _GONE.search(node.attrs["style"]))


def width(text: str) -> int:
    """Columns that a text takes: wide letters two, combining marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Lines:
    """Finished lines, the open line, and empty lines that are due."""

    def __init__(self):
        self.lines: list[str] = []
        self.open: list[str] = []
        self.gap = 0

    def end_line(self) -> None:
        text = "".join(self.open).strip(" ")
        self.open = []
        if text:
            self.put([text])

    def put(self, lines: list[str]) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = 0
        self.lines += lines

    def words(self, text: str) -> None:
        text = _SPACES.sub(" ", text)
        if text == " " and (not self.open or self.open[-1].endswith(" ")):
            return
        if self.open and self.open[-1].endswith(" "):
            text = text.lstrip(" ")
        if text:
            self.open.append(text)


def _number(text: str | None, default: int) -> int:
    m = re.match(r"\s*(-?\d{1,9})", text or "")
    return int(m[1]) if m else default


def _table(node: Node) -> list[str]:
    above: list[str] = []
    groups: dict[str, list[Node]] = {"thead": [], "tbody": [], "tfoot": []}

    def gather(at: Node, group: str) -> None:
        for child in at.children:
            if isinstance(child, str):
                if child.strip():
                    above.append(_SPACES.sub(" ", child).strip())
            elif visible(child):
                if child.tag in _GROUP:
                    gather(child, child.tag)
                elif child.tag == "tr":
                    groups[group].append(child)
                else:
                    above.extend(render(child))

    gather(node, "tbody")
    # lines of cells, by the column that the cell begins in; held: where cells of earlier rows reach down to, as end and rows left
    rows: list[tuple[dict[int, str], int]] = []
    held: dict[int, tuple[int, int]] = {}
    for row in groups["thead"] + groups["tbody"] + groups["tfoot"]:
        cells: dict[int, list[str]] = {}
        below: dict[int, tuple[int, int]] = {}
        loose: list = []
        at = 0
        for child in row.children:
            if isinstance(child, Node) and child.tag in _CELL:
                if not visible(child):
                    continue
                while at in held:
                    at = held[at][0]
                span = max(1, min(MAX_SPAN, _number(child.attrs.get("colspan"), 1)))
                down = max(1, min(65_534, _number(child.attrs.get("rowspan"), 1)))
                if down > 1 and len(held) + len(below) < HELD:
                    below[at] = (at + span, down)
                cells[at] = render(child) or [""]
                at += span
            elif not isinstance(child, str) or child.strip():
                loose.append(child)
        while at in held:
            at = held[at][0]
        held = {start: (end, left - 1) for start, (end, left) in (held | below).items() if left > 1}
        if loose:
            stray = Node("div")
            stray.children = loose
            above.extend(render(stray))
        for i in range(max((len(c) for c in cells.values()), default=0)):
            rows.append(({start: c[i] for start, c in cells.items() if i < len(c)}, at))
    return above + _aligned(rows)


def _aligned(rows: list[tuple[dict[int, str], int]]) -> list[str]:
    """Rows (cells by column, and where the row ends) under one another, if that
    takes no more than ``ROOM`` times their text."""
    wide: dict[int, int] = {}
    for row, _ in rows:
        for at, cell in row.items():
            own = width(cell)
            wide[at] = max(wide.get(at, 0), own if own <= WIDE else 0)
    order, total = sorted(wide), 0
    upto = {}
    for at in order:
        total += wide[at] + 3
        upto[at] = total
    lasts = [bisect.bisect_left(order, end) for _, end in rows]
    text = sum(len(cell) + 3 for row, _ in rows for cell in row.values())
    if sum(upto[order[n - 1]] for n in lasts if n) > ROOM * text + 1000:
        return [" | ".join(cell for _, cell in sorted(row.items()) if cell) for row, _ in rows]
    out = []
    for (row, _), n in zip(rows, lasts):
        cells = ((row.get(at, ""), wide[at]) for at in order[:n])
        out.append(" | ".join(cell + " " * (most - width(cell)) for cell, most in cells).rstrip())
    return out


def render(node: Node) -> list[str]:
    """The visible text of ``node``, as lines."""
    out = Lines()
    _fill(node, out, False)
    out.end_line()
    return out.lines


def _fill(node: Node, out: Lines, pre: bool) -> None:
    number = _number(node.attrs.get("start"), 1)
    closed = node.tag == "details" and "open" not in node.attrs
    for child in node.children:
        if isinstance(child, str):
            if closed:
                continue
            if not pre:
                out.words(child)
                continue
            first, *rest = child.replace("\r\n", "\n").split("\n")
            out.open.append(first)
            for line in rest:
                out.put(["".join(out.open).rstrip()])
                out.open = [line]
            continue
        tag = child.tag
        if not visible(child) or (closed and tag != "summary"):
            continue
        if tag == "br":
            if out.open and "".join(out.open).strip():
                out.end_line()
            elif out.lines:
                out.open = []
                out.gap = 1
        elif tag not in BLOCKS:
            _fill(child, out, pre or tag in ("textarea", "xmp"))
        else:
            out.end_line()
            apart = tag in PARAGRAPHS and not (tag in ("ul", "ol") and node.tag == "li")
            if apart:
                out.gap = 1
            if tag == "hr":
                out.put(["---"])
            elif tag == "table":
                if lines := _table(child):
                    out.put(lines)
            elif tag == "pre":
                inner = Lines()
                _fill(child, inner, True)
                lines = inner.lines + (["".join(inner.open).rstrip()] if inner.open else [])
                while lines and not lines[0]:
                    lines.pop(0)
                while lines and not lines[-1]:
                    lines.pop()
                if lines:
                    out.put(lines)
            elif tag == "li":
                mark = "- "
                if node.tag == "ol":
                    number = _number(child.attrs.get("value"), number)
                    mark, number = f"{number}. ", number + 1
                if lines := render(child):
                    out.put([mark + lines[0], *(" " * len(mark) + x if x else "" for x in lines[1:])])
            elif tag in ("dd", "blockquote"):
                if lines := render(child):
                    out.put([f"  {x}" if x else "" for x in lines])
            else:
                _fill(child, out, pre)
                out.end_line()
            if apart:
                out.gap = 1


def to_text(page: str | None) -> str:
    root = parse(page) if page else None
    return "\n".join(render(root)) if root and visible(root) else ""


_OUT = pa.schema([("page_id", pa.int64()), ("text", pa.string())])


def _extract(batches):
    for batch in sliced(batches, 128):
        yield as_batch(_OUT, batch.column(0), [to_text(p).encode("utf-8", "replace").decode() for p in batch.column(1).to_pylist()])


def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text of every page."""
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).mapInArrow(_extract, "page_id long, text string")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
