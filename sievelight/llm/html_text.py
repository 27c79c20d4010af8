"""Operator 1: the visible text of HTML, laid out as a browser would place it.

A tree builder with implied tags (p, li, dt/dd, option, table parts end where
the next one opens) and visibility rules (head matter, scripts, ``hidden``,
``display:none``, ``visibility:hidden``) feeds a renderer that keeps block
spacing, list markers and aligned table cells, with cells that span columns or
rows in their place. Open elements are known by name and place, so a tag costs
the same at any depth, and the renderer's steps are generators on a stack of
their own: nesting has no limit.

Defined cases: a null page gives a null text, an empty one an empty text;
broken markup never raises; the title is that of the first title element
outside of drawings; repeated rows get equal results; an empty table gives an
empty result; clashing input columns are renamed to ``input_<name>``.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Generator, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame

from sievelight.llm._common import free_names, mapped, plus

#: Most columns and rows that a cell spans, as in HTML.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content is text up to the end tag.
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes title object canvas audio video datalist desc defs metadata symbol annotation annotation-xml".split())
#: Of these the text is kept, with its entities replaced or not.
TEXTS = {"textarea": True, "title": True, "xmp": False}
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr".split())
BLOCKS = PARAGRAPHS | frozenset("html body div article section nav aside header footer main address form fieldset legend details summary figcaption li dt dd tr caption thead tbody tfoot option select center dir menu hgroup search textarea".split())
#: A start tag closes an open element of these names, but not beyond the scope on the right.
_TABLE_SCOPE = frozenset(("table",))
CELLS = frozenset(("td", "th"))
CLOSES = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "td": (frozenset(("td", "th")), _TABLE_SCOPE),
    "th": (frozenset(("td", "th")), _TABLE_SCOPE),
    "tr": (frozenset(("tr", "td", "th", "caption")), _TABLE_SCOPE),
    "thead": (frozenset(("tr", "thead", "tbody", "tfoot", "caption")), _TABLE_SCOPE),
    "tbody": (frozenset(("tr", "thead", "tbody", "tfoot", "caption")), _TABLE_SCOPE),
    "tfoot": (frozenset(("tr", "thead", "tbody", "tfoot", "caption")), _TABLE_SCOPE),
}
ENDS_P = BLOCKS - {"li", "dt", "dd", "tr", "thead", "tbody", "tfoot", "caption", "option", "select", "textarea", "html", "body", "legend"}
P_SCOPE = frozenset("table td th caption button li dd dt".split())
#: An end tag reaches no further up than these, unless it is their own.
END_SCOPE = frozenset("table td th caption".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"']|[\"'](?=[^\"']*>))*)>?", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_STYLE_HIDES = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)


class Node:
    __slots__ = ("children", "hidden", "name", "start")

    def __init__(self, name: str, hidden: bool = False, start: int | tuple[int, int] = 1):
        #: ``start``: a list's first number, or the columns and rows that a cell spans.
        self.name, self.hidden, self.start, self.children = name, hidden, start, []


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def _element(name: str, attributes: str) -> Node:
    hidden, start = name in UNSEEN, 1
    if attributes and not hidden and attributes.strip("/ "):
        a = _attributes(attributes)
        hidden = "hidden" in a or bool(a.get("style") and _STYLE_HIDES.search(a["style"])) or name == "input" and a.get("type", "").lower() == "hidden"
        if name == "ol" and re.fullmatch(r"-?\d{1,9}", a.get("start", "")):
            start = int(a["start"])
        elif name in CELLS:
            start = tuple(min(int(a[k]), most) if re.fullmatch(r"\d{1,9}", a.get(k, "")) and int(a[k]) else 1 for k, most in (("colspan", MOST_COLUMNS), ("rowspan", MOST_ROWS)))
    return Node(name, hidden, start)


class Open:
    """The open elements, with the places of each name."""

    def __init__(self):
        self.nodes, self.places = [Node("#root")], defaultdict(list)

    def push(self, node: Node) -> None:
        self.places[node.name].append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        """Close all elements from ``at`` on."""
        while len(self.nodes) > at:
            self.places[self.nodes.pop().name].pop()

    def last(self, names) -> int:
        """Place of the innermost element of ``names``, 0 if there is none."""
        return max((self.places[n][-1] for n in names if self.places[n]), default=0)

    def close(self, names: frozenset[str], scope: frozenset[str]) -> None:
        """Close the outermost open element of ``names`` inside the nearest scope element."""
        limit = self.last(scope)
        found = [p[k] for n in names if (p := self.places[n]) and (k := bisect_right(p, limit)) < len(p)]
        if found:
            self.cut(min(found))


_TABLE_PARTS = frozenset("table tr tbody thead tfoot td th".split())


def build(page: str) -> tuple[Node, str | None]:
    """The tree of a page, with text as strings among the children, and the title's text."""
    stack, title = Open(), None
    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        into = stack.nodes[-1].children
        if m is None:
            into.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            into.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                into.append(m[0][9:].removesuffix("]]>"))
            continue
        name = m[2].lower()
        if m[1]:
            if name == "p" and not stack.places["p"]:
                into.append(Node("p"))
            elif name == "br":
                into.append(Node("br"))
            else:
                found = stack.last((name,))
                if found and found >= stack.last(_TABLE_SCOPE if name in _TABLE_PARTS else END_SCOPE):
                    stack.cut(found)
            continue
        if name in ENDS_P:
            stack.close(_P, P_SCOPE)
        if name in CLOSES:
            stack.close(*CLOSES[name])
        if name == "body" and stack.places["head"]:
            stack.cut(stack.places["head"][0])
        elif stack.nodes[-1].name == "head" and name not in ("meta", "link", "title", "style", "script", "base", "noscript", "template"):
            stack.cut(len(stack.nodes) - 1)  # body matter ends an open head
        node = _element(name, m[3])
        stack.nodes[-1].children.append(node)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            stop = end.start() if end else size
            if name in TEXTS:
                body = html.unescape(page[at:stop]) if TEXTS[name] else page[at:stop]
                node.children.append(body)
                if name == "title" and title is None and not stack.places["svg"]:
                    title = _SPACE.sub(" ", body).strip(" ")
            at = end.end() if end else size
        elif name not in VOID and (not m[3].endswith("/") or name in BLOCKS):  # HTML ignores the slash of <div/>
            stack.push(node)
    return stack.nodes[0], title


_P = frozenset(("p",))


class Lines:
    """Text being laid out: collapses white space and keeps at most one blank line between blocks."""

    def __init__(self):
        self.done: list[str] = []
        self.line: list[str] = []
        self.blank = False
        self.space = False

    def text(self, s: str) -> None:
        body = _SPACE.sub(" ", s)
        if body == " ":
            self.space = self.space or bool(self.line)
            return
        if not body:
            return
        if self.line and (self.space or body[0] == " "):
            self.line.append(" ")
        self.line.append(body.strip(" "))
        self.space = body[-1] == " "

    def end(self, blank: bool = False) -> None:
        if self.line:
            if self.blank and self.done:
                self.done.append("")
            self.done.append("".join(self.line))
            self.line, self.blank = [], False
        self.space = False
        self.blank = self.blank or blank

    def block(self, lines: list[str], blank: bool) -> None:
        """Place finished lines as they are."""
        self.end(blank)
        if lines:
            if self.blank and self.done:
                self.done.append("")
            self.done += lines
            self.blank = False
        self.end(blank)


Steps = Generator["Steps", object, object]


def _run(steps: Steps) -> object:
    """Run a step and those it yields; what each returns is sent to the one that yielded it."""
    stack, value = [steps], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
    return value


def _pre(node: Node, out: list[str]) -> None:
    """All text below a node as it is."""
    todo = [iter(node.children)]
    while todo:
        for x in todo[-1]:
            if isinstance(x, str):
                out.append(x)
            elif x.name == "br":
                out.append("\n")
            elif not x.hidden:
                todo.append(iter(x.children))
                break
        else:
            todo.pop()


def _rows(node: Node, rows: list[list[Node]], captions: list[Node]) -> None:
    """Rows of cells of a table, and what else stands in it; parts in parts are taken apart in order."""
    todo: list[Node | str] = list(reversed(node.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x.strip():
                captions.append(_wrap(x))
        elif x.hidden or x.name in ("colgroup", "col"):
            continue
        elif x.name in ("thead", "tbody", "tfoot"):
            todo += reversed(x.children)
        elif x.name == "tr":
            rows.append([c for c in x.children if isinstance(c, Node) and not c.hidden and c.name in CELLS])
            strays = [c for c in x.children if not (isinstance(c, Node) and c.name in CELLS) and (not isinstance(c, str) or c.strip())]
            captions += [_wrap(c) for c in strays]
        elif x.name in CELLS:
            rows.append([x])
        else:
            captions.append(x)


def _wrap(x: Node | str) -> Node:
    node = Node("div")
    node.children.append(x)
    return node


def grid(rows: list[list[tuple[int, int]]]) -> list[list[int]]:
    """The first column of each cell, given the columns and rows that each spans: the first one free from above."""
    busy: dict[int, int] = {}  # column: rows for which it is still taken
    out = []
    for row in rows:
        column, places, new = 0, [], {}
        for across, down in row:
            while busy.get(column, 0):
                column += 1
            places.append(column)
            if down > 1:
                new |= dict.fromkeys(range(column, column + across), down)
            column += across
        busy = {c: n - 1 for c, n in busy.items() if n > 1} | {c: n - 1 for c, n in new.items()}
        out.append(places)
    return out


def _table(node: Node, out: Lines, nested: bool) -> Steps:
    """Captions and strays first, then the cells in columns padded to equal width, ' | ' between.

    Columns in which no cell starts have no place of their own.
    """
    rows: list[list[Node]] = []
    captions: list[Node] = []
    _rows(node, rows, captions)
    for c in captions:
        out.block((yield _laid(c, nested)), False)
    rows = [row for row in rows if row]
    spans = [[c.start if isinstance(c.start, tuple) else (1, 1) for c in row] for row in rows]
    places = grid(spans)
    used = {c: i for i, c in enumerate(sorted({c for row in places for c in row}))}
    known = sorted(used)
    cells = []
    for row, at, of in zip(rows, places, spans, strict=True):
        line = []
        for c, column, (across, _) in zip(row, at, of, strict=True):
            line.append((used[column], max(1, bisect_right(known, column + across - 1) - used[column]), (yield _laid(c, nested)) or [""]))
        cells.append(line)
    widths = [0] * len(used)
    for across in sorted({c[1] for row in cells for c in row}):  # narrow cells first, then what wide ones still need
        for row in cells:
            for column, n, lines in row:
                if n == across:
                    short = max(map(len, lines)) - sum(widths[column : column + n]) - 3 * (n - 1)
                    widths[column + n - 1] += max(0, short)
    for row in cells:
        lines = []
        for k in range(max(len(c[2]) for c in row)):
            parts, column = [], 0
            for start, n, body in row:
                parts += [" " * w for w in widths[column:start]]
                parts.append((body[k] if k < len(body) else "").ljust(sum(widths[start : start + n]) + 3 * (n - 1)))
                column = start + n
            lines.append(" | ".join(parts).rstrip())
        out.block([x for x in lines if x.strip(" |")], False)


def _lay(node: Node, out: Lines, nested: bool) -> Steps:
    """Lay out what is in a node; a list ``nested`` in another one has no blank lines around it."""
    number = node.start
    for x in node.children:
        if isinstance(x, str):
            out.text(x)
            continue
        name = x.name
        if name == "br":
            if not out.line and out.done and not out.blank:
                out.blank = True
            out.end()
        elif x.hidden:
            continue
        elif name in ("pre", "xmp"):
            parts: list[str] = []
            _pre(x, parts)
            out.block([s.rstrip() for s in "".join(parts).strip("\n").split("\n")] if "".join(parts).strip() else [], True)
        elif name == "table":
            out.end(True)
            yield _table(x, out, nested)
            out.end(True)
        elif name == "li":
            mark = f"{number}. " if node.name == "ol" else "- "
            if node.name == "ol":
                number += 1
            body = yield _laid(x, True)
            out.block([(mark if i == 0 else " " * len(mark)) + s if s else "" for i, s in enumerate(body)], False)
        elif name == "dd":
            out.block(["    " + s if s else "" for s in (yield _laid(x, True))], False)
        elif name == "blockquote":
            out.block(["> " + s if s else ">" for s in (yield _laid(x, nested))], True)
        elif name in BLOCKS:
            inner = nested and name in ("ul", "ol", "menu", "dir", "dl")
            out.end(name in PARAGRAPHS and not inner)
            yield _lay(x, out, nested)
            out.end(name in PARAGRAPHS and not inner)
        elif name not in VOID:
            if name in CELLS:
                out.text(" ")
            yield _lay(x, out, nested)


def _laid(node: Node, nested: bool = False) -> Steps:
    out = Lines()
    yield _lay(node, out, nested)
    out.end()
    return out.done


def rendered(page: str | None) -> tuple[str | None, str | None]:
    """The laid-out visible text of one page, and its title."""
    if page is None:
        return None, None
    tree, title = build(page)
    return "\n".join(_run(_laid(tree))).replace("\x00", ""), title


def visible_text(page: str | None) -> str | None:
    return rendered(page)[0]


def page_title(page: str | None) -> str | None:
    return rendered(page)[1]


def _extract(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            pages = [rendered(p) for p in part.column(column).to_pylist()]
            own = [pa.array([p[k] for p in pages], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*part.columns, *own], names=[*part.schema.names, "extracted_text", "title"])


def extract_html(pages: DataFrame, column: str = "html") -> DataFrame:
    """All columns of ``pages`` with extracted_text and title. No shuffle."""
    pages = free_names(pages, ["extracted_text", "title"])
    return mapped(pages, partial(_extract, column=column), plus(pages, "extracted_text string, title string"))


def op1_query(pages: DataFrame) -> DataFrame:
    """The digest of query op1."""
    return extract_html(pages.select("page_id", "html")).select("page_id", "title", "extracted_text")
