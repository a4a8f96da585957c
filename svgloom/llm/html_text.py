"""Visible text of HTML pages, laid out.

A tokenizer and a tree builder with implied tags (a paragraph ends where a block begins,
list items, table parts, options and definition terms end their like, rows and cells
are made where they are missing, stray end tags are ignored) give a tree; what is not
displayed (the fallback of audio, video and canvas; title, desc, defs and metadata of svg and annotations of MathML; head, scripts, styles, templates, ``hidden``, ``display:none``,
``visibility:hidden`` with visible parts inside) is left out; all other text is rendered: white space
collapses except in preformatted text, blocks stand on lines of their own, paragraphs and
the like between blank lines, list items behind bullets or numbers with their lines
indented, table cells padded to the width of their column and set off by `` | ``.
Nothing is taken for boilerplate.

Building and rendering use explicit stacks, so nesting has no limit, and take time in
proportion to the page. Null HTML gives null text; an empty page or one without visible text
an empty string. Repeated and null ids keep their rows; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svgloom.session import ship

from .common import table

# Element names as HTML defines them.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_UNSEEN = frozenset("head script style template title meta link base noscript iframe noembed noframes datalist audio video canvas".split())
# seen nowhere inside of svg and math; elsewhere they are unknown elements
_UNSEEN_FOREIGN = frozenset("desc defs metadata symbol clippath mask marker pattern annotation annotation-xml".split())
# set apart from their like by place only
_APART = frozenset("text mtd".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead tr ul xmp".split())
_SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul xmp".split())
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul xmp".split())
_PHRASES = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_HEAD_PARTS = frozenset("base link meta noscript script style template title".split())
_SCOPE = frozenset("table td th caption html template button".split())
_ROWS = frozenset("tbody thead tfoot".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_HIDES = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag, self.attrs, self.children = tag, attrs, []

    def get(self, name: str) -> str | None:
        for m in _ATTRIBUTE.finditer(self.attrs):
            if m[1].lower() == name:
                return unescape((m[2] or "").strip("\"'"))
        return None


def parse(html: str) -> Node:
    """The tree of a page; text is in it as strings."""
    root = Node("html")
    stack, counts = [root], {"html": 1}

    def push(node: Node) -> None:
        stack[-1].children.append(node)
        stack.append(node)
        counts[node.tag] = counts.get(node.tag, 0) + 1

    def pop_to(k: int) -> None:
        while len(stack) > max(k, 1):
            counts[stack.pop().tag] -= 1

    def close(names: frozenset | set, stops: frozenset) -> None:
        """Close the innermost open element of these names, unless one of the stops is nearer."""
        if not any(counts.get(n) for n in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                pop_to(k)
                return
            if stack[k].tag in stops:
                return

    def start(tag: str, attrs: str) -> None:
        if tag == "html":
            return
        if tag == "body":
            close({"head"}, frozenset())
            if counts.get("body"):
                return
        elif tag == "head":
            if counts.get("head") or counts.get("body"):
                return
        elif counts.get("head") and tag not in _HEAD_PARTS:
            close({"head"}, _SCOPE)
        if tag in _ENDS_P and counts.get("p"):
            close({"p"}, _SCOPE)
        if tag == "li":
            close({"li"}, frozenset(("ul", "ol", "menu", *_SCOPE)))
        elif tag in ("dt", "dd"):
            close({"dt", "dd"}, frozenset(("dl", *_SCOPE)))
        elif tag == "option":
            close({"option"}, frozenset(("select", "optgroup")))
        elif tag == "optgroup":
            close({"optgroup"}, frozenset(("select",)))
        elif tag in _HEADINGS and stack[-1].tag in _HEADINGS:
            pop_to(len(stack) - 1)
        elif tag in _ROWS or tag == "caption":
            if not counts.get("table"):
                return
            close({*_ROWS, "caption"}, frozenset(("table",)))
            while stack[-1].tag not in ("table", "html"):
                pop_to(len(stack) - 1)
        elif tag == "tr":
            if not counts.get("table"):
                return
            close({"tr", "caption"}, frozenset(("table",)))
        elif tag in ("td", "th"):
            if not counts.get("table"):
                return
            close({"td", "th"}, frozenset(("tr", "table")))
            if stack[-1].tag in ("table", *_ROWS):
                push(Node("tr"))
        if counts.get("svg") or counts.get("math"):
            if tag in _UNSEEN_FOREIGN:
                attrs = "hidden" + "/" * attrs.endswith("/")
            elif tag in _APART:
                stack[-1].children.append(" ")
            if attrs.endswith("/"):
                stack[-1].children.append(Node(tag, attrs))
                return
        if tag in _VOID:
            stack[-1].children.append(Node(tag, attrs))
        else:
            push(Node(tag, attrs))

    def end(tag: str) -> None:
        if tag == "br":
            stack[-1].children.append(Node("br"))
        elif tag == "p" and not counts.get("p"):
            stack[-1].children.append(Node("p"))
        elif tag in _HEADINGS:
            close(_HEADINGS, _SCOPE)
        elif tag in ("table", *_ROWS, "tr", "td", "th", "caption"):
            close({tag}, frozenset() if tag == "table" else frozenset(("table",)))
        elif tag not in ("html", "body"):
            # the end of a phrase does not end a block that began inside it
            close({tag}, _BLOCK if tag in _PHRASES else frozenset(("table", "td", "th", "caption")) - {tag})

    at, n = 0, len(html)
    while at < n:
        k = html.find("<", at)
        if k < 0:
            k = n
        if k > at:
            text = html[at:k]
            if counts.get("head") and not text.isspace() and stack[-1].tag == "head":
                close({"head"}, frozenset())
            stack[-1].children.append(unescape(text) if "&" in text else text)
            at = k
            continue
        if html.startswith("<!--", k):
            stop = html.find("-->", k + 4)
            at = n if stop < 0 else stop + 3
        elif html[k + 1 : k + 2] in ("!", "?"):
            stop = html.find(">", k)
            at = n if stop < 0 else stop + 1
        elif m := _TAG.match(html, k) or _LOOSE.match(html, k):
            at, tag = m.end(), m[2].lower()
            if m[1]:
                end(tag)
                continue
            start(tag, m[3])
            if tag in _RAW and stack[-1].tag == tag:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                text = html[at : stop.start() if stop else n]
                stack[-1].children.append(unescape(text) if tag in ("textarea", "title") else text)
                pop_to(len(stack) - 1)
                at = n if not stop else (html.find(">", stop.end()) + 1 or n)
        elif html.startswith("</", k):
            stop = html.find(">", k)
            at = n if stop < 0 else stop + 1
        else:
            stack[-1].children.append("<")
            at = k + 1
    return root


class Flow:
    """Lines of text that are being laid out."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = False

    def text(self, s: str, pre: bool) -> None:
        if not pre:
            self.inline.append(s)
            return
        first, *rest = s.split("\n")
        self.inline.append(_keep(first))
        for x in rest:
            self.end_line(empty=True)
            self.inline.append(_keep(x))

    def end_line(self, gap: bool = False, empty: bool = False) -> None:
        if self.inline:
            line = _SPACES.sub(" ", "".join(self.inline)).strip(" ").replace("\x00", " ").replace("\xa0", " ").rstrip()
            self.inline.clear()
            if line or empty:
                self.block([line], False)
        elif empty:
            self.block([""], False)
        self.gap |= gap

    def block(self, lines: list[str], gap: bool) -> None:
        if lines:
            if (self.gap or gap) and self.lines and self.lines[-1]:
                self.lines.append("")
            self.lines += lines
            self.gap = False
        self.gap |= gap


def _keep(s: str) -> str:
    """Preformatted text: its spaces survive the collapse."""
    return s.replace("\t", "    ").replace("\r", "").replace(" ", "\x00")


def _trimmed(lines: list[str]) -> list[str]:
    a, b = 0, len(lines)
    while a < b and not lines[a]:
        a += 1
    while b > a and not lines[b - 1]:
        b -= 1
    return lines[a:b]


def _number(value: str | None, other: int) -> int:
    try:
        return max(-(10**9), min(10**9, int(value or "")))
    except ValueError:
        return other


def _rows_covered(value: str | None) -> int:
    """Of a cell; zero is all to the end of the group."""
    rows = _number(value, 1)
    return 65534 if rows == 0 else max(1, min(65534, rows))


def _grid(rows: list[list[tuple[list[str], int, int]]], groups: set[int]) -> list[str]:
    """Cells (lines, columns and rows covered) padded to the width of their columns; cells from above cover rows of their group only."""
    placed: list[list[tuple[int, list[str], int]]] = []
    widths: dict[int, int] = {}
    busy: dict[int, int] = {}
    for k, row in enumerate(rows):
        if k in groups:
            busy.clear()
        cells, at = [], 0
        for lines, span, down in row:
            first = at
            while busy.get(at, 0) > k:
                at += 1
            if at > first:
                cells.append((first, [], at - first))
            if span == 1:
                widths[at] = max(widths.get(at, 0), max(map(len, lines), default=0))
            cells.append((at, lines, span))
            if down > 1:
                busy.update(dict.fromkeys(range(at, at + span), k + down))
            at += span
        if any(x for x, _, _ in row):
            placed.append(cells)
    out = []
    for row in placed:
        cells = [(lines, sum(widths.get(at + k, 0) for k in range(span)) + 3 * (span - 1)) for at, lines, span in row]
        for k in range(max((len(x) for x, _ in cells), default=0)):
            out.append(" | ".join((x[k] if k < len(x) else "").ljust(w) for x, w in cells).rstrip())
    return out


def _seen(node: Node, visible: bool) -> tuple[bool, bool]:
    """Whether a node is displayed at all, and whether its own text is visible."""
    if node.tag in _UNSEEN:
        return False, False
    attrs = node.attrs
    if attrs:
        low = attrs.lower()
        if "hidden" in low and node.get("hidden") is not None:
            return False, False
        if node.tag == "input" and (node.get("type") or "").lower() == "hidden":
            return False, False
        if "style" in low and (style := node.get("style")):
            if _HIDES.search(style):
                return False, False
            if m := _VISIBILITY.search(style):
                visible = m[1].lower() == "visible"
    return True, visible


def render(root: Node) -> str:
    """The visible text of a tree."""
    top = Flow()
    # node, its next child, the flow of its content, visible, preformatted, and what its parent keeps for it
    stack: list[list] = [[root, 0, top, True, False, None]]
    while stack:
        frame = stack[-1]
        node, k, flow, visible, pre, own = frame
        if k < len(node.children):
            frame[1] += 1
            child = node.children[k]
            if isinstance(child, str):
                if visible and not (own is not None and node.tag in ("table", "tr", *_ROWS) and child.isspace()):
                    flow.text(child, pre)
                continue
            shown, sees = _seen(child, visible)
            if not shown:
                continue
            tag = child.tag
            if tag == "br":
                flow.end_line(empty=True)
            elif tag == "hr":
                flow.end_line()
                flow.block(["---"] if sees else [], True)
            elif tag == "input":
                kind = (child.get("type") or "text").lower()
                if sees and kind in ("text", "button", "submit", "reset", "search", "email", "url", "tel", "number") and (value := child.get("value")):
                    flow.inline.append(f" {value} ")
            elif tag in ("li", "td", "th", "table", "blockquote", "dd"):
                flow.end_line()
                keeps: object = None
                if tag == "table":
                    keeps = {"rows": [], "captions": [], "groups": set()}
                elif tag == "li":
                    counter = own if node.tag in ("ol", "ul", "menu") and isinstance(own, dict) else {"n": None}
                    if counter["n"] is not None:
                        counter["n"] = _number(child.get("value"), counter["n"])
                    keeps = f"{counter['n']}. " if counter["n"] is not None else "- "
                    if counter["n"] is not None:
                        counter["n"] += 1
                elif tag in ("td", "th"):
                    keeps = own
                stack.append([child, 0, Flow(), sees, pre, keeps])
            elif tag == "caption":
                flow.end_line()
                stack.append([child, 0, Flow(), sees, pre, own])
            else:
                if tag in _BLOCK:
                    flow.end_line(gap=tag in _SPACED)
                keeps = own if tag in ("tr", *_ROWS) else None
                if tag in _ROWS and isinstance(own, dict) and "rows" in own:
                    own["groups"].add(len(own["rows"]))
                if tag == "tr" and isinstance(own, dict) and "rows" in own:
                    own["rows"].append([])
                elif tag in ("ol", "ul", "menu"):
                    keeps = {"n": _number(child.get("start"), 1) if tag == "ol" else None}
                stack.append([child, 0, flow, sees, pre or tag in ("pre", "xmp", "textarea"), keeps])
            continue
        stack.pop()
        if not stack:
            break
        outer, tag = stack[-1][2], node.tag
        if flow is outer:
            if tag in _ROWS and isinstance(own, dict) and "rows" in own:
                own["groups"].add(len(own["rows"]))
            if tag in _BLOCK:
                flow.end_line(gap=tag in _SPACED)
            continue
        flow.end_line()
        lines = _trimmed(flow.lines)
        if tag == "li":
            if lines:
                mark = own
                outer.block([mark + lines[0], *[" " * len(mark) + x if x else "" for x in lines[1:]]], False)
        elif tag in ("blockquote", "dd"):
            if tag == "blockquote":
                outer.gap = True
            outer.block(["    " + x if x else "" for x in lines], tag == "blockquote")
        elif tag in ("td", "th"):
            if isinstance(own, dict) and "rows" in own and own["rows"]:
                own["rows"][-1].append((lines, max(1, min(1000, _number(node.get("colspan"), 1))), _rows_covered(node.get("rowspan"))))
            else:
                outer.block(lines, False)
        elif tag == "caption":
            if isinstance(own, dict) and "rows" in own:
                own["captions"] += lines
            else:
                outer.block(lines, False)
        else:  # a table; what stood in it outside of cells goes before it
            outer.gap = True
            outer.block(lines, False)
            outer.block(own["captions"], False)
            outer.block(_grid(own["rows"], own["groups"]), False)
            outer.gap = True
    top.end_line()
    return "\n".join(_trimmed(top.lines))


def visible_text(html: str) -> str:
    return render(parse(html))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id and text of every page."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if x is None else visible_text(x) for x in part.column(1).to_pylist()], pa.string())], names=["page_id", "text"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, text string")


def op8_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
