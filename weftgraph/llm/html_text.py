"""HTML extraction by layout: a tree builder with implied tags, visibility rules, and a text renderer.

The builder reads tags, comments and character data in one linear scan, closes elements whose end
is implied (a paragraph at the next block, an item at the next item, a row or cell at the next) and
ignores end tags that match nothing in scope. The renderer walks the tree without recursion and
emits all visible text: blocks on lines of their own, paragraphs, headings, lists and tables set
off by a blank line, list items with their marker and indent, preformatted text unchanged, and
table cells padded so that columns stand under each other. Cells wider than ``ALIGN`` characters do
not widen their column, so a table's text stays in proportion to its content.

Not visible: ``head``, scripts, styles, templates, ``noscript`` (scripting is on), embedded media
and frames, ``hidden`` or ``display:none`` elements, ``visibility:hidden`` text (unless a
descendant is visible again), closed dialogs, and all of a closed ``details`` but its summary.

A cell that spans rows keeps its columns free in the rows below.

Scale: row by row in Arrow batches, no shuffle; memory is that of one page's tree. The builder takes
time in proportion to the page, however deep its elements are nested.

Defined cases: a null or empty page gives an empty text; text without any tag is one paragraph;
unclosed or stray tags never fail; repeated rows are each returned; a null id is carried; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of more characters do not widen their column; deeper lists and quotes are not indented further; pages of a batch sent on.
ALIGN, MOST_INDENT, PAGES = 60, 80, 64
#: Element groups of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE = frozenset("textarea title".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas svg datalist title map area base link meta param source track".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol option optgroup p plaintext pre search section summary table caption tbody td tfoot th thead tr ul xmp".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir table pre blockquote figure listing".split())
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption option optgroup legend".split())
#: A start tag ends these open elements, down to a boundary.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select", "datalist"}),
    "tr": ({"tr", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "body": ({"head"}, {"body"}),
}
CELL = frozenset(("td", "th", "caption"))
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACE = re.compile(r"[ \t\n\r\f]+")
HIDE = re.compile(r"display\s*:\s*none", re.I)
FADE = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.attributes, self.children = tag, attributes, []

    def values(self) -> dict[str, str]:
        if not self.attributes:
            return {}
        found: dict[str, str] = {}
        for name, a, b, c in ATTRIBUTE.findall(self.attributes):
            found.setdefault(name.lower(), unescape(a or b or c))
        return found


class Builder:
    """The open elements, and for each tag where in them it stands, so that no step looks through all of them."""

    def __init__(self) -> None:
        self.root = Node("html")
        self.open = [self.root]
        self.at: dict[str, list[int]] = {"html": [0]}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def pop(self) -> None:
        self.at[self.open.pop().tag].pop()

    def innermost(self, tags) -> int:
        return max((self.at[tag][-1] for tag in tags if self.at.get(tag)), default=0)

    def text(self, data: str) -> None:
        if data:
            if self.open[-1].tag == "head" and not data.isspace():
                self.pop()
            self.open[-1].children.append(data)

    def close(self, tags, stop) -> None:
        """End the innermost open element among ``tags`` and all within it, if none of ``stop`` stands between."""
        at = self.innermost(tags)
        if at and at >= self.innermost(stop):
            while len(self.open) > at:
                self.pop()

    def start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body") and any(n.tag == tag for n in self.open[:3]):
            return
        if self.open[-1].tag == "head" and tag not in UNSEEN and tag not in ("script", "style"):
            self.pop()
        if tag in CLOSES_P:
            self.close({"p"}, CELL | {"table", "button"})
        if tag in IMPLIED:
            tags, stop = IMPLIED[tag]
            if tag in ("tr", "thead", "tbody", "tfoot"):
                self.close(CELL, {"tr", "table"} if tag == "tr" else {"table"})
                if tag != "tr":
                    self.close({"tr"}, {"table"})
            self.close(tags, stop)
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and self.open[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.pop()
        node = Node(tag, attributes)
        self.open[-1].children.append(node)
        if tag not in VOID and not attributes.endswith("/") or tag in BLOCK and tag != "hr":
            self.push(node)

    def end(self, tag: str) -> None:
        if tag in ("html", "body", "br"):
            if tag == "br":
                self.open[-1].children.append(Node("br"))
            return
        if tag == "p" and not self.at.get("p"):
            self.open[-1].children.append(Node("p"))
            return
        stop = {"table"} if tag in CELL or tag in ("tr", "tbody", "thead", "tfoot") else set() if tag == "table" else CELL | {"table"}
        self.close({tag}, stop - {tag})


def parse(html: str) -> Node:
    builder, at, n = Builder(), 0, len(html)
    find = TOKEN.search
    while at < n:
        met = find(html, at)
        if met is None:
            builder.text(unescape(html[at:]))
            break
        if met.start() > at:
            builder.text(unescape(html[at : met.start()]))
        at = met.end()
        if met[2] is None:
            continue
        tag = met[2].lower()
        if met[1]:
            builder.end(tag)
            continue
        builder.start(tag, met[3])
        if tag in RAW or tag in ESCAPABLE:
            stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(html, at)
            data = html[at : stop.start() if stop else n]
            builder.text(unescape(data) if tag in ESCAPABLE else data)
            at = stop.start() if stop else n
            builder.close({tag}, set())
    return builder.root


class Lines:
    """A block of text as it grows. ``gap`` counts the line ends owed before the next text."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.line: list[str] = []
        self.gap, self.blank, self.indent, self.marker = 0, False, 0, ""

    def break_line(self, gap: int) -> None:
        if self.line:
            self.done.append("".join(self.line).rstrip())
            self.line = []
        self.gap = max(self.gap, gap)

    def add(self, text: str) -> None:
        if not self.line:
            if self.gap > 1 and self.done and self.done[-1]:
                self.done.append("")
            self.gap = 0
            text = text.lstrip(" ")
            if not text:
                return
            pad = " " * min(self.indent, MOST_INDENT)
            if self.marker:
                pad, self.marker = pad[: -len(self.marker)] + self.marker if len(pad) >= len(self.marker) else self.marker, ""
            self.line.append(pad)
        elif self.blank:
            text = text.lstrip(" ")
        if text:
            self.line.append(text)
            self.blank = text[-1] == " "

    def flow(self, text: str) -> None:
        text = SPACE.sub(" ", text)
        if text == " " and not self.line:
            return
        self.add(text)

    def exact(self, text: str) -> None:
        for k, part in enumerate(text.expandtabs(8).split("\n")):
            if k:
                if not self.line:
                    self.done.append("")
                self.break_line(1)
                self.gap = 0
            if part:
                if not self.line:
                    if self.gap > 1 and self.done and self.done[-1]:
                        self.done.append("")
                    self.gap = 0
                    self.line.append(" " * min(self.indent, MOST_INDENT))
                self.line.append(part)
                self.blank = False

    def finished(self) -> list[str]:
        self.break_line(0)
        while self.done and not self.done[-1]:
            self.done.pop()
        while self.done and not self.done[0]:
            self.done.pop(0)
        return self.done


def placed(rows: list[list[tuple[int, int, list[str]]]]) -> list[list[tuple[int, int, list[str]]]]:
    """Rows of (first column, columns spanned, lines) from rows of (columns, rows spanned, lines): a cell
    takes the next columns that no cell of an earlier row reaches down into."""
    out, down = [], []  # down: first column, column after the last, row after the last
    for r, row in enumerate(rows):
        down = sorted(x for x in down if x[2] > r)
        at, k, mine, more = 0, 0, [], []
        for across, below, lines in row:
            while k < len(down) and down[k][0] <= at:
                at = max(at, down[k][1])
                k += 1
            mine.append((at, across, lines))
            if below > 1:
                more.append((at, at + across, r + below))
            at += across
        down += more
        out.append(mine)
    return out


def laid_out(rows: list[list[tuple[int, int, list[str]]]]) -> list[str]:
    """Rows of (columns spanned, rows spanned, lines) with the columns under each other."""
    grid = placed(rows)
    width: dict[int, int] = {}
    for row in grid:
        for at, across, lines in row:
            w = max(map(len, lines), default=0)
            if across == 1 and w <= ALIGN:
                width[at] = max(width.get(at, 0), w)
    columns = sorted(width)
    starts = [0, *accumulate(width[c] + 2 for c in columns)]
    out = []
    for row in grid:
        for k in range(max((len(lines) for *_, lines in row), default=0)):
            line, n = [], 0
            for at, _, lines in row:
                if k < len(lines) and lines[k]:
                    pad = max(starts[bisect_left(columns, at)] - n, 2 if n else 0)
                    line.append(" " * pad + lines[k])
                    n += pad + len(lines[k])
            out.append("".join(line).rstrip())
    return out


class Renderer:
    def __init__(self) -> None:
        self.lines = Lines()
        self.outer: list[Lines] = []
        self.lists: list[list] = []
        self.tables: list[list] = []
        self.exact = 0

    def number(self, text: str, other: int) -> int:
        return int(text) if re.fullmatch(r"[+-]?\d{1,9}", text.strip()) else other

    def enter(self, node: Node, values: dict[str, str]) -> None:
        tag, lines = node.tag, self.lines
        if tag in BLOCK:
            lines.break_line(2 if tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and self.lists) else 1)
        if tag == "br":
            lines.break_line(0)
            if lines.gap:
                lines.gap = 2
            else:
                lines.gap = 1
        elif tag in ("ul", "ol", "menu", "dir"):
            self.lists.append([tag, self.number(values.get("start", ""), 1), lines.indent])
        elif tag == "li":
            kind, count, indent = self.lists[-1] if self.lists else ("ul", 1, lines.indent)
            if kind == "ol":
                count = self.number(values.get("value", ""), count)
                self.lists[-1][1] = count + 1
            marker = f"{count}. " if kind == "ol" else "- "
            lines.indent, lines.marker = indent + len(marker), marker
        elif tag in ("blockquote", "dd"):
            lines.indent += 2
        elif tag in ("pre", "listing", "xmp", "textarea"):
            self.exact += 1
        elif tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in CELL and self.tables:
            if tag == "caption" or not self.tables[-1]:
                self.tables[-1].append([])
            self.outer.append(lines)
            self.lines = Lines()

    def leave(self, node: Node, values: dict[str, str]) -> None:
        tag = node.tag
        if tag in CELL and self.tables and self.outer:
            done, self.lines = self.lines.finished(), self.outer.pop()
            across = max(1, min(1000, self.number(values.get("colspan", ""), 1)))
            below = self.number(values.get("rowspan", ""), 1)  # 0: to the table's end
            self.tables[-1][-1].append((across, max(1, min(65534, below or 65534)), done))
            if tag == "caption":
                self.tables[-1].append([])
            return
        if tag in ("ul", "ol", "menu", "dir"):
            self.lines.indent = self.lists.pop()[2]
            self.lines.marker = ""
        elif tag == "li":
            self.lines.indent = self.lists[-1][2] if self.lists else max(0, self.lines.indent - 2)
            self.lines.marker = ""
        elif tag in ("blockquote", "dd"):
            self.lines.indent -= 2
        elif tag in ("pre", "listing", "xmp", "textarea"):
            self.exact -= 1
        elif tag == "table":
            for line in laid_out(self.tables.pop()):
                self.lines.break_line(1)
                if line:
                    self.lines.exact(line)
        if tag in BLOCK:
            self.lines.break_line(2 if tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and self.lists) else 1)

    def render(self, root: Node) -> str:
        work: list[tuple] = [(root, True, False)]
        while work:
            node, shown, leaving = work.pop()
            if leaving:
                self.leave(node, shown)
                continue
            if isinstance(node, str):
                if shown:
                    (self.lines.exact if self.exact else self.lines.flow)(node)
                continue
            if node.tag in UNSEEN:
                continue
            values = node.values()
            if "hidden" in values or node.tag == "dialog" and "open" not in values or node.tag == "input":
                continue
            style = values.get("style", "")
            if style:
                if HIDE.search(style):
                    continue
                if met := FADE.search(style):
                    shown = met[1].lower() == "visible"
            self.enter(node, values)
            work.append((node, values, True))
            children = node.children
            if node.tag == "details" and "open" not in values:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            work.extend((c, shown, False) for c in reversed(children))
        return "\n".join(self.lines.finished()).replace("\xa0", " ")


def visible_text(html: str | None) -> str:
    return Renderer().render(parse(html)) if html else ""


def extractor(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, PAGES):
            texts = [visible_text(html.as_py()) for html in batch.column(1).slice(at, PAGES)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, PAGES), pa.array(texts, pa.string())], names=["page_id", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, text``: a row for each page."""
    given = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(html_col).alias("html"))
    return given.mapInArrow(extractor, "page_id bigint, text string")


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
