"""Visible text of web pages, laid out as blocks, lists and tables.

A page is read into a tree that closes tags which HTML lets authors omit, the
tree is walked with the visibility rules applied, and all text that a reader
would see comes out: a blank line around paragraphs and headings, a line for
other blocks, marks for list items, preformatted text as it is, and table rows
with their columns aligned.  Nothing is judged as boilerplate or dropped for
where it stands.
"""

from __future__ import annotations

import html as entities
import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the HTML standard: elements by how they open, close and show.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head title script style template noscript iframe noembed noframes datalist area base link meta param source track svg math object audio video canvas select".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre table blockquote figure hr form fieldset".split())
BLOCK = SPACED | frozenset("address article aside body center dd details dialog div dt figcaption footer header hgroup html legend li main menu nav optgroup option section summary tr caption thead tbody tfoot".split())
#: What a head holds; anything else ends it, but within an open template or noscript.
HEAD_CONTENT = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
IN_HEAD = frozenset("template noscript".split())
CLOSES_P = (BLOCK - frozenset("body html tr thead tbody tfoot caption option optgroup legend".split()))
#: A start tag closes the nearest open one of these, unless one of the limits stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"optgroup", "option"}, {"select"}),
    "body": ({"head"}, set()),
}
_OPEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?")
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_BLANK = re.compile(r"[ \t\n\r\f]+")
#: Indents and table columns stop growing there, and rows at so many cells; columns are halved until a table has
#: at most so many times its text in blanks.  So a page's text stays in proportion to the page.
MOST_INDENT, MOST_WIDTH, MOST_CELLS, MOST_PADDING = 64, 120, 1000, 8


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []

    def attributes(self) -> dict[str, str]:
        return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(self.attrs)} if self.attrs.strip(" /") else {}


class Tags:
    """Finds the ends of tags.

    A ``>`` within quotes does not end a tag.  If the quotes of a tag never come to an end,
    they count as ordinary characters from that tag on, so a page is read once or twice,
    however many tags are left open.
    """

    def __init__(self, page: str):
        self.page, self.quoted = page, True
        self.last = page.rfind(">")

    def end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag whose name ends at ``at``; -1: none."""
        if at > self.last:
            return -1
        here = at
        while self.quoted:
            m = _STOP.search(self.page, here)
            if m and m[0] == ">":
                return m.start()
            here = self.page.find(m[0], m.end()) + 1 if m else 0
            self.quoted = here > 0
        return self.page.find(">", at)


def parse(page: str) -> Node:
    """The page's tree; stray end tags are ignored, open elements end with their parents."""
    root = Node("html")
    stack = [root]
    #: Depths at which elements of a name are open.
    places: dict[str, list[int]] = {}

    def is_open(*names) -> bool:
        return any(places.get(t) for t in names)

    def nearest(names) -> int:
        return max((d[-1] for t in names if (d := places.get(t))), default=0)

    def close(names, limits) -> None:
        """Ends the nearest open element of these names, unless a limit stands between."""
        depth = nearest(names)
        if depth > nearest(limits):
            while len(stack) > depth:
                places[stack.pop().tag].pop()

    at, tags = 0, Tags(page)
    while at < len(page):
        m, look, stop = None, at, -1
        while m := _OPEN.search(page, look):
            if m[2] is None or (stop := tags.end(m.end())) >= 0:
                break
            look = m.end()  # no tag: nothing ends it
        text = page[at : m.start() if m else len(page)]
        if text:
            if is_open("head") and not _BLANK.fullmatch(text) and not is_open(*IN_HEAD):
                close({"head"}, set())
            stack[-1].children.append(entities.unescape(text) if "&" in text else text)
        if not m:
            break
        if m[2] is None:
            at = m.end()
            continue
        at, attrs = stop + 1, page[m.end() : stop]
        tag = m[2].lower()
        if m[1]:
            if is_open(tag):
                # An end tag inside a table cell cannot close what holds the table.
                limits = set() if tag in ("table", "body", "html") else {"table"}
                close({tag}, limits)
            continue
        if tag == "html":
            continue
        if is_open("head") and tag not in HEAD_CONTENT and not is_open(*IN_HEAD):
            close({"head"}, set())
        if tag in CLOSES_P:
            close({"p"}, {"table", "td", "th", "button", "object"})
        if tag in IMPLIED:
            if tag in ("tr", "thead", "tbody", "tfoot"):
                close({"td", "th"}, {"table"})
                if tag != "tr":
                    close({"tr"}, {"table"})
            close(*IMPLIED[tag])
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in VOID or (attrs.endswith("/") and tag in ("svg", "math", "path")):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            body = page[at : end.start() if end else len(page)]
            node.children.append(entities.unescape(body) if tag in ("textarea", "title") else body)
            at = end.end() if end else len(page)
            continue
        places.setdefault(tag, []).append(len(stack))
        stack.append(node)
    return root


def _seen(node: Node) -> bool:
    if node.tag in UNSEEN:
        return False
    if "hidden" not in (low := node.attrs.lower()) and "none" not in low and "collapse" not in low:
        return True
    attrs = node.attributes()
    return not ("hidden" in attrs or _HIDDEN.search(attrs.get("style", "")) or (node.tag == "input" and attrs.get("type", "").lower() == "hidden"))


class Rope:
    """Text of a table within a cell, in pieces that are joined once, when the outermost cell is laid out."""

    __slots__ = ("parts",)

    def __init__(self, parts: list):
        self.parts = parts


class Flow:
    """Lines of text; blanks collapse, and breaks wait until text follows."""

    def __init__(self):
        self.parts: list[str | Rope] = []
        self.ropes = False
        self.breaks, self.blank, self.indent, self.mark = 0, False, 0, ""

    def text(self, s: str, pre: bool) -> None:
        if pre:
            if s:
                self._open()
                self.parts.append(s.replace("\r\n", "\n").replace("\n", "\n" + " " * min(self.indent, MOST_INDENT)))
            return
        words = _BLANK.sub(" ", s)
        if words in ("", " "):
            self.blank = self.blank or bool(words)
            return
        if words[0] == " ":
            self.blank = True
        self._open()
        self.parts.append(words.strip(" "))
        self.blank = words[-1] == " "

    def _open(self) -> None:
        if self.breaks and self.parts:
            self.parts.append("\n" * self.breaks)
        elif self.blank and self.parts and not self.mark:
            self.parts.append(" ")
        if self.breaks or not self.parts:
            self.parts.append(" " * (min(self.indent, MOST_INDENT) - len(self.mark)) + self.mark)
        self.breaks, self.blank, self.mark = 0, False, ""

    def line(self, n: int) -> None:
        self.breaks, self.blank = max(self.breaks, n), False

    def rope(self, pieces: list) -> None:
        self._open()
        self.parts.append(Rope(pieces))
        self.ropes = True

    def value(self) -> str:
        if not self.ropes:
            return "".join(self.parts)
        out, open_ = [], [iter(self.parts)]
        while open_:
            for part in open_[-1]:
                if isinstance(part, Rope):
                    open_.append(iter(part.parts))
                    break
                out.append(part)
            else:
                open_.pop()
        text = "".join(out)
        return text.rstrip() if isinstance(self.parts[-1], Rope) else text


class Row:
    """Cells of a table's row with their columns, and the number of columns they take."""

    __slots__ = ("cells", "n")

    def __init__(self):
        self.cells: list[tuple[int, str | Rope]] = []
        self.n = 0

    def add(self, cell: str | Rope, span: int) -> None:
        if isinstance(cell, Rope) or cell:
            self.cells.append((self.n, cell))
        self.n += 1
        self.n += max(min(span - 1, MOST_CELLS - self.n), 0)

    def pieces(self) -> list:
        """Of a table within a cell, where blanks collapse anyway: the cells with a blank between, none at the end."""
        out = []
        for column, cell in self.cells:
            if isinstance(cell, Rope) or _BLANK.sub("", cell):
                out += [" ", cell] if out or column else [cell]
        while out and isinstance(out[-1], str) and not out[-1].strip():
            out.pop()
        if out:
            held, at = (out, -1) if isinstance(out[-1], str) else (out[-1].parts, -1)
            held[at] = held[at].rstrip() if isinstance(held[at], str) else held[at]
        return out


def render(page: str) -> str:
    """Visible text of a page."""
    flow, outer = Flow(), []  # outer: flows, tables and lists that wait for an inner one
    lists: list[list] = []
    work: list[tuple] = [("open", parse(page), False)]
    tables: list[list[Row]] = []
    cells = 0  # that are open
    while work:
        step, node, pre = work.pop()
        if step == "open":
            if isinstance(node, str):
                flow.text(node, pre)
                continue
            if not _seen(node):
                continue
            tag = node.tag
            pre = pre or tag in ("pre", "textarea", "listing", "xmp")
            if tag == "br":
                flow.breaks = min(flow.breaks + 1, 2) if flow.breaks else 1
                flow.blank = False
                continue
            if tag == "img":
                flow.text(node.attributes().get("alt", ""), False)
                continue
            if tag == "input":
                attrs = node.attributes()
                flow.text(attrs.get("value", "") if attrs.get("type", "text").lower() in ("submit", "button", "reset", "text") else "", False)
                continue
            if tag == "hr":
                flow.line(2)
                continue
            if tag == "table":
                flow.line(2)
                tables.append([])
                outer.append(flow)
                flow = Flow()
            elif tag == "tr" and tables:
                tables[-1].append(Row())
            elif tag in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append(Row())
                outer.append(flow)
                flow = Flow()
                cells += 1
            elif tag in ("ul", "ol", "menu"):
                flow.line(1 if lists else 2)
                start = node.attributes().get("start", "1") if tag == "ol" else ""
                lists.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
                flow.indent += 2
            elif tag == "li":
                flow.line(1)
                if lists and lists[-1][0] == "ol":
                    flow.mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                else:
                    flow.mark = "- "
                flow.indent += len(flow.mark)
                work.append(("item", len(flow.mark), pre))
            elif tag in BLOCK:
                flow.line(2 if tag in SPACED else 1)
                flow.indent += 2 * (tag in ("dd", "blockquote"))
            if tag != "li":
                work.append(("close", node, pre))
            work.extend(("open", child, pre) for child in reversed(node.children))
            continue
        if step == "item":
            flow.indent -= node
            if flow.mark:  # an item without text
                flow.mark = ""
            flow.line(1)
            continue
        tag = node.tag
        if tag == "table":
            caption, flow, rows = flow, outer.pop(), tables.pop()
            if cells:
                lines = [x.rstrip() for x in caption.value().split("\n") if x.strip()] if not caption.ropes else []
                pieces = ["\n".join(lines)] if lines else []
                for part in caption.parts if caption.ropes else ():  # lines of blanks in front don't count
                    part = re.sub(r"^\s*\n", "", part) if isinstance(part, str) and not pieces else part
                    pieces += [part] if part else []
                for row in filter(None, (r.pieces() for r in rows)):
                    pieces += ["\n", *row] if pieces else row
                if any(isinstance(p, Rope) or p.strip() for p in pieces):
                    flow.line(1)
                    flow.rope(pieces)
            else:
                for line in [*caption.value().split("\n"), *_aligned(rows)]:
                    if line.strip():
                        flow.line(1)
                        flow.text(line.rstrip(), True)
            flow.line(2)
        elif tag in ("td", "th") and outer and tables:
            cells -= 1
            cell = Rope(flow.parts) if cells and flow.ropes else _BLANK.sub(" ", flow.value())
            flow = outer.pop()
            span = node.attributes().get("colspan", "1")
            tables[-1][-1].add(cell, int(span) if re.fullmatch(r"[1-9]\d{0,3}", span) else 1)
        elif tag in ("ul", "ol", "menu"):
            lists.pop()
            flow.indent -= 2
            flow.line(1 if lists else 2)
        elif tag in BLOCK and tag != "tr":
            flow.indent -= 2 * (tag in ("dd", "blockquote"))
            flow.line(2 if tag in SPACED else 1)
    return flow.value()


def _aligned(rows: list[Row]) -> list[str]:
    """Rows with cells padded to their column's width."""
    most, text = MOST_WIDTH, sum(len(cell) for row in rows for _, cell in row.cells)
    while True:
        widths = [0] * max((row.n for row in rows), default=0)
        for row in rows:
            for i, cell in row.cells:
                widths[i] = max(widths[i], min(len(cell), most))
        starts = [0, *accumulate(w + 2 for w in widths)]
        if sum(starts[row.cells[-1][0]] for row in rows if row.cells) <= MOST_PADDING * text + 4096:
            break
        if not most:  # the blanks between empty columns alone are too many
            return ["  ".join(cell for _, cell in row.cells) for row in rows]
        most //= 2
    out = []
    for row in rows:
        parts, end, over = [], 0, 0  # over: by how much earlier cells were wider than their columns
        for i, cell in row.cells:
            parts += [" " * (starts[i] + over - end), cell]
            end = starts[i] + over + len(cell)
            over += max(len(cell) - widths[i], 0)
        out.append("".join(parts))
    return out


@F.arrow_udf(StringType())
def _visible(pages: pa.Array) -> pa.Array:
    return pa.array([render(x.as_py() or "") for x in pages], pa.string())


def visible_text(html: Column) -> Column:
    """Visible text of a page; "" for null and empty pages.

    Time and text stay in proportion to the page, also where tags, quotes or comments are
    left open, tables stand in tables or cells span many columns.  Left out are drawings, formulas, media, frames and the options of selections.
    """
    return _visible(html)


def extract_text(pages: DataFrame, *, html_col: str = "html", out: str = "text") -> DataFrame:
    """Adds the column ``out`` with each page's visible text.

    A column of that name is replaced, others stay; repeated rows get equal texts.
    """
    return pages.withColumn(out, visible_text(F.col(html_col)))
