"""HTML extraction: a tree builder with implied tags and visibility rules, and a layout-aware renderer of the visible text.

Blocks stand on lines of their own with the spacing of their kind, lists get bullets or numbers and indents, tables get cells
aligned by column.  All visible text comes out: nothing is judged to be boilerplate.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes audio video canvas datalist title meta link base".split())
#: Parts of svg and math elements that are not drawn where they stand.
UNDRAWN = {"desc": "svg", "metadata": "svg", "defs": "svg", "symbol": "svg", "annotation": "math", "annotation-xml": "math"}
#: What may stand in a head; the start tag of anything else ends it.
HEADED = frozenset("head base basefont bgsound link meta title style script template noscript noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul".split())
SPACED = frozenset("p blockquote pre ul ol dl table h1 h2 h3 h4 h5 h6 figure menu dir".split())
#: The start tag at the left closes an open element at the right, up to but not beyond an element of the third set.
SCOPE = frozenset("html body table td th caption button object template".split())
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
}
IMPLIED |= {"thead": IMPLIED["tbody"], "tfoot": IMPLIED["tbody"]}
CLOSES_P = BLOCK - frozenset(["html", "body", "legend", "summary"])
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<![^>]*>?|<\?[^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'][^>]*)*)>?", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
QUOTED = r"\"(?:[^\"\\]|\\.)*(?:\"|\Z)|'(?:[^'\\]|\\.)*(?:'|\Z)"
#: What declares nothing in a style: comments, strings and what stands in parentheses, as addresses do.
OPAQUE = re.compile(rf"/\*.*?(?:\*/|\Z)|{QUOTED}|\((?:{QUOTED}|[^()\"']|\((?:{QUOTED}|[^()\"'])*(?:\)|\Z))*(?:\)|\Z)", re.S)
#: Where the content of an element ends that has no elements in it.
ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}
BLANKS = re.compile(r"[ \t\n\r\f]+")
DEEPEST = 250


class Node:
    """An element: hidden with all below it, or veiled, which elements below may undo."""

    __slots__ = ("tag", "children", "hidden", "veiled", "attrs")

    def __init__(self, tag: str, hidden: bool = False, veiled: bool = False, attrs: dict[str, str] | None = None):
        self.tag, self.children, self.hidden, self.veiled, self.attrs = tag, [], hidden, veiled, attrs or {}


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(ATTRIBUTE.finditer(text)))}


def declared(attrs: dict[str, str], name: str) -> str:
    """The value that an element's style gives a property: the last one, or the last that is important; none is empty."""
    value, important = "", False
    if name in attrs.get("style", "").lower():
        for part in OPAQUE.sub("", attrs["style"]).lower().split(";"):
            key, _, own = part.partition(":")
            own, _, mark = own.partition("!")
            if key.strip() == name and own.strip() and (mark.strip() == "important" or not important):
                value, important = own.strip(), mark.strip() == "important"
    return value


def unseen(tag: str, attrs: dict[str, str]) -> bool:
    """Whether an element's text is not shown; that of an object is, if it names no data."""
    if tag in HIDDEN or tag == "object" and attrs.get("data", "").strip() or declared(attrs, "display") == "none":
        return True
    return "hidden" in attrs and attrs["hidden"].lower() != "until-found"


def veil(attrs: dict[str, str], around: bool) -> bool:
    """Whether an element's own text is kept from view by its visibility, or else by that of what is around it."""
    value = declared(attrs, "visibility")
    return value in ("hidden", "collapse") if value in ("hidden", "collapse", "visible", "initial") else around


def tree(page: str) -> Node:
    """The element tree of a page: unknown end tags are passed over, missing ones are implied."""
    root = Node("html")
    stack = [root]
    places: dict[str, list[int]] = {}  # where in the stack the elements of a tag are
    at = 0

    def last(tag: str) -> int:
        return places[tag][-1] if places.get(tag) else 0

    def shut(k: int) -> None:
        for n in stack[k:]:
            places[n.tag].pop()
        if any(n.tag in BLOCK for n in stack[max(k, DEEPEST) :]):
            stack[DEEPEST - 1].children.append(Node("div"))  # ends the line
        del stack[k:]

    def put(child: Node | str) -> None:
        # what is deeper than DEEPEST stays a sibling at that depth, but its text is shown only if all around it is
        if isinstance(child, Node) or len(stack) <= DEEPEST or not (stack[-1].hidden or stack[-1].veiled):
            stack[min(len(stack), DEEPEST) - 1].children.append(child)

    def write(text: str) -> None:
        if stack[-1].tag == "head" and text.strip(" \t\n\r\f"):
            shut(len(stack) - 1)
        put(html.unescape(text))

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            write(page[at:])
            break
        if m.start() > at:
            write(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "p" and not last("p"):
                put(Node("p"))
            k = last(tag)
            if k and (tag in ("td", "th", "tr", "table", "tbody", "thead", "tfoot", "body", "html") or k > max(map(last, ("td", "th", "table")))):
                shut(k)
            continue
        if tag == "body" and last("head"):
            shut(last("head"))
        if tag in ("html", "body"):
            continue
        if stack[-1].tag == "head" and tag not in HEADED:
            shut(len(stack) - 1)
        close, within = IMPLIED.get(tag, ((), ()))
        if tag in CLOSES_P:
            close, within = frozenset(close) | {"p"}, frozenset(within) | SCOPE
        if tag[0] == "h" and tag in SPACED and stack[-1].tag in SPACED and stack[-1].tag[0] == "h":
            shut(len(stack) - 1)
        if any(map(last, close)):
            beyond = max((last(x) for x in within if x not in close), default=0)
            lowest = min((places[x][k] for x in close if places.get(x) and (k := bisect_right(places[x], beyond)) < len(places[x])), default=0)
            if lowest:
                shut(lowest)
        attrs = attributes(m[3]) if m[3] and m[3].strip(" /\n") else {}
        foreign = last("svg") or last("math")
        undrawn = tag in UNDRAWN and last(UNDRAWN[tag]) > 0
        node = Node(tag, stack[-1].hidden or undrawn or unseen(tag, attrs), veil(attrs, stack[-1].veiled), attrs)
        put(node)
        if foreign and m[3] and m[3].endswith("/"):
            continue
        if tag in RAW:
            end = ENDS[tag].search(page, at)
            text = page[at : end.start()] if end else page[at:]
            node.children.append(html.unescape(text) if tag in ("textarea", "title") else text)
            at = end.end() if end else len(page)
        elif tag not in VOID:
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
    return root


def width(text: str) -> int:
    """Columns that a text takes on a fixed grid."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Lines:
    """Output of a block: lines, with at most one empty line between blocks; blanks in them are collapsed, or kept as in a pre."""

    def __init__(self, kept: bool = False) -> None:
        self.lines: list[str] = []
        self.now = ""
        self.gap = False
        self.kept = kept

    def text(self, s: str, own: bool = False) -> None:
        """Go on with a text; ``own`` text is the page's, which keeps its blanks and lines where they are kept."""
        if self.kept and own:
            *whole, rest = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            for x in whole:
                self.now += x
                self.cut()
            if rest:
                self.start()
                self.now += rest
            return
        s = BLANKS.sub(" ", s)
        if s[:1] == " " and (not self.now or self.now[-1] == " "):
            s = s[1:]
        if s:
            self.start()
            self.now += s

    def start(self) -> None:
        if self.gap and self.lines and self.lines[-1] != "":
            self.lines.append("")
        self.gap = False

    def end(self, gap: bool = False) -> None:
        """End the line; a gap asks for an empty line before what follows."""
        if self.now.strip(" "):
            self.lines.append(self.now.rstrip(" "))
        self.now = ""
        self.gap = self.gap or gap

    def cut(self) -> None:
        """End the line even if it is empty."""
        if self.now.strip():
            self.start()
        self.lines.append(self.now.rstrip())
        self.now = ""

    def add(self, lines: list[str]) -> None:
        if lines:
            self.start()
            self.lines += lines

    def done(self) -> list[str]:
        self.end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def rendered(node: Node, out: Lines) -> None:
    """Write what is visible below a node."""
    number = None
    if node.tag == "ol":
        start = node.attrs.get("start", "")
        number = int(start) if start.lstrip("-").isdigit() and len(start) < 10 else 1
    for child in node.children:
        if isinstance(child, str):
            if not node.hidden and not node.veiled:
                out.text(child, own=True)
            continue
        if child.hidden:
            continue
        tag = child.tag
        if child.veiled and tag in VOID:
            continue
        if tag == "br":
            if out.kept:
                out.cut()
            elif out.now.strip(" "):
                out.end()
            else:
                out.now = ""
                out.gap = True
        elif tag == "hr":
            out.end()
            out.add(["---"])
        elif tag == "input":
            if child.attrs.get("type", "").lower() in ("submit", "reset", "button") and child.attrs.get("value", "").strip():
                out.text(" " + child.attrs["value"] + " ")
        elif tag == "tr":  # of no table
            out.end()
            rendered(child, out)
            out.end()
        elif tag in ("td", "th"):
            out.text(" ")
            rendered(child, out)
            out.text(" ")
        elif tag == "img":
            if child.attrs.get("alt", "").strip():
                out.text(" " + child.attrs["alt"] + " ")
        elif tag == "li":
            out.end()
            own = Lines(out.kept)
            rendered(child, own)
            lines = own.done()
            mark = "- " if number is None else f"{number}. "
            number = number and number + 1
            out.add([(mark if k == 0 else " " * len(mark)) + x if x else "" for k, x in enumerate(lines)])
        elif tag == "dd" or tag == "blockquote":
            out.end(tag == "blockquote")
            own = Lines(out.kept)
            rendered(child, own)
            out.add(["  " + x if x else "" for x in own.done()])
            out.gap = out.gap or tag == "blockquote"
        elif tag == "pre":
            out.end(True)
            own = Lines(kept=True)
            rendered(child, own)
            lines = own.done()
            out.add(lines[1:] if lines[:1] == [""] and starts_with_line(child) else lines)
            out.gap = True
        elif tag == "table":
            out.end(True)
            out.add(table_lines(child, out.kept))
            out.gap = True
        elif tag in ("option", "optgroup"):
            out.end()
            if tag == "optgroup" or "label" in child.attrs:
                out.text(child.attrs.get("label", ""))
                out.end()
            if tag == "optgroup" or "label" not in child.attrs:
                rendered(child, out)
                out.end()
        elif tag == "text":  # of an svg: drawn at a place of its own
            out.text(" ")
            rendered(child, out)
            out.text(" ")
        elif tag in BLOCK:
            nested = tag in ("ul", "ol", "menu", "dir") and node.tag == "li"
            out.end(tag in SPACED and not nested)
            rendered(child, out)
            out.end(tag in SPACED and not nested)
        else:
            rendered(child, out)


def starts_with_line(pre: Node) -> bool:
    """Whether a pre's text starts with the end of a line, which is not shown."""
    first = pre.children[0] if pre.children else ""
    return isinstance(first, str) and first[:1] in ("\n", "\r")


def table_lines(table: Node, kept: bool = False) -> list[str]:
    """Rows of a table with cells aligned by column, in which blanks may be kept; what stands outside of rows goes before it."""
    outside, rows = Lines(), []

    def collect(node: Node) -> None:
        for c in node.children:
            if isinstance(c, str):
                outside.text(c)
            elif c.hidden:
                continue
            elif c.tag == "tr":
                rows.append([(lines_of(x, kept), span(x), span(x, "rowspan")) for x in c.children if not isinstance(x, str) and not x.hidden and x.tag in ("td", "th")])
                for x in c.children:
                    if isinstance(x, str):
                        outside.text(x)
                    elif not x.hidden and x.tag not in ("td", "th"):
                        rendered_alone(x, outside)
            elif c.tag in ("thead", "tbody", "tfoot"):
                collect(c)
            elif c.tag in ("td", "th"):
                rows.append([(lines_of(c, kept), span(c), span(c, "rowspan"))])
            elif c.tag not in ("colgroup", "col"):
                rendered_alone(c, outside)

    collect(table)
    placed = placing(rows)
    widths = [0] * max((k + over for row in placed for k, _, over in row), default=0)
    for row in placed:
        for k, lines, over in row:
            if over == 1:
                widths[k] = max(widths[k], *map(width, lines or [""]))
    starts = [0]
    for w in widths:
        starts.append(starts[-1] + w + 2)
    out = outside.done()
    for row in placed:
        for i in range(max((len(lines) for _, lines, _ in row), default=0)):
            line = ""
            for k, lines, _ in row:
                if i < len(lines):
                    line += " " * max(2 if line.strip() else 0, starts[k] - width(line)) + lines[i]
            out.append(line.rstrip())
    return out


def placing(rows: list[list[tuple[list[str], int, int]]]) -> list[list[tuple[int, list[str], int]]]:
    """(column, lines, columns) of each row's cells, beside the cells of rows before that reach down to it."""
    taken: dict[int, int] = {}  # columns and how many more rows a cell before holds them for
    out = []
    for row in rows:
        placed, k, new = [], 0, {}
        for lines, over, down in row:
            while taken.get(k, 0):
                k += 1
            placed.append((k, lines, over))
            if down > 1:
                new |= {k + j: down - 1 for j in range(over)}
            k += over
        taken = {c: n - 1 for c, n in taken.items() if n > 1} | new
        out.append(placed)
    return out


def span(cell: Node, of: str = "colspan") -> int:
    n = cell.attrs.get(of, "1").strip()
    return min(1000, max(1, int(n))) if n.isdigit() and len(n) < 6 else 1


def lines_of(node: Node, kept: bool = False) -> list[str]:
    own = Lines(kept)
    rendered(node, own)
    return [x for x in own.done() if x]


def rendered_alone(node: Node, out: Lines) -> None:
    holder = Node("div")
    holder.children.append(node)
    rendered(holder, out)
    out.end()


def extract(page: str | None) -> str:
    """The visible text of one page."""
    if not page:
        return ""
    out = Lines()
    rendered(tree(page), out)
    return "\n".join(out.done())


def visible_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text) of every row.

    Null and empty pages, and pages with nothing visible, give the empty text; pages of any length are read whole.  Elements
    deeper than DEEPEST stay siblings at that depth, with all their text, so no page can exhaust the stack.  Null ids and repeated rows are passed on, one row out for each row in.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([b.column(0), pa.array([extract(x) for x in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return map_arrow(pages.select(pages[id_col].alias("id"), F.col(html_col).alias("html")), run, f"id {kind}, text string", 500).withColumnRenamed("id", id_col)
