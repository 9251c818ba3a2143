"""HTML extraction: a tree with implied tags, rendered as the visible text of a page."""

from __future__ import annotations

import html
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, slices

#: Elements by how they are built and shown.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"}
UNSEEN = {"head", "script", "style", "title", "noscript", "template", "iframe", "meta", "link", "object", "svg", "canvas", "audio", "video", "datalist"}
PARAGRAPHS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "ul", "ol", "dl", "table", "figure", "hr"}
BLOCKS = PARAGRAPHS | {"address", "article", "aside", "body", "details", "dialog", "dd", "div", "dt", "fieldset", "figcaption", "footer", "form", "header", "html", "legend", "li", "main", "nav", "section", "summary", "caption", "tr", "td", "th", "thead", "tbody", "tfoot", "option", "select", "center"}
#: A start tag closes these open elements, up to the elements that shield them.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"td", "th", "tr", "caption", "colgroup"}, {"table"}),
    "thead": ({"td", "th", "tr", "tbody", "tfoot", "thead", "caption", "colgroup"}, {"table"}),
    "tbody": ({"td", "th", "tr", "tbody", "tfoot", "thead", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "tbody", "tfoot", "thead", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_NUMBER = re.compile(r"-?[0-9]{1,9}")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_HIDDEN = re.compile(r"(?i)(?:display\s*:\s*none|visibility\s*:\s*hidden)")
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def build(page: str) -> Node:
    """The tree of a page. Unclosed elements end with their parents; end tags that match nothing are dropped."""
    root = Node("html", {})
    line, at = [root], 0
    places: dict[str, list[int]] = {}  # where the open elements of each tag stand in line

    def end_from(i: int) -> None:
        for node in line[i:]:
            places[node.tag].pop()
        del line[i:]

    def close(tags: set[str], shields: set[str]) -> None:
        """End the outermost open one of `tags` that no shield stands inside of, and all in it."""
        shield = max((places[t][-1] for t in shields if places.get(t)), default=0)
        ends = [p[bisect_right(p, shield)] for t in tags if (p := places.get(t)) and p[-1] > shield]
        if ends:
            end_from(min(ends))

    quotes = True  # until a tag's quotes do not end: then, and in what follows, a tag ends at the first >

    def tag_end(at: int) -> int:
        nonlocal quotes
        if quotes and (found := _QUOTED.match(page, at)):
            return found.end()
        quotes = False
        return page.find(">", at) + 1

    while True:
        start = page.find("<", at)
        while start >= 0 and not (page[start + 1 : start + 2] in ("!", "?") or _NAME.match(page, start + 1)):
            start = page.find("<", start + 1)
        text = page[at : start if start >= 0 else len(page)]
        if text:
            line[-1].children.append(html.unescape(text))
        if start < 0:
            return root
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        name = _NAME.match(page, start + 1)
        end = tag_end(name.end()) if name else page.find(">", start) + 1
        if not end:  # no tag ends from here on
            line[-1].children.append(html.unescape(page[start:]))
            return root
        at = end
        if not name:
            continue
        tag, rest = name[2].lower(), page[name.end() : end - 1]
        if name[1]:
            if places.get(tag):
                end_from(places[tag][-1])
            continue
        attributes = {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(rest)} if rest else {}
        if tag == "html":
            root.attributes |= attributes
            continue
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in BLOCKS:
            close({"p"}, {"td", "th", "table", "button", "div", "li", "blockquote"})
        node = Node(tag, attributes)
        line[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?![^\s/>])", re.I).search(page, at)
            node.children.append(html.unescape(page[at : end.start() if end else len(page)]))
            at = page.find(">", end.end()) + 1 if end else 0
            at = at or len(page)
        elif tag not in VOID and not rest.rstrip().endswith("/"):
            places.setdefault(tag, []).append(len(line))
            line.append(node)


def _visible(node: Node) -> bool:
    style = node.attributes.get("style")
    return not (node.tag in UNSEEN or "hidden" in node.attributes or (style and _HIDDEN.search(style)) or (node.tag == "input" and node.attributes.get("type", "").lower() == "hidden"))


class _Out:
    """Lines of text, with the space that blocks ask for between them."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0

    def text(self, text: str, keep: bool) -> None:
        if keep:
            first, *rest = text.split("\n")
            self._put(first)
            for x in rest:
                self.break_line()
                self._put(x)
            return
        text = _SPACE.sub(" ", text)
        if text.startswith(" ") and (not self.line or self.line[-1].endswith(" ")):
            text = text[1:]
        self._put(text)

    def _put(self, text: str) -> None:
        if text:
            if not self.line and self.lines and self.gap > 1:
                self.lines += [""] * (self.gap - 1)
            self.gap = 0
            self.line.append(text)

    def break_line(self) -> None:
        self.lines.append("".join(self.line).rstrip(" "))
        self.line = []

    def block(self, gap: int) -> None:
        if self.line:
            self.break_line()
        self.gap = max(self.gap, gap)

    def done(self) -> list[str]:
        if self.line:
            self.break_line()
        return self.lines


#: Fixed value: the most columns and rows that the standard lets a cell cover.
SPANS = {"colspan": 1000, "rowspan": 65534}


def _span(cell: Node, name: str) -> int:
    value = cell.attributes.get(name, "1").strip()
    return min(int(value), SPANS[name]) if _NUMBER.fullmatch(value) and int(value) > 0 else 1


#: Tables inside of tables, and lists inside of lists, beyond which they are shown as plain blocks: each cell and item on a line of its own.
MAX_TABLES, MAX_LISTS = 24, 24
_VISIT, _BLOCK, _ITEM = range(3)


def _rows(table: Node) -> tuple[list[Node], list[Node | str]]:
    """(rows, what stands in the table but in no row) of a table in order; its foot comes last."""
    rows: list[Node] = []
    feet: list[Node] = []
    other: list[Node | str] = []
    todo = [(c, rows) for c in reversed(table.children)]
    while todo:
        c, into = todo.pop()
        if isinstance(c, str):
            if c.strip():
                other.append(c)
        elif not _visible(c):
            continue
        elif c.tag == "tr":
            into.append(c)
        elif c.tag in ("thead", "tbody", "tfoot", "colgroup"):
            todo += [(x, feet if c.tag == "tfoot" else into) for x in reversed(c.children)]
        else:
            other.append(c)
    return rows + feet, other


def _table(node: Node, tables: int) -> list[str]:
    """Rows of cells, each column as wide as its widest cell, two spaces between columns; a column in which no cell starts takes no room."""
    found, other = _rows(node)
    captions = [x for c in other for x in _lines([c] if isinstance(c, str) else c.children, tables)]
    rows: list[list[tuple[int, list[str]]]] = []
    covered: list[tuple[int, int, int]] = []  # from, to, rows: columns that cells above still cover
    for tr in found:
        row, column, above, k = [], 0, covered, 0
        covered = [(a, b, n - 1) for a, b, n in above if n > 1]
        for cell in tr.children:
            if isinstance(cell, str) or cell.tag not in ("td", "th"):  # shown before the table
                if isinstance(cell, str) and cell.strip() or isinstance(cell, Node):
                    captions += _lines([cell], tables)
                continue
            if not _visible(cell):
                continue
            while k < len(above) and above[k][0] <= column:
                column = max(column, above[k][1])
                k += 1
            wide, high = _span(cell, "colspan"), _span(cell, "rowspan")
            row.append((column, _lines(cell.children, tables)))
            if high > 1:
                covered.append((column, column + wide, high - 1))
            column += wide
        covered.sort()
        rows.append(row)
    width: dict[int, int] = {}
    for row in rows:
        for column, text in row:
            width[column] = max(width.get(column, 0), max(map(len, text), default=0))
    left, at = {}, 0
    for column in sorted(width):
        left[column] = at
        at += width[column] + 2
    out = captions
    for row in rows:
        for k in range(max((len(text) for _, text in row), default=0)):
            line, size = [], 0
            for column, text in row:
                if k < len(text) and text[k]:
                    line += [" " * (left[column] - size), text[k]]
                    size = max(left[column], size) + len(text[k])
            out.append("".join(line).rstrip())
    return out


def _lines(nodes: list[Node | str], tables: int) -> list[str]:
    """The lines that nodes give. The nodes still to be shown are kept in a list of our own, so that elements may be nested to any depth."""
    whole = _Out()
    # A list directly inside of another (`tight`) has no blank lines around it.
    todo: list[tuple] = [(_VISIT, n, whole, False, 0, False) for n in reversed(nodes)]
    while todo:
        what, node, out, keep, lists, tight = todo.pop()
        if what == _BLOCK:
            out.block(node)
            continue
        if what == _ITEM:
            mark, inner = node
            for i, x in enumerate(inner.done() or [""]):
                out.text((mark if not i else " " * len(mark)) + x if x or not i else "", True)
                out.block(1)
            continue
        if isinstance(node, str):
            out.text(node, keep)
            continue
        if not _visible(node):
            continue
        tag = node.tag
        if tag == "br":
            out.break_line()
        elif tag == "hr":
            out.block(2)
        elif tag == "table" and tables < MAX_TABLES:
            out.block(2)
            for x in _table(node, tables + 1):
                out.text(x, True)
                out.block(1)
            out.block(2)
        elif tag in ("ul", "ol", "menu") and lists < MAX_LISTS:
            gap, number, steps = 1 if tight else 2, _number(node, "start"), []
            out.block(gap)
            for c in node.children:
                if isinstance(c, Node) and c.tag == "li" and _visible(c):
                    if tag == "ol":
                        number = _number(c, "value", number)
                    inner = _Out()
                    steps += [(_VISIT, x, inner, keep, lists + 1, True) for x in c.children]
                    steps.append((_ITEM, (f"{number}. " if tag == "ol" else "- ", inner), out, keep, lists, tight))
                    number += 1
                else:
                    steps.append((_VISIT, c, out, keep, lists + 1, True))
            todo += [(_BLOCK, gap, out, keep, lists, tight), *reversed(steps)]
        else:
            gap = 2 if tag in PARAGRAPHS else 1 if tag in BLOCKS else 0
            if gap:
                out.block(gap)
                todo.append((_BLOCK, gap, out, keep, lists, tight))
            todo += [(_VISIT, c, out, keep or tag == "pre", lists, tight and not gap) for c in reversed(node.children)]
    return whole.done()


def _number(node: Node, name: str, other: int = 1) -> int:
    value = node.attributes.get(name, "").strip()
    return int(value) if _NUMBER.fullmatch(value) else other


def visible_text(page: str | None) -> str:
    """The visible text of a page: blocks on lines of their own, a blank line around paragraphs, list marks, aligned table cells."""
    if not page:
        return ""
    return "\n".join(_lines(build(page).children, 0)).strip("\n")


def extract(pages: DataFrame, source: str = "html", into: str = "text") -> DataFrame:
    """pages without the column `source` and with `into`, the visible text of each page.

    A null or empty page gives an empty text, broken markup the text that a lenient reader would see. Elements may be nested to any depth; tables and
    lists inside of more than MAX_TABLES and MAX_LISTS others are shown as plain blocks. Text that stands in a table but in no cell comes before the
    table. Rows are taken one by one, without a shuffle, so ties and repeated rows do not matter; pages of any length are
    read in time in proportion to it. Other columns stay, one named like `into` is replaced; an empty table gives an empty one.
    """
    kept = [c for c in pages.columns if c not in (source, into)]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.select(*kept).schema)

    def run(batches):
        for batch in slices(batches, source):
            texts = [visible_text(x) for x in batch[source].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(texts, pa.string())], names=[*kept, into])

    return in_arrow(pages.select(*kept, F.col(source)), run, f"{fields}`{into}` string")
