"""HTML tables as Markdown, by expansion of spanning cells into a grid."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.latex import math_string
from folioflow.functions.text import by_slices

MODES = ("blank", "repeat", "keep_html")
_TABLE = re.compile(r"(?is)<table\b[^>]*>.*?</table>")
_EQ = re.compile(r"(?is)<eq>(.*?)</eq>")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Node:
    __slots__ = ("name", "attrs", "items")

    def __init__(self, name: str, attrs):
        self.name, self.attrs, self.items = name, dict(attrs), []

    def walk(self, name: str):
        for x in self.items:
            if isinstance(x, _Node):
                if x.name == name:
                    yield x
                yield from x.walk(name)

    def texts(self):
        for x in self.items:
            if isinstance(x, _Node):
                yield from x.texts()
            elif x.strip():
                yield x.strip()


class _Tree(HTMLParser):
    """A lenient tree: an end tag closes up to its start, and one without a start is dropped."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = _Node("", [])
        self.open = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, attrs)
        self.open[-1].items.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].items.append(_Node(tag, attrs))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        at = self.open[-1].items
        if at and isinstance(at[-1], str):
            at[-1] += data
        else:
            at.append(data)


def _count(value: str | None) -> int:
    try:
        return max(1, int(value)) if value is not None else 1
    except ValueError:
        return 1


def expanded(rows: list[list[tuple[str, int, int]]], mode: str) -> list[list[str]] | None:
    """The grid of rows of (text, rowspan, colspan); None where a cell spans and ``mode`` keeps HTML.

    Cells carried down from above are taken up ahead of each cell and at a row's end; a
    wide cell runs over them. Rows without cells don't count.
    """
    carried: dict[int, tuple[int, str]] = {}
    grid: list[list[str]] = []
    for cells in rows:
        if not cells:
            continue
        out: list[str] = []

        def take() -> None:
            while carried.get(len(out), (0, ""))[0] > 0:
                left, text = carried[len(out)]
                carried[len(out)] = (left - 1, text)
                out.append(text)

        for text, down, wide in cells:
            take()
            if (down > 1 or wide > 1) and mode == "keep_html":
                return None
            for j in range(wide):
                shown = "" if mode == "blank" and j else text
                if down > 1:
                    at = len(out)
                    carried[at] = (max(carried.get(at, (0, ""))[0], down - 1), "" if mode == "blank" else shown)
                out.append(shown)
        take()
        grid.append(out)
    width = max(map(len, grid), default=0)
    return [r + [""] * (width - len(r)) for r in grid]


def _cell(node: _Node) -> str:
    return " ".join(" ".join(node.texts()).split()).replace("|", "\\|")


def table_rows(html: str, as_unicode: bool = False) -> tuple[list[list[tuple[str, int, int]]], bool] | None:
    """(rows of (text, rowspan, colspan), whether any cell is a heading) of a table; None where there is none."""
    html = _EQ.sub(lambda m: math_string(m[1], as_unicode, display=False), html)
    table = next(_Tree(html).root.walk("table"), None)
    if table is None:
        return None
    rows, heading = [], False
    for tr in table.walk("tr"):
        cells = [x for x in tr.items if isinstance(x, _Node) and x.name in ("td", "th")]
        heading = heading or any(x.name == "th" for x in cells)
        rows.append([(_cell(x), _count(x.attrs.get("rowspan")), _count(x.attrs.get("colspan"))) for x in cells])
    return rows, heading


def rows_markdown(found: tuple[list[list[tuple[str, int, int]]], bool] | None, mode: str) -> str | None:
    """Markdown of ``table_rows``; None where the table stays HTML or has no cells. The first row is the header if any cell is a heading."""
    grid = expanded(found[0], mode) if found else None
    if not grid:
        return None
    head, body = (grid[0], grid[1:]) if found[1] else ([""] * len(grid[0]), grid)
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(head), line(["---"] * len(head)), *map(line, body)])


def table_markdown(html: str, mode: str = "repeat", as_unicode: bool = False) -> str | None:
    """One table as Markdown, as ``rows_markdown`` says."""
    return rows_markdown(table_rows(html, as_unicode), mode)


def tables_in_modes(text: str, modes: tuple[str, ...], as_unicode: bool = False) -> tuple[str, ...]:
    """``text`` in each mode, with each table as Markdown between line breaks where it can be; each is parsed once."""
    if "<table" not in text.lower():
        return (text,) * len(modes)
    out, at = [[] for _ in modes], 0
    for m in _TABLE.finditer(text):
        found = table_rows(m[0], as_unicode)
        for parts, mode in zip(out, modes):
            md = rows_markdown(found, mode)
            parts += (text[at : m.start()], m[0] if md is None else f"\n{md}\n")
        at = m.end()
    return tuple("".join(parts) + text[at:] for parts in out)


def tables_markdown(text: str, mode: str = "repeat", as_unicode: bool = False) -> str:
    """``tables_in_modes`` for one mode."""
    return tables_in_modes(text, (mode,), as_unicode)[0]


def html_tables_in_modes(text: Column, modes: tuple[str, ...], as_unicode: bool = False) -> Column:
    """``tables_in_modes`` for a column, a field for each mode; texts without a table never reach Python."""
    has = F.lower(text).contains("<table")
    kind = pa.struct([(m, pa.string()) for m in modes])

    def convert(x: str) -> dict:
        return dict(zip(modes, tables_in_modes(x, modes, as_unicode)))

    same = F.struct(*[text.alias(m) for m in modes])
    return F.when(has, by_slices(convert, kind)(F.when(has, text))).otherwise(same)


def html_tables_to_markdown(text: Column, mode: str = "repeat", as_unicode: bool = False) -> Column:
    """The same in one mode."""
    return html_tables_in_modes(text, (mode,), as_unicode)[mode]
