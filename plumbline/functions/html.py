"""A small element tree over the standard HTML parser, and what is read from it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# A start tag on the left closes an open element on the right.
CLOSES = {
    "li": {"li"}, "p": {"p"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "thead": {"tr", "td", "th"}, "tfoot": {"tr", "td", "th", "thead", "tbody"},
}
SCOPES = {"table", "ul", "ol", "select", "dl", "body", "html", "[root]"}
HIDDEN = {"script", "style", "template", "noscript", "head"}


class Element:
    """A tag with attributes and children; text children are plain strings."""

    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag = tag
        self.attrs = attrs
        self.children: list[Element | str] = []

    def walk(self) -> Iterator[Element]:
        """All elements below this one, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Element)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Element)]

    def text(self) -> str:
        """Shown text with white space collapsed."""
        parts: list[str] = []
        stack: list[Element | str] = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                parts.append(node)
            elif node is self or node.tag not in HIDDEN:
                parts.append(" " if node.tag in ("br", "p", "div", "tr", "li", "td", "th") else "")
                stack += reversed(node.children)
        return re.sub(r"\s+", " ", "".join(parts)).strip()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("[root]", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        closes = CLOSES.get(tag, set())
        while closes and self.open[-1].tag in closes:
            self.open.pop()
        node = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                del self.open[depth:]
                return
            if self.open[depth].tag in SCOPES and tag not in SCOPES:
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str | None) -> Element:
    """Element tree of a page; broken markup never fails."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def tables(root: Element, header_as_row: bool = False) -> list[list[dict[str, str]]]:
    """Every table as rows of header -> cell text; elements with a table or grid role count when they are not tables."""
    found = [_table(n, header_as_row) for n in root.walk() if n.tag == "table"]
    found += [_grid(n, header_as_row) for n in root.walk() if n.tag != "table" and n.attrs.get("role") in ("table", "grid")]
    return found


def _labelled(headers: list[str], cells: list[str]) -> dict[str, str]:
    return {name or f"col_{i}": cells[i] if i < len(cells) else "" for i, name in enumerate(headers)}


def _rows(table: Element) -> Iterator[tuple[Element, bool]]:
    """(row, inside thead) of a table, rows of nested tables left out."""
    stack = [(c, False) for c in reversed(table.children) if isinstance(c, Element)]
    while stack:
        node, head = stack.pop()
        if node.tag == "table":
            continue
        if node.tag == "tr":
            yield node, head
            continue
        stack += [(c, head or node.tag == "thead") for c in reversed(node.children) if isinstance(c, Element)]


def _cells(row: Element) -> list[str]:
    return [c.text() for c in row.children if isinstance(c, Element) and c.tag in ("td", "th")]


def _table(table: Element, header_as_row: bool) -> list[dict[str, str]]:
    rows = [(_cells(row), head) for row, head in _rows(table)]
    headers = [cell for cells, head in rows if head for cell in cells]
    if headers:
        body = [cells for cells, head in rows if header_as_row or not head]
    else:
        headers, body = (rows[0][0] if rows else []), [cells for cells, _ in rows[1:]]
    return [_labelled(headers, cells) for cells in body]


def _grid(grid: Element, header_as_row: bool) -> list[dict[str, str]]:
    headers = [n.text() for n in grid.walk() if n.attrs.get("role") == "columnheader"]
    rows = []
    for row in (n for n in grid.walk() if n.attrs.get("role") == "row"):
        head = any(n.attrs.get("role") == "columnheader" for n in row.walk())
        cells = [n.text() for n in row.walk() if n.attrs.get("role") in ("cell", "gridcell")]
        if headers and (header_as_row or not head):
            rows.append(_labelled(headers, cells))
    return rows


def texts(root: Element, tag: str) -> list[str]:
    """Text of every element with the tag."""
    return [n.text() for n in root.walk() if n.tag == tag]


def buttons(root: Element, max_chars: int | None = None) -> list[tuple]:
    """(index, text, tag, id, testid, aria_label) of everything that acts as a button and shows text."""
    found = [
        n for n in root.walk()
        if n.tag == "button" or n.attrs.get("role") == "button" or (n.tag == "input" and n.attrs.get("type") in ("submit", "button"))
    ]
    rows = [
        (i, (n.text() or n.attrs.get("value", "")).strip()[:max_chars], n.tag, n.attrs.get("id") or None,
         n.attrs.get("data-testid") or None, n.attrs.get("aria-label") or None)
        for i, n in enumerate(found)
    ]
    return [row for row in rows if row[1]]


def inputs(root: Element) -> list[tuple]:
    """(index, tag, type, name, id, testid, placeholder, required, is_password) of the fields a user can fill."""
    rows = []
    for i, n in enumerate(n for n in root.walk() if n.tag in ("input", "textarea", "select")):
        if n.tag == "input":
            kind = n.attrs.get("type") or "text"
        elif n.tag == "select":
            kind = "select-multiple" if "multiple" in n.attrs else "select-one"
        else:
            kind = "textarea"
        if kind != "hidden":
            rows.append((i, n.tag, kind, n.attrs.get("name") or None, n.attrs.get("id") or None, n.attrs.get("data-testid") or None,
                         n.attrs.get("placeholder") or None, "required" in n.attrs, kind == "password"))
    return rows
