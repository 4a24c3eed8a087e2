"""HTML tables of a page text, parsed: structure, conversion to pipe tables, joining. Plain Python."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np

from docspark.functions.pipes import row


class _Cells(HTMLParser):
    """Rows of (colspan, rowspan, header, text) of one table; 0 for a span that is no number."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[list]] = []
        self.open = False
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
            self.open = False
        elif tag in ("td", "th") and self.rows:
            spans = []
            for name in ("colspan", "rowspan"):
                value = dict(attrs).get(name, "1")
                spans.append(max(1, int(value)) if re.fullmatch(r"\s*[+-]?\d+\s*", value or "") else 0)
            self.rows[-1].append([*(spans if all(spans) else (0, 0)), tag == "th", ""])
            self.open = True
        elif tag == "br" and self.open:
            self.rows[-1][-1][3] += "<br>"

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr"):
            self.open = False

    def handle_data(self, data):
        if self.open:
            self.rows[-1][-1][3] += data


_TABLE = re.compile(r"<table\b.*?</table>", re.I | re.S)
_OPEN = re.compile(r"<table\b", re.I)


def number(text: str) -> int:
    return len(_OPEN.findall(text)) if "<table" in text.lower() else 0


#: Rows of plain cells, without attributes, references, further tags or anything between: read without a parser.
_PLAIN = re.compile(r"<table>\s*(?:<tr>\s*(?:<(?:td>[^<&]*</td|th>[^<&]*</th)>\s*)+</tr>\s*)+</table>")
_PLAIN_CELL = re.compile(r"<t([dh])>([^<]*)<")


def _rows(source: str) -> list[list[list]]:
    """Rows of _Cells of one table."""
    if not _PLAIN.fullmatch(source):
        return _Cells(source).rows
    return [[[1, 1, kind == "h", text] for kind, text in _PLAIN_CELL.findall(r)] for r in source.split("</tr>")[:-1]]


#: A span of more columns, or rows, counts as so many (fixed values, those of the HTML standard).
MOST_COLUMNS, MOST_ROWS = 1000, 65534


def structure_errors(text: str | None) -> list[str]:
    """Span and width errors of the tables of a text that hold no other table, each code once.

    The cells of a table are laid on a grid that counts how many cover each
    place. A place covered twice is an overlap; rows that reach to different
    columns are inconsistent; so is a span that is no number (invalid).
    """
    codes: list[str] = []
    for source in _TABLE.findall(text or ""):
        if number(source) == 1:
            codes += (f"malformed_html_table:{c}" for c in _grid_errors(_Cells(source).rows))
    return list(dict.fromkeys(codes))


def _grid_errors(rows: list[list[list]]) -> list[str]:
    spans = [[(min(c[0], MOST_COLUMNS), min(c[1], MOST_ROWS)) for c in r if c[0]] for r in rows]
    width = 1 + 2 * max((sum(columns for columns, _ in r) for r in spans), default=0)
    while (laid := _laid(spans, width)) is None:
        width *= 2
    overlap, reach = laid
    found = [("invalid_span", any(not c[0] for r in rows for c in r)), ("overlapping_span", overlap), ("inconsistent_logical_columns", len({x for x in reach if x}) > 1)]
    return [code for code, is_so in found if is_so]


def _laid(rows: list[list[tuple[int, int]]], width: int) -> tuple[bool, list[int]] | None:
    """(whether a place is covered twice, columns that each row reaches); None if the grid is too narrow."""
    cover = np.zeros((len(rows), width + 1), np.int16)
    for y, cells in enumerate(rows):
        x = 0
        for columns, down in cells:
            # The next place that no cell from above, nor one of this row, covers.
            x += int((cover[y, x:] == 0).argmax())
            if x + columns > width:
                return None
            cover[y : y + down, x : x + columns] += 1
            x += columns
    return bool((cover > 1).any()), [int(np.flatnonzero(r)[-1]) + 1 if r.any() else 0 for r in cover]


def simple_to_pipes(text: str | None) -> str | None:
    """Plain HTML tables as pipe tables.

    A table stays HTML if it holds another, spans cells, has fewer than two rows
    or columns, or a header that isn't the widest row. Short rows are padded, and
    rows that repeat the header go.
    """

    def change(m: re.Match) -> str:
        if len(_OPEN.findall(m[0])) > 1:
            return m[0]
        rows = [r for r in _rows(m[0]) if r]
        if len(rows) < 2 or any(c[:2] != [1, 1] for r in rows for c in r):
            return m[0]
        cells = [[" ".join(c[3].split()).replace("|", "\\|") for c in r] for r in rows]
        width = len(cells[0])
        if width < 2 or any(len(r) > width for r in cells):
            return m[0]
        body = [r + [""] * (width - len(r)) for r in cells[1:] if r != cells[0]]
        return "\n".join([row(cells[0]), row(["---"] * width), *map(row, body)])

    return text if text is None or "<table" not in text.lower() else _TABLE.sub(change, text)


_SHELL = re.compile(r"<!doctype\s+html[^>]*>|</?(?:html|head|body)\b[^>]*>|<meta\b[^>]*>", re.I)
_BRIDGE = re.compile(r"<!--.*?-->|!\[[^\]]*\]\([^)]+\)|^[^\S\n]*(?:hình|ảnh|figure|nguồn\s*:)[^\n]*$", re.I | re.S | re.M)


def joined(text: str | None) -> str | None:
    """HTML tables that only comments, images or captions part, as one; what was between follows it. Document shells go."""
    if text is None or "<" not in text:
        return text
    parts, last = [], 0
    source = _SHELL.sub("", text)
    if "<table" not in source.lower():
        return source
    for m in re.finditer(r"<table\b[^>]*>.*?</table>", source, re.I | re.S):
        parts += [("gap", source[last : m.start()]), ("table", m[0])]
        last = m.end()
    out, bridge = [], ""
    for kind, part in [*parts, ("gap", source[last:])]:
        if kind == "table" and out and out[-1][0] == "table":
            opened = re.sub(r"(?i)</table>\s*\Z", "", out[-1][1])
            out[-1][1] = opened + re.sub(r"(?i)\A<table\b[^>]*>", "", part)
        elif kind == "gap" and out and out[-1][0] == "table" and not _BRIDGE.sub("", part).strip():
            bridge += part
        else:
            if bridge.strip():
                out.append(["gap", bridge])
            elif bridge:
                part = bridge + part
            bridge = ""
            out.append([kind, part])
    return "".join(p for _, p in [*out, ["gap", bridge]])
