"""Pipe tables of a page text: parsed to cells, repaired, and joined over page marks. Plain Python, linear in the text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import accumulate

from docspark.functions.patterns import CAPTION

_HELD = re.compile(r"`[^`]*`|\\\|")
_RULE = re.compile(r":?-{3,}:?")
_IMAGE_LINE = re.compile(r"!\[[^\]]*\]\([^)]+\)")
_CAPTION = re.compile(CAPTION)
_MARKUP = re.compile(r"<[^>]+>|[*_`]")
ROMAN = dict(zip("IVXLCDM", (1, 5, 10, 50, 100, 500, 1000), strict=True))


def is_row(line: str) -> bool:
    x = line.strip()
    return len(x) > 1 and x[0] == x[-1] == "|"


def cells(line: str) -> list[str]:
    r"""Cells of a row, trimmed; a pipe that is escaped or inside backticks doesn't split."""
    x = line.strip()
    if "`" not in x and "\\|" not in x and "\0" not in x:
        return [c.strip() for c in x.removeprefix("|").removesuffix("|").split("|")]
    x = _HELD.sub(lambda m: m[0].replace("|", "\0"), x).removeprefix("|").removesuffix("|")
    return [c.strip().replace("\0", "|") for c in x.split("|")]


def row(values: list[str]) -> str:
    return "| " + " | ".join(values) + " |"


def is_rule(values: list[str]) -> bool:
    return bool(values) and all(map(_RULE.fullmatch, values))


def rank(cell: str) -> tuple[str, int] | None:
    """(kind, number) of a cell that numbers its row: digits, one letter, or a roman number of two letters or more."""
    token = _MARKUP.sub("", cell).strip().rstrip(".)-:")
    if re.fullmatch(r"\d{1,18}", token):
        return "number", int(token)
    if re.fullmatch("[A-Za-z]", token):
        return "letter", ord(token.lower())
    digits = [ROMAN.get(c) for c in token.upper()]
    if len(digits) > 1 and token.isascii() and all(digits):
        # A sign counts against the sum before a greater one.
        tops = list(accumulate(reversed(digits), max))
        return "roman", sum(d if d == top else -d for d, top in zip(reversed(digits), tops, strict=True))
    return None


def html(rows: list[list[str]]) -> str:
    """An HTML table of rows of cells, the first a header; <br> in a cell stays."""
    safe = lambda c: c.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("&lt;br&gt;", "<br>")
    made = ("".join(f"<{tag}>{safe(c)}</{tag}>" for c in r) for r, tag in zip(rows, ["th", *["td"] * len(rows)], strict=False))
    return "<table>" + "".join(f"<tr>{x}</tr>" for x in made) + "</table>"


@dataclass
class Block:
    """Neighbouring lines of one kind: table, mark (comment, image or caption), blank or text; marks among a table's rows stand apart."""

    kind: str
    lines: list[str] = field(default_factory=list)
    marks: list[str] = field(default_factory=list)
    trimmed: bool = False

    @property
    def headed(self) -> bool:
        return len(self.lines) > 1 and not set(self.lines[1].strip()) - set(" -:+|")


def _kind(line: str) -> str:
    x = line.strip()
    if not x:
        return "blank"
    if is_row(x):
        return "table"
    return "mark" if x.startswith("<!--") and x.endswith("-->") or x[0] == "!" and _IMAGE_LINE.fullmatch(x) or _CAPTION.match(x) else "text"


def blocks(text: str) -> list[Block]:
    """Blocks of a text in order; comments between the rows of a table don't end it."""
    out: list[Block] = []
    for line in text.splitlines():
        kind = _kind(line)
        if out and out[-1].kind == kind:
            out[-1].lines.append(line)
        elif kind == "table" and len(out) > 1 and out[-1].kind == "mark" and out[-2].kind == "table" and all(x.strip().startswith("<!--") for x in out[-1].lines):
            out[-2].marks += out.pop().lines
            out[-1].lines.append(line)
        else:
            out.append(Block(kind, [line]))
    return out


def repaired(text: str) -> tuple[str, int]:
    """(text, number of tables): pipe tables whose second row is their only rule, and whose rows differ in width, as HTML."""
    if "|" not in text:
        return text, 0
    out, n, run = [], 0, []

    def closed() -> list[str]:
        nonlocal n
        parsed = [cells(x) for x in run]
        rules = [i for i, c in enumerate(parsed) if is_rule(c)]
        if rules == [1] and len({len(c) for c in parsed}) > 1:
            n += 1
            return [html([parsed[0], *parsed[2:]])]
        return run

    for line in [*text.splitlines(), None]:
        if line is not None and is_row(line):
            run.append(line)
            continue
        if run:
            out += closed()
            run = []
        if line is not None:
            out.append(line)
    return "\n".join(out), n


def _without_repeats(block: Block) -> list[list[str]]:
    """Rows as cells; those that repeat the header go, with the rules under them."""
    rows = [cells(x) for x in block.lines]
    if not block.headed:
        return rows
    head, out, again = [c.casefold() for c in rows[0]], rows[:2], False
    for r in rows[2:]:
        again = [c.casefold() for c in r] == head or again and not set("".join(r)) - set(" -:+|")
        if not again:
            out.append(r)
    return out


def _trimmed(rows: list[list[str]]) -> list[list[str]]:
    """Without the last columns that are empty but for rules."""
    width = max(map(len, rows))
    used = max((i + 1 for r in rows if not is_rule(r) for i, c in enumerate(r) if c), default=width)
    return rows if used == width else [(r + [""] * used)[:used] for r in rows]


def _continued(first: list[list[str]], rows: list[list[str]], headed: bool) -> list[list[str]] | None:
    """The rows that a table takes from the next one, if that continues it; it may be narrower if it starts with a numbered row."""
    number, own = rank(rows[0][0]), rank(first[0][0])
    if len(rows[0]) < len(first[0]) and own is None and number is not None:
        rows = [r + [":---" if is_rule(r) else ""] * (len(first[0]) - len(r)) for r in rows]
    if len(rows[0]) != len(first[0]):
        return None
    if not headed:
        return rows
    if [c.casefold() for c in rows[0]] == [c.casefold() for c in first[0]]:
        return rows[2:]
    last = rank(first[-1][0])
    follows = last is not None and number is not None and number == (last[0], last[1] + 1)
    return [rows[0], *rows[2:]] if number is not None and (own is None or follows) else None


def merged(text: str) -> str:
    """Pipe tables that only blank lines, comments, images or captions part, as one, where the next continues the one before; what was between follows it."""
    if "|" not in text:
        return text
    out: list[tuple[Block, list[list[str]] | None]] = []
    last = -1  # place of the table that only marks and blank lines follow
    for block in blocks(text):
        if block.kind != "table":
            last = -1 if block.kind == "text" else last
            out.append((block, None))
            continue
        rows = _without_repeats(block)
        before = out[last] if last >= 0 else None
        if before:
            first = before[1] if before[0].trimmed else _trimmed(before[1])
            more = _continued(first, _trimmed(rows), block.headed)
            if more is not None:
                marks = [x for b, _ in out[last + 1 :] if b.kind == "mark" for x in b.lines]
                before[0].marks += [*marks, *block.marks]
                before[0].lines += block.lines
                before[0].trimmed = True
                first += more
                out[last:] = [(before[0], first)]
                continue
        # Rows without a header that open a text are no table's start.
        last = len(out) if block.headed or out else -1
        out.append((block, rows))
    lines: list[str] = []
    for block, rows in out:
        if rows is None:
            lines += block.lines
            continue
        # A row that is as it was keeps its own form.
        given = {tuple(cells(x)): x for x in reversed(block.lines)}
        lines += [given.get(tuple(r)) or row(r) for r in rows] + block.marks
    return "\n".join(lines)
