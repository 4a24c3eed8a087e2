"""Repair of a whole page text: a pass over its lines for each kind of damage, with a count of what it mended.

A text is a list of lines. Passes that need to know whether a line is code or
display mathematics ask states(). All passes are linear in the text; the final
text of a repaired text is that text.
"""

from __future__ import annotations

import re
from collections import Counter

from docspark.functions import choices, htmltables, loops, pipes
from docspark.functions.markup import BLOCK_START, IMAGE, IMAGE_TARGET, TABLE, TABLE_TAGS
from docspark.functions.patterns import GENERIC_FOOTER, PAGE_FOOTER, PAGE_MARKER, PAGE_NUMBER, SHORT_NUMBER, python

#: What the report counts, in order.
COUNTS = (
    "headings", "headings_split", "paragraph_lines_joined", "list_lines_joined", "tables_repaired", "tables_converted", "html_tags_closed",
    "math_normalised", "image_paths", "duplicate_images", "page_artifacts_removed", "repetition_lines_removed", "spell_fixed", "spell_warnings",
)
#: Signs that end a sentence, and those after which a line isn't stitched to the next page (fixed values).
ENDS = tuple(".!?:;。！？")
NO_STITCH = re.compile(r"[.!?:;#`|*$]")
GLUED = re.compile(r"(?<!\s)\s+(?=#{1,6}\s+\S)")
#: A heading that ends in bold capitals, at least so many letters of them, is two.
BOLD_END = re.compile(r"(#{1,6})\s+(.+?)\s+(\*\*([^*]+)\*\*)\s*")
BOLD_LETTERS = 8
#: What a line of BLOCK_START may begin with, decimals aside.
_BLOCK_SIGNS = frozenset("#-+*>`~<|!$")
#: First signs of GENERIC_FOOTER, in any case.
_GENERIC_SIGNS = frozenset("#iIİısSſmMtTpP")
_BLOCK, _ITEM, _IMAGE = re.compile(BLOCK_START), re.compile(r"\s*(?:[-+*]|\d+[.)])\s"), re.compile(IMAGE)
_ESCAPED = re.compile(r"!\[[^\]\n]*\]\\\([^)\n]*\)")
_INDENTED = re.compile(r"^(?: {4,}|\t+)(!\[[^\]\n]*\]\([^)\n]+\))[ \t]*$", re.M)
_PLACEHOLDER = re.compile(rf"!\[[^\]\n]*\]\(\s*{IMAGE_TARGET}\s*\)|<img\b[^>]*{IMAGE_TARGET}[^>]*>|(?<![\w/.-]){IMAGE_TARGET}(?![\w/.-])", re.I)
_TABLES = re.compile(TABLE)
_TAG_LINE = re.compile(r"^\s*(</?(?:table|thead|tbody|tfoot|tr|th|td)\b[^>]*>)", re.I)
_MARKER = re.compile(PAGE_MARKER)
_HEAD, _REMOTE, _DOTS, _BLANKS, _DIGIT = re.compile(r"#{1,6}\s*\S"), re.compile(r"(?i)https?://|data:"), re.compile(r"^(?:\./)+"), re.compile(r"\n{3,}"), re.compile(r"\d")
_FOOTER, _GENERIC, _NUMBER, _SHORT = (re.compile(python(p)) for p in (PAGE_FOOTER, GENERIC_FOOTER, PAGE_NUMBER, SHORT_NUMBER))


def states(lines: list[str]) -> list[str]:
    """fence, code, math or nothing for each line; a fence and a line of $$ are as what they open."""
    whole = "\n".join(lines)
    if "```" not in whole and "~~~" not in whole and "$$" not in whole:
        return [""] * len(lines)
    out, code, math = [], False, False
    for line in lines:
        x = line.strip()
        if x.startswith(("```", "~~~")):
            code = not code
            out.append("fence")
        elif x == "$$" and not code:
            math = not math
            out.append("math")
        else:
            out.append("code" if code else "math" if math else "")
    return out


def _heading(line: str) -> tuple[int, str] | None:
    """(level, text) of a heading, its closing marks gone; None of a line without text after the marks."""
    x = line.strip()
    body = x.lstrip("#")
    return (len(x) - len(body), body.strip().rstrip("#").rstrip()) if len(body) < len(x) and body.strip(" #\t") else None


def headings(lines: list[str], n: Counter) -> list[str]:
    """Headings that share a line apart; `#` marks spaced, at most six, and at most one level below the heading before."""
    parts: list[tuple[str, bool]] = []
    for line, state in zip(lines, states(lines), strict=True):
        if "#" not in line:
            parts.append((line, False))
            continue
        free = state in ("", "math")
        found = [line]
        if free and _HEAD.match(line.lstrip()):
            found = GLUED.split(line)
            bold = BOLD_END.fullmatch(line.lstrip()) if len(found) == 1 and line.rstrip().endswith("**") else None
            letters = re.sub(r"[^A-Za-zÀ-ỹĐđ]", "", bold[4]) if bold else ""
            if len(letters) >= BOLD_LETTERS and letters.isupper():
                found = [f"{bold[1]} {bold[2]}", f"{bold[1]} {bold[3]}"]
        n["headings_split"] += len(found) - 1
        parts += [(x, free) for x in found]
    out, level = [], 6
    for line, free in parts:
        head = _heading(line) if free else None
        if head:
            level = min(head[0], level + 1, 6)
            fixed = f"{'#' * level} {head[1]}"
            n["headings"] += fixed != line
            line = fixed
        out.append(line)
    return out


def flow(lines: list[str], n: Counter) -> list[str]:
    """Lines that go on with a sentence, or with a list item, joined to it.

    A line of prose goes on with the prose before it if that has no sentence's
    end and the line starts in lower case or indented; with an item, if it starts
    in lower case.
    """
    out: list[str] = []
    open_ = ended = None
    for line, state in zip(lines, states(lines), strict=True):
        x = line.strip()
        block = bool(x) and (x[0] in _BLOCK_SIGNS or x[0].isdecimal())
        if state or not x or block and _BLOCK.match(line):
            out.append(line.rstrip() if state in ("", "fence") or x == "$$" else line)
            open_ = "item" if not state and block and _ITEM.match(line) else None
            # An item's own end doesn't part it from a line in lower case.
            ended = True
            continue
        low = x[0].islower()
        if open_ and not ended and (low or line[0].isspace()):
            n["paragraph_lines_joined"] += 1
        elif open_ == "item" and low:
            n["list_lines_joined"] += 1
        else:
            out.append(x)
            open_, ended = "prose", x.endswith(ENDS)
            continue
        out[-1] = f"{out[-1].rstrip()} {x}"
        ended = x.endswith(ENDS)
    return out


def artifacts(lines: list[str], n: Counter, footers: re.Pattern | None = None) -> list[str]:
    """Without page numbers and footers that stand alone on a line.

    A page ends at the next marker. Numbers go among its first three visible
    lines, if a marker opens it, and its last five; `footers` is a pattern of a
    publication's own lines, which go anywhere, with a number just before.
    """
    pages: list[list[str]] = [[]]
    for line in lines:
        if "<!--" in line and _MARKER.fullmatch(line):
            pages.append([])
        pages[-1].append(line)
    out: list[str] = []
    for k, page in enumerate(pages):
        bare = [x.strip() for x in page]
        total, seen = len(page) - bare.count(""), 0
        for i, (line, x) in enumerate(zip(page, bare, strict=True)):
            shown = x != ""
            seen += shown
            # A footer has a digit or one of the first signs, if it isn't the publication's own.
            if not shown or k and not i or footers is None and x[0] not in _GENERIC_SIGNS and not _DIGIT.search(x):
                out.append(line)
                continue
            near_end = total - seen <= 4
            near_start = k > 0 and seen - 2 <= 2
            own = False
            if footers is not None:
                after = next((y for y in page[i + 1 : i + 3] if y.strip()), "")
                own = footers.fullmatch(line) or _SHORT.fullmatch(line) and footers.fullmatch(after)
            if own or "/" in x and _FOOTER.fullmatch(line) or near_end and _GENERIC.fullmatch(line) or (near_end or near_start) and _NUMBER.fullmatch(line):
                n["page_artifacts_removed"] += 1
            else:
                out.append(line)
    return out


def stitch(lines: list[str], n: Counter) -> list[str]:
    """A sentence that a page marker cuts, on one line with the marker; a hyphen before the cut goes.

    At most two blank lines stand on either side of the marker; the line before
    has text after its last sentence's end, the line after starts in lower case.
    """
    out: list[str] = []
    i = 0
    while i < len(lines):
        line = lines[i]
        i += 1
        if "<!--" in line and _MARKER.fullmatch(line):
            back = next((k for k in (1, 2, 3) if len(out) >= k and out[-k].strip()), 0)
            ahead = next((k for k in (0, 1, 2) if i + k < len(lines) and lines[i + k].strip()), None)
            before = out[-back].rstrip() if back else ""
            tail = NO_STITCH.split(before)[-1]
            if ahead is not None and re.search(r"[^\s>-]", tail) and lines[i + ahead].strip()[0].islower():
                n["paragraph_lines_joined"] += 1
                del out[-back:]
                out.append(f"{before[: -before.endswith('-') or None]} {line.strip()} {lines[i + ahead].lstrip()}")
                i += ahead + 1
                continue
        out.append(line)
    return out


def images(text: str, n: Counter) -> str:
    """Local targets with forward slashes and no leading ./, alternative texts trimmed; each target once."""
    seen: set[str] = set()

    def change(m: re.Match) -> str:
        given = m[2].strip().strip("<>")
        target = given if _REMOTE.match(given) else _DOTS.sub("", given.replace("\\", "/"))
        n["image_paths"] += target != given
        if target.casefold() in seen:
            n["duplicate_images"] += 1
            return ""
        seen.add(target.casefold())
        return f"![{m[1].strip()}]({target})"

    return _IMAGE.sub(change, text)


def placeholders(text: str) -> str:
    if "image_placeholder" not in text.lower():
        return text
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+$", "", _PLACEHOLDER.sub("", text), flags=re.M)).strip()


def html_tables(text: str, n: Counter) -> str:
    """Table tags that are opened but not closed, closed at the end; complete tables without blank lines, their tags at the start of a line."""
    low = text.casefold()
    if "<table" not in low:
        return text
    missing = [t for t in TABLE_TAGS for _ in range(len(re.findall(rf"<{t}\b", low)) - len(re.findall(rf"</{t}\s*>", low)))]
    n["html_tags_closed"] += len(missing)
    if missing:
        text = text.rstrip() + "\n" + "".join(f"</{t}>" for t in missing)
    return _TABLES.sub(lambda m: "\n".join(_TAG_LINE.sub(r"\1", x) for x in m[0].splitlines() if x.strip()), text)


def mathematics(text: str) -> str:
    """Entities, fills and stray delimiters of table cells gone; answer labels outside mathematics; delimiters balanced."""
    text = re.sub(r"&(?:nbsp|amp);", " ", text) if "&" in text else text
    if "<td" in text.lower():
        text = re.sub(r"(<td\b[^>]*>)\s*([+-])\$\s*(</td>)", r"\1$\2$\3", text, flags=re.I)
        text = re.sub(r"(</td>)\s*\$\s*(?=<td\b)|(<td\b[^>]*>)\s*\$\s*(</td>)\s*\$?", lambda m: (m[1] or "") + (m[2] or "") + (m[3] or ""), text, flags=re.I)
    return choices.balance(choices.answer_math(text))


def finalised(text: str, footers: re.Pattern | None = None, correct=None) -> tuple[str, Counter]:
    """(repaired text, counts by COUNTS) of one text; correct gives (text, words that it changed or would change) and is applied if it says so."""
    n: Counter = Counter()
    out = text
    if "![" in out:
        out = _ESCAPED.sub(lambda m: m[0].replace("]\\(", "](").replace("\\_", "_"), out) if "]\\(" in out else out
        out = _INDENTED.sub(r"\1", out) if "    ![" in out or "\t![" in out else out
    out = placeholders(out)
    lines = out.splitlines()
    kept = (loops.collapse(out) or "").splitlines()
    n["repetition_lines_removed"] = len(lines) - len(kept)
    lines = flow(headings(kept, n), n)
    lines = images("\n".join(lines), n).split("\n")
    lines = stitch(artifacts(lines, n, footers), n)
    out = html_tables("\n".join(lines), n)
    out = (_BLANKS.sub("\n\n", out) if "\n\n\n" in out else out).strip()
    out, n["tables_repaired"] = pipes.repaired(out)
    out = pipes.merged(htmltables.joined(out))
    before = htmltables.number(out)
    out = htmltables.simple_to_pipes(out)
    n["tables_converted"] = before - htmltables.number(out)
    if n["tables_converted"]:
        out = pipes.merged(out)
    mended = mathematics(out)
    n["math_normalised"] = int(mended != out)
    out = placeholders(mended)
    if correct:
        out, n["spell_fixed"], n["spell_warnings"] = correct(out)
    return out, n
