"""Removal of repetition loops: a greedy rewrite, in Arrow batches; quality.has_loop tells natively whether there is one."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.functions.markup import BLOCK_START

_START = re.compile(BLOCK_START)
_TABLE = re.compile(r"<(/?)table\b", re.I)


def _keys(lines: list[str]) -> list[str]:
    """What a line is compared by; empty for lines that aren't prose, or stand in code, mathematics or a table."""
    out, fence, maths, depth = [], False, False, 0
    for line in lines:
        x = line.strip()
        if x.startswith(("```", "~~~")):
            fence = not fence
        elif x == "$$" and not fence:
            maths = not maths
        opened = [m[1] for m in _TABLE.finditer(x)]
        held = fence or maths or depth + opened.count("") > 0
        depth = max(0, depth + opened.count("") - opened.count("/"))
        prose = not held and not _START.match(line) and x[:1] not in ("<", "!", "|") and sum(map(str.isalpha, x)) >= 15 and len(x) >= 24
        out.append(" ".join(x.split()).casefold() if prose else "")
    return out


def collapse(text: str | None) -> str | None:
    """One copy of each block of one to six prose lines that stands three times or more in a row."""
    if not text:
        return text
    lines = text.splitlines()
    # Cheap first: a loop needs some line of 24 characters or more again.
    long = [" ".join(x.split()).casefold() for x in lines if len(x) >= 24]
    if len(set(long)) == len(long):
        return "\n".join(lines)
    keys, out, i = _keys(lines), [], 0
    while i < len(lines):
        for width in range(1, min(6, (len(lines) - i) // 3) + 1):
            block = keys[i : i + width]
            if not all(block) or sum(map(len, block)) < (40 if width == 1 else 70):
                continue
            n = 1
            while keys[i + n * width : i + (n + 1) * width] == block:
                n += 1
            if n >= 3:
                out += lines[i : i + width]
                i += n * width
                break
        else:
            out.append(lines[i])
            i += 1
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def collapse_loops(texts: pd.Series) -> pd.Series:
    return texts.map(collapse)
