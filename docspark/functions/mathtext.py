"""Checks of mathematics in Markdown: native expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions.text import count, let

#: A `$` that no backslash precedes; inline mathematics (fixed values).
DOLLAR = r"(?<!\\)\$"
INLINE = r"(?<!\$)\$([^$\n]+)\$(?!\$)"
#: Codes in the order in which they are reported (fixed values).
CODES = ("answer_label_inside_math", "multiple_answers_inside_math", "prose_inside_math", "non_math_math_block", "unbalanced_latex_braces", "incomplete_latex_command", "display_math_inline", "adjacent_math_blocks")


def unbalanced(c: Column) -> Column:
    """An odd number of unescaped `$`."""
    return c.contains("$") & (count(c, DOLLAR) % 2 == 1)


def inline_parts(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(INLINE), F.lit(1))


def errors(c: Column) -> Column:
    """Distinct codes of CODES that a text shows, as an array."""
    return let(inline_parts(c), lambda inner: _errors(c, inner))


def _errors(c: Column, inner: Column) -> Column:
    some = lambda f: F.exists(inner, f)
    tests = {
        "answer_label_inside_math": c.rlike(r"\${1,2}\s*[A-D]\.\s*\${1,2}"),
        "multiple_answers_inside_math": some(lambda x: count(x, r"(?:^|\s)[A-D]\.\s") >= 2),
        "prose_inside_math": some(lambda x: (count(x, "[A-Za-zÀ-ỹĐđ]{3,}") >= 6) & (count(x, r"[=+*/^_{}\\<>]") <= 1)),
        "non_math_math_block": some(lambda x: x.rlike(r"^\s*(?:[A-D]\.|[.,;:!?-]+)\s*$")),
        "unbalanced_latex_braces": some(lambda x: count(x, r"\{") != count(x, r"\}")),
        "incomplete_latex_command": some(lambda x: x.rlike(r"\\(?:frac|sqrt)\s*$|\\frac\s*\{[^{}]*\}\s*$")),
        "display_math_inline": c.rlike(r"\$\$[^$\n]+\$\$\S|\S\$\$[^$\n]+\$\$"),
        "adjacent_math_blocks": c.rlike(r"\${1,2}\s*\${1,2}"),
    }
    return F.array_compact(F.array(*(F.when(tests[k], k) for k in CODES)))
