"""Scores of recognised text against expected text: native expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions.mathtext import unbalanced
from docspark.functions.text import casefold, count, let, lines, squeeze, strip, tokens

#: Numbers and formulas (fixed values).
NUMBER = r"(?<![\p{L}\p{N}_.])-?\d+(?:[.,]\d+)?(?:%|\b)"
#: The first branch ends only where the text ends; strict_math has the form that doesn't.
MATH = r"(?s)\$\$(.+?)\$$|\$(.+?)\$"
STRICT_MATH = r"(?s)\$\$(.+?)\$\$|\$(.+?)\$"
#: Code points from the first on stand for distinct words in word_error_rate: all beyond the surrogates and byte order marks.
FIRST_CODE = 0x10000
CODES = 0x110000 - FIRST_CODE


def normal(c: Column) -> Column:
    """Case-folded, white space squeezed."""
    return squeeze(casefold(F.coalesce(c, F.lit(""))))


def _rate(distance: Column, length: Column, other: Column) -> Column:
    return F.when(length == 0, F.when(other == 0, 0.0).otherwise(1.0)).otherwise(distance / length)


def char_error_rate(expected: Column, actual: Column) -> Column:
    a, b = normal(expected), normal(actual)
    return _rate(F.levenshtein(a, b), F.length(a), F.length(b))


def word_error_rate(expected: Column, actual: Column) -> Column:
    """Edit distance of the word sequences, by the number of expected words.

    Distinct words of both become one character each. Over CODES (1,048,576)
    distinct words raise an error: no text goes without a rate unseen.
    """

    def rate(both):
        a, b, known = both["a"], both["b"], F.array_distinct(F.concat(both["a"], both["b"]))
        as_chars = lambda ws, k: F.array_join(F.transform(ws, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.lit(FIRST_CODE - 1) + F.array_position(k, w)), 8, "0")), "UTF-32")), "")
        return let(known, lambda k: F.when(F.size(k) > CODES, F.raise_error(F.lit("word_error_rate: too many distinct words"))).otherwise(_rate(F.levenshtein(as_chars(a, k), as_chars(b, k)), F.size(a), F.size(b))))

    return let(F.struct(tokens(normal(expected)).alias("a"), tokens(normal(actual)).alias("b")), rate)


def multiset_f1(expected: Column, actual: Column) -> Column:
    """F1 of two arrays as multisets: 1 if both are empty, 0 if one is."""
    times = lambda xs, v: F.size(F.filter(xs, lambda x: x == v))

    def f1(x):
        e, a = x["e"], x["a"]
        matched = F.aggregate(F.array_distinct(e), F.lit(0), lambda n, v: n + F.least(times(e, v), times(a, v)))
        both, none = (F.size(e) == 0) & (F.size(a) == 0), (F.size(e) == 0) | (F.size(a) == 0)
        value = lambda m: F.when(m == 0, 0.0).otherwise(2 * (m / F.size(a)) * (m / F.size(e)) / (m / F.size(a) + m / F.size(e)))
        return F.when(both, 1.0).when(none, 0.0).otherwise(let(matched, value))

    return let(F.struct(expected.alias("e"), actual.alias("a")), f1)


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0))


def formulas(c: Column, strict: bool = False) -> Column:
    pattern = STRICT_MATH if strict else MATH
    parts = F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)).alias("block"), F.regexp_extract_all(c, F.lit(pattern), F.lit(2)).alias("inline"))
    return F.transform(parts, lambda x: squeeze(F.when(x["block"] != "", x["block"]).otherwise(x["inline"])))


def table_rows(c: Column) -> Column:
    """cells:n of each pipe row that isn't a separator."""
    cells = lambda x: F.transform(F.split(F.regexp_replace(strip(x), r"^\|+|\|+$", ""), r"\|", -1), strip)
    rows = F.transform(F.filter(lines(c), lambda x: count(x, r"\|") >= 2), cells)
    return F.transform(F.filter(rows, lambda r: ~F.forall(r, lambda x: x.rlike(r"^:?-{3,}:?$"))), lambda r: F.concat(F.lit("cells:"), F.size(r).cast("string")))


def list_items(c: Column) -> Column:
    """ordered or unordered for each list item."""
    items = F.filter(F.transform(lines(c), strip), lambda x: x.rlike(r"^(?:[-*+] |\d+[.)] )"))
    return F.transform(items, lambda x: F.when(x.rlike(r"^\d"), "ordered").otherwise("unordered"))


def markdown_errors(c: Column) -> Column:
    """Odd code fences, odd `$`, and lines with a single pipe, as an array of codes."""
    bad = F.filter(F.transform(lines(c), lambda x, i: F.when(count(x, r"\|") == 1, F.concat(F.lit("malformed_table_line:"), (i + 1).cast("string")))), lambda x: x.isNotNull())
    return F.concat(F.array_compact(F.array(F.when(count(c, "```") % 2 == 1, "unclosed_code_fence"), F.when(unbalanced(c), "unbalanced_inline_math"))), bad)


def scores(expected: Column, actual: Column) -> Column:
    """All scores as a struct."""
    same = lambda f: F.array_sort(f(expected)) == F.array_sort(f(actual))
    errors = markdown_errors(actual)
    return F.struct(
        char_error_rate(expected, actual).alias("cer"), word_error_rate(expected, actual).alias("wer"), (F.size(errors) == 0).alias("markdown_valid"), F.array_join(errors, ";").alias("markdown_errors"),
        multiset_f1(numbers(expected), numbers(actual)).alias("numbers_f1"), same(numbers).alias("numbers_exact"),
        multiset_f1(formulas(expected), formulas(actual)).alias("formulas_f1"), same(formulas).alias("formulas_exact"),
        multiset_f1(table_rows(expected), table_rows(actual)).alias("table_f1"), multiset_f1(list_items(expected), list_items(actual)).alias("list_f1"),
    )
