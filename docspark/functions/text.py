"""Text helpers: native expressions only."""

from __future__ import annotations

import functools
import operator
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line breaks, those that split a text into lines.
BREAK = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"
#: Unicode's white space, as `(?U)\\s` has it.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Words of Latin and Vietnamese letters.
LETTERS = "[a-zA-ZÀ-ỹĐđ]+"
#: Accented Latin letters, lower case, and the plain letters under them.
_FOLDED = [(chr(x), unicodedata.normalize("NFD", chr(x))[0]) for x in (*range(0xE0, 0x250), *range(0x1E00, 0x1F00)) if unicodedata.normalize("NFD", chr(x))[0].isascii() and chr(x).islower()]
ACCENTED = "đ" + "".join(a for a, _ in _FOLDED)
PLAIN = "d" + "".join(p for _, p in _FOLDED)


def let(value: Column, body) -> Column:
    """body(x) with x bound to value: evaluated once, however often body uses it, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.trim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """Stripped, each run of white space one space."""
    return strip(F.regexp_replace(c, r"(?U)\s{2,}|[\s&&[^ ]]", " "))


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def unaccented(c: Column) -> Column:
    """Case-folded, Latin and Vietnamese accents removed, đ as d."""
    return F.translate(F.regexp_replace(casefold(c), "[\\u0300-\\u036F]", ""), ACCENTED, PLAIN)


def lines(c: Column) -> Column:
    """Lines of a text, without an empty one after its last break; none of a null or empty text."""
    return let(F.split(F.coalesce(c, F.lit("")), BREAK, -1), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def words(c: Column, pattern: str = LETTERS) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def tokens(c: Column) -> Column:
    """Parts between white space; none of a blank text."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("int")


def where_signs(c: Column, signs: tuple[str, ...], pattern: str, to: str) -> Column:
    """regexp_replace of a text that holds one of signs, any other as it is: a pattern runs only where it can match."""
    return let(c, lambda t: F.when(functools.reduce(operator.or_, (t.contains(x) for x in signs)), F.regexp_replace(t, pattern, to)).otherwise(t))


def one_of(listed: tuple[str, ...]) -> str:
    """Pattern of a whole word of LETTERS that is one of listed: first letters are looked at first, and each is tried once."""
    ends: dict[str, list[str]] = {}
    for x in listed:
        ends.setdefault(x[0], []).append(x[1:])
    tried = "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in ends.items())
    return f"(?=[{''.join(ends)}])(?<!{LETTERS[:-1]})(?:{tried})(?!{LETTERS[:-1]})"


def letter_class(letters: str) -> str:
    """Class of lower-case letters, in ranges where only upper-case ones are between: for case-folded text."""
    spans: list[list[int]] = []
    for x in sorted(map(ord, letters)):
        if spans and all(chr(y).isupper() for y in range(spans[-1][1] + 1, x)):
            spans[-1][1] = x
        else:
            spans.append([x, x])
    return "[" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in spans) + "]"


def rewrite(c: Column, pattern: str, change) -> Column:
    """Each match of pattern replaced by change(match), a Column function; what is between stays."""
    hits = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    gaps = F.split(c, pattern, -1)
    both = F.transform(F.arrays_zip(gaps.alias("gap"), F.transform(hits, change).alias("hit")), lambda x: F.concat(x["gap"], F.coalesce(x["hit"], F.lit(""))))
    return F.when(c.rlike(pattern), F.array_join(both, "")).otherwise(c)


def longest_run(items: Column, same) -> Column:
    """Length of the longest run of neighbours for which same(earlier, later) holds; 0 of no items."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc, x):
        run = F.when(acc["last"].isNotNull() & same(acc["last"], x), acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(items, start, step, lambda acc: acc["best"])


def case_like(source: Column, target: Column) -> Column:
    """target in the case of source: upper, title or lower."""
    return F.when(source == F.upper(source), F.upper(target)).when(source == F.initcap(source), F.initcap(target)).otherwise(target)
