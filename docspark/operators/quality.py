"""Quality gate of pages: error codes, weights, score, best attempt, completeness.

Everything is a projection over the page text (higher-order functions on its
lines), so a gate over any number of pages has no shuffle; only the choice among
attempts and the completeness of documents group rows.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.functions import markup, mathtext
from docspark.functions.text import LETTERS, casefold, count, let, letter_class, lines, longest_run, one_of, squeeze, strip, tokens, where_signs, words

#: Weight of each kind of error (fixed values); any other kind weighs OTHER_WEIGHT.
WEIGHTS = {
    "empty_page": 100, "missing_pages": 100, "duplicate_pages": 80, "repetition_loop": 50, "missing_image": 40,
    "unresolved_placeholder": 35, "truncated_page": 35, "malformed_markdown_table": 25, "malformed_html_table": 25,
    "unclosed_code_blocks": 25, "repeated_words": 20, "unbalanced_latex_braces": 15, "incomplete_latex_command": 15,
    "unbalanced_math_delimiters": 15, "answer_label_inside_math": 10, "multiple_answers_inside_math": 10,
    "prose_inside_math": 10, "non_math_math_block": 10, "display_math_inline": 10, "adjacent_math_blocks": 10,
    "missing_vietnamese_diacritics": 10, "unclosed_inline_code": 10, "glued_words": 5,
}
OTHER_WEIGHT = 20
#: Errors that no page passes with (fixed values).
FATAL = ("empty_page", "missing_pages", "duplicate_pages", "repetition_loop", "truncated_page")
PASS = 80
#: Word lists of the language profile (fixed values).
VI_FUNCTION = ("cua", "va", "la", "trong", "duoc", "cho", "voi", "tu", "den", "mot", "nhung", "cac", "nay", "theo", "tai", "ve", "khi", "co")
VI_COMMON = (*VI_FUNCTION, "viet", "nam", "nguoi", "nuoc", "thanh", "pho", "du lich", "phat trien", "chuong trinh", "hoat dong", "thong tin", "doanh nghiep", "thi truong")
EN_COMMON = ("the", "and", "is", "are", "of", "to", "in", "for", "with", "from", "this", "that", "was", "were", "by", "on", "as", "an", "be", "or")
VI_MARKS = "ăâđêôơưáàảãạấầẩẫậắằẳẵặéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ"
GLUE_SIGNS = ("cua", "va", "la", "trong", "duoc", "nhung", "mot", "cho", "voi", "viet", "nam")


def kind(error: Column) -> Column:
    return F.substring_index(error, ":", 1)


def weight(error: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair))
    return F.coalesce(F.element_at(table, kind(error)), F.lit(OTHER_WEIGHT))


def penalty(errors: Column) -> Column:
    return F.aggregate(errors, F.lit(0), lambda n, e: n + weight(e))


def score(errors: Column) -> Column:
    return F.greatest(F.lit(0), F.lit(100) - penalty(errors)).cast("double")


def fatal(errors: Column) -> Column:
    return F.filter(errors, lambda e: kind(e).isin(*FATAL))


def should_retry(errors: Column) -> Column:
    """Fatal, below the pass mark, an error of weight 30 or more, or lost diacritics."""
    return (F.size(fatal(errors)) > 0) | (score(errors) < PASS) | F.exists(errors, lambda e: (weight(e) >= 30) | (kind(e) == "missing_vietnamese_diacritics"))


# Repetition


def visible_lines(c: Column) -> Column:
    """Stripped lines that aren't blank or comments."""
    return F.filter(F.transform(lines(c), strip), lambda x: (x != "") & ~x.startswith("<!--"))


def line_run(c: Column) -> Column:
    """Longest run of equal visible lines of six characters or more, heading marks and case aside."""
    return _line_run(visible_lines(c))


def _compared(x: Column) -> Column:
    """A visible line without heading marks and case."""
    return casefold(F.when(x.startswith("#"), strip(F.regexp_replace(x, r"^#{1,6}\s+", ""))).otherwise(x))


def _line_run(shown: Column) -> Column:
    return longest_run(F.transform(shown, _compared), lambda a, b: (a == b) & (F.length(b) >= 6))


def word_run(c: Column, least_words: int = 8) -> Column:
    """Longest run of equal neighbouring words in a line of least_words or more, case aside."""
    each = F.transform(visible_lines(c), lambda x: words(x, "[a-zA-ZÀ-ỹĐđ0-9]+"))
    runs = F.transform(F.filter(each, lambda w: F.size(w) >= least_words), lambda w: longest_run(F.transform(w, casefold), lambda a, b: a == b))
    return F.coalesce(F.array_max(runs), F.lit(0))


def four_lines(c: Column) -> Column:
    """line_run of four or more. Runs are counted only in texts of which some line stands twice."""
    each = lambda shown: let(F.filter(F.transform(shown, _compared), lambda x: F.length(x) >= 6), lambda x: F.size(F.array_distinct(x)) < F.size(x))
    return let(visible_lines(c), lambda shown: F.when(F.size(shown) >= 4, F.when(each(shown), _line_run(shown) >= 4).otherwise(False)).otherwise(False))


def _loop_lines(c: Column) -> Column:
    """Lines without what is protected: code, mathematics and tables are one sign each."""
    safe = where_signs(F.coalesce(c, F.lit("")), ("```", "~~~"), r"(?ms)^[^\S\n]*(?:```|~~~).*?(?:^[^\S\n]*(?:```|~~~)[^\n]*$|\z)", "```")
    safe = where_signs(safe, ("$$",), r"(?ms)^[^\S\n]*\$\$[^\S\n]*$.*?(?:^[^\S\n]*\$\$[^\S\n]*$|\z)", "\\$\\$")
    return lines(where_signs(safe, ("<",), r"(?is)<table\b.*?(?:</table>|\z)", "<t>"))


def has_loop(c: Column) -> Column:
    """A block of one to six prose lines, 40 characters (one line) or 70 in all, that stands three times in a row."""
    # Cheap first: a loop needs some line of 24 characters or more again.
    twice = lambda rows: let(F.transform(F.filter(rows, lambda x: F.length(x) >= 24), lambda x: casefold(squeeze(x))), lambda long: F.size(F.array_distinct(long)) < F.size(long))
    fit = lambda x: ~x.rlike(markup.BLOCK_START) & ~x.rlike(r"^\s*[<!|]") & x.rlike(r"\A(?:\P{L}*+\p{L}){15}") & (F.length(strip(x)) >= 24)
    norm = lambda rows: F.transform(rows, lambda x: F.when(fit(x), casefold(squeeze(x))).otherwise(""))
    return let(_loop_lines(c), lambda rows: F.when(twice(rows), let(norm(rows), _loops)).otherwise(False))


def _loops(norm: Column) -> Column:
    n = F.size(norm)
    at = lambda i: F.get(norm, i - 1)

    def repeats(width: int) -> Column:
        offsets = range(width)
        same = lambda i: functools.reduce(operator.and_, ((at(i + k) != "") & (at(i + k) == at(i + k + width)) & (at(i + k) == at(i + k + 2 * width)) for k in offsets))
        size = lambda i: sum((F.length(at(i + k)) for k in offsets), F.lit(0))
        found = F.exists(F.sequence(F.lit(1), n - 3 * width + 1), lambda i: same(i) & (size(i) >= (40 if width == 1 else 70)))
        return F.when(n >= 3 * width, found).otherwise(False)

    return functools.reduce(operator.or_, (repeats(width) for width in range(1, 7)))


# Language


def _running(c: Column) -> Column:
    """A text without code, mathematics, addresses and HTML tables; of a link only its label stays."""
    t = where_signs(F.coalesce(c, F.lit("")), ("```",), r"(?s)```.*?```", "")
    t = where_signs(t, ("`",), r"`[^`]*`", "")
    t = where_signs(t, ("$",), r"(?s)\$\$.*?\$\$|\$[^$\n]*\$", "")
    t = where_signs(t, ("](",), r"!?\[([^\]]*)\]\([^)]+\)", "$1")
    t = where_signs(t, ("://", "@"), r"(?i)https?://\S+|\b\S[^\s@]*+@\S[^\s.]*+\.\S+\b", "")
    return where_signs(t, ("<",), r"(?is)<table\b.*?</table>", "")


def _sentences(c: Column) -> Column:
    """Lines of running text, heading marks aside: tables and short, upper-case or numeric lines left out."""
    # Whether there are 60 letters and 12 tokens is seen from the start of a line, and a lower-case ASCII letter tells that it isn't upper case.
    long = lambda x: (F.length(x) >= 60) & x.rlike(r"(?U)\A\s*+(?:\S++\s++){11}\S") & x.rlike(r"\A(?:\P{L}*+\p{L}){60}")
    good = lambda x: long(x) & (x.rlike("[a-z]") | (x != F.upper(x))) & (count(x, r"\p{Nd}") <= 0.2 * F.length(x))
    plain = lambda x: F.when(x.startswith("#"), F.regexp_replace(x, r"^#{1,6}\s+", "")).otherwise(x)
    shown = F.filter(F.transform(lines(c), strip), lambda x: (F.length(x) >= 60) & ~x.startswith("|") & ~x.startswith("<!--"))
    return F.filter(F.transform(shown, plain), good)


def prose(c: Column) -> Column:
    """Paragraphs of running text: code, mathematics, links, addresses, tables and short, upper-case or numeric lines left out."""
    return F.filter(F.transform(F.split(_running(c), r"\n\s*\n"), lambda b: strip(F.array_join(_sentences(b), " "))), lambda p: p != "")


def language_profile(c: Column) -> Column:
    """mixed_vi_en, vi, en or unknown, by three function words or marks of either."""
    return let(casefold(F.array_join(_sentences(_running(c)), " ")), _profile)


#: Words that tell a language, in case-folded text: of Vietnamese also those with one of its marks, each from its first mark to its end.
VI_WORD = f"[à-ỹ&&{letter_class(VI_MARKS)}]{LETTERS[:-1]}*+|{one_of(VI_FUNCTION)}"
EN_WORD = one_of(EN_COMMON)


def _profile(low: Column) -> Column:
    vi, en = count(low, VI_WORD) >= 3, count(low, EN_WORD) >= 3
    return F.when(vi, F.when(en, "mixed_vi_en").otherwise("vi")).when(en, "en").otherwise("unknown")


def _loss(segment: Column) -> Column:
    """Points for a Vietnamese sentence without its marks; 0 under eight words, or without three function words."""
    scored = lambda low: let(F.struct(words(low).alias("words"), tokens(segment).alias("parts")), lambda x: F.when(F.size(x["words"]) >= 8, _points(low, x["words"], x["parts"])).otherwise(0))
    return let(casefold(segment), lambda low: F.when(count(low, one_of(VI_FUNCTION)) >= 3, scored(low)).otherwise(0))


def _function_hits(w: Column) -> Column:
    """Under three of these, no sentence reaches six points."""
    return F.size(F.filter(w, lambda x: x.isin(*VI_FUNCTION)))


def _points(low: Column, w: Column, parts: Column) -> Column:
    hits = _function_hits(w)
    phrases = sum(((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t) for t in VI_COMMON), F.lit(0))
    english = F.size(F.filter(w, lambda x: x.isin(*EN_COMMON)))
    marks = count(low, f"[{VI_MARKS}]") / F.greatest(count(low, r"\p{L}"), F.lit(1))
    technical = F.size(F.filter(parts, lambda x: x.rlike(r"\d|[_/@]"))) / F.greatest(F.size(parts), F.lit(1))
    distinct = F.size(F.array_intersect(w, F.array(*(F.lit(x) for x in VI_FUNCTION))))
    return (
        F.when(hits >= 3, 3).otherwise(0) + F.when((phrases >= 5) | (distinct >= 4), 2).otherwise(0) + F.when(F.size(w) >= 18, 1).otherwise(0)
        + F.when(marks < 0.02, 2).otherwise(0) - F.when(technical >= 0.15, 3).otherwise(0) - F.when((english >= 4) & (english > hits), 4).otherwise(0)
    )


def diacritic_loss(c: Column) -> Column:
    """Struct of high, medium and segments: sentences that lost their marks for sure, likely, and all.

    A text with fewer than three Vietnamese function words has none of either,
    and isn't cut into sentences, unless something is taken out of it that may
    leave one.
    """
    none = F.struct(F.lit(0).alias("high"), F.lit(0).alias("medium"), F.lit(0).alias("segments"))
    return F.when((count(casefold(c), one_of(VI_FUNCTION)) >= 3) | c.rlike(r"[`$@<]|\]\(|://"), _diacritic_loss(c)).otherwise(none)


def _diacritic_loss(c: Column) -> Column:
    segments = F.filter(F.flatten(F.transform(prose(c), lambda p: F.split(p, r"(?<=[.!?;:])\s+|\n+"))), lambda s: strip(s) != "")
    return let(F.transform(segments, _loss), lambda points: F.struct(F.size(F.filter(points, lambda p: p >= 7)).alias("high"), F.size(F.filter(points, lambda p: p == 6)).alias("medium"), F.size(points).alias("segments")))


# Tables


def pipe_errors(c: Column) -> Column:
    """malformed_markdown_table:line for each run of pipe rows of different widths, named by its first line."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("first"), F.lit(0).alias("width"), F.lit(False).alias("bad"), F.array().cast("array<string>").alias("out"))

    def closed(acc):
        return F.when(acc["bad"], F.array_append(acc["out"], F.concat(F.lit("malformed_markdown_table:"), acc["first"].cast("string")))).otherwise(acc["out"])

    def step(acc, line):
        x = strip(line)
        row = x.startswith("|") & x.endswith("|")
        wide = count(x, r"\|") - 1
        n = acc["n"] + 1
        opened = F.struct(n.alias("n"), n.alias("first"), wide.alias("width"), F.lit(False).alias("bad"), acc["out"].alias("out"))
        more = F.struct(n.alias("n"), acc["first"].alias("first"), acc["width"].alias("width"), (acc["bad"] | (wide != acc["width"])).alias("bad"), acc["out"].alias("out"))
        ended = F.struct(n.alias("n"), F.lit(0).alias("first"), F.lit(0).alias("width"), F.lit(False).alias("bad"), closed(acc).alias("out"))
        return F.when(row & (acc["first"] == 0), opened).when(row, more).otherwise(ended)

    return F.when(c.contains("|"), F.aggregate(lines(c), start, step, closed)).otherwise(start["out"])


def tag_errors(c: Column) -> Column:
    low = casefold(c)
    tags = ("table", "tr", "td", "th")
    found = F.array_compact(F.array(*(F.when(count(low, rf"<{t}\b") != count(low, f"</{t}>"), f"malformed_html_table:{t}") for t in tags)))
    return F.when(c.contains("<"), found).otherwise(F.array().cast("array<string>"))


# The gate


def _syntax(c: Column) -> Column:
    ticks = F.exists(lines(c), lambda x: ~x.contains("```") & (count(x, r"(?<!`)`(?!`)") % 2 == 1))
    return F.array_compact(F.array(F.when(c.contains("```") & (count(c, "```") % 2 == 1), "unclosed_code_blocks"), F.when(c.contains("`") & ticks, "unclosed_inline_code")))


def _glued(c: Column) -> Column:
    shown = where_signs(where_signs(c, ("](",), r"!?\[([^\]]*)\]\([^)]+\)", "$1"), ("://",), r"(?i)https?://\S+", "")
    long = lambda t: words(t, r"(?<![\p{L}\p{N}_-])\p{L}{45,}(?![\p{L}\p{N}_-])")
    signs = lambda x: sum((x.contains(s).cast("int") for s in GLUE_SIGNS), F.lit(0))
    found = lambda t: F.exists(long(t), lambda x: (x == casefold(x)) & ((F.length(x) >= 80) | (signs(x) >= 3)))
    return let(shown, lambda t: F.when(t.rlike(r"\A(?:\P{L}++|\p{L}{1,44}+(?!\p{L}))*+\p{L}"), found(t)).when(t.isNull(), F.lit(None).cast("boolean")).otherwise(False))


def core_errors(c: Column) -> Column:
    """The gate's cheapest codes: empty page, open fences, runs of lines, runs of words, odd `$`."""
    text = F.coalesce(c, F.lit(""))
    tests = {"empty_page": strip(text) == "", "unclosed_code_blocks": count(text, "```") % 2 == 1, "repetition_loop": four_lines(text), "repeated_words": word_run(text) >= 5, "unbalanced_math_delimiters": mathtext.unbalanced(text)}
    return F.array_compact(F.array(*(F.when(t, k) for k, t in tests.items())))


def core_report(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, score, should_retry, passed and errors (sorted, comma-joined) by core_errors. A projection."""
    full = lambda e: F.struct(score(e).alias("score"), should_retry(e).alias("should_retry"), (F.size(e) == 0).alias("passed"), F.array_join(F.array_sort(e), ",").alias("errors"))
    return pages.select(*keys, F.inline(F.transform(F.array(core_errors(F.col(text))), full)))


def page_errors(c: Column, check_tables: Column | bool = True, assets: Column | None = None, html_tables: Column | None = None, loss: Column | None = None) -> Column:
    """Ordered distinct error codes of a page as an array.

    assets: names of the images there are (null or left out: images aren't
    looked for); html_tables: codes of tables.html_structure, which parses; loss:
    diacritic_loss of the text, where that is at hand.
    """
    text = F.coalesce(c, F.lit(""))
    none = F.array().cast("array<string>")
    tables = F.concat(pipe_errors(text), tag_errors(text), F.coalesce(html_tables, none) if html_tables is not None else none)
    loss = diacritic_loss(text) if loss is None else loss
    images = none
    if assets is not None:
        local = F.filter(markup.image_targets(text), lambda t: ~t.rlike(markup.PLACEHOLDER) & ~t.rlike("(?i)^(?:https?://|data:)") & ~F.array_contains(assets, t))
        images = F.when(assets.isNotNull(), F.transform(local, lambda t: F.concat(F.lit("missing_image:"), t))).otherwise(none)
    return F.array_distinct(
        F.concat(
            F.array_compact(F.array(F.when(strip(text) == "", "empty_page"))),
            _syntax(text),
            F.when(F.lit(check_tables) if isinstance(check_tables, bool) else check_tables, tables).otherwise(none),
            F.array_compact(
                F.array(
                    F.when(has_loop(text) | four_lines(text), "repetition_loop"), F.when(word_run(text) >= 5, "repeated_words"), F.when(_glued(text), "glued_words"),
                    F.when(loss["high"] > 0, "missing_vietnamese_diacritics"), F.when(mathtext.unbalanced(text), "unbalanced_math_delimiters"),
                )
            ),
            F.when(text.contains("$"), mathtext.errors(text)).otherwise(none),
            F.array_compact(F.array(F.when(text.contains("_") & text.rlike(markup.PLACEHOLDER), "unresolved_placeholder"))),
            images,
        )
    )


def page_warnings(loss: Column) -> Column:
    """Warnings of a page by its diacritic_loss."""
    likely = (loss["high"] == 0) & (loss["medium"] >= 2) & (loss["medium"] >= 0.25 * F.greatest(loss["segments"], F.lit(1)))
    return F.array_compact(F.array(F.when(likely, "suspected_missing_vietnamese_diacritics")))


def report(pages: DataFrame, text: str = "text", **options) -> DataFrame:
    """pages with errors, warnings, fatal, score, should_retry and passed. A null text is an empty page."""
    full = lambda e, w: F.struct(w.alias("warnings"), e.alias("errors"), fatal(e).alias("fatal"), score(e).alias("score"), should_retry(e).alias("should_retry"), (F.size(e) == 0).alias("passed"))
    parsed = options.pop("html_tables", None)
    if parsed is not None:
        # No parser runs inside an expression's lambda.
        name = "html_tables_of_page"
        pages, options["html_tables"] = pages.withColumn(name, parsed), F.col(name)
    judged = lambda loss: let(page_errors(F.col(text), loss=loss, **options), lambda e: full(e, page_warnings(loss)))
    # inline() gives the struct's fields without evaluating the gate once for each.
    out = pages.select("*", F.inline(F.transform(F.array(diacritic_loss(F.coalesce(F.col(text), F.lit("")))), judged)))
    return out if parsed is None else out.drop(name)


def attempt_key(text: Column, errors: Column, warnings: Column | None = None) -> Column:
    """What attempts are compared by, the least first: fatal, severe, penalty, warnings, length."""
    warned = F.size(warnings) if warnings is not None else F.lit(0)
    severe = F.size(F.filter(errors, lambda e: weight(e) >= 35))
    shown = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", ""))
    return F.struct(F.size(fatal(errors)).alias("fatal"), severe.alias("severe"), F.floor(100 - score(errors)).cast("int").alias("penalty"), warned.alias("warned"), (-shown).alias("short"))


def choose_best(attempts: DataFrame, keys: list[str], order: str, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """The best attempt of each page; of equal ones the first by order. columns: which of the others to give (all), so that texts that nobody wants aren't shuffled."""
    best = F.struct(attempt_key(F.col(text), F.col("errors"), F.col("warnings") if "warnings" in attempts.columns else None).alias("key"), F.col(order).alias("at"))
    rest = [c for c in attempts.columns if c not in keys] if columns is None else columns
    return attempts.groupBy(*keys).agg(F.min_by(F.struct(*rest), best).alias("b")).select(*keys, "b.*")


def completeness(pages: DataFrame, doc: str, page: str, total: str | None = None) -> DataFrame:
    """A row for each document: missing and duplicate page numbers as comma-joined lists, errors, score, passed.

    total is a column with the number of pages; left out, the greatest number
    counts. Only distinct page numbers are gathered for a document.
    """
    counted = pages.groupBy(doc, page).agg(F.count(F.lit(1)).alias("n"), F.max(F.col(total) if total else F.col(page)).alias("of"))
    each = counted.groupBy(doc).agg(F.max("of").alias("total"), F.array_sort(F.collect_list(F.col(page).cast("long"))).alias("pages"), F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.col(page).cast("long")))).alias("twice"))
    expected = F.when(F.col("total") >= 1, F.sequence(F.lit(1).cast("long"), F.col("total").cast("long"))).otherwise(F.array().cast("array<bigint>"))
    joined = lambda a: F.array_join(a.cast("array<string>"), ",")
    missing, twice = joined(F.array_except(expected, "pages")), joined(F.col("twice"))
    errors = F.array_compact(F.array(F.when(missing != "", F.concat(F.lit("missing_pages:"), missing)), F.when(twice != "", F.concat(F.lit("duplicate_pages:"), twice))))
    return each.select(doc, missing.alias("missing"), twice.alias("duplicate"), errors.alias("errors"), score(errors).alias("score"), (F.size(errors) == 0).alias("passed"))


def rollup(reports: DataFrame, *keys: str) -> DataFrame:
    """Pages, mean score and passed pages by each prefix of keys."""
    return reports.rollup(*keys).agg(F.count(F.lit(1)).alias("pages"), F.avg("score").alias("score"), F.sum(F.col("passed").cast("long")).alias("passed"))


# The file validator: other thresholds, and a category of its own for each finding.


def validator_findings(c: Column) -> Column:
    """Findings of the file validator: over four equal words in a line of more than ten, and more than three adjacent equal lines in all."""
    shown = visible_lines(c)
    w = lambda x: words(x, "[a-zA-ZÀ-ỹĐđ0-9]+")
    repeated = F.exists(shown, lambda x: (F.size(w(x)) > 10) & (longest_run(F.transform(w(x), casefold), lambda a, b: a == b) > 5))
    pairs = F.aggregate(shown, F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("n")), lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.when(acc["last"].eqNullSafe(x), 1).otherwise(0)).alias("n")), lambda acc: acc["n"])
    return F.array_compact(F.array(F.when(repeated, "repeated_words"), F.when(pairs > 3, "repeated_lines"), F.when(mathtext.unbalanced(c), "math"), F.when(F.size(pipe_errors(c)) > 0, "table"), F.when(c.rlike(markup.PLACEHOLDER), "placeholder")))
