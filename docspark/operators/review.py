"""Lines of a page that are worth reading again, budgets, escalation and acceptance."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docspark.functions.text import casefold, lines, strip, words

#: Severity of each reason (fixed values); any other reason is medium.
SEVERITY = {
    "mass_diacritic_loss": "critical", "invalid_table_grid": "critical", "ocr_disagreement": "high", "graphic_overlap": "high",
    "truncated_line": "high", "glued_characters": "high", "malformed_date": "high", "malformed_document_number": "high",
    "possible_pen_stroke_or_glued_punctuation": "medium", "possible_missing_printed_footer": "high", "unusual_word": "low",
}
RANKS = ("critical", "high", "medium", "low")
#: Function words of a sentence that lost its marks (fixed values).
LOSS_SIGNS = ("cua", "va", "la", "trong", "duoc", "nhung", "mot", "cho", "voi", "khong")
FOOTER = "possible_missing_printed_footer"


#: Dates, document numbers and cut ends (fixed values).
DATED = r"(?iu)\bngày\s*.{0,12}\d"
VALID_DATE = r"(?iu)ngày\s+\d{1,2}\s+tháng\s+\d{1,2}\s+năm\s+\d{4}|ngày\s+\d{1,2}/\d{1,2}/\d{4}"
BROKEN_DATE = r"\d\s*[.]{2,}|\d[.]\d[.]"
BROKEN_NUMBER = r"(?iu)\bSố\s*:\s*[^\s]*[.]{2,}|\bSố\s*:\s*\d+[.]/"
CUT_END = "�|[\\p{L}\\p{N}_]-$|\\.{3,}$"


def line_reasons(line: Column, lost_marks: Column | bool = False) -> Column:
    """Reasons that a line itself gives, as an array; lost_marks: its page lost its diacritics."""
    x = strip(line)
    dated = F.lower(x).contains("ngày") & x.rlike(DATED)
    valid = x.rlike(VALID_DATE)
    pairs = F.regexp_extract_all(x, F.lit(r"(?<!\d)([A-Za-zÀ-ỹĐđ]+)-([A-Za-zÀ-ỹĐđ]+)"), F.lit(0))
    lower = lambda p: F.substring_index(p, "-", 1) != F.upper(F.substring_index(p, "-", 1))
    lower_after = lambda p: F.substring_index(p, "-", -1) != F.upper(F.substring_index(p, "-", -1))
    found = words(x)
    signs = F.size(F.filter(found, lambda w: casefold(w).isin(*LOSS_SIGNS)))
    lost = F.lit(lost_marks) if isinstance(lost_marks, bool) else lost_marks
    tests = {
        "glued_characters": (F.length(x) >= 45) & x.rlike(r"(?<!\p{L})\p{L}{45}"),
        "malformed_date": dated & (x.rlike(BROKEN_DATE) | ~valid),
        "malformed_document_number": x.contains(":") & x.rlike(BROKEN_NUMBER),
        "mass_diacritic_loss": lost & (F.size(found) >= 7) & (signs >= 2),
        "possible_pen_stroke_or_glued_punctuation": x.contains("-") & F.exists(pairs, lambda p: lower(p) & lower_after(p)),
        "truncated_line": (x.contains("\ufffd") | x.endswith("-") | x.endswith("...")) & x.rlike(CUT_END),
    }
    return F.array_compact(F.array(*(F.when((x != "") & tests[k], k) for k in sorted(tests))))


def severity(reasons: Column) -> Column:
    """The gravest severity of an array of reasons."""
    table = F.create_map(*(F.lit(x) for r, s in SEVERITY.items() for x in (r, RANKS.index(s))))
    least = F.array_min(F.transform(reasons, lambda r: F.coalesce(F.element_at(table, r), F.lit(2))))
    return F.element_at(F.array(*(F.lit(s) for s in RANKS)), least + 1)


def rank(c: Column) -> Column:
    return F.array_position(F.array(*(F.lit(s) for s in RANKS)), c) - 1


def suspicious_lines(pages: DataFrame, keys: list[str], text: str = "text", lost_marks: Column | bool = False, footer: bool = False) -> DataFrame:
    """keys, line_idx (from 0), text, reasons (sorted), severity, n_content: a row for each line with a reason.

    footer adds the last visible line of each page. No shuffle.
    """
    all_lines = lines(F.col(text))
    shown = lambda x: (strip(x) != "") & ~F.ltrim(x).startswith("<!--")
    last = F.array_max(F.transform(all_lines, lambda x, i: F.when(shown(x), i)))
    e = pages.select(*keys, F.size(F.filter(all_lines, shown)).alias("n_content"), last.alias("last"), F.posexplode(all_lines).alias("line_idx", "line"))
    reasons = line_reasons(F.col("line"), lost_marks)
    if footer:
        reasons = F.array_sort(F.concat(reasons, F.array_compact(F.array(F.when(F.col("line_idx") == F.col("last"), FOOTER)))))
    return e.withColumn("reasons", reasons).where(F.size("reasons") > 0).select(*keys, "line_idx", F.col("line").alias("text"), "reasons", severity(F.col("reasons")).alias("severity"), "n_content")


def add_reasons(candidates: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates with further reasons by line: more has keys, line_idx, text, reason, n_content."""
    rows = candidates.select(*keys, "line_idx", "text", F.explode("reasons").alias("reason"), "n_content").unionByName(more.select(*keys, "line_idx", "text", "reason", "n_content"))
    g = rows.groupBy(*keys, "line_idx").agg(F.first("text").alias("text"), F.array_sort(F.collect_set("reason")).alias("reasons"), F.max("n_content").alias("n_content"))
    return g.select(*keys, "line_idx", "text", "reasons", severity(F.col("reasons")).alias("severity"), "n_content")


def within_budget(candidates: DataFrame, keys: list[str], each: int = 2, total: int = 2) -> DataFrame:
    """Critical and high candidates, `each` of a severity (missing footers first) and `total` of a page."""
    c = candidates.where(F.col("severity").isin("critical", "high")).withColumn("other", ~F.array_contains("reasons", FOOTER))
    by = Window.partitionBy(*keys, "severity").orderBy("other", "line_idx")
    c = c.withColumn("n", F.row_number().over(by)).where((F.col("n") <= each) | ~F.col("other"))
    whole = Window.partitionBy(*keys).orderBy(rank(F.col("severity")), "other", "line_idx")
    return c.withColumn("n", F.row_number().over(whole)).where(F.col("n") <= total).drop("n", "other")


def reread_pages(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """keys, reread: whether so many lines fail that the whole page is read again. A row for each page with candidates."""
    text = ~F.array_contains("reasons", "invalid_table_grid") & ~F.array_contains("reasons", FOOTER)
    n = lambda test: F.count_if(text & test)
    affected = F.count_if(text)
    return candidates.groupBy(*keys).agg(
        (
            (n(F.col("severity") == "critical") >= 3)
            | (n(F.col("severity").isin("critical", "high")) >= 3)
            | ((affected >= 2) & (affected >= 0.2 * F.greatest(F.max("n_content"), F.lit(1))))
            | (n(F.array_contains("reasons", "mass_diacritic_loss")) >= 2)
        ).alias("reread")
    )


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two texts; null counts as empty."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def accepted(candidates: DataFrame, replies: DataFrame, keys: list[str]) -> DataFrame:
    """candidates with corrected and accepted.

    A reply (keys, line_idx, original, corrected, confidence) counts if it names
    the line as it stands, is sure (0.98, a missing footer 0.95), changes it, and
    stays similar (0.72, a missing footer 0.20). A line without a reply stays.
    """
    r = replies.select(*keys, "line_idx", F.col("original").alias("o"), F.col("corrected").alias("corrected"), "confidence")
    j = candidates.join(r, [*keys, "line_idx"], "left").withColumn("footer", F.array_contains("reasons", FOOTER))
    sure = (F.col("o") == F.col("text")) & (F.col("confidence") >= F.when(F.col("footer"), 0.95).otherwise(0.98)) & (F.trim("corrected") != "") & (F.col("corrected") != F.col("o"))
    like = similarity(F.when(sure, F.col("o")), F.when(sure, F.col("corrected")))
    j = j.withColumn("sure", F.coalesce(sure, F.lit(False))).withColumn("like", like)
    return j.withColumn("accepted", F.col("sure") & (F.col("like") >= F.when(F.col("footer"), 0.20).otherwise(0.72))).drop("o", "sure", "like", "footer")


def disagreements(candidates_lines: DataFrame, rereads: DataFrame, keys: list[str]) -> DataFrame:
    """Lines whose second reading is less than 0.72 similar, with reason ocr_disagreement."""
    j = candidates_lines.join(rereads.select(*keys, "line_idx", F.col("text").alias("again")), [*keys, "line_idx"])
    return j.where((F.trim("again") != "") & (similarity(F.trim("text"), F.trim("again")) < 0.72)).drop("again").withColumn("reason", F.lit("ocr_disagreement"))


def nearby_groups(candidates: DataFrame, keys: list[str], most: int = 2, height: Column | None = None) -> DataFrame:
    """candidates with grp: one that is near the one before joins it; `most` to a group.

    Near is at most two lines after; with the page's height, where both have a box
    (l, t, r, b), it is an upright gap of at most 8 % of that and sides that
    overlap.
    """
    w = Window.partitionBy(*keys).orderBy("line_idx")
    near = F.col("line_idx") - F.lag("line_idx").over(w) <= 2
    if height is not None:
        before = {c: F.lag(c).over(w) for c in "ltrb"}
        gap = F.greatest(F.lit(0.0), F.col("t") - before["b"], before["t"] - F.col("b"))
        beside = F.least("r", before["r"]) > F.greatest("l", before["l"])
        near = F.when(F.col("l").isNotNull() & before["l"].isNotNull(), (gap <= 0.08 * height) & beside).otherwise(near)
    g = candidates.withColumn("n", F.row_number().over(w)).withColumn("near", F.coalesce(near, F.lit(False)))
    joined = F.col("near") & (F.col("n") <= most)
    return g.withColumn("grp", F.sum((~joined).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("n", "near")


def of_unsound_pages(candidates: DataFrame, score: str = "score") -> DataFrame:
    """Candidates of pages below the full score; of others only missing footers. A null score counts as below."""
    return candidates.where((F.coalesce(F.col(score), F.lit(0.0)) < 100) | F.array_contains("reasons", FOOTER))


def span_boxes(rows: DataFrame, spans: DataFrame, page: list[str], start: str = "start") -> DataFrame:
    """rows with box (l, t, r, b): that of the exactly placed span, no image's, in which a row starts; null if there is none.

    spans (md_start, md_end, kind, exact, l, t, r, b) of a page don't overlap: the
    one that began last decides, so spans and rows are merged in one window, and
    no pairs are made. Rows of a null start have no box.
    """
    value = F.struct("md_start", "md_end", "kind", "exact", *(F.col(c).cast("double").alias(c) for c in "ltrb"))
    events = rows.withColumns({"at": F.col(start), "late": F.lit(1)}).unionByName(spans.select(*page, F.col("md_start").alias("at"), F.lit(0).alias("late"), value.alias("span")), allowMissingColumns=True)
    last = F.last("span", ignorenulls=True).over(Window.partitionBy(*page).orderBy("at", "late").rowsBetween(Window.unboundedPreceding, 0))
    held = (F.col("at") < F.col("last.md_end")) & F.col("last.exact") & (F.col("last.kind") != "image")
    return events.withColumn("last", last).where("late = 1").select(*rows.columns, F.when(held, F.struct(*(F.col(f"last.{c}").alias(c) for c in "ltrb"))).alias("box"))


def ranked_boxes(rows: DataFrame, regions: DataFrame, page: list[str], order: str) -> DataFrame:
    """rows with box: the k-th of a page's n rows takes the region at the same share of the page's regions, from the top, then the left."""
    w = Window.partitionBy(*page)
    share = (F.row_number().over(w.orderBy(order)) - 1) / F.greatest(F.count(F.lit(1)).over(w) - 1, F.lit(1))
    placed = regions.select(*page, F.row_number().over(w.orderBy("t", "l", "r", "b")).alias("k"), F.count(F.lit(1)).over(w).alias("of"), F.struct("l", "t", "r", "b").alias("box"))
    number = regions.groupBy(*page).agg(F.count(F.lit(1)).alias("of"))
    k = (F.bround(F.col("share") * (F.col("of") - 1)) + 1).cast("int")
    return rows.withColumn("share", share).join(number, page, "left").withColumn("k", k).join(placed.drop("of"), [*page, "k"], "left").select(*rows.columns, "box")


def review_boxes(candidates: DataFrame, regions: DataFrame, page: list[str], ident: str, width: Column, height: Column, margin: int = 30) -> DataFrame:
    """page, ident, l, t, r, b: what to cut out for a candidate of box (l, t, r, b): the region nearest to it by the sum of distances of sides, and its neighbours from the top.

    margin stands about them, inside the page. The first of equally near regions
    counts; a page without regions has no row.
    """
    n = F.row_number().over(Window.partitionBy(*page).orderBy("t", "l", "r", "b"))
    ordered = regions.select(*page, "l", "t", "r", "b", n.alias("n"))
    about = Window.partitionBy(*page).orderBy("n").rowsBetween(-1, 1)
    cut = ordered.select(*page, "n", *(F.col(c).alias(f"own_{c}") for c in "ltrb"), F.min("l").over(about).alias("low"), F.max("r").over(about).alias("high"), F.first("t").over(about).alias("top"), F.last("b").over(about).alias("end"))
    far = sum((F.abs(F.col(c) - F.col(f"own_{c}")) for c in "ltrb"), F.lit(0.0))
    best = candidates.select(*page, ident, "l", "t", "r", "b").join(cut, page).groupBy(*page, ident).agg(F.min_by(F.struct("low", "top", "high", "end"), F.struct(far, F.col("n"))).alias("x"))
    whole = lambda c: c.cast("long")
    return best.select(*page, ident, F.greatest(whole(F.col("x.low")) - margin, F.lit(0)).alias("l"), F.greatest(whole(F.col("x.top")) - margin, F.lit(0)).alias("t"), F.least(whole(F.col("x.high")) + margin, whole(width)).alias("r"), F.least(whole(F.col("x.end")) + margin, whole(height)).alias("b"))
