"""Line operators: a row for each line, windows over the lines of a document.

One window, by document and line number, carries all running state, so a plan has
one shuffle and one sort whatever it combines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.functions.markup import BLOCK_START
from docspark.functions.patterns import GENERIC_FOOTER, PAGE_FOOTER, PAGE_MARKER, PAGE_NUMBER, SHORT_NUMBER, java
from docspark.functions.text import lines, strip

#: Sentence ends after which a paragraph isn't continued.
ENDS = r"[.!?:;。！？]$"


def explode_lines(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, ln (from 1) and line; a null or empty text has no rows."""
    return docs.select(*keys, F.posexplode(lines(F.col(text))).alias("at", "line")).select(*keys, (F.col("at") + 1).alias("ln"), "line")


def _by(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("ln")


def _before(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _upto(w):
    return w.rowsBetween(Window.unboundedPreceding, 0)


def with_state(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with fenced, in_math and in_table: whether a line is, or lies, inside a code fence, display mathematics or an HTML table.

    Table depth is opened minus closed tags before the line; text that closes
    more tables than it opens is taken as it counts.
    """
    w = _by(keys)
    fence = strip(F.col("line")).rlike("^(?:```|~~~)")
    r = rows.withColumn("fence", fence.cast("int")).withColumn("fences", F.sum("fence").over(_upto(w)))
    open_ = (F.col("fences") % 2 == 1) | (F.col("fence") == 1)
    r = r.withColumn("mark", ((strip(F.col("line")) == "$$") & ~open_).cast("int")).withColumn("marks", F.sum("mark").over(_upto(w)))
    tables = lambda tag: F.regexp_count("line", F.lit(tag))
    r = r.withColumn("depth", F.coalesce(F.sum(tables("(?i)<table\\b") - tables("(?i)</table>")).over(_before(w)), F.lit(0)))
    return r.withColumns({"fenced": open_, "in_math": (F.col("marks") % 2 == 1) | (F.col("mark") == 1), "in_table": (F.col("depth") > 0) | (tables("(?i)<table\\b") > 0)}).drop("fence", "fences", "mark", "marks", "depth")


def runs(rows: DataFrame, keys: list[str], value: Column, least: int = 1) -> DataFrame:
    """keys, first, last, length and value of each run of equal neighbouring values, of `least` rows or more."""
    w = _by(keys)
    r = rows.withColumn("value", value).withColumn("new", (~F.col("value").eqNullSafe(F.lag("value").over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    r = r.withColumn("run", F.sum("new").over(_upto(w)))
    return r.groupBy(*keys, "run").agg(F.min("ln").alias("first"), F.max("ln").alias("last"), F.count(F.lit(1)).alias("length"), F.min("value").alias("value")).where(F.col("length") >= least).drop("run")


def clamp_headings(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ln, level and clamped: heading lines outside fences, a level at most one deeper than the heading before, six at most.

    For the k-th heading of a document the clamped level is k plus the least of
    level minus rank up to it; the first stands as it is.
    """
    level = F.length(F.regexp_extract("line", r"^\s*(#+)", 1))
    heads = with_state(rows, keys).where(~F.col("fenced") & F.col("line").rlike(r"^\s*#+\s*[^#\s]")).select(*keys, "ln", F.least(level, F.lit(6)).alias("level"))
    w = _by(keys)
    k = F.row_number().over(w)
    return heads.withColumn("k", k).withColumn("low", F.min(F.col("level") - F.col("k")).over(_upto(w))).select(*keys, "ln", "level", (F.col("k") + F.col("low")).cast("int").alias("clamped"))


def page_artifacts(rows: DataFrame, keys: list[str], footers: str | None = None) -> DataFrame:
    """rows with artifact: whether a line is a page number or footer that a page's text doesn't include.

    footers is a pattern of a publication's own footer lines.
    """
    w = _by(keys)
    r = rows.withColumn("shown", (strip(F.col("line")) != "").cast("int")).withColumn("marker", F.col("line").rlike(PAGE_MARKER).cast("int"))
    # A marker closes the page before it, and opens the next.
    r = r.withColumn("page", F.sum("marker").over(_upto(w)))
    p = Window.partitionBy(*keys, "page").orderBy("ln")
    after = F.coalesce(F.sum("shown").over(p.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    before = F.coalesce(F.sum(F.col("shown") - F.col("marker")).over(p.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near_end, near_start = after <= 4, (F.col("page") > 0) & (before <= 2)
    mine = F.col("line").rlike(footers) if footers else F.lit(False)
    filled = lambda n: F.lead(F.when(F.col("shown") == 1, F.col("line")), n).over(w)
    following = F.coalesce(filled(1), filled(2))
    number = F.col("line").rlike(SHORT_NUMBER) & (F.coalesce(following.rlike(footers), F.lit(False)) if footers else F.lit(False))
    hit = F.col("line").rlike(java(PAGE_FOOTER)) | mine | (F.col("line").rlike(java(GENERIC_FOOTER)) & near_end) | (F.col("line").rlike(PAGE_NUMBER) & (near_end | near_start)) | number
    return r.withColumn("artifact", hit & (F.col("marker") == 0)).drop("shown", "marker", "page")


def join_paragraphs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ln and line: lines that continue a paragraph or a list item joined to its first line, ln that line's.

    A line continues the one before if it starts in lower case or indented and
    starts no block, and the one before is prose without a sentence's end, or a
    list item; code and display mathematics stay.
    """
    w = _by(keys)
    r = with_state(rows, keys)
    held = F.col("fenced") | F.col("in_math")
    text = strip(F.col("line"))
    prose = ~held & (text != "") & ~F.col("line").rlike(BLOCK_START)
    item = ~held & F.col("line").rlike(r"^\s*(?:[-+*]|\d+[.)])\s+")
    r = r.withColumns({"prose": prose, "item": item, "ended": text.rlike(ENDS)})
    goes_on = F.col("prose") & (F.col("line").rlike(r"^\s") | text.rlike(r"^\p{Ll}"))
    # An item goes on over several lines: the last line that isn't a continuation decides.
    head = F.last(F.when(~goes_on, F.col("item")), ignorenulls=True).over(_before(w))
    joins = goes_on & ((F.lag("prose").over(w) & ~F.lag("ended").over(w)) | (head & F.lag(F.col("prose") | F.col("item")).over(w)))
    r = r.withColumn("start", (~F.coalesce(joins, F.lit(False))).cast("int")).withColumn("part", F.sum("start").over(_upto(w)))
    first = F.regexp_replace(F.col("line"), r"(?U)\s+$", "")
    pieces = F.array_sort(F.collect_list(F.struct("ln", F.when((F.col("start") == 1) & ~F.col("prose"), first).otherwise(F.when(held, F.col("line")).otherwise(text)).alias("line"))))
    return r.groupBy(*keys, "part").agg(F.min("ln").alias("ln"), F.array_join(F.transform(pieces, lambda x: x["line"]), " ").alias("line")).drop("part")


def assemble_lines(rows: DataFrame, keys: list[str], out: str = "text") -> DataFrame:
    """A text for each document: its lines in order."""
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", "line"))), lambda x: x["line"]), "\n").alias(out))
