"""Assets, placement, and documents from pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docspark.functions import markup, repair
from docspark.functions.text import let, strip
from docspark.operators import quality, spelling


def distinct_assets(assets: DataFrame, page: list[str], order: str, content: str = "content") -> DataFrame:
    """The first asset of each content (SHA-256) of a page."""
    w = Window.partitionBy(*page, "digest").orderBy(order)
    return assets.withColumn("digest", F.sha2(F.col(content), 256)).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def unreferenced(assets: DataFrame, pages: DataFrame, doc: list[str], name: str = "name", text: str = "text") -> DataFrame:
    """Local assets of a document that none of its pages links, as an image or otherwise; remote ones and those outside its folder are never among them."""
    links = pages.select(*doc, F.explode(markup.link_targets(F.col(text))).alias(name)).distinct()
    local = assets.where(~F.col(name).rlike("(?i)^(?:https?://|data:|/)") & ~F.col(name).rlike(r"(?:^|/)\.\.(?:/|$)"))
    return local.join(links, [*doc, name], "left_anti")


def with_content(blocks: DataFrame, content: DataFrame, on: list[str]) -> DataFrame:
    """Blocks with the content recognised for their box, or else their own."""
    found = content.select(*on, F.col("content").alias("found"))
    rest = [c for c in blocks.columns if c != "content"]
    return blocks.join(found, on, "left").select(*rest, F.coalesce("found", "content").alias("content"))


def fill_slots(slots: DataFrame, items: DataFrame, page: list[str], slot_order: str, item_order: str, item: str = "item") -> DataFrame:
    """The k-th item of a page in its k-th slot: page, k, slot (null: item without one), item (null: slot left empty)."""
    k = lambda order: F.row_number().over(Window.partitionBy(*page).orderBy(order))
    s = slots.select(*page, F.col(slot_order).alias("slot"), k(slot_order).alias("k"))
    i = items.select(*page, F.col(item).alias("item"), k(item_order).alias("k"))
    return s.join(i, [*page, "k"], "full_outer").select(*page, "k", "slot", "item")


#: Text of an image that has none of its own (fixed value).
NO_LABEL = "Hình ảnh"


def link_images(text: Column, paths: Column) -> Column:
    """Struct (text, remaining) of a page: its image placeholders as links to the paths that it doesn't link yet, in order; surplus placeholders go, surplus paths remain.

    Markdown placeholders come first, then HTML ones, then bare words; an image
    tag left open at the end of a line is a placeholder too. Nulls give nulls.
    """
    target = markup.IMAGE_TARGET
    kinds = (rf"!\[[^\]]*\]\(\s*{target}\s*\)", rf"<img\b[^>]*\bsrc\s*=\s*['\"]{target}['\"][^>]*>", rf"(?<![\w/.-]){target}(?![\w/.-])")
    pattern = "(?i)" + "|".join(kinds)
    kind = lambda h: F.when(h.startswith("!["), 0).when(h.startswith("<"), 1).otherwise(2)
    label = lambda h, k: F.when(k == 0, F.regexp_extract(h, r"!\[([^\]]*)\]", 1)).when(k == 1, F.regexp_extract(h, r"(?i)\balt\s*=\s*(['\"])(.*?)\1", 2)).otherwise("")
    named = lambda h, k: let(label(h, k), lambda x: F.when(x == "", NO_LABEL).otherwise(x))
    image = lambda h, k, path: let(path, lambda p: F.when(p.isNull(), "").otherwise(F.concat(F.lit("!["), named(h, k), F.lit("]("), p, F.lit(")"))))

    # Each step is bound before the next uses it: an expression inside a lambda is evaluated as often as it is written.
    def given(x: Column) -> Column:
        whole = F.regexp_replace(x["text"], r"(?m)!\[([^\]\n]+)$", "![$1](image_placeholder.png)")
        free = F.filter(x["paths"], lambda p: ~F.contains(x["text"], F.concat(F.lit("]("), p, F.lit(")"))))
        return F.when(x["text"].isNotNull() & x["paths"].isNotNull(), let(F.struct(whole.alias("whole"), free.alias("free")), found))

    def found(x: Column) -> Column:
        hits = F.regexp_extract_all(x["whole"], F.lit(pattern), F.lit(0))
        # split() compiles its pattern for every text; a text with the sign in it is split by the pattern all the same.
        gaps = F.when(x["whole"].contains("\x01"), F.split(x["whole"], pattern, -1)).otherwise(F.split(F.regexp_replace(x["whole"], pattern, "\x01"), "\x01", -1))
        return let(F.struct(hits.alias("hits"), F.transform(hits, kind).alias("kinds"), gaps.alias("gaps"), x["free"].alias("free")), linked)

    def linked(x: Column) -> Column:
        before = lambda k, i: F.size(F.filter(x["kinds"], lambda o, j: (o < k) | (o == k) & (j < i)))
        link = lambda i, k: image(F.get(x["hits"], i), k, F.get(x["free"], before(k, i)))
        parts = F.transform(x["gaps"], lambda gap, i: F.when(i < F.size(x["hits"]), F.concat(gap, link(i, F.get(x["kinds"], i)))).otherwise(gap))
        return F.struct(F.array_join(parts, "").alias("text"), F.slice(x["free"], F.size(x["hits"]) + 1, F.greatest(F.size(x["free"]), F.lit(1))).alias("remaining"))

    return let(F.struct(text.alias("text"), paths.alias("paths")), given)


def fill_formulas(text: Column, formulas: Column) -> Column:
    """Formula placeholders of a text filled in order; surplus placeholders go, surplus formulas follow as paragraphs. Nulls give null."""
    pattern = "(?i)formula_placeholder"

    def filled(x: Column) -> Column:
        gaps, n = x["gaps"], F.size(x["gaps"]) - 1
        whole = F.array_join(F.transform(gaps, lambda gap, i: F.when(i < n, F.concat(gap, F.coalesce(F.get(x["formulas"], i), F.lit("")))).otherwise(gap)), "")
        rest = F.slice(x["formulas"], n + 1, F.greatest(F.size(x["formulas"]), F.lit(1)))
        return F.when(F.size(rest) > 0, F.array_join(F.concat(F.array(F.regexp_replace(whole, r"(?U)\s+$", "")), rest), "\n\n")).otherwise(whole)

    return F.when(text.isNotNull() & formulas.isNotNull(), let(F.struct(F.split(text, pattern, -1).alias("gaps"), formulas.alias("formulas")), filled))


def insert_images(text: Column, paths: Column, kinds: Column) -> Column:
    """The images that a page doesn't link yet, as paragraphs at their place in the layout.

    The k-th image block of kinds stands at its share of the blocks, and the k-th
    path goes before the paragraph at the same share of the paragraphs, or last if
    there is no such block. Nulls give null.
    """
    link = lambda p: F.concat(F.lit(f"![{NO_LABEL}]("), p, F.lit(")"))

    def placed(x: Column) -> Column:
        n = F.size(x["parts"])
        share = F.filter(F.transform(x["kinds"], lambda kind, i: F.when(kind == "image", i / F.size(x["kinds"]))), lambda v: v.isNotNull())
        at = lambda k: F.bround(F.coalesce(F.get(share, k), F.lit(1.0)) * n).cast("int")
        tags = F.transform(x["paths"], lambda p, k: F.struct(at(k).alias("at"), p.alias("path")))
        free = F.filter(tags, lambda t: ~F.contains(text, F.concat(F.lit("]("), t["path"], F.lit(")"))))
        here = lambda i: F.transform(F.filter(free, lambda t: t["at"] == i), lambda t: link(t["path"]))
        one = lambda i: F.when(i < n, F.array(F.get(x["parts"], i))).otherwise(F.array().cast("array<string>"))
        every = F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(here(i), one(i))))
        return F.when(F.size(free) == 0, text).otherwise(F.array_join(every, "\n\n"))

    parts = F.filter(F.split(strip(text), r"\n{2,}"), lambda p: strip(p) != "")
    return F.when(text.isNotNull() & paths.isNotNull() & kinds.isNotNull(), let(F.struct(parts.alias("parts"), paths.alias("paths"), kinds.alias("kinds")), placed))


def without_blank(pages: DataFrame, blank: DataFrame, on: list[str]) -> DataFrame:
    """The pages that aren't among the blank ones."""
    return pages.join(blank.select(*on).distinct(), on, "left_anti")


def with_offsets(blocks: DataFrame, page: list[str], order: str, content: str = "content", gap: int = 2) -> DataFrame:
    """Non-empty blocks with md_start and md_end, their places in the page text that joins them by blank lines."""
    w = Window.partitionBy(*page).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    text = strip(F.col(content))
    b = blocks.withColumn("body", text).where("body <> ''")
    start = F.coalesce(F.sum(F.length("body") + gap).over(w), F.lit(0)).cast("int")
    return b.withColumn("md_start", start).withColumn("md_end", F.col("md_start") + F.length("body")).drop("body")


def rebased(spans: Column, old: Column, new: Column) -> Column:
    """Spans (md_start, md_end, ...) of one text found again, in order, in another; those not found go."""
    piece = lambda s: F.substring(old, s["md_start"] + 1, s["md_end"] - s["md_start"])

    # A cursor moves over the new text: its tail after the last piece found.
    first = F.struct(new.alias("tail"), F.lit(0).alias("gone"), F.filter(spans, lambda s: F.lit(False)).alias("out"))

    def move(acc, s):
        p = piece(s)
        found = F.instr(acc["tail"], p)
        hit, at = (found > 0) & (p != ""), found - 1
        begin = acc["gone"] + at
        moved = s.withField("md_start", begin.cast("int")).withField("md_end", (begin + F.length(p)).cast("int"))
        return F.when(hit, F.struct(F.substring(acc["tail"], at + F.length(p) + 1, F.length(acc["tail"])).alias("tail"), (begin + F.length(p)).cast("int").alias("gone"), F.array_append(acc["out"], moved).alias("out"))).otherwise(acc)

    return F.aggregate(spans, first, move, lambda acc: acc["out"])


def documents(pages: DataFrame, doc: list[str], page: str, text: str = "text") -> DataFrame:
    """doc, text, n_pages, n_filled: the non-empty pages of a document in order, each after its marker; all blank gives an empty text."""
    body = strip(F.coalesce(F.col(text), F.lit("")))
    piece = F.struct(F.col(page).alias("at"), F.concat(F.lit("<!-- Page "), F.col(page).cast("string"), F.lit(" -->\n\n"), body).alias("text"))
    g = pages.groupBy(*doc).agg(F.count(F.lit(1)).alias("n_pages"), F.array_sort(F.collect_list(F.when(body != "", piece))).alias("p"))
    return g.select(*doc, F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"), "n_pages", F.size("p").cast("long").alias("n_filled"))


#: Most words and word pairs of a lexicon that the finaliser takes: it goes to every task.
LEXICON_ENTRIES = 1_000_000


def finalise(docs: DataFrame, text: str = "text", footers: str | None = None, lexicon: tuple[DataFrame, DataFrame, DataFrame] | None = None, correct: bool = False) -> DataFrame:
    """docs with final, the repaired text, and report, a struct of how much each step of repair.COUNTS mended.

    Steps run in a fixed order in one pass over Arrow batches, each linear in the
    text; a second run changes nothing. footers is a pattern (Python's) of a
    publication's own footer lines. With a lexicon, words that its pairs correct
    are counted, and corrected too if `correct` says so. Null stays null, with
    counts of 0. No shuffle.
    """
    import re

    own = re.compile(footers) if footers else None
    words = spelling.dictionary(lexicon, LEXICON_ENTRIES) if lexicon else None
    counts = [T.StructField(name, T.LongType()) for name in repair.COUNTS]

    def speller(found: str) -> tuple[str, int, int]:
        mended, n = spelling.correct(found, *words)
        return (mended, n, n) if correct else (found, 0, n)

    @F.pandas_udf(T.StructType([T.StructField("final", T.StringType()), *counts]))
    def run(texts: pd.Series) -> pd.DataFrame:
        done = [repair.finalised(t, own, speller if words else None) if t is not None else (None, {}) for t in texts]
        return pd.DataFrame({"final": [t for t, _ in done], **{c: [n.get(c, 0) for _, n in done] for c in repair.COUNTS}})

    out = docs.withColumn("repaired", run(F.col(text)))
    return out.withColumn("final", F.col("repaired.final")).withColumn("report", F.struct(*(F.col(f"repaired.{c}") for c in repair.COUNTS))).drop("repaired")


def describe(report: Column) -> Column:
    """Names and counts of what was mended, `name: n`, comma-joined; `nothing to repair` if nothing was."""
    parts = F.array_compact(F.array(*(F.when(report[n] > 0, F.concat(F.lit(f"{n}: "), report[n].cast("string"))) for n in repair.COUNTS)))
    return F.when(F.size(parts) == 0, "nothing to repair").otherwise(F.array_join(parts, ", "))


def gate(pages: DataFrame, doc: str, page: str, text: str = "text", error: str | None = None) -> DataFrame:
    """doc, errors: documents with pages that are missing, double or failed; a document without any has no row."""
    whole = quality.completeness(pages, doc, page).where(~F.col("passed")).select(doc, F.col("errors"))
    if error is None:
        return whole
    failed = pages.where(F.col(error).isNotNull()).groupBy(doc).agg(F.array_sort(F.collect_set(F.concat(F.lit("failed_page:"), F.col(page).cast("string")))).alias("failed"))
    none = F.array().cast(T.ArrayType(T.StringType()))
    return whole.join(failed, doc, "full_outer").select(doc, F.concat(F.coalesce("errors", none), F.coalesce("failed", none)).alias("errors"))
