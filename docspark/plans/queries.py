"""A query for each group of operators; each takes (spark, folder of the tables) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.functions import markup, scoring
from docspark.functions.text import LETTERS, casefold, unaccented, words
from docspark.functions.text import lines as cut_lines
from docspark.operators import assembly, bench, layout, lines, quality, review, spelling, tables
from docspark.plans.oracles import ORACLES
from docspark.sources.readers import model_json, spread
from docspark.streaming import pages as streams

__all__ = ["ORACLES", "QUERIES"]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def q01_page_quality_report(spark, d):
    return quality.core_report(_t(spark, d, "documents"), ["doc_id"])


def q02_language_profile(spark, d):
    return _t(spark, d, "documents").select("doc_id", quality.language_profile(F.col("text")).alias("profile"))


def q03_repetition_runs(spark, d):
    return _t(spark, d, "documents").select("doc_id", quality.line_run(F.col("text")).cast("long").alias("longest")).where("longest >= 4")


def q04_repeated_words(spark, d):
    return _t(spark, d, "documents").select("doc_id", quality.word_run(F.col("text")).cast("long").alias("longest")).where("longest >= 5")


def q05_unbalanced_math(spark, d):
    c = F.col("text")
    return _t(spark, d, "documents").where(F.regexp_count(c, F.lit(r"(?<!\\)\$")) % 2 == 1).select("doc_id", F.regexp_count(c, F.lit(r"(?<!\\)\$")).cast("long").alias("n_delimiters"))


def q06_glued_words(spark, d):
    """Whole texts, each with a made-up word of nought to eight times twelve letters at its end."""
    long = F.concat(F.col("lang"), F.repeat(F.lit("cuavalatrong"), (F.col("doc_id") % 9).cast("int")))
    made = _t(spark, d, "documents").select("doc_id", F.concat_ws(" ", "text", long, F.lit("x")).alias("text"))
    return made.select("doc_id", quality._glued(F.col("text")).alias("glued"))


def q07_html_tag_balance(spark, d):
    return _t(spark, d, "pages").select("page_id", *(markup.tag_balance(F.col("html"), t).cast("long").alias(f"open_{t}") for t in ("p", "b", "li", "a", "div", "article")))


def q08_page_completeness(spark, d):
    pages = _t(spark, d, "conversations").withColumn("page", F.col("turn") + 1)
    total = pages.groupBy(F.col("conv_id").alias("c")).agg(F.max("page").alias("total"))
    left = pages.where("role <> 'assistant'").join(total, F.col("conv_id") == F.col("c"))
    r = quality.completeness(left, "conv_id", "page", "total")
    return r.select("conv_id", "missing", "duplicate", "score", "passed")


def q09_document_assembly(spark, d):
    docs = assembly.documents(_t(spark, d, "conversations").withColumn("page", F.col("turn") + 1), ["conv_id"], "page")
    return docs.select("conv_id", F.md5(F.col("text").cast("binary")).alias("digest"), "n_pages", "n_filled")


def _pipe_orders(spark, d) -> DataFrame:
    """A pipe table for each customer: header, rule and orders, every seventh order with a cell too many."""
    row = F.concat(F.lit("| "), F.col("o_orderkey").cast("string"), F.lit(" | "), F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 7 == 0, " | x |").otherwise(" |"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("row")))), lambda x: x["row"]), "\n")
    return _t(spark, d, "orders").groupBy("o_custkey").agg(F.concat(F.lit("| key | status |\n| --- | --- |\n"), body).alias("text"))


def q10_pipe_table_errors(spark, d):
    return _pipe_orders(spark, d).select("o_custkey", F.array_join(quality.pipe_errors(F.col("text")), ",").alias("errors"))


def _fragments(spark, d) -> DataFrame:
    """Table fragments of a customer, an order each: with a header, without, or with a row in its place."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = _t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", n.alias("n"))
    row = F.array(F.col("n").cast("string"), F.col("o_orderstatus"))
    header = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("No"), F.lit("Status"))).when(F.col("o_orderkey") % 3 == 2, row)
    return o.select("o_custkey", "n", header.alias("header"), F.array(F.array(F.when(F.col("o_orderkey") % 5 == 0, "-").otherwise(F.col("n").cast("string")), F.col("o_orderstatus"))).alias("rows"))


def q11_table_continuation(spark, d):
    return tables.continuations(_fragments(spark, d), ["o_custkey"], "n").select("o_custkey", F.col("n").cast("long").alias("n"), "continues")


def q12_table_repair(spark, d):
    rows = lines.explode_lines(_pipe_orders(spark, d), ["o_custkey"])
    r = tables.repairs(tables.pipe_rows(rows, ["o_custkey"]), ["o_custkey"])
    return r.select("o_custkey", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "broken", F.md5(F.col("text").cast("binary")).alias("digest"))


def q13_heading_clamp(spark, d):
    rows = lines.explode_lines(_t(spark, d, "documents"), ["doc_id"])
    heads = rows.where("trim(line) <> ''").select("doc_id", "ln", F.concat(F.repeat(F.lit("#"), (F.col("ln") * F.col("ln") % 6 + 1).cast("int")), F.lit(" x")).alias("line"))
    return lines.clamp_headings(heads, ["doc_id"]).select("doc_id", F.col("ln").cast("long").alias("ln"), F.col("level").cast("long").alias("level"), F.col("clamped").cast("long").alias("clamped"))


def q14_fence_parity(spark, d):
    rows = lines.explode_lines(_t(spark, d, "documents"), ["doc_id"]).select("doc_id", "ln", F.when(F.col("ln") % 4 == 0, "```").otherwise("x").alias("line"))
    return lines.with_state(rows, ["doc_id"]).groupBy("doc_id").agg(F.count_if("fenced").alias("n_fenced"), F.count(F.lit(1)).alias("n_lines"))


def q15_page_artifacts(spark, d):
    c = _t(spark, d, "conversations")
    text = F.concat(F.lit("<!-- Page "), (F.col("turn") + 1).cast("string"), F.lit(" -->\n"), F.col("text"), F.lit("\n\n"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("- "), (F.col("turn") + 1).cast("string"), F.lit(" -"))).otherwise(F.concat(F.lit("Page "), (F.col("turn") + 1).cast("string"))))
    docs = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", text.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    found = lines.page_artifacts(lines.explode_lines(docs, ["conv_id"]), ["conv_id"])
    return found.groupBy("conv_id").agg(F.count_if("artifact").alias("n_artifacts"), F.count(F.lit(1)).alias("n_lines"))


def q16_stitch_pages(spark, d):
    half = F.floor(F.length("text") / 2).cast("int")
    cut = F.concat(F.substring("text", F.lit(1), half), F.lit("\n\n<!-- Page 2 -->\n\n"), F.substring(F.col("text"), half + 1, F.length("text")))
    return _t(spark, d, "conversations").select("conv_id", "turn", cut.alias("text")).select("conv_id", "turn", F.md5(markup.stitch_pages(F.col("text")).cast("binary")).alias("digest"))


def q17_column_merge(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("page"), F.floor(F.col("o_totalprice") % 900).cast("double").alias("l"), (F.col("o_orderkey") % 50 + 20).cast("double").alias("w"))
    boxes = o.select("page", "l", (F.col("l") + F.col("w")).alias("r"))
    return layout.columns(boxes, ["page"], F.lit(1000.0)).select("page", F.col("left").alias("left_edge"), F.col("right").alias("right_edge"), "cut")


def _boxes(spark, d) -> DataFrame:
    """A box for each line item, sixteen order keys to a page: pages grow in number with the orders, not in size."""
    x = _t(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 16).alias("page"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    left, top = (F.col("l_partkey") * 37 % 800).cast("double"), F.floor(F.col("l_extendedprice") % 1200).cast("double")
    b = x.select("page", "l_returnflag", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), left.alias("l"), top.alias("t"), (left + F.col("l_quantity") * 14 + 10).alias("r"), (top + F.col("l_suppkey") % 90 + 12).alias("b"), "l_quantity")
    return b.groupBy("page", "id").agg(F.min_by(F.struct("l_returnflag", "l", "t", "r", "b"), F.struct("l", "t", "r", "b", "l_returnflag")).alias("x")).select("page", "id", "x.*")


def q18_reading_order(spark, d):
    return layout.reading_order(_boxes(spark, d), ["page"], "id", F.lit(1000.0)).select("page", "id", F.col("band").cast("long").alias("band"), F.col("column").cast("long").alias("col"), F.col("place").cast("long").alias("place"))


def q19_overlap_anti_join(spark, d):
    b = _boxes(spark, d)
    other = b.where("l_returnflag = 'R'")
    return layout.without_overlap(b.where("l_returnflag <> 'R'"), other, ["page"]).select("page", "id")


def q20_point_in_segment(spark, d):
    b = _boxes(spark, d)
    points = b.where("l_returnflag = 'A'").select("page", "id", ((F.col("l") + F.col("r")) / 2).alias("x"), ((F.col("t") + F.col("b")) / 2).alias("y"))
    return layout.nearest_segment(points, b.where("l_returnflag = 'R'"), ["page"], "id", "id").select("page", "id", F.coalesce("seg", F.lit(-1)).alias("seg"))


def q21_exact_dedup(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "lang", F.col("text").alias("content"))
    return assembly.distinct_assets(docs, ["lang"], "doc_id").select("doc_id", "lang", "digest")


def _altered(spark, d) -> DataFrame:
    """Whole benchmark texts and copies of them: `the` spelled otherwise, `and` two words, white space doubled, upper case."""
    e = F.col("text")
    return _t(spark, d, "benchmark").select("item_id", e.alias("e"), F.upper(F.replace(F.replace(F.replace(e, F.lit("the"), F.lit("thé")), F.lit("and"), F.lit("an d")), F.lit(" "), F.lit("  "))).alias("a"))


def q22_cer(spark, d):
    return _altered(spark, d).select("item_id", scoring.char_error_rate(F.col("e"), F.col("a")).alias("cer"))


def q23_wer(spark, d):
    return _altered(spark, d).select("item_id", scoring.word_error_rate(F.col("e"), F.col("a")).alias("wer"))


def q24_number_f1(spark, d):
    each = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity").cast("int")).alias("e"), F.collect_list((F.col("l_partkey") % 50 + 1).cast("int")).alias("a"))
    return each.select("l_orderkey", scoring.multiset_f1(F.col("e"), F.col("a")).alias("f1"))


def q25_structure_f1(spark, d):
    item = lambda test: F.when(test, "- x").otherwise("1. x")
    g = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(item(F.col("l_partkey") % 2 == 0)), "\n").alias("e"), F.array_join(F.collect_list(item(F.col("l_partkey") % 3 == 0)), "\n").alias("a"))
    return g.select("l_orderkey", scoring.multiset_f1(scoring.list_items(F.col("e")), scoring.list_items(F.col("a"))).alias("f1"))


def q26_choose_best(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.col("text"))
    both = docs.withColumn("attempt", F.lit(1)).unionByName(docs.select("doc_id", F.translate("text", "$", "").alias("text"), F.lit(2).alias("attempt")))
    best = quality.choose_best(both.withColumn("errors", quality.core_errors(F.col("text"))), ["doc_id"], "attempt", columns=["attempt", "errors"])
    return best.select("doc_id", F.col("attempt").cast("long").alias("attempt"), F.array_join(F.array_sort("errors"), ",").alias("errors"))


def _marked_docs(spark, d) -> DataFrame:
    """Documents, every seventh line cut, every eleventh hyphened, every thirteenth with a word too long; made where the texts are, without a shuffle."""
    end = lambda n: F.when(n % 7 == 0, "...").when(n % 11 == 0, " x-").when(n % 13 == 0, F.concat(F.lit(" "), F.repeat(F.lit("z"), 50))).otherwise("")
    marked = F.transform(cut_lines(F.col("text")), lambda x, i: F.concat(F.translate(x, "-–.", "   "), end(i + 1)))
    return _t(spark, d, "documents").where("text <> ''").select("doc_id", F.array_join(marked, "\n").alias("text"))


def q27_suspicious_lines(spark, d):
    c = review.suspicious_lines(_marked_docs(spark, d), ["doc_id"])
    return c.select("doc_id", F.col("line_idx").cast("long").alias("line_idx"), F.array_join("reasons", ",").alias("reasons"), "severity")


def _candidates(spark, d) -> DataFrame:
    kinds = [["invalid_table_grid"], ["truncated_line"], ["possible_missing_printed_footer"], ["unusual_word"], ["mass_diacritic_loss"], ["glued_characters"]]
    reasons = F.element_at(F.array(*(F.array(*(F.lit(r) for r in k)) for k in kinds)), (F.col("l_partkey") % 6 + 1).cast("int"))
    x = _t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    return x.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("long").alias("line_idx"), reasons.alias("reasons"), review.severity(reasons).alias("severity"), F.lit(12).alias("n_content"))


def q28_review_budget(spark, d):
    return review.within_budget(_candidates(spark, d), ["page"]).select("page", "line_idx", "severity")


def q29_reread_escalation(spark, d):
    return review.reread_pages(_candidates(spark, d), ["page"])


def _lexicon(spark):
    entries = spark.createDataFrame([("thé",), ("ànd",), ("thé ànd",), ("ôf thé",), ("ôf",), ("dér ünd",), ("dér",), ("ünd",)], "entry string")
    return spelling.build_lexicon(entries)


def q30_spelling_suggest(spark, d):
    """Three words for each order, of the lexicon but without its accents, some titled or upper case; a comma parts the first two of every third."""
    word = lambda n: F.element_at(F.array(*(F.lit(w) for w in ("the", "and", "of", "der", "und", "The", "AND"))), (F.floor(F.col("o_orderkey") / n) % 7 + 1).cast("int"))
    gap = F.element_at(F.array(F.lit(" "), F.lit(", "), F.lit("\n")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    docs = _t(spark, d, "orders").select("o_orderkey", F.concat(word(1), gap, word(7), F.lit(" "), word(49)).alias("text"))
    return spelling.suggestions(docs, ["o_orderkey"], _lexicon(spark)).select("o_orderkey", F.col("at").cast("long").alias("at"), "left", "right", "new_left", "new_right")


def q31_lexicon_build(spark, d):
    tokens = _t(spark, d, "documents").select(F.explode(words(F.lower("text"), LETTERS)).alias("value")).distinct()
    _, accents, _ = spelling.build_lexicon(spelling.lexicon_entries(tokens))
    return accents.select("plain", F.array_join("forms", ",").alias("forms"))


def q33_blank_response(spark, d):
    c = _t(spark, d, "conversations")
    said = F.when(F.col("turn") % 3 == 0, "The image provided is a blank page.").when(F.col("turn") % 3 == 1, F.concat(F.lit("(empty response)"), F.when(F.col("conv_id") % 2 == 0, " .").otherwise(" x"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", markup.is_blank_response(said).alias("is_blank"))


def _runs(spark, d) -> DataFrame:
    v = F.coalesce(F.col("value"), F.lit(0.0))
    return _t(spark, d, "events").select(
        F.col("event_type").alias("config"), F.when(F.col("user_id") % 97 == 0, "ERROR").otherwise("OK").alias("status"), F.when(F.col("event_id") % 501 == 0, 1).otherwise(0).cast("long").alias("cuda_oom_count"), F.lit(10.0).alias("seconds_per_page"),
        F.floor(v * 100).alias("quality_score"), v.alias("vram_mb_peak"), (F.col("user_id") % 3).alias("retry_count"), (F.col("user_id") % 2).alias("timeout_count"), (F.col("event_id") % 4 + 1).alias("run"),
    )


def q34_bench_summary(spark, d):
    return bench.summary(_runs(spark, d).withColumn("quality_score", F.col("quality_score").cast("double"))).select("config", "disqualified", F.bround("quality_score_avg", 4).alias("quality_score_avg"), "vram_mb_peak", "retry_total", "timeout_total", "cuda_oom_total")


def q35_json_reply(spark, d):
    """Properties of events as a model's reply in a code fence; every seventh isn't JSON."""
    fenced = F.concat(F.lit("```json\n"), F.when(F.col("event_id") % 7 == 0, F.lit("no JSON")).otherwise(F.col("props")), F.lit("\n```"))
    e = _t(spark, d, "events").select("event_id", model_json(fenced, "map<string,string>").alias("x"))
    return e.select("event_id", F.element_at("x", "k").alias("k"), F.when(F.col("x").isNull(), -1).otherwise(F.size("x")).cast("long").alias("n_keys"))


def q36_quality_rollup(spark, d):
    r = quality.core_report(_t(spark, d, "documents"), ["doc_id", "lang"]).join(_t(spark, d, "labels"), "doc_id")
    return quality.rollup(r, "lang", "quality").select("lang", F.coalesce(F.col("quality").cast("string"), F.lit("all")).alias("quality"), "pages", F.round("score", 6).alias("score"), "passed")


def q37_finalise(spark, d):
    """A page text for each order, with damage of every kind; the table is sound, of uneven rows, or an HTML table left open."""
    k, s = F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    head = F.concat(F.lit("#Order "), k, F.lit(" ## Status "), s, F.lit("\n\nThe order was\nplaced by customer "), F.col("o_custkey").cast("string"), F.lit("\n\n- item\n  goes on here\n\n"))
    images = F.concat(F.lit("![ a ](.\\img\\"), k, F.lit(".png)\n\n![b](img/"), k, F.lit(".png)\n\nEnd of this page is cut in a sen-\n\n<!-- Page 2 -->\n\ntence of it.\n\nTrang 1/6\n\n"))
    rows = F.concat(F.lit("| key | status |\n| --- | --- |\n| "), k, F.lit(" | "), s, F.lit(" |"))
    table = F.when(F.col("o_orderkey") % 3 == 0, rows).when(F.col("o_orderkey") % 3 == 1, F.concat(rows, F.lit(" more |"))).otherwise(F.concat(F.lit("<table><tr><th>key</th><th>status</th></tr>\n\n<tr><td>"), k, F.lit("</td><td>"), s))
    docs = _t(spark, d, "orders").select("o_orderkey", F.concat(head, images, table).alias("text"))
    return assembly.finalise(docs).select("o_orderkey", F.md5(F.col("final").cast("binary")).alias("digest"), assembly.describe(F.col("report")).alias("report"))


def q38_stream_pages(spark, d):
    import uuid

    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = f"{folder or '/tmp/checkpoints/docspark'}/streams/{uuid.uuid4().hex}"
    source = streams.arriving(spark, f"{d}/documents.parque[t]", spark.read.parquet(f"{d}/documents.parquet").schema)
    streams.write(quality.core_report(source, ["doc_id"]), f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out")


def q39_cold_warm(spark, d):
    return bench.cold_warm(_runs(spark, d), "config", "vram_mb_peak").select("config", F.round("cold", 6).alias("cold"), F.round("warm", 6).alias("warm"))


def q40_full_gate(spark, d):
    r = quality.report(_t(spark, d, "documents").select("doc_id", "text"), html_tables=tables.html_structure(F.when(F.col("text").rlike("(?i)<table"), F.col("text"))))
    return r.select("doc_id", "score", "should_retry", "passed", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"))


def q41_progress_windows(spark, d):
    e = streams.progress(_t(spark, d, "events"), width="1 day")
    return e.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def q42_close_tables(spark, d):
    text = F.concat(F.lit("<table><tr><td>"), F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 2 == 0, "</td></tr>").otherwise("</td>"), F.when(F.col("o_orderkey") % 3 == 0, "</table>").otherwise(""))
    return _t(spark, d, "orders").select("o_orderkey", markup.close_tables(text).alias("text"))


def q43_fill_slots(spark, d):
    o = _t(spark, d, "orders")
    slots, items = o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1")
    s = slots.select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("at"))
    i = items.select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("at"), F.col("o_orderkey").alias("item"))
    return assembly.fill_slots(s, i, ["page"], "at", "at").select("page", F.col("k").cast("long").alias("k"), F.coalesce("slot", F.lit(-1)).alias("slot"), F.coalesce("item", F.lit(-1)).alias("item"))


def q44_block_offsets(spark, d):
    b = assembly.with_offsets(_t(spark, d, "conversations").withColumnRenamed("text", "content"), ["conv_id"], "turn")
    return b.select("conv_id", "turn", F.col("md_start").cast("long").alias("md_start"), F.col("md_end").cast("long").alias("md_end"))


def q45_unreferenced_assets(spark, d):
    o = _t(spark, d, "orders")
    pages = o.where("o_orderkey % 2 = 0").select("o_custkey", F.concat(F.lit("![x](p"), F.col("o_orderkey").cast("string"), F.lit(".png)")).alias("text"))
    assets = o.select("o_custkey", F.concat(F.when(F.col("o_orderkey") % 5 == 0, "../p").otherwise("p"), F.col("o_orderkey").cast("string"), F.lit(".png")).alias("name"))
    return assembly.unreferenced(assets, pages, ["o_custkey"]).select("o_custkey", "name")


def q46_unaccented_words(spark, d):
    t = _t(spark, d, "documents").select("lang", F.explode(words(casefold(F.col("text")), LETTERS)).alias("w"))
    return t.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("w").alias("n_words"), F.count_distinct(unaccented(F.col("w"))).alias("n_plain"))


def q47_span_boxes(spark, d):
    """The orders of a customer as lines, each 10 characters further; the even ones begin spans of 15, every fifth inexact, every seventh an image."""
    o = _t(spark, d, "orders")
    at = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1) * 10
    rows = o.select("o_custkey", "o_orderkey", at.alias("start"))
    spans = rows.where("start % 20 = 0").select("o_custkey", F.col("start").alias("md_start"), (F.col("start") + 15).alias("md_end"), F.when(F.col("o_orderkey") % 7 == 0, "image").otherwise("text").alias("kind"), (F.col("o_orderkey") % 5 != 0).alias("exact"), *(F.col("o_orderkey").alias(c) for c in "ltrb"))
    return review.span_boxes(rows, spans, ["o_custkey"]).select("o_custkey", "o_orderkey", F.coalesce("box.l", F.lit(-1.0)).alias("box"))


def _regions(spark, d) -> DataFrame:
    """A region for each third order of a customer's page."""
    o = _t(spark, d, "orders").where("o_orderkey % 3 = 0")
    left, top = (F.col("o_orderkey") * 37 % 600).cast("double"), (F.col("o_orderkey") * 91 % 1100).cast("double")
    return o.select("o_custkey", left.alias("l"), top.alias("t"), (left + F.col("o_orderkey") % 200 + 20).alias("r"), (top + F.col("o_orderkey") % 70 + 10).alias("b"))


def q48_ranked_boxes(spark, d):
    rows = _t(spark, d, "orders").where("o_orderkey % 3 <> 0").select("o_custkey", "o_orderkey")
    return review.ranked_boxes(rows, _regions(spark, d), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", F.coalesce("box.l", F.lit(-1.0)).alias("l"), F.coalesce("box.t", F.lit(-1.0)).alias("t"))


def q49_review_boxes(spark, d):
    o = _t(spark, d, "orders").where("o_orderkey % 3 <> 0")
    left, top = (F.col("o_orderkey") * 53 % 600).cast("double"), (F.col("o_orderkey") * 29 % 1100).cast("double")
    boxes = o.select("o_custkey", "o_orderkey", left.alias("l"), top.alias("t"), (left + 50).alias("r"), (top + 20).alias("b"))
    return review.review_boxes(boxes, _regions(spark, d), ["o_custkey"], "o_orderkey", F.lit(800), F.lit(1200))


def q50_merge_column_blocks(spark, d):
    o = _t(spark, d, "orders")
    left, top = (F.col("o_orderkey") % 4 * 60).cast("double"), (F.col("o_orderkey") * 7 % 40).cast("double")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) * 30
    boxes = o.select("o_custkey", "o_orderkey", left.alias("l"), (top + n).alias("t"), (left + 400 + F.col("o_orderkey") % 90).alias("r"), (top + n + 25).alias("b"))
    return layout.merge_column_blocks(boxes, ["o_custkey"], "o_orderkey", F.lit(1000), F.lit(800)).select("o_custkey", F.col("n").cast("long").alias("n"), "l", "t", "r", "b")


def q51_finalise_documents(spark, d):
    """Every document as a page text, with an image and an HTML table left open."""
    docs = _t(spark, d, "documents").select("doc_id", F.concat(F.col("text"), F.lit("\n\n![ a ](.\\x.png)\n\n<table><tr><th>A</th><th>B</th></tr>\n\n<tr><td>1</td><td>2")).alias("text"))
    return assembly.finalise(docs).select("doc_id", F.md5(F.col("final").cast("binary")).alias("digest"), assembly.describe(F.col("report")).alias("report"))


def q52_link_images(spark, d):
    """Two Markdown placeholders about an HTML and a bare one, and the paths of none to five images, the first of which may be linked already."""
    k = F.col("o_orderkey").cast("string")
    paths = F.transform(F.sequence(F.lit(0), (F.col("o_orderkey") % 6).cast("int")), lambda i: F.concat(F.lit("p"), i.cast("string"), F.lit(".png")))
    text = F.concat(F.lit("![one](image_placeholder.png) <img alt='two' src='x/image_placeholder'> image_placeholder.jpg ![](a/image_placeholder) "), k, F.when(F.col("o_orderkey") % 4 == 0, " ![own](p0.png)").otherwise(""))
    linked = _t(spark, d, "orders").select("o_orderkey", assembly.link_images(text, F.slice(paths, 1, (F.col("o_orderkey") % 6).cast("int"))).alias("x"))
    return linked.select("o_orderkey", "x.text", F.array_join("x.remaining", ",").alias("remaining"))


def q53_retained_blocks(spark, d):
    o = _t(spark, d, "orders")
    boxes = o.select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "image").otherwise("text").alias("kind"), *(F.floor(F.col("o_orderkey") % n).alias(c) for c, n in zip("ltrb", (5, 7, 3, 2), strict=True)))
    accepted = boxes.where("kind = 'image' AND o_orderkey % 3 = 0")
    return layout.retained(boxes, accepted, ["o_custkey"]).select("o_custkey", "o_orderkey", "kind")


def q54_unsound_pages(spark, d):
    scored = _candidates(spark, d).withColumn("score", F.when(F.col("page") % 3 == 0, 100.0).when(F.col("page") % 3 == 1, 85.0))
    return review.of_unsound_pages(scored).select("page", "line_idx", "severity")


def q55_nearby_boxes(spark, d):
    top = (F.col("line_idx") * 40 % 130).cast("double")
    left = F.when(F.col("line_idx") % 5 != 0, (F.col("page") % 50).cast("double"))
    boxed = _candidates(spark, d).withColumns({"l": left, "t": top, "r": F.col("page") % 50 + F.col("line_idx") * 5 + 1.0, "b": top + 20})
    found = review.nearby_groups(boxed, ["page"], height=F.lit(1000.0))
    return found.select("page", "line_idx", F.col("grp").cast("long").alias("grp"))


def q56_against_truth(spark, d):
    b = _altered(spark, d)
    found = bench.against_truth(b.select("item_id", F.col("a").alias("text")), b.where("item_id % 3 <> 0").select("item_id", F.col("e").alias("text")), "item_id")
    return found.select("item_id", F.coalesce("scores.cer", F.lit(-1.0)).alias("cer"), F.coalesce("scores.wer", F.lit(-1.0)).alias("wer"))


def q57_without_blank(spark, d):
    c = _t(spark, d, "conversations")
    return assembly.without_blank(c.select("conv_id", "turn"), c.where(markup.is_blank_response(F.when(F.col("turn") % 3 == 0, "(empty response)").otherwise(F.col("text")))), ["conv_id", "turn"])


def q58_fill_formulas(spark, d):
    """Two placeholders, and none to three formulas."""
    n = (F.col("o_orderkey") % 4).cast("int")
    formulas = F.slice(F.array(F.lit("$x$"), F.concat(F.lit("$"), F.col("o_orderkey").cast("string"), F.lit("$")), F.lit("$z$")), 1, n)
    text = F.concat(F.lit("a formula_placeholder b FORMULA_PLACEHOLDER "), F.col("o_orderstatus"), F.lit("\n"))
    return _t(spark, d, "orders").select("o_orderkey", assembly.fill_formulas(text, formulas).alias("text"))


def q59_insert_images(spark, d):
    """Four paragraphs, one to five blocks of which every other is an image, and none to three paths, the first of which may be linked already."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("p0\n\np1"), F.when(k % 3 == 0, " ![x](i0.png)").otherwise(""), F.lit("\n\n\np2\n\np3"))
    kinds = F.slice(F.array(*(F.lit(x) for x in ("text", "image", "text", "image", "text"))), 1, (k % 5 + 1).cast("int"))
    paths = F.slice(F.array(*(F.lit(f"i{i}.png") for i in range(3))), 1, (k % 4).cast("int"))
    return _t(spark, d, "orders").select("o_orderkey", assembly.insert_images(text, paths, kinds).alias("text"))


def q60_merge_near(spark, d):
    return layout.merge_near(_regions(spark, d), ["o_custkey"]).select("o_custkey", F.col("n").cast("long").alias("n"), "l", "t", "r", "b")


def q61_spelling_documents(spark, d):
    """Suggestions for every pair of neighbouring words of the documents."""
    found = spelling.suggestions(_t(spark, d, "documents"), ["doc_id"], _lexicon(spark))
    return found.select("doc_id", F.col("at").cast("long").alias("at"), "left", "right", "new_left", "new_right")


QUERIES = {name: f for name, f in sorted(globals().items()) if name.startswith("q") and name[1:3].isdigit()}
