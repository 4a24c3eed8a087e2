import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docspark.functions import htmltables, loops
from docspark.operators import assembly, bench, images, layout, lines, quality, review, spelling, tables

LINE = "This is a line of prose that is long enough to count."


def report(spark, *texts, **options):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return quality.report(rows, **options).orderBy("i").collect()


def test_gate_codes(spark):
    cases = [
        ("", "empty_page"), (None, "empty_page"), ("```\nx", "unclosed_code_blocks"), ("a ` b", "unclosed_inline_code"), ("| a | b |\n| c |", "malformed_markdown_table:1"),
        ("<table><tr></tr>", "malformed_html_table:table"), ("\n".join([LINE] * 4), "repetition_loop"), ("# same thing\n## same thing\n### same thing\n#### same thing", "repetition_loop"),
        ("no no no no no no and more words here", "repeated_words"), ("x " + "cuavalatrong" * 5, "glued_words"), ("a $ b", "unbalanced_math_delimiters"), ("image_placeholder", "unresolved_placeholder"),
    ]
    for (t, code), r in zip(cases, report(spark, *[c[0] for c in cases]), strict=True):
        assert code in r.errors, (t, r.errors)
        assert 0 <= r.score <= 100 and not r.passed
    clean = report(spark, "# Title\n\nSome prose.\n\n| a | b |\n| --- | --- |\n| 1 | 2 |")[0]
    assert clean.errors == [] and clean.passed and clean.score == 100 and not clean.should_retry


def test_loop_of_several_lines_matches_rewrite(spark):
    other = "Another line of running text, also long enough here."
    texts = ["\n".join([LINE, other] * 3), "\n".join([LINE, other] * 2), "\n".join([LINE, "x"] * 3), "```\n" + "\n".join([LINE] * 5) + "\n```", "\n".join([LINE] * 3)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(quality.has_loop(F.col("t")).alias("x")).collect()
    assert [r.x for r in rows] == [loops.collapse(t) != t for t in texts]


def test_lost_diacritics_and_language(spark):
    lost = "cua va la trong duoc cho voi tu den mot nhung cac nay theo tai ve khi co viet nam nguoi nuoc thanh pho phat trien."
    r = report(spark, lost, "The men and the women of the town are in the house for the day with all of this and that too.")
    assert "missing_vietnamese_diacritics" in r[0].errors and r[0].should_retry
    rows = spark.createDataFrame([(lost,), ("The men and the women of the town are in the house for the day with all of this and that too.",), ("short",)], "t string")
    assert [x.p for x in rows.select(quality.language_profile(F.col("t")).alias("p")).collect()] == ["vi", "en", "unknown"]


def test_language_by_words_that_are_not_gathered(spark):
    filler = "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt "
    cases = {
        "cua va la": "vi", "cua va laa": "unknown", "cua1 va_ (la)": "vi", "đi đường một": "vi", "éa aé éé": "vi", "éaé éxé": "unknown", "THE And oF": "en", "the and": "unknown", "the-and-of": "en", "thé ands of": "unknown",
        "the and of cua va là": "mixed_vi_en", "`the` `and` `of`": "unknown", "the and of@x.y": "unknown", "[the](and) [and](x) of": "en", "ÅÉ Ý Ẳ": "vi", "ß ä ö ü": "unknown",
    }
    texts = [filler + x for x in cases] + ["| " + filler + "the and of", filler.upper() + "THE AND OF", "1" * 30 + filler + "the and of", "the and of", "# " + filler + "the and of", None, ""]
    want = [*cases.values(), "unknown", "unknown", "unknown", "unknown", "en", "unknown", "unknown"]
    found = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").select("i", quality.language_profile(F.col("t")).alias("p"))
    assert [r.p for r in found.orderBy("i").collect()] == want
    # No array of all words, nor of all letters, of a text.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert r"\p{L}, 0" not in plan and "[a-zA-ZÀ-ỹĐđ]+, 0" not in plan


def test_addresses_in_a_long_word_without_end(spark):
    text = "x@" * 4000
    assert [r.p for r in spark.createDataFrame([(text,), (text + "y.z",)], "t string").select(quality.prose(F.col("t")).alias("p")).collect()] == [[], []]


def test_lost_diacritics_of_words_with_signs_about_them(spark):
    plain = "viet nam nguoi nuoc thanh pho lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore magna aliqua enim minim veniam quis nostrud"
    texts = [f"cua_ va_ la_ {plain}.", f"c`x`ua v`x`a l`x`a {plain}.", f"cuax vax lax {plain}.", f"cua va la {plain}."]
    assert ["missing_vietnamese_diacritics" in r.errors for r in report(spark, *texts)] == [True, True, False, True]


def test_runs_tell_the_gate_what_they_tell_by_themselves(spark):
    tail = " and so on with more words"
    texts = [
        "no " * 5 + tail, "no " * 4 + tail, "No, nO. no! NO no" + tail, "no no no\nno no" + tail, "no\nno no no no no", "straße STRASSE strasse Straße STRAßE" + tail, "ΑΣ ας ΑΣ Ας ΑΣ" + tail, "nok " * 2 + "no\u212a " * 3 + tail,
        "no\u00b2 " * 5 + tail, "<!-- " + "no " * 6 + tail, "x" + "no " * 5 + "nox" + tail, "nono " * 5, "\n".join(["same line"] * 4), "\n".join(["# Same Line", "same line", "", "<!-- x -->", "## same line", "SAME LINE"]), "\n".join(["same line"] * 3),
        "\n".join(["ßßß", "SSSSSS"] * 2), "\n".join(["short"] * 9), "\n".join(["same line", "other line"] * 4), "\r\n".join(["same line"] * 4), "", None,
    ]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    c = F.col("t")
    got = rows.select((quality.word_run(c) >= 5).alias("word"), quality.four_lines(c).alias("l"), (quality.line_run(c) >= 4).alias("line"), quality.core_errors(c).alias("e")).collect()
    assert [r.l for r in got] == [r.line for r in got]
    assert {r.word for r in got} == {r.l for r in got} == {True, False}
    assert [("repeated_words" in r.e, "repetition_loop" in r.e) for r in got] == [(r.word, r.line) for r in got]


def test_missing_images(spark):
    r = report(spark, "![a](x.png) ![b](y.png) ![c](https://h/z.png)", assets=F.array(F.lit("x.png")))
    assert r[0].errors == ["missing_image:y.png"] and r[0].score == 60


def test_choose_best_keeps_the_first_of_equals(spark):
    rows = spark.createDataFrame([(1, 1, "abc", []), (1, 2, "abd", []), (2, 1, "x", ["empty_page"]), (2, 2, "y", ["glued_words"]), (3, 1, "ab", []), (3, 2, "abc", [])], "p int, n int, text string, errors array<string>")
    assert {r.p: r.n for r in quality.choose_best(rows, ["p"], "n").collect()} == {1: 1, 2: 2, 3: 2}


def test_completeness(spark):
    rows = spark.createDataFrame([(1, 1, 3), (1, 3, 3), (2, 1, 2), (2, 2, 2), (2, 2, 2)], "d int, p int, n int")
    got = {r.d: r for r in quality.completeness(rows, "d", "p", "n").collect()}
    assert got[1].errors == ["missing_pages:2"] and got[2].errors == ["duplicate_pages:2"]


def test_clamp_against_a_loop(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for d in range(20):
        last = None
        for n, level in enumerate(rng.integers(1, 9, 15)):
            rows.append((d, n + 1, "#" * int(level) + " x"))
            level = min(int(level), 6)
            last = level if last is None else min(level, last + 1)
            want[d, n + 1] = last
    got = lines.clamp_headings(spark.createDataFrame(rows, "d int, ln int, line string"), ["d"]).collect()
    assert {(r.d, r.ln): r.clamped for r in got} == want


def test_paragraphs_and_lists_join(spark):
    t = "A first line that\ngoes on here\nand ends.\nnot joined to a sentence\n\n- item one\n  more of it\n```\ncode\nlower\n```\nTitle\nOther title"
    rows = lines.explode_lines(spark.createDataFrame([(1, t)], "d int, text string"), ["d"])
    got = lines.assemble_lines(lines.join_paragraphs(rows, ["d"]), ["d"]).first().text
    assert got == "A first line that goes on here and ends.\nnot joined to a sentence\n\n- item one more of it\n```\ncode\nlower\n```\nTitle\nOther title"


def test_page_artifacts(spark):
    t = "<!-- Page 1 -->\nBody of the page\n- 1 -\n<!-- Page 2 -->\n2\nText\na\nb\nc\nd\n12\ne\nf\ng\nh\ni\nPage 2/9"
    rows = lines.explode_lines(spark.createDataFrame([(1, t)], "d int, text string"), ["d"])
    gone = [r.line for r in lines.page_artifacts(rows, ["d"]).where("artifact").orderBy("ln").collect()]
    assert gone == ["- 1 -", "2", "Page 2/9"]


def test_runs(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate("aabbbac", 1)], "d int, ln int, line string")
    got = {(r.value, r.first, r.length) for r in lines.runs(rows, ["d"], F.col("line"), 2).collect()}
    assert got == {("a", 1, 2), ("b", 3, 3)}


def test_table_structure():
    bad = "<table><tr><td>a</td></tr><tr><td>b</td><td>c</td></tr></table>"
    assert htmltables.structure_errors(bad) == ["malformed_html_table:inconsistent_logical_columns"]
    assert htmltables.structure_errors("<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr></table>") == []
    assert "malformed_html_table:invalid_span" in htmltables.structure_errors("<table><tr><td colspan=x>a</td></tr></table>")
    assert htmltables.structure_errors(None) == []


def test_html_to_pipes():
    assert htmltables.simple_to_pipes("<table><tr><th>A</th><th>B</th></tr><tr><td>1|2</td></tr><tr><td>A</td><td>B</td></tr></table>") == "| A | B |\n| --- | --- |\n| 1\\|2 |  |"
    kept = "<table><tr><td colspan=2>a</td></tr><tr><td>b</td><td>c</td></tr></table>"
    assert htmltables.simple_to_pipes(kept) == kept


def test_html_tables_join_over_page_marks():
    t = "<table><tr><td>1</td></tr></table>\n<!-- Page 2 -->\n<table><tr><td>2</td></tr></table>\nend"
    assert htmltables.joined(t) == "<table><tr><td>1</td></tr><tr><td>2</td></tr></table>\n<!-- Page 2 -->\n\nend"
    apart = "<table><tr><td>1</td></tr></table>\ntext\n<table><tr><td>2</td></tr></table>"
    assert htmltables.joined(apart) == apart


def test_order_keys_and_fragments(spark):
    rows = spark.createDataFrame([("12.",), ("b)",), ("**XIV**",), ("I",), ("word",), ("",)], "c string").select(tables.order_key(F.col("c")).alias("k")).collect()
    assert [tuple(r.k) if r.k else None for r in rows] == [("number", 12), ("letter", 98), ("roman", 14), ("letter", 105), None, None]
    f = spark.createDataFrame([(1, 1, ["No", "x"], [["1", "a"]]), (1, 2, ["2", "b"], [["3", "c"]]), (1, 3, ["Q", "R"], [["1", "z"]])], "d int, n int, header array<string>, rows array<array<string>>")
    got = tables.merge_fragments(f, ["d"], "n").orderBy("first").collect()
    assert [r.rows for r in got] == [[["1", "a"], ["2", "b"], ["3", "c"]], [["1", "z"]]]


def test_columns_and_segments(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0, 400.0, 50.0), (1, 20.0, 60.0, 402.0, 100.0), (1, 600.0, 0.0, 990.0, 80.0)], "p int, l double, t double, r double, b double")
    got = layout.columns(rows, ["p"], F.lit(1000.0)).orderBy("left").collect()
    assert [(r.left, r.right, r.cut) for r in got] == [(0.0, 402.0, 503.0), (600.0, 990.0, None)]
    seg = layout.segments(rows.withColumn("w", F.lit(1000.0)), ["p"], "w").orderBy("seg").collect()
    assert [(r.l, r.r) for r in seg] == [(0.0, 402.0), (600.0, 990.0)] or len(seg) == 3


def test_reading_order(spark):
    rows = [(1, 1, 0.0, 0.0, 1000.0, 50.0), (1, 2, 500.0, 60.0, 900.0, 90.0), (1, 3, 0.0, 100.0, 400.0, 150.0), (1, 4, 0.0, 60.0, 400.0, 90.0), (1, 5, 0.0, 200.0, 1000.0, 240.0), (1, 6, 0.0, 250.0, 300.0, 280.0)]
    got = layout.reading_order(spark.createDataFrame(rows, "p int, id int, l double, t double, r double, b double"), ["p"], "id", F.lit(1000.0)).orderBy("place").collect()
    assert [r.id for r in got] == [1, 5, 4, 3, 2, 6]


def test_text_rows():
    boxes = pd.DataFrame({"l": [50, 0, 0, 60], "t": [1, 0, 30, 31], "r": [90, 40, 50, 90], "b": [11, 10, 40, 41], "text": list("badc")})
    assert layout.text_rows(boxes) == [[1, 0], [2, 3]]


def test_suspicious_lines_and_budget(spark):
    t = "ngày 12..3 tháng\nSố: 12./QD\nthis-that\nfine line\nends here...\n" + "x" * 50
    pages = spark.createDataFrame([(1, t)], "p int, text string")
    c = review.suspicious_lines(pages, ["p"], footer=True)
    got = {r.line_idx: (r.reasons, r.severity) for r in c.collect()}
    assert got[0][0] == ["malformed_date"] and got[1][0] == ["malformed_document_number"] and got[2] == (["possible_pen_stroke_or_glued_punctuation"], "medium")
    assert 3 not in got and "truncated_line" in got[4][0] and got[5][0] == ["glued_characters", "possible_missing_printed_footer"]
    assert [r.line_idx for r in review.within_budget(c, ["p"]).orderBy("line_idx").collect()] == [0, 5]
    assert review.reread_pages(c, ["p"]).first().reread is True


def test_acceptance(spark):
    c = spark.createDataFrame([(1, 0, "teh cat sat", ["truncated_line"]), (1, 1, "abc", ["truncated_line"]), (1, 2, "same", ["truncated_line"])], "p int, line_idx int, text string, reasons array<string>")
    r = spark.createDataFrame([(1, 0, "teh cat sat", "the cat sat", 0.99), (1, 1, "abc", "xyz", 0.99)], "p int, line_idx int, original string, corrected string, confidence double")
    assert {x.line_idx: x.accepted for x in review.accepted(c, r, ["p"]).collect()} == {0: True, 1: False, 2: False}


def test_spelling(spark):
    entries = spark.createDataFrame([("hòa bình",), ("hòa",), ("bình",), ("việt nam",), ("việt",), ("viết",), ("nam",)], "entry string")
    lexicon = spelling.build_lexicon(entries)
    docs = spark.createDataFrame([(1, "muon hoa binh o day"), (2, "HOA binh"), (3, "`hoa binh` hoa, binh"), (4, "viet nam")], "d int, text string")
    got = {(r.d, r.new_left, r.new_right) for r in spelling.suggestions(docs, ["d"], lexicon).collect()}
    assert got == {(1, "hòa", "bình"), (4, "việt", "nam")}
    options = {"hoa": ["hòa"], "binh": ["bình"]}
    assert spelling.correct("Hoa binh", options, {("hòa", "bình")}) == ("Hòa bình", 2)
    assert spelling.correct("$hoa binh$", options, {("hòa", "bình")}) == ("$hoa binh$", 0)


def test_assets_and_documents(spark):
    a = spark.createDataFrame([(1, "a.png", b"x", 1), (1, "b.png", b"x", 2), (1, "https://h/c.png", b"y", 3), (1, "../d.png", b"z", 4)], "d int, name string, content binary, n int")
    assert sorted(r.name for r in assembly.distinct_assets(a, ["d"], "n").collect()) == ["../d.png", "a.png", "https://h/c.png"]
    pages = spark.createDataFrame([(1, 1, "![q](a.png)"), (1, 2, " "), (2, 1, None)], "d int, page int, text string")
    assert [r.name for r in assembly.unreferenced(a, pages, ["d"]).collect()] == ["b.png"]
    docs = {r.d: (r.text, r.n_filled) for r in assembly.documents(pages, ["d"], "page").collect()}
    assert docs == {1: ("<!-- Page 1 -->\n\n![q](a.png)", 1), 2: ("", 0)}


def test_offsets_and_rebase(spark):
    b = spark.createDataFrame([(1, 1, " ab "), (1, 2, ""), (1, 3, "cde")], "p int, n int, content string")
    got = assembly.with_offsets(b, ["p"], "n").orderBy("n").collect()
    assert [(r.md_start, r.md_end) for r in got] == [(0, 2), (4, 7)]
    rows = spark.createDataFrame([([(0, 2), (4, 7)], "ab\n\ncde", "xx ab - cde")], "s array<struct<md_start:int,md_end:int>>, a string, b string")
    moved = rows.select(assembly.rebased(F.col("s"), F.col("a"), F.col("b")).alias("m")).first().m
    assert [tuple(x) for x in moved] == [(3, 5), (8, 11)]


def test_links_of_images_evaluate_a_text_once(spark):
    texts = ["image_placeholder <img src='image_placeholder' alt='z'> ![a](x/image_placeholder)", "![open\nimage_placeholder", "\x01 image_placeholder \x01 ![](image_placeholder.png)", "![q](p0.png) image_placeholder", "plain \\1 $2", None]
    rows = spark.createDataFrame([(i, t, ["p0.png", "p1.png"]) for i, t in enumerate(texts)], "i int, t string, p array<string>")
    linked = rows.select("i", assembly.link_images(F.concat("t", F.lit(" @sign@")), F.col("p")).alias("x"))
    assert linked._jdf.queryExecution().optimizedPlan().toString().count("@sign@") == 1
    h = "![Hình ảnh]"
    want = [
        (" ![z](p1.png) ![a](p0.png) @sign@", []), (f"![open](p0.png)\n{h}(p1.png) @sign@", []), (f"\x01 {h}(p1.png) \x01 {h}(p0.png) @sign@", []), (f"![q](p0.png) {h}(p1.png) @sign@", []), ("plain \\1 $2 @sign@", ["p0.png", "p1.png"]), None,
    ]
    assert [r.x and tuple(r.x) for r in linked.orderBy("i").collect()] == want


def test_finalise_is_stable(spark):
    docs = spark.createDataFrame([(1, "Text\n\n<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2"), (2, "clean text"), (3, None)], "d int, text string")
    once = assembly.finalise(docs).select("d", F.col("final").alias("text"), assembly.describe(F.col("report")).alias("how")).orderBy("d").collect()
    assert once[0].text == "Text\n\n| A | B |\n| --- | --- |\n| 1 | 2 |" and "html_tags_closed: 3" in once[0].how
    assert (once[1].text, once[1].how, once[2].text) == ("clean text", "nothing to repair", None)
    twice = assembly.finalise(spark.createDataFrame([(r.d, r.text) for r in once], "d int, text string")).orderBy("d").collect()
    assert [r.final for r in twice] == [r.text for r in once]


def test_blank_pages():
    white = np.full((400, 300, 3), 250, np.float32)
    page = white.copy()
    for y in range(60, 340, 24):
        page[y : y + 8, 40:260] = 20
    assert images.classify(white) == "blank" and images.classify(page) == "content" and images.classify(None) == "uncertain"
    hole = white.copy()
    hole[190:205, 3:12] = 10
    assert images.classify(hole) == "blank"
    yellow = np.zeros((400, 300, 3), np.float32) + np.array([164, 207, 224], np.float32)
    assert images.classify(yellow) == "blank" and images.classify_plain(white) == "blank"
    stamp = white.copy()
    stamp[100:160, 100:160] = (30, 30, 200)
    assert len(images.chromatic_regions(stamp)) == 1
    assert images.classify(images.mask_regions(stamp, [(0.3, 0.2, 0.6, 0.45)])) == "blank"


def test_scanner_bands_and_sensitivities(spark):
    page = np.full((400, 300), 240.0)
    page[:12], page[:, -9:] = 20, 30
    rows, cols = images.crop_borders(page, images.PROFILES["safe"])
    assert (rows, cols) == (slice(12, 392), slice(6, 291))
    page[:60] = 20
    assert images.crop_borders(page, images.PROFILES["safe"])[0] == slice(36, 392)
    page[:200] = 20
    assert images.crop_borders(np.full((40, 40), 9.0), images.PROFILES["safe"]) == (slice(1, 39), slice(1, 39))
    assert [images.sensitivity_name(x) for x in (None, " Chuẩn ", "MANH", "safe")] == ["safe", "standard", "aggressive", "safe"]
    with pytest.raises(ValueError):
        images.sensitivity_name("bold")


def test_masked_pages_and_graphics_as_columns(spark):
    white = np.full((400, 300, 3), 250, np.uint8)
    stamp = white.copy()
    stamp[150:210, 100:160] = (40, 40, 220)
    rows = [(i, p.shape[0], p.shape[1], 3, p.tobytes()) for i, p in enumerate([white, stamp])] + [(2, None, None, None, None)]
    table = spark.createDataFrame(rows, "i int, height int, width int, nChannels int, data binary").select("i", F.struct("height", "width", "nChannels", "data").alias("image"))
    boxes = images.graphics(F.col("image"))
    got = {r.i: (r.n, r.bare, r.masked) for r in table.withColumn("g", boxes).select("i", F.size("g").alias("n"), images.page_state(F.col("image")).alias("bare"), images.page_state(F.col("image"), masked=F.col("g")).alias("masked")).collect()}
    assert got == {0: (0, "blank", "blank"), 1: (1, "content", "blank"), 2: (0, "uncertain", "uncertain")}


def test_overlap_at_a_tie_is_as_its_sql_multiplies(spark):
    boxes = spark.createDataFrame([(1, 433.0, 928.0, 1017.0, 1023.0), (2, 0.0, 0.0, 10.0, 10.0)], "page int, l double, t double, r double, b double")
    others = spark.createDataFrame([(1, 485.0, 907.0, 901.0, 967.0), (2, 5.0, 3.0, 100.0, 100.0)], boxes.schema)
    # 16224 shared of 416 by 60: 0.65 * 416 * 60 is a little more, 0.65 * (416 * 60) isn't; 35 of 100 is a tie in either order.
    assert [r.page for r in layout.without_overlap(boxes, others, ["page"]).collect()] == [1]


def test_near_boxes_against_pairs_joined_one_by_one():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 12, 40):
        corner = rng.integers(0, 600, (n, 2)).astype(float)
        boxes = np.hstack([corner, corner + rng.integers(1, 60, (n, 2))])
        want = [tuple(b) for b in boxes]
        while True:
            pair = next(((i, j) for i in range(len(want)) for j in range(i) if all(want[i][k] < want[j][k + 2] + 30 and want[j][k] < want[i][k + 2] + 30 for k in (0, 1))), None)
            if pair is None:
                break
            a, b = want.pop(pair[0]), want.pop(pair[1])
            want.append((min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])))
        assert sorted(map(tuple, layout.near_groups(boxes.reshape(-1, 4)).tolist())) == sorted(want)


def test_near_boxes_of_few_and_of_many_by_either_way(spark):
    rng = np.random.default_rng(4)
    rows = []
    for page, n in enumerate((1, 2, 5, 23, 24, 25, 60)):
        corner = rng.integers(0, 900, (n, 2)).astype(float)
        boxes = np.hstack([corner, corner + rng.integers(1, 60, (n, 2))])
        assert layout.few_near_groups(boxes.ravel().tolist()) == layout.near_groups(boxes).tolist()
        rows += [(page, *map(float, b)) for b in boxes]
    frame = spark.createDataFrame([*rows, (99, None, 1.0, 2.0, 3.0)], "page int, l double, t double, r double, b double")
    merged = layout.merge_near(frame, ["page"])
    assert "FlatMapGroupsInPandas" not in merged._jdf.queryExecution().toString()
    got = {(r.page, r.n): (r.l, r.t, r.r, r.b) for r in merged.collect()}
    want = {(p, k): tuple(b) for p in range(7) for k, b in enumerate(layout.near_groups(np.array([r[1:] for r in rows if r[0] == p])).tolist())}
    assert got == want


def test_suggestions_by_a_lexicon_in_every_task_and_by_joins(spark):
    entries = spark.createDataFrame([("thé",), ("the",), ("thè ô",), ("thé ànd",), ("ôf",), ("ôf thé",), ("strassé an",)], "entry string")
    lexicon = spelling.build_lexicon(entries)
    texts = ["of the and, the and of the", "The And thè\nand THE and", "a the\n\nand of\r\nthê $of the$ of `x` thë", "| of the |\nof the/and-1", "×of of thê\u2028and the \x85and", "straße an Straße an ôf thé", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "d int, text string")
    found = spelling.suggestions(docs, ["d"], lexicon)
    plan = found._jdf.queryExecution().toString()
    assert "Join" not in plan and "Exchange" not in plan
    rows = lambda f: sorted(map(tuple, f.select("d", "at", "left", "right", "new_left", "new_right").collect()))
    assert rows(found) == rows(spelling._joined(docs, ["d"], lexicon, "text")) != []


def test_bench(spark):
    rows = spark.createDataFrame([("a", "OK", 10.0, 90.0, 5.0, 1, 0, 0), ("a", "OK", 130.0, 80.0, 7.0, 0, 0, 0), ("b", "ERROR", 1.0, 1.0, 1.0, 0, 0, 0)], "config string, status string, seconds_per_page double, quality_score double, vram_mb_peak double, retry_count int, timeout_count int, cuda_oom_count int")
    got = {r.config: r for r in bench.summary(rows).collect()}
    assert got["a"].disqualified and got["a"].quality_score_avg == 85 and got["b"].seconds_per_page_avg == 0
    t = spark.createDataFrame([([(200, 90.0, 10.0), (250, 90.1, 8.0), (300, 90.4, 20.0)],)], "t array<struct<dpi:int,score:double,seconds:double>>")
    assert t.select(bench.best_resolution(F.col("t")).alias("d")).first().d == 300
