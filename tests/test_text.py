import unicodedata

from pyspark.sql import functions as F

from docspark.functions import choices, loops, markup, mathtext, scoring, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_lines_split_like_text_lines(spark):
    for t in ("", "a", "a\n", "a\n\nb", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x85e\u2028f", "\n", "\n\n"):
        assert one(spark, t, text.lines) == t.splitlines(), repr(t)
    assert one(spark, None, text.lines) == []


def test_strip_takes_unicode_space(spark):
    assert one(spark, "\u00a0 a b\u2003\n", text.strip) == "a b"


def test_unaccented_folds_latin_letters(spark):
    word = "Đường ÀÉÎÕÜ ñç ß ễ"
    plain = "".join(c for c in unicodedata.normalize("NFD", word.casefold().replace("đ", "d")) if unicodedata.category(c) != "Mn")
    assert one(spark, word, text.unaccented) == plain


def test_rewrite_changes_matches_only(spark):
    assert one(spark, "a1b22c", lambda c: text.rewrite(c, r"\d+", lambda m: F.concat(F.lit("<"), m, F.lit(">")))) == "a<1>b<22>c"


def test_case_like(spark):
    rows = spark.createDataFrame([("ABC", "xyz"), ("Abc", "xyz"), ("abc", "xyz")], "a string, b string")
    assert [r.x for r in rows.select(text.case_like(F.col("a"), F.col("b")).alias("x")).collect()] == ["XYZ", "Xyz", "xyz"]


def test_math_codes(spark):
    cases = {
        "$A.$ x": "answer_label_inside_math", "$x A. 1 B. 2$": "multiple_answers_inside_math", "$one two three four five seven$": "prose_inside_math", "$...$": "non_math_math_block",
        "$\\frac{1$": "unbalanced_latex_braces", "$a \\sqrt$": "incomplete_latex_command", "see $$x$$ there": "adjacent_math_blocks", "x$$y$$": "display_math_inline", "$a$ $b$": "adjacent_math_blocks", "plain": None,
    }
    for t, code in cases.items():
        found = one(spark, t, mathtext.errors)
        assert (code in found) if code else found == [], (t, found)


def test_unbalanced_passes_escaped(spark):
    assert one(spark, r"a \$5 and $x$", mathtext.unbalanced) is False
    assert one(spark, "costs $5", mathtext.unbalanced) is True


def test_blank_responses(spark):
    blank = ["", "  ", "(Empty response)", "**no content**", "# x\n## x\n### X\n#### x", "The image provided is a blank page.", "```markdown\n```"]
    full = ["A blank page is left on purpose in this book.", "# x\n## y\n### x\n#### x", "text"]
    assert all(one(spark, t, markup.is_blank_response) for t in blank)
    assert not any(one(spark, t, markup.is_blank_response) for t in full)


def test_clean_response(spark):
    assert one(spark, "```markdown\nHi&nbsp;$one two three four five six$\n```", markup.clean_response) == "Hi one two three four five six"
    assert one(spark, "Here is the converted text:\n\nBody", markup.clean_response) == "Body"
    assert one(spark, "costs $5", markup.clean_response) == "costs $5"


def test_repairs(spark):
    assert one(spark, "<table><tr><td>a", markup.close_tables) == "<table><tr><td>a\n</td></tr></table>"
    assert one(spark, "no table", markup.close_tables) == "no table"
    assert one(spark, "<table>\n\n  <tr>\n<td>a  b</td></tr></table>", markup.compact_tables) == "<table>\n<tr>\n<td>a  b</td></tr></table>"
    assert one(spark, "![ a ](.\\x\\y.png) ![b](https://h/./q)", markup.normalise_images) == "![a](x/y.png) ![b](https://h/./q)"
    assert one(spark, "![a]\\(p\\_x.png)", markup.unescape_image_links) == "![a](p_x.png)"
    assert one(spark, "x ![q](image_placeholder) <img src=\"image_placeholder.png\">\n\n\n\ny", markup.drop_placeholders) == "x\n\ny"
    assert one(spark, "a ![Chữ ký.](s.png) ![logo](l.png)", markup.drop_signatures) == "a  ![logo](l.png)"
    assert one(spark, "One cut-\n\n<!-- Page 2 -->\n\nlower", markup.stitch_pages) == "One cut <!-- Page 2 --> lower"
    assert one(spark, "Ends.\n\n<!-- Page 2 -->\n\nlower", markup.stitch_pages) == "Ends.\n\n<!-- Page 2 -->\n\nlower"
    assert one(spark, "x\n\n<!-- Page 2 -->\n\nUpper", markup.stitch_pages) == "x\n\n<!-- Page 2 -->\n\nUpper"


def test_pipe_rows(spark):
    assert one(spark, r"| a \| b | `x|y` | c |", markup.split_row) == [r"a \| b", "`x|y`", "c"]
    assert one(spark, "| :--- | ---: |", lambda c: markup.is_separator(markup.split_row(c))) is True


def test_scores(spark):
    rows = spark.createDataFrame([("kitten", "sitting"), ("a b c", "a x c"), ("", ""), ("", "x"), ("1 2 2,5%", "2 1 3")], "e string, a string")
    got = rows.select(scoring.scores(F.col("e"), F.col("a")).alias("s")).select("s.*").collect()
    assert got[0].cer == 0.5
    assert abs(got[1].wer - 1 / 3) < 1e-12
    assert (got[2].cer, got[2].wer, got[3].cer, got[3].wer) == (0.0, 0.0, 1.0, 1.0)
    assert abs(got[4].numbers_f1 - 2 / 3) < 1e-12
    same = spark.createDataFrame([("| a | b |\n- x $y$ 12",)], "t string").select(scoring.scores(F.col("t"), F.col("t")).alias("s")).first().s
    assert (same.cer, same.wer, same.numbers_f1, same.formulas_f1, same.table_f1, same.list_f1) == (0, 0, 1, 1, 1, 1)


def test_choices():
    assert choices.split_choices("A. one B. two C. three") == "A. one\nB. two\nC. three"
    assert choices.split_choices("see B. alone") == "see B. alone"
    assert choices.split_choices("| A. x B. y |") == "|<br>A. x<br>B. y |"
    assert choices.split_choices("$x A. y$ only") == "$x A. y$ only"
    assert choices.answer_math("$A.$ x") == "A. x"
    assert choices.answer_math("$a B. b$") == "$a$\nB. $b$"
    assert choices.balance("it costs $5") == "it costs $5"
    assert choices.balance("so $x = 1") == "so $x = 1$"


def test_loops():
    line = "This is a line of prose that is long enough to count."
    assert loops.collapse("\n".join([line] * 4 + ["end"])) == line + "\nend"
    assert loops.collapse("\n".join([line] * 2)) == "\n".join([line] * 2)
    other = "Another line of running text, also long enough here."
    assert loops.collapse("\n".join([line, other] * 3)) == line + "\n" + other
    held = "```\n" + "\n".join([line] * 4) + "\n```"
    assert loops.collapse(held) == held
