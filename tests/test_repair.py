import re
import time
from collections import Counter

import pytest

from docspark.functions import htmltables, pipes, repair
from docspark.operators import assembly, spelling


def final(text, **options):
    return repair.finalised(text, **options)


def test_headings():
    assert final("# One ## Two ### Three")[0].split("\n") == ["# One", "## Two", "### Three"]
    assert final("#Head\n\n####Deep")[0] == "# Head\n\n## Deep"
    kept = "Text with ## signs.\n\n```\n# code ## here\n```\n\n| a ## b |"
    assert final(kept)[0] == kept
    out, n = final("# OFFICE OF PLANS **YEARLY REPORT**")
    assert out == "# OFFICE OF PLANS\n# **YEARLY REPORT**" and n["headings_split"] == 1
    assert final("# Office **note**")[0] == "# Office **note**"


def test_lines_that_go_on():
    assert final("This sentence was\nbroken here.\nNew one")[0] == "This sentence was broken here.\nNew one"
    assert final("- first item\n  goes on here\n- second")[0] == "- first item goes on here\n- second"
    assert final("Ends.\nlower case starts")[0] == "Ends.\nlower case starts"
    for held in ("```\na line\nb line\n```", "$$\na\nb\n$$"):
        assert final(held)[0] == held


def test_page_artifacts():
    out, n = final("Body text\n7 | Our Journal\nTrang 1/6 – Mã đề thi 001\nMore text", footers=re.compile(r"\d+ \| Our Journal"))
    assert out == "Body text\nMore text" and n["page_artifacts_removed"] == 2
    text = "\n".join(["<!-- Page 1 -->", "- 1 -", *(f"Line {i} of text." for i in range(9)), "12", *(f"Line {i} of text." for i in range(9)), "<!-- Page 2 -->", "x", "[ 2 ]"])
    out, n = final(text)
    assert n["page_artifacts_removed"] == 2 and "\n12\n" in out and "- 1 -" not in out and "[ 2 ]" not in out


def test_sentences_over_a_page_mark():
    assert final("One cut-\n\n<!-- Page 2 -->\n\nlower goes on")[0] == "One cut <!-- Page 2 --> lower goes on"
    for kept in ("Ends.\n\n<!-- Page 2 -->\n\nlower", "x\n\n<!-- Page 2 -->\n\nUpper"):
        assert final(kept)[0] == kept


def test_images_once():
    out, n = final("![ A ](.\\img\\one.png)\n\n![B](img/one.png)\n\n![C](img/two.png)")
    assert out == "![A](img/one.png)\n\n![C](img/two.png)" and (n["image_paths"], n["duplicate_images"]) == (1, 1)


def test_report_counts_each_kind():
    _, n = final("#Head\n\nThis is one\ncut.\n\n- item\n  goes on\n\n<table><tr><td>c\n\n![A](.\\i\\o.png)\n![B](i/o.png)")
    assert {k: v for k, v in n.items() if v} == {"headings": 1, "paragraph_lines_joined": 1, "list_lines_joined": 1, "html_tags_closed": 3, "image_paths": 1, "duplicate_images": 1}


def test_pipe_tables_of_differing_widths_become_html():
    out, n = final("Before\n\n| A | B |\n|---|---|\n| <i> | 1 | more |\n\nAfter")
    assert out == "Before\n\n<table><tr><th>A</th><th>B</th></tr><tr><td>&lt;i&gt;</td><td>1</td><td>more</td></tr></table>\n\nAfter" and n["tables_repaired"] == 1
    assert "<th>A</th>" in pipes.repaired("| A | B |\n|---|\n| 1 | 2 |")[0]
    for kept in ("| A | B |\n|---|---|\n| `x|y` | z |", "| A |\n| 1 | 2 |", "no table"):
        assert pipes.repaired(kept) == (kept, 0)


HEAD = "| No | Name |\n|---|---|\n"


@pytest.mark.parametrize(
    ("second", "rows"),
    [
        (HEAD + "| 3 | c |", 1), ("| 3 | c |\n| 4 | d |", 2), ("| 3 | c |\n|---|---|\n| 4 | d |", 2), ("| Other | Head |\n|---|---|\n| 1 | x |", 0),
        ("| 3 | c | d |", 0), ("| 3 | c |  |\n| 4 | d |  |", 2), ("| No | NAME |\n|---|---|\n| 3 | c |", 1), ("| III | c |\n|---|---|\n| IV | d |", 2),
    ],
)
def test_pipe_tables_join_over_page_marks(second, rows):
    first, bridge = HEAD + "| 1 | a |\n| 2 | b |", "\n\n<!-- Page 2 -->\n\n![Map](m.png)\nFigure 1: a map\n\n"
    got = pipes.merged(first + bridge + second)
    if not rows:
        assert got == first + bridge + second
        return
    lines = got.split("\n")
    assert len(lines) == 4 + rows + 3 and sum(map(pipes.is_row, lines)) == 4 + rows and lines[-3:] == ["<!-- Page 2 -->", "![Map](m.png)", "Figure 1: a map"]
    assert pipes.merged(first + "\n\nSome text\n\n" + second) == first + "\n\nSome text\n\n" + second


def test_narrow_numbered_rows_are_padded():
    got = pipes.merged("| Head | B | C |\n|---|---|---|\n| 1 | x | y |\n\n| 2 | z |")
    assert got.split("\n")[-1] == "| 2 | z |  |"


def test_tables_of_both_kinds_join():
    text = HEAD + "| 1 | a |\n\n<!-- Page 2 -->\n\n<table><tr><th>No</th><th>Name</th></tr><tr><td>2</td><td>b</td></tr></table>"
    out, n = final(text)
    assert out == HEAD + "| 1 | a |\n| 2 | b |\n<!-- Page 2 -->" and n["tables_converted"] == 1


def test_ranks():
    assert [pipes.rank(x) for x in ("12.", "**b**)", "XIV", "MCM", "i", "", "x1")] == [("number", 12), ("letter", 98), ("roman", 14), ("roman", 1900), ("letter", 105), None, None]


def test_table_grid():
    err = lambda *rows: [e.split(":")[1] for e in htmltables.structure_errors("<table>" + "".join(f"<tr>{r}</tr>" for r in rows) + "</table>")]
    assert err("<td colspan=2>a</td>", "<td>b</td><td>c</td>") == []
    assert err("<td rowspan=2>a</td><td>b</td>", "<td>c</td>") == []
    assert err("<td>a</td><td rowspan=2>b</td><td>c</td>", "<td colspan=2>d</td>") == ["overlapping_span", "inconsistent_logical_columns"]
    assert err("<td rowspan=3>a</td><td>b</td>", "<td>c</td><td>d</td>") == ["inconsistent_logical_columns"]
    assert err("<td colspan=999999>a</td>", "<td colspan=1000>b</td>") == []
    assert err("", "<td>a</td>") == []


def test_a_lexicon_warns_and_corrects_only_if_asked(spark):
    entries = spark.createDataFrame([("hòa bình",), ("hòa",), ("bình",)], "entry string")
    lexicon = spelling.build_lexicon(entries)
    docs = spark.createDataFrame([(1, "Muon hoa binh."), (2, None)], "d int, text string")
    rows = {(r.d, c): r for c in (False, True) for r in assembly.finalise(docs, lexicon=lexicon, correct=c).collect()}
    assert (rows[1, False].final, rows[1, False].report.spell_fixed, rows[1, False].report.spell_warnings) == ("Muon hoa binh.", 0, 2)
    assert (rows[1, True].final, rows[1, True].report.spell_fixed) == ("Muon hòa bình.", 2)
    assert rows[2, True].final is None and sum(rows[2, True].report) == 0
    assert spelling.corrected(docs, lexicon).orderBy("d").first().corrected == "Muon hòa bình."
    with pytest.raises(ValueError):
        spelling.dictionary(lexicon, 1)


def test_choices_of_long_lines():
    assert final("A. $x=1$ \\hfill B. $x=2$ C. $x=3$ D. $x=4$")[0] == "A. $x=1$\nB. $x=2$\nC. $x=3$\nD. $x=4$"
    assert final("Author B. Smith wrote this report.")[0] == "Author B. Smith wrote this report."
    assert final("$A.$ one $B.$ two")[0] == "A. one\nB. two"
    assert final("A. one\n\nB. two")[0] == "A. one\nB. two"
    assert final("$x=1 B. y=2$")[0] == "$x=1$\nB. $y=2$"
    assert final("<table><tr><td>A. p B. q C. r</td></tr></table>")[0] == "<table><tr><td><br>A. p<br>B. q<br>C. r</td></tr></table>"


@pytest.mark.parametrize("part", ["word ", "\n", " ", "# ", "| a |\n", "<!-- Page 2 -->\n", "<table>", "![a](b)", "$x ", "A. x B. y ", "- a\n", "`", "image_placeholder ", "1\n", "<td>", "| 1 | a |\n\n"])
def test_long_texts_take_linear_time(part):
    def seconds(n):
        start = time.process_time()
        repair.finalised(part * n, None)
        return time.process_time() - start

    seconds(500)
    assert seconds(8_000) < 16 * seconds(1_000) + 1


def test_a_second_run_changes_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = [r.text for r in docs.collect()]
    for t in texts:
        once, _ = final(t)
        twice, n = final(once)
        assert twice == once and not +Counter(n), (t, n)


def test_plain_tables_are_read_as_the_parser_reads_them():
    from docspark.functions import htmltables

    plain = ["<table><tr><th>a</th><th> b\n</th></tr>\n<tr><td>1 > 0</td><td></td></tr></table>", "<table> <tr><td>x</td></tr>\n</table>"]
    other = ["<table><tr><td>a<br>b</td></tr></table>", "<table><tr><td>a &amp; b</td></tr></table>", "<table><tr></tr></table>", "<table>x<tr><td colspan='2'>a</td></tr></table>", "<table><tr><td>a</td></tr></table></table>"]
    assert [bool(htmltables._PLAIN.fullmatch(t)) for t in plain + other] == [True] * 2 + [False] * 5
    for t in plain + other:
        assert htmltables._rows(t) == htmltables._Cells(t).rows
