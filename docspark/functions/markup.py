"""Repairs of Markdown and HTML text, row by row: native expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions.text import casefold, count, let, lines, rewrite, squeeze, strip, tokens

#: Markdown and HTML forms (fixed values).
TABLE = r"(?is)<table\b[^>]*>.*?</table>"
IMAGE = r"!\[([^\]\n]*)\]\(([^)\n]+)\)"
LINK_TARGET = r"!\[[^\]]*\]\(([^)]+)\)"
PLACEHOLDER = r"(?i)(?:image|formula)_placeholder"
#: Start of a line that isn't running prose (fixed value).
BLOCK_START = r"^\s*(?:#{1,6}\s|[-+*]\s|\d+[.)]\s|>|```|~~~|<!--|<[/A-Za-z]|\||!\[|\$\$)"
#: Tags in the order in which missing ends are added.
TABLE_TAGS = ("td", "th", "tr", "table")
#: Labels of an image that is only a signature or a stamp (fixed values).
SIGNATURE_LABELS = ("signature", "seal", "stamp", "seal and signature", "signature and seal", "signature stamp", "stamp and signature", "chữ ký", "con dấu", "chữ ký và con dấu", "con dấu và chữ ký")
#: Signs of a reply about an empty page (fixed values), in case-folded text.
BLANK_SIGNS = r"\b(?:blank page|page (?:is|appears to be) blank|(?:completely|entirely|mostly|largely|almost) blank|no visible (?:document )?(?:text|content)|nothing to transcribe|does not contain (?:any )?(?:visible )?(?:text|content))\b|\b(?:trang trắng|không (?:có|thấy) (?:văn bản|nội dung)|không có gì để (?:chép|phiên âm|chuyển đổi))\b"
ASSISTANT_SIGNS = r"\b(?:provided|uploaded|given|image|transcrib|markdown|instructions?|provide another|further assistance|hình ảnh|chuyển đổi|cung cấp)\b"
EMPTY_CONCLUSION = r"\b(?:i (?:will|shall|must|am going to) (?:return|provide|leave)|as (?:required|instructed))\b.{0,100}\b(?:empty response|nothing to transcribe|response empty)\b"
PREAMBLE = r"(?is)\A(?:based on (?:your|the) requirements|here (?:is|are) (?:the )?(?:converted|extracted|requested)|dưới đây là).+?(?:\r?\n){2,}"
IMAGE_TARGET = r"""(?:[^\s)'"]*/)?image_placeholder(?:\.[A-Za-z0-9]+)?"""


def tag_balance(c: Column, tag: str) -> Column:
    """Opened minus closed tags of a name."""
    return count(c, rf"(?i)<{tag}\b") - count(c, rf"(?i)</{tag}\s*>")


def close_tables(c: Column) -> Column:
    """With the table tags that are opened but not closed, closed at the end."""
    missing = F.concat(*(F.repeat(F.lit(f"</{t}>"), F.greatest(tag_balance(c, t), F.lit(0))) for t in TABLE_TAGS))
    return F.when(c.rlike("(?i)<table") & (missing != ""), F.concat(F.regexp_replace(c, r"(?U)\s+$", ""), F.lit("\n"), missing)).otherwise(c)


def compact_tables(c: Column) -> Column:
    """Complete HTML tables without blank lines, their structural tags at the start of the line."""
    tag = r"(?i)^\s*(</?(?:table|thead|tbody|tfoot|tr|th|td)\b[^>]*>)"
    return rewrite(c, TABLE, lambda t: F.array_join(F.transform(F.filter(lines(t), lambda x: strip(x) != ""), lambda x: F.regexp_replace(x, tag, "$1")), "\n"))


def normalise_images(c: Column) -> Column:
    """Local image targets with forward slashes and no leading ./, alternative texts trimmed."""
    target = lambda m: F.regexp_replace(strip(F.regexp_extract(m, IMAGE, 2)), "^<+|>+$", "")
    local = lambda t: F.when(t.rlike("(?i)^(?:https?://|data:)"), t).otherwise(F.regexp_replace(F.translate(t, "\\", "/"), r"^(?:\./)+", ""))
    return rewrite(c, IMAGE, lambda m: F.concat(F.lit("!["), strip(F.regexp_extract(m, IMAGE, 1)), F.lit("]("), local(target(m)), F.lit(")")))


def image_targets(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(LINK_TARGET), F.lit(1)), strip)


def link_targets(c: Column) -> Column:
    """Targets of images and of all other links, with forward slashes and no leading ./."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"\]\(([^)]+)\)"), F.lit(1)), lambda t: F.regexp_replace(F.translate(strip(t), "\\", "/"), r"^(?:\./)+", ""))


def unescape_image_links(c: Column) -> Column:
    r"""`![a]\(p\_x.png)` as `![a](p_x.png)`, and lines of one image not indented as code."""
    escaped = r"!\[[^\]\n]*\]\\\([^)\n]*\)"
    fixed = rewrite(c, escaped, lambda m: F.replace(F.replace(m, F.lit("]\\("), F.lit("](")), F.lit("\\_"), F.lit("_")))
    return F.regexp_replace(fixed, r"(?m)^(?: {4,}|\t+)(!\[[^\]\n]*\]\([^)\n]+\))[ \t]*$", "$1")


def drop_placeholders(c: Column) -> Column:
    """Without image placeholders (Markdown, img or bare), and the line ends and blank lines that they leave."""
    out = F.regexp_replace(c, rf"(?i)!\[[^\]\n]*\]\(\s*{IMAGE_TARGET}\s*\)|<img\b[^>]*{IMAGE_TARGET}[^>]*>|{IMAGE_TARGET}", "")
    return F.when(c.rlike("(?i)image_placeholder"), F.regexp_replace(F.regexp_replace(out, r"(?m)[ \t]+$", ""), r"\n{3,}", "\n\n")).otherwise(c)


def drop_signatures(c: Column) -> Column:
    """Without images whose text, punctuation aside, is a signature's or a stamp's label."""
    label = lambda m: strip(F.regexp_replace(casefold(squeeze(F.regexp_extract(m, IMAGE, 1))), r"[.,:;!?()\[\]{}]+", ""))
    out = rewrite(c, IMAGE, lambda m: F.when(label(m).isin(*SIGNATURE_LABELS), "").otherwise(m))
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


#: A page marker with the white space about it, as one part of a text.
_PAGE_CUT = r"(?<!\s)\s*+<!--\s*+(?i:page)\s++\d++\s*+-->\s*+"


def stitch_pages(c: Column) -> Column:
    """A sentence that a page marker cuts, on one line with the marker; a hyphen before the cut goes.

    The text is split at its markers; whether two parts join is seen from the end
    of the last line of one, after its last sentence's end, and from the start of
    the other: linear in the text.
    """
    cuts = F.regexp_extract_all(c, F.lit(_PAGE_CUT), F.lit(0))
    return F.when(c.rlike(r"(?i)<!--\s*+page"), let(F.struct(F.split(c, _PAGE_CUT, -1).alias("parts"), cuts.alias("cuts")), _stitched)).otherwise(c)


def _stitched(x: Column) -> Column:
    def joins(i: Column) -> Column:
        cut = F.get(x["cuts"], i)
        tail = F.regexp_replace(F.substring_index(F.get(x["parts"], i), "\n", -1), r"^.*[.!?:;#`|*$]", "")
        return cut.rlike(r"^[^\S\n]*\n") & cut.rlike(r"-->\n") & tail.rlike(r"[^\s>-]") & F.get(x["parts"], i + 1).rlike(r"^\p{Ll}")

    def piece(part: Column, i: Column) -> Column:
        cut = F.get(x["cuts"], i)
        joined = F.concat(F.regexp_replace(part, "-$", ""), F.lit(" "), strip(cut), F.lit(" "))
        return F.when(cut.isNull(), part).when(F.coalesce(joins(i), F.lit(False)), joined).otherwise(F.concat(part, cut))

    return F.array_join(F.transform(x["parts"], piece), "")


def _prose(x: Column) -> Column:
    return (F.size(tokens(x)) >= 6) & (count(x, r"[=+*/^_{}\\]") <= 2)


def unwrap_prose(c: Column) -> Column:
    """`$...$` that holds prose (six words or more, at most two operators) without its delimiters; so are lone `$` of prose lines."""
    inner = lambda m: F.substring(m, F.lit(2), F.length(m) - 2)
    out = rewrite(c, r"(?<!\$)\$[^$\n]+\$(?!\$)", lambda m: F.when(_prose(inner(m)), inner(m)).otherwise(m))
    bare = lambda x: F.when((count(x, r"\$") % 2 == 1) & _prose(F.regexp_replace(strip(x), r"^\$+|\$+$", "")), F.translate(x, "$", "")).otherwise(x)
    return F.array_join(F.transform(lines(out), bare), "\n")


def clean_response(c: Column) -> Column:
    """A recogniser's reply as page text: blank replies empty; fences, preambles, entities and stray delimiters gone."""
    out = F.regexp_replace(strip(c), r"\\+hfill\b\s*", " ")
    out = strip(F.regexp_replace(F.regexp_replace(out, r"^```[a-zA-Z0-9_-]*\s*\r?\n?", ""), r"\r?\n?```\s*$", ""))
    out = F.regexp_replace(F.regexp_replace(out, PREAMBLE, ""), "&(?:amp;)?nbsp;", " ")
    return F.when(is_blank_response(c), "").otherwise(unwrap_prose(out))


def _ladder(body: Column) -> Column:
    """All lines are headings, four or more, each one level deeper than the last, with the same text."""
    return let(F.filter(F.transform(lines(body), strip), lambda x: x != ""), _is_ladder)


def _is_ladder(heads: Column) -> Column:
    level = F.transform(heads, lambda x: F.length(F.regexp_extract(x, r"^(#{1,6})\s", 1)))
    text = F.array_distinct(F.transform(heads, lambda x: casefold(squeeze(F.regexp_replace(x, r"^#{1,6}\s+", "")))))
    steps = F.transform(level, lambda x, i: x - i)
    return (F.size(heads) >= 4) & F.forall(heads, lambda x: x.rlike(r"^#{1,6}\s+\S")) & (F.size(F.array_distinct(steps)) == 1) & (F.size(text) == 1)


def is_blank_response(c: Column) -> Column:
    """A reply that says that the page is empty, or says nothing."""
    body = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"^```[a-zA-Z0-9_-]*\s*|```\s*$", "")
    return _ladder(body) | let(casefold(squeeze(F.translate(body, "*_`#>", "     "))), _says_nothing)


#: Replies that say nothing (fixed values).
NO_CONTENT = ("empty response", "no response", "no content")


def _says_nothing(plain: Column) -> Column:
    status = F.regexp_replace(plain, r"^[()\[\]{} .:-]+|[()\[\]{} .:-]+$", "")
    n = F.size(tokens(plain))
    blank, talk = plain.rlike(BLANK_SIGNS), plain.rlike(ASSISTANT_SIGNS)
    short = (F.length(plain) <= 1200) & (n <= 120)
    long = (F.length(plain) <= 5000) & (n <= 500) & plain.rlike(EMPTY_CONCLUSION)
    return (plain == "") | status.isin(*NO_CONTENT) | (blank & talk & (short | long))


def html_rows(rows: Column) -> Column:
    """An HTML table of an array of rows of cells: a header row, then data rows; <br> in a cell stays."""
    escape = lambda x: F.replace(F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("&lt;br&gt;"), F.lit("<br>"))
    row = lambda cells, i: F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda x: F.concat(F.when(i == 0, "<th>").otherwise("<td>"), escape(x), F.when(i == 0, "</th>").otherwise("</td>"))), ""), F.lit("</tr>"))
    return F.concat(F.lit("<table>"), F.array_join(F.transform(rows, row), ""), F.lit("</table>"))


def split_row(line: Column) -> Column:
    r"""Cells of a pipe row, trimmed: a pipe that is escaped or inside backticks doesn't split; outer pipes are optional."""
    masked = rewrite(strip(line), r"`[^`]*`|\\\|", lambda m: F.translate(m, "|", "\u0001"))
    inner = F.regexp_replace(F.regexp_replace(masked, r"^\|", ""), r"\|$", "")
    return F.transform(F.split(inner, r"\|", -1), lambda x: strip(F.translate(x, "\u0001", "|")))


def is_separator(cells: Column) -> Column:
    """All cells are dashes with optional colons, and there is one."""
    return (F.size(cells) > 0) & F.forall(cells, lambda x: x.rlike(r"^:?-{3,}:?$"))
