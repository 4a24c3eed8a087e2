"""Main text of HTML pages by maximum-scoring subsequence.

A page becomes a sequence of units in page order: runs of words, by the context
they stand in, and tags, by kind. Words of content contexts score positive, tags
negative; a linear scan finds the contiguous run of units with the largest sum.
Weights are log odds counted over labelled pages. Containers that never hold main
text (menus, forms, scripts, adverts, comments ...) are neither scored nor
returned, so they don't cut an article in two.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docspark.llm.common import fresh, slices

OPEN = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
COMMENT_END = re.compile("--!?>")
#: Rest of a tag, up to the first > that isn't quoted.
TAG_END = re.compile(r"""(?:"[^"]*"|'[^']*'|[^"'>])*+>""")
EDGES = re.compile("[\"'>]")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their own end tag.
RAW = frozenset("script style noscript textarea title iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open element of these names, up to the nearest of the barriers.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements without main text.
BARRED = frozenset("head script style noscript template iframe svg object nav footer aside button select textarea menu dialog canvas audio video title datalist map frameset noframes noembed".split())
#: Elements without main text unless they hold the page's own.
SOFT = frozenset({"form"})
#: Words in a class, id or role that mark such a container, unless it holds the page's own text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion banner banners sidebar sidebars side rail menu menus nav navbar navigation"
    " breadcrumb breadcrumbs footer foot header masthead topbar comment comments commentlist disqus discussion replies respond reply cookie cookies consent gdpr notice notices alert alerts notification"
    " newsletter subscribe subscription signup login signin register search share sharing social related recommended recommendations widget widgets popup modal overlay toolbar pagination pager copyright"
    " disclaimer legal teaser teasers outbrain taboola paywall complementary contentinfo dialog form feedback hidden skip".split()
)
#: Those of reader comments, which may be longer than the article.
COMMENTS = frozenset("comment comments commentlist disqus discussion replies respond reply".split())
#: A header of the article itself is kept.
OWN = frozenset("article entry post story content title page".split())
#: Parts of a class that tell a state of the page, such as has-sidebar: it marks no container.
STATES = frozenset("has no not with without open opened closed enabled disabled on off".split())
#: Elements that a class never bars.
WRAPPERS = frozenset("html body main".split())
#: A tag scores between these, negative.
TAG_LEAST, TAG_MOST = 0.05, 2.0
#: Words that make a block outside paragraphs a long one.
LONG = 10
SPLIT = re.compile(r"[^a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@lru_cache(1 << 14)
def _short_marks(name: str, rest: str) -> tuple[str, bool]:
    return _read_marks(name, rest)


def _marks(name: str, rest: str) -> tuple[str, bool]:
    """(bar, only as a header) by the attributes of a tag.

    bar is "hard" for what is hidden, "comments" or "soft" for what a class, id or
    role marks, which the page's own words may overrule, and else empty.
    """
    return (_short_marks if len(rest) <= 256 else _read_marks)(name, rest)


def _read_marks(name: str, rest: str) -> tuple[str, bool]:
    if not rest.strip() or name in WRAPPERS:
        return "", False
    bar, header = "", False
    for m in ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and HIDDEN.search(value):
            return "hard", False
        if key in ("class", "id", "role"):
            for name_ in value.split():
                parts = {*SPLIT.split(CAMEL.sub("-", name_).lower())}
                found = parts & MARKS
                if found <= {"header", "side"} and parts & OWN:
                    continue
                if found == {"header"}:
                    header = True
                elif found and (key == "role" or name_.lower() in MARKS or not parts & STATES):
                    bar = "comments" if found & COMMENTS or bar == "comments" else "soft"
    return bar, header


def _ends(source: str) -> tuple[list[int], list[int]]:
    """(places, ends): for each quote and > of a page, the place after the > that ends a tag whose rest starts there; -1 if none does.

    One pass from the end: a quote goes on after its partner.
    """
    found = [(m.start(), m[0]) for m in EDGES.finditer(source)]
    ends, after = [-1] * (len(found) + 1), {"'": -1, '"': -1}
    for i in range(len(found) - 1, -1, -1):
        at, c = found[i]
        if c == ">":
            ends[i] = at + 1
        else:
            ends[i] = ends[after[c] + 1] if after[c] >= 0 else -1
            after[c] = i
    return [at for at, _ in found], ends


class _Page:
    """Units of one page: (class, amount, block, text); block is None for tags."""

    def __init__(self, source: str, free: frozenset[int] = frozenset()):
        self.free, self.pushed, self.words = free, 0, 0
        self.soft: dict[int, tuple[int, int, int, str]] = {}
        self.spans: list[tuple[int, int, int, int, str]] = []
        self.marks: dict[str, int] = {}
        self.units: list[tuple[str, int, int | None, str]] = []
        self.stack: list[tuple[str, bool, bool]] = []
        #: Places in the stack of each open element, by name.
        self.open: dict[str, list[int]] = {}
        self.barred = self.inside = self.links = self.heads = self.paras = 0
        self.block = 0
        self.outside: list[int] = []
        self.has_article = False
        self._read(source)

    def wrappers(self) -> frozenset[int]:
        """Softly barred tags that hold most of the page's words and its first heading of level 1, or if it has none its first article."""
        while self.stack:
            self._pop()
        head = self.marks.get("h1")
        mark = self.marks.get("article") if head is None else head
        return frozenset(n for n, words, first, last, bar in self.spans if 2 * words > self.words and (first < mark <= last if mark is not None and (head is not None or bar != "comments") else bar != "comments"))

    def _push(self, name: str, rest: str) -> None:
        bar, header = _marks(name, rest)
        self.pushed += 1
        barred = bar == "hard" or name in BARRED or (header or name == "header") and not self.inside
        bar = bar or "soft" * (name in SOFT)
        if bar and not barred and self.pushed not in self.free:
            barred = True
            self.soft[len(self.stack)] = (self.pushed, self.words, self.pushed, bar)
        kind = "h1" if name == "h1" else "article" if name in ("article", "main") else ""
        if kind:
            self.marks.setdefault(kind, self.pushed)
        self.open.setdefault(name, []).append(len(self.stack))
        self.barred += barred
        inner = name in ("article", "main") and not self.barred
        self.stack.append((name, barred, inner))
        self.inside += inner
        self.has_article |= inner
        self.links += name == "a"
        self.heads += name in HEADINGS
        self.paras += name == "p"

    def _pop(self) -> None:
        name, barred, inner = self.stack.pop()
        self.open[name].pop()
        if found := self.soft.pop(len(self.stack), None):
            self.spans.append((found[0], self.words - found[1], found[2] - 1, self.pushed, found[3]))
        self.barred -= barred
        self.inside -= inner
        self.links -= name == "a"
        self.heads -= name in HEADINGS
        self.paras -= name == "p"

    def _last(self, names: Iterable[str]) -> int:
        """Place of the innermost open element of these names, or -1."""
        return max((self.open[n][-1] for n in names if self.open.get(n)), default=-1)

    def _close(self, name: str) -> None:
        at = self._last((name,))
        while 0 <= at < len(self.stack):
            self._pop()

    def _imply(self, name: str) -> None:
        """End what a start tag ends: an open paragraph, list item or cell."""
        if name in BLOCK and self.paras and self._last("p") > self._last(("table", "button", "object")):
            self._close("p")
        if name in CLOSES:
            ends, barriers = CLOSES[name]
            if (at := self._last(ends)) > self._last(barriers):
                while len(self.stack) > at:
                    self._pop()

    def _text(self, raw: str) -> None:
        self.words += len(raw.split())
        if not raw or self.barred:
            return
        text = html.unescape(raw)
        kind = "link" if self.links else "heading" if self.heads else "para" if self.paras else "other"
        if not self.inside:
            self.outside.append(len(self.units))
        self.units.append((f"{'in' if self.inside else 'word'}:{kind}", len(text.split()), self.block, text))

    def _tag(self, name: str) -> None:
        if not self.barred:
            kind = "link" if name == "a" else "list" if name in ("ul", "ol", "li", "dl", "dt", "dd") else "para" if name == "p" else "heading" if name in HEADINGS else "block" if name in BLOCK else "inline"
            self.units.append((f"tag:{kind}", 1, None, ""))

    def _read(self, source: str) -> None:
        at, lower, last, edges = 0, None, source.rfind(">"), None
        while m := OPEN.search(source, at):
            begin = m.start()
            if m[5] and begin > last:
                break  # No tag ends any more: the rest is text.
            self._text(source[at:begin])
            if m[1]:
                end = COMMENT_END.search(source, begin + 2)
                at = end.end() if end else len(source)
                continue
            if m[2] or m[3]:
                end = source.find("]]>" if m[2] else ">", m.end())
                at = len(source) if end < 0 else end + (3 if m[2] else 1)
                continue
            end = TAG_END.match(source, m.end()) if edges is None else None
            if end:
                at = end.end()
            else:
                # Quotes that don't pair: from here on the ends of tags are looked up, which one pass over the page has found.
                edges = edges or _ends(source)
                at = edges[1][bisect_left(edges[0], m.end())]
                if at < 0:
                    at = source.find(">", m.end()) + 1
            name = m[5].lower()
            if m[4]:
                self._tag(name)
                if name in BLOCK:
                    self.block += 1
                self._close(name)
                continue
            self._imply(name)
            if name in BLOCK:
                self.block += 1
            rest = source[m.end() : at - 1]
            if name in RAW:
                lower = source.lower() if lower is None else lower
                if len(lower) != len(source):  # a letter whose lower case is longer
                    lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in source)
                end = lower.find(f"</{name}", at)
                if end < 0:
                    at = len(source)
                else:
                    close = source.find(">", end)
                    at = len(source) if close < 0 else close + 1
                continue
            if name in VOID:
                if name == "br":
                    self._text(" ")
                continue
            self._push(name, rest)
            self._tag(name)
            if name in ("td", "th"):
                self._text(" ")
        self._text(source[at:])
        self._grade()

    def _grade(self) -> None:
        """What the whole page shows of a unit: a long bare block, and text beside an article."""
        amount = Counter()
        for _, n, block, _ in self.units:
            amount[block] += n
        for i, (kind, n, block, text) in enumerate(self.units):
            if kind == "word:other" and amount[block] >= LONG:
                self.units[i] = ("word:long", n, block, text)
        if self.has_article:
            for i in self.outside:
                _, n, block, text = self.units[i]
                self.units[i] = ("word:outside", n, block, text)


def best_run(scores: list[float]) -> tuple[int, int]:
    """(start, end) of the contiguous run with the largest sum, by one scan; the first and shortest of ties, (0, 0) if none is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def labelled_pages() -> Iterator[tuple[str, set[str]]]:
    """(html, words of its main text): pages of several layouts; the words of the main text begin with x, all others with o."""
    text = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    links = lambda n: "".join(f'<li><a href="/{i}">{text("o", 1 + i % 2)}</a></li>' for i in range(n))
    for k in range(40):
        paras = "".join(f"<p>{text('x', 12 + 7 * (i + k) % 60)} <b>{text('x', 2)}</b> <a href='/r'>{text('x', 1 + i % 2)}</a> {text('x', 9)}</p>" for i in range(3 + k % 5))
        bare = "".join(f"<div>{text('x', 14 + 5 * (i + k) % 50)}<br>{text('x', 11)}</div>" for i in range(2 + k % 3))
        items = "".join(f"<li>{text('x', 6 + i)}</li>" for i in range(k % 4))
        cells = "".join(f"<tr><td>{text('x', 2)}</td><td>{text('x', 1)}</td></tr>" for _ in range(k % 3))
        body = f"<h1>{text('x', 4 + k % 5)}</h1>{bare if k % 5 == 4 else paras}<h2>{text('x', 3)}</h2><ul>{items}</ul><table>{cells}</table><p>{text('x', 30)}</p>"
        top = f"<div><ul>{links(6 + k % 7)}</ul></div><div>{text('o', 3 + k % 4)}</div>"
        end = f"<div><ul>{links(4 + k % 5)}</ul></div><div><a href='/c'>{text('o', 2)}</a> {text('o', 2 + k % 5)}</div>"
        wrap = ("<article>{}</article>", "<main>{}</main>", "<div id='content'>{}</div>", "<div><div>{}</div></div>")[k % 4]
        yield f"<html><body>{top}{wrap.format(body)}{end}</body></html>", {"x"}


@lru_cache(1)
def weights() -> dict[str, float]:
    """Score of a unit of each class: log odds of main text over the rest; a tag's is negative."""
    inside, outside = Counter(), Counter()
    for source, _ in labelled_pages():
        units = _Page(source).units
        words = [i for i, u in enumerate(units) if u[1] and u[2] is not None and u[3].split()[0][0] == "x"]
        for i, (kind, n, *_) in enumerate(units):
            (inside if words[0] <= i <= words[-1] else outside)[kind] += n
    words = [f"{at}:{k}" for at in ("in", "word") for k in ("link", "heading", "para", "other")] + ["word:long", "word:outside"]
    tags = [f"tag:{t}" for t in ("link", "list", "para", "heading", "block", "inline")]
    out = {}
    for kinds in (words, tags):
        n_in, n_out = (sum(c[k] for k in kinds) + len(kinds) for c in (inside, outside))
        for k in kinds:
            odds = math.log((inside[k] + 1) / n_in) - math.log((outside[k] + 1) / n_out)
            out[k] = min(max(odds, -TAG_MOST), -TAG_LEAST) if kinds is tags else odds
    return out


def main_text(source: str | None) -> str:
    """Main text of one page: its blocks in page order, joined by a newline; empty if there is none."""
    if not source:
        return ""
    page, w = _Page(source), weights()
    free: frozenset[int] = frozenset()
    while more := page.wrappers():
        free |= more
        page = _Page(source, free)
    linked, whole = Counter(), Counter()
    for kind, n, block, _ in page.units:
        if block is not None:
            whole[block] += n
            linked[block] += n * kind.endswith(":link")
    # A link in running text is a word like its neighbours.
    score = lambda k, n, b: n * w["word:para" if k == "word:link" and 2 * linked[b] < whole[b] else k]
    start, end = best_run([score(k, n, b) for k, n, b, _ in page.units])
    blocks: dict[int, list[str]] = {}
    for kind, _, block, text in page.units[start:end]:
        if block is not None and kind != "word:outside":
            blocks.setdefault(block, []).append(text)
    joined = (" ".join("".join(b).split()) for b in blocks.values())
    return "\n".join(b for b in joined if b)


def extract(pages: DataFrame, source: str = "html", keep: list[str] | None = None) -> DataFrame:
    """pages (its columns in `keep`, default all) with text, the main text, and n_chars, its code points.

    Null, empty or unparsable html gives an empty text; a page of any length is
    read whole, in linear time; rows that repeat are each a page, and an empty
    table gives an empty one. The new columns get other names if pages has such
    columns. No shuffle; each page is one unit of work.
    """
    keep = pages.columns if keep is None else keep
    text, chars = fresh(pages, "text", "n_chars")
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField(text, T.StringType()), T.StructField(chars, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, source):
                found = [main_text(x) for x in batch.column(source).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], schema.names)

    return pages.select(*dict.fromkeys([*keep, source])).mapInArrow(run, schema)
