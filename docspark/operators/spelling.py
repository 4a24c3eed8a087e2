"""Spelling by word pairs: a lexicon of words, accent candidates and bigrams, joined to the pairs of a text."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docspark.functions.text import ACCENTED, PLAIN, casefold, let, unaccented

WORD = r"[A-Za-zÀ-ỹĐđ]+"
#: Parts of a text that are never corrected (fixed value).
MASK = r"(?is)```.*?```|`[^`\n]*`|\$\$.*?\$\$|(?<!\$)\$[^$\n]*\$(?!\$)|!?\[[^\]]*\]\([^)]+\)|https?://[^\s<>]+|\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b|\b\d{1,4}/\d{4}/[A-ZĐ-]+\b|\b(?=[A-Za-z0-9._/-]*\d)(?=[A-Za-z0-9._/-]*[-_/])[A-Za-z0-9]+(?:[-_/][A-Za-z0-9.]+)+\b|<table\b.*?</table>"
PIPE_LINE = r"(?m)^[^\S\n]*\|.*$"


def lexicon_entries(words: DataFrame, column: str = "value") -> DataFrame:
    """entry: distinct case-folded entries of one or two words of letters."""
    entry = casefold(F.trim(column))
    return words.select(entry.alias("entry")).where(F.col("entry").rlike(r"^\p{L}+(?:\s+\p{L}+)?$")).distinct()


def build_lexicon(entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, accents, bigrams): distinct words; plain form with its accented forms, where there is one; pairs."""
    split = entries.select(F.split("entry", r"\s+").alias("p"))
    words = split.select(F.explode("p").alias("w")).distinct()
    accents = words.groupBy(unaccented(F.col("w")).alias("plain")).agg(F.sort_array(F.collect_set("w")).alias("forms")).where(F.exists("forms", lambda f: f != F.col("plain")))
    bigrams = split.where(F.size("p") == 2).select(F.col("p")[0].alias("left"), F.col("p")[1].alias("right")).distinct()
    return words, accents, bigrams


def load_lexicon(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lexicon frames from a JSON file of words, accent_candidates and bigrams; entries that don't fit are left out."""
    schema = T.StructType([T.StructField("words", T.ArrayType(T.StringType())), T.StructField("accent_candidates", T.MapType(T.StringType(), T.ArrayType(T.StringType()))), T.StructField("bigrams", T.ArrayType(T.StringType()))])
    raw = spark.read.schema(schema).option("multiLine", "true").json(path)
    words = raw.select(F.explode("words").alias("w")).distinct()
    accents = raw.select(F.explode("accent_candidates").alias("k", "forms")).groupBy(unaccented(F.col("k")).alias("plain")).agg(F.array_distinct(F.flatten(F.collect_list("forms"))).alias("forms"))
    pairs = raw.select(F.explode("bigrams").alias("b")).select(F.split("b", r"\s+").alias("p")).where(F.size("p") == 2)
    return words, accents, pairs.select(F.col("p")[0].alias("left"), F.col("p")[1].alias("right")).distinct()


#: What a text must hold for a part of MASK.
_MASKABLE = r"(?i)[`$@]|\]\(|://|<table|[A-Za-z0-9][-_/][A-Za-z0-9.]"


def _masked(c: Column) -> Column:
    """Masked parts as a character that is neither a letter nor white space, line breaks kept."""
    gone = let(c, lambda t: F.when(t.rlike(_MASKABLE), F.regexp_replace(t, MASK, "\u0001")).otherwise(t))
    return let(gone, lambda t: F.when(t.contains("|"), F.regexp_replace(t, PIPE_LINE, "\u0001")).otherwise(t))


def word_pairs(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, at, left, right: neighbouring words of one line or of lines that no blank one parts. No shuffle."""
    safe = _masked(F.col(text))
    cut = F.regexp_extract_all(safe, F.lit(rf"{WORD}|[^A-Za-zÀ-ỹĐđ]+"), F.lit(0))
    pairs = let(cut, lambda t: F.transform(t, lambda x, i: F.struct(i.alias("at"), x.alias("left"), F.get(t, i + 1).alias("gap"), F.get(t, i + 2).alias("right"))))
    good = F.filter(pairs, lambda p: p["left"].rlike(f"^{WORD}$") & p["right"].isNotNull() & p["gap"].rlike(r"^[ \t\r\n]+$") & ~F.replace(p["gap"], F.lit("\r"), F.lit("")).contains("\n\n"))
    return docs.select(*keys, F.inline(F.transform(good, lambda p: F.struct(p["at"].alias("at"), p["left"].alias("left"), p["right"].alias("right")))))


def suggestions(docs: DataFrame, keys: list[str], lexicon: tuple[DataFrame, DataFrame, DataFrame], text: str = "text") -> DataFrame:
    """keys, at, left, right, new_left, new_right: pairs for which exactly one bigram fits their options, where that changes a word.

    A word's options are itself, if it is in the lexicon, or else the accented
    forms of its plain form. Upper-case words, and pairs of titled ones, are left
    alone. A lexicon of up to LOOKED_UP entries goes to every task; a larger one is
    joined by word, and so are the texts' words.
    """
    found = _looked_up(docs, keys, lexicon, text)
    return found if found is not None else _joined(docs, keys, lexicon, text)


#: Entries up to which a lexicon goes to every task, so that texts are read once and not joined by their words.
LOOKED_UP = 100_000


def _looked_up(docs: DataFrame, keys: list[str], lexicon: tuple[DataFrame, DataFrame, DataFrame], text: str) -> DataFrame | None:
    """suggestions by a lexicon in every task: one pass over the texts, no shuffle; nothing if the lexicon has too many entries."""
    frames = [f.limit(LOOKED_UP + 1).collect() for f in lexicon]
    if max(map(len, frames)) > LOOKED_UP:
        return None
    known, forms, bigrams = {r.w for r in frames[0]}, {r.plain: r.forms for r in frames[1]}, {(r.left, r.right) for r in frames[2]}
    rows = "array<struct<at:int,`left`:string,`right`:string,new_left:string,new_right:string>>"

    @F.pandas_udf(rows)
    def run(texts: pd.Series) -> pd.Series:
        found = _Options(known, forms, bigrams)
        return pd.Series([found.suggested(t) if t is not None else None for t in texts], dtype=object)

    return docs.withColumn("safe", _masked(F.col(text))).withColumn("suggested", run("safe")).select(*keys, F.inline("suggested"))


class _Options:
    """Options of tokens, each looked up once, and the only pair of two tokens' options."""

    # A gap may end in a further line break, before which the pattern's `$` matches.
    _TOKEN, _WORD, _GAP, _MARKS = re.compile(rf"{WORD}|[^A-Za-zÀ-ỹĐđ]+"), re.compile(WORD), re.compile("[ \t\r\n]+[\x85\u2028\u2029]?"), re.compile("[\u0300-\u036F]")
    _PLAIN = str.maketrans(ACCENTED, PLAIN)

    def __init__(self, words: set[str], forms: dict[str, list[str]], bigrams: set[tuple[str, str]]):
        self.words, self.forms, self.bigrams = words, forms, bigrams
        self.tokens: dict[str, tuple[list[str], str, bool] | None] = {}

    def token(self, t: str) -> tuple[list[str], str, bool] | None:
        """(options, folded, titled) of a token; nothing of one without options, or in upper case."""
        low = t.lower().replace("ß", "ss")
        found = [low] if low in self.words else self.forms.get(self._MARKS.sub("", low).translate(self._PLAIN))
        if not found or t == t.upper() != t.lower():
            return None
        kinds = [unicodedata.category(c) for c in t]
        return found, low, kinds[0] == "Lu" and all(k == "Ll" for k in kinds[1:])

    def suggested(self, text: str) -> list[dict]:
        cut = self._TOKEN.findall(text)
        if len(self.tokens) > 200_000:
            self.tokens.clear()
        out, known, last = [], self.tokens, -9
        # Words and what is between them take turns.
        for at in range(0 if self._WORD.match(text) else 1, len(cut), 2):
            t = cut[at]
            if t not in known:
                known[t] = self.token(t)
            if known[t] is None:
                continue
            if at - last == 2 and self._GAP.fullmatch(cut[at - 1]) and "\n\n" not in cut[at - 1].replace("\r", ""):
                a, b = known[cut[last]], known[t]
                fits = [] if a[2] and b[2] else [(x, y) for x in a[0] for y in b[0] if (x, y) in self.bigrams]
                if len(fits) == 1 and fits[0] != (a[1], b[1]):
                    out.append({"at": last, "left": cut[last], "right": t, "new_left": fits[0][0], "new_right": fits[0][1]})
            last = at
        return out


def _joined(docs: DataFrame, keys: list[str], lexicon: tuple[DataFrame, DataFrame, DataFrame], text: str) -> DataFrame:
    """suggestions by joins of the texts' words with a lexicon of any size."""
    words, accents, bigrams = lexicon
    upper = lambda c: (F.col(c) == F.upper(c)) & (F.col(c) != F.lower(c))
    title = lambda c: F.col(c).rlike(r"^\p{Lu}\p{Ll}*$")
    pairs = word_pairs(docs, keys, text).where(~upper("left") & ~upper("right") & ~(title("left") & title("right")))
    used = pairs.select(F.explode(F.array("left", "right")).alias("token")).distinct()
    used = used.withColumn("w", casefold(F.col("token"))).withColumn("plain", unaccented(F.col("token")))
    options = used.join(words.withColumn("known", F.lit(True)), "w", "left").join(accents, "plain", "left").select("token", F.when(F.col("known"), F.array("w")).otherwise(F.col("forms")).alias("options")).where("options IS NOT NULL")
    side = lambda name: options.select(F.col("token").alias(name), F.explode("options").alias(f"new_{name}"))
    fits = pairs.select("left", "right").distinct().join(side("left"), "left").join(side("right"), "right").join(bigrams.select(F.col("left").alias("new_left"), F.col("right").alias("new_right")), ["new_left", "new_right"])
    one = fits.groupBy("left", "right").agg(F.count(F.lit(1)).alias("n"), F.min("new_left").alias("new_left"), F.min("new_right").alias("new_right")).where("n = 1").drop("n")
    changed = (F.col("new_left") != casefold(F.col("left"))) | (F.col("new_right") != casefold(F.col("right")))
    return pairs.join(one, ["left", "right"]).where(changed).select(*keys, "at", "left", "right", "new_left", "new_right")


def first_of_overlaps(found: DataFrame, keys: list[str]) -> DataFrame:
    """Suggestions without those that share a word with an accepted one before: every other of a chain."""
    w = Window.partitionBy(*keys).orderBy("at")
    r = found.withColumn("new", (F.coalesce(F.col("at") - F.lag("at").over(w), F.lit(9)) > 2).cast("int")).withColumn("chain", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.row_number().over(Window.partitionBy(*keys, "chain").orderBy("at"))
    return r.withColumn("n", n).where(F.col("n") % 2 == 1).drop("new", "chain", "n")


def nfc(texts: Column) -> Column:
    """Canonical composition; Spark has no function for it."""
    return _nfc(texts)


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def dictionary(lexicon: tuple[DataFrame, DataFrame, DataFrame], most: int) -> tuple[dict[str, list[str]], set[tuple[str, str]]]:
    """(options of each word, pairs) of a lexicon, as correct() takes them; an error if it has more than `most` words or pairs.

    A lexicon is of a language and doesn't grow with the texts, but that is checked.
    """
    words, accents, bigrams = lexicon
    rows = [f.limit(most + 1).collect() for f in (words, accents, bigrams)]
    if max(map(len, rows)) > most:
        raise ValueError(f"a lexicon of over {most} entries doesn't go to every task")
    options = {r.plain: list(r.forms) for r in rows[1]} | {r.w: [r.w] for r in rows[0]}
    return options, {(r.left, r.right) for r in rows[2]}


def corrected(docs: DataFrame, lexicon: tuple[DataFrame, DataFrame, DataFrame], text: str = "text", most: int = 1_000_000) -> DataFrame:
    """docs with corrected, the text with the words that exactly one pair of the lexicon fits, and n_corrected; a null text stays null."""
    options, pairs = dictionary(lexicon, most)

    @F.pandas_udf("corrected string, n_corrected long")
    def run(texts: pd.Series) -> pd.DataFrame:
        done = [correct(t, options, pairs) for t in texts]
        return pd.DataFrame({"corrected": [t for t, _ in done], "n_corrected": [n for _, n in done]})

    return docs.withColumn("spelt", run(F.col(text))).select(*docs.columns, "spelt.corrected", "spelt.n_corrected")


def correct(text: str | None, options: dict[str, list[str]], bigrams: set[tuple[str, str]]) -> tuple[str | None, int]:
    """(text, changed words) of one text, by dictionaries."""
    if not text:
        return text, 0
    blocked = [m.span() for p in (MASK, PIPE_LINE) for m in re.finditer(p, text)]
    found = [m for m in re.finditer(WORD, text) if not any(s < m.end() and m.start() < e for s, e in blocked)]
    new: dict[int, str] = {}
    busy = -1
    for i, (a, b) in enumerate(zip(found, found[1:], strict=False)):
        gap = text[a.end() : b.start()]
        if i <= busy or not gap or gap.strip(" \t\r\n") or "\n\n" in gap.replace("\r", "") or a[0].isupper() or b[0].isupper() or (a[0].istitle() and b[0].istitle()):
            continue
        fits = [(x, y) for x in options.get(a[0].casefold(), ()) for y in options.get(b[0].casefold(), ()) if (x, y) in bigrams]
        if len(fits) == 1 and fits[0] != (a[0].casefold(), b[0].casefold()):
            for at, m, word in ((i, a, fits[0][0]), (i + 1, b, fits[0][1])):
                if word != m[0].casefold():
                    new[at] = word.upper() if m[0].isupper() else word.title() if m[0].istitle() else word
            busy = i + 1
    out, last = [], 0
    for at, word in sorted(new.items()):
        out += [text[last : found[at].start()], word]
        last = found[at].end()
    return "".join([*out, text[last:]]), len(new)
