"""Secret scans with corpus-wide ownership frequency.

Candidates are matches of the base kinds and, beyond them, of high-entropy
tokens. Hashes of the candidate values are aggregated over the corpus by distinct
repositories (documents) and owners (sources). A value that many owners share, or
that one owner has pasted into many repositories, is a copied example; one that
few of both have looks live. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import materialise

#: Base kinds, in order: pattern, group that must have the least length, least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = {"assign": (ASSIGN, 2, 6), "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]+", 0, 24)}
#: Kind added by the method: long tokens of mixed characters.
TOKEN = (r"[A-Za-z0-9+/_-]+", 0, 32)
#: Fewest bits of a character, on average, in a token.
TOKEN_BITS = 3.5
#: A value of more owners than this is a widely copied example.
MOST_OWNERS = 2
#: So is a value of more repositories than this, whoever owns them.
MOST_REPOSITORIES = 50
#: Tasks that a value's finds are dealt to at least, so that one value may hold most of the rows.
SALTS = 16
#: Matches of a text whose places are added up at a time.
FOLD = 512
ORDER = [*KINDS, "token"]


def matches(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches: array of (kind, start, stop, value) in code points; matches below the least length are dropped.

    Text between the matches gives their places: lengths of both, summed in turn,
    FOLD at a time and then over these, as an array that grows in a fold is
    copied at each step.
    """
    pattern, group, least = (KINDS | {"token": TOKEN})[kind]
    fields = [F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")]
    value = (lambda x: x["value"]) if group else (lambda x: x["hit"])
    if group:
        fields.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    lengths = F.transform(F.arrays_zip(*fields), lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.coalesce(F.length(x["hit"]), F.lit(0)).alias("hit"), F.coalesce(value(x), F.lit("")).alias("value")))
    none = F.array().cast("array<struct<kind:string,start:int,stop:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        end = begin + x["hit"]
        found = F.array(F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("stop"), x["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= least, F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"))

    def moved(acc, part):
        placed = F.transform(part["out"], lambda s: F.struct(s["kind"].alias("kind"), (s["start"] + acc["at"]).alias("start"), (s["stop"] + acc["at"]).alias("stop"), s["value"].alias("value")))
        return F.struct((acc["at"] + part["at"]).alias("at"), F.when(F.size(placed) > 0, F.concat(acc["out"], placed)).otherwise(acc["out"]).alias("out"))

    def summed(items):
        parts = F.transform(F.sequence(F.lit(0), ((F.size(items) - 1) / FOLD).cast("int")), lambda k: F.aggregate(F.slice(items, k * FOLD + 1, FOLD), start, step))
        return F.aggregate(parts, start, moved, lambda acc: acc["out"])

    # Bound to a name of a lambda, the array is made once.
    return F.when(text.rlike(_probe(kind)), F.element_at(F.transform(F.array(lengths), summed), 1)).otherwise(none)


def _probe(kind: str) -> str:
    """Pattern found in each text with a match that counts."""
    return {"assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}""", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}", "token": r"[A-Za-z0-9+/_-]{32}"}[kind]


def bits(value: Column) -> Column:
    """Shannon entropy of a value's characters, in bits."""
    chars = F.split(value, "")
    n = F.length(value)
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - (F.size(F.filter(chars, lambda x: x == c)) / n) * F.log2(F.size(F.filter(chars, lambda x: x == c)) / n))


def candidates(docs: DataFrame, text: str = "text", ident: str = "doc_id", owner: str = "source") -> DataFrame:
    """row, doc_id, owner, found (array of kind, start, stop, value); a row for each row of docs, kept as a table. A null text counts as empty."""
    body = F.coalesce(F.col("text"), F.lit(""))
    found = F.concat(*(matches(body, k) for k in KINDS))
    token = F.filter(matches(body, "token"), lambda x: x["value"].rlike(r"[0-9]") & x["value"].rlike(r"[A-Z]") & x["value"].rlike(r"[a-z]") & (bits(x["value"]) >= TOKEN_BITS))
    table = docs.select(F.col(ident).alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(text).alias("text"))
    return materialise(table.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", found.alias("base"), token.alias("more")))


def ownership(found: DataFrame, repository: str = "doc_id") -> DataFrame:
    """hash, n_repositories, n_owners of each candidate value; a null owner or repository counts as one."""
    values = found.select("owner", F.col(repository).cast("string").alias("repository"), F.explode(F.concat("base", "more")).alias("c")).select(F.sha2(F.col("c.value"), 256).alias("hash"), F.coalesce("owner", F.lit("\0")).alias("owner"), F.coalesce("repository", F.lit("\0")).alias("repository"))
    pairs = lambda k: values.groupBy("hash", k).count().groupBy("hash").agg(F.count(F.lit(1)).alias(f"n_{k}"))
    return pairs("repository").join(pairs("owner"), "hash").select("hash", F.col("n_repository").alias("n_repositories"), F.col("n_owner").alias("n_owners"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _sorted(spans: Column) -> Column:
    """By start, then kind as listed."""
    rank = lambda s: F.array_position(F.array(*(F.lit(k) for k in ORDER)), s["kind"])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind"), s["value"].alias("value")))
    return F.array_sort(keyed)


def scan(docs: DataFrame, text: str = "text", ident: str = "doc_id", owner: str = "source", most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """row, doc_id, base, spans, live; a row for each row of docs.

    base holds the base matches. live holds the matches and tokens whose value at
    most most_owners owners and most_repositories repositories have; spans holds
    the base ones and the live tokens. Each is an array of (start, rank, stop,
    kind, value) by start, then kind. Rows that repeat a doc_id are one
    repository; null doc_ids, and null owners, are one. Texts are read whole,
    whatever their length; a text without candidates has empty arrays; an empty
    table gives an empty one.
    """
    found = candidates(docs, text, ident, owner)
    live = ownership(found).where((F.col("n_owners") <= most_owners) & (F.col("n_repositories") <= most_repositories))
    # A copied example may stand in a third of all rows: its finds are dealt over SALTS keys. Only live values, of few repositories each, are repeated for that.
    live = live.select("hash", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    each = found.where((F.size("base") > 0) | (F.size("more") > 0)).select("row", F.explode(F.concat("base", "more")).alias("s"))
    each = each.withColumn("hash", F.sha2(F.col("s.value"), 256)).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    lived = each.join(live, ["hash", "salt"], "left_semi").groupBy(F.col("row").alias("r")).agg(F.collect_list("s").alias("live"))
    none = F.array().cast("array<struct<kind:string,start:int,stop:int,value:string>>")
    joined = found.join(lived, found["row"] == lived["r"], "left").withColumn("live", F.coalesce("live", none))
    spans = F.concat("base", F.filter("live", lambda s: s["kind"] == "token"))
    return joined.select("row", "doc_id", _sorted(F.col("base")).alias("base"), _sorted(spans).alias("spans"), _sorted(F.col("live")).alias("live"))
