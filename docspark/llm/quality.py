"""Quality rules with risk-controlled thresholds.

Every rule rejects a document whose figure exceeds a cutoff. Cutoffs come from
labelled documents, for each stratum apart. One half of them chooses a cutoff of
a fixed grid for each rule. The other half, the holdout, certifies the verdict
of all rules together, along a path: the rules that rank best come first, each
falls from its loosest cutoff to the chosen one, then the next is added, so that
each step rejects what the one before it does. A step is certified if an exact
binomial test rejects, at level DELTA / strata (Bonferroni), that more than ALPHA
of the good documents are rejected by any rule. The path is tested from the
loosest step on and ends at the first that fails (a fixed sequence, which needs
no further correction). A stratum with too few good holdout documents to certify
anything by itself is pooled with the others like it, and the bound holds for the
pool; that is settled by numbers of labels alone, never by what the rules reject.
A pool that is still too small has no cutoff, and so rejects nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import discard, fresh, materialise, prefilter, slices, split_words

#: Strata: these languages, and all others together.
STRATA = ("de", "en", "es", "fr")
OTHER = "other"
ALPHA = 0.02
DELTA = 0.05
GRID = 64
#: Weight of a rejected good document against a rejected bad one in the choice among certified cutoffs.
COST = 10.0
#: Rule -> (numerator, denominator, loosest cutoff); the grid falls from it geometrically, over two decades.
RULES = {
    "symbols": ("n_symbols", "n_words", 4.0),
    "exclaim": ("n_exclaim", "n_words", 4.0),
    "upper": ("n_upper", "word_chars", 1.0),
    "dup_lines": ("n_dup_lines", "n_lines", 1.0),
    "repeats": ("n_repeat_words", "n_words", 1.0),
    "word_length": ("word_chars", "n_words", 200.0),
}
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim")


def repeat_words(offsets: np.ndarray, ids: np.ndarray, width: int = 3) -> np.ndarray:
    """For each text, its words that lie in a window of `width` words found twice or more in it."""
    docs = len(offsets) - 1
    if len(ids) < width:
        return np.zeros(docs, np.int64)
    doc = np.repeat(np.arange(docs), np.diff(offsets))
    key = ids.astype(np.int64)
    for k in range(1, width):
        pair = key[: len(key) - 1] * (int(ids.max()) + 1) + ids[k : k + len(key) - 1]
        key = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    start = np.flatnonzero(doc[: len(key)] == doc[width - 1 :])
    key = key[start]
    order = np.argsort(key, kind="stable")
    k, d = key[order], doc[start[order]]
    same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    hit = np.zeros(len(order), bool)
    hit[1:] |= same
    hit[:-1] |= same
    edge = np.zeros(len(ids) + width, np.int64)
    at = start[order[hit]]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    covered = np.cumsum(edge)[: len(ids)] > 0
    return np.bincount(doc[covered], minlength=docs)


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """FEATURES of each text."""
    texts = pc.fill_null(texts, "")
    offsets, words = split_words(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    count = lambda pattern: pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(np.int64)
    lines, dups = [], []
    for t in texts.to_pylist():
        full = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        lines.append(len(full))
        dups.append(len(full) - len(set(full)))
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, np.int64)
    return {
        "n_words": np.diff(offsets),
        "word_chars": np.bincount(doc, weights=lengths, minlength=len(texts)).astype(np.int64),
        "n_symbols": count(r"[#*$%&|<>]"),
        "n_dup_lines": np.array(dups, np.int64),
        "n_repeat_words": repeat_words(offsets, ids),
        "n_lines": np.array(lines, np.int64),
        "n_upper": count(r"\p{Lu}"),
        "n_exclaim": count(r"!"),
    }


def with_features(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """docs (its columns in `keep`, default all) and FEATURES, under names that don't clash.

    A null text counts as empty, a text of any length is measured whole, rows
    that repeat are each measured, and an empty table gives an empty one.
    """
    keep = docs.columns if keep is None else keep
    names = dict(zip(FEATURES, fresh(docs, *FEATURES), strict=True))
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(names[f], T.LongType()) for f in FEATURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                found = measure(batch.column(text))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(found[f], pa.int64()) for f in FEATURES)], schema.names)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema), names


def base_failed(n: dict[str, str]) -> Column:
    """Under 50 words, or over half of the words in repeated windows."""
    return (F.col(n["n_words"]) < 50) | (100 * F.col(n["n_repeat_words"]) > 50 * F.col(n["n_words"]))


def stratum(lang: Column) -> Column:
    return F.when(lang.isin(*STRATA), lang).otherwise(OTHER)


def grid(rule: str) -> np.ndarray:
    """Cutoffs of a rule, loosest first."""
    return RULES[rule][2] * 10.0 ** (-2 * np.arange(GRID) / (GRID - 1))


def figure(rule: str, n: dict[str, str]) -> Column:
    over, under, _ = RULES[rule]
    return F.col(n[over]) / F.greatest(F.col(n[under]), F.lit(1))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of n trials of chance p, exactly summed."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    steps = np.log(np.maximum(n - i[:-1], 1)) - np.log(i[1:])
    terms = n * math.log1p(-p) + np.concatenate([[0.0], np.cumsum(steps)]) + i * (math.log(p) - math.log1p(-p))
    top = terms.max()
    return float(min(1.0, math.exp(top) * np.exp(terms - top).sum()))


def upper_bound(k: int, n: int, level: float) -> float:
    """Clopper-Pearson upper bound of a rate, of which k of n were seen."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        low, high = (p, high) if p < 1 and binomial_cdf(k, n, p) > level else (low, p)
    return high


def choose(good_fit, bad_fit, good_holdout, level: float, alpha: float = ALPHA) -> int | None:
    """Index of the best certified cutoff or step; the arrays count documents by bin: bin b exceeds the cutoffs b - 1 and looser not.

    A document of bin b is rejected by the cutoffs with index >= b; the last bin is rejected by none.
    """
    rejected = lambda bins: np.cumsum(np.asarray(bins)[:-1])
    held, n = rejected(good_holdout), int(np.sum(good_holdout))
    best, best_value = None, 0.0
    good, bad = rejected(good_fit) / max(1, np.sum(good_fit)), rejected(bad_fit) / max(1, np.sum(bad_fit))
    for c in range(len(held)):
        if n == 0 or binomial_cdf(int(held[c]), n, alpha) > level:
            break
        value = bad[c] - COST * good[c]
        if value > best_value + 1e-12:
            best, best_value = c, value
    return best


def target(good_fit, bad_fit) -> tuple[float, int] | None:
    """(value, index) of the best cutoff of a rule by the documents that rank, uncertified; bins as in choose()."""
    good, bad = (np.cumsum(np.asarray(x)[:GRID]) / max(1, np.sum(x)) for x in (good_fit, bad_fit))
    value = bad - COST * good
    return (float(value.max()), int(value.argmax())) if value.max() > 1e-12 else None


def needed(alpha: float, level: float) -> int:
    """Good documents, none of them rejected, that certify a step at this level."""
    return math.ceil(math.log(level) / math.log1p(-alpha))


def pools(holdout: dict[str, int], alpha: float, delta: float) -> list[tuple[str, ...]]:
    """Strata that are certified together, by their numbers of good holdout documents: those too small by themselves, as one."""
    strata = (*STRATA, OTHER)
    small = tuple(s for s in strata if holdout.get(s, 0) < needed(alpha, delta / len(strata)))
    return [*((s,) for s in strata if s not in small), *([small] if small else [])]


def fit_cutoffs(features: DataFrame, names: dict[str, str], labels: DataFrame, ident: str = "doc_id", lang: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> dict[tuple[str, str], float]:
    """{(stratum, rule): cutoff}, from all labelled documents.

    Only counts come to the driver: by (stratum, rule, label, half, bin) of all
    labelled documents, at most 5 x 6 x 2 x 2 x 65, and by (pool, half, label,
    step) of the path, at most 5 x 2 x 2 x 385, whatever the input. Labels that
    are null or contradict each other for a document are left out.
    """
    label = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high").select(F.col("doc_id").alias("label_id"), (F.col("low") > 0).alias("good"))
    bins = lambda rule: F.lit(GRID) - F.aggregate(F.array(*(F.lit(float(c)) for c in grid(rule))), F.lit(0), lambda n, c: n + (figure(rule, names) > c).cast("int"))
    rows = features.where(~base_failed(names)).select(
        F.col(ident).alias("id"), stratum(F.col(lang)).alias("stratum"), F.array(*(F.struct(F.lit(r).alias("rule"), bins(r).alias("bin")) for r in RULES)).alias("bins")
    )
    held = materialise(rows.join(label, F.col("id") == F.col("label_id")).select("stratum", "good", (F.crc32(F.col("id").cast("string").cast("binary")) % 2 == 0).alias("holdout"), "bins"))
    seen: dict[tuple, np.ndarray] = {}
    numbers: dict[str, int] = {}
    for r in held.select("stratum", "good", "holdout", F.inline("bins")).groupBy("stratum", "rule", "good", "holdout", "bin").count().collect():
        if not r.holdout:
            seen.setdefault((r.stratum, r.rule, r.good), np.zeros(GRID + 1, np.int64))[r.bin] += r["count"]
        elif r.good and r.rule == next(iter(RULES)):
            numbers[r.stratum] = numbers.get(r.stratum, 0) + r["count"]
    none = np.zeros(GRID + 1, np.int64)
    together = pools(numbers, alpha, delta)
    total = lambda pool, rule, good: sum((seen.get((s, rule, good), none) for s in pool), none)
    targets = {pool: sorted((-t[0], rule, t[1]) for rule in RULES if (t := target(total(pool, rule, True), total(pool, rule, False)))) for pool in together}
    end = GRID * len(RULES)
    step, name = F.lit(end), F.lit(0)
    for i, pool in enumerate(together):
        name = F.when(F.col("stratum").isin(*pool), i).otherwise(name)
        for k, (_, rule, t) in enumerate(targets[pool]):
            b = F.col("bins")[list(RULES).index(rule)]["bin"]
            step = F.least(step, F.when(F.col("stratum").isin(*pool) & (b <= t), k * GRID + b).otherwise(end))
    paths: dict[tuple, np.ndarray] = {}
    for r in held.select(name.alias("pool"), "good", "holdout", step.alias("step")).groupBy("pool", "good", "holdout", "step").count().collect():
        paths.setdefault((r.pool, r.good, r.holdout), np.zeros(end + 1, np.int64))[r.step] += r["count"]
    discard(held)
    unseen = np.zeros(end + 1, np.int64)
    out = {}
    for i, pool in enumerate(together):
        get = lambda good, holdout: paths.get((i, good, holdout), unseen)  # noqa: E731, B023
        c = choose(get(True, False), get(False, False), get(True, True), delta / len(together), alpha)
        if c is not None:
            out |= {(s, rule): float(grid(rule)[min(c - k * GRID, t)]) for s in pool for k, (_, rule, t) in enumerate(targets[pool]) if c >= k * GRID}
    return out


def labelled(docs: DataFrame, labels: DataFrame, ident: str = "doc_id") -> DataFrame:
    """All rows of docs that have a label, and few others: texts aren't shuffled, fit_cutoffs() joins their figures."""
    (key,) = fresh(docs, "label_of")
    return prefilter(docs, ident, labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").alias(key)), key)


def verdict(cutoffs: dict[tuple[str, str], float], names: dict[str, str], lang: str = "lang") -> Column:
    """False where a rule of the document's stratum rejects it."""
    s = stratum(F.col(lang))
    rejected = F.lit(False)
    for (name, rule), c in sorted(cutoffs.items()):
        rejected = rejected | ((s == name) & (figure(rule, names) > c))
    return ~rejected
