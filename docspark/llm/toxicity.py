"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams and itself, all hashed
to buckets; a document is the mean of its words; a softmax over two classes reads
it. Vectors and softmax are trained together in numpy. A misspelt word that the
training never saw shares most n-grams, and so most of its vector, with the word
it stands for.

The fit uses at most TRAIN_ROWS labelled documents of each class, those of least
hash, with at most TRAIN_BYTES of text in all. Bags are made, and buckets counted,
where the texts are; the driver gets counts of buckets and the parts of the bags
that are trained. Scoring covers every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docspark.llm.common import discard, fresh, materialise, slices, split_words

#: Most labelled documents of each class in the fit.
TRAIN_ROWS = 2000
#: Most bytes of text of each class in the fit; texts of over a 16th of that don't count towards the fit.
TRAIN_BYTES = 32 << 20
BUCKETS = 1 << 17
WIDTHS = (3, 4, 5)
DIMENSIONS = 8
EPOCHS = 40
BATCH = 32
RATE = 4.0
#: A bucket is trained if so many training documents have it, and if the share of
#: these that is toxic differs from that of all by so many standard errors.
LEAST_DOCS = 6
LEAST_Z = 3.0
SEED = 20240601
_STEP = np.uint64(0x9E3779B97F4A7C15)


def subwords(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of each n-gram of the lower-cased words between < and >, and of each whole word."""
    lower = pc.utf8_lower(words.cast(pa.large_string()))
    marked = pc.binary_join_element_wise(*(x if x is lower else pa.scalar(x, pa.large_string()) for x in ("<", lower, ">", "")))
    lengths = pc.utf8_length(marked).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = np.frombuffer("".join(marked.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(len(codes))
    out_word, out_hash = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, max(WIDTHS) + 1):
        shifted = np.zeros(len(codes), np.uint64)
        shifted[: max(0, len(codes) - n + 1)] = codes[n - 1 :]
        h = (h ^ shifted) * _STEP
        h ^= h >> np.uint64(29)
        if n in WIDTHS:
            ok = left >= n
            out_word.append(word[ok])
            out_hash.append(h[ok] + np.uint64(n))
    if len(codes):
        place = np.arange(len(codes)) - np.repeat(ends - lengths, lengths)
        spread = (codes + np.uint64(1)) * _STEP
        spread = (spread ^ (spread >> np.uint64(31))) * (np.uint64(2) * place.astype(np.uint64) + np.uint64(0xBF58476D1CE4E5B9))
        out_word.append(np.arange(len(lengths)))
        out_hash.append(np.add.reduceat(spread, ends - lengths))
    hashes = np.concatenate(out_hash)
    hashes = (hashes ^ (hashes >> np.uint64(32))) * _STEP
    return np.concatenate(out_word), (hashes >> np.uint64(64 - 17)).astype(np.int64)


@dataclass
class Model:
    """score = sigmoid(bias + mean over words of mean over their buckets of value)."""

    value: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        offsets, words = split_words(texts)
        n = len(offsets) - 1
        logit = np.full(n, self.bias)
        if len(words):
            coded = words.dictionary_encode()
            word, bucket = subwords(coded.dictionary)
            each = np.bincount(word, weights=self.value[bucket], minlength=len(coded.dictionary)) / np.bincount(word, minlength=len(coded.dictionary))
            doc = np.repeat(np.arange(n), np.diff(offsets))
            total = np.bincount(doc, weights=each[coded.indices.to_numpy(zero_copy_only=False)], minlength=n)
            logit = logit + total / np.maximum(np.diff(offsets), 1)
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def _bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, weight), weights of a document adding up to 1; by document."""
    offsets, words = split_words(texts)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    coded = words.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    word, bucket = subwords(coded.dictionary)
    order = np.argsort(word, kind="stable")
    bucket, grams = bucket[order], np.bincount(word, minlength=len(coded.dictionary))
    first = np.concatenate([[0], np.cumsum(grams)])
    out = []
    for d in range(len(offsets) - 1):
        used, times = np.unique(ids[offsets[d] : offsets[d + 1]], return_counts=True)
        if len(used):
            k = grams[used]
            at = np.repeat(first[used], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            weight = np.repeat(times / k, k) / times.sum()
            b, back = np.unique(bucket[at], return_inverse=True)
            out.append((np.full(len(b), d), b, np.bincount(back, weights=weight)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def trained(having: np.ndarray, with_label: np.ndarray, share: float) -> np.ndarray:
    """Which buckets are trained, by the documents and the toxic documents that have each; share is that of toxic documents."""
    z = (with_label - having * share) / np.sqrt(np.maximum(having, 1) * share * (1 - share))
    return (having >= LEAST_DOCS) & (np.abs(z) >= LEAST_Z)


def train(bags: tuple[np.ndarray, np.ndarray, np.ndarray], often: np.ndarray, toxic: np.ndarray, prior: float) -> Model:
    """Vectors and softmax, trained jointly by Adagrad, of the bags (document, bucket, weight; by document) of the buckets that `often` marks.

    prior is the rate of toxic documents, to which the bias is set.
    """
    n, labels = len(toxic), toxic.astype(np.int64)
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    even = float(np.log(prior / (1 - prior)))
    if n == 0 or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS), even)
    doc, bucket, weight = bags
    start = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))])
    rng = np.random.default_rng(SEED)
    vectors = np.zeros((BUCKETS, DIMENSIONS))
    vectors[often] = rng.normal(0, 0.1, (int(often.sum()), DIMENSIONS))
    soft = np.stack([-np.ones(DIMENSIONS), np.ones(DIMENSIONS)], 1) / np.sqrt(DIMENSIONS)
    bias = np.zeros(2)
    seen, seen_soft, seen_bias = np.zeros(BUCKETS), np.full(soft.shape, 1.0), np.full(2, 1.0)
    balance = n / (2 * np.bincount(labels, minlength=2))
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            ids = np.sort(order[at : at + BATCH])
            k = start[ids + 1] - start[ids]
            rows = np.repeat(start[ids], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            local, b, w = np.repeat(np.arange(len(ids)), k), bucket[rows], weight[rows]
            used, back = np.unique(b, return_inverse=True)
            dense = np.zeros((len(ids), len(used)))
            dense[local, back] = w
            hidden = dense @ vectors[used]
            z = hidden @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(ids)), labels[ids]] -= 1
            p *= balance[labels[ids]][:, None] / len(ids)
            g = dense.T @ (p @ soft.T)
            # One rate for each bucket, from the length of its gradients: rare and common buckets learn alike.
            seen[used] += (g * g).sum(1)
            g_soft, g_bias = hidden.T @ p, p.sum(0)
            vectors[used] -= RATE * g / (np.sqrt(seen[used])[:, None] + 1e-7)
            seen_soft += g_soft**2
            seen_bias += g_bias**2
            soft -= RATE * g_soft / np.sqrt(seen_soft)
            bias -= RATE * g_bias / np.sqrt(seen_bias)
    return Model(vectors @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0]) + even)


def held_out(ident: Column) -> Column:
    """Documents whose labels the fit never sees; a null id counts as the empty text."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, text: str = "text", ident: str = "doc_id", most: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> tuple[DataFrame, float]:
    """((id, toxic, text) of the fit, by no other columns; the rate of toxic documents among all that it might use)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    count = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    drawn = [known.where(F.col("toxic") == side).withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(most) for side in (False, True)]
    ids = drawn[0].unionByName(drawn[1]).select(F.col("doc_id").alias("label_id"), "toxic", "place")
    # At most 2 * most rows of three columns: a proven bound.
    rows = docs.select(F.col(ident).alias("id"), F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(ids), F.col("id") == F.col("label_id"))
    size = F.octet_length("text").cast("long")
    rows = rows.where(size <= most_bytes // 16).groupBy("id", "toxic", "place").agg(F.min("text").alias("text"))
    before = F.sum(size).over(Window.partitionBy("toxic").orderBy("place", "id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("so_far", before).where(F.col("so_far") <= most_bytes).select("id", "toxic", "text"), count.get(True, 0) / max(1, sum(count.values()))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", ident: str = "doc_id", most: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Model:
    """A model of the labels outside the held-out fold.

    Null ids and labels are left out; an id with several labels takes the
    largest, one with several texts the least. The driver gets a row for each
    document of the sample (its id and label), one for each bucket, and the
    trained parts of the bags; never a text.
    """
    rows, prior = sample(docs, labels, text, ident, most, most_bytes)
    rows = materialise(rows)
    every = rows.select("id", "toxic").toArrow().sort_by("id")
    ids, toxic = every.column("id").to_numpy(), every.column("toxic").to_numpy()
    if not len(ids):
        return Model(np.zeros(BUCKETS), float(np.log(1e-4)) if not prior else float(np.log(max(prior, 1e-4) / max(1 - prior, 1e-4))))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        having, with_label = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                doc, bucket, _ = _bags(batch.column("text"))
                marks = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
                having += np.bincount(bucket, minlength=BUCKETS)
                with_label += np.bincount(bucket[marks[doc] > 0], minlength=BUCKETS)
        seen = np.flatnonzero(having)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(having[seen]), pa.array(with_label[seen])], ["bucket", "n", "n_toxic"])

    counts = rows.mapInArrow(counted, "bucket bigint, n bigint, n_toxic bigint").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic")).toArrow()
    having, with_label = np.zeros(BUCKETS), np.zeros(BUCKETS)
    having[counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    with_label[counts.column("bucket").to_numpy()] = counts.column("n_toxic").to_numpy()
    share = toxic.mean()
    often = trained(having, with_label, share) if 0 < share < 1 else np.zeros(BUCKETS, bool)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                doc, bucket, weight = _bags(batch.column("text"))
                keep = often[bucket]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(doc[keep])), pa.array(bucket[keep].astype(np.int32)), pa.array(weight[keep])], ["id", "bucket", "weight"])

    bags = rows.mapInArrow(kept, "id bigint, bucket int, weight double").toArrow().sort_by([("id", "ascending"), ("bucket", "ascending")])
    discard(rows)
    doc = np.searchsorted(ids, bags.column("id").to_numpy())
    return train((doc, bags.column("bucket").to_numpy().astype(np.int64), bags.column("weight").to_numpy()), often, toxic, prior)


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (its columns in `keep`, default all) with score, 0 to 1. No shuffle.

    A null or empty text scores by the bias alone, a text of any length is read
    whole, rows that repeat are each scored, equal texts alike, and an empty table
    gives an empty one. score gets another name if docs has such a column.
    """
    keep = docs.columns if keep is None else keep
    (name,) = fresh(docs, "score")
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(name, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(shared.value.score(batch.column(text)))], schema.names)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
