"""Substring dedup by repeated-phrase automata.

A window is WINDOW consecutive words. Passages that recur are found by hashes:
every window gives its least ANCHOR-word hash, and only windows whose anchor
stands in several documents are hashed whole; the document of least id with a
window owns it. The owner's passages are then cut into tiles of TILE words, and
each shard of documents compiles the tiles of its passages into one Aho-Corasick
automaton and streams its documents through it. Every hit is extended word by
word along the passage: the words themselves, not hashes, say what is removed.
A run of WINDOW equal words holds a whole tile, so no occurrence is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import discard, fresh, join_hot, materialise, prefilter, slices, split_words

WINDOW = 50
ANCHOR = 25
TILE = 25
_BASE = 0x9E3779B97F4A7C15
#: Base of the check hash of windows, a hash of its own.
_CHECK = 0xD6E8FEB86659FD93
#: Documents that take passages from one join key, on average.
SHARE = 256


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class _Hashes:
    """Hashes of the word runs of a batch of texts, texts laid end to end."""

    def __init__(self, texts: pa.Array):
        self.offsets, words = split_words(texts)
        n = self.n = len(words)
        coded = words.dictionary_encode()
        names = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        each = names[coded.indices.to_numpy(zero_copy_only=False)] if n else np.zeros(0, np.uint64)
        self.back = _powers(pow(_BASE, -1, 1 << 64), n + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each * _powers(_BASE, n)[:n], dtype=np.uint64)])
        self.each = each
        self.doc = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))

    def runs(self, width: int) -> np.ndarray:
        """Hash of the run of `width` words from each place on."""
        if self.n < width:
            return np.zeros(0, np.uint64)
        return _mix((self.sums[width:] - self.sums[:-width]) * self.back[: self.n - width + 1])

    def checks(self, width: int, places: np.ndarray) -> np.ndarray:
        """A second hash of the runs of `width` words from these places on, 32 bits, of other word hashes and another base."""
        if not len(places):
            return np.zeros(0, np.int32)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(self.each ^ np.uint64(_CHECK)) * _powers(_CHECK, self.n)[: self.n], dtype=np.uint64)])
        back = _powers(pow(_CHECK, -1, 1 << 64), self.n + 1)
        return (_mix((sums[places + width] - sums[places]) * back[places]) >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def windows(self, width: int) -> np.ndarray:
        """Places of the windows that lie in one text."""
        if self.n < width:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[: self.n - width + 1] == self.doc[width - 1 :])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def _anchors(h: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(place, anchor) of each window."""
    at = h.windows(WINDOW)
    if not len(at):
        return at, np.zeros(0, np.int64)
    return at, _sliding_min(h.runs(ANCHOR), WINDOW - ANCHOR + 1)[at].view(np.int64)


def anchors(docs: DataFrame) -> DataFrame:
    """(h, d): the distinct anchors of each document; docs has id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                h = _Hashes(batch.column("text"))
                at, value = _anchors(h)
                doc = h.doc[at]
                # Neighbouring windows mostly share their anchor.
                new = np.concatenate([[True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])]) if len(at) else np.zeros(0, bool)
                ids = batch.column("id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(value[new]), pa.array(ids[doc[new]], pa.int64())], ["h", "d"])

    return docs.mapInArrow(run, "h bigint, d bigint")


def windows(docs: DataFrame) -> DataFrame:
    """(w, c, d, p): hash, check hash and place of the windows whose anchor is among the document's `marks`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                h = _Hashes(batch.column("text"))
                at, value = _anchors(h)
                marks = batch.column("marks")
                marked = marks.flatten().to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(len(marks)), marks.value_lengths().to_numpy(zero_copy_only=False))
                doc = h.doc[at]
                # Marks and anchors of one document, by a key of both.
                key = lambda d, v: _mix(v.view(np.uint64) + d.astype(np.uint64) * np.uint64(_BASE))
                hit = np.isin(key(doc, value), key(owner, marked))
                places, doc = at[hit], doc[hit]
                ids = batch.column("id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(h.runs(WINDOW)[places].view(np.int64)), pa.array(h.checks(WINDOW, places)), pa.array(ids[doc], pa.int64()), pa.array((places - h.offsets[doc]).astype(np.int32))], ["w", "c", "d", "p"])

    return docs.mapInArrow(run, "w bigint, c int, d bigint, p int")


def routes(docs: DataFrame) -> DataFrame:
    """(d, m, places): for each document, the places in smaller document m of the windows that it shares with m, their owner.

    Windows are told apart by 96 bits. Anchors and windows of more than a
    HOT_KEYS-th of the rows are joined by broadcast.
    """
    found = materialise(anchors(docs))
    known = materialise(found.groupBy("h").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("h", "n"))
    marked = join_hot(found, known, ["h"], "left_semi", "n").groupBy(F.col("d").alias("id")).agg(F.collect_set("h").alias("marks"))
    seen = materialise(windows(docs.join(marked, "id").select("id", "text", "marks")))
    discard(found, known)
    owners = materialise(seen.groupBy("w", "c").agg(F.min("d").alias("m"), F.max("d").alias("high"), F.min_by("p", "d").alias("mp"), F.count(F.lit(1)).alias("n")).where("m < high").select("w", "c", "m", "mp", "n"))
    routed = materialise(join_hot(seen, owners, ["w", "c"], count="n").where("d > m").groupBy("d", "m").agg(F.array_sort(F.collect_set("mp")).alias("places")))
    discard(seen, owners)
    return routed


def passages(routed: DataFrame, docs: DataFrame) -> DataFrame:
    """(d, found): the passages that each document shares with smaller ones, words joined by a space, with their owners.

    Ids go before texts: an owner's text meets each set of its places once,
    however many documents share them, and only the passages cut from it go to
    these documents, SHARE of them a join key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                out: list[list[str]] = []
                text, words = None, []
                for places, t in zip(batch.column("places").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    if t != text:
                        text, words = t, (t or "").encode().split()
                    at = np.array(places)
                    out.append([b" ".join(words[r[0] : r[-1] + WINDOW]).decode() for r in np.split(at, np.flatnonzero(np.diff(at) != 1) + 1)])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("m", "key", "n")), pa.array(out, pa.list_(pa.string()))], ["m", "key", "n", "passages"])

    keyed = routed.withColumn("key", F.md5(F.to_binary(F.array_join(F.col("places").cast("array<string>"), ","), F.lit("utf-8"))))
    sets = materialise(keyed.groupBy("m", "key").agg(F.count(F.lit(1)).alias("n"), F.first("places").alias("places")))
    # Few documents own a passage: the others' texts stay out of the shuffle.
    owners = prefilter(docs, "id", sets, "m")
    cut = sets.join(owners, F.col("m") == F.col("id")).select("m", "key", "n", "places", "text").mapInArrow(run, "m bigint, key string, n bigint, passages array<string>")
    dealt = cut.withColumn("part", F.explode(F.sequence(F.lit(0), (F.col("n") / SHARE).cast("int"))))
    takers = join_hot(materialise(keyed.select("d", "m", "key")), sets.select("m", "key", "n"), ["m", "key"], count="n").withColumn("part", F.pmod(F.xxhash64("d"), (F.col("n") / SHARE).cast("int") + 1).cast("int"))
    shared = takers.select("d", "m", "key", "part").join(dealt.select("m", "key", "part", "passages"), ["m", "key", "part"])
    return shared.groupBy("d").agg(F.collect_list(F.struct("m", "passages")).alias("found"))


class Automaton:
    """Tiles of a shard's passages; finds the runs of WINDOW or more words that a text shares with one of them."""

    def __init__(self, passages: list[tuple[int, bytes]]):
        self.letters: dict[bytes, str] = {}
        self.owners: list[int] = []
        self.texts: list[str] = []
        tiles: dict[str, list[tuple[int, int]]] = {}
        for m, passage in dict.fromkeys(passages):
            text = "".join(map(self._letter, passage.split()))
            for at in range(0, len(text) - TILE + 1, TILE):
                tiles.setdefault(text[at : at + TILE], []).append((len(self.texts), at))
            self.owners.append(m)
            self.texts.append(text)
        self.machine = ahocorasick.Automaton()
        for tile, places in tiles.items():
            self.machine.add_word(tile, places)
        if tiles:
            self.machine.make_automaton()

    def _letter(self, word: bytes) -> str:
        """A character for each word; surrogates are passed over, U+0000 is any other word."""
        found = self.letters.get(word)
        if found is None:
            code = len(self.letters) + 1
            found = self.letters[word] = chr(code if code < 0xD800 else code + 0x800)
        return found

    def shared(self, words: list[bytes], ident: int) -> np.ndarray:
        """For each word, whether it lies in a window that a document smaller than ident has too."""
        text = "".join(map(self.letters.get, words, repeat("\0")))
        edge = np.zeros(len(words) + 1, np.int64)
        reached: dict[tuple[int, int], int] = {}
        if len(self.machine):
            for last, places in self.machine.iter(text):
                begin = last - TILE + 1
                for k, at in places:
                    if self.owners[k] >= ident or reached.get((k, begin - at), -1) > last:
                        continue
                    other = self.texts[k]
                    left = _common(text[:begin], other[:at], True)
                    right = _common(text[last + 1 :], other[at + TILE :], False)
                    reached[k, begin - at] = last + 1 + right
                    if left + TILE + right >= WINDOW:
                        edge[begin - left] += 1
                        edge[last + 1 + right] -= 1
        return np.cumsum(edge[:-1]) > 0


def _common(a: str, b: str, ends: bool) -> int:
    """Length of the longest common prefix, or suffix."""
    n = min(len(a), len(b))
    low, step = 0, 64
    while low < n:
        high = min(n, low + step)
        same = a[len(a) - high : len(a) - low] == b[len(b) - high : len(b) - low] if ends else a[low:high] == b[low:high]
        if same:
            low, step = high, step * 2
        elif high - low == 1:
            return low
        else:
            step = max(1, (high - low) // 2)
    return n


def remove_repeats(docs: DataFrame, text: str = "text", ident: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """docs (its columns in `keep`, default all) with n_words, spans and kept.

    spans are the runs of words [start, stop) that lie in windows which a
    document with a smaller ident has too; kept holds the other words, joined by
    a space. Windows are judged on the input. A null text has no words; a row
    with a null ident is compared with nothing and kept whole; rows with the same
    ident aren't compared with each other. New columns get other names if docs
    has such columns. Passages reach a shard as far as one of its documents
    shares them, so automata stay within the size of the shard's own text.
    """
    keep = docs.columns if keep is None else keep
    n_words, spans, kept, found, key = fresh(docs, "n_words", "spans", "kept", "found", "key")
    plain = docs.where(F.col(ident).isNotNull()).select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text"))
    shared = passages(routes(plain), plain).select(F.col("d").alias(key), F.col("found").alias(found))
    span = pa.struct([pa.field("start", pa.int32()), pa.field("stop", pa.int32())])
    spark_span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(n_words, T.LongType()), T.StructField(spans, spark_span), T.StructField(kept, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                ids, lists = batch.column(ident).to_pylist(), batch.column(found).to_pylist()
                machine = Automaton([(x["m"], p.encode()) for xs in lists for x in xs or () for p in x["passages"]])
                counts, runs, left = [], [], []
                for i, t in enumerate(batch.column(text).to_pylist()):
                    words = (t or "").encode().split()
                    gone = machine.shared(words, ids[i]) if machine.texts and ids[i] is not None and len(words) >= WINDOW else np.zeros(len(words), bool)
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                    counts.append(len(words))
                    runs.append([{"start": int(a), "stop": int(b)} for a, b in edges.reshape(-1, 2)])
                    left.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode() if len(edges) else b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(span)), pa.array(left, pa.string())], schema.names)

    need = list(dict.fromkeys([*keep, text, ident]))
    return docs.select(*need).join(shared, F.col(ident) == F.col(key), "left").select(*need, found).mapInArrow(run, schema)
