"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is the sequence of its SHINGLE-word k-mers, each labelled with its number
among its equals. For each of TABLES hash functions the PICKS least k-mers, in
the order in which they stand in the text, make one sketch. Texts that share a
sketch are candidates; the ordered Jaccard similarity, M / (n + m - M) for M
k-mers matched in order, decides. An alignment that reaches SIMILARITY stays
within a band of (n + m) x (1 - s) / (1 + s) about the diagonal.

Every bucket is compared with its leaders first; then the pairs of its members
that are still in different components, in blocks, until none is untried.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import discard, fresh, give_back, join_hot, materialise, prefilter, slices
from docspark.llm.substring_dedup import _Hashes, _mix

SHINGLE = 5
SIMILARITY = 0.8
TABLES = 32
PICKS = 5
#: k-mers looked at, on average, for the PICKS least.
DRAW = 30
#: Members of a bucket that meet those of another block, or each other, in one task, on average.
BLOCK = 256
#: Bytes of text of the groups that cross() hashes at a time.
CROSS_BYTES = 2 << 20
_ODD = (np.random.default_rng(7).integers(0, 1 << 63, (2, TABLES), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.arange(TABLES, dtype=np.uint64) * _STEP


def shingles(h: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, k-mers) of each text; a text of fewer than SHINGLE words, but some, is one k-mer."""
    counts = np.diff(h.offsets)
    at = h.windows(SHINGLE)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    doc = np.concatenate([h.doc[at], short])
    value = h.runs(SHINGLE)[at]
    start, stop = h.offsets[short], h.offsets[short + 1]
    whole = _mix((h.sums[stop] - h.sums[start]) * h.back[start]) + counts[short].astype(np.uint64)
    order = np.argsort(doc, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(counts)))]), np.concatenate([value, whole])[order]


def labelled(offsets: np.ndarray, kmers: np.ndarray) -> np.ndarray:
    """k-mers mixed with their number among the equal ones of their text."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    key = _mix(kmers + doc.astype(np.uint64) * _STEP)
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(key) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0)) if len(key) else np.zeros(0, np.int64)
    number = np.empty(len(key), np.uint64)
    number[order] = (np.arange(len(key)) - first).astype(np.uint64)
    return _mix(kmers + number * _STEP)


def sketches(offsets: np.ndarray, kmers: np.ndarray) -> np.ndarray:
    """A row of TABLES sketches for each text; 0 for texts without k-mers."""
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    marks = labelled(offsets, kmers)
    share = np.minimum(DRAW / np.maximum(sizes, 1), 1.0)
    limit = np.where(share >= 1, np.uint64(2**64 - 1), (share * 2.0**63).astype(np.uint64) * np.uint64(2))
    each = limit[doc]
    need = np.minimum(sizes, PICKS)
    out = np.zeros((len(sizes), TABLES), np.int64)
    for t in range(TABLES):
        value = (marks ^ _ODD[1, t]) * _ODD[0, t]
        picked = np.flatnonzero(value <= each)
        few = np.bincount(doc[picked], minlength=len(sizes)) < need
        if few.any():
            picked = np.flatnonzero((value <= each) | few[doc])
        order = picked[np.lexsort((value[picked], doc[picked]))]
        start = np.concatenate([[0], np.cumsum(np.bincount(doc[order], minlength=len(sizes)))])
        rank = np.arange(len(order)) - start[doc[order]]
        least = np.sort(order[rank < PICKS])
        if len(least):
            first = np.concatenate([[0], np.cumsum(need)])
            place = (np.arange(len(least)) - first[doc[least]]).astype(np.uint64)
            some = need > 0
            mixed = np.add.reduceat(_mix(marks[least] + (place + np.uint64(1)) * _ODD[0, 0]), first[:-1][some])
            out[some, t] = _mix(mixed + _TABLE[t]).view(np.int64)
    return out


def short_keys(kmers: np.ndarray) -> list[int]:
    """Keys of the k-mer sequences that a text of 4 to 11 k-mers shares with any that is similar, if one of both has 9 or fewer.

    Such a pair is equal but for one k-mer more (4 to 9 against one more), two
    more (8 against 10, 9 against 11) or one of 9 in each: the sequence itself,
    and with each one or two k-mers left out, are all that they can share.
    """
    n = len(kmers)
    left_out = [k for k, sizes in enumerate((range(4, 10), range(5, 11), range(10, 12))) if n in sizes]
    runs = {tuple(run) for k in left_out for run in combinations(kmers.tolist(), n - k)}
    return [int.from_bytes(hashlib.blake2b(np.array(run, np.uint64).tobytes(), digest_size=8).digest(), "little", signed=True) for run in runs]


def signatures(docs: DataFrame) -> DataFrame:
    """(id, words, sketches) of the texts that have words; words is a digest of the word sequence. docs has id and text.

    The short_keys of texts of few k-mers stand after their sketches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                h = _Hashes(batch.column("text"))
                offsets, kmers = shingles(h)
                found = sketches(offsets, kmers)
                few = np.flatnonzero((np.diff(offsets) >= 4) & (np.diff(offsets) <= 11))
                more = {i: short_keys(kmers[offsets[i] : offsets[i + 1]]) for i in few.tolist()}
                size = np.full(len(found), TABLES, np.int32)
                size[list(more)] += np.array([len(k) for k in more.values()], np.int32)
                ends = np.cumsum(size, dtype=np.int32)
                flat = np.insert(found.ravel(), np.repeat((few + 1) * TABLES, size[few] - TABLES), [k for keys in more.values() for k in keys]) if more else found.ravel()
                full = np.diff(h.offsets) > 0
                digest = [hashlib.sha256(b" ".join((t or "").encode().split())).digest()[:16] for t in batch.column("text").to_pylist()]
                rows = pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(1, np.int32), ends])), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(digest, pa.binary()), rows], ["id", "words", "sketches"]).filter(pa.array(full))

    return docs.mapInArrow(run, "id bigint, words binary, sketches array<bigint>")


def ordered_similarity(a: list[int], b: list[int], least: float = SIMILARITY) -> float:
    """M / (n + m - M) of the k-mers matched in order inside the band of `least`; 0.0 as soon as it can't reach that.

    The longest common subsequence runs bit-parallel: one integer holds a row.
    """
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    most = sum((Counter(a) & Counter(b)).values())
    if most < least * (n + m - most):
        return 0.0
    band = int((n + m) * (1 - least) / (1 + least)) + 1
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    row, full, width = (1 << n) - 1, (1 << n) - 1, (1 << (2 * band + 1)) - 1
    for j, x in enumerate(b):
        if hits := places.get(x, 0):
            hits &= width << (j - band) if j >= band else width >> (band - j)
            if u := row & hits:
                row = ((row + u) | (row - u)) & full
    matched = n - row.bit_count()
    return matched / (n + m - matched)


def verify(pairs: DataFrame, docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b) that reach `least`; docs has id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text_b", 2 << 20):
                n = batch.num_rows
                texts = pa.concat_arrays([batch.column("text_a"), batch.column("text_b")]).dictionary_encode()
                offsets, kmers = shingles(_Hashes(texts.dictionary))
                rows = [kmers[s:e].tolist() for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
                at = texts.indices.to_pylist()
                found = np.array([ordered_similarity(rows[at[i]], rows[at[n + i]], least) for i in range(n)])
                good = found >= least
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found)], ["a", "b", "similarity"]).filter(pa.array(good))

    ids = pairs.select(F.explode(F.array("a", "b")).alias("some"))
    texts = prefilter(docs, "id", ids, "some")
    one = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint, similarity double")


def links(members: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): similar texts among those that share a sketch; members is a table of (s, r), docs has id and text.

    Every bucket's members meet two leaders, the least and the hub: the member
    whose buckets are largest in all, which for copies of one text is that text
    or the copy nearest to it. So far the pairs grow with the members. cross()
    then tries what is left, so that each two texts of a bucket are linked by
    some chain or were compared.
    """
    sizes = members.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).where("low < high").select("s", "n", "low")
    held = materialise(members.join(sizes, "s"))
    weight = held.groupBy("r").agg(F.sum("n").alias("weight"))
    hubs = held.join(weight, "r").groupBy("s").agg(F.max_by("r", F.struct("weight", "r")).alias("hub"))
    led = held.join(hubs, "s")
    pair = lambda lead: F.struct(F.least("r", lead).alias("a"), F.greatest("r", lead).alias("b"))
    pairs = materialise(led.select(F.explode(F.array(pair("low"), pair("hub"))).alias("p")).select("p.*").where("a < b").distinct())
    found = materialise(verify(pairs, docs).select("a", "b").distinct())
    return materialise(found.unionByName(cross(held, found, docs)).distinct())


def cross(held: DataFrame, found: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): similar texts that share a bucket and that the links found don't join; held is a table of (s, r, n), n the bucket's size.

    Buckets of one component have nothing to try. The members of any other are
    dealt to blocks of BLOCK on average, and each two blocks, or one with itself,
    are a group of rows for one task, so that a large bucket is many tasks.
    A group tries all its pairs of different components: their number grows with
    the square of the bucket where it holds many texts that aren't similar.
    """
    parts = components(found)
    named = materialise(held.join(parts, F.col("r") == F.col("node"), "left").select("s", "r", "n", F.coalesce("least", "r").alias("c")))
    mixed = named.groupBy("s").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("s")
    rest = named.join(mixed, "s").select("s", "r", "c", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rest = rest.withColumn("block", F.pmod(F.xxhash64("r"), "blocks").cast("int"))
    rest = materialise(rest.select("s", "r", "c", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")))
    groups = rest.select("s", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "r", "c")
    texts = prefilter(docs, "id", rest, "r").select(F.col("id").alias("r"), "text").dropDuplicates(["r"])
    return groups.join(texts, "r").repartition("s", "i", "j").sortWithinPartitions("s", "i", "j").select("s", "i", "j", "block", "r", "c", "text").mapInArrow(_cross, "a bigint, b bigint")


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of rows (s, i, j, block, r, c, text), those of a group in sequence."""

    def starts(rows: pa.RecordBatch) -> np.ndarray:
        keys = np.stack([rows.column(k).to_numpy() for k in "sij"])
        return np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1])

    def tried(rows: pa.RecordBatch, at: np.ndarray) -> pa.RecordBatch:
        """Links of whole groups, which start at `at`."""
        texts = rows.column("text").dictionary_encode()
        offsets, kmers = shingles(_Hashes(texts.dictionary))
        marks = np.unique(labelled(offsets, kmers), return_inverse=True)[1]
        which, r, c = texts.indices.to_numpy(), rows.column("r").to_numpy(), rows.column("c").to_numpy()
        block = np.where(rows.column("i").to_numpy() == rows.column("j").to_numpy(), -1, rows.column("block").to_numpy())
        found: list[tuple[int, int]] = []
        for start, stop in zip(at, [*at[1:], rows.num_rows], strict=True):
            mine = which[start:stop]
            found += [(r[start + x], r[start + y]) for x, y in _group([kmers[offsets[w] : offsets[w + 1]] for w in mine], [marks[offsets[w] : offsets[w + 1]] for w in mine], c[start:stop], block[start:stop])]
        ends = np.sort(np.array(found, np.int64).reshape(-1, 2), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    last = None
    for batch in batches:
        rows = batch if last is None else pa.concat_batches([last, batch])
        at = starts(rows) if rows.num_rows else np.zeros(1, np.int64)
        yield from _parts(rows.slice(0, at[-1]), at[:-1], tried)
        last = rows.slice(at[-1])
    if last is not None:
        yield from _parts(last, np.zeros(1, np.int64), tried)


def _parts(rows: pa.RecordBatch, at: np.ndarray, tried: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """tried(rows, starts) of runs of groups with about CROSS_BYTES of text."""
    if not rows.num_rows:
        return
    give_back()
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(rows.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    part = size[at] // CROSS_BYTES
    heads = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
    for one, end in zip(heads, [*heads[1:], len(at)], strict=True):
        stop = at[end] if end < len(at) else rows.num_rows
        yield tried(rows.slice(at[one], stop - at[one]), at[one:end] - at[one])


def _group(kmers: list[np.ndarray], marks: list[np.ndarray], label: np.ndarray, block: np.ndarray) -> list[tuple[int, int]]:
    """Links (x, y) of a group, after which each two members of it, of different blocks or of block -1, are joined or were compared.

    Equal labels are joined. The labelled k-mers that two texts share are at
    least as many as can be matched in order: pairs that they rule out need no
    alignment.
    """
    label = label.copy()
    names, counts = np.unique(label, return_counts=True)
    if len(names) < 2:
        return []
    size = np.array([len(k) for k in marks])
    vocabulary, flat = np.unique(np.concatenate(marks), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    inside = np.zeros(len(vocabulary), bool)
    listed: dict[int, list[int]] = {}
    runs = lambda y: listed[y] if y in listed else listed.setdefault(y, kmers[y].tolist())
    done = np.zeros(len(label), bool)
    out = []
    for x in np.flatnonzero(label != names[counts.argmax()]):
        done[x] = True
        open_ = ~done & (label != label[x]) & ((block == -1) | (block != block[x]))
        if not open_.any():
            continue
        inside[:] = False
        inside[flat[start[x] : start[x] + size[x]]] = True
        shared = np.add.reduceat(inside[flat], start, dtype=np.int64)
        for y in np.flatnonzero(open_ & (shared >= SIMILARITY * (size + size[x] - shared) - 1e-9)):
            if label[x] != label[y] and ordered_similarity(runs(x), runs(y)) >= SIMILARITY:
                out.append((x, y))
                label[label == label[y]] = label[x]
    return out


def _least_of_neighbours(edges: DataFrame) -> DataFrame:
    """(u, v, m): edges with m, the least v of u; a node of any number of edges is many tasks."""
    return join_hot(edges, materialise(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))), ["u"], count="n")


def components(edges: DataFrame) -> DataFrame:
    """(node, least) of each node of edges (a, b): the least node that it is linked to, by any number of steps.

    Large-star and small-star steps in turn until nothing changes; each halves
    the depth of what is left. Two sets of edges are taken for equal by their
    number and the sums of two hashes.
    """
    sign = lambda t: tuple(t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    edges = materialise(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct())
    before = sign(edges)
    while True:
        both = materialise(edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u"))))
        m = F.least("m", "u")
        large = materialise(_least_of_neighbours(both).where("v > u").select(F.col("v").alias("u"), m.alias("v")).where("u <> v").distinct())
        small = _least_of_neighbours(large).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = materialise(small.select("v", "u"))
        now = sign(after)
        discard(both, large, edges)
        if now == before:
            return after.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("node"), "least").unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("least")).distinct())
        edges, before = after, now


def classes(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(doc_id, class_id): a row for each distinct ident, classes of near-duplicates named by their least ident.

    Equal word sequences are one class: only the least ident of each is compared
    with others, and its class is joined to the rest afterwards. A text without
    words is a class by itself, and so are rows with a null ident, which have no
    row here; rows that share an ident share its class. Texts are compared whole,
    whatever their length; other columns of docs have no part. An empty table
    gives an empty one.
    """
    plain = docs.where(F.col(ident).isNotNull()).select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text"))
    signed = materialise(signatures(plain))
    heads = materialise(signed.groupBy("words").agg(F.min("id").alias("r"), F.count(F.lit(1)).alias("n")))
    named = materialise(signed.select("id", "words").distinct())
    of = materialise(join_hot(named, heads, ["words"], count="n").select("id", "r"))
    members = signed.join(heads.select(F.col("r").alias("id"), "words"), ["id", "words"]).select(F.col("id").alias("r"), F.explode("sketches").alias("s")).distinct()
    found = links(materialise(members), plain)
    # An ident of several texts links their heads.
    several = of.groupBy("id").agg(F.min("r").alias("a"), F.max("r").alias("z")).where("a < z").select("id", "a")
    found = found.unionByName(of.join(several, "id").where("r > a").select("a", F.col("r").alias("b")))
    parts = materialise(components(found))
    first = of.groupBy("id").agg(F.min("r").alias("node"))
    joined = join_hot(materialise(first), parts, ["node"], "left").select(F.col("id").alias("known"), F.coalesce("least", "node").alias("class_id"))
    every = plain.select("id").distinct()
    return every.join(joined, F.col("id") == F.col("known"), "left").select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"))


def representatives(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Rows of docs, one ident of each class; rows with a null ident stay."""
    (key,) = fresh(docs, "gone")
    gone = materialise(classes(docs, text, ident).where("doc_id <> class_id").select(F.col("doc_id").alias(key)))
    return docs.join(gone, F.col(ident) == F.col(key), "left_anti")
