"""Exact dedup with a cuckoo-filter index.

Each shard of the digest space has a cuckoo filter over its live digests beside
a table of their content. Rows stream through the index of their shard: a filter
hit is checked against the stored content of its bucket; a row that a larger
ident supersedes is deleted from the index and the new one inserted; a filter
that overflows is rebuilt at twice the size from the stored keys. Memory holds
the live texts of a shard, never the copies that pass by.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import fresh, join_hot, materialise, shards_for, slices

SLOTS = 4
MAX_KICKS = 200
#: Bytes of the corpus to one shard, each row counted with ROW_BYTES beside its text.
SHARD_BYTES = 24 << 20
ROW_BYTES = 256
#: Text among which copies are combined before the shuffle.
LOCAL_BYTES = 16 << 20


class CuckooFilter:
    """Set of 16-bit fingerprints, two candidate buckets of four slots for each key."""

    def __init__(self, capacity: int):
        buckets = 2
        while buckets * SLOTS * 0.9 < capacity:
            buckets *= 2
        self.mask = buckets - 1
        self.table = array("H", bytes(2 * buckets * SLOTS))

    @staticmethod
    def _key(digest: bytes) -> tuple[int, int]:
        return int.from_bytes(digest[8:16], "big"), 1 + int.from_bytes(digest[16:18], "big") % 65535

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def _slot(self, bucket: int, mark: int) -> int:
        for i in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if self.table[i] == mark:
                return i
        return -1

    def __contains__(self, digest: bytes) -> bool:
        h, mark = self._key(digest)
        b = h & self.mask
        return self._slot(b, mark) >= 0 or self._slot(self._other(b, mark), mark) >= 0

    def insert(self, digest: bytes) -> bool:
        """False if the filter overflows; what it held may then be incomplete."""
        h, mark = self._key(digest)
        b = h & self.mask
        for b in (b, self._other(b, mark)):
            if (i := self._slot(b, 0)) >= 0:
                self.table[i] = mark
                return True
        for kick in range(MAX_KICKS):
            i = b * SLOTS + (kick + mark) % SLOTS
            self.table[i], mark = mark, self.table[i]
            b = self._other(b, mark)
            if (i := self._slot(b, 0)) >= 0:
                self.table[i] = mark
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        h, mark = self._key(digest)
        b = h & self.mask
        for b in (b, self._other(b, mark)):
            if (i := self._slot(b, mark)) >= 0:
                self.table[i] = 0
                return True
        return False


class CuckooIndex:
    """Live texts of one shard: a cuckoo filter, verified against bucketed content."""

    def __init__(self, capacity: int = 8):
        self.filter = CuckooFilter(capacity)
        self.buckets: dict[int, list[list]] = {}
        self.live = self.resized = self.false_hits = 0

    def _find(self, digest: bytes, text: str | None) -> list | None:
        if digest not in self.filter:
            return None
        for entry in self.buckets.get(int.from_bytes(digest[8:16], "big"), ()):
            if entry[0] == digest and entry[1] == text:
                return entry
        self.false_hits += 1
        return None

    def __contains__(self, key: tuple[bytes, str | None]) -> bool:
        return self._find(*key) is not None

    def add(self, digest: bytes, text: str | None, row: int, ident: int | None, n: int = 1) -> list:
        """Insert a live text, or add n copies to it; a row of larger ident takes the place of the live one."""
        entry = self._find(digest, text)
        if entry is not None:
            entry[4] += n
            if ident is None or entry[3] is not None and ident <= entry[3]:
                return entry
            n = entry[4]
            self.remove(digest, text)
        entry = [digest, text, row, ident, n]
        self.buckets.setdefault(int.from_bytes(digest[8:16], "big"), []).append(entry)
        self.live += 1
        if not self.filter.insert(digest):
            self._resize()
        return entry

    def remove(self, digest: bytes, text: str | None) -> bool:
        """Take a live text out of the index; False if it isn't there."""
        entry = self._find(digest, text)
        if entry is None:
            return False
        key = int.from_bytes(digest[8:16], "big")
        self.buckets[key].remove(entry)
        if not self.buckets[key]:
            del self.buckets[key]
        self.live -= 1
        return self.filter.delete(digest)

    def entries(self) -> Iterator[list]:
        for bucket in self.buckets.values():
            yield from bucket

    def _resize(self) -> None:
        capacity = 2 * SLOTS * (self.filter.mask + 1)
        while True:
            self.filter = CuckooFilter(capacity)
            self.resized += 1
            if all(self.filter.insert(e[0]) for e in self.entries()):
                return
            capacity *= 2


def survivors(docs: DataFrame, text: str = "text", ident: str = "doc_id", columns: list[str] | None = None) -> DataFrame:
    """One row for each distinct text: the row with the largest ident.

    Returns the given columns of that row (default all), digest (SHA-256, binary)
    and group_size; the last two get other names if docs has such columns. Every
    LOCAL_BYTES of text keep one row for each of their texts before the shuffle,
    so of a group of copies of any size few rows reach its shard, and there they
    stream through the index. Shards are as many as the bytes of all texts ask
    for. A null text equals the empty one; a null ident is below every other; of
    rows with the same ident and text any one stays; an empty table gives an
    empty one.
    """
    columns = docs.columns if columns is None else columns
    digest, size, shard, body = fresh(docs, "digest", "group_size", "shard", "body")
    whole = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES)).first()[0]
    n_shards = shards_for(whole or 0, SHARD_BYTES)
    kept = T.StructType([docs.schema[c] for c in columns])
    out = T.StructType([*kept.fields, T.StructField(digest, T.BinaryType()), T.StructField(size, T.LongType())])
    #: Content travels in a column of its own unless it is returned anyway.
    moved = T.StructType([*out.fields, T.StructField(shard, T.LongType()), T.StructField(ident if ident not in columns else f"{shard}_id", T.LongType())])
    key = moved.fields[-1].name
    if text not in columns:
        moved = moved.add(body, T.StringType())
    names = moved.fieldNames()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text, LOCAL_BYTES):
                best: dict[bytes, list] = {}
                ids = batch.column(ident).to_pylist()
                for i, t in enumerate(batch.column(text).to_pylist()):
                    d = hashlib.sha256((t or "").encode()).digest()
                    e = best.get(d)
                    if e is None:
                        best[d] = [i, 1]
                    else:
                        e[1] += 1
                        if ids[i] is not None and (ids[e[0]] is None or ids[i] > ids[e[0]]):
                            e[0] = i
                take = batch.take(pa.array([e[0] for e in best.values()], pa.int64()))
                arrays = [take.column(c) for c in columns]
                arrays += [pa.array(list(best), pa.binary()), pa.array([e[1] for e in best.values()], pa.int64())]
                arrays += [pa.array([int.from_bytes(d[:8], "big") % n_shards for d in best], pa.int64()), take.column(ident).cast(pa.int64())]
                if text not in columns:
                    arrays.append(take.column(text))
                yield pa.RecordBatch.from_arrays(arrays, names)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come shard by shard; a shard's live rows leave when the next begins."""
        at, found, held = None, CuckooIndex(), _Held([*columns, digest], size)
        for whole in batches:
            for batch in slices(whole, text if text in columns else body):
                ids, sizes = batch.column(key).to_pylist(), batch.column(size).to_pylist()
                texts, digests, marks = batch.column(text if text in columns else body).to_pylist(), batch.column(digest).to_pylist(), batch.column(shard).to_pylist()
                first = held.add(batch)
                for i, mark in enumerate(marks):
                    if mark != at:
                        yield from held.rows(found)
                        at, found = mark, CuckooIndex()
                        first = held.clear(batch)
                    found.add(digests[i], texts[i] or "", first + i, ids[i], sizes[i])
                held.compact(found)
        yield from held.rows(found)

    need = list(dict.fromkeys([*columns, text, ident]))
    return docs.select(*need).mapInArrow(local, moved).repartition(shard).sortWithinPartitions(shard).mapInArrow(index, out)


class _Held:
    """Batches that hold the live rows of an index; a row's number counts through them."""

    def __init__(self, columns: list[str], size: str):
        self.columns, self.size = columns, size
        self.batches: list[pa.RecordBatch] = []
        self.end = self.bytes = self.most = 0

    def add(self, batch: pa.RecordBatch) -> int:
        """Number of the batch's first row."""
        self.batches.append(batch)
        self.end += batch.num_rows
        self.bytes += batch.nbytes
        return self.end - batch.num_rows

    def clear(self, batch: pa.RecordBatch) -> int:
        """Holds this batch alone."""
        self.batches, self.end, self.bytes = [], 0, 0
        first = self.add(batch)
        self.most = 2 * self.bytes + LOCAL_BYTES
        return first

    def _taken(self, entries: list[list]) -> pa.RecordBatch:
        table = pa.Table.from_batches(self.batches)
        return table.take(pa.array([e[2] for e in entries], pa.int64())).combine_chunks().to_batches()[0]

    def compact(self, index: CuckooIndex) -> None:
        """Lets go of superseded rows and copies once the batches are twice what was live before, and LOCAL_BYTES."""
        if self.bytes <= self.most:
            return
        entries = list(index.entries())
        rows = self._taken(entries)
        self.clear(rows)
        for i, e in enumerate(entries):
            e[2] = i

    def rows(self, index: CuckooIndex) -> Iterator[pa.RecordBatch]:
        """The live rows, with the sizes of their groups."""
        entries = list(index.entries())
        if not entries:
            return
        rows = self._taken(entries)
        yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in self.columns), pa.array([e[4] for e in entries], pa.int64())], [*self.columns, self.size])


def memberships(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Exactly one row of a group is kept, the one with the largest ident; of rows
    that repeat ident and text too, one. Nulls, long texts and empty tables are
    as in survivors(); other columns of docs, whatever their names, have no part.
    """
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("text_sha256"))
    plain = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"))
    keep = materialise(survivors(plain, columns=["doc_id"]).select(F.col("doc_id").alias("keep_id"), F.lower(F.hex("digest")).alias("text_sha256"), "group_size"))
    counted = materialise(rows.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")))
    return (
        join_hot(counted, keep, ["text_sha256"], count="group_size")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")
    )
