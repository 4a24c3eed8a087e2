"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LIBC = ctypes.CDLL(None)
#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Python batches are cut into slices of about so many bytes of text.
SLICE_BYTES = 2 << 20
#: Used only where the session names no checkpoint folder (tests, single machine).
LOCAL_CHECKPOINTS = "/tmp/checkpoints/docspark"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a local one on a single machine, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found or LOCAL_CHECKPOINTS


def materialise(df: DataFrame) -> DataFrame:
    """df, written once as a Parquet table in the shared folder and read back.

    Cuts lineage so that later passes neither recompute df nor depend on the
    executors that made it: a lost executor loses nothing. The table goes when
    the application ends, or before that by discard().
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/docspark-tables/{uuid.uuid4().hex}"
    folder, system = _file_system(spark, path)
    system.deleteOnExit(folder)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._docspark_path = path
    return table


def _file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that materialise() made and that nothing reads any more."""
    for table in tables:
        folder, system = _file_system(table.sparkSession, table._docspark_path)
        system.delete(folder, True)


#: Keys that join_hot() may broadcast: no more can hold over a HOT_KEYS-th of the rows each.
HOT_KEYS = 4096


def join_hot(rows: DataFrame, found: DataFrame, keys: list[str], how: str = "inner", count: str | None = None) -> DataFrame:
    """rows joined with found, which has one row for each value of keys, whatever share of rows one value has.

    A value that more than a HOT_KEYS-th of the rows have is joined by broadcast
    (there are fewer than HOT_KEYS of them, so found must be narrow); all others
    by a shuffle on the keys. count is a column of found that says how many rows a
    value has, or more; it is counted where left out. `how` is inner, left or
    left_semi. Null keys join nothing. Both are read twice or more: they should be
    tables.
    """
    hot, here = fresh(rows.join(found.limit(0), keys), "is_hot", "is_here")
    rest = [c for c in found.columns if c not in keys]
    if count:
        total = found.agg(F.sum(count)).first()[0] or 0
        few = found.where(F.col(count) > total / HOT_KEYS).withColumns({hot: F.lit(True), here: F.lit(True)})
    else:
        total = rows.count()
        frequent = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(hot)).where(F.col(hot) > total / HOT_KEYS).select(*keys, F.lit(True).alias(hot))
        few = frequent.join(found.withColumn(here, F.lit(True)), keys, "left")
    marked = rows.join(F.broadcast(materialise(few)), keys, "left")
    kept = [*rows.columns, *(rest if how != "left_semi" else [])]
    by_broadcast = marked.where(F.col(hot) if how == "left" else F.col(hot) & F.col(here)).select(*kept)
    by_shuffle = marked.where(F.col(hot).isNull()).select(*rows.columns).join(found, keys, how).select(*kept)
    return by_broadcast.unionByName(by_shuffle)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that clash with no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shards_for(rows: int, per_shard: int) -> int:
    """Number of hash shards that keeps about per_shard rows in each."""
    return max(1, math.ceil(rows / per_shard))


def word_count(text: Column) -> Column:
    """Number of words; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def give_back() -> None:
    """Return freed memory of Arrow and the C library to the system: Python workers live on over stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """Cut a batch so that column holds about `most` bytes in each part."""
    give_back()
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = 0
    part = np.cumsum(size) // most
    for cut in [*(np.flatnonzero(part[1:] != part[:-1]) + 1), len(size)]:
        if cut > start:
            yield batch.slice(start, cut - start)
        start = cut


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets, words): the words of text i are words[offsets[i]:offsets[i+1]]."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    flat = lists.flatten()
    counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    filled = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not filled.all():
        doc = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(doc[filled], minlength=len(counts))
        flat = flat.filter(pa.array(filled))
    return np.concatenate([[0], np.cumsum(counts)]), flat


#: Slots of the hashed id set that prefilters a table before a shuffle.
SLOTS = 1 << 20


def prefilter(docs: DataFrame, ident: str, ids: DataFrame, of: str) -> DataFrame:
    """Rows of docs whose ident may be among ids: all that are, and few others.

    The set is broadcast as at most SLOTS hashed slots, whatever the size of ids;
    where most slots are taken it lets more rows by, which costs time only.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    slots = ids.select(slot(F.col(of)).alias("slot_of_ids")).distinct()
    return docs.join(F.broadcast(slots), slot(F.col(ident)) == F.col("slot_of_ids"), "left_semi")
