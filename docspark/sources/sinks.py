"""Sinks: one Markdown file for each document, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_markdown(docs: DataFrame, path: str, stem: str = "stem", text: str = "text") -> None:
    """A folder stem=... with one Markdown file for each document.

    The files are staged beside path and take its place by rename once all are
    written; if the job fails, what was there stays. Works on any file system
    that Spark writes to.
    """
    spark = docs.sparkSession
    jvm = spark._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    base, mark = path.rstrip("/"), uuid.uuid4().hex
    staged, old = f"{base}.{mark}.tmp", f"{base}.{mark}.old"
    rows = docs.select(F.col(stem).alias("stem"), F.col(text).alias("value"))
    fs = at(base).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        rows.repartition("stem").write.partitionBy("stem").option("lineSep", "\n").text(staged)
        had = fs.exists(at(base))
        if had and not fs.rename(at(base), at(old)):
            raise OSError(f"can't move {base} aside")
        if not fs.rename(at(staged), at(base)):
            if had:
                fs.rename(at(old), at(base))
            raise OSError(f"can't move the new files to {base}")
        if had:
            fs.delete(at(old), True)
    finally:
        if fs.exists(at(staged)):
            fs.delete(at(staged), True)


def write_report(rows: DataFrame, path: str) -> None:
    """Rows as CSV with a header under path/csv, and as JSON under path/json."""
    rows.write.mode("overwrite").option("header", "true").csv(f"{path}/csv")
    rows.write.mode("overwrite").json(f"{path}/json")


def write_lexicon(lexicon: tuple[DataFrame, DataFrame, DataFrame], path: str) -> None:
    """Words, accent candidates and bigrams of a lexicon as JSON lines of one object under path, as load_lexicon() reads them.

    A lexicon is of one language: its entries fit one row.
    """
    words, accents, bigrams = lexicon
    one = words.agg(F.sort_array(F.collect_set("w")).alias("words"))
    two = accents.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("plain", "forms")))).alias("accent_candidates"))
    three = bigrams.agg(F.sort_array(F.collect_set(F.concat_ws(" ", "left", "right"))).alias("bigrams"))
    one.join(two).join(three).coalesce(1).write.mode("overwrite").json(path)
