"""Readers of documents, page images, texts and reports. All go through Spark's own sources."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.operators.spelling import nfc

#: Columns of a page of a rendered document.
PAGES = "path string, page_num int, content binary, error string"
RENDERED = f"{PAGES}, seconds double"


def spread(table: DataFrame) -> DataFrame:
    """A table that is read in fewer tasks than there are cores, dealt over them all; any other as it is.

    Only small inputs, of few splits, are ever dealt anew.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def stem(path: Column) -> Column:
    """File name without folder and suffix, in canonical composition."""
    return nfc(F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", ""))


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """path, stem, content, length, modificationTime of a file, or of the PDF files of a folder (not below), by path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    return files.withColumn("stem", stem(F.col("path"))).orderBy("path")


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """path, stem, text of the Markdown files of a folder and below; one row a file."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("text")).withColumn("stem", stem(F.col("path")))


def page_images(spark: SparkSession, path: str) -> DataFrame:
    """path, page_num, image: page_N images in order of N."""
    raw = spark.read.format("image").option("pathGlobFilter", "page_*").load(path)
    return raw.select(F.col("image.origin").alias("path"), F.regexp_extract("image.origin", r"page_0*(\d+)\.[^./]*$", 1).try_cast("int").alias("page_num"), "image").orderBy("page_num")


def run_reports(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of CSV reports with the union of their columns, as strings."""
    frames = [spark.read.option("header", "true").csv(p) for p in paths]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def model_json(reply: Column, schema: T.StructType | str) -> Column:
    """A model's JSON reply, code fences aside; null where it doesn't parse."""
    return F.from_json(F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""), schema)


#: Categories of a graphic that a classifier may name (fixed values).
GRAPHICS = ("content_image", "logo", "signature", "stamp", "text_fragment", "decoration", "page_canvas", "uncertain")


def graphic_category(reply: Column) -> Column:
    """Struct (category, confidence) of a classifier's reply; uncertain, 0 where it is none."""
    x = model_json(reply, "category string, confidence double")
    good = x["category"].isin(*GRAPHICS) & x["confidence"].isNotNull()
    return F.struct(F.when(good, x["category"]).otherwise("uncertain").alias("category"), F.coalesce(F.when(good, x["confidence"]), F.lit(0.0)).alias("confidence"))


def discard_graphic(category: Column, confidence: Column) -> Column:
    """Signatures and stamps from 0.90, fragments, decoration and canvases from 0.95."""
    return (category.isin("signature", "stamp") & (confidence >= 0.90)) | (category.isin("text_fragment", "decoration", "page_canvas") & (confidence >= 0.95))


#: A renderer gives (page number from 1, image) of those pages of a file's content that it is asked to keep.
Renderer = Callable[[bytes, Callable[[int], bool]], Iterator[tuple[int, bytes]]]


def render(files: DataFrame, renderer: Renderer, wanted: DataFrame | None = None, done: DataFrame | None = None) -> DataFrame:
    """RENDERED pages of each file; a file that fails gives one row with the error.

    wanted (path, page_num) names the pages to render, and files without any
    aren't opened; done (path, page_num) names pages that are there already. The
    renderer asks before each page, so none is rendered to be dropped. seconds is
    the time that a page took.
    """
    pages = lambda t, name: t.groupBy("path").agg(F.collect_set(F.col("page_num").cast("int")).alias(name))
    none = F.lit(None).cast("array<int>")
    rows = files.select("path", "content")
    rows = rows.withColumn("asked", none) if wanted is None else rows.join(pages(wanted, "asked"), "path")
    rows = rows.withColumn("skipped", none) if done is None else rows.join(pages(done, "skipped"), "path", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = lambda *row: pd.DataFrame([row], columns=["path", "page_num", "content", "error", "seconds"])
        for batch in batches:
            for path, content, asked, skipped in batch.itertuples(index=False):
                asked, skipped = None if asked is None else set(asked), set() if skipped is None else set(skipped)
                keep = lambda n, a=asked, s=skipped: (a is None or n in a) and n not in s
                try:
                    start = time.perf_counter()
                    for n, image in renderer(content, keep):
                        yield one(path, n, image, None, time.perf_counter() - start)
                        start = time.perf_counter()
                except Exception as e:  # noqa: BLE001  a broken file is a row, not the end of the job
                    yield one(path, None, None, str(e), None)

    return rows.select("path", "content", "asked", "skipped").mapInPandas(run, RENDERED)


def page_counts(files: DataFrame, counter: Callable[[bytes], int]) -> DataFrame:
    """path, pages, error of each file, by a function that counts the pages of a content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.append([path, counter(content), None])
                except Exception as e:  # noqa: BLE001
                    rows.append([path, None, str(e)])
            yield pd.DataFrame(rows, columns=["path", "pages", "error"]).astype({"pages": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, pages int, error string")


def usable_native_text(text: Column) -> Column:
    """A text layer of 40 characters and eight words or more."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return (F.length(flat) >= 40) & (F.size(F.split(flat, " ")) >= 8)
