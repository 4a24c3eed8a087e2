"""Streams: quality of arriving pages, progress events in windows, assets seen before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from docspark.operators import quality


def arriving(spark: SparkSession, path: str, schema: StructType | str, files: int = 64) -> DataFrame:
    """Rows of Parquet files as they arrive in a folder, or at the places of a pattern; at most so many files in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def page_reports(pages: DataFrame, text: str = "text") -> DataFrame:
    """The quality report of each arriving page: a projection, without state."""
    return quality.report(pages, text)


def progress(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by window and kind; events later than `late` are dropped, and their windows closed."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")


def new_assets(assets: DataFrame, time: str = "ts", content: str = "content", late: str = "1 hour") -> DataFrame:
    """Assets whose content didn't come before, within `late`."""
    return assets.withColumn("digest", F.sha2(F.col(content), 256)).withWatermark(time, late).dropDuplicatesWithinWatermark(["digest"])


def write(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that is there now, as Parquet; a restart goes on where it ended, each row once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
