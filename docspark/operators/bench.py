"""Summaries of benchmark runs and resource samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import scoring

#: Seconds a page over which a configuration is out.
LIMIT = 120


def summary(runs: DataFrame, key: str = "config") -> DataFrame:
    """A row for each configuration: means over the runs that are OK (0 if none is), peaks and sums over all, disqualified."""
    ok = F.col("status") == "OK"
    mean = lambda c: F.coalesce(F.avg(F.when(ok, F.col(c))), F.lit(0.0)).alias(f"{c}_avg")
    bad = ~ok | (F.col("cuda_oom_count") > 0) | (F.col("seconds_per_page") > LIMIT)
    return runs.groupBy(key).agg(
        F.bool_or(bad).alias("disqualified"), mean("seconds_per_page"), mean("quality_score"), F.coalesce(F.max("vram_mb_peak"), F.lit(0.0)).alias("vram_mb_peak"),
        F.sum("retry_count").alias("retry_total"), F.sum("timeout_count").alias("timeout_total"), F.sum("cuda_oom_count").alias("cuda_oom_total"),
    )


def cold_warm(runs: DataFrame, key: str, value: str) -> DataFrame:
    """Mean of the first run and of the others, nulls aside."""
    return runs.groupBy(key).agg(F.avg(F.when(F.col("run") == 1, F.col(value))).alias("cold"), F.avg(F.when(F.col("run") > 1, F.col(value))).alias("warm"))


def sample_stats(samples: DataFrame, key: str, value: str) -> DataFrame:
    """Mean and peak of resource samples; 0 where there are none."""
    return samples.groupBy(key).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("avg"), F.coalesce(F.max(value), F.lit(0.0)).alias("peak"))


def best_resolution(trials: Column) -> Column:
    """Of an array of (dpi, score, seconds) by dpi: one that scores over 0.2 better takes the lead, and so does one within 0.2 in under 85 % of the time."""
    def step(best, x):
        better = (x["score"] > best["score"] + 0.2) | ((F.abs(x["score"] - best["score"]) <= 0.2) & (x["seconds"] < 0.85 * best["seconds"]))
        return F.when(better, x).otherwise(best)

    rows = F.array_sort(trials)
    return F.when(F.size(trials) > 0, F.aggregate(rows, F.get(rows, F.lit(0)), step)["dpi"])


def log_counts(log: Column) -> Column:
    """Retries, timeouts and memory failures that a log names."""
    low = F.lower(log)
    n = lambda p: F.regexp_count(low, F.lit(p)).cast("long")
    return F.struct(n("retry").alias("retries"), n("timeout").alias("timeouts"), n("out of memory").alias("out_of_memory"))


def markdown_table(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """One text: the rows as a pipe table in order. For reports, whose rows are few."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |"))
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n"
    return rows.agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), line.alias("line")))), lambda x: x["line"]), "\n")).alias("report"))


def elapsed(seconds: Column) -> Column:
    """hh:mm:ss of a number of seconds."""
    s = F.greatest(F.floor(seconds), F.lit(0))
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def progress(done: Column, total: Column) -> Column:
    """Per cent of recognition, 90 at most; 0 of no pages."""
    return F.when(total > 0, F.least(F.lit(90.0), done / total * 90)).otherwise(0.0)


def against_truth(outputs: DataFrame, truth: DataFrame, on: str = "stem", text: str = "text") -> DataFrame:
    """outputs with the scores of their text against the true text of the same name; null scores where there is none."""
    known = truth.select(on, F.col(text).alias("true_text"))
    scored = F.when(F.col("true_text").isNotNull(), scoring.scores(F.col("true_text"), F.col(text)))
    return outputs.join(known, on, "left").withColumn("scores", scored).drop("true_text")
