"""Tables in page text: pipe rows, repair, continuation across pages, HTML structure."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docspark.functions import htmltables
from docspark.functions.markup import html_rows, is_separator, split_row
from docspark.functions.text import strip
from docspark.operators.lines import _upto


def pipe_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, block, ln, cells, naive_width, is_rule: the pipe rows of line rows; block numbers the runs of neighbouring ones."""
    w = Window.partitionBy(*keys).orderBy("ln")
    x = strip(F.col("line"))
    r = rows.withColumn("row", (x.startswith("|") & x.endswith("|") & (F.length(x) > 1)).cast("int"))
    r = r.withColumn("new", ((F.col("row") == 1) & (F.coalesce(F.lag("row").over(w), F.lit(0)) == 0)).cast("int")).withColumn("block", F.sum("new").over(_upto(w)))
    cells = split_row(F.col("line"))
    return r.where("row = 1").select(*keys, "block", "ln", "line", cells.alias("cells"), (F.regexp_count(x, F.lit(r"\|")) - 1).alias("naive_width"), is_separator(cells).alias("is_rule"))


def repairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each block of pipe_rows whose second row is its only rule: first, last, broken, text.

    broken: cell counts differ; such a table's text is HTML, any other's its own lines.
    """
    g = rows.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct("ln", "cells", "line", "is_rule"))).alias("r"))
    rules = F.filter("r", lambda x: x["is_rule"])
    second = F.get("r", F.lit(1))
    tables = g.where((F.size("r") >= 2) & (F.size(rules) == 1) & second["is_rule"])
    broken = F.size(F.array_distinct(F.transform("r", lambda x: F.size(x["cells"])))) > 1
    data = F.transform(F.filter("r", lambda x: ~x["is_rule"]), lambda x: x["cells"])
    return tables.select(*keys, "block", F.get("r", F.lit(0))["ln"].alias("first"), F.element_at("r", -1)["ln"].alias("last"), broken.alias("broken"), F.when(broken, html_rows(data)).otherwise(F.array_join(F.transform("r", lambda x: x["line"]), "\n")).alias("text"))


def order_key(cell: Column) -> Column:
    """Struct (kind, rank) of a row's ordering cell: number, letter, or roman of two letters or more; null if it is none."""
    token = F.regexp_replace(strip(F.regexp_replace(cell, r"<[^>]+>|[*_`]", "")), r"[.):-]+$", "")
    values = F.create_map(*(F.lit(x) for p in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in p))
    digits = F.transform(F.split(F.upper(token), ""), lambda ch: F.element_at(values, ch))
    roman = F.aggregate(F.reverse(digits), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("top")), lambda a, v: F.struct((a["sum"] + F.when(v < a["top"], -v).otherwise(v)).alias("sum"), F.greatest(a["top"], v).alias("top")), lambda a: a["sum"])
    made = lambda kind, rank: F.struct(F.lit(kind).alias("kind"), rank.cast("long").alias("rank"))
    return F.when(token.rlike(r"^\d{1,18}$"), made("number", token.try_cast("long"))).when(token.rlike("^[A-Za-z]$"), made("letter", F.ascii(F.lower(token)))).when(token.rlike("^(?i)[IVXLCDM]{2,}$"), made("roman", roman))


def continuations(fragments: DataFrame, keys: list[str], order: str) -> DataFrame:
    """fragments (header and rows as arrays of cells, header null if it has none) with continues.

    A fragment continues the one before it in its document if the headers are
    equal, if it has none and as many columns, or if its header is a data row:
    the row's order key follows the last key of the fragment before.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    width = F.size(F.coalesce(F.col("header"), F.get("rows", F.lit(0))))
    last_key = order_key(F.get(F.element_at("rows", -1), F.lit(0)))
    first_key = order_key(F.get(F.coalesce(F.col("header"), F.get("rows", F.lit(0))), F.lit(0)))
    r = fragments.withColumns({"width": width, "last_key": last_key, "first_key": first_key})
    before = lambda c: F.lag(c).over(w)
    same = F.col("header").eqNullSafe(before("header")) & F.col("header").isNotNull()
    bare = F.col("header").isNull() & (F.col("width") == before("width"))
    follows = (F.col("first_key.kind") == before("last_key.kind")) & (F.col("first_key.rank") == before("last_key.rank") + 1) & (F.col("width") == before("width"))
    return r.withColumn("continues", F.coalesce(same, F.lit(False)) | F.coalesce(bare, F.lit(False)) | F.coalesce(follows, F.lit(False))).drop("width", "last_key", "first_key")


def merge_fragments(fragments: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One table for each run of continuations: keys, first (order of its first fragment), header, rows."""
    w = Window.partitionBy(*keys).orderBy(order)
    r = continuations(fragments, keys, order).withColumn("table", F.sum((~F.col("continues")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # A continuation's header that repeats the table's isn't a row; one that doesn't, is.
    r = r.withColumn("lead", F.first("header").over(Window.partitionBy(*keys, "table").orderBy(order)))
    body = F.when(F.col("continues") & F.col("header").isNotNull() & ~F.col("header").eqNullSafe(F.col("lead")), F.concat(F.array("header"), "rows")).otherwise(F.col("rows"))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), body.alias("rows"))))
    return r.groupBy(*keys, "table").agg(F.min(order).alias("first"), F.min_by("header", order).alias("header"), F.flatten(F.transform(parts, lambda x: x["rows"])).alias("rows")).drop("table")


@F.pandas_udf(T.ArrayType(T.StringType()))
def html_structure(texts: pd.Series) -> pd.Series:
    return texts.map(htmltables.structure_errors)


@F.pandas_udf(T.StringType())
def html_to_pipes(texts: pd.Series) -> pd.Series:
    return texts.map(htmltables.simple_to_pipes)


@F.pandas_udf(T.StringType())
def join_tables(texts: pd.Series) -> pd.Series:
    return texts.map(htmltables.joined)
