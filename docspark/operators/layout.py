"""Page geometry: boxes, overlap, columns, reading order, segments, text rows.

Boxes are four columns l, t, r, b. Joins are by page first, so that a range or
nearest join compares the boxes of one page only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Thresholds here and below are fixed values.
#: Share of the page width from which a block counts as full width; width of a column, as a share.
FULL_WIDTH, COLUMN = 0.65, 0.18


def area(l: Column, t: Column, r: Column, b: Column) -> Column:  # noqa: E741
    return F.greatest(r - l, F.lit(0.0)) * F.greatest(b - t, F.lit(0.0))


def _shared(x: str, y: str) -> Column:
    c = lambda a, n: F.col(f"{a}.{n}")
    return area(F.greatest(c(x, "l"), c(y, "l")), F.greatest(c(x, "t"), c(y, "t")), F.least(c(x, "r"), c(y, "r")), F.least(c(x, "b"), c(y, "b")))


def _own(x: str) -> Column:
    return area(*(F.col(f"{x}.{n}") for n in "ltrb"))


def overlaps(x: str, y: str) -> Column:
    """Significant overlap of aliased frames x and y: 35 % of x's box or 65 % of y's.

    The share is a width's, times the height: at a tie the product's rounding decides, so its order is fixed.
    """
    s = _shared(x, y)
    c = lambda a, n: F.col(f"{a}.{n}")
    part = lambda a, share: share * F.greatest(c(a, "r") - c(a, "l"), F.lit(0.0)) * F.greatest(c(a, "b") - c(a, "t"), F.lit(0.0))
    return ((_own(x) > 0) & (s >= part(x, 0.35))) | ((_own(y) > 0) & (s >= part(y, 0.65)))


def intersects(x: str, y: str) -> Column:
    c = lambda a, n: F.col(f"{a}.{n}")
    return ~((c(x, "r") <= c(y, "l")) | (c(y, "r") <= c(x, "l")) | (c(x, "b") <= c(y, "t")) | (c(y, "b") <= c(x, "t")))


def without_overlap(boxes: DataFrame, others: DataFrame, page: list[str], test=overlaps) -> DataFrame:
    """Boxes that significantly overlap none of the others of their page."""
    on = [F.col(f"x.{p}").eqNullSafe(F.col(f"y.{p}")) for p in page]
    return boxes.alias("x").join(others.alias("y"), [*on, test("x", "y")], "left_anti")


def with_overlap(boxes: DataFrame, others: DataFrame, page: list[str], test=intersects) -> DataFrame:
    on = [F.col(f"x.{p}").eqNullSafe(F.col(f"y.{p}")) for p in page]
    return boxes.alias("x").join(others.alias("y"), [*on, test("x", "y")], "left_semi")


def retained(blocks: DataFrame, accepted: DataFrame, page: list[str]) -> DataFrame:
    """Blocks (kind, l, t, r, b) without the images whose box isn't among the accepted ones of their page."""
    keys = [*page, "l", "t", "r", "b"]
    images = blocks.where("kind = 'image'").join(accepted.select(*keys).distinct(), keys, "left_semi").select(*blocks.columns)
    return blocks.where(~F.col("kind").eqNullSafe("image")).unionByName(images)


def columns(regions: DataFrame, page: list[str], width: Column) -> DataFrame:
    """page, island, left, right, cut of the columns of a page: regions merged from the left, parted by gaps over 5 % of the width.

    cut is the middle of the gap to the next column, half-even, plus 2; null for
    the last.
    """
    w = Window.partitionBy(*page).orderBy("l", "r")
    r = regions.withColumn("wide", width).withColumn("reach", F.max("r").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    r = r.withColumn("new", F.when(F.col("reach").isNull() | (F.col("l") > F.col("reach") + 0.05 * F.col("wide")), 1).otherwise(0))
    r = r.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = r.groupBy(*page, "island").agg(F.min("l").alias("left"), F.max("r").alias("right"))
    return merged.withColumn("cut", F.bround((F.col("right") + F.lead("left").over(Window.partitionBy(*page).orderBy("island"))) / 2) + 2)


def reading_order(blocks: DataFrame, page: list[str], ident: str, width: Column) -> DataFrame:
    """blocks with band, column and place.

    A full-width block (65 % of the page) starts a band; blocks go by band, then
    column (full-width first), top, left, ident.
    """
    b = blocks.withColumn("full", (F.col("r") - F.col("l")) >= FULL_WIDTH * width)
    # Bands: full-width blocks whose bottom is at or above a block's top; counted over sorted bottoms, without a join: the blocks are rows among the bottoms.
    events = b.withColumns({"y": F.col("t"), "late": F.lit(1), "step": F.lit(0)}).unionByName(b.where("full").select(*page, F.col("b").alias("y"), F.lit(0).alias("late"), F.lit(1).alias("step")), allowMissingColumns=True)
    out = events.withColumn("band", F.sum("step").over(Window.partitionBy(*page).orderBy("y", "late").rowsBetween(Window.unboundedPreceding, 0))).where("late = 1").drop("y", "late", "step")
    column = F.when(F.col("full"), -1).otherwise(F.floor(F.col("l") / F.greatest(COLUMN * width, F.lit(1.0))).cast("int"))
    return out.withColumn("column", column).withColumn("place", F.row_number().over(Window.partitionBy(*page).orderBy("band", "column", "t", "l", ident))).drop("full")


def nearest_segment(points: DataFrame, segments: DataFrame, page: list[str], point: str, segment: str) -> DataFrame:
    """points (x, y) with seg: the first segment of the page that holds the point, else the nearest by the distances to its edges.

    A page without segments gives null. Each point keeps one candidate, as a
    minimum, so a page's pairs are never gathered; they are as many as the
    points times the segments of the page.
    """
    s = segments.select(*page, F.col(segment).alias("seg"), "l", "t", "r", "b")
    rest = [c for c in points.columns if c not in (*page, point)]
    away = lambda v, low, high: F.when(v < low, low - v).when(v > high, v - high).otherwise(0.0)
    x, y = F.col("x"), F.col("y")
    inside = (x >= F.col("l")) & (x <= F.col("r")) & (y >= F.col("t")) & (y <= F.col("b"))
    distance = away(x, F.col("l"), F.col("r")) + away(y, F.col("t"), F.col("b"))
    choice = F.struct((~inside).alias("out"), F.when(inside, 0.0).otherwise(distance).alias("far"), F.col("seg").alias("seg"))
    # Grouped by page and point, rows stay where the join by page has put them.
    return points.join(s, page, "left").groupBy(*page, point).agg(*(F.any_value(c).alias(c) for c in rest), F.min_by("seg", choice).alias("seg"))


def nearby_text(words: DataFrame, rects: DataFrame, page: list[str], rect: str, margin: float = 36.0) -> DataFrame:
    """rects with words, chars and cover: text of the page whose middle lies within margin of a rectangle, and the share of it that text covers."""
    w = words.select(*page, F.col("text"), ((F.col("l") + F.col("r")) / 2).alias("x"), ((F.col("t") + F.col("b")) / 2).alias("y"), area(*(F.col(n) for n in "ltrb")).alias("size"))
    near = (F.col("x") >= F.col("l") - margin) & (F.col("x") <= F.col("r") + margin) & (F.col("y") >= F.col("t") - margin) & (F.col("y") <= F.col("b") + margin)
    stats = rects.join(w, page).where(near).groupBy(*page, rect).agg(F.count(F.lit(1)).alias("words"), F.sum(F.length("text")).alias("chars"), F.sum("size").alias("covered"))
    out = rects.join(stats, [*page, rect], "left")
    return out.select(*rects.columns, F.coalesce("words", F.lit(0)).alias("words"), F.coalesce("chars", F.lit(0)).alias("chars"), F.coalesce(F.col("covered") / F.greatest(area(*(F.col(n) for n in "ltrb")), F.lit(1e-9)), F.lit(0.0)).alias("cover"))


def text_heavy(words: Column, chars: Column, cover: Column) -> Column:
    return (words >= 10) | ((words >= 4) & (chars >= 20) & (cover >= 0.035)) | ((words >= 2) & (chars >= 12) & (cover >= 0.12))


def keep_drawing(l: Column, t: Column, r: Column, b: Column, width: Column, height: Column) -> Column:  # noqa: E741
    """A vector drawing that is content by its size, shape and place."""
    w, h = r - l, b - t
    ratio = w / F.greatest(h, F.lit(1e-9))
    middle = (t + b) / 2
    return (w > 10) & (h > 10) & ratio.between(0.2, 12) & (w >= 0.035 * width) & (h >= 0.025 * height) & middle.between(0.05 * height, 0.95 * height) & (w <= 0.9 * width)


def is_canvas(l: Column, t: Column, r: Column, b: Column, width: Column, height: Column) -> Column:  # noqa: E741
    return area(l, t, r, b) > 0.8 * width * height


def padded(l: Column, t: Column, r: Column, b: Column, width: Column, height: Column) -> Column:  # noqa: E741
    """The box with 5 %, 10 at least, on each side, inside the page."""
    dx, dy = F.greatest(F.lit(10.0), 0.05 * (r - l)), F.greatest(F.lit(10.0), 0.05 * (b - t))
    return F.struct(F.greatest(l - dx, F.lit(0.0)).alias("l"), F.greatest(t - dy, F.lit(0.0)).alias("t"), F.least(r + dx, width).alias("r"), F.least(b + dy, height).alias("b"))


def tiled_pages(images: DataFrame, page: list[str], width: Column, height: Column) -> DataFrame:
    """page, tiled: six images or more that cover three quarters of the page."""
    return images.groupBy(*page).agg(F.count(F.lit(1)).alias("n"), F.sum(area(*(F.col(n) for n in "ltrb")) / (width * height)).alias("cover")).select(*page, ((F.col("n") >= 6) & (F.col("cover") >= 0.75)).alias("tiled"))


def merge_column_blocks(blocks: DataFrame, page: list[str], order: str, width: Column, height: Column, pad: float = 5.0) -> DataFrame:
    """page, n, l, t, r, b: neighbouring blocks of a column, in order, as one box with pad on each side, inside the page.

    A block joins the box before it if its sides are within a tenth of the page's
    width of that box's, and its top at most 20 above the box's bottom. The
    fold takes the blocks of one page; nulls in a box leave it out.
    """
    box = F.struct(F.col(order).alias("at"), *(F.col(c).cast("double").alias(c) for c in "ltrb"), width.cast("double").alias("w"), height.cast("double").alias("h"))
    g = blocks.where(" AND ".join(f"{c} IS NOT NULL" for c in "ltrb")).groupBy(*page).agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    kind = "struct<l:double,t:double,r:double,b:double,w:double,h:double>"
    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("last"))
    keep = lambda x: F.struct(*(x[c].alias(c) for c in "ltrbwh"))

    def step(acc, x):
        last = acc["last"]
        joins = (F.abs(x["l"] - last["l"]) < 0.1 * x["w"]) & (F.abs(x["r"] - last["r"]) < 0.1 * x["w"]) & (x["t"] >= last["b"] - 20)
        both = F.struct(F.least(x["l"], last["l"]).alias("l"), F.least(x["t"], last["t"]).alias("t"), F.greatest(x["r"], last["r"]).alias("r"), F.greatest(x["b"], last["b"]).alias("b"), last["w"].alias("w"), last["h"].alias("h"))
        fresh = F.struct(F.when(last.isNull(), acc["done"]).otherwise(F.array_append(acc["done"], last)).alias("done"), keep(x).alias("last"))
        return F.when(joins, F.struct(acc["done"].alias("done"), both.alias("last"))).otherwise(fresh)

    merged = F.aggregate("boxes", start, step, lambda acc: F.array_append(acc["done"], acc["last"]))
    wider = lambda x, i: F.struct(i.alias("n"), F.greatest(x["l"] - pad, F.lit(0.0)).alias("l"), F.greatest(x["t"] - pad, F.lit(0.0)).alias("t"), F.least(x["r"] + pad, x["w"]).alias("r"), F.least(x["b"] + pad, x["h"]).alias("b"))
    return g.select(*page, F.inline(F.transform(merged, wider)))


def near_groups(boxes: np.ndarray, gap: float = 30.0) -> np.ndarray:
    """Boxes (l, t, r, b) joined to their bounding box while two lie less than gap apart; from the top, then the left.

    Each round joins the groups of boxes that are near, through any number of
    others, so that rounds are few.
    """
    while True:
        l, t, r, b = boxes.T  # noqa: E741
        near = (l[:, None] < r + gap) & (l < r[:, None] + gap) & (t[:, None] < b + gap) & (t < b[:, None] + gap)
        group = np.arange(len(boxes))
        while True:
            least = np.array([group[row].min() for row in near], int)
            if (least == group).all():
                break
            group = least
        names = np.unique(group)
        if len(names) == len(boxes):
            return boxes[np.lexsort((boxes[:, 0], boxes[:, 1]))]
        boxes = np.array([[*boxes[group == k, :2].min(0), *boxes[group == k, 2:].max(0)] for k in names])


#: Boxes of a page up to which plain loops are faster than numpy.
FEW = 24


def few_near_groups(values: list[float], gap: float = 30.0) -> list[list[float]]:
    """near_groups of a few boxes, given as l, t, r, b in turn."""
    done: list[list[float]] = []
    for i in range(0, len(values), 4):
        l, t, r, b = values[i : i + 4]  # noqa: E741
        k = 0
        while k < len(done):
            x = done[k]
            if l < x[2] + gap and x[0] < r + gap and t < x[3] + gap and x[1] < b + gap:
                # The joined box may be near those that the box itself wasn't.
                l, t, r, b = min(l, x[0]), min(t, x[1]), max(r, x[2]), max(b, x[3])  # noqa: E741
                del done[k]
                k = 0
            else:
                k += 1
        done.append([l, t, r, b])
    return sorted(done, key=lambda x: (x[1], x[0]))


def merge_near(boxes: DataFrame, page: list[str], gap: float = 30.0) -> DataFrame:
    """page, n, l, t, r, b: near_groups of each page's boxes; the pairs of one page's boxes are formed in its task.

    Pages go to Python in batches, a row each.
    """

    @F.pandas_udf("array<array<double>>")
    def merge(pages: pd.Series) -> pd.Series:
        return pd.Series([few_near_groups(x.tolist(), gap) if len(x) <= 4 * FEW else near_groups(x.reshape(-1, 4), gap).tolist() for x in pages], dtype=object)

    good = boxes.where(" AND ".join(f"{c} IS NOT NULL" for c in "ltrb"))
    each = good.groupBy(*page).agg(F.collect_list(F.array(*(F.col(c).cast("double") for c in "ltrb"))).alias("boxes"))
    found = each.select(*page, merge(F.flatten("boxes")).alias("found")).select(*page, F.posexplode("found").alias("n", "box"))
    return found.select(*page, "n", *(F.col("box")[i].alias(c) for i, c in enumerate("ltrb")))


def _cuts(low: np.ndarray, high: np.ndarray, gap: float) -> np.ndarray:
    """Island of each interval; islands lie at least gap apart."""
    order = np.argsort(low, kind="stable")
    reach = np.concatenate([[-np.inf], np.maximum.accumulate(high[order])[:-1]])
    island = np.empty(len(low), int)
    island[order] = np.cumsum(low[order] - reach >= gap)
    return island


def xy_cut(boxes: np.ndarray, width: float) -> list[np.ndarray]:
    """Segments of a page, as index arrays in reading order: boxes parted by horizontal gaps of 15, then vertical ones of 5 % of the width (20 at least), in turn until none is left."""
    out, todo = [], [(np.arange(len(boxes)), True, False)]
    while todo:
        at, by_y, stuck = todo.pop()
        if len(at) < 2:
            out.append(at)
            continue
        low, high, gap = (boxes[at, 1], boxes[at, 3], 15.0) if by_y else (boxes[at, 0], boxes[at, 2], max(0.05 * width, 20.0))
        island = _cuts(low, high, gap)
        parts = [at[island == k] for k in np.unique(island)]
        if len(parts) == 1 and stuck:
            out.append(at)
        else:
            todo += [(p, not by_y, len(parts) == 1) for p in reversed(parts)]
    return out


def segments(blocks: DataFrame, page: list[str], width: str) -> DataFrame:
    """page, seg, l, t, r, b: bounding boxes of a page's segments, in reading order."""

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        boxes = pdf[["l", "t", "r", "b"]].to_numpy(float)
        parts = xy_cut(boxes, float(pdf[width].iloc[0]))
        rows = [[*pdf[page].iloc[0], k, *boxes[p, :2].min(0), *boxes[p, 2:].max(0)] for k, p in enumerate(parts)]
        return pd.DataFrame(rows, columns=[*page, "seg", "l", "t", "r", "b"])

    kinds = dict(blocks.dtypes)
    schema = ", ".join([*(f"`{p}` {kinds[p]}" for p in page), "seg int, l double, t double, r double, b double"])
    return blocks.select(*page, "l", "t", "r", "b", width).groupBy(*page).applyInPandas(cut, schema)


def text_rows(boxes: pd.DataFrame) -> list[list[int]]:
    """Rows of words, top-down, each left to right: a word joins the open row if it overlaps it by 35 % of the lower height, or its middle is near the row's."""
    height = (boxes["b"] - boxes["t"]).to_numpy()
    near = 0.65 * max(3.0, 0.5 * float(np.median(height))) if len(boxes) else 0.0
    middle = ((boxes["t"] + boxes["b"]) / 2).to_numpy()
    top, bottom, left = boxes["t"].to_numpy(), boxes["b"].to_numpy(), boxes["l"].to_numpy()
    rows: list[list[int]] = []
    for i in np.lexsort((left, middle)):
        if rows:
            row = rows[-1]
            t, b, m = top[row].mean(), bottom[row].mean(), middle[row].mean()
            share = (min(b, bottom[i]) - max(t, top[i])) / max(min(b - t, height[i]), 1e-9)
            if share >= 0.35 or abs(middle[i] - m) <= near:
                row.append(int(i))
                continue
        rows.append([int(i)])
    return [sorted(r, key=lambda i: left[i]) for r in rows]


def rows_of_text(words: DataFrame, page: list[str], threshold: float = 0.5) -> DataFrame:
    """page, text: words of confidence `threshold` or more, clustered into lines."""

    def read(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        text = "\n".join(" ".join(pdf["text"][i] for i in r) for r in text_rows(pdf))
        return pd.DataFrame([[*pdf[page].iloc[0], text]], columns=[*page, "text"])

    kinds = dict(words.dtypes)
    good = words.where((F.col("score") >= threshold) & (F.trim("text") != "")).select(*page, "text", "l", "t", "r", "b")
    return good.groupBy(*page).applyInPandas(read, ", ".join([*(f"`{p}` {kinds[p]}" for p in page), "text string"]))
