"""Mixing sources to target weights by weighted fair queueing.

Every source queues its documents in shuffled order; a document's virtual finish
time is its source's tokens up to its end, divided by the source's target. The
queue goes round again for a source whose target exceeds its size. All sources'
documents are merged by finish time and cut at the total budget. Prefix sums run
in two levels, blocks of documents and sums of blocks, so that no task holds a
whole source. The global order is a range partition by time: sums of short spans
of time tell in which span the budget ends, and only that span is sorted, to find
the last place that the mix takes. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.llm.common import fresh, materialise, shards_for, word_count

WEIGHTS = (3, 1, 2)
#: Total of the mix, as a multiple of all sizes.
SHARE = 1.5
#: Most passes over a document.
REPEATS = 2
#: Documents to a block of the prefix sums.
BLOCK = 4096


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target; of a table of (source, source_size), a row a source.

    Sources by code point, null last, take the weights in turn. A target is
    min(repeats x size, level x weight): level is where the targets add up to the
    budget, which is what resharing the excess until none is above comes to. The
    windows here have a row for each source.
    """
    ordered = sizes.withColumn("at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), ((F.col("at") - 1) % len(weights) + 1).cast("int"))
    capped = ordered.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * repeats)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "at")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # The first source in order of ratio that its level doesn't fill, sets the level of all after it.
    open_level = F.when(level * F.col("weight") <= F.col("cap"), level)
    first = F.first(open_level, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, 0))
    filled = capped.withColumn("level", first)
    return filled.select("source", "source_size", F.coalesce(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")), F.col("cap").cast("double")).alias("target"))


def _queue(rows: DataFrame, goal: DataFrame, n: int) -> DataFrame:
    """rows (doc_id, source, size, copies, spot, load) with source_size, target and served, the load of the source in order of spot up to the row.

    A block is a range of spot, a task holds whole blocks, of all sources: its
    size doesn't depend on how the rows are dealt among sources. The load before
    a block stands at its head as a row of its own, so nothing is joined to rows.
    """
    cut = rows.withColumn("block", F.floor(F.conv(F.substring("spot", 1, 8), 16, 10).cast("long") * n / F.lit(1 << 32)))
    sums = cut.groupBy("source", "block").agg(F.sum("load").alias("block_load"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    g = goal.select(F.col("source").alias("source_of"), "source_size", "target")
    heads = sums.withColumn("load", F.coalesce(F.sum("block_load").over(before), F.lit(0))).join(g, F.col("source").eqNullSafe(F.col("source_of")))
    both = heads.select("source", "block", "load", "source_size", "target", F.lit(0).alias("rank")).unionByName(cut.withColumn("rank", F.lit(1)), allowMissingColumns=True)
    upto = Window.partitionBy("source", "block").orderBy("rank", "spot", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    summed = both.repartition("block").withColumn("served", F.sum("load").over(upto))
    for name in ("source_size", "target"):
        summed = summed.withColumn(name, F.first(name).over(upto))
    return summed.where("rank = 1").select(*rows.columns, "source_size", "target", "served")


def mix(docs: DataFrame, text: str = "text", ident: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """A row for each row of docs: doc_id, source, size, source_size, target, taken.

    size counts words (null text: 0); a null source is a source of its own, last
    in order; rows that agree in doc_id, source and size are one place in the
    queue and are taken alike. Documents are taken whole, so a source comes
    within the size of a document of its target; a document without words is
    taken, as nothing, always (taken 0). Order in a source is by the MD5 of
    doc_id, then doc_id and size: the same on each run. Texts of any length are
    counted whole; other columns of docs, whatever their names, have no part. An
    empty table gives an empty one.
    """
    rows = materialise(
        docs.select(F.col(ident).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
        .groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("spot", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
        .withColumn("load", F.col("size") * F.col("copies"))
    )
    goal = materialise(targets(rows.groupBy("source").agg(F.sum("load").alias("source_size")), weights, share, repeats))
    n = shards_for(rows.count(), BLOCK)
    queue = materialise(_queue(rows, goal, n))

    def place(turn: Column) -> Column:
        """Where a row stands in the order of the whole mix, in its turn-th round."""
        finish = (F.col("served") + turn * F.col("source_size")) / F.col("target")
        # The span of time; the last one, which is never sorted, takes all that finishes after it begins.
        span = F.floor(F.least(finish, F.lit(float(repeats))) * n)
        return F.struct(span.alias("span"), finish.alias("finish"), F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("source"), F.col("spot").alias("spot"), F.col("doc_id").alias("doc_id"), F.col("size").alias("size"), turn.cast("int").alias("turn"))

    turns = F.array(*(F.lit(r) for r in range(repeats)))
    placed = queue.where("load > 0").select("load", F.explode(F.transform(turns, place)).alias("place"))
    # Half a word of slack: targets are doubles and may add up to just under the budget.
    budget = goal.agg((F.sum("target") + 0.5).alias("budget"))
    spans = placed.groupBy("place.span").agg(F.sum("load").alias("span_load"))
    spans = spans.withColumn("passed", F.sum("span_load").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, 0)))
    edge = materialise(spans.join(F.broadcast(budget), F.col("passed") > F.col("budget")).agg(F.min_by(F.struct("span", (F.col("passed") - F.col("span_load")).alias("before"), "budget"), "span").alias("edge")).select("edge.*"))
    last = placed.join(F.broadcast(edge), F.col("place.span") == F.col("span")).withColumn("passed", F.col("before") + F.sum("load").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    # One row: the span in which the budget ends, null if it doesn't, and the last place taken in it, null if none is.
    cut = edge.agg(F.first("span").alias("span")).crossJoin(last.where("passed <= budget").agg(F.max("place").alias("last")))
    within = lambda p: F.col("span").isNull() | (p["span"] < F.col("span")) | F.coalesce((p["span"] == F.col("span")) & (p <= F.col("last")), F.lit(False))
    times = F.when(F.col("load") > 0, F.size(F.filter(F.transform(turns, place), within))).otherwise(0)
    taken = queue.join(F.broadcast(materialise(cut))).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"), "copies")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copy", "copies")


def mixed(docs: DataFrame, decisions: DataFrame, text: str = "text", ident: str = "doc_id", source: str = "source") -> DataFrame:
    """The rows of docs as often as the mix takes them; decisions is mix() of docs. Documents without words stay, once."""
    size, times, d, s, z = fresh(docs, "size", "times", "d", "s", "z")
    taken = decisions.groupBy(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("size").alias(z)).agg(F.max("taken").alias(times))
    rows = docs.withColumn(size, word_count(F.col(text)))
    joined = rows.join(taken, rows[ident].eqNullSafe(taken[d]) & rows[source].eqNullSafe(taken[s]) & (rows[size] == taken[z]))
    count = F.when(F.col(size) > 0, F.col(times) / F.greatest(F.col(size), F.lit(1))).otherwise(1).cast("int")
    return joined.where(count > 0).withColumn(z, F.explode(F.sequence(F.lit(1), count))).select(*docs.columns)
