"""Chat formatting: tool calls linked to their results.

Calls and results are hash-joined by conversation and identifier, put in an order
in which each call follows the calls that it depends on, checked against JSON
schemas, and written as canonical JSON.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.llm.common import materialise

#: Schema of the columns that calls and results have.
CALLS = "conv_id bigint, call_id string, seq bigint, name string, arguments string, after array<string>"
RESULTS = "conv_id bigint, call_id string, seq bigint, content string"
#: Values of seq that one task ranks together.
RANKS = 4096


def canonical(value) -> str:
    """JSON with sorted keys, no white space, characters unescaped; not-a-number is an error."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)


def _is(kind: str, v) -> bool:
    if kind == "number":
        return isinstance(v, (int, float)) and not isinstance(v, bool)
    if kind == "integer":
        return not isinstance(v, bool) and (isinstance(v, int) or isinstance(v, float) and math.isfinite(v) and v == int(v))
    return isinstance(v, {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}[kind])


def violations(value, schema: dict, at: str = "$") -> Iterator[str]:
    """What a value breaks of a schema (type, enum, required, properties, additionalProperties, items, and bounds of numbers and lengths)."""
    kinds = schema.get("type")
    if kinds and not any(_is(k, value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        yield f"{at}:type"
        return
    if "enum" in schema and value not in schema["enum"]:
        yield f"{at}:enum"
    if _is("number", value):
        if value < schema.get("minimum", value):
            yield f"{at}:minimum"
        if value > schema.get("maximum", value):
            yield f"{at}:maximum"
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            yield f"{at}:minLength"
        if len(value) > schema.get("maxLength", len(value)):
            yield f"{at}:maxLength"
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            yield from violations(v, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for k in schema.get("required", ()):
            if k not in value:
                yield f"{at}.{k}:required"
        for k in sorted(value):
            if k in known:
                yield from violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                yield f"{at}.{k}:additional"


def _finite(digits: str) -> float:
    value = float(digits)
    if not math.isfinite(value):
        raise ValueError(digits)
    return value


def _refuse(constant: str):
    raise ValueError(constant)


def check_arguments(name: str | None, arguments: str | None, schemas: dict[str, dict]) -> tuple[list[str], object]:
    """(errors, arguments as a value) of one call.

    `$:json` stands for all that canonical JSON in UTF-8 can't hold: text that
    doesn't parse, numbers beyond a double, lone surrogates, nesting too deep.
    """
    if name not in schemas:
        return ["$:unknown_tool"], None
    try:
        value = json.loads(arguments if arguments is not None else "null", parse_constant=_refuse, parse_float=_finite)
        canonical(value).encode()
        return list(violations(value, schemas[name])), value
    except (ValueError, RecursionError):
        return ["$:json"], None


def kahn(ids: list[str], seqs: list[int], after: list[list[str]]) -> list[int | None]:
    """Place of each call in topological order, the earliest ready call first; None in a cycle or behind one."""
    at = {c: i for i, c in enumerate(ids)}
    needs = [{at[a] for a in before if a in at} for before in after]
    gives: list[list[int]] = [[] for _ in ids]
    for i, before in enumerate(needs):
        for a in before:
            gives[a].append(i)
    left = [len(n) for n in needs]
    ready = [(seqs[i], ids[i], i) for i in range(len(ids)) if not left[i]]
    heapq.heapify(ready)
    place: list[int | None] = [None] * len(ids)
    done = 0
    while ready:
        i = heapq.heappop(ready)[2]
        place[i] = done
        done += 1
        for g in gives[i]:
            left[g] -= 1
            if not left[g]:
                heapq.heappush(ready, (seqs[g], ids[g], g))
    return place


def _first(rows: DataFrame, key: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(first, others): of the rows with one key the least by columns, with n, their number; all other rows, those without a key among them.

    Rows are told apart by a number of their own, so that no task meets all rows of a key.
    """
    numbered = materialise(rows.withColumn("row", F.monotonically_increasing_id()))
    first = materialise(numbered.where(" AND ".join(f"{k} IS NOT NULL" for k in key)).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*columns, "row")).alias("x")).select(*key, "n", "x.*"))
    return first, numbered.join(first.select("row"), "row", "left_anti").drop("row")


def ranked(calls: DataFrame) -> DataFrame:
    """calls (conv_id, call_id, seq) with rank, the place from 0 by (seq, call_id) in the conversation; a null seq comes first.

    Counts of RANKS neighbouring values of seq are summed first, so that a
    conversation of any number of values is many tasks.
    """
    block = F.coalesce(F.floor(F.col("seq") / RANKS), F.lit(-(1 << 62)))
    cut = calls.select("conv_id", "call_id", "seq", block.alias("block"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("conv_id", "block").count().select("conv_id", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("seq", "call_id")) - 1
    return cut.withColumn("within", within).join(offsets, ["conv_id", "block"]).select("conv_id", "call_id", (F.col("within") + F.col("offset")).alias("rank"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], context: DataFrame | None = None) -> DataFrame:
    """conv_id, call_id, role, call_seq, result_seq, place, copies, n_results, status, errors, message.

    Every row of calls, results and context is in one row of the result. Calls
    and results of one identifier make one row, of role call: of several calls
    (results) the first by seq, then content, is linked, and copies (n_results)
    says how many there were; each of the others is a row of status extra_call
    (extra_result). The first call's status is linked, no_result, or cycle; a
    first result without a call is a row of role result and status no_call; rows
    without conv_id or call_id are linked to nothing (no_result, no_call); turns
    of context (conv_id, seq, role, content) are rows of status context.

    place numbers the first calls of a conversation from 0 so that each follows
    those in its `after` (identifiers that no call has are passed over); where
    all of these have smaller seq that is the order by seq, and only
    conversations that break this are sorted topologically, each in a task of its
    own, by identifiers and dependencies alone; place is null in a cycle and
    behind one, and for all other rows. message is canonical JSON of what the row
    holds, whatever its length. Empty tables give an empty one.
    """
    key = ["conv_id", "call_id"]
    listed = calls.select(*key, "seq", "name", "arguments", F.array_sort(F.array_distinct(F.coalesce("after", F.array().cast("array<string>")))).alias("after"))
    c, more_calls = _first(listed, key, ["seq", "name", "arguments", "after"])
    r, more_results = _first(results.select(*key, "seq", "content"), key, ["seq", "content"])
    needs = c.select("conv_id", F.col("call_id").alias("of"), F.col("seq").alias("of_seq"), F.explode("after").alias("call_id"))
    broken = materialise(needs.join(c.select(*key, "seq"), key).where("seq IS NULL OR of_seq IS NULL OR seq >= of_seq").select("conv_id").distinct())

    def order(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        place = kahn(rows["call_id"], [s if s is not None else -1 for s in rows["seq"]], [a or [] for a in rows["after"]])
        return table.select(["conv_id", "call_id"]).append_column("place", pa.array(place, pa.int64()))

    sorted_ = c.join(broken, "conv_id", "left_semi").select(*key, "seq", "after").groupBy("conv_id").applyInArrow(order, "conv_id bigint, call_id string, place bigint")
    plain = ranked(c.join(broken, "conv_id", "left_anti")).withColumnRenamed("rank", "place")
    placed = c.join(plain.unionByName(sorted_), key)
    one = placed.select(*key, F.lit("call").alias("role"), "seq", "place", F.col("n").alias("copies"), "name", "arguments", "after")
    two = r.select(*key, F.col("seq").alias("result_seq"), F.col("n").alias("n_results"), "content")
    status = F.when(F.col("role").isNull(), "no_call").when(F.col("place").isNull(), "cycle").when(F.col("n_results").isNull(), "no_result").otherwise("linked")
    rows = one.join(two, key, "full_outer").withColumn("status", status).withColumn("role", F.coalesce("role", F.lit("result")))
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    rows = rows.unionByName(more_calls.select(*key, F.lit("call").alias("role"), "seq", "name", "arguments", "after", F.when(known, "extra_call").otherwise("no_result").alias("status")), allowMissingColumns=True)
    rows = rows.unionByName(more_results.select(*key, F.lit("result").alias("role"), F.col("seq").alias("result_seq"), "content", F.when(known, "extra_result").otherwise("no_call").alias("status")), allowMissingColumns=True)
    if context is not None:
        rows = rows.unionByName(context.select("conv_id", F.col("seq").alias("result_seq"), "role", "content", F.lit("context").alias("status")), allowMissingColumns=True)
    copies = lambda n, role, none: F.coalesce(n, F.when((F.col("role") == role) & ~F.col("status").isin(none, "context"), 1).otherwise(0)).cast("long")
    rows = rows.select(*key, "role", F.col("seq").alias("call_seq"), "result_seq", "place", copies("copies", "call", "extra_call").alias("copies"), copies("n_results", "result", "extra_result").alias("n_results"), "status", "name", "arguments", "after", "content")
    kept = ["conv_id", "call_id", "role", "call_seq", "result_seq", "place", "copies", "n_results", "status"]
    out = "conv_id bigint, call_id string, role string, call_seq bigint, result_seq bigint, place bigint, copies bigint, n_results bigint, status string, errors string, message string"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors, messages = [], []
            for m in batch.to_pylist():
                called = m["role"] == "call" and m["status"] != "context"
                bad, value = check_arguments(m["name"], m["arguments"], schemas) if called else ([], None)
                errors.append(",".join(bad))
                call = {"id": m["call_id"], "name": m["name"], "arguments": value if value is not None or not bad else m["arguments"], "after": m["after"] or []} if called else None
                said = {"role": m["role"], "content": m["content"]} if m["status"] == "context" else {"call": call, "result": m["content"]}
                messages.append(canonical({"conversation": m["conv_id"], "status": m["status"], **said}))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(errors, pa.string()), pa.array(messages, pa.string())], [*kept, "errors", "message"])

    return rows.mapInArrow(write, out)


#: Tool that plain conversations are read as calls of.
REPLY = {"reply": {"type": "object", "required": ["prompt", "turn"], "additionalProperties": False, "properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": 4000}, "turn": {"type": "integer", "minimum": 0}}}}


#: A turn that makes tool calls, and one that brings a result, as JSON.
TURN = "tool_calls array<struct<id:string,name:string,arguments:string,after:array<string>>>, tool_call_id string, content string"


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, results, context) of conversations; each turn, whatever its columns beyond conv_id, turn, role and text, gives a row of one of them at least.

    A turn whose text is a JSON object with tool_calls (id, name, arguments as a
    JSON string, after) makes these calls; one with a tool_call_id brings its
    result. Of plain conversations a user's turn is a call of `reply`, which
    depends on the one two turns before, and the assistant's next turn its
    result. All other turns, those of a null or another role, are context.
    """
    ident = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    t = F.col("turn").cast("long")
    said = F.when(F.col("text").rlike(r'(?s)^\s*\{.*"tool_call(?:s|_id)"'), F.from_json("text", TURN))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), t.alias("seq"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), said.alias("said"))
    known = F.col("conv_id").isNotNull() & F.col("seq").isNotNull()
    kind = F.when(F.size("said.tool_calls") > 0, "calls").when(F.col("said.tool_call_id").isNotNull(), "result").when(F.col("role") == "user", "ask").when(F.col("role") == "assistant", "answer").otherwise("context")
    rows = rows.withColumn("kind", kind)
    none = F.array().cast("array<string>")
    asked = rows.where("kind = 'ask'").select("conv_id", F.when(known, ident(F.col("seq"))).alias("call_id"), "seq", F.lit("reply").alias("name"), F.to_json(F.struct(F.col("text").alias("prompt"), F.col("seq").alias("turn"))).alias("arguments"), F.when(known & (F.col("seq") >= 2), F.array(ident(F.col("seq") - 2))).otherwise(none).alias("after"))
    made = rows.where("kind = 'calls'").select("conv_id", "seq", F.explode("said.tool_calls").alias("c")).select("conv_id", F.col("c.id").alias("call_id"), "seq", "c.name", "c.arguments", F.coalesce("c.after", none).alias("after"))
    answered = rows.where("kind = 'answer'").select("conv_id", F.when(known, ident(F.col("seq") - 1)).alias("call_id"), "seq", F.col("text").alias("content"))
    brought = rows.where("kind = 'result'").select("conv_id", F.col("said.tool_call_id").alias("call_id"), "seq", F.col("said.content").alias("content"))
    return asked.unionByName(made), answered.unionByName(brought), rows.where("kind = 'context'").select("conv_id", "seq", "role", F.col("text").alias("content"))
