"""Linking of tool calls and their results in conversations.

Calls and results meet in a hash join on (conversation, call id). Calls are ordered so that each
comes after those it depends on. Nearly always the order of turns does that already, which one join
verifies; conversations where it doesn't are ordered inside a task each, or, where one is too large
for a task, in rounds that place the calls whose dependencies are all placed. Positions are counted over a range-sorted table, so that one very long
conversation is spread over tasks. Arguments are validated against JSON schemas, and linked calls
are written as canonical JSON: sorted keys, no spaces, UTF-8.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>"
RESULTS = "conv_id long, turn long, call_id string, content string"
#: Conversations of at most this many calls and dependencies are ordered inside one task.
TASK_CALLS = 100_000
#: Arguments nested deeper than this are no valid arguments.
MAX_DEPTH = 64
_TYPES = {"string": (str,), "boolean": (bool,), "object": (dict,), "array": (list,), "null": (type(None),), "number": (int, float), "integer": (int, float)}


def _number(text: str) -> int | float:
    """A JSON number with a fraction or exponent; one that a double can't hold is refused."""
    value = float(text)
    if not math.isfinite(value):
        raise ValueError(f"{text} is out of range")
    return int(value) if value == int(value) and abs(value) < 2**53 else value


def _refuse(text: str):
    raise ValueError(f"{text} is no JSON")


def _deep(value, depth: int) -> bool:
    if not isinstance(value, (dict, list)):
        return False
    return depth == 0 or any(_deep(v, depth - 1) for v in (value.values() if isinstance(value, dict) else value))


def parse(text: str | None):
    """JSON as Python holds it; ValueError for what is no JSON, not finite or too deeply nested."""
    try:
        value = json.loads(text or "", parse_float=_number, parse_constant=_refuse)
    except RecursionError:
        raise ValueError("nested too deeply") from None
    if _deep(value, MAX_DEPTH):
        raise ValueError("nested too deeply")
    return value


def canonical(value) -> str:
    """Sorted keys, no spaces, whole numbers without a fraction; half surrogate pairs stay escaped."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def check_schema(schema: dict) -> None:
    """ValueError for a schema with an unknown type."""
    kinds = schema.get("type", [])
    for kind in [kinds] if isinstance(kinds, str) else kinds:
        if kind not in _TYPES:
            raise ValueError(f"unknown type {kind!r}")
    for part in [*schema.get("properties", {}).values(), *([schema["items"]] if "items" in schema else [])]:
        check_schema(part)


def _is(value, kind: str) -> bool:
    if kind in ("number", "integer") and isinstance(value, bool):
        return False
    return isinstance(value, _TYPES[kind]) and (kind != "integer" or value == int(value))


def _same(a, b) -> bool:
    """Equality of JSON values: true is not 1, but 1.0 is."""
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(v, b[k]) for k, v in a.items())
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    return isinstance(a, bool) == isinstance(b, bool) and a == b


def valid(value, schema: dict) -> bool:
    """Whether a value fits a schema of: type (one or several), enum, properties, required, additionalProperties, items."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return False
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]):
        return False
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if any(k not in value for k in schema.get("required", ())) or schema.get("additionalProperties") is False and any(k not in known for k in value):
            return False
        return all(valid(v, known[k]) for k, v in value.items() if k in known)
    return all(valid(v, schema["items"]) for v in value) if isinstance(value, list) and "items" in schema else True


def _written(schemas: dict):
    names = ["conv_id", "turn", "call_id", "position", "linked", "valid", "json"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits, lines = [], []
            for row in batch.to_pylist():
                try:
                    arguments = parse(row["arguments"])
                    fits.append(row["name"] in schemas and valid(arguments, schemas[row["name"]]))
                except ValueError:
                    arguments = row["arguments"]
                    fits.append(False)
                said = {"arguments": arguments, "depends_on": row["depends_on"] or [], "id": row["call_id"], "name": row["name"], "result": row["content"], "turn": row["turn"]}
                lines.append(canonical(said))
            linked = pa.array([t is not None for t in batch.column("result_turn").to_pylist()])
            columns = [batch.column(n) for n in names[:4]]
            yield pa.RecordBatch.from_arrays([*columns, linked, pa.array(fits, pa.bool_()), pa.array(lines, pa.string())], names)

    return run


def levels_of(nodes: set, needs: list[tuple]) -> dict:
    """The level of each node: one more than the highest it needs (pairs of node and needed); none on or behind a cycle."""
    left, after, level = dict.fromkeys(nodes, 0), {}, {}
    for node, needed in set(needs):
        left[node] += 1
        after.setdefault(needed, []).append(node)
    ready = [n for n, open_needs in left.items() if not open_needs]
    at = 0
    while ready:
        following = []
        for n in ready:
            level[n] = at
            for m in after.get(n, ()):
                left[m] -= 1
                if not left[m]:
                    following.append(m)
        ready, at = following, at + 1
    return level


def _levels_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Levels of the calls of whole conversations, sorted by conversation; a null ``needed`` is the call alone."""

    def done():
        level = levels_of(nodes, needs)
        ids = sorted(level)
        return pa.RecordBatch.from_arrays([pa.array([now] * len(ids), pa.int64()), pa.array(ids, pa.string()), pa.array([level[i] for i in ids], pa.int32())], ["conv_id", "call_id", "level"])

    now, nodes, needs = None, set(), []
    for batch in batches:
        for conv, call, needed in zip(*(c.to_pylist() for c in batch.columns)):
            if conv != now and nodes:
                yield done()
                nodes, needs = set(), []
            now = conv
            nodes.add(call)
            if needed is not None:
                needs.append((call, needed))
    if nodes:
        yield done()


def _levels_in_rounds(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """As :func:`levels_of`, for conversations that fit no task: one round of joins for each level."""
    placed = None
    left = common.materialize(calls.select("conv_id", "call_id").distinct(), "unplaced")
    needs = needs.select("conv_id", F.col("call_id").alias("of"), F.col("needed"))
    level = 0
    while not left.isEmpty():
        open_needs = needs.join(left.select("conv_id", F.col("call_id").alias("needed")), ["conv_id", "needed"]).select("conv_id", F.col("of").alias("call_id")).distinct()
        ready = common.materialize(left.join(open_needs, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(level)), "ready")
        if ready.isEmpty():
            break
        placed = ready if placed is None else placed.unionByName(ready)
        left = common.materialize(left.join(ready, ["conv_id", "call_id"], "left_anti"), "unplaced")
        level += 1
    return placed if placed is not None else left.withColumn("level", F.lit(0))


def _levels(calls: DataFrame, needs: DataFrame, task_calls: int) -> DataFrame:
    """``(conv_id, call_id, level)`` of calls in conversations whose turns don't follow the dependencies.

    A call's level is one more than the highest it depends on; calls of a cycle get none.
    """
    rows = calls.filter("call_id is not null").select("conv_id", "call_id", F.lit(None).cast("string").alias("needed"))
    rows = common.materialize(rows.unionByName(needs.select("conv_id", "call_id", "needed")).distinct(), "late-calls")
    giant = rows.groupBy("conv_id").agg(F.count("*").alias("n")).filter(F.col("n") > task_calls).select(F.col("conv_id").alias("gc"))
    giant = common.materialize(giant, "giant-conversations")
    small = rows.join(giant, F.col("conv_id") == F.col("gc"), "left_anti").repartition("conv_id").sortWithinPartitions("conv_id")
    levels = small.mapInArrow(_levels_in_task, "conv_id long, call_id string, level int")
    if giant.isEmpty():
        return levels
    rest = rows.join(giant, F.col("conv_id") == F.col("gc"), "left_semi")
    return levels.unionByName(_levels_in_rounds(rest, rest.filter("needed is not null")))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict, *, task_calls: int = TASK_CALLS) -> DataFrame:
    """``conv_id, turn, call_id, position, linked, valid, json`` of each row of ``calls``.

    ``calls`` and ``results`` have the columns of ``CALLS`` and ``RESULTS``. A call's result is the
    earliest with its id in the conversation. Calls that repeat an id share it; a null id or
    conversation is never linked and has no dependencies. Dependencies on ids that no call has are
    ignored. ``position`` counts from 0 in an order in which each call follows its dependencies, by
    turn and id where they leave a choice; it is null for calls of a cycle and what depends on them.
    Unknown tools and arguments that are no JSON or don't fit are not ``valid``; arguments that are
    no JSON, hold numbers beyond a double, or are nested deeper than ``MAX_DEPTH`` are written as a
    string. Very long arguments and contents are written whole. A schema with an unknown type is a
    ValueError. Other columns are not read. Empty tables give no rows.
    """
    for schema in schemas.values():
        check_schema(schema)
    common.ship(calls.sparkSession)
    calls = common.materialize(calls.select(*[c.split()[0] for c in CALLS.split(", ")]), "calls")
    first = results.filter("call_id is not null").groupBy("conv_id", "call_id").agg(F.min_by(F.struct("turn", "content"), F.struct("turn", "content")).alias("r"))
    first = first.select(F.col("conv_id").alias("rc"), F.col("call_id").alias("ri"), F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"))

    known = calls.groupBy("conv_id", "call_id").agg(F.min("turn").alias("needed_turn")).select(F.col("conv_id").alias("kc"), F.col("call_id").alias("needed"), "needed_turn")
    needs = calls.filter("call_id is not null").select("conv_id", "call_id", "turn", F.explode("depends_on").alias("needed"))
    needs = needs.join(known.withColumnRenamed("needed", "ki"), (F.col("conv_id") == F.col("kc")) & (F.col("needed") == F.col("ki"))).drop("kc", "ki")
    late = needs.filter(F.struct("needed_turn", "needed") >= F.struct("turn", "call_id")).select("conv_id").distinct()
    late = common.materialize(late, "late").withColumnRenamed("conv_id", "lc")
    if late.isEmpty():
        ordered = calls.withColumn("level", F.lit(0))
    else:
        odd = calls.join(late, F.col("conv_id") == F.col("lc"), "left_semi")
        levels = _levels(odd, needs.join(late, F.col("conv_id") == F.col("lc"), "left_semi"), task_calls)
        ordered = calls.join(late, F.col("conv_id") == F.col("lc"), "left_anti").withColumn("level", F.lit(0))
        ordered = ordered.unionByName(odd.join(levels, ["conv_id", "call_id"], "left").select(*ordered.columns))

    order = ("conv_id", F.col("level").asc_nulls_last(), "turn", "call_id", "arguments")
    ranged = ordered.repartitionByRange(*order).sortWithinPartitions(*order)
    own = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(F.col("level").asc_nulls_last(), "turn", "call_id", "arguments")) - 1
    placed = common.materialize(ranged.withColumn("part", F.spark_partition_id()), "ordered-calls")
    sizes = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    spans = sizes.groupBy("conv_id").agg(F.count("*").alias("parts")).filter("parts > 1").select(F.col("conv_id").alias("sc"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.join(spans, F.col("conv_id").eqNullSafe(F.col("sc"))).select("sc", F.col("part").alias("sp"), before.alias("before"))
    rows = placed.withColumn("own", own).join(offsets, F.col("conv_id").eqNullSafe(F.col("sc")) & (F.col("part") == F.col("sp")), "left")
    rows = rows.withColumn("position", F.when(F.col("level").isNotNull(), F.coalesce("before", F.lit(0)) + F.col("own")))
    rows = rows.join(first, (F.col("conv_id") == F.col("rc")) & (F.col("call_id") == F.col("ri")), "left")
    rows = rows.select("conv_id", "turn", "call_id", "position", "name", "arguments", "depends_on", "content", "result_turn")
    return rows.mapInArrow(_written(schemas), "conv_id long, turn long, call_id string, position long, linked boolean, valid boolean, json string")


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """User turns as calls of a tool ``ask`` and assistant turns as their results.

    A user turn is the call ``conversation:turn``; it depends on the one two turns before, and the
    assistant's next turn is its result. Rows without conversation or turn are left out, and so are
    turns of other roles (system) and assistant turns without a user turn right before them.
    """
    rows = conversations.filter("conv_id is not null and turn is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", common.text_or_empty().alias("text"))
    call = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    calls = rows.filter("role = 'user'").select(
        "conv_id",
        "turn",
        call(F.col("turn")).alias("call_id"),
        F.lit("ask").alias("name"),
        F.to_json(F.struct(F.col("text").alias("prompt"))).alias("arguments"),
        F.when(F.col("turn") >= 2, F.array(call(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    results = rows.filter("role = 'assistant'").select("conv_id", "turn", call(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


ASK = {"ask": {"type": "object", "properties": {"prompt": {"type": "string"}}, "required": ["prompt"], "additionalProperties": False}}


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(*turns_as_calls(common.table(spark, sf_dir, "conversations")), ASK)


OP9_SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, conv_id || ':' || turn, text) - 1 AS position FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, turn, min(coalesce(text, '')) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id, turn)
SELECT c.conv_id, c.turn, c.conv_id || ':' || c.turn AS call_id, c.position, r.turn IS NOT NULL AS linked, true AS valid,
       '{"arguments":{"prompt":' || CAST(to_json(c.text) AS VARCHAR) || '},"depends_on":[' || CASE WHEN c.turn >= 2 THEN '"' || c.conv_id || ':' || (c.turn - 2) || '"' ELSE '' END
       || '],"id":"' || c.conv_id || ':' || c.turn || '","name":"ask","result":' || coalesce(CAST(to_json(r.text) AS VARCHAR), 'null') || ',"turn":' || c.turn || '}' AS json
FROM c LEFT JOIN r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1
"""
