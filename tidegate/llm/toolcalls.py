"""Tool-call linking for chat transcripts.

Calls and results meet in a hash join on the call identifier.  Calls are put in topological
order: a call comes after every call it names in ``after``.  Arguments are checked against
the schema of their tool, and each linked call is written as canonical JSON (sorted keys, no
blanks, no escapes beyond JSON's own).

Order at scale: transcripts are nearly always written in a valid order, so the order key of a
call is its position raised to the latest position among the calls before it, and only what
changes is recomputed; a transcript in order needs no round.  Ranks come from counts per
(conversation, slice) and a rank inside the slice, so a conversation that holds a third of
all rows is not sorted in one task.

Defined cases: a repeated call id keeps its first call, the others are reported as duplicates;
of several results the first counts; a null id cannot be linked; a missing dependency, broken
JSON or a schema violation is an error of the call, which is kept; calls in or behind a cycle
have no step; results without a call are returned with a null name; empty tables give no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tidegate.llm.common import table
from tidegate.llm.registry import query
from tidegate.session import stage_table

SLICE = 512
KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}


def violations(value, schema: dict, at: str = "") -> list[str]:
    """Where a value breaks a schema (type, enum, minimum, maximum, required, properties, items, additionalProperties)."""
    out, kind = [], schema.get("type")
    if kind:
        fits = isinstance(value, KINDS[kind]) and not (isinstance(value, bool) and kind in ("integer", "number"))
        if not fits:
            return [f"{at or '/'}: not {kind}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at or '/'}: not one of the allowed values")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            out.append(f"{at}: below {schema['minimum']}")
        if value > schema.get("maximum", value):
            out.append(f"{at}: above {schema['maximum']}")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}/{k}: missing" for k in schema.get("required", ()) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{at}/{k}: unknown" for k in sorted(value) if k not in known]
        for k in sorted(known.keys() & value.keys()):
            out += violations(value[k], known[k], f"{at}/{k}")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}/{i}")
    return out


def constant(name: str):
    raise ValueError(f"{name} is not JSON")


def parsed(text: str | None):
    """The value of JSON arguments and what is wrong with them (the value is then null)."""
    try:
        value = json.loads(text or "", parse_constant=constant)
        canonical(value)
    except RecursionError:
        return None, "arguments: nested too deeply"
    except ValueError:  # no JSON, or a number beyond the range of a double
        return None, "arguments: not JSON"
    return value, None


def writable(text: str) -> str:
    """The text with lone surrogates, which UTF-8 cannot hold, as JSON escapes."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    return writable(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """calls (conv_id, call_id, name, arguments, position, after) with the first result of each, and results without a call."""
    calls = calls.select("conv_id", "call_id", "name", "arguments", "position", "after")
    # the same id may be repeated without bound: the first is found by a grouped minimum, not by a window over the id
    first = calls.where("call_id IS NOT NULL").groupBy("call_id").agg(
        F.min(F.struct(F.col("position").isNull(), "position", "conv_id", F.xxhash64("name", "arguments").alias("tie"))).alias("first"))
    met = calls.withColumn("tie", F.xxhash64("name", "arguments")).join(first, "call_id", "left").withColumn(
        "original", F.col("call_id").isNotNull() & F.col("position").eqNullSafe(F.col("first.position"))
        & F.col("conv_id").eqNullSafe(F.col("first.conv_id")) & (F.col("tie") == F.col("first.tie")))
    answer = results.where("call_id IS NOT NULL").groupBy("call_id").agg(
        F.min(F.struct(F.col("position").isNull(), "position", "content")).alias("answer"), F.count("*").alias("n_results"))
    full = met.drop("first", "tie").join(answer, "call_id", "left")
    orphans = (answer.join(first.select("call_id"), "call_id", "left_anti").select(
        F.lit(None).cast("long").alias("conv_id"), "call_id", F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("arguments"), F.col("answer.position").alias("position"),
        F.lit(None).cast("array<string>").alias("after"), F.lit(False).alias("original"), "answer", "n_results"))
    unlinked = results.where("call_id IS NULL").select(
        F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("string").alias("call_id"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), "position",
        F.lit(None).cast("array<string>").alias("after"), F.lit(False).alias("original"),
        F.struct(F.col("position").isNull().alias("col1"), "position", "content").alias("answer"), F.lit(1).cast("long").alias("n_results"))
    return full.unionByName(orphans.select(full.columns)).unionByName(unlinked.select(full.columns))


def order_keys(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, late, hops, missing, stuck) of the distinct calls; (late, hops, position, call_id) orders a conversation."""
    nodes = calls.where("original").select("conv_id", "call_id", F.coalesce("position", F.lit(0)).cast("long").alias("position"), "after")
    nodes = nodes.dropDuplicates(["conv_id", "call_id"])  # the same row may be given twice
    edges = nodes.select("conv_id", "call_id", F.explode(F.array_distinct("after")).alias("before"))
    known = nodes.select("conv_id", F.col("call_id").alias("before"), F.col("position").alias("at"))
    state = nodes.select("conv_id", "call_id", "position", F.col("position").alias("late"), F.lit(0).cast("long").alias("hops"))
    lost = edges.join(known, ["conv_id", "before"], "left_anti").groupBy("call_id").agg(F.sort_array(F.collect_set("before")).alias("missing"))
    links = edges.join(known, ["conv_id", "before"]).join(nodes.select("call_id", "position"), "call_id")
    backward = links.where("at >= position").select("conv_id").distinct()
    stuck = None
    if not backward.isEmpty():
        # only conversations with a call before what it needs; each round is written, since plans would grow with the rounds
        links = stage_table(links.join(backward, "conv_id", "left_semi").select("call_id", "before"), "links")
        moving = stage_table(state.join(backward, "conv_id", "left_semi"), "order")
        bound = moving.count()
        for k in range(bound + 1):
            above = (links.join(moving.select(F.col("call_id").alias("before"), "late", "hops"), "before")
                     .groupBy("call_id").agg(F.max(F.struct("late", F.expr("hops + 1").alias("hops"))).alias("top")))
            after = moving.join(above, "call_id", "left").select(
                "conv_id", "call_id", "position", F.greatest("late", F.col("top.late")).alias("late"),
                F.when(F.col("top.late") > F.col("late"), F.col("top.hops"))
                .when(F.col("top.late") == F.col("late"), F.greatest("hops", F.col("top.hops"))).otherwise(F.col("hops")).alias("hops"),
                (F.greatest("late", F.col("top.late")) > F.col("late"))
                .__or__((F.col("top.late") == F.col("late")) & (F.col("top.hops") > F.col("hops"))).alias("moved"))
            after = stage_table(after, "order")
            changed = after.where("moved")
            if changed.isEmpty():
                moving = after.drop("moved")
                break
            # hops beyond the number of calls sharing a key can only come from a cycle
            shared = after.groupBy("conv_id", "late").count()
            circling = after.join(shared, ["conv_id", "late"]).where("hops > count").select("call_id").distinct()
            if not circling.isEmpty():
                stuck = stage_table(circling if stuck is None else stuck.union(circling).distinct(), "stuck")
                dead = reach(links, stuck)
                stuck = dead
                after = stage_table(after.join(dead, "call_id", "left_anti"), "order")
                links = stage_table(links.join(dead, "call_id", "left_anti"), "links")
            moving = after.drop("moved")
        state = state.join(backward, "conv_id", "left_anti").unionByName(moving)
    out = nodes.select("conv_id", "call_id", "position").join(state.select("call_id", "late", "hops"), "call_id", "left").join(lost, "call_id", "left")
    return out.withColumn("stuck", F.col("late").isNull())


def reach(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """The seeds and every call behind them."""
    found, frontier = seeds, seeds
    while True:
        step = links.join(frontier.withColumnRenamed("call_id", "before"), "before").select("call_id").distinct().join(found, "call_id", "left_anti")
        frontier = stage_table(step, "reach")
        if frontier.isEmpty():
            return found
        found = stage_table(found.union(frontier).distinct(), "reach")


def steps(keys: DataFrame) -> DataFrame:
    """The rank of every ordered call in its conversation, from slice counts and ranks inside slices."""
    keys = keys.where("NOT stuck").withColumn("slice", F.floor(F.col("late") / SLICE))
    before = W.partitionBy("conv_id").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    ahead = keys.groupBy("conv_id", "slice").count().select(
        "conv_id", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    inside = F.row_number().over(W.partitionBy("conv_id", "slice").orderBy("late", "hops", "position", "call_id"))
    ranked = keys.withColumn("inside", inside)
    return ranked.alias("r").join(
        ahead.alias("a"), F.expr("r.conv_id <=> a.conv_id AND r.slice = a.slice")).select("r.call_id", F.expr("CAST(ahead + inside AS BIGINT)").alias("step"))


def serialise(linked: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Validated calls as canonical JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, errors, records = [], [], []
            for r in batch.to_pylist():
                bad, arguments = list(r["problems"] or []), None
                if r["name"] is None:
                    bad.append("no call")
                else:
                    arguments, wrong = parsed(r["arguments"])
                    if wrong:
                        bad.append(wrong)
                    else:
                        schema = schemas.get(r["name"])
                        bad += ["unknown tool"] if schema is None else violations(arguments, schema)
                valid.append(not bad)
                errors.append([writable(x) for x in bad])
                records.append(canonical({
                    "arguments": arguments, "call_id": r["call_id"], "errors": bad, "name": r["name"], "result": r["content"], "step": r["step"]}))
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c) for c in ("conv_id", "call_id", "step", "n_results")], pa.array(valid, pa.bool_()),
                pa.array(errors, pa.list_(pa.string())), pa.array(records, pa.string())],
                ["conv_id", "call_id", "step", "n_results", "valid", "errors", "record"])

    return linked.mapInArrow(
        run, "conv_id long, call_id string, step long, n_results long, valid boolean, errors array<string>, record string")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call (and per result without one): step, validity, errors and the canonical record."""
    linked = stage_table(link(calls, results), "calls")
    keys = stage_table(order_keys(linked), "keys")
    ordered = linked.join(steps(keys).withColumn("original", F.lit(True)), ["call_id", "original"], "left").join(
        keys.select("call_id", "missing", "stuck", F.lit(True).alias("original")), ["call_id", "original"], "left")
    problems = F.filter(F.concat(
        F.array(F.when(F.col("call_id").isNull(), F.lit("no identifier")),
                F.when(F.col("call_id").isNotNull() & F.col("name").isNotNull() & ~F.col("original"), F.lit("duplicate identifier")),
                F.when(F.col("stuck"), F.lit("dependency cycle")),
                F.when(F.col("name").isNotNull() & F.col("n_results").isNull(), F.lit("no result"))),
        F.coalesce(F.transform("missing", lambda x: F.concat(F.lit("missing dependency "), x)), F.array().cast("array<string>"))),
        lambda x: x.isNotNull())
    return serialise(ordered.select(
        "conv_id", "call_id", "name", "arguments", F.col("answer.content").alias("content"), "step",
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), problems.alias("problems")), schemas)


ANSWER = {"answer": {
    "type": "object", "required": ["after", "chars", "text", "turn"], "additionalProperties": False,
    "properties": {"after": {"type": "array", "items": {"type": "string"}}, "chars": {"type": "integer", "minimum": 1},
                   "text": {"type": "string"}, "turn": {"type": "integer", "minimum": 0}}}}


def turns_as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every user turn as a call that follows the user turn two before, every assistant turn as the result of the turn before."""
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    name = lambda t: F.concat(F.lit("call_"), F.col("conv_id"), F.lit("_"), t)
    after = F.when(F.col("turn") >= 2, F.array(name(F.col("turn") - 2))).otherwise(F.array().cast("array<string>"))
    calls = turns.where("role = 'user'").select(
        "conv_id", name(F.col("turn")).alias("call_id"), F.lit("answer").alias("name"),
        F.to_json(F.struct("turn", "text", F.char_length("text").alias("chars"), after.alias("after"))).alias("arguments"),
        F.col("turn").alias("position"), after.alias("after"))
    results = turns.where("role = 'assistant'").select(
        name(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("position"), F.col("text").alias("content"))
    return calls, results


def turns_without_call(turns: DataFrame) -> DataFrame:
    """Turns of any other role, or of none, as rows without a call: their record has the role, the turn and the text as result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records = [canonical({"arguments": None, "call_id": None, "errors": ["no call"], "name": None, "result": r["text"],
                                  "role": r["role"], "step": None, "turn": r["turn"]}) for r in batch.to_pylist()]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([
                batch.column("conv_id"), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.array([0] * n, pa.int64()),
                pa.array([False] * n), pa.array([["no call"]] * n, pa.list_(pa.string())), pa.array(records, pa.string())],
                ["conv_id", "call_id", "step", "n_results", "valid", "errors", "record"])

    other = turns.where("NOT coalesce(role IN ('user', 'assistant'), false)").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    return other.mapInArrow(
        run, "conv_id long, call_id string, step long, n_results long, valid boolean, errors array<string>, record string")


@query("op3_tool_calls")
def op3_tool_calls(spark, sf_dir):
    """All turns of all conversations: user turns are calls, assistant turns results, and all others rows without a call."""
    turns = table(spark, sf_dir, "conversations")
    return link_tool_calls(*turns_as_calls(turns), ANSWER).unionByName(turns_without_call(turns))
