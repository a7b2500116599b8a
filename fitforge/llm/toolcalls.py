"""Linking tool calls with their results.

Calls and results meet in a hash join by conversation and identifier.  A call's
level is one more than the highest of the calls it names as needed before it, so
that (level, turn) is a topological order; calls on a cycle have none.  Arguments
are checked against the tool's schema, and each exchange is one line of canonical
JSON: sorted keys, no blanks, characters as they are.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitforge.llm.scratch import cut

#: Schemas by tool: required names, and of each argument the JSON type or a dict of
#: ``type``, ``minLength``, ``maxLength``, ``minimum``, ``maximum`` and ``enum``.
SCHEMAS: dict[str, dict] = {"reply": {"required": ["text"], "properties": {"text": {"type": "string", "minLength": 1, "maxLength": 300}}}}
#: Needs of a conversation that one task settles by itself.
TASK_NEEDS = 500_000

_TYPES = {"string": str, "number": (int, float), "integer": int, "boolean": bool, "object": dict, "array": list, "null": type(None)}
_PARSED = "is_call boolean, call_id string, turn long, place long, name string, arguments string, after array<string>, content string"
_LONE_SURROGATE = re.compile("[\ud800-\udfff]")


def _loaded(text: str | None):
    """The JSON object of a text and whether it is one; NaN, numbers out of range and too deep nesting are no JSON."""
    if not text or text.lstrip()[:1] != "{":
        return None
    try:
        found = json.loads(text)
        _canonical(found)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _canonical(value) -> str:
    """Strict JSON: sorted keys, no blanks, characters as they are (but half surrogates, which UTF-8 lacks, escaped)."""
    made = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return _LONE_SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", made)


def _identifier(value) -> str | None:
    """Strings and numbers as text, other values as JSON; null is no identifier."""
    if value is None:
        return None
    made = value if isinstance(value, str) else _canonical(value)
    return _LONE_SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", made)


def _parsed(turn, role: str | None, text: str | None) -> Iterator[tuple]:
    """Calls and results of a message.

    An assistant's JSON object with ``tool_calls`` makes calls, a tool's message is a
    result, of the call that its JSON object names as ``tool_call_id``.  All other
    messages, users' turns and answers among them, have neither."""
    if role == "assistant":
        found = _loaded(text)
        if found and isinstance(found.get("tool_calls"), list):
            for place, c in enumerate(found["tool_calls"]):
                if isinstance(c, dict):
                    after = c.get("after") if isinstance(c.get("after"), list) else []
                    after = [x for x in map(_identifier, after) if x is not None]
                    yield True, _identifier(c.get("id")), turn, place, _identifier(c.get("name")), _canonical(c.get("arguments")), after, None
    elif role == "tool":
        found = _loaded(text)
        known = found is not None and "tool_call_id" in found
        yield False, _identifier(found["tool_call_id"]) if known else None, turn, 0, None, None, None, _canonical(found.get("content") if known else text)


def parse_messages(messages: DataFrame) -> DataFrame:
    """Calls and results of messages (conv_id of any type, turn, role, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string())
        names = [x.split()[0] for x in _PARSED.split(", ")]
        for b in batches:
            found = [list(_parsed(*m)) for m in zip(*(b.column(i).to_pylist() for i in range(1, 4)), strict=True)]
            rows = [r for made in found for r in made]
            whose = b.column(0).take(pa.array([i for i, made in enumerate(found) for _ in made], pa.int64()))
            yield pa.RecordBatch.from_arrays([whose, *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["conv_id", *names])

    kind = dict(messages.dtypes)["conv_id"]
    return messages.select("conv_id", F.col("turn").cast("long"), "role", "text").where("role in ('assistant', 'tool')").mapInArrow(run, f"conv_id {kind}, {_PARSED}")


def argument_errors(name: str | None, arguments: str | None, schemas: dict[str, dict]) -> list[str]:
    """What is wrong with a call's arguments."""
    schema = schemas.get(name or "")
    if schema is None:
        return ["unknown tool"]
    value = json.loads(arguments) if arguments else None
    if not isinstance(value, dict):
        return ["arguments are no object"]
    out = [f"{x} is missing" for x in schema.get("required", []) if x not in value]
    for k in sorted(value):
        rule = schema.get("properties", {}).get(k)
        if rule is None:
            out.append(f"{k} is not known")
            continue
        rule = rule if isinstance(rule, dict) else {"type": rule}
        v, kind = value[k], rule.get("type")
        is_number = isinstance(v, (int, float)) and not isinstance(v, bool)
        if kind and (not isinstance(v, _TYPES[kind]) or (isinstance(v, bool) and kind in ("number", "integer"))):
            out.append(f"{k} is no {kind}")
        if isinstance(v, str) and not rule.get("minLength", 0) <= len(v) <= rule.get("maxLength", len(v)):
            out.append(f"{k} is too short or too long")
        if is_number and not rule.get("minimum", v) <= v <= rule.get("maximum", v):
            out.append(f"{k} is out of range")
        if "enum" in rule and v not in rule["enum"]:
            out.append(f"{k} is none of the values")
    return out


def _task_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From needs sorted by conversation: rows (conv_id, call_id, level) of those that become ready."""

    def settle(conv_id: int, pairs: list[tuple[str, str]]) -> pa.RecordBatch:
        open_needs = Counter(call for call, _ in pairs)
        behind = defaultdict(list)
        for call, before in pairs:
            behind[before].append(call)
        ready = [b for b in behind if b not in open_needs]
        level = dict.fromkeys(ready, 0)
        for b in ready:  # grows while it is read
            for call in behind[b]:
                level[call] = max(level.get(call, 0), level[b] + 1)
                open_needs[call] -= 1
                if not open_needs[call]:
                    ready.append(call)
        made = [x for x in ready if x in open_needs]
        return pa.RecordBatch.from_arrays([pa.array([conv_id] * len(made), kind), pa.array(made, pa.string()), pa.array([level[x] for x in made], pa.int32())], names=["conv_id", "call_id", "level"])

    last, held, kind = None, [], pa.null()
    for batch in batches:
        kind = batch.column("conv_id").type
        for conv_id, call, before in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "call_id", "before")), strict=True):
            if held and conv_id != last:
                yield settle(last, held)
                held = []
            last = conv_id
            held.append((call, before))
    if held:
        yield settle(last, held)


def _levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id and level of calls that need others; calls on a cycle, or behind one, are left out.

    A conversation of up to TASK_NEEDS needs is settled by one task; larger ones
    level by level, until no call becomes ready.
    """
    calls = calls.where("conv_id is not null and call_id is not null")
    needs = calls.where(F.size("after") > 0).select("conv_id", "call_id", F.explode(F.array_distinct("after")).alias("before"))
    known = calls.select("conv_id", F.col("call_id").alias("before"))
    needs = cut(needs.join(known, ["conv_id", "before"]), "needs")
    waiting = needs.select("conv_id", "call_id").distinct()
    level = calls.select("conv_id", "call_id").join(waiting, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0))
    large = cut(needs.groupBy("conv_id").count().where(F.col("count") > TASK_NEEDS).select("conv_id"), "large")
    small = needs.join(large, "conv_id", "left_anti").select("conv_id", "call_id", "before")
    dealt = small.repartition("conv_id").sortWithinPartitions("conv_id").mapInArrow(_task_levels, f"conv_id {dict(calls.dtypes)['conv_id']}, call_id string, level int")
    level = level.unionByName(cut(dealt, "task_levels"))
    if not large.limit(1).count():
        return level
    waiting = cut(waiting.join(large, "conv_id", "left_semi"), "waiting")
    for turn in count():
        done = level.select("conv_id", F.col("call_id").alias("before"), "level")
        state = needs.join(waiting, ["conv_id", "call_id"]).join(done, ["conv_id", "before"], "left").groupBy("conv_id", "call_id")
        ready = cut(state.agg(F.max("level").alias("level"), F.count("*").alias("n"), F.count("level").alias("known")).where("n = known").select("conv_id", "call_id", (F.col("level") + 1).alias("level")), f"ready_{turn}")
        if not ready.limit(1).count():
            return level
        level = cut(level.unionByName(ready), f"level_{turn}")
        waiting = cut(waiting.join(ready, ["conv_id", "call_id"], "left_anti"), f"waiting_{turn}")


def link_tool_calls(messages: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """One row per call, and per result without a call.

    Columns: conv_id, call_id, call_turn, result_turn, n_calls and n_results (rows
    with this identifier; the earliest, of these the first of its message, then the
    smallest text, counts), level (null on a cycle and without a call), valid, and
    ``exchange``, canonical JSON.  Calls and results without an identifier or without
    conv_id link with nothing; each is a row of its own, at level 0 if it is a call.
    Only assistants' ``tool_calls`` are calls and only tools' messages results; ordinary
    turns make neither.  Texts that are no strict JSON object are plain texts, whatever
    their length; null texts count as empty; conv_id keeps its type; other columns are
    left out; an empty table gives no rows.
    """
    known = SCHEMAS if schemas is None else schemas
    parsed = cut(parse_messages(messages), "parsed")
    key = ["conv_id", "call_id"]
    # what has no identifier is told apart by its place
    lone = F.when(F.col("call_id").isNull() | F.col("conv_id").isNull(), F.concat_ws(" ", "turn", "place")).alias("lone")
    first = F.min(F.struct("turn", "place", "name", "arguments", "after"))
    calls = parsed.where("is_call").groupBy(*key, lone).agg(first.alias("c"), F.count("*").alias("n_calls"))
    calls = calls.select(*key, "lone", F.col("c.turn").alias("call_turn"), "c.name", "c.arguments", "c.after", "n_calls")
    results = parsed.where("not is_call").groupBy(*key, lone).agg(F.min(F.struct("turn", "place", "content")).alias("r"), F.count("*").alias("n_results"))
    results = results.select(*key, F.col("r.turn").alias("result_turn"), "r.content", "n_results")
    linked = calls.join(results, key, "full_outer").join(_levels(calls), key, "left")
    linked = linked.withColumn("level", F.when(F.col("lone").isNotNull(), F.lit(0)).otherwise(F.col("level")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            valid, lines = [], []
            columns = (b.column(c).to_pylist() for c in ("call_id", "call_turn", "name", "arguments", "content"))
            for call_id, turn, name, arguments, content in zip(*columns, strict=True):
                errors = argument_errors(name, arguments, known) if turn is not None or name is not None else ["no call"]
                valid.append(not errors)
                lines.append(_canonical({"arguments": json.loads(arguments) if arguments else None, "id": call_id, "name": name, "result": json.loads(content) if content else None}))
            kept = [b.column(c) for c in ("conv_id", "call_id", "call_turn", "result_turn", "n_calls", "n_results", "level")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(valid, pa.bool_()), pa.array(lines, pa.string())], names=["conv_id", "call_id", "call_turn", "result_turn", "n_calls", "n_results", "level", "valid", "exchange"])

    rows = linked.select("conv_id", "call_id", "call_turn", "result_turn", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), F.col("level").cast("long").alias("level"), "name", "arguments", "content")
    return rows.mapInArrow(run, f"conv_id {dict(messages.dtypes)['conv_id']}, call_id string, call_turn long, result_turn long, n_calls long, n_results long, level long, valid boolean, exchange string")
