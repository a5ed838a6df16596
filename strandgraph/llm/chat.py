"""Chat formatting: tool-call linking.

Calls and results are hash-joined by (conversation, call identifier); calls are ordered topologically, so that each comes
after the results it uses; arguments are validated against the tool's JSON schema; and every call, with its result, is
serialised as canonical JSON (sorted keys, no spaces, shortest numbers, UTF-8).

The order needs no walk along a conversation: a call may use results of earlier turns only, which the turn number orders,
or of its own turn, where the few calls of one message are levelled by rounds of joins over such links alone. A link to a
later turn, to an unknown call or in a circle is an error of the call, named in its row.

Defined results: calls without identifier or conversation can't be linked and have status `unlinked`; of calls with one
identifier the first by (turn, text) is linked, the others are `duplicate`; of several results the first after the call
by (turn, text); results without call are rows of their own with status `orphan`; null text counts as empty; malformed
JSON arguments, or such as nest too deeply, are an error, not a crash, and halves of surrogate pairs stay escaped; an
empty table gives no rows. A system turn is in the JSON of the first call of
its turn or the next one with calls, from which on it holds; system turns that no call follows, and turns of null or other
roles, are rows of their own with status `turn`.
"""

from __future__ import annotations

import itertools
import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, table

#: Rounds of levelling within a turn between two tables that hold all levels found.
ROUNDS_A_TABLE = 16
TURNS_A_PIECE = 1024

_LONE = re.compile("[\ud800-\udfff]")
_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def schema_errors(value, schema, at: str = "$") -> list[str]:
    """What of a JSON schema a value breaks: type, enum, const, required, properties, additionalProperties, items and limits."""
    if schema is True or not schema:
        return [] if schema is not False else [f"{at}: not allowed"]
    out = []
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    whole = number and (isinstance(value, int) or value.is_integer())
    if kinds and not any((number if k == "number" else whole if k == "integer" else type(value) is _TYPES.get(k)) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if "const" in schema and value != schema["const"]:
        out.append(f"{at}: not the constant")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", math.inf):
            out.append(f"{at}: length {len(value)}")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: pattern")
    if number and not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf):
        out.append(f"{at}: out of range")
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", math.inf):
            out.append(f"{at}: {len(value)} items")
        for k, x in enumerate(value):
            out += schema_errors(x, schema.get("items", True), f"{at}[{k}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, x in value.items():
            out += schema_errors(x, known[k] if k in known else schema.get("additionalProperties", True), f"{at}.{k}")
    return out


def canonical(value) -> str:
    """Canonical JSON: keys in code point order, no spaces, whole floats as integers, non-finite numbers as null."""

    def plain(x):
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        if isinstance(x, float):
            return None if not math.isfinite(x) else int(x) if x.is_integer() and abs(x) < 2**53 else x
        return x

    return storable(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def storable(text: str) -> str:
    """Halves of surrogate pairs, which UTF-8 can't hold, as the escapes that JSON has for them."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def checked(arguments: str, name: str | None, tools: dict[str, dict], closed: bool = True) -> tuple[object, list[str]]:
    """The value of a call's arguments, and what is wrong with it. Text that no parser here can hold is wrong, not a crash.

    closed: a tool without a schema is wrong; else its arguments need only be JSON.
    """
    try:
        value = json.loads(arguments)
        errors = schema_errors(value, tools[name]) if name in tools else [f"unknown tool {name}"] * closed
        canonical(value)
    except RecursionError:
        return None, ["arguments nest too deeply"]
    except ValueError:
        return None, ["arguments are no JSON"]
    return value, [storable(e) for e in errors]


def levels(calls: DataFrame, links: DataFrame) -> DataFrame:
    """(conv, call, level) from links (conv, call, uses) within one turn: 0 uses none; a null level is in a circle."""
    inner = materialize(links, "inner")
    nodes = inner.select("conv", "call").unionByName(inner.select("conv", F.col("uses").alias("call"))).distinct()
    state = materialize(nodes.join(inner.select("conv", "call").distinct(), ["conv", "call"], "left_anti").withColumn("level", F.lit(0)), "levels")
    for level in itertools.count(1):
        # ready: all that a call uses has a level
        need = inner.join(state.select("conv", F.col("call").alias("uses"), "level"), ["conv", "uses"], "left").groupBy("conv", "call").agg(F.count("*").alias("n"), F.count("level").alias("k"))
        ready = need.filter("n = k").join(state, ["conv", "call"], "left_anti").select("conv", "call", F.lit(level).alias("level"))
        ready = materialize(ready, "levels")
        if ready.isEmpty():
            break
        state = state.unionByName(ready)
        if level % ROUNDS_A_TABLE == 0:
            state = materialize(state, "levels")
    return nodes.join(state, ["conv", "call"], "left").select("conv", "call", "level")


def placed(notes: DataFrame, calls: DataFrame) -> DataFrame:
    """notes(conv, turn, text) with `call`: the first of calls(conv, turn, call) in the note's turn or the next one that has
    calls; null: none follows. Turns are taken in pieces, so that no long conversation is one group."""
    heads = calls.filter("turn IS NOT NULL").groupBy("conv", "turn").agg(F.min("call").alias("head")).withColumn("piece", F.floor(F.col("turn") / TURNS_A_PIECE))
    asked = notes.withColumn("piece", F.floor(F.col("turn") / TURNS_A_PIECE))
    back = Window.partitionBy("conv", "piece").orderBy(F.col("turn").desc(), F.col("head").isNull())
    near = heads.withColumns({"text": F.lit(None).cast("string"), "note": F.lit(False)}).unionByName(asked.withColumns({"head": F.lit(None).cast("string"), "note": F.lit(True)}))
    near = near.withColumn("near", F.last("head", True).over(back.rowsBetween(Window.unboundedPreceding, 0))).filter("note")
    # where the piece has none, the first of the next piece that has calls
    starts = heads.groupBy("conv", "piece").agg(F.min_by("head", "turn").alias("start")).unionByName(asked.select("conv", "piece", F.lit(None).cast("string").alias("start")))
    starts = starts.groupBy("conv", "piece").agg(F.max("start").alias("start"))
    after = Window.partitionBy("conv").orderBy("piece").rowsBetween(1, Window.unboundedFollowing)
    starts = starts.select(F.col("conv").alias("s_conv"), F.col("piece").alias("s_piece"), F.first("start", True).over(after).alias("start"))
    near = near.join(starts, (F.col("conv") == F.col("s_conv")) & (F.col("piece") == F.col("s_piece")), "left")
    return near.select("conv", "turn", "text", F.when(F.col("conv").isNotNull() & F.col("turn").isNotNull(), F.coalesce("near", "start")).alias("call"))


def link(calls: DataFrame, results: DataFrame, tools: dict[str, dict], notes: DataFrame | None = None, closed: bool = True) -> DataFrame:
    """calls(conv, turn, call, name, arguments JSON, uses array), results(conv, turn, call, content) -> a row for each call
    and each orphan: conv, call, turn, name, status, level, position, valid, errors, json. Columns besides are left out.
    notes(conv, turn, role, text): turns that neither call nor answer, system turns among them. closed: as in `checked`."""
    calls = calls.select("conv", "turn", "call", "name", F.coalesce("arguments", F.lit("")).alias("arguments"), F.coalesce("uses", F.array().cast("array<string>")).alias("uses"))
    results = results.select("conv", F.col("turn").alias("r_turn"), "call", F.coalesce("content", F.lit("")).alias("content"))
    lost = F.col("conv").isNull() | F.col("call").isNull()
    order = Window.partitionBy("conv", "call").orderBy(F.col("turn").asc_nulls_last(), "name", "arguments")
    named = calls.filter(~lost).withColumn("copy", F.row_number().over(order))
    first = materialize(named.filter("copy = 1").drop("copy"), "calls")
    # the first result after the call, by a pre-aggregated minimum
    answer = first.select("conv", "call", "turn").join(results, ["conv", "call"]).filter("turn IS NULL OR r_turn IS NULL OR r_turn >= turn")
    answer = answer.groupBy("conv", "call").agg(F.min(F.struct(F.col("r_turn").isNull(), "r_turn", "content")).alias("m"))
    answer = answer.select("conv", "call", F.col("m.r_turn").alias("result_turn"), F.col("m.content").alias("result"))
    uses = first.select("conv", "call", "turn", F.explode(F.array_distinct("uses")).alias("uses"))
    known = first.select("conv", F.col("call").alias("uses"), F.col("turn").alias("u_turn"))
    uses = uses.join(known.withColumn("found", F.lit(True)), ["conv", "uses"], "left")
    level = levels(first, uses.filter("turn = u_turn").select("conv", "call", "uses"))
    bad = F.when(F.col("found").isNull(), F.concat(F.lit("uses unknown call "), "uses")).when(F.col("u_turn") > F.col("turn"), F.concat(F.lit("uses later call "), "uses"))
    bad = uses.withColumn("bad", bad).filter("bad IS NOT NULL").groupBy("conv", "call").agg(F.array_sort(F.collect_set("bad")).alias("bad"))
    rows = first.join(answer, ["conv", "call"], "left").join(level.withColumn("levelled", F.lit(True)), ["conv", "call"], "left").join(bad, ["conv", "call"], "left")
    rows = rows.withColumn("circle", F.col("levelled").isNotNull() & F.col("level").isNull())
    rows = rows.withColumn("level", F.when(~F.col("circle"), F.coalesce("level", F.lit(0)))).withColumn("status", F.when(F.col("result").isNull(), "open").otherwise("linked")).drop("levelled")
    # position in the conversation: within a piece of turns, after what the pieces before hold
    rows = materialize(rows.withColumn("piece", F.floor(F.col("turn") / TURNS_A_PIECE)), "linked")
    before = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("conv", "piece").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    base = base.select(F.col("conv").alias("b_conv"), F.col("piece").alias("b_piece"), "base")
    rows = rows.join(base, (F.col("conv") == F.col("b_conv")) & F.col("piece").eqNullSafe(F.col("b_piece")))
    inside = Window.partitionBy("conv", "piece").orderBy(F.col("turn").asc_nulls_last(), F.col("level").asc_nulls_last(), "call")
    rows = rows.withColumn("position", F.col("base") + F.row_number().over(inside))
    empty = {"result_turn": F.lit(None).cast("long"), "result": F.lit(None).cast("string"), "level": F.lit(None).cast("int"), "position": F.lit(None).cast("long"), "bad": F.lit(None).cast("array<string>"), "circle": F.lit(False)}
    columns = ["conv", "call", "turn", "name", "arguments", "uses", "result_turn", "result", "level", "position", "bad", "circle", "status"]
    rows = rows.withColumns({"result_turn": F.col("result_turn").cast("long"), "position": F.col("position").cast("long")}).select(columns)
    rows = rows.unionByName(named.filter("copy > 1").withColumns(empty).withColumn("status", F.lit("duplicate")).select(columns))
    rows = rows.unionByName(calls.filter(lost).withColumns(empty).withColumn("status", F.lit("unlinked")).select(columns))
    orphans = results.join(first.select("conv", "call"), ["conv", "call"], "left_anti")
    orphans = orphans.select("conv", "call", F.lit(None).cast(calls.schema["turn"].dataType).alias("turn"), F.lit(None).cast("string").alias("name"), F.lit("").alias("arguments"), F.array().cast("array<string>").alias("uses"), *[F.col("r_turn").cast("long").alias("result_turn"), F.col("content").alias("result")], *[v.alias(k) for k, v in empty.items() if k not in ("result_turn", "result")], F.lit("orphan").alias("status"))
    rows = rows.unionByName(orphans.select(columns))
    held = "array<struct<turn:bigint,text:string>>"
    if notes is None:
        rows = rows.withColumn("system", F.lit(None).cast(held))
    else:
        notes = notes.select("conv", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
        system = materialize(placed(notes.filter("role = 'system'").drop("role"), first), "system")
        own = system.filter("call IS NOT NULL").groupBy("conv", "call").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").cast("long").alias("turn"), "text"))).alias("system"))
        own = own.withColumn("status", F.explode(F.array(F.lit("linked"), F.lit("open"))))
        rows = rows.join(own, ["conv", "call", "status"], "left").select(*columns, F.col("system").cast(held))
        rest = system.filter("call IS NULL").select("conv", "turn", F.lit("system").alias("name"), "text")
        rest = rest.unionByName(notes.filter("role IS NULL OR role <> 'system'").select("conv", "turn", F.col("role").alias("name"), "text"))
        rest = rest.select("conv", "turn", "name", F.col("text").alias("arguments"), F.lit(None).cast("string").alias("call"), F.array().cast("array<string>").alias("uses"), *(v.alias(k) for k, v in empty.items()), F.lit("turn").alias("status"))
        rows = rows.unionByName(rest.select(*columns, F.lit(None).cast(held).alias("system")))

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                errors, value = list(r["bad"] or []) + ["uses itself in a circle"] * bool(r["circle"]), None
                if r["status"] == "turn":
                    errors.append("no call follows" if r["name"] == "system" else f"role {r['name']}")
                    out.append((False, errors, canonical({"conversation": r["conv"], "role": r["name"], "text": r["arguments"], "turn": r["turn"]})))
                    continue
                if r["status"] != "orphan":
                    value, wrong = checked(r["arguments"], r["name"], tools, closed)
                    errors += wrong
                line = {"arguments": value, "conversation": r["conv"], "id": r["call"], "name": r["name"], "turn": r["turn"], "uses": sorted(r["uses"])}
                if r["result"] is not None:
                    line["result"] = {"content": r["result"], "turn": r["result_turn"]}
                if r["system"]:
                    line["system"] = r["system"]
                out.append((not errors and r["status"] == "linked", errors, canonical(line)))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [*(b[c] for c in ("conv", "call", "turn", "name", "status", "level", "position")), pa.array(cols[0]), pa.array(cols[1], pa.list_(pa.string())), pa.array(cols[2], pa.string())],
                ["conv", "call", "turn", "name", "status", "level", "position", "valid", "errors", "json"],
            )

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return map_arrow(rows, run, f"conv {kind['conv']}, call string, turn {kind['turn']}, name string, status string, level int, position bigint, valid boolean, errors array<string>, json string")


#: The schema by which a conversation's prompts are checked in op4.
TOOLS = {
    "reply": {
        "type": "object",
        "required": ["prompt", "turn"],
        "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
        "additionalProperties": False,
    }
}


def parse(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of messages (conv_id, turn, role, text) whose text is the usual JSON: an assistant's
    {"tool_calls": [{"id", "name", "arguments", "uses"}]} and a tool's {"tool_call_id", "content"}."""
    call = "struct<id:string,name:string,arguments:string,uses:array<string>>"
    made = messages.filter(F.col("role") == "assistant").select("conv_id", "turn", F.explode(F.from_json("text", f"tool_calls array<{call}>")["tool_calls"]).alias("c"))
    done = messages.filter(F.col("role") == "tool").select("conv_id", "turn", F.from_json("text", "tool_call_id string, content string").alias("r"))
    return (
        made.select(F.col("conv_id").alias("conv"), "turn", F.col("c.id").alias("call"), "c.name", "c.arguments", "c.uses"),
        done.select(F.col("conv_id").alias("conv"), "turn", F.col("r.tool_call_id").alias("call"), "r.content"),
    )


def turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Plain conversations as tool use: a user's turn calls `reply`, the assistant's next turn is its result, and a call
    uses the user's turn two before it, if there is one. Identifiers say conversation and turn of the prompt. Third: the
    assistant's turns that follow no user's turn."""
    name = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    args = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("prompt"), "turn"))
    users, said = messages.filter(F.col("role") == "user"), messages.filter(F.col("role") == "assistant")
    asked = users.select("conv_id", "turn").distinct()
    has = lambda rows, back: rows.join(asked.select("conv_id", (F.col("turn") + back).alias("turn"), F.lit(True).alias("has_one")), ["conv_id", "turn"], "left")
    uses = F.when(F.col("has_one"), F.array(name(F.col("turn") - 2))).otherwise(F.array().cast("array<string>"))
    user = has(users.select("conv_id", "turn", "text"), 2).select(F.col("conv_id").alias("conv"), "turn", name(F.col("turn")).alias("call"), F.lit("reply").alias("name"), args.alias("arguments"), uses.alias("uses"))
    said = has(said.select("conv_id", "turn", "role", "text"), 1)
    back = said.filter("has_one").select(F.col("conv_id").alias("conv"), "turn", name(F.col("turn") - 1).alias("call"), F.col("text").alias("content"))
    return user, back, said.filter("has_one IS NULL").select(F.col("conv_id").alias("conv"), "turn", "role", "text")


def op4(spark, sf_dir: str) -> DataFrame:
    """All of `conversations`: JSON tool calls as they are, turns of plain text as calls of `reply`, and all other turns.

    The table holds no schemas of tools, so arguments of tools but `reply` need only be JSON.
    """
    messages = table(spark, sf_dir, "conversations")
    calls, results = parse(messages)
    is_call = (F.col("role") == "assistant") & F.from_json("text", "tool_calls array<string>")["tool_calls"].isNotNull()
    plain_calls, plain_results, alone = turns_as_calls(messages.filter(F.col("role").isin("user", "assistant") & ~F.coalesce(is_call, F.lit(False))))
    notes = messages.filter(F.col("role").isNull() | ~F.col("role").isin("user", "assistant", "tool")).select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    return link(calls.unionByName(plain_calls), results.unionByName(plain_results), TOOLS, notes.unionByName(alone), closed=False)
