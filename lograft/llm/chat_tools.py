"""Tool calls of chats: linked to their results, put in topological order, validated, as canonical JSON.

Calls and results meet in hash joins on (conversation, identifier). A row's place is (turn, step): its own turn, unless
something it depends on stands later, which moves it behind. Arguments are checked against JSON schemas, and every row
is written as JSON with sorted keys, no blanks and unescaped Unicode. Rows stay apart, so a conversation of any length
is never one group.
"""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, scratch, ship, written

ITEMS = "conv_id long, turn long, kind string, role string, call_id string, name string, arguments string, content string, after array<string>"
TYPES = {
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "null": lambda v: v is None,
}


def valid(value, schema: dict) -> bool:
    """Whether a JSON value satisfies type, enum, bounds, lengths, items, properties, required and additionalProperties."""
    kinds = schema.get("type")
    if kinds is not None and not any(TYPES[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return False
    if "enum" in schema and not any(value == e and isinstance(value, bool) == isinstance(e, bool) for e in schema["enum"]):
        return False
    if TYPES["number"](value):
        return schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf)
    if isinstance(value, str):
        return schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf)
    if isinstance(value, list):
        return schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", math.inf) and all(valid(v, schema.get("items", {})) for v in value)
    if isinstance(value, dict):
        known, extra = schema.get("properties", {}), schema.get("additionalProperties", True)
        if any(k not in value for k in schema.get("required", ())):
            return False
        if extra is False and any(k not in known for k in value):
            return False
        return all(valid(v, known[k] if k in known else extra if isinstance(extra, dict) else {}) for k, v in value.items())
    return True


def canonical(value) -> str:
    """JSON with sorted keys, no blanks, unescaped Unicode, and equal numbers written alike: 1 for 1.0."""
    return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _plain(value):
    if isinstance(value, float) and value.is_integer():
        return int(value)
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return value


def _refuse(text):
    raise ValueError(text)


def _parsed(text: str | None):
    """(value, whether text is JSON without repeated keys, NaN, infinities, lone surrogates and nesting beyond DEPTH)"""

    def pairs(found):
        out = dict(found)
        if len(out) != len(found):
            raise ValueError("repeated key")
        return out

    try:
        value = json.loads(text or "", object_pairs_hook=pairs, parse_constant=_refuse)
        if _depth(value) > DEPTH:
            return None, False
        canonical(value).encode()
        return value, True
    except (ValueError, RecursionError):  # UnicodeEncodeError is a ValueError
        return None, False


#: Levels of arrays and objects that arguments may have.
DEPTH = 100


def _depth(value) -> int:
    level, n = [value], 0
    while level := [x for v in level if isinstance(v, (list, dict)) for x in [*(v.values() if isinstance(v, dict) else v), None]]:
        n += 1
    return n


def _clean(text: str | None) -> str | None:
    """Text that UTF-8 can hold: U+FFFD for lone surrogates."""
    return None if text is None else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _serialised(schemas: dict[str, dict]):
    def run(batches):
        for batch in batches:
            ok, out = [], []
            for kind, role, call_id, name, arguments, content in zip(*(batch[c].to_pylist() for c in ("kind", "role", "call_id", "name", "arguments", "content")), strict=True):
                ok.append(None)
                if kind == "call":
                    value, readable = _parsed(arguments)
                    ok[-1] = readable and name in schemas and valid(value, schemas[name])
                    row = {"type": "call", "id": call_id, "name": name, "arguments": value if readable else _clean(arguments)}
                elif kind == "result":
                    row = {"type": "result", "id": call_id, "content": content}
                else:
                    row = {"type": "message", "role": role, "content": content}
                out.append(canonical(row))
            keep = [n for n in batch.schema.names if n not in ("role", "arguments", "content")]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in keep), pa.array(ok, pa.bool_()), pa.array(out, pa.string())], [*keep, "valid", "json"])

    return run


#: More than any chain is long; lengths around a cycle stop growing here.
FAR = 1 << 60


def _ordered(calls: DataFrame) -> DataFrame:
    """calls (conv_id, call_id, turn, after), one row per id -> (conv_id, call_id, at_turn, at_step): behind all that they depend on.

    A call's place is the greatest of its own and, for each call it needs, that one's place and a step. Every round doubles
    the pointers: what a call needs is replaced by what that one needs, if that is one call, and settled if that needs none;
    pointers that then agree become one. A chain of n calls takes about log2(n) rounds, and so do trees and chains of diamonds; only
    where calls keep needing several different ones is a round needed for each of them in a row. Rows never become more. A round
    that saves no pointer ends it: what is left stands on a cycle or behind one, and keeps its own place.
    """
    spark = calls.sparkSession
    key, columns = ["conv_id", "call_id"], ["conv_id", "call_id", "at_turn", "at_step"]
    schema = "conv_id long, call_id string, turn long, at struct<turn:long,step:long>, needs array<struct<on:string,steps:long>>"
    edges = calls.select(*key, F.explode(F.array_distinct("after")).alias("on")).where("on is not null and on <> call_id")
    edges = edges.join(calls.select("conv_id", F.col("call_id").alias("on")), ["conv_id", "on"])  # unknown identifiers bind nobody
    needs = edges.groupBy(*key).agg(F.collect_list(F.struct("on", F.lit(1).cast("long").alias("steps"))).alias("needs"))
    at = F.struct(F.col("turn"), F.lit(0).cast("long").alias("step")).alias("at")
    state = calls.select(*key, "turn", at).join(needs, key, "left").withColumn("needs", F.coalesce("needs", F.array().cast("array<struct<on:string,steps:long>>")))
    root, last, k = scratch(spark, "calls"), None, 0
    while True:
        # A round's file holds the calls that still waited before it: those that need none now have found their place.
        state.write.parquet(f"{root}/round={k}")
        state = spark.read.schema(schema).parquet(f"{root}/round={k}")
        left = state.agg(F.sum(F.size("needs")).alias("n")).first().n or 0
        if left == 0 or left == last:
            break
        last = left
        waiting = state.where("size(needs) > 0")
        known = spark.read.schema(f"{schema}, round int").parquet(root).where(f"size(needs) = 0 or round = {k}")
        theirs = known.select("conv_id", F.col("call_id").alias("on"), F.col("at").alias("their_at"), F.col("needs").alias("their_needs"))
        pointers = waiting.select(*key, F.inline("needs").alias("on", "steps")).join(theirs, ["conv_id", "on"])
        few = F.size("their_needs") < 2
        far = lambda x: F.least(x, F.lit(FAR))
        gained = F.when(few, F.struct(F.col("their_at.turn").alias("turn"), far(F.col("their_at.step") + F.col("steps")).alias("step")))
        to = F.when(few, F.get("their_needs", F.lit(0))["on"]).otherwise(F.col("on"))
        steps = F.when(few, far(F.get("their_needs", F.lit(0))["steps"] + F.col("steps"))).otherwise(F.col("steps"))
        moved = pointers.select(*key, to.alias("on"), steps.alias("steps"), gained.alias("gained"))
        moved = moved.groupBy(*key, "on").agg(F.max("steps").alias("steps"), F.max("gained").alias("gained"))
        moved = moved.groupBy(*key).agg(F.collect_list(F.when(F.col("on").isNotNull(), F.struct("on", "steps"))).alias("now"), F.max("gained").alias("gained"))
        state = waiting.join(moved, key).select(*key, "turn", F.greatest("at", "gained").alias("at"), F.col("now").alias("needs"))
        k += 1
    placed = spark.read.schema(schema).parquet(root).where("size(needs) = 0").select(*key, F.col("at.turn").alias("at_turn"), F.col("at.step").alias("at_step"))
    stuck = state.where("size(needs) > 0").select(*key, F.col("turn").alias("at_turn"), F.lit(0).cast("long").alias("at_step"))
    return placed.select(*columns).unionByName(stuck)


def link(items: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per row of items: conv_id, turn, kind, call_id, name, linked_turn, order_turn, order_step, valid, json.

    items has the columns of ITEMS; kind is call, result or message. A call links to the earliest result with its id, a
    result to the earliest call; null ids or conversations never link. Of several calls with one id the earliest counts for
    links, and the others keep their places. Calls on a cycle of dependences, or behind one, keep theirs, as do calls without a turn. valid is null but
    for calls; a name without schema, text that is no JSON, repeated keys, lone surrogates, numbers out of range and
    nesting beyond DEPTH levels are not valid, and such text is kept as a string. Long texts are kept whole. Repeated rows
    give repeated rows; an empty table gives an empty result.
    """
    spark = items.sparkSession
    ship(spark)
    items = items.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in ITEMS.split(", ")])
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    key = ["conv_id", "call_id"]
    calls = items.where(named & (F.col("kind") == "call")).groupBy(*key).agg(F.min("turn").alias("turn"), F.min_by("after", F.struct("turn", "arguments")).alias("after"))
    results = items.where(named & (F.col("kind") == "result")).groupBy(*key).agg(F.min("turn").alias("result_turn"))
    calls = written(calls, "calls")
    order = _ordered(calls).join(calls.select(*key, F.col("turn").alias("call_turn")), key)
    both = order.join(results.hint("shuffle_hash"), key, "full")
    rows = items.join(both.hint("shuffle_hash"), key, "left")
    call, result = F.col("kind") == "call", F.col("kind") == "result"
    own = F.struct(F.col("turn").alias("t"), F.lit(0).cast("long").alias("s"))
    first = call & (F.col("turn") == F.col("call_turn"))
    place = F.when(first, F.struct(F.col("at_turn").alias("t"), F.col("at_step").alias("s"))).when(
        result & F.col("at_turn").isNotNull(), F.greatest(own, F.struct(F.col("at_turn").alias("t"), (F.col("at_step") + 1).alias("s")))
    ).otherwise(own)
    linked = F.when(call, F.col("result_turn")).when(result, F.col("call_turn"))
    rows = rows.withColumn("_place", place).select(
        "conv_id", "turn", "kind", "call_id", "name", linked.alias("linked_turn"), F.col("_place.t").alias("order_turn"), F.col("_place.s").alias("order_step"), "role", "arguments", "content"
    )
    schema = "conv_id long, turn long, kind string, call_id string, name string, linked_turn long, order_turn long, order_step long, valid boolean, json string"
    return rows.mapInArrow(_serialised(schemas), schema)


CALL = "array<struct<id:string,name:string,arguments:string,after:array<string>>>"


def items_of(messages: DataFrame) -> DataFrame:
    """Items of chat messages (conv_id, turn, role, text): an assistant text {"tool_calls": [...]} holds calls, a tool text {"tool_call_id", "content"} a result."""
    made = F.from_json("text", f"tool_calls {CALL}")["tool_calls"]
    made = F.when((F.col("role") == "assistant") & F.col("text").contains("tool_calls"), made)
    said = F.when(F.col("role") == "tool", F.from_json("text", "tool_call_id string, content string"))
    base = messages.select("conv_id", "turn", "role", "text", made.alias("made"), said.alias("said"))
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    calls = base.where("size(made) > 0").select("conv_id", "turn", "role", F.explode("made").alias("m"))
    calls = calls.select("conv_id", "turn", F.lit("call").alias("kind"), "role", F.col("m.id").alias("call_id"), "m.name", "m.arguments", *none("content"), "m.after")
    rest = base.where("made is null or size(made) = 0")
    result = F.col("said.tool_call_id").isNotNull()
    rest = rest.select(
        "conv_id", "turn", F.when(result, "result").otherwise("message").alias("kind"), "role", F.when(result, F.col("said.tool_call_id")).alias("call_id"), *none("name", "arguments"),
        F.when(result, F.col("said.content")).otherwise(F.col("text")).alias("content"), F.lit(None).cast("array<string>").alias("after"),
    )
    return calls.unionByName(rest)


#: What the calls of op7 may say.
ASK = {"ask": {"type": "object", "required": ["chars", "text"], "additionalProperties": False, "properties": {"chars": {"type": "integer", "minimum": 1, "maximum": 400}, "text": {"type": "string", "minLength": 1}}}}


def op7_chat_tools(spark, sf_dir: str) -> DataFrame:
    """conversations as tool use, read from messages: a user's turn calls the tool ask, the assistant's next turn is its result.

    A call needs the one two turns later unless conversation and turn sum to a multiple of 3, so it moves behind that one, or behind a chain.
    """
    t = load(spark, sf_dir, "conversations")
    name = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    turn, user, assistant = F.col("turn").cast("long"), F.col("role") == "user", F.col("role") == "assistant"
    text = F.coalesce("text", F.lit(""))
    needs = F.when((F.col("conv_id") + turn) % 3 != 0, F.array(name(turn + 2)))
    ask = F.struct(name(turn).alias("id"), F.lit("ask").alias("name"), F.to_json(F.struct(text.alias("text"), F.length(text).alias("chars"))).alias("arguments"), needs.alias("after"))
    made = F.to_json(F.struct(F.array(ask).alias("tool_calls")))
    said = F.to_json(F.struct(name(turn - 1).alias("tool_call_id"), text.alias("content")))
    messages = t.select(
        "conv_id", turn.alias("turn"), F.when(user, "assistant").when(assistant, "tool").otherwise(F.col("role")).alias("role"), F.when(user, made).when(assistant, said).otherwise(text).alias("text")
    )
    return link(items_of(messages), ASK)


OP7_SQL = """
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
i AS (SELECT *, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
    CASE role WHEN 'user' THEN turn WHEN 'assistant' THEN turn - 1 END AS call_turn,
    CASE role WHEN 'user' THEN 'c' || conv_id || '-' || turn WHEN 'assistant' THEN 'c' || conv_id || '-' || (turn - 1) END AS call_id FROM t),
c AS (SELECT a.conv_id, a.turn, (a.conv_id + a.turn) % 3 <> 0 AND b.turn IS NOT NULL AS waits FROM t a LEFT JOIN t b ON b.role = 'user' AND b.conv_id = a.conv_id AND b.turn = a.turn + 2 WHERE a.role = 'user'),
o AS (SELECT a.conv_id, a.turn, CASE WHEN NOT a.waits THEN 0 WHEN NOT b.waits THEN 1 ELSE 2 END AS k FROM c a LEFT JOIN c b ON b.conv_id = a.conv_id AND b.turn = a.turn + 2),
l AS (SELECT i.*, o.k, CASE kind WHEN 'call' THEN (SELECT min(r.turn) FROM i r WHERE r.kind = 'result' AND r.call_id = i.call_id) WHEN 'result' THEN o.turn END AS linked_turn
    FROM i LEFT JOIN o ON o.conv_id = i.conv_id AND o.turn = i.call_turn)
SELECT conv_id, turn::BIGINT AS turn, kind, call_id, CASE kind WHEN 'call' THEN 'ask' END AS name, linked_turn::BIGINT AS linked_turn,
    (CASE WHEN coalesce(k, 0) > 0 THEN call_turn + 2 * k ELSE turn END)::BIGINT AS order_turn,
    (CASE WHEN coalesce(k, 0) = 0 THEN 0 WHEN kind = 'call' THEN k ELSE k + 1 END)::BIGINT AS order_step,
    CASE kind WHEN 'call' THEN length(text) BETWEEN 1 AND 400 END AS valid,
    CASE kind WHEN 'call' THEN '{"arguments":{"chars":' || length(text) || ',"text":' || to_json(text) || '},"id":"' || call_id || '","name":"ask","type":"call"}'
        WHEN 'result' THEN '{"content":' || to_json(text) || ',"id":"' || call_id || '","type":"result"}'
        ELSE '{"content":' || to_json(text) || ',"role":' || to_json(role) || ',"type":"message"}' END AS json
FROM l
"""
