"""Tool-call linking for chat data.

Calls and results are joined by hash on (conversation, call identifier). A call comes after the calls it depends on:
where every dependency is an earlier call, the order of turns is already topological; conversations with a dependency on
a later call are ordered in rounds, each of which places the calls that wait for nothing, and calls left in a cycle, or
waiting for one, are marked. Arguments are validated against the JSON schema of the tool, and each link is serialised as
canonical JSON: sorted keys, no blanks, shortest numbers, unescaped Unicode.

One row per call or unlinked result is returned, so a conversation of any length stays distributed. Places within a
conversation are counted in ranges of the order, cut where the rows are.

Defined results: the first call of an identifier (by turn, then content) is the call, later ones are `duplicate_call` and
link with nothing; the first result of a call is its link, later ones are `duplicate_result`. Of the states of a call,
`cycle` comes before `no_result`, `early_result` (a result before its call) and `linked`; a result without call is
`no_call`. Null identifiers link with nothing. Arguments that are no JSON object (NaN, infinite and overlong numbers are
no JSON) are invalid, as are those of unknown tools; a schema type that JSON schema does not know fits no value. Lone
surrogates stay escaped. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SharedTables, placed_in_key, spread_join

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value) -> str:
    """Canonical JSON: sorted keys, no blanks, whole numbers without a fraction."""

    def plain(v):
        if isinstance(v, float) and v.is_integer() and abs(v) < 1e15:
            return int(v)
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    text = json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def parsed(text: str | None):
    """The JSON value of a text; None where it is none."""

    def number(x: str) -> float:
        if not math.isfinite(float(x)):
            raise ValueError(x)
        return float(x)

    try:
        return None if text is None else json.loads(text, parse_constant=number, parse_float=number)
    except (ValueError, RecursionError):
        return None


def schema_errors(value, schema: dict, path: str = "$") -> list[str]:
    """Errors against a JSON schema of: type, enum, const, properties, required, additionalProperties, items, ranges."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds

    def is_a(kind: str) -> bool:
        if kind in ("number", "integer"):
            return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or isinstance(value, int) or value.is_integer())
        return isinstance(value, _TYPES.get(kind, ()))

    if kinds and not any(is_a(k) for k in kinds):
        return [f"{path}: not of type {'/'.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"] or "const" in schema and value != schema["const"]:
        out.append(f"{path}: not an allowed value")
    if isinstance(value, dict):
        props = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            rule = props.get(k, schema.get("additionalProperties", True))
            if rule is False:
                out.append(f"{path}.{k}: not allowed")
            elif isinstance(rule, dict):
                out += schema_errors(v, rule, f"{path}.{k}")
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        for k, v in enumerate(value):
            out += schema_errors(v, schema["items"], f"{path}[{k}]")
    size = len(value) if isinstance(value, (str, list)) else None
    for low, high in (("minLength", "maxLength"), ("minItems", "maxItems")):
        if size is not None and (low.endswith("Length") == isinstance(value, str)) and not schema.get(low, 0) <= size <= schema.get(high, size):
            out.append(f"{path}: size out of range")
    if isinstance(value, (int, float)) and not isinstance(value, bool) and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        out.append(f"{path}: out of range")
    return out


def _levels(calls: DataFrame, tables: SharedTables) -> DataFrame:
    """conv_id, call_id, level, cyclic of the calls of conversations in which a call depends on a later one. calls: one row an identifier."""
    wants = tables.save(calls.select("conv_id", "call_id", "seq", F.explode("depends_on").alias("on")))
    known = calls.select("conv_id", F.col("call_id").alias("on"), F.col("seq").alias("on_seq"))
    edges = tables.save(spread_join(wants, known, ["conv_id", "on"], "call_id"))  # dependencies on unknown calls bind nothing
    late = edges.filter("on_seq >= seq OR on_seq IS NULL OR seq IS NULL").select("conv_id").distinct()
    left = tables.save(calls.join(late, "conv_id", "left_semi").select("conv_id", "call_id"))
    out, level = None, 0
    while not left.isEmpty():
        waits = spread_join(edges, left.withColumnRenamed("call_id", "on"), ["conv_id", "on"], "call_id").select("conv_id", "call_id").distinct()
        free = tables.save(left.join(waits, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(level)).withColumn("cyclic", F.lit(False)))
        if free.isEmpty():
            free = left.withColumn("level", F.lit(level)).withColumn("cyclic", F.lit(True))
            out = free if out is None else out.unionByName(free)
            break
        out = free if out is None else out.unionByName(free)
        left, level = tables.save(left.join(free, ["conv_id", "call_id"], "left_anti")), level + 1
    return out if out is not None else left.withColumn("level", F.lit(0)).withColumn("cyclic", F.lit(False))


def _first_marked(rows: DataFrame, order: list[str], tables: SharedTables) -> DataFrame:
    """rows with `first`: true for one row of each identifier, the first by turn and content; null identifiers have none."""
    rows = tables.save(rows.withColumn("uid", F.monotonically_increasing_id()))
    least = F.min(F.struct(F.col("seq").isNull().alias("late"), "seq", *order, "uid"))  # minima are taken before the shuffle
    heads = rows.filter("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(least.alias("head")).select(F.col("head.uid").alias("uid"), F.lit(True).alias("first"))
    return tables.save(rows.join(heads, "uid", "left").withColumn("first", F.coalesce("first", F.lit(False))))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """conv_id, call_id, call_turn, result_turn, status, valid, position, json.

    calls: conv_id, call_id, seq, name, arguments (JSON), depends_on (array of call_id); results: conv_id, call_id, seq, content.
    """
    tables = SharedTables(calls.sparkSession, "chat")
    key = ["conv_id", "call_id"]
    ident, seq = F.col("call_id").cast("string").alias("call_id"), F.col("seq").cast("long").alias("seq")
    calls = calls.select("conv_id", ident, seq, F.col("name").cast("string"), F.col("arguments").cast("string"), F.col("depends_on").cast("array<string>"))
    results = results.select("conv_id", ident, seq, F.col("content").cast("string"))
    calls = _first_marked(calls, ["name", "arguments", "depends_on"], tables)
    results = _first_marked(results, ["content"], tables).withColumnRenamed("seq", "result_turn")
    main = calls.filter("first").drop("uid", "first")
    levels = _levels(main, tables)
    # Identifiers are unique on both sides, so the hash join meets no hot key; null ones stay out of it.
    answers = results.filter("first").select(*key, "result_turn", "content", F.lit(True).alias("answered"))
    status = (
        F.when(F.col("called").isNull(), "no_call").when(F.col("cyclic"), "cycle").when(F.col("answered").isNull(), "no_result")
        .when(F.col("result_turn") < F.col("seq"), "early_result").otherwise("linked")
    )
    linked = main.withColumn("called", F.lit(True)).join(answers.hint("shuffle_hash"), key, "full_outer").join(levels.hint("shuffle_hash"), key, "left").withColumn("status", status)
    no_key = "conv_id IS NULL OR call_id IS NULL"
    others = calls.filter("NOT first").select(*key, "seq", "name", "arguments", F.lit(True).alias("called"), F.expr(f"if({no_key}, 'no_result', 'duplicate_call')").alias("status"))
    extra = results.filter("NOT first").select(*key, "result_turn", "content", F.expr(f"if({no_key}, 'no_call', 'duplicate_result')").alias("status"))
    rows = linked.unionByName(others, allowMissingColumns=True).unionByName(extra, allowMissingColumns=True)
    rows = rows.withColumn("at", F.coalesce("seq", "result_turn", F.lit(0))).withColumn("level", F.coalesce("level", F.lit(0)))
    names = ["conv_id", "call_id", "call_turn", "result_turn", "status", "valid", "at", "level", "json"]

    def serialise(batches):
        for batch in batches:
            d = {n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns)}
            valid, text = [], []
            for k in range(len(batch)):
                args, schema = parsed(d["arguments"][k]), schemas.get(d["name"][k])
                valid.append(None if not d["called"][k] else schema is not None and isinstance(args, dict) and not schema_errors(args, schema))
                text.append(canonical({"id": d["call_id"][k], "name": d["name"][k], "arguments": args if args is not None else d["arguments"][k], "result": d["content"][k]}))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("conv_id", "call_id", "seq", "result_turn", "status")), pa.array(valid, pa.bool_()), batch.column("at"), batch.column("level"), pa.array(text, pa.string())], names)

    conv = calls.schema["conv_id"].dataType.simpleString()
    picked = rows.select("conv_id", "call_id", "seq", "result_turn", "status", "name", "arguments", "content", "called", F.col("at").cast("long"), F.col("level").cast("int"))
    done = picked.mapInArrow(serialise, f"conv_id {conv}, call_id string, call_turn long, result_turn long, status string, valid boolean, at long, level int, json string")
    placed = placed_in_key(tables.save(done), ["conv_id"], ["level", "at", "call_id", "result_turn", "status", "json"], tables)
    return placed.select("conv_id", "call_id", "call_turn", "result_turn", "status", "valid", F.col("nth").alias("position"), "json")


#: The schema of the one tool that the turns of plain conversations are read as.
REPLY = {"reply": {"type": "object", "required": ["prompt", "turn"], "additionalProperties": False, "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}}}


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain turns as calls and results: a user's turn calls `reply`, any other turn, also one without role, is the result of the turn before."""
    ident = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    turn = F.col("turn").cast("long")
    calls = conversations.filter("role = 'user'").select(
        "conv_id", ident(turn).alias("call_id"), turn.alias("seq"), F.lit("reply").alias("name"), F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("prompt"), turn.alias("turn"))).alias("arguments"), F.array(ident(turn - 2)).alias("depends_on")
    )
    results = conversations.filter("NOT role <=> 'user'").select("conv_id", ident(turn - 1).alias("call_id"), turn.alias("seq"), F.col("text").alias("content"))
    return calls, results
