"""Tool-call linking for chat formatting.

Calls and results meet in a hash join by conversation and call identifier. Calls are ordered
topologically by the calls whose results they use; arguments are checked against JSON schemas; and each
call with its result is serialised as canonical JSON (keys sorted, no spaces, UTF-8).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .tables import stage

_TYPES = {"string": str, "boolean": bool, "array": list, "object": dict, "null": type(None)}

#: Tools of the registered query, with their argument schemas.
SCHEMAS = {
    "search": {"type": "object", "required": ["query"], "additionalProperties": False,
               "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 50}}},
    "lookup": {"type": "object", "required": ["key", "exact"], "additionalProperties": False,
               "properties": {"key": {"type": "string"}, "exact": {"type": "boolean"},
                              "fields": {"type": "array", "items": {"type": "string"}}}},
    "measure": {"type": "object", "required": ["text", "unit"],
                "properties": {"text": {"type": "string"}, "unit": {"enum": ["chars", "words"]}, "scale": {"type": "number"}}},
}


#: Levels of arrays and objects that arguments may have: all Python versions read and write these.
DEEPEST = 500


def _depth(text: str) -> int:
    """Levels of brackets outside strings."""
    deepest = level = 0
    for b in re.findall(r"[][{}]", re.sub(r'"(?:[^"\\]|\\.)*"', "", text)):
        level += 1 if b in "[{" else -1
        deepest = max(deepest, level)
    return deepest


def parsed(text: str | None) -> tuple[object, list[str]]:
    """(value, problems) of a JSON text; null is null. Whatever Python or Arrow can't hold is a problem with a null
    value: no JSON, numbers out of range, more than ``DEEPEST`` levels, unpaired surrogates. Of a
    repeated key the last value counts. A whole number is an integer however it is written (2.0 is 2)."""
    repeated: list[str] = []

    def pairs(items: list) -> dict:
        out = dict(items)
        if len(out) < len(items):
            repeated.append("$: repeated key")
        return out

    def number(digits: str) -> int | float:
        value = float(digits)
        return int(value) if value.is_integer() and abs(value) < 2 ** 53 else value

    def constant(name: str):
        raise json.JSONDecodeError("not a JSON value", name, 0)

    if text is None:
        return None, []
    if text.count("[") + text.count("{") > DEEPEST and _depth(text) > DEEPEST:
        return None, ["$: nested too deeply"]
    try:
        value = json.loads(text, object_pairs_hook=pairs, parse_float=number, parse_constant=constant)
        canonical(value).encode()
    except json.JSONDecodeError:
        return None, ["$: not JSON"]
    except UnicodeEncodeError:
        return None, ["$: unpaired surrogate"]
    except ValueError:
        return None, ["$: number out of range"]
    return value, repeated[:1]


def canonical(value) -> str:
    """JSON with sorted keys, no spaces and plain Unicode: one text for equal values of ``parsed``."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """Where a JSON value breaks a schema: type, enum, minimum, maximum, minLength, required,
    properties, additionalProperties (false) and items are understood."""
    out: list[str] = []
    kind = schema.get("type")
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "integer":
        right = number and (isinstance(value, int) or value.is_integer())
    elif kind == "number":
        right = number
    else:
        right = kind is None or isinstance(value, _TYPES[kind])
    if not right:
        return [f"{at}: not {kind}"]
    if "enum" in schema and not any(canonical(value) == canonical(x) for x in schema["enum"]):
        out.append(f"{at}: not in enum")
    if number:
        if "minimum" in schema and value < schema["minimum"]:
            out.append(f"{at}: below {schema['minimum']}")
        if "maximum" in schema and value > schema["maximum"]:
            out.append(f"{at}: above {schema['maximum']}")
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        out.append(f"{at}: shorter than {schema['minLength']}")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, x in value.items():
            if k in known:
                out += violations(x, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: not allowed")
    return sorted(out)


def waves(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, wave): sorted by (wave, turn, call_id), every call comes after those it uses;
    wave is null on a cycle and behind one.

    ``calls`` has (conv_id, call_id, turn), distinct ids; ``edges`` (conv_id, call_id, uses) between them. Where all
    uses lie before their call, the turns are such an order and all waves are 0. Other
    conversations are peeled: each round takes the calls whose uses are all taken."""
    ids = ["conv_id", "call_id"]
    used = calls.select("conv_id", F.col("call_id").alias("uses"), F.col("turn").alias("used_turn"))
    placed = edges.join(calls, ids).join(used, ["conv_id", "uses"])
    forward = (F.col("used_turn") < F.col("turn")) | ((F.col("used_turn") == F.col("turn")) & (F.col("uses") < F.col("call_id")))
    mixed = stage(placed.filter(~F.coalesce(forward, F.lit(False))).select("conv_id").distinct(), "mixed-conversations")
    done = calls.join(mixed, "conv_id", "left_anti").select(*ids, F.lit(0).alias("wave"))
    left = stage(calls.join(mixed, "conv_id", "left_semi").select(*ids), "unordered-calls")
    open_edges = stage(edges.join(mixed, "conv_id", "left_semi"), "open-edges")
    wave = 0
    while not left.isEmpty():
        blocked = open_edges.join(left.withColumnRenamed("call_id", "uses"), ["conv_id", "uses"], "left_semi").select(*ids).distinct()
        ready = stage(left.join(blocked, ids, "left_anti"), "ready-calls")
        if ready.isEmpty():
            return done.unionByName(left.select(*ids, F.lit(None).cast("int").alias("wave")))
        done = done.unionByName(ready.select(*ids, F.lit(wave).alias("wave")))
        left = stage(left.join(ready, ids, "left_anti"), "unordered-calls")
        wave += 1
    return done


def link(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """Link ``calls`` (conv_id, turn, call_id, name, arguments, uses array<string>) with ``results``
    (conv_id, turn, call_id, content). One row per distinct call, and one per result id without a call:

    (conv_id, call_id, turn, wave, status, name, valid, problems, n_results, canonical)

    status is linked, unanswered, cycle or orphan (a result without a call). valid says whether the arguments
    are JSON that meets the tool's schema and all used calls exist; problems lists what is wrong. Of calls
    repeated under one id the first by turn, then name and arguments counts; of results too, and n_results
    says how many there are. Rows without a conversation or call id are left out: nothing can link them. A null
    text is a null result. Empty tables give an empty result; further columns are ignored."""
    ids = ["conv_id", "call_id"]
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    calls = calls.filter(known).groupBy(*ids).agg(F.min(F.struct("turn", "name", "arguments", "uses")).alias("c"))
    calls = stage(calls.select(*ids, "c.*"), "calls")
    answers = results.filter(known).groupBy(*ids).agg(
        F.min(F.struct(F.col("turn").alias("result_turn"), "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    edges = calls.select(*ids, F.explode(F.array_distinct("uses")).alias("uses")).filter("uses is not null")
    there = calls.select("conv_id", F.col("call_id").alias("uses"))
    edges = stage(edges.join(there.withColumn("there", F.lit(True)), ["conv_id", "uses"], "left"), "uses")
    order = waves(calls.select(*ids, "turn"), edges.filter("there").select(*ids, "uses"))
    unknown = edges.filter("there is null").groupBy(*ids).agg(F.array_sort(F.collect_set("uses")).alias("unknown"))
    both = calls.withColumn("is_call", F.lit(True)).join(answers.hint("shuffle_hash"), ids, "full")
    both = both.join(order, ids, "left").join(unknown, ids, "left")
    rows = both.select(
        *ids, F.coalesce("turn", "r.result_turn").alias("turn"), "wave",
        F.when(F.col("is_call").isNull(), "orphan").when(F.col("wave").isNull(), "cycle").when(
            F.col("r").isNull(), "unanswered").otherwise("linked").alias("status"),
        "name", "arguments", F.array_sort(F.array_distinct("uses")).alias("uses"), "unknown",
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), F.col("r.content").alias("content"))
    return _serialised(rows, schemas)


def _serialised(rows: DataFrame, schemas: dict) -> DataFrame:
    fields = {f.name: f for f in rows.schema.fields}
    schema = StructType([fields[n] for n in ("conv_id", "call_id", "turn", "wave", "status", "name")]
                        + StructType.fromDDL("valid boolean, problems array<string>, n_results long, canonical string").fields)
    arrow = to_arrow_schema(schema)

    def one(r: dict) -> dict:
        problems = [f"uses {u}: no such call" for u in r["unknown"] or []]
        arguments = None
        if r["status"] != "orphan":
            arguments, unreadable = parsed(r["arguments"])
            problems += unreadable
            if r["name"] not in schemas:
                problems.append("no such tool")
            elif unreadable in ([], ["$: repeated key"]):
                problems += violations(arguments, schemas[r["name"]])
        record = {"conversation": r["conv_id"], "id": r["call_id"], "name": r["name"], "arguments": arguments,
                  "uses": r["uses"] or [], "result": r["content"], "status": r["status"]}
        return {k: r[k] for k in ("conv_id", "call_id", "turn", "wave", "status", "name", "n_results")} | {
            "valid": not problems and r["status"] != "orphan", "problems": problems, "canonical": canonical(record)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [one(r) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in out], f.type) for f in arrow], schema=arrow)

    return rows.mapInArrow(run, schema)


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that turns of ``conversations`` (conv_id, turn, role, text) stand for.

    A user turn is a call, whose tool and arguments follow from its text, and an assistant turn is the result of
    the turn before it. Half of the calls use the call two turns earlier, some one two turns later."""
    text = F.coalesce(F.col("text"), F.lit(""))
    pick = F.crc32(text.cast("binary"))

    def ident(shift: int):
        return F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), (F.col("turn") + shift).cast("string"))

    name = F.element_at(F.array(*[F.lit(x) for x in ("search", "lookup", "measure")]), (pick % 3 + 1).cast("int"))
    words = F.size(F.split(text, " "))
    arguments = F.when(name == "search", F.to_json(F.struct(text.alias("query"), (words % 64).alias("limit")))).when(
        name == "lookup", F.to_json(F.struct(text.alias("key"), (words % 2 == 0).alias("exact"), F.split(
            F.lit("title,body"), ",").alias("fields")))).otherwise(F.to_json(F.struct(
                text.alias("text"), F.when(words % 5 == 0, "lines").otherwise("words").alias("unit"), (words / 2).alias("scale"))))
    uses = F.when(pick % 16 == 1, F.array(ident(2))).when(pick % 2 == 0, F.array(ident(-2))).otherwise(
        F.array().cast("array<string>"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    rows = conversations.filter(known)
    calls = rows.filter("role = 'user'").select("conv_id", "turn", ident(0).alias("call_id"), name.alias("name"),
                                                arguments.alias("arguments"), uses.alias("uses"))
    results = rows.filter("role = 'assistant'").select("conv_id", "turn", ident(-1).alias("call_id"), F.col("text").alias("content"))
    return calls, results
