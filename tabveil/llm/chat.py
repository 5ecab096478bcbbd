"""Chat formatting with tool-call linking; DataFrame functions only.

A message of the role assistant whose text is a JSON object with ``tool_calls`` (each with id, name and arguments)
makes calls; one of the role tool whose text has ``tool_call_id`` is a result. Calls and results of a conversation
are hash-joined by identifier, each call with the first later result. A call depends on the calls of its conversation
whose id its arguments name as ``"$id"``; its level is one more than the highest level of those, found round by
round; calls on or behind a cycle have none. Arguments are checked against the required names and types of schemas: a
table of them, or else those that a system message of the conversation declares (a JSON object with ``tools``, each with
name and parameters as JSON schema; of two declarations the earlier counts). Arguments of undeclared functions need only be an object.
Each message becomes one line of canonical JSON: keys in order, no spaces, calls in order of level and id.

One row for each message, so that a conversation of any length, or one that holds a third of all messages, is no
task's burden; only joins by identifier deal rows out, and those of single hot keys are split by Spark.

Cases: null texts are empty, null roles "unknown", null conv_ids and turns stay null and link with nothing; text that
is no such JSON is plain content; repeated calls of an id share result, level and validity of the first (of ties of turn, the
smaller name and arguments); repeated rows and ties of turn keep a line each; an empty table gives an empty result; texts
and chains of calls of any length are taken whole; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabveil.llm.common import only, whole_number, written

CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string>>>"
TOOLS = "struct<tools:array<struct<name:string,parameters:struct<required:array<string>,properties:map<string,struct<type:string>>>>>>"
#: How an argument of each JSON schema type looks as text.
TYPES = {"integer": r"^-?[0-9]+$", "number": r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$", "boolean": "^(true|false)$", "string": r"(?s)^.*$", "object": r"(?s)^\{.*\}$", "array": r"(?s)^\[.*\]$"}


def messages(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, calls (array, maybe empty), result_of (null: no result)."""
    plain = whole_number(whole_number(only(rows, conv_id="conv_id", turn="turn", role="role", text="text"), "conv_id"), "turn")
    plain = plain.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    maybe = F.col("text").rlike(r"^\s*\{")
    calls = F.when((F.col("role") == "assistant") & maybe, F.from_json("text", CALLS)["tool_calls"])
    calls = F.filter(F.coalesce(calls, F.array().cast("array<struct<id:string,name:string,arguments:string>>")), lambda c: c["id"].isNotNull())
    return plain.withColumns({"calls": calls, "result_of": F.when((F.col("role") == "tool") & maybe, F.get_json_object("text", "$.tool_call_id"))})


def declared(found: DataFrame) -> DataFrame:
    """(conv_id, name, required, types) of the functions that system messages declare."""
    tools = found.where((F.col("role") == "system") & F.col("text").rlike(r"^\s*\{")).select("conv_id", "turn", F.explode(F.from_json("text", TOOLS)["tools"]).alias("t"))
    types = F.transform_values(F.coalesce("t.parameters.properties", F.create_map().cast("map<string,struct<type:string>>")), lambda k, v: v["type"])
    required = F.coalesce("t.parameters.required", F.array().cast("array<string>"))
    # Maps have no order; their entries, sorted, do.
    tools = tools.where("conv_id is not null").select("conv_id", "turn", F.col("t.name").alias("name"), F.struct(required.alias("required"), F.array_sort(F.map_entries(types)).alias("types")).alias("s"))
    first = tools.groupBy("conv_id", "name").agg(F.min_by("s", F.struct("turn", "s")).alias("s"))
    return first.select("conv_id", "name", F.col("s.required").alias("required"), F.map_from_entries("s.types").alias("types"))


def linked(found: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """(conv_id, id, level, result_turn, valid, name) of each call id. schemas: (name, required array<string>, types map<string,string>)."""
    calls = found.where("size(calls) > 0").select("conv_id", "turn", F.explode("calls").alias("c"))
    first = F.min_by("c", F.struct("turn", "c.name", "c.arguments"))
    calls = calls.groupBy("conv_id", F.col("c.id").alias("id")).agg(F.min("turn").alias("turn"), first.alias("c")).select("conv_id", "id", "turn", "c.name", "c.arguments")
    calls = written(calls, "calls")
    results = found.where("result_of is not null").select("conv_id", F.col("result_of").alias("id"), F.col("turn").alias("at"))
    answered = calls.select("conv_id", "id", "turn").join(results, ["conv_id", "id"]).where("at > turn").groupBy("conv_id", "id").agg(F.min("at").alias("result_turn"))
    named = F.transform(F.regexp_extract_all("arguments", F.lit(r'"\$([^"\\]+)"'), F.lit(1)), lambda x: x)
    needs = calls.select("conv_id", F.col("id").alias("later"), F.explode(F.array_distinct(named)).alias("id"))
    needs = written(needs.join(calls.select("conv_id", "id"), ["conv_id", "id"]).select("conv_id", "id", "later"), "needs")
    level = calls.select("conv_id", "id").join(needs.select("conv_id", F.col("later").alias("id")).distinct(), ["conv_id", "id"], "left_anti").withColumn("level", F.lit(0))
    level = new = written(level, "levels")
    k = 0
    while not new.isEmpty():  # the last need that gets its level makes a call ready
        k += 1
        met = needs.join(new.select("conv_id", "id"), ["conv_id", "id"]).select("conv_id", "later").distinct()
        open_ = needs.join(met, ["conv_id", "later"]).join(level.select("conv_id", "id", "level"), ["conv_id", "id"], "left")
        ready = open_.groupBy("conv_id", "later").agg(F.count_if(F.col("level").isNull()).alias("wait")).where("wait = 0")
        new = written(ready.select("conv_id", F.col("later").alias("id"), F.lit(k).alias("level")), "levels")
        level = level.union(new) if k % 20 else written(level.union(new), "levels")
    out = calls.join(answered, ["conv_id", "id"], "left").join(level, ["conv_id", "id"], "left")
    given = schemas.select("name", "required", "types") if schemas is not None else declared(found)
    out = out.join(given, "name" if schemas is not None else ["conv_id", "name"], "left").withColumn("values", F.from_json("arguments", "map<string,string>"))
    kind = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    of = lambda key: F.when(F.map_contains_key("types", key), F.coalesce(kind[F.col("types")[key]], F.lit("(?s)^.*$")))
    typed = F.forall(F.map_entries("values"), lambda e: F.coalesce(F.regexp_like(e["value"], of(e["key"])), F.lit(False)))
    fits = F.col("values").isNotNull() & F.forall("required", lambda r: F.coalesce(F.map_contains_key("values", r), F.lit(False))) & typed
    plain = F.expr("try_parse_json(arguments) is not null and json_object_keys(arguments) is not null")
    valid = plain & F.when(F.col("types").isNotNull(), fits).otherwise(F.lit(schemas is None))
    return out.select("conv_id", "id", "name", "level", "result_turn", F.coalesce(valid, F.lit(False)).alias("valid"))


def formatted(rows: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """conv_id, turn, role, line, n_calls, n_linked, n_valid, result_of."""
    found = messages(rows)
    with_calls = found.where("size(calls) > 0").select("conv_id", "turn", "text", F.explode(F.array_distinct("calls")).alias("c"))
    links = linked(found, schemas)
    rich = with_calls.join(links.withColumnRenamed("id", "cid"), with_calls["conv_id"].eqNullSafe(links["conv_id"]) & (F.col("c.id") == F.col("cid")), "left").select(with_calls["conv_id"], "turn", "text", "c", "level", "result_turn", "valid")
    # Canonical: the parsed value writes its keys in order; arguments that are no JSON stay a string.
    arguments = F.expr("coalesce(to_json(try_parse_json(c.arguments)), to_json(named_struct('x', c.arguments)))")
    call = F.concat(F.lit('{"arguments":'), arguments, F.lit(',"id":'), _quoted(F.col("c.id")), F.lit(',"level":'), F.coalesce(F.col("level").cast("string"), F.lit("null")), F.lit(',"name":'), _quoted(F.coalesce("c.name", F.lit(""))), F.lit(',"result_turn":'), F.coalesce(F.col("result_turn").cast("string"), F.lit("null")), F.lit(',"valid":'), F.coalesce(F.col("valid").cast("string"), F.lit("false")), F.lit("}"))
    per = rich.select("conv_id", "turn", F.xxhash64("text").alias("key"), F.struct(F.coalesce("level", F.lit(1 << 30)).alias("level"), F.col("c.id").alias("id"), call.alias("json"), F.col("result_turn").isNotNull().alias("linked"), F.coalesce("valid", F.lit(False)).alias("valid")).alias("call"))
    per = per.groupBy("conv_id", "turn", "key").agg(F.array_sort(F.collect_set("call")).alias("linked_calls"))
    found = found.withColumn("key", F.xxhash64("text"))
    on = found["conv_id"].eqNullSafe(per["conv_id"]) & found["turn"].eqNullSafe(per["turn"]) & (found["key"] == per["key"])
    out = found.join(per, on, "left").select(found["conv_id"], found["turn"], "role", "text", "result_of", F.coalesce("linked_calls", F.array().cast(per.schema["linked_calls"].dataType)).alias("own"))
    plain = F.concat(F.lit('{"content":'), _quoted(F.col("text")), F.lit(',"role":'), _quoted(F.col("role")), F.lit("}"))
    answer = F.concat(F.lit('{"content":'), _quoted(F.coalesce(F.get_json_object("text", "$.content"), F.lit(""))), F.lit(',"role":"tool","tool_call_id":'), _quoted(F.col("result_of")), F.lit("}"))
    asked = F.concat(F.lit('{"content":'), _quoted(F.coalesce(F.get_json_object("text", "$.content"), F.lit(""))), F.lit(',"role":"assistant","tool_calls":['), F.array_join(F.transform("own", lambda c: c["json"]), ","), F.lit("]}"))
    line = F.when(F.size("own") > 0, asked).when(F.col("result_of").isNotNull(), answer).otherwise(plain)
    return out.select("conv_id", "turn", "role", line.alias("line"), F.size("own").cast("long").alias("n_calls"), F.size(F.filter("own", lambda c: c["linked"])).cast("long").alias("n_linked"), F.size(F.filter("own", lambda c: c["valid"])).cast("long").alias("n_valid"), "result_of")


def _quoted(text: Column) -> Column:
    """A JSON string."""
    whole = F.to_json(F.struct(text.alias("x")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


SQL = """
SELECT conv_id, turn, coalesce(role, 'unknown') AS role,
  '{"content":' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || ',"role":' || CAST(to_json(coalesce(role, 'unknown')) AS VARCHAR) || '}' AS line,
  CAST(CASE WHEN role = 'assistant' AND json_valid(text) THEN coalesce(json_array_length(text, '$.tool_calls'), 0) ELSE 0 END AS BIGINT) AS n_calls,
  CAST(0 AS BIGINT) AS n_linked, CAST(0 AS BIGINT) AS n_valid, CASE WHEN role = 'tool' AND json_valid(text) THEN json_extract_string(text, '$.tool_call_id') END AS result_of
FROM conversations
"""
