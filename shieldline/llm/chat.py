"""Chat formatting: linking tool calls and results.

Calls and results meet in a hash join on (conversation, identifier).  Calls are
put in topological order of their dependencies, arguments are validated against
the tool's JSON schema, and each linked call is serialised as canonical JSON
(keys sorted by UTF-16 units, no blanks, numbers as ECMAScript writes them).

Order: a call that depends on earlier turns only keeps its turn.  A call whose
dependency comes at a later turn is moved behind it, round by round, until
nothing changes; each round is a join over the edges concerned.  Calls in or
behind a cycle are told apart beforehand (by taking away, round by round, calls
without open dependencies) and stay at their turn with status ``cycle``.

Defined results: a call without a result is ``pending``; a result without a
call is ``orphan`` and comes last; of repeated calls or results of one
identifier the earliest counts (then the least text) and the rest are
``repeated``; null or invalid JSON arguments are ``invalid`` (so are those too
deep to read, with a number beyond a double, or half a surrogate pair); a tool
without a schema is ``unknown``, one with a schema that is null, invalid or holds
keywords that are not checked is ``unsupported``; dependencies on missing calls
are ignored.  Very long arguments are read whole.  Other columns are not looked
at, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shieldline.llm.tables import numbered, written

#: Bytes of schemas that are shipped to every task.
SCHEMA_BYTES = 16 << 20


def _number(x: float | int) -> str:
    """A JSON number as ECMAScript prints the double."""
    if isinstance(x, int) and abs(x) < 1 << 53:
        return str(x)
    try:
        x = float(x)
    except OverflowError:
        x = math.inf
    if math.isnan(x) or math.isinf(x):
        raise ValueError("not a JSON number")
    if x == 0:
        return "0"
    sign, text = "-" * (x < 0), repr(abs(x))
    mantissa, _, exp = text.partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    digits = (whole + part).lstrip("0")
    point = len(whole) + int(exp or 0) - (len(whole + part) - len((whole + part).lstrip("0")))
    digits = digits.rstrip("0")
    n = len(digits)
    if n <= point <= 21:
        return sign + digits + "0" * (point - n)
    if 0 < point <= 21:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    e = f"{'+' if point > 0 else '-'}{abs(point - 1)}"
    return f"{sign}{digits[0]}{'.' + digits[1:] if n > 1 else ''}e{e}"


def canonical(x) -> str:
    """Canonical JSON of a parsed value."""
    if x is None or isinstance(x, bool):
        return {None: "null", True: "true", False: "false"}[x]
    if isinstance(x, int | float):
        return _number(x)
    if isinstance(x, str):
        return json.dumps(x, ensure_ascii=False)
    if isinstance(x, dict):
        keys = sorted(x, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(x[k])}" for k in keys) + "}"
    return "[" + ",".join(map(canonical, x)) + "]"


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(x, kind: str) -> bool:
    if kind == "integer":
        return isinstance(x, int) and not isinstance(x, bool) or isinstance(x, float) and x.is_integer()
    if kind == "number":
        return isinstance(x, int | float) and not isinstance(x, bool)
    return isinstance(x, _TYPES.get(kind, ()))


def _same(x, y) -> bool:
    """Equality of JSON values: true is not 1, but 1.0 is."""
    if isinstance(x, bool) or isinstance(y, bool):
        return x is y
    if isinstance(x, dict) and isinstance(y, dict):
        return x.keys() == y.keys() and all(_same(x[k], y[k]) for k in x)
    if isinstance(x, list) and isinstance(y, list):
        return len(x) == len(y) and all(map(_same, x, y))
    return x == y


def _meant(ref: str, root) -> dict | bool:
    """What a reference within the schema (``#/...``) stands for."""
    if not ref.startswith("#"):
        raise LookupError(ref)
    at = root
    for part in ref[1:].split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        at = at[int(part)] if isinstance(at, list) else at[part]
    return at


#: Keywords that constrain values and are not checked: a schema with one has the status ``unsupported``.
UNCHECKED = frozenset("if then else dependentSchemas dependentRequired dependencies contains minContains maxContains prefixItems propertyNames "
                      "unevaluatedItems unevaluatedProperties $dynamicRef $recursiveRef additionalItems".split())


def unchecked(schema) -> bool:
    """Whether a schema has a keyword that ``faults`` does not check."""
    if isinstance(schema, list):
        return any(map(unchecked, schema))
    if not isinstance(schema, dict):
        return False
    if not UNCHECKED.isdisjoint(schema) or isinstance(schema.get("items"), list) or not str(schema.get("$ref", "#")).startswith("#"):
        return True
    inner = [schema[k] for k in ("anyOf", "oneOf", "allOf", "not", "items", "additionalProperties") if k in schema]
    for k in ("properties", "patternProperties", "$defs", "definitions"):
        inner += schema[k].values() if isinstance(schema.get(k), dict) else []
    return any(map(unchecked, inner))


def faults(x, schema, at: str = "$", root=None) -> list[str]:
    """Where a value breaks a JSON schema: type, enum, const, bounds, multiples,
    lengths, patterns, unique and other items, required, named, matched and other
    properties, anyOf, oneOf, allOf, not, and references within the schema."""
    root = schema if root is None else root
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: not allowed"]
    out = []
    if "$ref" in schema:
        out += faults(x, _meant(schema["$ref"], root), at, root)
    kinds = schema.get("type")
    if kinds is not None and not any(_is(x, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [*out, f"{at}: type"]
    if "enum" in schema and not any(_same(x, y) for y in schema["enum"]) or "const" in schema and not _same(x, schema["const"]):
        out.append(f"{at}: value")
    if _is(x, "number"):
        if (x < schema.get("minimum", x) or x > schema.get("maximum", x) or "exclusiveMinimum" in schema and x <= schema["exclusiveMinimum"]
                or "exclusiveMaximum" in schema and x >= schema["exclusiveMaximum"]):
            out.append(f"{at}: bounds")
        if "multipleOf" in schema and Fraction(x) % Fraction(str(schema["multipleOf"])) and Fraction(str(x)) % Fraction(str(schema["multipleOf"])):
            out.append(f"{at}: multiple")
    if isinstance(x, str | list):
        lo, hi = ("minLength", "maxLength") if isinstance(x, str) else ("minItems", "maxItems")
        if not schema.get(lo, 0) <= len(x) <= schema.get(hi, len(x)):
            out.append(f"{at}: length")
    if isinstance(x, str) and "pattern" in schema and not re.search(schema["pattern"], x):
        out.append(f"{at}: pattern")
    if isinstance(x, dict):
        own, matched = schema.get("properties", {}), schema.get("patternProperties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in x]
        if not schema.get("minProperties", 0) <= len(x) <= schema.get("maxProperties", len(x)):
            out.append(f"{at}: length")
        rest = schema.get("additionalProperties", True)
        for k in sorted(x):
            rules = [own[k]] if k in own else []
            rules += [r for p, r in matched.items() if re.search(p, k)]
            if not rules and rest is False:
                out.append(f"{at}.{k}: unexpected")
            for rule in rules or [rest]:
                out += faults(x[k], rule, f"{at}.{k}", root) if rule is not False or rules else []
    if isinstance(x, list):
        if "items" in schema:
            for i, y in enumerate(x):
                out += faults(y, schema["items"], f"{at}[{i}]", root)
        if schema.get("uniqueItems") and len({canonical(y) for y in x}) < len(x):
            out.append(f"{at}: repeated items")
    for part in schema.get("allOf", []):
        out += faults(x, part, at, root)
    if "anyOf" in schema and all(faults(x, part, at, root) for part in schema["anyOf"]):
        out.append(f"{at}: anyOf")
    if "oneOf" in schema and sum(not faults(x, part, at, root) for part in schema["oneOf"]) != 1:
        out.append(f"{at}: oneOf")
    if "not" in schema and not faults(x, schema["not"], at, root):
        out.append(f"{at}: not")
    return out


def _strict(text: str):
    def refuse(s: str):
        raise ValueError(s)

    return json.loads(text, parse_constant=refuse)


def parsed_schemas(rows: dict[str | None, str | None]) -> dict:
    """Schemas by name; a name with a null, invalid or unchecked one has None."""
    out = {}
    for name, text in rows.items():
        try:
            schema = _strict(text)
            fits = isinstance(schema, dict | bool) and not unchecked(schema)
        except (TypeError, ValueError, RecursionError):
            fits = False
        out[name] = schema if fits else None
    return out


def checked(arguments: str | None, name: str | None, schemas: dict) -> tuple[object, list[str], str]:
    """(value, faults, ``valid`` / ``invalid`` / ``unknown`` / ``unsupported``) of
    the arguments of a call.  Text that is no JSON, nested too deeply, or holds a
    number beyond a double or half a surrogate pair, has no canonical form: it is
    invalid, with a null value."""
    try:
        value = _strict(arguments)
        canonical(value).encode()
    except (TypeError, ValueError, RecursionError):
        return None, ["$: not JSON"], "invalid"
    if name not in schemas:
        return value, [], "unknown"
    if schemas[name] is None:
        return value, [], "unsupported"
    try:
        wrong = faults(value, schemas[name])
    except (RecursionError, LookupError, TypeError, ValueError, AttributeError, ZeroDivisionError, re.error):
        return value, [], "unsupported"  # the schema itself is at fault
    return value, wrong, "invalid" if wrong else "valid"


def _first(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row per (conv_id, call_id), the least by turn and then by content,
    with the number of rows there were.  Keys meet after a partial aggregation,
    so a key that fills a third of all rows reaches its task as a few rows."""
    return df.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", *cols)).alias("_x"), F.count("*").alias("_n")).select(
        "conv_id", "call_id", "_x.*", "_n")


def topological(calls: DataFrame) -> DataFrame:
    """``calls`` (conv_id, call_id, turn, depends) with _turn, _step, cycle: sorted
    by (_turn, _step, turn, call_id), each call follows what it depends on."""
    key = ["conv_id", "call_id"]
    nodes = calls.select(*key, "turn")
    edges = (calls.select(*key, "turn", F.explode("depends").alias("on"))
             .join(nodes.select("conv_id", F.col("call_id").alias("on"), F.col("turn").alias("on_turn")), ["conv_id", "on"])
             .select(*key, "turn", "on", "on_turn").distinct())
    late = edges.where(F.struct("on_turn", "on") >= F.struct("turn", "call_id")).select("conv_id").distinct()
    plain = {"_turn": F.col("turn"), "_step": F.lit(0), "cycle": F.lit(False)}
    if not late.take(1):
        return calls.withColumns(plain)
    edges = written(edges.join(late, "conv_id", "left_semi"), "call-edges")
    # calls of cycles, and behind them: what is left when no call without open dependencies remains
    open_ = edges
    while (before := open_.count()):
        rest = open_.join(open_.select("conv_id", F.col("call_id").alias("on")).distinct(), ["conv_id", "on"], "left_semi")
        rest = written(rest.select(edges.columns), "call-cycles")
        if rest.count() == before:
            break
        open_ = rest
    stuck = open_.select(*key).distinct().withColumn("cycle", F.lit(True))
    edges = written(edges.join(stuck, key, "left_anti"), "call-edges")
    place = nodes.join(late, "conv_id", "left_semi").select(*key, "turn", F.col("turn").alias("_turn"), F.lit(0).alias("_step"))
    place = written(place, "call-places")
    while True:
        on = place.select("conv_id", F.col("call_id").alias("on"), F.struct("_turn", (F.col("_step") + 1).alias("_step")).alias("_p"))
        need = edges.join(on, ["conv_id", "on"]).groupBy(*key).agg(F.max("_p").alias("_p"))
        moved = place.join(need, key, "left").withColumn("_new", F.greatest(F.struct("_turn", "_step"), F.col("_p")))
        moved = moved.select(*key, "turn", F.col("_new._turn").alias("_turn"), F.col("_new._step").alias("_step"),
                             (F.col("_new") != F.struct("_turn", "_step")).alias("_moved"))
        moved = written(moved, "call-places")
        place = moved.drop("_moved")
        if not moved.where("_moved").take(1):
            break
    found = calls.join(place.drop("turn"), key, "left").join(stuck, key, "left")
    return found.withColumns({"_turn": F.coalesce("_turn", "turn"), "_step": F.coalesce("_step", F.lit(0)), "cycle": F.coalesce("cycle", F.lit(False))})


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per identifier: conv_id, call_id, name, position (from 0, in
    topological order, orphans last), status, n_calls, n_results, faults (where
    the arguments break the schema) and message, its canonical JSON.

    calls: conv_id, call_id, turn, name, arguments (JSON text), depends (array
    of call ids); results: conv_id, call_id, turn, content; schemas: name,
    schema (JSON text).  Other columns are not looked at."""
    spark = calls.sparkSession
    calls = _first(calls.select("conv_id", "call_id", "turn", "name", "arguments", "depends"), ["name", "arguments", "depends"])
    calls = topological(calls).withColumnsRenamed({"_n": "n_calls"})
    results = _first(results.select("conv_id", "call_id", "turn", "content"), ["content"])
    results = results.select("conv_id", "call_id", F.col("turn").alias("result_turn"), F.col("content").alias("result"), F.col("_n").alias("n_results"))
    same = calls.conv_id.eqNullSafe(results.conv_id) & calls.call_id.eqNullSafe(results.call_id)
    linked = calls.alias("c").join(results.alias("r"), same, "full").select(
        F.coalesce("c.conv_id", "r.conv_id").alias("conv_id"), F.coalesce("c.call_id", "r.call_id").alias("call_id"),
        "name", "arguments", "turn", "_turn", "_step", "cycle", "result", "result_turn",
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"))
    linked = linked.withColumns({"orphan": F.col("n_calls") == 0, "_turn": F.coalesce("_turn", "result_turn")})
    placed = numbered(linked, ["conv_id"], ["orphan", "_turn", "_step", "turn", "call_id"], "position")

    size = schemas.agg(F.sum(F.octet_length("schema"))).first()[0] or 0
    if size > SCHEMA_BYTES:
        raise ValueError(f"{size} bytes of schemas; at most {SCHEMA_BYTES} are shipped to every task")
    known = spark.sparkContext.broadcast({r.name: r.schema for r in schemas.select("name", "schema").toLocalIterator()})

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parsed = parsed_schemas(known.value)
        for f in frames:
            status, broken, messages = [], [], []
            for r in f.itertuples(index=False):
                value, wrong, kind = (None, [], "") if r.orphan else checked(r.arguments, r.name, parsed)
                status.append("orphan" if r.orphan else "cycle" if r.cycle else kind if kind != "valid"
                              else "repeated" if max(r.n_calls, r.n_results) > 1 else "pending" if not r.n_results else "linked")
                broken.append(wrong)
                messages.append(canonical({"arguments": value, "id": r.call_id, "name": r.name, "position": int(r.position), "result": r.result, "status": status[-1]}))
            yield pd.DataFrame({"conv_id": f.conv_id, "call_id": f.call_id, "name": f.name, "position": f.position, "status": status,
                                "n_calls": f.n_calls, "n_results": f.n_results, "faults": broken, "message": messages})

    kinds = dict(placed.dtypes)
    return placed.mapInPandas(check, f"conv_id {kinds['conv_id']}, call_id {kinds['call_id']}, name string, position bigint, status string, "
                                     "n_calls bigint, n_results bigint, faults array<string>, message string")


#: The tools that the query reads out of ``conversations``, and their schemas.
TOOLS = [
    ("answer", {"type": "object", "required": ["prompt", "words"], "additionalProperties": False, "properties": {
        "prompt": {"type": "string", "minLength": 1}, "words": {"type": "integer", "minimum": 1, "maximum": 60}, "share": {"type": "number", "minimum": 0, "maximum": 1}}}),
    ("setup", {"type": "object", "required": ["prompt"], "properties": {"prompt": {"type": "string"}, "words": {"type": "integer"}}}),
]


def calls_of(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that turns of a chat stand for: a user or system turn
    calls the tool ``answer`` or ``setup`` with its text, and the assistant's
    next turn is the result (a turn without a role is a call).  By a hash of its
    text a call depends on the one two turns before it, on the one two turns
    later, on both, or on none: so calls have to be put in order, and some of
    them depend on each other."""
    ident = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    words = F.size(F.array_remove(F.split("text", r"\s+"), ""))
    share = F.round(F.try_divide(F.length(F.regexp_replace("text", "[^aeiou]", "")), F.length("text")), 4)
    way = F.crc32(F.coalesce("text", F.lit(""))) % 8
    before = F.when((F.col("turn") >= 2) & (way >= 4), ident(F.col("turn") - 2))
    later = F.when(way.isin(0, 1, 4), ident(F.col("turn") + 2))
    asks = turns.where("coalesce(role, '') <> 'assistant'").select(
        "conv_id", ident(F.col("turn")).alias("call_id"), "turn", F.when(F.col("role") == "system", "setup").otherwise("answer").alias("name"),
        F.to_json(F.struct(words.alias("words"), F.col("text").alias("prompt"), share.alias("share"))).alias("arguments"),
        F.array_compact(F.array(before, later)).alias("depends"))
    gives = turns.where("role = 'assistant'").select("conv_id", ident(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return asks, gives


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = calls_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    schemas = spark.createDataFrame([(n, json.dumps(s)) for n, s in TOOLS], "name string, schema string")
    return link_tool_calls(calls, results, schemas)
