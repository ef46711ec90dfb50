"""Chat formatting with tool-call linking.

A turn is a plain message, or a JSON object: an assistant's with ``tool_calls`` (id,
function name and arguments), a tool's with ``tool_call_id`` and ``content``, a
system's with ``tools`` (function name and JSON schema of its parameters).  Calls and
results are hash-joined by (conversation, identifier), arguments are checked against
the schemas of the conversation, and all items are put in topological order: an item
keeps its turn, but a call comes after the results that its arguments name
(``{"$result": id}``) and a result directly after its call.  Each item becomes one row
of canonical JSON (sorted keys, no spaces, no escapes but the needed ones).

Rows stay rows: a conversation is never gathered into one task, and positions are
counted in parts of ``PART`` turns.

Edge cases: null texts are null content; null roles and turns are kept (null turns come
first); null conv_ids form one conversation; text that is no such JSON is a plain
message; repeated rows are repeated items; of two calls with one identifier the first
is linked and the other marked ``duplicate_call``, of several results each is linked;
results without a call are ``orphan_result`` at their own turn, calls without a result
``unanswered``; calls in a cycle of references, or naming a result that is not there,
keep their own turn and are marked ``cycle`` or ``missing_reference``; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from fractions import Fraction
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, stored, table

PART = 512
#: Rounds of joins that place calls; what longer chains leave is placed by conversation.
DEEPEST = 64

ITEMS = "conv_id bigint, turn bigint, ord int, kind string, id string, name string, body string, needs array<string>, problem string"


def canonical(value: object) -> str:
    text = json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
    try:
        text.encode()
    except UnicodeEncodeError:  # half a surrogate pair
        text = json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)
    return text


def _refuse(value: str) -> None:
    raise ValueError(value)


def parsed(text: str | None) -> dict | None:
    """The JSON object that a text is, if it is one."""
    if not text or not text.lstrip().startswith("{"):
        return None
    try:
        out = json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None
    return out if isinstance(out, dict) else None


def references(value: object) -> list[str]:
    """Identifiers in {"$result": id} anywhere in a value, sorted."""
    found, todo = set(), [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            if isinstance(x.get("$result"), str):
                found.add(x["$result"])
            todo += x.values()
        elif isinstance(x, list):
            todo += x
    return sorted(found)


_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "number": (int, float), "integer": int}


#: Keywords of a schema that hold one schema, a list of schemas, or schemas by name.
_ONE = ("additionalProperties", "additionalItems", "contains", "not", "if", "then", "else", "propertyNames")
_MANY = ("anyOf", "oneOf", "allOf", "prefixItems")
_NAMED = ("properties", "patternProperties", "dependentSchemas", "$defs", "definitions")
_PLAIN = ("type", "enum", "const", "required", "items", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "minItems", "maxItems", "uniqueItems", "minContains", "maxContains", "minProperties", "maxProperties", "dependentRequired", "$ref")
_NOTES = ("title", "description", "default", "example", "examples", "format", "deprecated", "readOnly", "writeOnly", "$schema", "$id", "$comment", "contentEncoding", "contentMediaType")
_READ = {*_ONE, *_MANY, *_NAMED, *_PLAIN, *_NOTES}


def unread(schema: object, at: str = "#") -> list[str]:
    """Keywords anywhere in a schema that ``violations`` does not check."""
    if not isinstance(schema, dict):
        return []
    out = [f"{at}: unsupported {k}" for k in sorted(schema) if k not in _READ]
    for k in sorted(schema):
        x = schema[k]
        if k in _ONE or k == "items" and not isinstance(x, list):
            out += unread(x, f"{at}/{k}")
        elif k in _MANY or k == "items":
            out += [y for i, part in enumerate(x) for y in unread(part, f"{at}/{k}/{i}")]
        elif k in _NAMED:
            out += [y for name in sorted(x) for y in unread(x[name], f"{at}/{k}/{name}")]
    kinds = schema.get("type")
    out += [f"{at}: unsupported type {k}" for k in (kinds if isinstance(kinds, list) else [kinds] if kinds else []) if k not in _KINDS]
    return out


def equal(x: object, y: object) -> bool:
    """Whether two JSON values are the same; true is not 1."""
    if isinstance(x, bool) or isinstance(y, bool):
        return x is y
    if isinstance(x, list) and isinstance(y, list):
        return len(x) == len(y) and all(equal(a, b) for a, b in zip(x, y, strict=True))
    if isinstance(x, dict) and isinstance(y, dict):
        return x.keys() == y.keys() and all(equal(x[k], y[k]) for k in x)
    return x == y


def _target(root: object, ref: str) -> object:
    """The part of a schema that a local reference names."""
    if ref != "#" and not ref.startswith("#/"):
        raise LookupError(ref)
    for step in ref.split("/")[1:]:
        step = unquote(step).replace("~1", "/").replace("~0", "~")
        root = root[int(step)] if isinstance(root, list) else root[step]
    return root


def violations(value: object, schema: object) -> list[str]:
    """Where a value breaks a JSON schema, and what of the schema is not checked;
    references to results fit anywhere."""
    try:
        return unread(schema) + _breaks(value, schema, "$", schema, ())
    except (TypeError, ValueError, AttributeError, ArithmeticError, RecursionError, re.error):
        return ["schema: not valid"]


def _breaks(value: object, schema: object, at: str, root: object, refs: tuple[str, ...]) -> list[str]:
    if isinstance(value, dict) and "$result" in value:
        return []
    if schema is False:
        return [f"{at}: not allowed"]
    if not isinstance(schema, dict):
        return []
    kinds = schema.get("type")
    kinds = kinds if isinstance(kinds, list) else [kinds] if kinds else []
    fits = [isinstance(value, _KINDS[k]) and not (isinstance(value, bool) and k in ("number", "integer")) for k in kinds if k in _KINDS]
    if fits and not any(fits):
        return [f"{at}: not {'|'.join(kinds)}"]
    out = []
    inner = lambda part: _breaks(value, part, at, root, refs)
    below = lambda x, part, place: _breaks(x, part, place, root, ())
    if "enum" in schema and not any(equal(value, x) for x in schema["enum"]):
        out.append(f"{at}: not in enum")
    if "const" in schema and not equal(value, schema["const"]):
        out.append(f"{at}: const")
    if "$ref" in schema:
        ref = schema["$ref"]
        try:
            part = None if ref in refs else _target(root, ref)
        except (LookupError, TypeError, ValueError):
            part = None
        out += [f"{at}: unresolved {ref}"] if part is None else _breaks(value, part, at, root, (*refs, ref))
    for part in schema.get("allOf", ()):
        out += inner(part)
    if "anyOf" in schema and all(inner(part) for part in schema["anyOf"]):
        out.append(f"{at}: anyOf")
    if "oneOf" in schema and sum(not inner(part) for part in schema["oneOf"]) != 1:
        out.append(f"{at}: oneOf")
    if "not" in schema and not inner(schema["not"]):
        out.append(f"{at}: not")
    if "if" in schema:
        out += inner(schema.get("else" if inner(schema["if"]) else "then", True))
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        tests = {"minimum": lambda x: value < x, "maximum": lambda x: value > x, "exclusiveMinimum": lambda x: value <= x, "exclusiveMaximum": lambda x: value >= x, "multipleOf": lambda x: Fraction(str(value)) % Fraction(str(x)) != 0}
        for k, bad in tests.items():
            if k in schema and (isinstance(schema[k], bool) or bad(schema[k])):
                out.append(f"{at}: {k}")
    if isinstance(value, str):
        tests = {"minLength": lambda x: len(value) < x, "maxLength": lambda x: len(value) > x, "pattern": lambda x: not re.search(x, value)}
        out += [f"{at}: {k}" for k, bad in tests.items() if k in schema and bad(schema[k])]
    if isinstance(value, dict):
        own, like = schema.get("properties") or {}, schema.get("patternProperties") or {}
        out += [f"{at}.{k}: missing" for k in schema.get("required") or [] if k not in value]
        tests = {"minProperties": lambda x: len(value) < x, "maxProperties": lambda x: len(value) > x}
        out += [f"{at}: {k}" for k, bad in tests.items() if k in schema and bad(schema[k])]
        for k in sorted(value):
            parts = [own[k]] if k in own else []
            parts += [like[p] for p in sorted(like) if re.search(p, k)]
            for part in parts:
                out += below(value[k], part, f"{at}.{k}")
            if not parts and schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
            elif not parts:
                out += below(value[k], schema.get("additionalProperties", True), f"{at}.{k}")
            if below(k, schema.get("propertyNames", True), at):
                out.append(f"{at}.{k}: propertyNames")
            out += [f"{at}.{x}: missing" for x in (schema.get("dependentRequired") or {}).get(k, ()) if x not in value]
            out += inner((schema.get("dependentSchemas") or {}).get(k, True))
    if isinstance(value, list):
        tests = {"minItems": lambda x: len(value) < x, "maxItems": lambda x: len(value) > x, "uniqueItems": lambda x: x and any(equal(a, b) for i, a in enumerate(value) for b in value[:i])}
        out += [f"{at}: {k}" for k, bad in tests.items() if k in schema and bad(schema[k])]
        items = schema.get("items", True)
        lead, rest = (items, schema.get("additionalItems", True)) if isinstance(items, list) else (schema.get("prefixItems", []), items)
        for i, x in enumerate(value):
            out += below(x, lead[i] if i < len(lead) else rest, f"{at}[{i}]")
        if "contains" in schema:
            n = sum(not below(x, schema["contains"], at) for x in value)
            if not schema.get("minContains", 1) <= n <= schema.get("maxContains", n):
                out.append(f"{at}: contains")
    return out


def items_of(role: str | None, text: str | None) -> list[dict]:
    """The items of one turn."""
    own = parsed(text) if role in ("assistant", "tool", "system", "developer") else None
    plain = {"kind": "message", "body": canonical({"role": role, "content": text})}
    if own is None:
        return [plain]
    try:
        if role == "assistant" and isinstance(own.get("tool_calls"), list):
            out = [{"kind": "message", "body": canonical({"role": role, "content": own["content"]})}] if own.get("content") is not None else []
            for call in own["tool_calls"]:
                function = call.get("function") or call
                args = function.get("arguments")
                problem = None
                if isinstance(args, str):
                    decoded = parsed(args)
                    problem = None if decoded is not None else "arguments: not a JSON object"
                    args = decoded if decoded is not None else args
                out.append({"kind": "call", "id": str(call["id"]), "name": str(function["name"]), "body": canonical(args), "needs": references(args), "problem": problem})
            return out or [plain]
        if role == "tool" and "tool_call_id" in own:
            return [{"kind": "result", "id": str(own["tool_call_id"]), "body": canonical(own.get("content"))}]
        if role in ("system", "developer") and isinstance(own.get("tools"), list):
            out = [{"kind": "message", "body": canonical({"role": role, "content": own.get("content"), "tools": own["tools"]})}]
            for tool in own["tools"]:
                function = tool.get("function") or tool
                out.append({"kind": "tool", "name": str(function["name"]), "body": canonical(function.get("parameters") or {})})
            return out
    except (AttributeError, KeyError, TypeError, ValueError, RecursionError):
        pass
    return [plain]


def _items(turns: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"conv_id": pa.int64(), "turn": pa.int64(), "ord": pa.int32(), "kind": pa.string(), "id": pa.string(), "name": pa.string(), "body": pa.string(), "needs": pa.list_(pa.string()), "problem": pa.string()}
        for batch in batches:
            rows = []
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [{"conv_id": conv, "turn": turn, "ord": k, **x} for k, x in enumerate(items_of(role, text))]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in kinds.items()], list(kinds))

    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, ITEMS)


def _checked(calls: DataFrame) -> DataFrame:
    """Adds ``problems`` to calls that have a ``schema`` beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            found = []
            for body, schema, problem in zip(*(batch.column(at(k)).to_pylist() for k in ("body", "schema", "problem")), strict=True):
                bad = [problem] if problem else [] if schema is None else violations(json.loads(body), json.loads(schema))
                found.append(["name: no such tool"] if schema is None and not problem else bad)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], [*batch.schema.names, "problems"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in calls.schema)
    return calls.mapInArrow(run, kinds + ", problems array<string>")


def _rest(state: DataFrame, edges: DataFrame) -> DataFrame:
    """``state`` with the calls placed that are not done: a task takes the identifiers and
    references of a conversation's calls that are left, never their texts.  What is not
    done after it is in a cycle, or waits for one."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        where = {r["id"]: k for k, r in enumerate(rows)}
        waits = [len(r["waits"]) for r in rows]
        next_of: list[list[int]] = [[] for _ in rows]
        for k, r in enumerate(rows):
            for need in r["waits"]:
                next_of[where[need]].append(k)
        todo = [k for k, n in enumerate(waits) if not n]
        rank = lambda p: (p["_at"] is not None, p["_at"] or 0, p["_level"])
        for k in todo:  # grows
            r = rows[k]
            r["done"], last = True, r["last"]
            if last and last["_at"] is not None and r["turn"] is not None and last["_at"] >= r["turn"]:
                r["at"], r["level"] = last["_at"], last["_level"] + 1
            for j in next_of[k]:
                own = {"_at": r["at"], "_level": r["level"]}
                rows[j]["last"] = max(own, rows[j]["last"] or own, key=rank)
                waits[j] -= 1
                if not waits[j]:
                    todo.append(j)
        kinds = {"conv_id": pa.int64(), "id": pa.string(), "turn": pa.int64(), "at": pa.int64(), "level": pa.int32(), "done": pa.bool_(), "loop": pa.string()}
        return pa.table({k: pa.array([r[k] for r in rows], t) for k, t in kinds.items()})

    of = state.select(F.col("conv_id").alias("_c"), F.col("id").alias("_n"), F.col("at").alias("_at"), F.col("level").alias("_level"), F.col("done").alias("_done"))
    needs = edges.join(of, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("need") == F.col("_n"))).groupBy(F.col("conv_id").alias("_c"), F.col("id").alias("_i"))
    needs = needs.agg(F.collect_set(F.when(~F.col("_done"), F.col("need"))).alias("waits"), F.max(F.when(F.col("_done"), F.struct("_at", "_level"))).alias("last"))
    left = state.where("not done").join(needs, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("id") == F.col("_i"))).drop("_c", "_i")
    found = left.groupBy("conv_id").applyInArrow(run, "conv_id bigint, id string, turn bigint, at bigint, level int, done boolean, loop string")
    return state.where("done").unionByName(found)


def _in_order(state: DataFrame, edges: DataFrame) -> DataFrame:
    """``state`` with the calls done that come after all that they refer to, and so on down.

    A call moves, or is in a cycle, only if a reference on the way to it goes to a call of its
    own turn or a later one; what is not behind such a reference stays where it is, however
    long its chain of references.
    """
    of = state.select(F.col("conv_id").alias("_c"), F.col("id").alias("_n"), F.col("turn").alias("_turn"))
    links = edges.where("not missing").join(of, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("need") == F.col("_n"))).select("conv_id", "id", "need", "_turn")
    own = state.where("not done").select(F.col("conv_id").alias("_w"), F.col("id").alias("_x"), F.col("turn").alias("_own"))
    links = links.join(own, F.col("conv_id").eqNullSafe(F.col("_w")) & (F.col("id") == F.col("_x"))).drop("_w", "_x")
    forward = F.coalesce(F.col("_turn") < F.col("_own"), F.lit(False))
    links = stored(links.select(F.col("conv_id").alias("conv"), "id", "need", forward.alias("forward")), "links")
    moved = stored(links.where("not forward").select(F.col("conv").alias("_w"), F.col("id").alias("_x")).distinct(), "moved")
    front, rounds = moved, 0
    while rounds < DEEPEST and front.head(1):
        near = links.join(front, F.col("conv").eqNullSafe(F.col("_w")) & (F.col("need") == F.col("_x")), "left_semi").select(F.col("conv").alias("_a"), F.col("id").alias("_b")).distinct()
        front = near.join(moved, F.col("_a").eqNullSafe(F.col("_w")) & (F.col("_b") == F.col("_x")), "left_anti").select(F.col("_a").alias("_w"), F.col("_b").alias("_x"))
        front = stored(front, "moved")
        moved, rounds = stored(moved.union(front), "moved"), rounds + 1
    if front.head(1):  # a chain this long: all of its conversation is placed in rounds
        whole = moved.select(F.col("_w").alias("_v")).distinct()
        return state.join(whole, F.col("conv_id").eqNullSafe(F.col("_v")), "left").withColumn("done", F.col("done") | F.col("_v").isNull()).drop("_v")
    marked = moved.withColumn("_moved", F.lit(True))
    out = state.join(marked, F.col("conv_id").eqNullSafe(F.col("_w")) & (F.col("id") == F.col("_x")), "left")
    return out.withColumn("done", F.col("done") | F.col("_moved").isNull()).drop("_w", "_x", "_moved")


def _placed(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls with ``at`` (turn that they come at), ``level`` in it and ``loop``.

    Each round places the calls whose references are all placed; after ``DEEPEST`` rounds
    the calls that are left are placed by ``_rest``.
    """
    spark = calls.sparkSession
    names = calls.select("conv_id", "id", "turn", F.explode("needs").alias("need"))
    there = results.select(F.col("conv_id").alias("_c"), F.col("id").alias("_i")).distinct()
    # a reference holds if its call is there and has a result
    first = calls.select(F.col("conv_id").alias("_c"), F.col("id").alias("_i")).join(there, ["_c", "_i"], "left_semi")
    edges = stored(names.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("need") == F.col("_i")), "left").withColumn("missing", F.col("_i").isNull()).drop("_c", "_i"), "references")
    state = calls.select("conv_id", "id", "turn", F.col("turn").alias("at"), F.lit(0).alias("level"), (F.size("needs") == 0).alias("done"))
    if not edges.head(1):
        return calls.join(state.select(F.col("conv_id").alias("_c"), F.col("id").alias("_i"), "at", "level", F.lit(None).cast("string").alias("loop")), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("id") == F.col("_i"))).drop("_c", "_i")
    bad = edges.where("missing").select(F.col("conv_id").alias("_c"), F.col("id").alias("_i")).distinct().withColumn("_bad", F.lit(True))
    state = state.join(bad, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("id") == F.col("_i")), "left").select("conv_id", "id", "turn", "at", "level", (F.col("done") | F.col("_bad").isNotNull()).alias("done"), F.when(F.col("_bad"), "missing_reference").alias("loop"))
    state = stored(_in_order(state, edges), "order")
    left = state.where("not done").count()
    for _ in range(DEEPEST):
        if not left:
            break
        of = state.select(F.col("conv_id").alias("_c"), F.col("id").alias("_n"), F.col("at").alias("_at"), F.col("level").alias("_level"), F.col("done").alias("_done"))
        # only what still waits is joined again
        waits = state.where("not done").select(F.col("conv_id").alias("_w"), F.col("id").alias("_x"))
        edges = stored(edges.join(waits, F.col("conv_id").eqNullSafe(F.col("_w")) & (F.col("id") == F.col("_x")), "left_semi"), "references")
        ready = edges.join(of, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("need") == F.col("_n"))).groupBy(F.col("conv_id").alias("_c"), F.col("id").alias("_i")).agg(F.min("_done").alias("_all"), F.max(F.struct("_at", "_level")).alias("_last"))
        new = state.join(ready, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("id") == F.col("_i")), "left")
        now = ~F.col("done") & F.coalesce("_all", F.lit(False))
        later = F.coalesce(F.col("_last._at") >= F.col("turn"), F.lit(False))
        state = stored(new.select("conv_id", "id", "turn", F.when(now & later, F.col("_last._at")).otherwise(F.col("at")).alias("at"), F.when(now & later, F.col("_last._level") + 1).otherwise(F.col("level")).alias("level"), (F.col("done") | now).alias("done"), "loop"), "order")
        before, left = left, state.where("not done").count()
        if left == before:
            break
    else:
        if left:
            state = stored(_rest(state, edges), "order")
    state = state.select(F.col("conv_id").alias("_c"), F.col("id").alias("_i"), "at", "level", F.when(~F.col("done"), "cycle").otherwise(F.col("loop")).alias("loop"))
    return calls.join(state, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("id") == F.col("_i"))).drop("_c", "_i")


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, position, turn, kind, call_id, status, problems, json: one row an item, in order."""
    items = stored(_items(turns), "chat-items")
    none = F.array().cast("array<string>")
    messages = items.where("kind = 'message'").select("conv_id", "turn", F.col("turn").alias("at"), F.lit(0).alias("level"), "ord", F.lit(0).alias("after"), "kind", F.lit(None).cast("string").alias("call_id"), F.lit("ok").alias("status"), none.alias("problems"), F.col("body").alias("json"))
    out = messages
    calls = items.where("kind = 'call'")
    results = items.where("kind = 'result'")
    if items.where("kind in ('call', 'result')").head(1):
        place = F.struct("turn", "ord")
        firsts = calls.groupBy(F.col("conv_id").alias("_c"), F.col("id").alias("_i")).agg(F.min(place).alias("_f"))
        same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("id") == F.col("_i"))
        calls = calls.join(firsts, same).withColumn("again", ~F.struct("turn", "ord").eqNullSafe(F.col("_f"))).drop("_c", "_i", "_f")
        tools = items.where("kind = 'tool'").groupBy(F.col("conv_id").alias("_c"), F.col("name").alias("_t")).agg(F.min(F.struct("turn", "ord", "body")).alias("_s"))
        calls = calls.join(tools, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("name") == F.col("_t")), "left").withColumn("schema", F.col("_s.body")).drop("_c", "_t", "_s")
        calls = stored(_checked(calls), "chat-calls")
        linked = stored(_placed(calls.where("not again").dropDuplicates(["conv_id", "id"]), results), "chat-placed")
        answered = results.select(F.col("conv_id").alias("_c"), F.col("id").alias("_i")).distinct().withColumn("_answered", F.lit(True))
        body = F.concat(F.lit('{"arguments":'), F.col("body"), F.lit(',"id":'), F.to_json(F.array("id")).substr(F.lit(2), F.length(F.to_json(F.array("id"))) - 2), F.lit(',"name":'), F.to_json(F.array("name")).substr(F.lit(2), F.length(F.to_json(F.array("name"))) - 2), F.lit(',"role":"assistant"}'))
        status = F.coalesce("loop", F.when(F.col("_answered").isNull(), "unanswered"), F.lit("linked"))
        own = linked.join(answered, same, "left").select("conv_id", "turn", "at", "level", "ord", F.lit(1).alias("after"), "kind", F.col("id").alias("call_id"), status.alias("status"), "problems", body.alias("json"))
        again = calls.where("again").select("conv_id", "turn", F.col("turn").alias("at"), F.lit(0).alias("level"), "ord", F.lit(1).alias("after"), "kind", F.col("id").alias("call_id"), F.lit("duplicate_call").alias("status"), "problems", body.alias("json"))
        of = linked.select(F.col("conv_id").alias("_c"), F.col("id").alias("_i"), F.col("at").alias("_at"), F.col("level").alias("_level"), F.col("ord").alias("_ord"))
        reply = F.concat(F.lit('{"content":'), F.col("body"), F.lit(',"role":"tool","tool_call_id":'), F.to_json(F.array("id")).substr(F.lit(2), F.length(F.to_json(F.array("id"))) - 2), F.lit("}"))
        told = results.join(of, same, "left")
        there = F.col("_i").isNotNull()
        told = told.select("conv_id", "turn", F.when(there, F.col("_at")).otherwise(F.col("turn")).alias("at"), F.coalesce("_level", F.lit(0)).alias("level"), F.coalesce("_ord", "ord").alias("ord"), F.lit(2).alias("after"), "kind", F.col("id").alias("call_id"), F.when(there, "linked").otherwise("orphan_result").alias("status"), none.alias("problems"), reply.alias("json"))
        out = out.unionByName(own).unionByName(again).unionByName(told)
    part = F.coalesce(F.floor(F.col("at") / PART), F.lit(-(2**40))).alias("_part")
    order = [F.col("at"), F.col("level"), F.col("ord"), F.col("after"), F.col("turn"), F.col("json")]
    out = numbered(out.withColumn("_part", part), ["conv_id"], "_part", order, "position")
    return out.select("conv_id", "position", "turn", "kind", "call_id", "status", "problems", "json")


#: The tool that questions are put to: the schema of its arguments, as canonical JSON.
ASK = '{"additionalProperties":false,"properties":{"context":{},"question":{"maxLength":200,"type":"string"}},"required":["question"],"type":"object"}'


def question_calls(turns: DataFrame) -> DataFrame:
    """Plain conversations as tool use: a user's turn calls the tool ``ask`` with the text
    and, from the second turn on, the result of the call two turns before; an assistant's
    turn is the result of the call one turn before; a system's turn declares the tool.

    Roles and texts that are neither stay as they are; null texts are null values.
    """
    turn = F.col("turn").cast("bigint")
    name = lambda back: F.concat(F.lit("t"), (turn - back).cast("string"))
    keep = {"ignoreNullFields": "false"}
    text = F.col("text").cast("string")
    known = F.to_json(F.struct(F.struct(name(2).alias("$result")).alias("context"), text.alias("question")), keep)
    first = F.to_json(F.struct(text.alias("question")), keep)
    asked = F.to_json(F.struct(F.array(F.struct(name(0).alias("id"), F.struct(F.lit("ask").alias("name"), F.when(turn >= 2, known).otherwise(first).alias("arguments")).alias("function"))).alias("tool_calls")), keep)
    told = F.to_json(F.struct(name(1).alias("tool_call_id"), text.alias("content")), keep)
    said = F.concat(F.lit('{"content":'), F.coalesce(F.to_json(F.array(text)).substr(F.lit(2), F.length(F.to_json(F.array(text))) - 2), F.lit("null")), F.lit(',"tools":[{"function":{"name":"ask","parameters":' + ASK + "}}]}"))
    return turns.select(
        "conv_id",
        "turn",
        F.when(turn.isNull(), F.col("role")).when(F.col("role") == "user", "assistant").when(F.col("role") == "assistant", "tool").otherwise(F.col("role")).alias("role"),
        F.when(turn.isNull(), text).when(F.col("role") == "user", asked).when(F.col("role") == "assistant", told).when(F.col("role") == "system", said).otherwise(text).alias("text"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given conversations hold no tool calls, so questions and answers are put as calls
    and results; linking, order, schemas and canonical JSON then work on every turn."""
    out = formatted(question_calls(table(spark, sf_dir, "conversations")))
    return out.select("conv_id", "position", "turn", "kind", "call_id", "status", F.array_join("problems", "; ").alias("problems"), "json")


ORACLE = """
WITH t AS (SELECT conv_id, turn, role, coalesce(to_json(text)::VARCHAR, 'null') AS x, length(text) AS n FROM conversations),
asks AS (SELECT conv_id, turn FROM t WHERE role = 'user'),
tells AS (SELECT conv_id, turn - 1 AS turn FROM t WHERE role = 'assistant'),
items AS (
  SELECT conv_id, turn, turn AS place, 0 AS after, 'message' AS kind, NULL::VARCHAR AS call_id, 'ok' AS status, '' AS problems,
    '{"content":' || x || ',"role":"system","tools":[{"function":{"name":"ask","parameters":""" + ASK + """}}]}' AS json FROM t WHERE role = 'system'
  UNION ALL SELECT t.conv_id, t.turn, t.turn, 1, 'call', 't' || t.turn,
    CASE WHEN t.turn >= 2 AND NOT EXISTS (SELECT 1 FROM asks a JOIN tells b USING (conv_id, turn) WHERE a.conv_id = t.conv_id AND a.turn = t.turn - 2) THEN 'missing_reference'
      WHEN EXISTS (SELECT 1 FROM tells b WHERE b.conv_id = t.conv_id AND b.turn = t.turn) THEN 'linked' ELSE 'unanswered' END,
    CASE WHEN NOT EXISTS (SELECT 1 FROM t s WHERE s.conv_id = t.conv_id AND s.role = 'system') THEN 'name: no such tool' WHEN n > 200 THEN '$.question: maxLength' ELSE '' END,
    '{"arguments":{' || CASE WHEN t.turn >= 2 THEN '"context":{"$result":"t' || (t.turn - 2) || '"},' ELSE '' END || '"question":' || x || '},"id":"t' || t.turn || '","name":"ask","role":"assistant"}'
    FROM t WHERE role = 'user'
  UNION ALL SELECT t.conv_id, t.turn, CASE WHEN a.turn IS NULL THEN t.turn ELSE a.turn END, 2, 'result', 't' || (t.turn - 1),
    CASE WHEN a.turn IS NULL THEN 'orphan_result' ELSE 'linked' END, '', '{"content":' || x || ',"role":"tool","tool_call_id":"t' || (t.turn - 1) || '"}'
    FROM t LEFT JOIN asks a ON a.conv_id = t.conv_id AND a.turn = t.turn - 1 WHERE role = 'assistant')
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY place, after, turn, json) - 1)::BIGINT AS position, turn, kind, call_id, status, problems, json FROM items"""
