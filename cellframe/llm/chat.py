"""Tool calls of conversations: linked to their results, ordered, validated and written as canonical JSON.

Calls meet their results in a hash join on the identifier; results that share one are reduced to one
first, so the join cannot multiply.  The order is that of a topological sort: a call's level is one
more than the highest of the calls that it depends on.  Calls are cut into blocks of bounded size that
hold conversations whole, and parts of those that are longer; a task orders what it can of its block,
levels that another block waits for reach it in the next round, and chains through several blocks are
halved by path doubling in each round, so rounds grow with the logarithm of a chain.  Arguments are
validated against the schema of the call's tool, joined by name, and each call is written as JSON with
sorted keys and no white space; numbers without fraction are whole, others have the fewest digits that
give them back, so equal calls are equal text.

Defined cases: a call without result is ``unanswered``; of several results the first in the order of
their text stands and their number is told; dependencies on calls that are not there are ignored; calls
on a cycle, or behind one, are ``cyclic`` and have no level; a call whose arguments are null or no JSON
object, or break the schema, is ``invalid``; NaN, infinities, numbers beyond a double and arguments that
are nested too deeply to be read count as no JSON; half a surrogate pair stays as its escape.  A call
whose tool has no schema, or one that is no JSON object, is ``unknown``; a property's rule that is no
object or names no known type allows any value, a list of types any of them.  Calls that share an
identifier are linked each, to the same result, at the same level; calls without identifier have no
result; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.llm.common import discard, materialise, renewed

#: JSON types by the names that schemas use.
TYPES = {"string": (str,), "integer": (int,), "number": (int, float), "boolean": (bool,), "object": (dict,), "array": (list,), "null": (type(None),)}
#: Calls of a block, which one task orders.
BLOCK = 50_000
#: A level above all that a call without cycle has.
HIGHEST = 1 << 40
_halves = re.compile("[\ud800-\udfff]")


def canonical(value: object) -> str:
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return _halves.sub(lambda half: f"\\u{ord(half[0]):04x}", text)


def _number(text: str) -> int | float:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError("beyond a double")
    return int(value) if value.is_integer() and abs(value) < 1 << 53 else value


def _no_number(text: str) -> None:
    raise ValueError(f"{text} is no JSON")


def parsed(text: str) -> object:
    """The JSON value of ``text``; ValueError if it is none or nested too deeply."""
    try:
        value = json.loads(text, parse_float=_number, parse_constant=_no_number)
        canonical(value)
    except RecursionError:
        raise ValueError("nested too deeply") from None
    return value


@lru_cache(maxsize=1024)
def rules_of(schema: str | None) -> dict | None:
    """The rules {name: {"type", "required"}} of a schema; None if there is none."""
    try:
        rules = parsed(schema) if schema is not None else None
    except ValueError:
        return None
    return rules if isinstance(rules, dict) else None


def fits(value: object, kind: object) -> bool:
    """Whether a value is of a schema's type, a name or a list of names; names that mean nothing allow all."""
    if isinstance(kind, list):
        return any(fits(value, k) for k in kind)
    if not isinstance(kind, str) or kind not in TYPES:
        return True
    return isinstance(value, TYPES[kind]) and (kind == "boolean" or not isinstance(value, bool))


def violations(arguments: str | None, rules: dict) -> tuple[object, list[str]]:
    """The parsed arguments and what in them breaks the rules."""
    try:
        value = parsed(arguments) if arguments is not None else None
    except ValueError:
        return None, ["arguments are no JSON"]
    if not isinstance(value, dict):
        return value, ["arguments are no object"]
    rules = {name: rule if isinstance(rule, dict) else {} for name, rule in rules.items()}
    found = [f"{name} is missing" for name, rule in sorted(rules.items()) if rule.get("required") is True and name not in value]
    for name, own in sorted(value.items()):
        if name not in rules:
            found.append(f"{name} is not in the schema")
        elif not fits(own, kind := rules[name].get("type")):
            found.append(f"{name} is no {' or '.join(map(str, kind)) if isinstance(kind, list) else kind}")
    return value, [_halves.sub("?", x) for x in found]


def _ordered(edges: list[tuple[str, str | None, int]]) -> dict[str, int]:
    """Levels that (call, what it needs, how far above that it is) settle; without a need, the call is that high at least."""
    level: dict[str, int] = {}
    waits: dict[str, int] = {}
    above: dict[str, list[tuple[str, int]]] = {}
    for call, dep, gain in edges:
        level.setdefault(call, 0)
        if dep is None:
            level[call] = max(level[call], gain)
        else:
            waits[call] = waits.get(call, 0) + 1
            above.setdefault(dep, []).append((call, gain))
    ready, found = [c for c in level if c not in waits], {}
    while ready:
        done = ready.pop()
        found[done] = level[done]
        for call, gain in above.get(done, ()):
            level[call] = max(level[call], level[done] + gain)
            waits[call] -= 1
            if not waits[call]:
                ready.append(call)
    return found


def _order_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Levels that the open edges (block, call_id, dep, gain), block after block, settle."""
    held: list[tuple] = []
    at = None

    def levels_of(edges: list[tuple]) -> pa.RecordBatch:
        found = _ordered(edges)
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int32())], ["call_id", "level"])

    for batch in batches:
        blocks = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if blocks[a] != at and held:
                yield levels_of(held)
                held = []
            at = blocks[a]
            held += zip(*(batch.column(k).slice(a, b - a).to_pylist() for k in (1, 2, 3)), strict=True)
    if held:
        yield levels_of(held)


def _contracted(edges: DataFrame) -> DataFrame:
    """``edges`` where what leads to a call with one open need leads to that need itself, so chains halve.

    Edges do not grow in number.  Those on a cycle lead round it for ever; their gains stop at ``HIGHEST``.
    """
    bases, needs = edges.where("dep is null"), edges.where("dep is not null")
    one = edges.groupBy("call_id").agg(F.count("dep").alias("n"), F.max("dep").alias("next"), F.max(F.when(F.col("dep").isNotNull(), F.col("gain"))).alias("step"), F.max(F.when(F.col("dep").isNull(), F.col("gain"))).alias("base")).where("n = 1")
    further = needs.join(one.select(F.col("call_id").alias("dep"), "next", "step", "base"), "dep", "left")
    onward = F.struct(F.coalesce("next", "dep").alias("dep"), (F.col("gain") + F.coalesce("step", F.lit(0))).alias("gain"))
    least = F.struct(F.lit(None).cast("string").alias("dep"), (F.col("gain") + F.coalesce("base", F.lit(0))).alias("gain"))
    rows = further.select("block", "call_id", F.explode(F.array(onward, least)).alias("e")).select("block", "call_id", "e.dep", "e.gain")
    return rows.unionByName(bases).groupBy("block", "call_id", "dep").agg(F.least(F.max("gain"), F.lit(HIGHEST)).alias("gain"))


def levels(calls: DataFrame, bound: int = BLOCK) -> DataFrame:
    """call_id and level from calls (conversation, call_id, depends_on); ids on or behind a cycle have none.

    A conversation of up to ``bound`` calls lies in one block and is ordered in one round, whatever its
    ids; a longer one is cut by its ids, and chains that lead from block to block are halved in each round.
    """
    own = calls.where("call_id is not null").withColumn("call_id", F.col("call_id").cast("string"))
    ids = materialise(own.groupBy("call_id").agg(F.min(F.coalesce(F.col("conversation").cast("string"), F.lit(""))).alias("conversation")))
    parts = max(1, -(-ids.count() // bound))
    long = materialise(ids.groupBy("conversation").agg(F.count("*").alias("n")).where(F.col("n") > bound).select("conversation", F.lit(True).alias("cut")))
    places = ["conversation", F.when(F.col("cut"), F.length("call_id")), F.when(F.col("cut"), F.col("call_id"))]
    ranged = ids.join(long, "conversation", "left").repartitionByRange(parts, *places)
    nodes = materialise(ranged.select("call_id", F.spark_partition_id().alias("block")))
    pairs = own.select("call_id", F.explode(F.col("depends_on").cast("array<string>")).alias("dep")).where("dep is not null").distinct()
    pairs = pairs.join(nodes.select(F.col("call_id").alias("dep")), "dep").join(nodes, "call_id").select("block", "call_id", "dep", F.lit(1).cast("long").alias("gain"))
    edges = materialise(pairs.unionByName(nodes.select("block", "call_id", F.lit(None).cast("string").alias("dep"), F.lit(0).cast("long").alias("gain"))))
    discard(ids, long, nodes)
    done: list[DataFrame] = []
    while True:
        solved = materialise(edges.repartition("block").sortWithinPartitions("block").mapInArrow(_order_blocks, "call_id string, level int"))
        done.append(solved)
        if not solved.limit(1).count():  # nothing is left, or cycles and what is behind them
            break
        # What the round settled is told to the calls that wait for it, and its own edges go.
        left = edges.join(solved.select("call_id"), "call_id", "left_anti")
        told = left.where("dep is not null").join(solved.select(F.col("call_id").alias("dep"), F.col("level").alias("_level")), "dep", "left")
        told = told.select("block", "call_id", F.when(F.col("_level").isNull(), F.col("dep")).alias("dep"), (F.col("gain") + F.coalesce("_level", F.lit(0))).alias("gain"))
        edges = renewed(edges, told.unionByName(left.where("dep is null")))
        if not edges.limit(1).count():
            break
        edges = renewed(edges, _contracted(edges))
    discard(edges)
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Links calls (conversation, call_id, name, arguments, depends_on) to results (call_id, content).

    ``schemas`` has name and schema (JSON).  Returns conversation, call_id, level, status, errors,
    n_results and message; the order (level, call_id) never has a call before one that it needs.
    """
    calls = materialise(calls.select("conversation", "call_id", "name", "arguments", "depends_on"))
    answers = results.where("call_id is not null").groupBy("call_id").agg(F.min("content").alias("content"), F.count("*").alias("n_results"))
    rules = schemas.groupBy("name").agg(F.min("schema").alias("schema"))
    linked = calls.drop("depends_on").join(answers, "call_id", "left").join(levels(calls), "call_id", "left").join(rules, "name", "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {"status": [], "errors": [], "message": []}
            for x in batch.to_pylist():
                own = rules_of(x["schema"])
                value, errors = violations(x["arguments"], own or {})
                states = (("unknown", own is None), ("invalid", bool(errors)), ("cyclic", x["level"] is None and x["call_id"] is not None), ("unanswered", x["n_results"] is None))
                rows["status"].append(next((name for name, holds in states if holds), "ok"))
                rows["errors"].append([] if own is None else errors)
                rows["message"].append(canonical({"arguments": value, "id": x["call_id"], "name": x["name"], "result": x["content"]}))
            columns = [batch.column(i) for i in (0, 1, 2)] + [pa.array(rows["status"], pa.string()), pa.array(rows["errors"], pa.list_(pa.string())), batch.column(3), pa.array(rows["message"], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["conversation", "call_id", "level", "status", "errors", "n_results", "message"])

    ordered = linked.select(F.col("conversation").cast("string"), F.col("call_id").cast("string"), "level", "n_results", "name", "arguments", "content", "schema")
    return ordered.mapInArrow(write, "conversation string, call_id string, level int, status string, errors array<string>, n_results long, message string")


#: The tools that the turns of a plain conversation stand for.
TURN_TOOLS = {"configure": {"prompt": {"type": "string", "required": True}, "turn": {"type": "integer", "required": True}}, "respond": {"prompt": {"type": "string", "required": True}, "turn": {"type": "integer", "required": True}}}


def turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and schemas of plain conversations (conv_id, turn, role, text).

    A user's turn calls ``respond`` and a system turn ``configure``; the assistant's turn is the result
    of the call one turn before.  A call depends on the calls one and two turns before it.
    """
    name = lambda back: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    tool = F.when(F.col("role") == "system", "configure").when(F.col("role") == "user", "respond")
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), "turn"))
    calls = conversations.where(tool.isNotNull()).select(F.col("conv_id").cast("string").alias("conversation"), name(0).alias("call_id"), tool.alias("name"), arguments.alias("arguments"), F.array(name(1), name(2)).alias("depends_on"))
    results = conversations.where("role = 'assistant'").select(name(1).alias("call_id"), F.col("text").alias("content"))
    schemas = conversations.sparkSession.createDataFrame([(k, canonical(v)) for k, v in TURN_TOOLS.items()], "name string, schema string")
    return calls, results, schemas


def link_turns(conversations: DataFrame) -> DataFrame:
    return link(*turns(conversations))
