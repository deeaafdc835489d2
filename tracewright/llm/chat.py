"""Tool-call linking for chat data.

Calls and results are hash-joined by (conversation, call id). Calls are put into an order in which
nothing comes before what it depends on, their arguments are validated against schemas, and every
exchange is written as canonical JSON: keys in code point order, no white space, integral numbers
without a fraction.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import keep
from tracewright.llm.sharding import number_rows

KEY = ["conv_id", "call_id"]
LARGE_CONVERSATION = 10_000     # calls up to which one task orders a conversation that is out of order
_SURROGATE = re.compile("[\ud800-\udfff]")


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def _no_repeats(pairs: list[tuple[str, object]]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("a key is repeated")
    return found


def _whole(value: object) -> object:
    if isinstance(value, float) and value.is_integer() and abs(value) < 2 ** 53:
        return int(value)
    if isinstance(value, list):
        return [_whole(x) for x in value]
    if isinstance(value, dict):
        return {k: _whole(x) for k, x in value.items()}
    return value


def canonical_json(value: object) -> str:
    """The one text of a JSON value. Halves of surrogate pairs, which UTF-8 cannot hold, are escaped."""
    text = json.dumps(_whole(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def parse_json(text: str) -> object:
    """A JSON value; NaN, infinities and repeated keys are errors."""
    return json.loads(text, parse_constant=_no_constant, object_pairs_hook=_no_repeats)


def _is(value: object, kind: str) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    return {"string": isinstance(value, str), "boolean": isinstance(value, bool), "null": value is None,
            "number": number, "integer": number and float(value).is_integer(),
            "array": isinstance(value, list), "object": isinstance(value, dict)}.get(kind, False)


def schema_errors(value: object, schema: dict, at: str = "$") -> list[str]:
    """What a value breaks of a schema: type, enum, bounds, lengths, pattern, items, properties, required,
    additionalProperties."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, kind) for kind in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    errors = []
    if "enum" in schema and not any(type(value) is type(x) and value == x for x in schema["enum"]):
        errors.append(f"{at}: not in enum")
    if _is(value, "number"):
        errors += [f"{at}: below minimum"] if value < schema.get("minimum", value) else []
        errors += [f"{at}: above maximum"] if value > schema.get("maximum", value) else []
    if isinstance(value, (str, list)):
        few, many = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
        errors += [f"{at}: too short"] if len(value) < schema.get(few, 0) else []
        errors += [f"{at}: too long"] if len(value) > schema.get(many, len(value)) else []
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        errors.append(f"{at}: no match of pattern")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            errors += schema_errors(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        errors += [f"{at}.{name}: missing" for name in schema.get("required", []) if name not in value]
        for name in sorted(value):
            if name in known:
                errors += schema_errors(value[name], known[name], f"{at}.{name}")
            elif schema.get("additionalProperties", True) is False:
                errors.append(f"{at}.{name}: unknown")
            elif isinstance(schema.get("additionalProperties"), dict):
                errors += schema_errors(value[name], schema["additionalProperties"], f"{at}.{name}")
    return errors


def check_arguments(name: str | None, text: str | None, schemas: dict[str, dict]) -> tuple[object, list[str]]:
    """(value, errors) of a call's arguments; unreadable arguments have the value None."""
    errors = [] if name in schemas else ["unknown tool"]
    if text is None:
        return None, errors + ["no arguments"]
    try:
        value = parse_json(text)
        return value, errors + schema_errors(value, schemas.get(name, {}))
    except (ValueError, RecursionError) as problem:
        return None, errors + [f"arguments: {str(problem)[:100]}"]


def _levels(rows: pd.DataFrame) -> list[tuple]:
    """(conv_id, call_id, level) by repeatedly taking what has no open dependency; none for the rest."""
    out = []
    for conv_id, calls in rows.groupby("conv_id"):
        ids = calls["call_id"].tolist()
        needs = {i: set(d) for i, d in zip(ids, calls["needs"])}
        wanted, level = defaultdict(list), {}
        for i, own in needs.items():
            for d in own:
                wanted[d].append(i)
        ready = [(0, i) for i, own in needs.items() if not own]
        heapq.heapify(ready)
        while ready:
            depth, i = heapq.heappop(ready)
            level[i] = depth
            for other in wanted[i]:
                needs[other].discard(i)
                if not needs[other]:
                    heapq.heappush(ready, (depth + 1, other))
        out += [(conv_id, i, level.get(i)) for i in ids]
    return out


def _solved(rows: pd.DataFrame) -> list[tuple]:
    """(conv_id, call_id, level) of what a part of the calls settles on its own.

    rows: conv_id, call_id, base and the open needs, each with a weight; a call's level is the greatest of
    base and level + weight of its needs.
    """
    base, left, wanted, out = {}, {}, defaultdict(list), []
    for conv_id, call_id, least, needs in zip(rows["conv_id"], rows["call_id"], rows["base"], rows["needs"]):
        base[conv_id, call_id], left[conv_id, call_id] = int(least), len(needs)
        for need in needs:
            wanted[conv_id, need["of"]].append(((conv_id, call_id), int(need["weight"])))
    ready = [key for key, n in left.items() if not n]
    while ready:
        key = ready.pop()
        out.append((*key, base[key]))
        for other, weight in wanted[key]:
            base[other] = max(base[other], base[key] + weight)
            left[other] -= 1
            if not left[other]:
                ready.append(other)
    return out


def _contracted(nodes: DataFrame, edges: DataFrame, part: int) -> DataFrame:
    """The same levels for conversations of any size.

    Every round settles what parts of up to `part` calls can settle on their own, puts the levels found
    into the calls that wait for them, and replaces needs that wait for a single call by that call, with
    a weight. So chains and trees take rounds in the logarithm of their size wherever their calls stand,
    and other graphs as many as there are steps from part to part on a way through them. Every round
    settles a call as long as one is left that is neither in nor behind a cycle.
    """
    kind = dict(nodes.dtypes)["conv_id"]
    most = F.lit(1 << 40)       # beyond any number of calls; only weights around cycles get there
    chunk = F.expr(f"row_number div {part}").alias("chunk")
    nodes = keep(number_rows(nodes, ["conv_id", "position", "call_id"]).select(
        *KEY, chunk, F.lit(0).cast("long").alias("base")), "nodes")
    edges = keep(edges.select(*KEY, F.col("of_call_id").alias("of"), F.lit(1).cast("long").alias("weight")), "edges")
    every, found = nodes.select(*KEY), []

    def solved(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_solved(batch), columns=["conv_id", "call_id", "level"])

    while True:
        open_needs = edges.groupBy(*KEY).agg(F.collect_list(F.struct("of", "weight")).alias("needs"))
        waiting = nodes.join(open_needs, KEY, "left").withColumn(
            "needs", F.coalesce("needs", F.array().cast("array<struct<of:string,weight:bigint>>")))
        ready = keep(waiting.groupBy("chunk").applyInPandas(solved, f"conv_id {kind}, call_id string, level long"),
                     "ready")
        if ready.isEmpty():
            break
        found.append(ready)
        if len(found) == 16:    # so that no plan grows with the number of rounds
            found = [keep(reduce(DataFrame.union, found), "levels")]
        edges = edges.join(ready.select(*KEY), KEY, "left_anti")
        known = ready.select("conv_id", F.col("call_id").alias("of"), "level")
        put = keep(edges.join(known, ["conv_id", "of"], "left"), "edges")
        raised = put.filter("level IS NOT NULL").groupBy(*KEY).agg(F.max(F.col("level") + F.col("weight")).alias("raised"))
        nodes = keep(nodes.join(ready.select(*KEY), KEY, "left_anti").join(raised, KEY, "left").select(
            *KEY, "chunk", F.greatest("base", F.coalesce("raised", "base")).alias("base")), "nodes")
        edges = put.filter("level IS NULL").drop("level")

        lone = (edges.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("of").alias("next"),
                                        F.max("weight").alias("step")).filter("n = 1").drop("n"))
        lone = keep(lone.join(nodes, KEY).select("conv_id", F.col("call_id").alias("of"), "next", "step",
                                                 F.col("base").alias("floor")), "lone")
        moved = keep(edges.join(lone, ["conv_id", "of"], "left"), "edges")
        raised = moved.filter("next IS NOT NULL").groupBy(*KEY).agg(
            F.max(F.col("floor") + F.col("weight")).alias("raised"))
        nodes = keep(nodes.join(raised, KEY, "left").select(
            *KEY, "chunk", F.least(F.greatest("base", F.coalesce("raised", "base")), most).alias("base")), "nodes")
        edges = keep(moved.groupBy(*KEY, F.coalesce("next", "of").alias("of")).agg(
            F.max(F.least(F.col("weight") + F.coalesce("step", F.lit(0)), most)).alias("weight")), "edges")
    levels = reduce(DataFrame.union, found) if found else ready
    return every.join(levels, KEY, "left")


def call_levels(calls: DataFrame, large: int = LARGE_CONVERSATION) -> DataFrame:
    """conv_id, call_id, level (null in and behind cycles) for conversations in which some call comes
    before one it depends on; in all others the position is an order already.

    calls: conv_id, call_id, position, depends_on. Conversations of up to `large` calls are ordered whole
    by one task each, longer ones in parts and with chains contracted by joins.
    """
    own = calls.select(*KEY, "position", F.explode("depends_on").alias("need")).filter("need IS NOT NULL").distinct()
    known = calls.select(F.col("conv_id").alias("of_conv_id"), F.col("call_id").alias("of_call_id"),
                         F.col("position").alias("of_position"))
    edges = keep(own.join(known, (F.col("conv_id") == F.col("of_conv_id")) & (F.col("need") == F.col("of_call_id")))
                 .select(*KEY, "position", "of_conv_id", "of_call_id", "of_position"), "needs")
    late = edges.filter("of_position >= position").select(F.col("conv_id").alias("late")).distinct()
    sizes = (calls.join(late, F.col("conv_id") == F.col("late"), "left_semi").groupBy(F.col("conv_id").alias("late"))
             .agg(F.count(F.lit(1)).alias("n")))
    sizes = keep(sizes, "late-conversations")
    nodes = calls.select(*KEY, "position").filter("call_id IS NOT NULL").join(sizes, F.col("conv_id") == F.col("late")).drop("late")
    links = edges.join(sizes, F.col("conv_id") == F.col("late")).drop("late")

    needs = (links.filter(F.col("n") <= large).groupBy(*KEY).agg(F.collect_set("of_call_id").alias("needs")))
    small = (nodes.filter(F.col("n") <= large).select(*KEY).join(needs, KEY, "left")
             .withColumn("needs", F.coalesce("needs", F.array().cast("array<string>"))))

    def ordered(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_levels(batch), columns=["conv_id", "call_id", "level"]).astype({"level": "Int64"})

    kind = dict(calls.dtypes)["conv_id"]
    found = small.groupBy("conv_id").applyInPandas(ordered, f"conv_id {kind}, call_id string, level long")
    if not sizes.filter(F.col("n") > large).isEmpty():
        big = nodes.filter(F.col("n") > large).select(*KEY, "position")
        found = found.union(_contracted(big, links.filter(F.col("n") > large).select(*KEY, "of_call_id"), 10 * large))
    return found


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], large: int = LARGE_CONVERSATION
               ) -> DataFrame:
    """One row per call id of a conversation, asked or only answered: conv_id, seq, call_id, name, status,
    call_position, result_position, n_calls, n_results, valid, errors, message.

    calls: conv_id, position, call_id, name, arguments (JSON text), depends_on (array of call ids).
    results: conv_id, position, call_id, content. Further columns are ignored. Of calls or results that
    repeat an id the first position counts and n_calls or n_results tell how many there were; all without
    an id stand under a null id and link with nothing. status: `linked`, `misplaced` (the result comes
    first), `unanswered` or `unasked`. seq counts a conversation's calls from 0: dependencies first, else
    by position; calls in or behind a cycle come last; it is null without a call. errors lists what
    speaks against a call: unknown tool, unreadable arguments, breaches of the tool's schema, missing
    dependencies, a cycle. message is the exchange as canonical JSON. Empty tables give empty results.
    """
    asked = keep(calls.groupBy(*KEY).agg(F.min(F.struct("position", "name", "arguments", "depends_on")).alias("call"),
                                         F.count(F.lit(1)).alias("n_calls"))
                 .select(*KEY, "call.*", "n_calls"), "calls")
    told = (results.groupBy(*KEY).agg(F.min(F.struct("position", "content")).alias("result"),
                                      F.count(F.lit(1)).alias("n_results"))
            .select(*KEY, F.col("result.position").alias("result_position"), "result.content", "n_results"))
    levels = keep(call_levels(asked, large), "levels").withColumn("placed", F.lit(True))
    missing = (asked.select(*KEY, F.explode(F.array_distinct("depends_on")).alias("need"))
               .join(asked.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"], "left_anti")
               .groupBy(*KEY).agg(F.count(F.lit(1)).alias("missing")))
    asked = (asked.join(levels, KEY, "left").join(missing, KEY, "left")
             .withColumn("cyclic", F.coalesce("placed", F.lit(False)) & F.col("level").isNull()))
    late = F.when(F.col("cyclic"), F.lit(1 << 62)).otherwise(F.coalesce("level", F.lit(0)))
    numbered = keep(number_rows(asked.withColumn("late", late.cast("long")), ["conv_id", "late", "position", "call_id"]),
                    "numbered-calls")
    first = numbered.groupBy(F.col("conv_id").alias("of")).agg(F.min("row_number").alias("first"))
    numbered = numbered.join(first, F.col("conv_id").eqNullSafe(F.col("of"))).withColumn(
        "seq", (F.col("row_number") - F.col("first")).cast("long"))
    status = (F.when(F.col("n_calls").isNull(), "unasked").when(F.col("n_results").isNull(), "unanswered")
              .when(F.col("result_position") <= F.col("call_position"), "misplaced").otherwise("linked"))
    linked = (numbered.withColumnRenamed("position", "call_position")
              .join(told.hint("shuffle_hash"), KEY, "full").withColumn("status", status))

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, text, content, call_id, state, gaps, loop in zip(*(batch[c] for c in (
                    "name", "arguments", "content", "call_id", "status", "missing", "cyclic"))):
                value, errors = (None, []) if state == "unasked" else check_arguments(name, text, schemas)
                errors += [] if pd.isna(gaps) else [f"{int(gaps)} dependencies missing"]
                errors += ["depends on itself"] if loop is True else []
                message = {"call_id": call_id, "name": name, "arguments": value, "result": content, "status": state}
                rows.append((not errors, errors, canonical_json(message)))
            found = pd.DataFrame(rows, columns=["valid", "errors", "message"])
            yield pd.concat([batch[kept].reset_index(drop=True), found], axis=1)

    kept = ["conv_id", "seq", "call_id", "name", "status", "call_position", "result_position", "n_calls", "n_results"]
    types = dict(linked.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in kept) + ", valid boolean, errors array<string>, message string"
    rows = linked.select(*kept, "arguments", "content", "missing", "cyclic")
    return rows.mapInPandas(written, schema)
