"""The JSON layout of object-centric logs: writing, reading and checking its form.

Written as folders of JSON lines, one per top-level list (eventTypes, objectTypes, events,
objects), with the key names of the standard. Single documents of the standard are read as well.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.config import VOCABULARY, Vocabulary
from tracewright.functions.columns import iso_time, last_wins, no_nulls, parse_time, without_keys
from tracewright.operators.mapping import Relations
from tracewright.operators.ordered import OrderedGroups, sum_before
from tracewright.operators.skew import Skew

# Top-level keys of the JSON standard.
SECTIONS = ("eventTypes", "objectTypes", "events", "objects")

EPOCH = "1970-01-01T00:00:00.000000Z"


EDGES_PER_ENTRY = 10_000


def _edges(df: DataFrame, owner: str, other: str, skew: Skew | None) -> DataFrame:
    """Relationships of each event or object, in arrays of bounded length: (log, id, part, ...)."""
    edges = OrderedGroups(df.select("log", F.col(owner).alias("id"), F.col(other).alias("objectId"),
                                    "qualifier"), ["log", "id"], ["objectId", "qualifier"], skew,
                          of=f"edges of {owner}").scan(_before=sum_before(F.lit(1))).df()
    part = F.floor(F.coalesce(F.col("_before"), F.lit(0)) / EDGES_PER_ENTRY).cast("int")
    return edges.groupBy("log", "id", part.alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("objectId", "qualifier"))).alias("relationships"))


def _with_edges(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """Entries with their relationships.

    An entry with more relationships than one line should hold goes on in further entries of the
    same id, which have a `part` number and no attributes.
    """
    none = F.expr("cast(array() as array<struct<objectId:string,qualifier:string>>)")
    first = F.coalesce(F.col("part"), F.lit(0)) == 0
    joined = entries.join(edges, ["log", "id"], "left")
    return joined.withColumns({
        "relationships": F.coalesce("relationships", none),
        "attributes": F.when(first, F.col("attributes")).otherwise(F.slice("attributes", 1, 0)),
        "part": F.when(~first, F.col("part"))})


def _attribute_list(attributes: Column) -> Column:
    return F.transform(F.array_sort(F.map_entries(attributes)),
                       lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))


def event_documents(relations: Relations, v: Vocabulary = VOCABULARY, skew: Skew | None = None
                    ) -> DataFrame:
    attributes = no_nulls(F.map_concat(without_keys("residual", v.elem_type_attr), F.create_map(
        F.lit(v.elem_type_attr), F.col("elem_type"))))
    events = relations.events.select(
        "log", F.col("eid").alias("id"), F.col("activity").alias("type"),
        iso_time(F.col("ts")).alias("time"), _attribute_list(attributes).alias("attributes"))
    return _with_edges(events, _edges(relations.e2o, "eid", "oid", skew))


def object_documents(relations: Relations, skew: Skew | None = None) -> DataFrame:
    """Objects with static attributes, which carry the epoch as their time."""
    attributes = F.transform(_attribute_list(F.col("attrs")), lambda a: F.struct(
        a["name"].alias("name"), a["value"].alias("value"), F.lit(EPOCH).alias("time")))
    objects = relations.objects.select("log", F.col("oid").alias("id"), F.col("otype").alias("type"),
                                       attributes.alias("attributes"))
    return _with_edges(objects, _edges(relations.o2o, "src_oid", "tgt_oid", skew))


def type_documents(df: DataFrame, name: str, attributes: str) -> DataFrame:
    """(log, name, attributes[{name, type}]) of the event or object types; all values are texts."""
    keys = df.select("log", F.col(name).alias("name"),
                     F.explode_outer(F.map_keys(attributes)).alias("key")).distinct()
    one = F.when(F.col("key").isNotNull(), F.struct(F.col("key").alias("name"),
                                                    F.lit("string").alias("type")))
    return keys.groupBy("log", "name").agg(F.sort_array(F.collect_list(one)).alias("attributes"))


def document_sections(relations: Relations, v: Vocabulary = VOCABULARY, skew: Skew | None = None
                      ) -> dict[str, DataFrame]:
    typed = relations.events.withColumn("_attrs", F.map_concat(
        without_keys("residual", v.elem_type_attr), F.create_map(F.lit(v.elem_type_attr), F.col("elem_type"))))
    return {"eventTypes": type_documents(typed, "activity", "_attrs"),
            "objectTypes": type_documents(relations.objects, "otype", "attrs"),
            "events": event_documents(relations, v, skew),
            "objects": object_documents(relations, skew)}


def write_documents(relations: Relations, folder: str, v: Vocabulary = VOCABULARY,
                    skew: Skew | None = None) -> None:
    for section, df in document_sections(relations, v, skew).items():
        df.write.mode("overwrite").option("ignoreNullFields", "true").json(f"{folder}/{section}")


# --- reading --------------------------------------------------------------------------------------

_REL = "ARRAY<STRUCT<objectId: STRING, qualifier: STRING>>"
EVENT_SCHEMA = ("log STRING, id STRING, type STRING, time STRING, part INT, "
                f"attributes ARRAY<STRUCT<name: STRING, value: STRING>>, relationships {_REL}")
OBJECT_SCHEMA = ("log STRING, id STRING, type STRING, part INT, attributes ARRAY<STRUCT<name: STRING, "
                 f"value: STRING, time: STRING>>, relationships {_REL}")


def _relations(events: DataFrame, objects: DataFrame, v: Vocabulary) -> Relations:
    pairs = F.transform(F.coalesce("attributes", F.array()), lambda a: F.struct(
        a["name"].alias("key"), a["value"].alias("value")))
    attributes = F.map_from_entries(last_wins(pairs, "key"))
    # Continued entries only add relationships.
    heads, object_heads = events.filter(F.col("part").isNull()), objects.filter(F.col("part").isNull())
    types = object_heads.select("log", F.col("id").alias("oid"), F.col("type").alias("otype"))
    e2o = events.select("log", F.col("id").alias("eid"), F.explode("relationships").alias("r")).select(
        "log", "eid", F.col("r.objectId").alias("oid"), F.col("r.qualifier").alias("qualifier"))
    o2o = objects.select("log", F.col("id").alias("src_oid"), F.explode("relationships").alias("r"))
    # Of several versions of an attribute the one with the latest time counts.
    versions = objects.select("log", F.col("id").alias("oid"),
                              F.posexplode("attributes").alias("at", "a"))
    latest = (versions.filter(F.col("a.value").isNotNull())
              .groupBy("log", "oid", F.col("a.name").alias("name"))
              .agg(F.max_by("a.value", F.struct(F.coalesce("a.time", F.lit("")), "at")).alias("value"))
              .groupBy("log", "oid").agg(F.map_from_entries(F.sort_array(F.collect_list(
                  F.struct("name", "value")))).alias("attrs")))
    empty = F.expr("cast(map() as map<string,string>)")
    return Relations(
        heads.select("log", F.col("id").alias("eid"), F.col("type").alias("activity"),
                     parse_time(F.col("time")).alias("ts"),
                     attributes[v.elem_type_attr].alias("elem_type"),
                     F.lit(None).cast("long").alias("src_order"),
                     F.map_filter(attributes, lambda k, _: k != v.elem_type_attr).alias("residual")),
        types.join(latest, ["log", "oid"], "left").select(
            "log", "oid", "otype", F.coalesce("attrs", empty).alias("attrs")),
        e2o.join(types, ["log", "oid"], "left").select("log", "eid", "oid", "otype", "qualifier"),
        o2o.select("log", "src_oid", F.col("r.objectId").alias("tgt_oid"),
                   F.col("r.qualifier").alias("qualifier")))


def read_documents(spark: SparkSession, folder: str, v: Vocabulary = VOCABULARY) -> Relations:
    """Relations of a folder written by `write_documents`. Lines that are cut off fail the read."""
    strict = {"mode": "FAILFAST"}
    return _relations(spark.read.options(**strict).schema(EVENT_SCHEMA).json(f"{folder}/events"),
                      spark.read.options(**strict).schema(OBJECT_SCHEMA).json(f"{folder}/objects"), v)


def read_single_document(spark: SparkSession, path: str, log: str, v: Vocabulary = VOCABULARY
                         ) -> Relations:
    """Relations of a single JSON document of the standard, which is the work of one task."""
    def section(name: str, schema: str) -> DataFrame:
        fields = spark.createDataFrame([], schema).schema
        inner = [f for f in fields if f.name != "log"]
        struct = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in inner)
        read = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(f"{name} ARRAY<STRUCT<{struct}>>").json(path)
        return read.select(F.explode(name).alias("x")).select(F.lit(log).alias("log"), "x.*")

    return _relations(section("events", EVENT_SCHEMA), section("objects", OBJECT_SCHEMA), v)


# --- form -----------------------------------------------------------------------------------------
# Fields are read as VARIANT, which tells a missing key (NULL) from a JSON value and keeps the type
# of the value.

_V = "VARIANT"
_FORM = {
    "eventTypes": f"name {_V}, attributes ARRAY<STRUCT<name: {_V}, type: {_V}>>",
    "objectTypes": f"name {_V}, attributes ARRAY<STRUCT<name: {_V}, type: {_V}>>",
    "events": (f"id {_V}, type {_V}, time {_V}, attributes ARRAY<STRUCT<name: {_V}, value: {_V}>>, "
               f"relationships ARRAY<STRUCT<objectId: {_V}, qualifier: {_V}>>"),
    "objects": (f"id {_V}, type {_V}, attributes ARRAY<STRUCT<name: {_V}, value: {_V}, time: {_V}>>, "
                f"relationships ARRAY<STRUCT<objectId: {_V}, qualifier: {_V}>>"),
}


def _problem(condition: Column, path: Column, message: str) -> Column:
    return F.when(condition, F.struct(path.alias("path"), F.lit(message).alias("message")))


def _is_text(value: Column) -> Column:
    return F.schema_of_variant(value).eqNullSafe("STRING")


def _entry_problems(section: str) -> Column:
    """Violations of one entry, as an array of (path, message).

    `_text` is the entry's JSON, or NULL where lists need not be told from other values. It is parsed as a whole only
    for entries without a list, since a key that was read as a list is one.
    """
    at, typed = F.col("_path"), section.endswith("Types")
    # Keys that the standard asks for.
    required = {"eventTypes": ("name",), "objectTypes": ("name",), "events": ("id", "type", "time"),
                "objects": ("id", "type")}[section]
    inner = ("name", "type") if typed else ("name", "value") if section == "events" else ("name", "value", "time")

    def texts(value, keys: tuple[str, ...], path: Column) -> list[Column]:
        found = [_problem(value(k).isNull(), path, f"absent: {k}") for k in keys]
        found += [_problem(value(k).isNotNull() & ~_is_text(value(k)), path, f"not text: {k}") for k in keys]
        if "time" in keys:
            written = F.try_variant_get(value("time"), "$", "string")
            readable = F.coalesce(written.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"), F.lit(False))
            found.append(_problem(_is_text(value("time")) & ~(readable & parse_time(written).isNotNull()), path,
                                  "no date and time: time"))
        return found

    def nested(name: str, keys: tuple[str, ...]) -> Column:
        per_entry = F.transform(F.coalesce(F.col(name), F.array()), lambda x, i: F.array(*texts(
            lambda k: x[k], keys, F.concat(at, F.lit(f".{name}["), i.cast("string"), F.lit("]")))))
        return F.flatten(per_entry)

    lists = {"attributes": inner} | ({} if typed else {"relationships": ("objectId", "qualifier")})
    top = texts(F.col, required, at)
    def whole(name: str) -> Column:
        return F.try_variant_get(F.try_parse_json("_text"), f"$.{name}", "variant")

    for name in lists:
        kind = F.when(F.col(name).isNull(), F.schema_of_variant(whole(name)))
        top.append(_problem(F.coalesce(~kind.startswith("ARRAY"), F.lit(False)), at, f"not a list: {name}"))
    if typed:
        absent = F.when(F.col("attributes").isNull(), whole("attributes").isNull())
        top.append(_problem(F.coalesce(absent, F.lit(False)), at, "absent: attributes"))
    found = [F.array(*top), *[nested(name, keys) for name, keys in lists.items()]]
    return F.filter(F.concat(*found), lambda p: p.isNotNull())


def _violations(df: DataFrame, section: str) -> DataFrame:
    return df.select(F.lit(section).alias("section"),
                     F.explode(_entry_problems(section)).alias("p")).select("section", "p.*")


def document_violations(spark: SparkSession, folder: str) -> DataFrame:
    """(section, path, message) of every breach of form in a folder of JSON lines.

    Entries of a sharded section have no position, so the path names them by id or name.
    """
    parts = []
    for section in SECTIONS:
        lines = spark.read.text(f"{folder}/{section}")
        entry = lines.select(F.from_json("value", _FORM[section]).alias("e"),
                             F.col("value").alias("_text")).select("e.*", "_text")
        label = F.col("name" if section.endswith("Types") else "id")
        name = F.coalesce(F.try_variant_get(label, "$", "string"), F.lit("?"))
        parts.append(_violations(entry.withColumn("_path", F.concat(
            F.lit(f"{section}["), name, F.lit("]"))), section))
    return reduce(lambda a, b: a.unionByName(b), parts)


def single_document_violations(spark: SparkSession, path: str) -> DataFrame:
    """(section, path, message) of every breach of form in one document."""
    text = spark.read.text(path, wholetext=True)
    document = text.select(F.try_parse_json("value").alias("d"))
    parts = []
    for section in SECTIONS:
        whole = F.variant_get("d", f"$.{section}", "variant")
        form = F.schema_of_variant(whole)
        parts.append(document.select(F.lit(section).alias("section"), F.when(
            whole.isNull(), F.struct(F.lit("$").alias("path"), F.lit(
                f"absent: {section}").alias("message"))).when(
            ~form.startswith("ARRAY"), F.struct(F.lit("$").alias("path"), F.lit(
                f"not a list: {section}").alias("message"))).alias("p"))
            .filter(F.col("p").isNotNull()).select("section", "p.*"))
        entries = text.select(F.from_json("value", f"{section} ARRAY<STRUCT<{_FORM[section]}>>")
                              .alias("d")).select(F.posexplode(f"d.{section}").alias("i", "e"))
        located = entries.select("e.*", F.lit(None).cast("string").alias("_text"), F.concat(F.lit(f"{section}["), F.col("i").cast("string"),
                                                 F.lit("]")).alias("_path"))
        parts.append(_violations(located, section))
    return reduce(lambda a, b: a.unionByName(b), parts)


def require_valid(violations: DataFrame, shown: int = 25) -> None:
    """Strict mode: raise with the first violations."""
    rows = violations.limit(shown).collect()
    if rows:
        raise RuntimeError("document breaks the layout: " + "; ".join(
            f"{r['path']}: {r['message']}" for r in rows))
