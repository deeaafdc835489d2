"""The relational layout of object-centric logs, as folders of Parquet tables, and flat frames."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.config import VOCABULARY, Vocabulary
from tracewright.functions.columns import columns_to_map, iso_time, no_nulls, parse_time, without_keys
from tracewright.operators.attributes import latest_attributes
from tracewright.operators.mapping import Relations
from tracewright.session import materialize
from tracewright.sources.position import place

# Column names of the relational standard.
EVENT_CORE = ["ocel_id", "ocel_time"]
OBJECT_CORE = ["ocel_id", "ocel_time", "ocel_changed_field"]


def normal_names(df: DataFrame) -> DataFrame:
    """Column names with `_` for `:`."""
    return df.toDF(*[c.replace(":", "_") for c in df.columns])


def strip_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Column names without a leading prefix."""
    return df.withColumnsRenamed({c: c[len(prefix):] for c in df.columns if c.startswith(prefix)})


def _few(df: DataFrame, column: str) -> list[str]:
    """Distinct values of a metadata column."""
    rows = df.select(column).distinct().collect()
    return sorted(r[0] for r in rows if r[0] is not None)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _placed(df: DataFrame) -> DataFrame:
    """A table with the place of its rows, by which the later of two changes is told."""
    return df.select("*", place(df).alias("_place"))


def _versions(df: DataFrame, log: Column) -> DataFrame:
    """Change rows of one or several object types: attributes as a map, rows with their place."""
    df, order = df if "_place" in df.columns else _placed(df), F.col("_place")
    names = [c for c in df.columns if c not in OBJECT_CORE + ["log", "ocel_type_map", "_place"]]
    return df.select(log.alias("log"), F.col("ocel_id").alias("oid"),
                     F.col("ocel_time").cast("string").alias("ocel_time"),
                     columns_to_map(names).alias("attrs"),
                     order.alias("row_order"))


def _event_details(df: DataFrame, log: Column) -> DataFrame:
    names = [c for c in df.columns if c not in EVENT_CORE + ["log", "ocel_type_map"]]
    time = F.col("ocel_time")
    ts = parse_time(time) if dict(df.dtypes)["ocel_time"] == "string" else time.cast("timestamp")
    return df.select(log.alias("log"), F.col("ocel_id").alias("eid"), ts.alias("ts"),
                     columns_to_map(names).alias("details"))


def _assemble(log: Column, event: DataFrame, obj: DataFrame, e2o: DataFrame, o2o: DataFrame,
              details: DataFrame, versions: DataFrame, v: Vocabulary) -> Relations:
    elem = F.col("details")[v.elem_type_attr]
    position = F.col("details")["src_order"].cast("long")
    residual = F.map_filter("details", lambda k, _: ~k.isin(v.elem_type_attr, "src_order"))
    events = event.select(log.alias("log"), F.col("ocel_id").alias("eid"),
                          F.col("ocel_type").alias("activity")).join(details, ["log", "eid"], "left")
    objects = obj.select(log.alias("log"), F.col("ocel_id").alias("oid"),
                         F.col("ocel_type").alias("otype"))
    types = objects.select("log", "oid", "otype")
    empty = F.expr("cast(map() as map<string,string>)")
    return Relations(
        events.select("log", "eid", "activity", "ts", elem.alias("elem_type"),
                      position.alias("src_order"), residual.alias("residual")),
        objects.join(latest_attributes(versions), ["log", "oid"], "left").select(
            "log", "oid", "otype", F.coalesce("attrs", empty).alias("attrs")),
        e2o.select(log.alias("log"), F.col("ocel_event_id").alias("eid"),
                   F.col("ocel_object_id").alias("oid"), F.col("ocel_qualifier").alias("qualifier"))
        .join(types, ["log", "oid"], "left").select("log", "eid", "oid", "otype", "qualifier"),
        o2o.select(log.alias("log"), F.col("ocel_source_id").alias("src_oid"),
                   F.col("ocel_target_id").alias("tgt_oid"), F.col("ocel_qualifier").alias("qualifier")))


def relations_of_tables(tables: Mapping[str, DataFrame], log: str,
                        v: Vocabulary = VOCABULARY) -> Relations:
    """Relations of the standard's tables, with one attribute table per type.

    `event_map_type` and `object_map_type` tell which tables those are.
    """
    name = F.lit(log)

    def per_type(kind: str) -> list[DataFrame]:
        return [tables[f"{kind}_{k}"] for k in _few(tables[f"{kind}_map_type"], "ocel_type_map")]

    return _assemble(name, tables["event"], tables["object"], tables["event_object"],
                     tables["object_object"], _event_details(_union(per_type("event")), name),
                     _versions(_union([_placed(t) for t in per_type("object")]), name), v)


def write_relational(relations: Relations, folder: str, v: Vocabulary = VOCABULARY) -> None:
    """Write the tables of the standard; attribute tables are partitioned by type."""
    def table_name(column: str) -> Column:
        return F.regexp_replace(F.col(column), r"[^\p{L}\p{N}]", "")

    def write(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")

    def by_type(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").partitionBy("ocel_type_map").parquet(f"{folder}/{name}")

    # Four tables come from the objects, whose duplicates are removed by a shuffle: once, not for each.
    events, objects = relations.events, materialize(relations.objects, "objects")
    write(events.select("log", F.col("eid").alias("ocel_id"), F.col("activity").alias("ocel_type")),
          "event")
    write(objects.select("log", F.col("oid").alias("ocel_id"), F.col("otype").alias("ocel_type")),
          "object")
    write(relations.e2o.select("log", F.col("eid").alias("ocel_event_id"),
                               F.col("oid").alias("ocel_object_id"),
                               F.col("qualifier").alias("ocel_qualifier")), "event_object")
    write(relations.o2o.select("log", F.col("src_oid").alias("ocel_source_id"),
                               F.col("tgt_oid").alias("ocel_target_id"),
                               F.col("qualifier").alias("ocel_qualifier")), "object_object")
    for df, column, name in ((events, "activity", "event_map_type"), (objects, "otype", "object_map_type")):
        write(df.select("log", F.col(column).alias("ocel_type"),
                        table_name(column).alias("ocel_type_map")).distinct(), name)

    details = events.select(
        "log", F.col("eid").alias("ocel_id"), iso_time(F.col("ts")).alias("ocel_time"),
        table_name("activity").alias("ocel_type_map"),
        no_nulls(F.map_concat(without_keys("residual", v.elem_type_attr, "src_order"), F.create_map(
            F.lit(v.elem_type_attr), F.col("elem_type"),
            F.lit("src_order"), F.col("src_order").cast("string")))).alias("_attrs"))
    by_type(_wide(details), "event_by_type")
    static = objects.select(
        "log", F.col("oid").alias("ocel_id"),
        iso_time(F.lit("1970-01-01 00:00:00").cast("timestamp")).alias("ocel_time"),
        F.lit(None).cast("string").alias("ocel_changed_field"),
        table_name("otype").alias("ocel_type_map"), F.col("attrs").alias("_attrs"))
    by_type(_wide(static), "object_by_type")


def _wide(df: DataFrame) -> DataFrame:
    """One column per attribute name of the map."""
    names = _few(df.select(F.explode(F.map_keys("_attrs")).alias("name")), "name")
    return df.select(*[c for c in df.columns if c != "_attrs"],
                     *[F.col("_attrs")[n].alias(n) for n in names])


def read_relational(spark: SparkSession, folder: str, v: Vocabulary = VOCABULARY) -> Relations:
    """Relations of tables written by `write_relational`, all logs at once."""
    log = F.col("log")

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}")

    return _assemble(log, table("event"), table("object"), table("event_object"),
                     table("object_object"), _event_details(table("event_by_type"), log),
                     _versions(table("object_by_type"), log), v)


# --- flat frames ----------------------------------------------------------------------------------

# Column names of flat object-centric frames.
FLAT_EVENT = {"ocel:eid": "ocel_id", "ocel:activity": "ocel_type", "ocel:timestamp": "ocel_time"}
FLAT_OBJECT = {"ocel:oid": "ocel_id", "ocel:type": "ocel_type"}
FLAT_E2O = {"ocel:eid": "ocel_event_id", "ocel:oid": "ocel_object_id", "ocel:qualifier": "ocel_qualifier"}
FLAT_O2O = {"ocel:oid": "ocel_source_id", "ocel:oid_2": "ocel_target_id",
            "ocel:qualifier": "ocel_qualifier"}


def relations_of_frames(events: DataFrame, objects: DataFrame, e2o: DataFrame, o2o: DataFrame,
                        log: str, v: Vocabulary = VOCABULARY) -> Relations:
    """Relations of flat frames with `ocel:*` columns; other non-null columns are attributes."""
    name = F.lit(log)
    events, objects = events.withColumnsRenamed(FLAT_EVENT), objects.withColumnsRenamed(FLAT_OBJECT)
    details = _event_details(events.drop("ocel_type"), name)
    static = objects.drop("ocel_type").withColumn("ocel_time", F.lit(""))
    return _assemble(name, events, objects, e2o.withColumnsRenamed(FLAT_E2O),
                     o2o.withColumnsRenamed(FLAT_O2O), details, _versions(static, name), v)


def relations_of_changes(events: DataFrame, object_types: DataFrame,
                         changes: Mapping[str, DataFrame], e2o: DataFrame, o2o: DataFrame,
                         log: str, v: Vocabulary = VOCABULARY) -> Relations:
    """Relations of an event frame with `event_` columns and change tables per object type.

    `events` has event_id, event_activity, event_timestamp and further attributes; `object_types`
    object_id and type; each change table object_id, ocel_time, ocel_changed_field and attributes;
    the edge frames use the relational column names.
    """
    name = F.lit(log)
    events = strip_prefix(events, "event_").withColumnsRenamed(
        {"id": "ocel_id", "activity": "ocel_type", "timestamp": "ocel_time"})
    objects = object_types.withColumnsRenamed({"object_id": "ocel_id", "type": "ocel_type"})
    versions = _union([_placed(t) for t in changes.values()]).withColumnRenamed("object_id", "ocel_id")
    return _assemble(name, events, objects, e2o, o2o, _event_details(events.drop("ocel_type"), name),
                     _versions(versions, name), v)
