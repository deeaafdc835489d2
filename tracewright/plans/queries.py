"""The registered queries: every operator applied to the event and order-line tables."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.catalog import COMPARED_TASKS, TASKS
from tracewright.config import VOCABULARY as V
from tracewright.config import Experiment, SourceColumns
from tracewright.functions.columns import iso_time
from tracewright.operators import checks, discover, features, fidelity, folds, sparse
from tracewright.operators import labels as L
from tracewright.operators import mapping as M
from tracewright.operators import match as J
from tracewright.operators import trace as T
from tracewright.operators.attributes import latest_attributes
from tracewright.operators.load import participant_spans, with_load
from tracewright.operators.skew import Skew
from tracewright.plans import evaluation as E
from tracewright.session import materialize, new_folder, prepare, size_shuffles
from tracewright.sources import documents, flat, relational, xes
from tracewright.sources.results import write_csv
from tracewright.sources.tables import events_log, orders_log, table

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}

PARTICIPANT, ACTIVITY = "P0", "purchase"

_limit: ContextVar[int] = ContextVar("limit", default=Skew.limit)

# Queries that run a second time with groups of more than so many rows cut into segments, as groups of
# millions of rows are otherwise. The results are the same.
SEGMENTED = {"participant_load": 500, "grouped_folds": 2_000, "directly_follows": 500, "label_x_mst": 500}


def query(name: str) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        def prepared(spark: SparkSession, folder: str) -> DataFrame:
            return run(prepare(spark), folder)
        _queries[name] = prepared
        return run
    return add


def registered() -> dict[str, Query]:
    return dict(_queries)


def events_source(spark: SparkSession, folder: str) -> tuple[DataFrame, Skew]:
    src = events_log(spark, folder)
    return src, measured(src)


def measured(source: DataFrame) -> Skew:
    skew = Skew.of(source, limit=_limit.get())
    size_shuffles(source.sparkSession, skew.rows)
    return skew


def orders_source(spark: SparkSession, folder: str) -> tuple[DataFrame, Skew]:
    skew = measured(table(spark, folder, "lineitem"))
    return orders_log(spark, folder, skew), skew


def events_relations(spark: SparkSession, folder: str, keep: bool = False) -> M.Relations:
    return M.transform(*events_source(spark, folder), keep=keep)


def events_trace(spark: SparkSession, folder: str) -> tuple[DataFrame, Skew]:
    src, skew = events_source(spark, folder)
    return T.trace_of_matched(J.match_messages(src, skew)), skew


def micros(df: DataFrame, *names: str) -> DataFrame:
    """Timestamps as epoch microseconds, which compare across engines."""
    return df.withColumns({n: F.unix_micros(n) for n in names})


# --- prediction targets ----------------------------------------------------------------------

def label_query(key: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        src, skew = events_source(spark, folder)
        if key == "X-MSt":
            trace = T.trace_of_matched(J.match_messages(src, skew))
        else:
            trace = T.trace_without_receives(src, skew)
        param = {"participant": PARTICIPANT, "activity": ACTIVITY, None: None}[TASKS[key].param]
        return L.label_rows(trace, key, param, skew).drop("log")
    return run


for _key in TASKS:
    query("label_" + _key.lower().replace("-", "_"))(label_query(_key))


@query("labels_orders_wide")
def labels_orders_wide(spark: SparkSession, folder: str) -> DataFrame:
    """All sixteen targets at once on a log with time ties."""
    src, skew = orders_source(spark, folder)
    trace = T.trace_of_matched(J.match_messages(src, skew))
    return L.label_columns(trace, TASKS, "S0", "N", skew).drop("log")


@query("labels_source_wide")
def labels_source_wide(spark: SparkSession, folder: str) -> DataFrame:
    """The fourteen targets of plain event logs from source columns, ties in source order."""
    src, skew = orders_source(spark, folder)
    wide = L.label_columns(T.source_trace(src), COMPARED_TASKS, "S0", "N", skew, ["ts", "src_order"])
    return wide.drop("log", "event_id")


@query("labels_every_parameter")
def labels_every_parameter(spark: SparkSession, folder: str) -> DataFrame:
    """Long labels of all targets for every participant and send activity."""
    trace, skew = events_trace(spark, folder)
    rows = L.all_label_rows(trace, TASKS, L.parameter_domain(trace), skew)
    return rows.drop("log").withColumn("y_bool", F.col("y_bool").cast("string"))


@query("parameter_domain")
def parameter_domain(spark: SparkSession, folder: str) -> DataFrame:
    src, skew = orders_source(spark, folder)
    return L.parameter_domain(T.trace_without_receives(src, skew))


# --- order and messages ------------------------------------------------------------------------

@query("source_order")
def source_order(spark: SparkSession, folder: str) -> DataFrame:
    src, skew = orders_source(spark, folder)
    return micros(J.order_events(src, skew).df(), "ts").select("case_id", "event_id", "idx", "ts")


@query("cut_points")
def cut_points(spark: SparkSession, folder: str) -> DataFrame:
    src, skew = orders_source(spark, folder)
    return fidelity.prefixes(T.trace_without_receives(src, skew), skew).select("case_id", "k")


@query("match_messages")
def match_messages(spark: SparkSession, folder: str) -> DataFrame:
    return J.message_pairs(J.match_messages(*events_source(spark, folder))).drop("log")


@query("match_messages_orders")
def match_messages_orders(spark: SparkSession, folder: str) -> DataFrame:
    return J.message_pairs(J.match_messages(*orders_source(spark, folder))).drop("log")


def partly_unknown(src: DataFrame) -> DataFrame:
    """Source events where some messages lost one of their parties."""
    kept = F.col("src_order") % 3 != 0
    return src.withColumns({
        "from_participant": F.when(kept, F.col("from_participant")),
        "to_participant": F.when(F.col("src_order") % 5 != 0, F.col("to_participant"))})


@query("match_messages_unknown_parties")
def match_messages_unknown_parties(spark: SparkSession, folder: str) -> DataFrame:
    """Pairing where messages with and without known parties mix."""
    src, skew = events_source(spark, folder)
    return J.message_pairs(J.match_messages(partly_unknown(src), skew)).drop("log")


@query("unmatched_receives")
def unmatched_receives(spark: SparkSession, folder: str) -> DataFrame:
    return J.unmatched_receives(J.match_messages(*events_source(spark, folder))).drop("log")


# --- object-centric relations -------------------------------------------------------------------

@query("ocel_events")
def ocel_events(spark: SparkSession, folder: str) -> DataFrame:
    return micros(events_relations(spark, folder).events, "ts").select(
        "eid", "activity", "ts", "elem_type", F.col("residual")["value"].cast("double").alias("value"),
        F.col("residual")["props"].alias("props"))


@query("ocel_objects")
def ocel_objects(spark: SparkSession, folder: str) -> DataFrame:
    attrs = F.col("attrs")
    return events_relations(spark, folder).objects.select(
        "oid", "otype", attrs[V.case_id_attr].alias("case_attr"), attrs[V.name_attr].alias("name_attr"),
        attrs[V.participant_attr].alias("participant_attr"), attrs[V.sender_attr].alias("sender"),
        attrs[V.receiver_attr].alias("receiver"))


@query("ocel_e2o")
def ocel_e2o(spark: SparkSession, folder: str) -> DataFrame:
    return events_relations(spark, folder).e2o


@query("ocel_e2o_without_actor")
def ocel_e2o_without_actor(spark: SparkSession, folder: str) -> DataFrame:
    return M.without_actor_edges(events_relations(spark, folder)).e2o


@query("ocel_o2o")
def ocel_o2o(spark: SparkSession, folder: str) -> DataFrame:
    return events_relations(spark, folder).o2o


@query("ocel_static_attributes")
def ocel_static_attributes(spark: SparkSession, folder: str) -> DataFrame:
    rows = M.static_attributes(events_relations(spark, folder).objects)
    return micros(rows, "ts").drop("log")


@query("transformation_stats")
def transformation_stats(spark: SparkSession, folder: str) -> DataFrame:
    matched = J.match_messages(*events_source(spark, folder))
    return M.transformation_stats(M.relations_of(matched), matched)


@query("latest_attributes")
def latest_object_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """Each order as an object whose lines change its attributes; equal times, later row wins."""
    lines = table(spark, folder, "lineitem")
    versions = lines.select(
        F.lit("orders").alias("log"), F.concat(F.lit("order::"), F.col("l_orderkey")).alias("oid"),
        F.date_format(F.col("l_shipdate"), "yyyy-MM").alias("ocel_time"),
        F.create_map(F.lit("status"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linestatus")),
                     F.lit("flag"), F.col("l_returnflag")).alias("attrs"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag",
                 "l_linestatus").alias("row_order"))
    latest = latest_attributes(versions)
    return latest.select("oid", F.col("attrs")["status"].alias("status"),
                         F.col("attrs")["flag"].alias("flag"))


# --- trace -----------------------------------------------------------------------------------------

def shown_trace(trace: DataFrame) -> DataFrame:
    return micros(trace, "ts").drop("log", "src_order")


@query("trace_of_relations")
def trace_of_relations(spark: SparkSession, folder: str) -> DataFrame:
    """Roles, actors and message parties resolved by joins over the relations."""
    return shown_trace(T.trace_of_relations(events_relations(spark, folder, keep=True)))


@query("trace_of_source")
def trace_of_source(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows without joins."""
    return shown_trace(events_trace(spark, folder)[0])


@query("event_roles")
def event_roles(spark: SparkSession, folder: str) -> DataFrame:
    roles = T.event_roles(events_relations(spark, folder, keep=True))
    return roles.select("eid", F.col("instance.oid").alias("ci_oid"),
                        F.col("local_case.oid").alias("lc_oid"), F.col("person.oid").alias("pa_oid"),
                        F.col("message.oid").alias("msg_oid"), "sends", "receives")


@query("object_facts")
def object_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Case ids, names, actors and message parties learnt from objects and their relations."""
    return T.object_facts(events_relations(spark, folder, keep=True)).drop("log")


@query("participant_spans")
def spans(spark: SparkSession, folder: str) -> DataFrame:
    src, skew = orders_source(spark, folder)
    rows = participant_spans(T.trace_without_receives(src, skew))
    return micros(rows, "first_ts", "last_ts").select("actor", "case_id", "first_ts", "last_ts")


@query("participant_load")
def participant_load(spark: SparkSession, folder: str) -> DataFrame:
    src, skew = events_source(spark, folder)
    return with_load(T.trace_without_receives(src, skew), skew).select("event_id", "actor", "load")


# --- checks ----------------------------------------------------------------------------------------

def damaged(relations: M.Relations) -> M.Relations:
    """Relations with some edges, objects and times missing or wrong."""
    late = F.col("activity") == "signup"
    return M.Relations(
        relations.events.withColumn("ts", F.when(late, F.expr("ts - interval 30 days"))
                                    .otherwise(F.col("ts"))),
        relations.objects.filter(F.col("oid") != "part::P2"),
        relations.e2o.filter(~((F.col("qualifier") == V.send) & F.col("eid").endswith("7"))),
        relations.o2o.filter(~((F.col("qualifier") == V.executed_by) & (F.col("tgt_oid") == "part::P1"))))


@query("check_measures")
def check_measures(spark: SparkSession, folder: str) -> DataFrame:
    src = events_log(spark, folder)
    return checks.check_measures(src, events_relations(spark, folder, keep=True))


@query("check_measures_damaged")
def check_measures_damaged(spark: SparkSession, folder: str) -> DataFrame:
    src = events_log(spark, folder)
    return checks.check_measures(src, damaged(events_relations(spark, folder, keep=True)))


@query("check_report")
def check_report(spark: SparkSession, folder: str) -> DataFrame:
    return checks.check_report(check_measures_damaged(spark, folder))


@query("orphan_objects")
def orphan_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Messages left without relations after all their edges are taken away."""
    relations = events_relations(spark, folder, keep=True)
    cut = replace(relations, o2o=relations.o2o.filter(~F.col("src_oid").startswith("msg::")),
                  e2o=damaged(relations).e2o)
    return checks.orphan_objects(cut)


# --- label comparison --------------------------------------------------------------------------

@query("fidelity_equivalence")
def fidelity_equivalence(spark: SparkSession, folder: str) -> DataFrame:
    """Source labels against labels of the relations, for every task and parameter."""
    src, skew = events_source(spark, folder)
    trace = T.trace_of_relations(M.transform(src, skew, keep=True))
    return fidelity.equivalence(T.source_trace(src), trace, skew=skew)


def disturbed(src: DataFrame) -> DataFrame:
    """Source events with some times moved, activities renamed and events missing."""
    n = F.col("src_order")
    return src.filter(n % 97 != 0).withColumns({
        "ts": F.when(n % 7 == 0, F.expr("ts + interval 2 seconds")).otherwise(F.col("ts")),
        "activity": F.when(n % 11 == 0, F.lit("other")).otherwise(F.col("activity")),
        "participant": F.when(n % 13 != 0, F.col("participant"))})


@query("fidelity_disturbed")
def fidelity_disturbed(spark: SparkSession, folder: str) -> DataFrame:
    """Comparison with a disturbed copy: mismatches and prefixes that exist on one side only."""
    src, skew = events_source(spark, folder)
    trace = T.trace_without_receives(disturbed(src), skew)
    found = fidelity.equivalence(T.source_trace(src), trace, skew=skew)
    return found.withColumn("agreement", F.round("agreement", 9))


@query("mismatch_examples")
def mismatch_examples(spark: SparkSession, folder: str) -> DataFrame:
    """The first differing labels of every compared target, for one participant and one activity."""
    src, skew = events_source(spark, folder)
    asked = {"participant": "P1", "activity": "purchase"}
    params = {key: F.lit(asked[TASKS[key].param]) for key in COMPARED_TASKS if TASKS[key].param}

    def long(trace: DataFrame, order: list[str]) -> DataFrame:
        wide = L.label_columns(trace, COMPARED_TASKS, *asked.values(), skew, order)
        return L.long_labels(wide, COMPARED_TASKS, params)

    reference = long(T.source_trace(src), ["ts", "src_order"])
    other = long(T.trace_without_receives(disturbed(src), skew), ["ts", "event_id"])
    aligned = fidelity.align_labels(reference, other)
    texts = [F.col(c).cast("string").alias(c) for c in ("ref_bool", "obj_bool")]
    return fidelity.mismatch_examples(aligned).select(
        "task", F.coalesce("param", F.lit("")).alias("param"), "case_id", "k", "ref_str", "ref_num", "obj_str", "obj_num",
        *texts, "nth")


@query("fidelity_consistency")
def fidelity_consistency(spark: SparkSession, folder: str) -> DataFrame:
    trace, skew = events_trace(spark, folder)
    return fidelity.consistency(trace, skew=skew)


# --- features, folds, baselines ----------------------------------------------------------------

@query("feature_table")
def feature_table(spark: SparkSession, folder: str) -> DataFrame:
    trace, skew = events_trace(spark, folder)
    activities = features.activity_names(trace)
    table_ = features.feature_table(trace, activities, skew)
    names = dict(zip(features.activity_columns(activities), ["before_" + a for a in activities]))
    return table_.withColumnsRenamed(names).drop("log")


@query("feature_table_direct")
def feature_table_direct(spark: SparkSession, folder: str) -> DataFrame:
    trace, skew = events_trace(spark, folder)
    activities = features.activity_names(trace)
    table_ = features.feature_table(trace, activities, skew, direct=True)
    names = dict(zip(features.activity_columns(activities), ["right_before_" + a for a in activities]))
    return table_.withColumnsRenamed(names).drop(
        "log", "case_id", "remaining", *features.BASE_FEATURES)


@query("feature_vectors")
def feature_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse features: the places of the activities that occurred before, and how often, as text."""
    src, skew = orders_source(spark, folder)
    trace = T.trace_of_matched(J.match_messages(src, skew))
    rows = sparse.feature_vectors(trace, sparse.activity_index(trace), skew)
    entries = F.transform(F.arrays_zip("at", "x"), lambda e: F.concat(
        e["at"].cast("string"), F.lit(":"), e["x"].cast("long").cast("string")))
    first = len(features.BASE_FEATURES)
    return rows.select("event_id", "remaining", *features.BASE_FEATURES, F.array_join(
        F.slice(entries, first + 1, F.greatest(F.size("at") - first, F.lit(0))), " ").alias("activities"))


@query("past_features")
def past_features(spark: SparkSession, folder: str) -> DataFrame:
    src, skew = orders_source(spark, folder)
    trace = T.trace_of_matched(J.match_messages(src, skew))
    return features.past_features(trace, skew).drop("log", "case_id")


@query("preceding_activities")
def preceding_activities(spark: SparkSession, folder: str) -> DataFrame:
    src, skew = orders_source(spark, folder)
    rows = features.preceding_activities(T.trace_without_receives(src, skew), skew)
    return rows.select("event_id", "activity", "occurrences")


@query("feature_alignment")
def feature_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Feature rows of a disturbed log against the times of the log itself."""
    src, skew = events_source(spark, folder)
    trace = T.trace_without_receives(src, skew)
    other = T.trace_without_receives(disturbed(src), skew)
    return features.misaligned(features.past_features(other, skew), trace, 1.0, skew)


@query("remaining_times")
def remaining_times(spark: SparkSession, folder: str) -> DataFrame:
    src, skew = orders_source(spark, folder)
    return features.remaining_times(T.trace_without_receives(src, skew), skew).drop("log")


@query("most_frequent")
def most_frequent(spark: SparkSession, folder: str) -> DataFrame:
    src, skew = events_source(spark, folder)
    return folds.most_frequent(T.trace_without_receives(src, skew), skew)


@query("grouped_folds")
def grouped_folds(spark: SparkSession, folder: str) -> DataFrame:
    src, skew = orders_source(spark, folder)
    return folds.grouped_folds(src, 5, skew).drop("log")


def labelled(spark: SparkSession, folder: str) -> tuple[DataFrame, Skew]:
    src, skew = events_source(spark, folder)
    trace = T.trace_without_receives(src, skew)
    experiment = Experiment()
    parameters = materialize(E.chosen_parameters(trace, experiment, skew), "parameters")
    return E.with_folds(E.labelled_rows(trace, experiment.tasks, parameters, skew), 5, skew), skew


@query("labelled_rows")
def labelled_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Defined labels of the representative tasks with chosen parameters and folds."""
    return labelled(spark, folder)[0].select(
        "task", "case_id", "event_id", "k", "y_str", "y_num",
        F.col("y_bool").cast("string").alias("y_bool"), "fold")


@query("training_medians")
def training_medians(spark: SparkSession, folder: str) -> DataFrame:
    rows, skew = labelled(spark, folder)
    found = folds.training_medians(rows.filter(F.col("kind") == "numeric"), 5, skew)
    return found.select("task", "fold", F.round("median", 6).alias("median"))


@query("median_baseline")
def median_baseline(spark: SparkSession, folder: str) -> DataFrame:
    rows, skew = labelled(spark, folder)
    found = folds.median_baseline(rows.filter(F.col("kind") == "numeric"), 5, skew)
    return found.select("task", "fold", "rows", F.round("score", 6).alias("score"))


@query("majority_baseline")
def majority_baseline(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = labelled(spark, folder)
    found = folds.majority_baseline(rows.filter(F.col("kind") != "numeric"), 5)
    return found.select("task", "fold", "rows", "majority", F.round("score", 9).alias("score"))


@query("fold_summary")
def fold_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Spread over the folds of the baseline and of a score that differs from it by the fold's number."""
    rows, skew = labelled(spark, folder)
    scores = E.baselines(materialize(rows, "labelled"), 5, skew).withColumn("score", 2 * F.col("baseline") + F.col("fold"))
    found = folds.fold_summary(scores)
    return found.select("task", "folds", *[F.round(c, 6).alias(c)
                                           for c in ("metric_mean", "metric_sd", "baseline_mean")])


def repeated(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """Labels with the label of the previous prefix as prediction, per actor of the last event."""
    src, skew = events_source(spark, folder)
    trace = T.trace_without_receives(src, skew)
    wide = L.label_columns(trace, ["NE-NEPr", "NV-TNE"], skew=skew)
    rows = trace.join(wide.drop("case_id"), ["log", "event_id"])
    if key == "NE-NEPr":
        return rows.select("actor", F.col("NE-NEPr").alias("y"), F.col("activity").alias("prediction"))
    return rows.select("actor", F.col("NV-TNE").alias("y"),
                       (F.length("event_id") * 1000.0).alias("prediction"))


@query("macro_f1")
def macro_f1(spark: SparkSession, folder: str) -> DataFrame:
    """Score of predicting that the current activity happens again, per actor."""
    found = folds.macro_f1(repeated(spark, folder, "NE-NEPr"), ["actor"])
    return found.withColumn("score", F.round("score", 9))


@query("mean_absolute_error")
def mean_absolute_error(spark: SparkSession, folder: str) -> DataFrame:
    """Error of a prediction made from the length of the event id, per actor."""
    found = folds.mean_absolute_error(repeated(spark, folder, "NV-TNE"), ["actor"])
    return found.withColumn("score", F.round("score", 6))


def linear_results(spark: SparkSession, folder: str, drop_collinear: bool) -> DataFrame:
    trace, skew = events_trace(spark, folder)
    tasks = tuple(k for k, t in TASKS.items() if t.kind == "numeric" and t.single_case)
    found = E.evaluate(trace, Experiment(tasks=tasks), skew, least_squares=True, drop_collinear=drop_collinear)
    return result_rows(found, 3)


@query("cv_linear")
def cv_linear(spark: SparkSession, folder: str) -> DataFrame:
    """Cross-validated least squares on the numeric targets. Every send of these logs is a message of its own, so
    that messages and sends so far are collinear and no fit is unique."""
    return linear_results(spark, folder, False)


@query("cv_linear_independent")
def cv_linear_independent(spark: SparkSession, folder: str) -> DataFrame:
    """The same without the features that depend on the others."""
    return linear_results(spark, folder, True)


def result_rows(found: DataFrame, digits: int) -> DataFrame:
    scores = [F.round(c, digits).alias(c) for c in ("metric_mean", "metric_sd", "baseline_mean")]
    return found.select("task", "samples", "ran_end_to_end", "metric_name", *scores, "folds", "participant", "obm_activity", "note")


def constant_results(spark: SparkSession, folder: str, tasks: tuple[str, ...]) -> DataFrame:
    src, skew = events_source(spark, folder)
    return result_rows(E.evaluate_constants(T.trace_without_receives(src, skew), Experiment(tasks=tasks), skew), 6)


@query("cv_baselines")
def cv_baselines(spark: SparkSession, folder: str) -> DataFrame:
    """Samples and baselines of the published targets, as the forests are held against."""
    return constant_results(spark, folder, Experiment().tasks)


@query("cv_baselines_full_catalog")
def cv_baselines_full_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """The same for every target that a plain log has too."""
    return constant_results(spark, folder, E.FULL_CATALOG)


@query("cv_forest")
def cv_forest(spark: SparkSession, folder: str) -> DataFrame:
    """Cross-validated forests with the published settings on the published targets."""
    trace, skew = events_trace(spark, folder)
    return E.evaluate(trace, Experiment(), skew)


# --- discovery -------------------------------------------------------------------------------------

@query("object_types")
def object_types(spark: SparkSession, folder: str) -> DataFrame:
    return discover.object_types(events_relations(spark, folder))


@query("event_types")
def event_types(spark: SparkSession, folder: str) -> DataFrame:
    return discover.event_types(events_relations(spark, folder))


@query("activities_per_type")
def activities_per_type(spark: SparkSession, folder: str) -> DataFrame:
    return discover.activities_per_type(events_relations(spark, folder, keep=True))


@query("directly_follows")
def directly_follows(spark: SparkSession, folder: str) -> DataFrame:
    """Directly-follows graph of all object types, participants included."""
    src, skew = events_source(spark, folder)
    return discover.directly_follows(M.transform(src, skew, keep=True), skew)


# --- sources and sinks -------------------------------------------------------------------------

def messy_frame(spark: SparkSession, folder: str) -> DataFrame:
    """A flat text frame of the events: padded, blank and missing values, unreadable times."""
    names, n = SourceColumns(), F.col("src_order")
    blank = F.when(n % 4 == 0, F.lit(" \t")).when(n % 4 == 1, F.lit("")).when(n % 4 == 2, F.lit("\u00a0"))
    participant = F.when(n % 10 == 0, blank).otherwise(
        F.concat(F.lit("\u00a0 "), F.col("participant"), F.lit("\t")))
    time = F.when(n % 9 == 0, F.lit("unknown")).otherwise(iso_time(F.col("ts")))
    return events_log(spark, folder).select(
        F.col("case_id").alias(names.case), F.col("activity").alias(names.activity),
        time.alias(names.timestamp),
        F.when(n % 6 != 0, F.concat(F.lit(" "), F.col("elem"))).alias(names.elem_type),
        participant.alias(names.participant), F.col("from_participant").alias(names.from_participant),
        F.col("to_participant").alias(names.to_participant),
        F.col("residual")["props"].alias("props"), n.alias("__position"))


@query("flat_frame")
def flat_frame(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaning, default element type, time coercion and residual attributes of a flat frame."""
    src = flat.source_events(messy_frame(spark, folder), "events", order_column="__position")
    return src.select(
        "log", "case_id", "src_order", "activity", iso_time(F.col("ts")).alias("ts"), "unread_ts", "elem", "participant",
        "from_participant", "to_participant", F.col("residual")["props"].alias("props"),
        F.size("residual").alias("attributes"))


@query("unreadable_times")
def unreadable_times(spark: SparkSession, folder: str) -> DataFrame:
    return flat.unreadable_times(messy_frame(spark, folder))


CHUNK = 500  # events of a case in one trace element


def write_event_log(spark: SparkSession, folder: str, part: str = "true") -> str:
    """The events as event-log XML, also only a part; long cases are spread over several trace elements."""
    src, skew = events_source(spark, folder)
    src = src.filter(part)
    names = SourceColumns()

    def attribute(key: str, value):
        return F.when(value.isNotNull(), F.struct(F.lit(key).alias("_key"), value.alias("_value")))

    texts = F.array(attribute(names.activity, F.col("activity")),
                    attribute(names.elem_type, F.col("elem")),
                    attribute(names.participant, F.col("participant")),
                    attribute(names.from_participant, F.col("from_participant")),
                    attribute(names.to_participant, F.col("to_participant")),
                    attribute("props", F.col("residual")["props"]))
    event = F.struct("idx", F.filter(texts, lambda a: a.isNotNull()).alias("string"),
                     F.array(attribute(names.timestamp, iso_time(F.col("ts")))).alias("date"))
    ordered = J.order_events(src, skew).df()
    traces = (ordered.groupBy("case_id", F.floor(F.col("idx") / CHUNK).alias("chunk"))
              .agg(F.sort_array(F.collect_list(event)).alias("events")))
    path = new_folder(spark, "event-log")
    (traces.select(
        F.array(F.struct(F.lit("concept:name").alias("_key"), F.col("case_id").alias("_value")))
        .alias("string"),
        F.transform("events", lambda e: F.struct(e["string"].alias("string"), e["date"].alias("date")))
        .alias("event"))
     .write.format("xml").option("rootTag", "log").option("rowTag", "trace").save(path))
    return path


@query("event_log_registry")
def event_log_registry(spark: SparkSession, folder: str) -> DataFrame:
    """Four event logs in one scan, a row for each: the events dealt to three, of which the third is not
    well-formed, and one that does not exist."""
    paths = {f"part{i}": write_event_log(spark, folder, f"src_order % 3 = {i}") for i in range(3)}
    broken = new_folder(spark, "broken-log")
    spark.read.text(paths["part2"]).select(F.replace("value", F.lit("</trace>"), F.lit("</event></trace>"))).write.text(broken)
    src, errors = xes.read_event_logs(spark, paths | {"part2": broken, "gone": f"{broken}-gone"})
    found = src.groupBy("log").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("case_id").alias("cases"),
                                   (F.max("src_order") + 1).alias("positions"), F.lit(False).alias("failed"))
    failed = [(e["log"], 0, 0, 0, True) for e in errors]
    return found.unionByName(spark.createDataFrame(
        failed, "log string, events long, cases long, positions long, failed boolean"))


@query("event_log_xml")
def event_log_xml(spark: SparkSession, folder: str) -> DataFrame:
    """Scan of event-log XML, and the message pairs found in it."""
    src = xes.read_event_log(spark, write_event_log(spark, folder), "events")
    matched = J.match_messages(src, Skew.of(src))
    return micros(matched, "ts").select(
        "log", "case_id", "event_id", "activity", "ts", "elem", "participant", "from_participant",
        "to_participant", F.col("residual")["props"].alias("props"),
        F.col("sent.event_id").alias("send_event"))


@query("relational_tables")
def relational_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Relational tables written, read back and turned into a trace."""
    path = new_folder(spark, "relational")
    relational.write_relational(events_relations(spark, folder, keep=True), path)
    return shown_trace(T.trace_of_relations(relational.read_relational(spark, path)))


@query("flat_ocel_frames")
def flat_ocel_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Trace from four flat frames with prefixed column names."""
    r = events_relations(spark, folder, keep=True)
    attrs = [V.case_id_attr, V.name_attr, V.participant_attr, V.sender_attr, V.receiver_attr]
    built = relational.relations_of_frames(
        r.events.select(F.col("eid").alias("ocel:eid"), F.col("activity").alias("ocel:activity"),
                        F.col("ts").alias("ocel:timestamp"), F.col("elem_type").alias(V.elem_type_attr),
                        F.col("residual")["props"].alias("props")),
        r.objects.select(F.col("oid").alias("ocel:oid"), F.col("otype").alias("ocel:type"),
                         *[F.col("attrs")[a].alias(a) for a in attrs]),
        r.e2o.select(F.col("eid").alias("ocel:eid"), F.col("oid").alias("ocel:oid"),
                     F.col("otype").alias("ocel:type"), F.col("qualifier").alias("ocel:qualifier")),
        r.o2o.select(F.col("src_oid").alias("ocel:oid"), F.col("tgt_oid").alias("ocel:oid_2"),
                     F.col("qualifier").alias("ocel:qualifier")), "events")
    return shown_trace(T.trace_of_relations(built))


@query("change_tables")
def change_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Trace from an event frame and change tables per object type; old names are replaced."""
    r = events_relations(spark, folder, keep=True)

    def changes(otype: str, *attrs: str) -> DataFrame:
        of_type = r.objects.filter(F.col("otype") == otype)
        values = [F.col("attrs")[a].alias(a) for a in attrs]
        now = of_type.select(F.col("oid").alias("object_id"), F.lit("2024-02-01").alias("ocel_time"),
                             F.lit(None).cast("string").alias("ocel_changed_field"), *values)
        before = [F.concat(F.lit("old "), F.col(a)).alias(a) for a in attrs]
        empty = [F.lit(None).cast("string").alias(a) for a in attrs]
        return (now.unionByName(now.select("object_id", F.lit("2024-01-01").alias("ocel_time"),
                                           "ocel_changed_field", *before))
                .unionByName(now.select("object_id", F.lit("2024-03-01").alias("ocel_time"),
                                        "ocel_changed_field", *empty)))

    tables = {V.instance: changes(V.instance, V.case_id_attr),
              V.participant: changes(V.participant, V.name_attr),
              V.local_case: changes(V.local_case, V.case_id_attr, V.participant_attr),
              V.message: changes(V.message, V.sender_attr, V.receiver_attr)}
    built = relational.relations_of_changes(
        r.events.select(F.col("eid").alias("event_id"), F.col("activity").alias("event_activity"),
                        F.col("ts").alias("event_timestamp"),
                        F.col("elem_type").alias("event_" + V.elem_type_attr)),
        r.objects.select(F.col("oid").alias("object_id"), F.col("otype").alias("type")), tables,
        r.e2o.select(F.col("eid").alias("ocel_event_id"), F.col("oid").alias("ocel_object_id"),
                     F.col("qualifier").alias("ocel_qualifier")),
        r.o2o.select(F.col("src_oid").alias("ocel_source_id"), F.col("tgt_oid").alias("ocel_target_id"),
                     F.col("qualifier").alias("ocel_qualifier")), "events")
    return shown_trace(T.trace_of_relations(built))


@query("json_documents")
def json_documents(spark: SparkSession, folder: str) -> DataFrame:
    """JSON documents written, read back and turned into a trace."""
    path = new_folder(spark, "documents")
    documents.write_documents(events_relations(spark, folder, keep=True), path)
    return shown_trace(T.trace_of_relations(documents.read_documents(spark, path)))


@query("json_violations")
def json_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Form check of JSON documents some of which lost keys or hold numbers instead of text."""
    path = new_folder(spark, "documents")
    sections = documents.document_sections(events_relations(spark, folder, keep=True))
    for section in ("eventTypes", "objectTypes"):
        sections[section].write.json(f"{path}/{section}")
    e = sections["events"].withColumns({
        "time": F.when(~F.col("id").endswith("3"), F.col("time")),
        "relationships": F.transform("relationships", lambda r: F.struct(
            r["objectId"].alias("objectId"),
            F.when(~F.col("id").endswith("8"), r["qualifier"]).alias("qualifier")))})
    e.write.option("ignoreNullFields", "true").json(f"{path}/events")
    # Entries that break the rules on types, names, times and lists.
    written = spark.read.schema("id STRING").json(f"{path}/events")     # not joined a second time
    rough = written.filter(F.col("id").endswith("7")).select(F.format_string(
        '{"id": %d, "type": "a", "time": "soon", "attributes": [{"value": "v"}], "relationships": "none"}',
        F.length("id")))
    rough.write.mode("append").text(f"{path}/events")
    bare = sections["eventTypes"].select(F.to_json(F.struct(F.concat("name", F.lit("-bare")).alias("name"))))
    bare.distinct().write.mode("append").text(f"{path}/eventTypes")
    o = sections["objects"].withColumn("attributes", F.transform("attributes", lambda a: F.struct(
        a["name"].alias("name"), F.length(a["value"]).alias("value"), a["time"].alias("time"))))
    o.write.json(f"{path}/objects")
    return documents.document_violations(spark, path)


@query("result_csv")
def result_csv(spark: SparkSession, folder: str) -> DataFrame:
    """A result table written as CSV and read back."""
    path = new_folder(spark, "results")
    report = fidelity_consistency(spark, folder)
    write_csv(report.withColumn("param", F.nullif(F.col("param"), F.lit(""))), path)
    return spark.read.option("header", True).schema(report.schema).csv(path, enforceSchema=False)


# --- the same with oversized groups ----------------------------------------------------------------

def _segmented(name: str, limit: int) -> Query:
    run = _queries[name]

    def small_groups(spark: SparkSession, folder: str) -> DataFrame:
        token = _limit.set(limit)
        try:
            return run(spark, folder)
        finally:
            _limit.reset(token)
    return small_groups


for _name, _rows in SEGMENTED.items():
    _queries[_name + "_segmented"] = _segmented(_name, _rows)
