"""Do two sources give the same labels, and are the object-only labels well defined?

Both comparisons cover every parameter value of a log. A parameter can only make a difference in
executions where it occurs, so labels are computed there, and prefixes of all other executions are
counted without building a row for each parameter.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.catalog import COMPARED_TASKS, EXTENDED_TASKS, TASKS, catalog_frame
from tracewright.operators.labels import (ACTIVITY, PARTICIPANT, all_label_rows, label_columns, parameter_domain,
                                           parameter_of, parameter_slots, wide_per_parameter)
from tracewright.operators.skew import Skew
from tracewright.operators.trace import trace_groups
from tracewright.operators.ordered import sum_all, sum_before
from tracewright.session import materialize

ALIGNED = ["log", "task", "param", "case_id", "k"]


def values_equal(key: str, ref: Column, obj: Column, tolerance: float, exact_counts: bool = False) -> Column:
    """Do two labels of one task agree? Numeric labels may differ by the tolerance.

    Counts use the tolerance as well unless `exact_counts` asks for equality.
    """
    if TASKS[key].kind != "numeric":
        return ref.eqNullSafe(obj)
    exact = exact_counts and TASKS[key].problem_type == TASKS["NV-NMPr"].problem_type
    near = ref == obj if exact else F.abs(ref - obj) <= F.lit(tolerance)
    return F.coalesce(near, ref.isNull() & obj.isNull())


def label_equal(kind: Column, problem_type: Column, tolerance: float,
                exact_counts: bool = False) -> Column:
    """Do `ref_*` and `obj_*` values agree? Numeric labels may differ by the tolerance.

    Counts use the tolerance as well unless `exact_counts` asks for equality.
    """
    near = F.abs(F.col("ref_num") - F.col("obj_num")) <= F.lit(tolerance)
    if exact_counts:
        near = F.when(problem_type == TASKS["NV-NMPr"].problem_type,
                      F.col("ref_num") == F.col("obj_num")).otherwise(near)
    both_missing = F.col("ref_num").isNull() & F.col("obj_num").isNull()
    numeric = F.coalesce(near, both_missing)
    return (F.when(kind == "numeric", numeric)
            .when(kind == "binary", F.col("ref_bool").eqNullSafe(F.col("obj_bool")))
            .otherwise(F.col("ref_str").eqNullSafe(F.col("obj_str"))))


def _side(labels: DataFrame, name: str) -> DataFrame:
    return labels.select(
        "log", "task", F.coalesce("param", F.lit("")).alias("param"), "case_id", "k",
        F.col("y_str").alias(f"{name}_str"), F.col("y_num").alias(f"{name}_num"),
        F.col("y_bool").alias(f"{name}_bool"), F.lit(True).alias(f"in_{name}"))


def align_labels(reference: DataFrame, object_centric: DataFrame, tolerance: float = 1.0,
                 exact_counts: bool = False) -> DataFrame:
    """Long labels of both sources side by side, with `aligned` and `equal` flags."""
    joined = _side(reference, "ref").join(_side(object_centric, "obj"), ALIGNED, "full_outer")
    tasks = F.broadcast(catalog_frame(reference.sparkSession).select("task", "kind", "problem_type"))
    aligned = F.col("in_ref").isNotNull() & F.col("in_obj").isNotNull()
    return joined.join(tasks, "task").withColumns({
        "aligned": aligned,
        "equal": aligned & label_equal(F.col("kind"), F.col("problem_type"), tolerance, exact_counts)})


def equivalence_summary(aligned: DataFrame) -> DataFrame:
    """Counts per log, task and parameter; agreement is NULL if nothing aligned."""
    counts = aligned.groupBy("log", "task", "param").agg(
        F.count_if("aligned").alias("eval_labels"), F.count_if("equal").alias("matches"),
        F.count_if(F.col("in_obj").isNull()).alias("only_in_reference"),
        F.count_if(F.col("in_ref").isNull()).alias("only_in_object_centric"))
    return _with_rates(counts)


def _with_rates(counts: DataFrame) -> DataFrame:
    n, matches = F.col("eval_labels"), F.col("matches")
    return counts.withColumns({"mismatches": n - matches,
                               "agreement": F.when(n > 0, matches / n)})


def mismatch_examples(aligned: DataFrame, most: int = 5) -> DataFrame:
    """The first mismatches per log, task and parameter in key order."""
    first = Window.partitionBy("log", "task", "param").orderBy("case_id", "k")
    return (aligned.filter(F.col("aligned") & ~F.col("equal"))
            .withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= most))


def prefixes(trace: DataFrame, skew: Skew | None = None, order: list[str] | None = None
             ) -> DataFrame:
    """(log, case_id, k) of every prefix that gets a label."""
    groups = trace_groups(trace, skew, order) if order else trace_groups(trace, skew)
    groups = groups.scan(_k=sum_before(F.lit(1)), _n=sum_all(F.lit(1)))
    k = (F.coalesce(F.col("_k"), F.lit(0)) + 1).cast("int")
    return groups.df().filter(k < F.col("_n")).select("log", "case_id", k.alias("k"))


def occurrences(*traces: DataFrame) -> DataFrame:
    """(log, case_id, kind, param): parameters that occur in a case of one of the traces."""
    found = None
    for trace in traces:
        sender = F.when(F.col("is_send"), F.col("msg_from"))
        people = trace.select("log", "case_id", F.lit("participant").alias("kind"),
                              F.explode(F.array("actor", sender)).alias("param"))
        activities = trace.filter("is_send").select(
            "log", "case_id", F.lit("activity").alias("kind"), F.col("activity").alias("param"))
        rows = people.unionByName(activities)
        found = rows if found is None else found.unionByName(rows)
    return found.filter(F.col("param") != "").distinct()


def equivalence(reference: DataFrame, object_centric: DataFrame,
                tasks: Iterable[str] = tuple(COMPARED_TASKS), tolerance: float = 1.0,
                exact_counts: bool = False, skew: Skew | None = None) -> DataFrame:
    """Compare the labels of two traces for every task and parameter value.

    The reference trace is ordered by source position, the other one by event id. Parameter values
    are those of the object-centric trace.
    """
    return _equivalence(reference, materialize(object_centric, "trace"), list(tasks), tolerance,
                        exact_counts, skew)


def _equivalence(reference: DataFrame, object_centric: DataFrame, tasks: list[str],
                 tolerance: float, exact_counts: bool, skew: Skew | None) -> DataFrame:
    reference = materialize(reference, "reference")
    domain = parameter_domain(object_centric)
    cases = materialize(occurrences(reference, object_centric).join(
        domain, ["log", "kind", "param"], "left_semi"), "parameters")
    plain = [t for t in tasks if not TASKS[t].param]
    asked = [t for t in tasks if TASKS[t].param]
    source_order = ["ts", "src_order"]
    # Labels of a prefix stay side by side: sources are joined once for all tasks, and only counts
    # are unpivoted.
    every = materialize(_compare(
        label_columns(reference, plain, skew=skew, order=source_order),
        label_columns(object_centric, plain, skew=skew), ["log", "case_id", "k"], "full_outer",
        ["log"], plain, tolerance, exact_counts), "plain-counts")
    found = [_unpivot(every, {t: F.lit("") for t in plain})] if plain else []
    if asked:
        slots = materialize(parameter_slots(cases, skew), "slots")
        pairs = _compare(
            wide_per_parameter(reference, asked, slots, skew, source_order),
            wide_per_parameter(object_centric, asked, slots, skew),
            ["log", "case_id", "_slot", "k"], "inner", ["log", PARTICIPANT, ACTIVITY], asked, tolerance,
            exact_counts)
        found.append(_unpivot(pairs, {t: parameter_of(t) for t in asked}))
    sparse = found[0]
    for part in found[1:]:
        sparse = sparse.unionByName(part)
    return _fill(sparse, every, domain, tasks)


def _compare(reference: DataFrame, object_centric: DataFrame, keys: list[str], how: str,
             by: list[str], tasks: list[str], tolerance: float, exact_counts: bool) -> DataFrame:
    """Rows of both sides, and for each task the aligned rows whose labels agree, per `by`."""
    def side(rows: DataFrame, name: str, more: list[str]) -> DataFrame:
        return rows.select(*keys, *more, F.lit(True).alias(f"in_{name}"),
                           *[F.col(f"`{t}`").alias(f"{name}:{t}") for t in tasks])

    both = side(reference, "ref", [c for c in by if c not in keys]).join(
        side(object_centric, "obj", []), keys, how)
    aligned = F.col("in_ref").isNotNull() & F.col("in_obj").isNotNull()
    equal = [F.count_if(aligned & values_equal(t, F.col(f"`ref:{t}`"), F.col(f"`obj:{t}`"), tolerance,
                                               exact_counts)).alias(f"equal:{t}") for t in tasks]
    return both.groupBy(*by).agg(
        F.count_if(aligned).alias("all_aligned"), F.count_if(F.col("in_obj").isNull()).alias("all_only_ref"),
        F.count_if(F.col("in_ref").isNull()).alias("all_only_obj"), *equal)


def _unpivot(counts: DataFrame, params: dict[str, Column]) -> DataFrame:
    """(log, task, param, eval_labels, matches) of compared tasks."""
    items = F.explode(F.array(*[
        F.struct(F.lit(t).alias("task"), param.alias("param"), F.col("all_aligned").alias("n"),
                 F.col(f"`equal:{t}`").alias("equal")) for t, param in params.items()])).alias("item")
    return (counts.select("log", items).filter(F.col("item.param").isNotNull())
            .groupBy("log", "item.task", "item.param")
            .agg(F.sum("item.n").alias("eval_labels"), F.sum("item.equal").alias("matches")))


def _asked(domain: DataFrame, every: DataFrame, tasks: list[str]) -> DataFrame:
    """One row per log, task and parameter value (`""` for tasks without one)."""
    catalog = catalog_frame(domain.sparkSession).filter(F.col("task").isin(tasks))
    plain = every.select("log", F.explode(F.array(*[F.lit(t) for t in tasks if not TASKS[t].param])
                                          .cast("array<string>")).alias("task"))
    asked = domain.join(F.broadcast(catalog.select("task", F.col("param_kind").alias("kind"))), "kind")
    return plain.withColumn("param", F.lit("")).unionByName(asked.select("log", "task", "param"))


def _fill(sparse: DataFrame, every: DataFrame, domain: DataFrame, tasks: list[str]) -> DataFrame:
    """Add the prefixes of executions in which the parameter does not occur: all equal."""
    joined = (_asked(domain, every, tasks).join(every, "log")
              .join(sparse, ["log", "task", "param"], "left"))
    computed, matches = F.coalesce("eval_labels", F.lit(0)), F.coalesce("matches", F.lit(0))
    filled = joined.select(
        "log", "task", "param", F.col("all_aligned").alias("eval_labels"),
        (matches + F.col("all_aligned") - computed).alias("matches"),
        F.col("all_only_ref").alias("only_in_reference"),
        F.col("all_only_obj").alias("only_in_object_centric"))
    return _with_rates(filled)


def ill_defined(problem_type: Column, value: Column) -> Column:
    """Counts must be whole and not negative, times not negative."""
    broken = F.when(problem_type.startswith("Count"), (value < 0) | (value != F.floor(value)))
    return F.coalesce(broken.otherwise(value < 0), F.lit(False))


def consistency_summary(labels: DataFrame) -> DataFrame:
    """Defined, undefined and ill-defined labels per log, task and parameter."""
    tasks = F.broadcast(catalog_frame(labels.sparkSession).select("task", "problem_type"))
    value = F.col("y_num")
    counts = labels.join(tasks, "task").groupBy(
        "log", "task", F.coalesce("param", F.lit("")).alias("param")).agg(
        F.count(F.lit(1)).alias("eval_labels"), F.count(value).alias("defined"),
        F.count_if(ill_defined(F.col("problem_type"), value)).alias("ill_defined"))
    return _with_verdict(counts)


def _with_verdict(counts: DataFrame) -> DataFrame:
    return counts.withColumns({"bottom": F.col("eval_labels") - F.col("defined"),
                               "well_defined": F.col("ill_defined") == 0})


def consistency(trace: DataFrame, tasks: Iterable[str] = tuple(EXTENDED_TASKS),
                skew: Skew | None = None) -> DataFrame:
    """Consistency of the object-only targets for every parameter value.

    Where a participant does not occur its load is 0, which is defined and well formed.
    """
    tasks = list(tasks)
    domain = parameter_domain(trace)
    cases = materialize(occurrences(trace), "parameters")
    sparse = consistency_summary(all_label_rows(trace, tasks, cases, skew))
    every = prefixes(trace, skew).groupBy("log").agg(F.count(F.lit(1)).alias("prefixes"))
    joined = (_asked(domain, every, tasks).join(every, "log")
              .join(sparse.drop("bottom", "well_defined"), ["log", "task", "param"], "left"))
    computed = F.coalesce("eval_labels", F.lit(0))
    filled = joined.select(
        "log", "task", "param", F.col("prefixes").alias("eval_labels"),
        (F.coalesce("defined", F.lit(0)) + F.col("prefixes") - computed).alias("defined"),
        F.coalesce("ill_defined", F.lit(0)).alias("ill_defined"))
    return _with_verdict(filled)


def fidelity_report(reference: DataFrame, object_centric: DataFrame, tolerance: float = 1.0,
                    skew: Skew | None = None) -> DataFrame:
    """Both comparisons in one table, in the published result layout."""
    object_centric = materialize(object_centric, "trace")
    equal = _equivalence(reference, object_centric, COMPARED_TASKS, tolerance, False, skew)
    defined = consistency(object_centric, skew=skew)
    return (equal.withColumn("check", F.lit("equivalence"))
            .unionByName(defined.withColumn("check", F.lit("internal_consistency")),
                         allowMissingColumns=True)
            .withColumn("param", F.nullif(F.col("param"), F.lit(""))))
