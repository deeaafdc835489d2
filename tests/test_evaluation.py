"""Label comparison, features, folds, baselines and cross-validation."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from conftest import event, forced, frame, same_rows
from data import random_rows
from tracewright.catalog import COMPARED_TASKS, TASKS
from tracewright.config import Experiment
from tracewright.operators import features as FE
from tracewright.operators import fidelity as FI
from tracewright.operators import folds as FO
from tracewright.operators import labels as L
from tracewright.operators import match as J
from tracewright.operators import sparse as SP
from tracewright.operators import trace as T
from tracewright.operators.mapping import transform
from tracewright.plans import evaluation as E


def trace_of(spark, rows):
    return T.trace_of_matched(J.match_messages(frame(spark, rows)))


def distinct_times(rows):
    """The two sides order ties differently, so give every event a time of its own."""
    from conftest import at
    return [(*r[:4], at(i), *r[5:]) for i, r in enumerate(rows)]


def test_both_sources_agree(spark):
    rows = distinct_times(random_rows(21, cases=6, longest=9))
    src = frame(spark, rows)
    report = FI.fidelity_report(T.source_trace(src), T.trace_of_relations(transform(src)))
    prefixes = FI.prefixes(T.source_trace(src)).count()
    rows = report.collect()
    assert {r["task"] for r in rows} == set(TASKS)
    for r in rows:
        assert r["eval_labels"] == prefixes
        if r["check"] == "equivalence":
            assert r["mismatches"] == 0 and r["agreement"] == 1.0
        else:
            assert r["defined"] + r["bottom"] == prefixes


def test_counts_equal_dense_comparison(spark):
    rows = distinct_times(random_rows(22, cases=8, longest=9))
    src = frame(spark, rows)
    other = frame(spark, rows[::7] + [r for i, r in enumerate(rows) if i % 7 and i % 5])
    ref, obj = T.source_trace(src), trace_of(spark, other.collect())
    domain = L.parameter_domain(obj)
    dense = FI.equivalence_summary(FI.align_labels(
        L.all_label_rows(ref, COMPARED_TASKS, domain, order=["ts", "src_order"]),
        L.all_label_rows(obj, COMPARED_TASKS, domain)))
    same_rows(dense, FI.equivalence(ref, obj, skew=forced(src)))


def sides(spark, ref, obj):
    schema = "log string, task string, param string, case_id string, event_id string, k int, " \
             "y_str string, y_num double, y_bool boolean"
    make = lambda rows: spark.createDataFrame(rows, schema)
    return make(ref), make(obj)


def row(task, k, y_str=None, y_num=None, y_bool=None, case="c"):
    return "log", task, None, case, "e", k, y_str, y_num, y_bool


def test_tolerance_covers_counts_unless_exact(spark):
    ref, obj = sides(spark, [row("NV-NMPr", 1, y_num=2.0)], [row("NV-NMPr", 1, y_num=3.0)])
    assert FI.equivalence_summary(FI.align_labels(ref, obj)).first()["matches"] == 1
    assert FI.equivalence_summary(FI.align_labels(ref, obj, exact_counts=True)).first()["matches"] == 0


def test_undefined_equals_undefined_only(spark):
    ref, obj = sides(spark, [row("NE-NEPr", 1), row("NE-NEPr", 2), row("NV-TNE", 1)],
                     [row("NE-NEPr", 1), row("NE-NEPr", 2, "a"), row("NV-TNE", 1, y_num=0.5)])
    found = {r["task"]: r["matches"] for r in FI.equivalence_summary(FI.align_labels(ref, obj)).collect()}
    assert found == {"NE-NEPr": 1, "NV-TNE": 0}


def test_nothing_in_common(spark):
    ref, obj = sides(spark, [row("NE-NEPr", 1, "a")], [row("NE-NEPr", 2, "a")])
    r = FI.equivalence_summary(FI.align_labels(ref, obj)).first()
    assert (r["eval_labels"], r["agreement"]) == (0, None)
    assert (r["only_in_reference"], r["only_in_object_centric"]) == (1, 1)


def test_first_mismatches(spark):
    ref, obj = sides(spark, [row("NE-NEPr", k, "a") for k in range(1, 9)],
                     [row("NE-NEPr", k, "b") for k in range(1, 9)])
    found = FI.mismatch_examples(FI.align_labels(ref, obj)).collect()
    assert sorted(r["k"] for r in found) == [1, 2, 3, 4, 5]


def test_ill_defined(spark):
    labels, _ = sides(spark, [row("X-PaL", 1, y_num=1.5), row("X-PaL", 2, y_num=-1.0), row("X-PaL", 3, y_num=2.0),
                              row("X-MSt", 1, y_num=-0.5), row("X-MSt", 2), row("X-MSt", 3, y_num=0.5)], [])
    found = {r["task"]: (r["defined"], r["bottom"], r["ill_defined"], r["well_defined"])
             for r in FI.consistency_summary(labels).collect()}
    assert found == {"X-PaL": (3, 0, 2, False), "X-MSt": (2, 1, 1, False)}


# --- features ----------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def sample(spark):
    rows = distinct_times(random_rows(31, cases=20, longest=10))
    return rows, trace_of(spark, rows).cache()


def test_features_look_back_only(spark, sample):
    import brute
    rows, trace = sample
    names = FE.activity_names(trace)
    table = {r["event_id"]: r for r in FE.feature_table(trace, names, forced(trace)).collect()}
    long = {(r["event_id"], r["activity"]): r["occurrences"]
            for r in FE.preceding_activities(trace, forced(trace)).collect()}
    direct = {r["event_id"]: r for r in FE.feature_table(trace, names, direct=True).collect()}
    for events in brute.trace(rows).values():
        for i, e in enumerate(events):
            past, r = events[:i], table[e["id"]]
            assert r["elapsed"] == e["ts"] - events[0]["ts"] and r["remaining"] == events[-1]["ts"] - e["ts"]
            assert r["previous_participants"] == len({x["actor"] for x in past if x["actor"]})
            assert r["previous_messages"] == len({x["message"] for x in past if x["message"]})
            for n, a in enumerate(names):
                count = sum(x["activity"] == a for x in past)
                assert r[f"before_{n}"] == count and long.get((e["id"], a), 0) == count
                assert direct[e["id"]][f"before_{n}"] == float(bool(past) and past[-1]["activity"] == a)


def test_any_number_of_activities(spark):
    rows = [event("c", i, i, activity=f"a{i:05}") for i in range(1200)]
    trace = trace_of(spark, rows)
    names = FE.activity_names(trace)
    assert names == sorted(names) and len(names) == 1200
    assert FE.preceding_activities(trace).count() == 1200 * 1199 // 2


def as_counts(rows):
    return {r["event_id"]: dict(zip(r["at"], r["x"])) for r in rows}


@pytest.mark.parametrize("block", [1, 3, 64])
def test_sparse_features_are_the_wide_ones(spark, sample, monkeypatch, block):
    monkeypatch.setattr(SP, "BLOCK", block)
    _, trace = sample
    names = FE.activity_names(trace)
    index = SP.activity_index(trace)
    assert {r["place"]: r["activity"] for r in index.collect()} == dict(enumerate(names))
    columns = FE.BASE_FEATURES + FE.activity_columns(names)
    wide = {r["event_id"]: {i: r[c] for i, c in enumerate(columns) if i < 3 or r[c]}
            for r in FE.feature_table(trace, names).collect()}
    for skew in (None, forced(trace)):
        found = SP.feature_vectors(trace, index, skew).collect()
        assert len(found) == len(wide) and as_counts(found) == wide
        assert all(r["at"] == sorted(r["at"]) for r in found)


def test_sparse_features_of_odd_events(spark):
    """No activity, an activity missing in the index, an empty trace, equal activities in two logs."""
    rows = [event("c", 0, 0, activity="b"), event("c", 1, 1, activity="none"), event("c", 2, 2, activity="a"),
            event("c", 3, 3, activity="b"), event("d", 0, 0, activity="b")]
    trace = trace_of(spark, rows).withColumn("activity", F.nullif("activity", F.lit("none")))
    index = SP.activity_index(trace)
    counts = {r["event_id"]: [tuple(e) for e in r["entries"]] for r in SP.activity_counts(trace, index).collect()}
    assert sorted(counts.values()) == [[], [], [(0, 1), (1, 1)], [(1, 1)], [(1, 1)]]
    only = index.filter("activity = 'a'")
    assert sorted(r["entries"] != [] for r in SP.activity_counts(trace, only).collect()) == [False] * 4 + [True]
    none = trace.limit(0)
    assert SP.activity_index(none).count() == 0 and SP.feature_vectors(none, index).count() == 0


def test_sparse_features_of_many_activities(spark):
    """100,000 activities: no column each, and an execution whose activities all differ."""
    rows = [event(f"c{i % 500}", i, i, activity=f"a{i:06}") for i in range(100_000)]
    trace = trace_of(spark, rows)
    index = SP.activity_index(trace)
    found = SP.feature_vectors(trace, index).select(
        F.size("at").alias("n"), F.array_max("at").alias("top"), F.aggregate("x", F.lit(0.0), lambda a, b: a + b).alias("s"))
    r = found.agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.max("top").alias("top")).first()
    # The last event of the last execution follows the activity 500 places before the last one.
    assert (r["rows"], r["n"], r["top"]) == (100_000, 300_000 + 500 * 200 * 199 // 2, 3 + 99_999 - 500)


def test_alignment(spark, sample):
    _, trace = sample
    table = FE.past_features(trace)
    FE.require_aligned(FE.misaligned(table, trace))
    moved = table.withColumn("remaining", F.col("remaining") + 1.5)
    with pytest.raises(RuntimeError):
        FE.require_aligned(FE.misaligned(moved, trace))


# --- folds and baselines -----------------------------------------------------------------------

def test_folds_are_grouped_and_even(spark):
    rows = spark.createDataFrame([("log", f"c{i}", j) for i in range(23) for j in range(1 + i % 4)],
                                 "log string, case_id string, j int")
    folds = FO.grouped_folds(rows, 5)
    sizes = [r["rows"] for r in folds.groupBy("fold").agg(F.sum("rows").alias("rows")).collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 4
    same_rows(folds, FO.grouped_folds(rows, 5, forced(rows)))


@pytest.mark.parametrize("seed", range(4))
def test_every_case_goes_to_the_lightest_fold(spark, seed):
    rng = random.Random(seed)
    sizes = {f"c{i:03}": rng.choice([1, 1, 2, 3, 5, 8, 13, 40]) for i in range(rng.randrange(3, 70))}
    rows = spark.createDataFrame([("log", case, j) for case, n in sizes.items() for j in range(n)],
                                 "log string, case_id string, j int")
    k = min(5, len(sizes))
    loads, wanted = [0] * k, {}
    for case in sorted(sizes, key=lambda c: (-sizes[c], c)):
        wanted[case] = loads.index(min(loads))
        loads[wanted[case]] += sizes[case]
    assert {r["case_id"]: r["fold"] for r in FO.grouped_folds(rows, 5).collect()} == wanted


def test_single_case_has_no_folds(spark):
    rows = spark.createDataFrame([("log", "c", 1)], "log string, case_id string, j int")
    assert FO.grouped_folds(rows, 5).first()["fold"] is None


def labelled(spark, seed, n=60):
    rng = random.Random(seed)
    return [("log", "t", rng.randrange(5), rng.choice([1.0, 2.0, 2.0, 7.5, 9.0]), rng.choice("aabc"))
            for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_median_baseline(spark, seed):
    rows = labelled(spark, seed)
    df = spark.createDataFrame(rows, "log string, task string, fold int, y_num double, y_str string")
    for skew in (None, forced(df, 2)):
        found = {r["fold"]: r["score"] for r in FO.median_baseline(df, 5, skew).collect() if r["rows"]}
        for f in found:
            train = [r[3] for r in rows if r[2] != f]
            test = [r[3] for r in rows if r[2] == f]
            middle = statistics.median(train)
            assert found[f] == pytest.approx(sum(abs(y - middle) for y in test) / len(test))


def plain_f1(pairs):
    labels, total = {y for y, _ in pairs} | {p for _, p in pairs}, 0.0
    for label in labels:
        tp = sum(y == p == label for y, p in pairs)
        total += 2 * tp / (sum(y == label for y, _ in pairs) + sum(p == label for _, p in pairs))
    return total / len(labels)


@pytest.mark.parametrize("seed", [1, 2])
def test_majority_baseline(spark, seed):
    rows = labelled(spark, seed, 25)
    df = spark.createDataFrame(rows, "log string, task string, fold int, y_num double, y_str string")
    df = df.withColumns({"kind": F.lit("categorical"), "y_bool": F.lit(None).cast("boolean")})
    for r in FO.majority_baseline(df, 5).collect():
        train = [x[4] for x in rows if x[2] != r["fold"]]
        best = min(sorted(set(train)), key=lambda y: -train.count(y))
        assert r["majority"] == best
        assert r["score"] == pytest.approx(plain_f1([(x[4], best) for x in rows if x[2] == r["fold"]]))


def test_macro_f1_counts_labels_of_both_sides(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "c"), ("a", "a")]
    df = spark.createDataFrame([("g", *p) for p in pairs], "g string, y string, prediction string")
    r = FO.macro_f1(df, ["g"]).first()
    assert r["score"] == pytest.approx(plain_f1(pairs)) and r["rows"] == 4


def test_fold_summary_uses_population_deviation(spark):
    df = spark.createDataFrame([("log", "t", 0, 1.0, 2.0), ("log", "t", 1, 3.0, 4.0)],
                               "log string, task string, fold int, score double, baseline double")
    r = FO.fold_summary(df).first()
    assert (r["metric_mean"], r["metric_sd"], r["baseline_mean"], r["folds"]) == (2.0, 1.0, 3.0, 2)


def test_most_frequent_value_ties_go_to_the_first_seen(spark):
    trace = trace_of(spark, [event("z", 0, 5, who="B"), event("a", 1, 0, who="A"),
                             event("a", 2, 1, "SendTask", "A", activity="s"), event("z", 3, 6, who="B")])
    best = {r["kind"]: r["param"] for r in FO.most_frequent(trace).collect()}
    assert best == {"participant": "B", "activity": "s"}


# --- learners ----------------------------------------------------------------------------------

def test_cross_validation(sample):
    _, trace = sample
    small = Experiment(tasks=("NE-NPaA", "NV-NMPr", "OB-M"), trees=5, max_depth=4, folds=3)
    rows = {r["task"]: r for r in E.evaluate(trace, small).collect()}
    assert set(rows) == {"NE-NPaA", "NV-NMPr", "OB-M"}
    for r in rows.values():
        assert r["ran_end_to_end"] and r["folds"] == 3 and r["note"] is None
        assert r["metric_mean"] >= 0 and r["baseline_mean"] >= 0
    assert rows["OB-M"]["metric_name"] == "f1_macro" and rows["OB-M"]["obm_activity"]


def test_linear_learner_skips_classes(sample):
    _, trace = sample
    small = Experiment(tasks=("NE-NPaA", "NV-PrT"), folds=2)
    rows = {r["task"]: (r["folds"], r["note"])
            for r in E.evaluate(trace, small, least_squares=True, drop_collinear=True).collect()}
    assert rows == {"NE-NPaA": (None, None), "NV-PrT": (2, None)}
    # Messages so far are sends so far.
    rows = {r["task"]: (r["metric_mean"], r["note"]) for r in E.evaluate(trace, small, least_squares=True).collect()}
    assert rows == {"NE-NPaA": (None, None), "NV-PrT": (None, "every fit is singular")}


def test_too_few_cases(spark):
    trace = trace_of(spark, [event("c", i, i) for i in range(4)])
    r = E.evaluate(trace, Experiment(tasks=("NE-NEPr", "NE-NPaM"))).orderBy("task").collect()
    assert r[0]["note"] == "a single case cannot be split" and r[0]["metric_mean"] is None
    assert r[1]["note"] == "no labelled rows" and r[1]["samples"] == 0


def test_forest_query_has_the_published_settings(spark, monkeypatch):
    from tracewright.config import Experiment as Settings
    from tracewright.plans import queries

    asked = []
    monkeypatch.setattr(queries, "events_trace", lambda spark, folder: (None, None))
    monkeypatch.setattr(queries.E, "evaluate", lambda trace, experiment, skew: asked.append(experiment))
    queries.registered()["cv_forest"](spark, "")
    assert asked == [Settings()] and len(asked[0].tasks) == 6


def test_labels_are_computed_once_for_folds(spark):
    rows = [("l", "t", f"c{i % 4}", f"e{i}", i) for i in range(20)]
    calls = spark.sparkContext.accumulator(0)

    def same(text):
        calls.add(1)
        return text

    labels = spark.createDataFrame(rows, "log string, task string, case_id string, event_id string, k int")
    counted = labels.withColumn("case_id", F.udf(same, "string").asNondeterministic()("case_id"))
    dealt = E.with_folds(counted, 2).collect()
    assert calls.value == len(rows) == len(dealt)
    assert len({(r["case_id"], r["fold"]) for r in dealt}) == 4
