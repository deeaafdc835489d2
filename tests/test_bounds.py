from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import functions as F

from conftest import event, frame
from tracewright.operators import forest
from tracewright.operators import labels as L
from tracewright.operators.ordered import OrderedGroups, sum_before
from tracewright.operators.skew import Skew
from tracewright.operators.trace import source_trace
from tracewright.session import prepare, size_shuffles

PARTITIONS = "spark.sql.shuffle.partitions"


def test_shuffled_partitions_stay_small(spark):
    before = spark.conf.get(PARTITIONS)
    try:
        size_shuffles(prepare(spark), 3_000_000)
        assert int(spark.conf.get(PARTITIONS)) >= 20
        assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "6m"
    finally:
        spark.conf.set(PARTITIONS, before)


def test_rows_repeated_per_parameter_get_more_partitions(spark):
    before = spark.conf.get(PARTITIONS)
    try:
        trace = source_trace(frame(spark, [event("c", i, i, who=f"P{i}") for i in range(40)]))
        L.wide_per_parameter(trace, ["NV-PaT"], L.parameter_domain(trace), Skew(rows=30_000, limit=10**9))
        assert int(spark.conf.get(PARTITIONS)) == 30_000 * 40 // 150_000 + 1
    finally:
        spark.conf.set(PARTITIONS, before)


def test_segments_are_few_while_they_are_small(spark):
    rows = spark.range(6_000).select(F.lit(1).alias("g"), "id")
    skew = Skew(rows=6_000, limit=3)
    assert skew.find(rows, ["g"]).segments <= skew.enough_segments + 1
    found = OrderedGroups(rows, ["g"], ["id"], skew).scan(n=sum_before(F.lit(1))).df()
    assert found.filter(F.coalesce("n", F.lit(0)) != F.col("id")).isEmpty() and found.count() == 6_000


def test_large_segments_keep_their_size(spark):
    found = Skew(rows=10).find(spark.range(10).select(F.lit(1).alias("g")), ["g"], fanout=10**6)
    assert found.segment_rows == Skew.limit and found.segments == 6


def test_models_meet_many_packs_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [("log", task, kind, int(rng.integers(3)), f"e{i}", [float(v) for v in rng.integers(0, 9, 3)], y)
            for task, kind in (("a", "numeric"), ("b", "categorical")) for i in range(200)
            for y in [str(float(rng.integers(5))) if kind == "numeric" else "xyz"[rng.integers(3)]]]
    df = spark.createDataFrame(rows, "log string, task string, kind string, fold int, event_id string, x array<double>, y string")
    monkeypatch.setattr(forest, "PART", 10)
    found = []
    for together in (1, 1000):
        monkeypatch.setattr(forest, "TOGETHER", together)
        found.append(sorted(map(tuple, forest.out_of_fold(df, 12, 50, 1, 10_000).collect())))
    assert len(found[0]) == 400 and found[0] == found[1]


def test_trees_travel_without_what_follows(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 300, (500, 3)).astype(float)
    trees = forest.grow_block(x, rng.choice(list("ab"), 500).tolist(), ["a", "b"], 3, 50, [1], 3)
    packed = forest.packed_trees(trees)
    again = forest.unpacked_trees(packed)
    assert all((trees[k] == again[k]).all() for k in ("feature", "threshold", "left"))
    assert (trees["value"][trees["feature"] < 0] == again["value"][trees["feature"] < 0]).all()
    assert len(pickle.dumps(packed)) < len(pickle.dumps(trees)) / 2


def test_orders_by_node_and_code():
    rng = np.random.default_rng(5)
    for nodes, width in ((3, 5), (70_000, 13), (90_000, 2), (50, 90_000), (70_000, 70_000)):
        node, code = np.sort(rng.integers(0, nodes, 100_000)), rng.integers(0, width, 100_000)
        assert (forest._order(node, code, nodes, width) == np.lexsort((code, node))).all()


def test_events_are_placed_before_they_are_repeated(spark):
    """Rows repeated per parameter of a case are sorted once, and reach their windows by the exchange of single events."""
    rows = [event(f"c{i % 9}", i, i, who="ABC"[i % 3]) for i in range(60)]
    trace = source_trace(frame(spark, rows))
    cases = trace.select("log", "case_id", F.lit("participant").alias("kind"), F.col("actor").alias("param")).distinct()
    slots = L.parameter_slots(cases).localCheckpoint()
    wide = L.wide_per_parameter(trace, ["NV-PaT", "OB-P"], slots, order=["ts", "src_order"])
    plan = wide._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [i for i, line in enumerate(plan) if "Join" in line][0]
    assert sum("Window [" in line for line in plan[:depth]) == 1
    assert wide.filter("k = 1 and _participant = 'A'").count() == len({r["case_id"] for r in cases.collect() if r["param"] == "A"})


def test_items_are_dropped_after_they_are_listed(spark):
    from tracewright.operators.mapping import event_object_rows
    from tracewright.operators.match import match_messages

    edges = event_object_rows(match_messages(frame(spark, [event("c", 1, 1, who="A"), event("c", 2, 2, who=None)])))
    assert "lambda" not in edges._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["qualifier"] for r in edges.collect()) == ["actor", "local", "within", "within"]
