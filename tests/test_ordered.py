"""Segmented scans give what windows give."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import forced, same_rows
from tracewright.operators import ordered as O
from tracewright.operators.skew import Skew


def rows(seed):
    rng = random.Random(seed)
    return [(rng.choice(["a", "a", "a", "b", None, "c"]), rng.choice([None, 1, 2, 3, 4]), i,
             rng.choice([None, rng.randint(-5, 5)])) for i in range(120)]


def scans():
    v = F.col("v")
    return dict(
        s=O.sum_before(v), a=O.sum_after(v), t=O.sum_all(v), lo=O.min_before(v), hi=O.max_after(v),
        least=O.min_all(v), most=O.max_all(v), p=O.previous(v), f=O.following(v),
        nxt=O.next_row("i", "v"), n=O.sum_before(F.lit(1)))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_segments_equal_windows(spark, seed):
    df = spark.createDataFrame(rows(seed), "k string, o int, i int, v int")
    plain = O.OrderedGroups(df, ["k"], ["o", "i"]).scan(**scans())
    cut = O.OrderedGroups(df, ["k"], ["o", "i"], forced(df)).scan(**scans())
    assert cut._cut is not None
    same_rows(plain.df(), cut.df())


def test_scans_follow_each_other(spark):
    df = spark.createDataFrame(rows(4), "k string, o int, i int, v int")

    def chained(groups):
        groups = groups.scan(x=O.sum_before(F.col("v")))
        groups = groups.with_columns({"x": F.coalesce("x", F.lit(0)) + F.coalesce("v", F.lit(0))})
        return groups.scan(low=O.min_before(F.col("x")), late=O.sum_after(F.col("x"))).df()

    same_rows(chained(O.OrderedGroups(df, ["k"], ["o", "i"])),
              chained(O.OrderedGroups(df, ["k"], ["o", "i"], forced(df))))


def test_groups_found_by_part_of_the_keys(spark):
    df = spark.createDataFrame(rows(5), "k string, o int, i int, v int").withColumn("sub", F.col("i") % 2)
    plain = O.OrderedGroups(df, ["k", "sub"], ["o", "i"]).scan(**scans())
    cut = O.OrderedGroups(df, ["k", "sub"], ["o", "i"], forced(df, 10), by=["k"]).scan(**scans())
    same_rows(plain.df(), cut.df())


def test_equal_times_are_cut_too(spark):
    df = spark.createDataFrame([("a", 1, i, 1) for i in range(50)], "k string, o int, i int, v int")
    cut = O.OrderedGroups(df, ["k"], ["o", "i"], forced(df, 5))
    sizes = [r["count"] for r in cut._cut.groupBy(O.SEGMENT).count().collect()]
    assert len(sizes) > 3 and max(sizes) < 25
    same_rows(O.OrderedGroups(df, ["k"], ["o", "i"]).scan(**scans()).df(), cut.scan(**scans()).df())


def test_small_sources_cost_no_lookup(spark):
    df = spark.createDataFrame([("a", 1)], "k string, i int")
    assert Skew.of(df).find(df, ["k"]) is None
    assert Skew.of(df, limit=0).find(df, ["k"]) is not None


def test_one_exchange_for_all_directions(spark):
    df = spark.createDataFrame(rows(1), "k string, o int, i int, v int")
    plan = O.OrderedGroups(df, ["k"], ["o", "i"]).scan(**scans()).df()._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert physical.count("Exchange hashpartitioning") == 1


def test_lookups_are_kept_per_kind_of_row(spark):
    df = spark.createDataFrame([("a", i) for i in range(9)], "k string, i int")
    skew = forced(df, 5)
    assert skew.find(df.filter("i < 3"), ["k"], of="cases") is None
    assert skew.find(df, ["k"]).rows == 9


def test_regrouping_needs_the_columns_groups_were_found_by(spark):
    df = spark.createDataFrame([("a", 1, 2)], "k string, o int, i int")
    groups = O.OrderedGroups(df, ["k"], ["o"])
    assert groups.regroup(["k", "i"], ["o"]).keys == ["k", "i"]
    with pytest.raises(ValueError):
        groups.regroup(["i"], ["o"])
