"""Source positions from files: the same for any number of files and any splits."""

import pytest
from pyspark.sql import functions as F

from tracewright.operators.attributes import latest_attributes
from tracewright.sources import flat, position, relational, xes
from tracewright.config import SourceColumns

NAMES = SourceColumns()


@pytest.fixture
def tiny_splits(spark):
    sizes = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "1"}
    before = {key: spark.conf.get(key) for key in sizes}
    for key, value in sizes.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def write(df, path, form, files):
    df.repartitionByRange(files, "n").sortWithinPartitions("n").write.format(form).option("header", True).save(path)


@pytest.mark.parametrize("form", ["parquet", "json", "csv"])
@pytest.mark.parametrize("files", [1, 3, 40])
def test_positions_do_not_depend_on_files(spark, tmp_path, tiny_splits, form, files):
    rows = spark.range(2000).select(
        F.col("id").alias("n"), F.concat(F.lit("c"), F.col("id") % 7).alias(NAMES.case), F.lit("a").alias(NAMES.activity),
        F.lit("2024-01-01T00:00:00Z").alias(NAMES.timestamp), F.lit("P").alias(NAMES.participant), F.lit("task").alias(NAMES.elem_type),
        *[F.lit("Q").alias(c) for c in (NAMES.from_participant, NAMES.to_participant)])
    write(rows, str(tmp_path / "log"), form, files)
    back = spark.read.format(form).schema(rows.schema).option("header", True).load(str(tmp_path / "log"))
    assert form == "parquet" or back.rdd.getNumPartitions() > 1
    src = flat.source_events(back, "log")
    found = src.select("src_order", F.col("residual")["n"].cast("long").alias("n")).collect()
    assert sorted((r["src_order"], r["n"]) for r in found) == [(i, i) for i in range(2000)]


@pytest.mark.parametrize("files", [1, 5, 30])
@pytest.mark.parametrize("form", ["parquet", "json"])
def test_the_later_of_equal_times_wins_in_any_files(spark, tmp_path, tiny_splits, form, files):
    rows = spark.range(1000).select(
        F.col("id").alias("n"), F.concat(F.lit("o"), F.col("id") % 10).alias("ocel_id"), F.lit("2024").alias("ocel_time"),
        F.col("id").cast("string").alias("value"))
    write(rows, str(tmp_path / "object"), form, files)
    table = spark.read.format(form).schema(rows.schema).load(str(tmp_path / "object")).drop("n")
    versions = relational._versions(table, F.lit("log"))
    assert {r["oid"]: r["attrs"]["value"] for r in latest_attributes(versions).collect()} == {
        f"o{i}": str(990 + i) for i in range(10)}


def log_text(cases):
    event = '<event><string key="concept:name" value="{}"/></event>'
    return "<log>" + "".join(f'<trace><string key="concept:name" value="{c}"/>' + "".join(map(event.format, names))
                             + "</trace>" for c, names in cases) + "</log>"


@pytest.mark.parametrize("cut", [[6], [1, 2, 3], [1] * 6])
def test_positions_in_event_logs(spark, tmp_path, tiny_splits, cut):
    cases = [(f"c{i}", [f"{i}-{k}" for k in range(1 + i % 3)]) for i in range(6)]
    (tmp_path / "log").mkdir()
    start = 0
    for number, size in enumerate(cut):
        (tmp_path / "log" / f"{number:03}.xes").write_text(log_text(cases[start:start + size]))
        start += size
    src = xes.read_event_log(spark, str(tmp_path / "log"), "l")
    assert [(r["src_order"], r["activity"]) for r in src.orderBy("src_order").collect()] == list(
        enumerate(name for _, names in cases for name in names))


def test_several_logs_in_one_scan(spark, tmp_path):
    (tmp_path / "a b%.xes").write_text(log_text([("x", ["1", "2"])]))
    (tmp_path / "b.xes").write_text(log_text([("x", ["3"]), ("y", [])]))
    (tmp_path / "c.xes").write_text(log_text([("x", ["4"]), ("y", ["5"])]).replace("</trace>", "</event></trace>", 1))
    (tmp_path / "e.xes").write_text("<log></log>")
    paths = {name: str(tmp_path / f"{name}.xes") for name in ("a b%", "b", "c", "d", "e")} | {"again": str(tmp_path / "b.xes")}
    src, errors = xes.read_event_logs(spark, paths)
    assert sorted((r["log"], r["src_order"], r["activity"]) for r in src.collect()) == [
        ("a b%", 0, "1"), ("a b%", 1, "2"), ("again", 0, "3"), ("b", 0, "3")]
    assert [e["log"] for e in errors] == ["c", "d"] and all(e["error"] for e in errors)
    none, errors = xes.read_event_logs(spark, {"d": paths["d"]})
    assert none is None and [e["log"] for e in errors] == ["d"]
    with pytest.raises(ValueError):
        xes.read_event_log(spark, paths["c"], "c")


def test_frames_without_files_and_empty_folders(spark, tmp_path):
    rows = position.with_position(spark.range(10).repartition(3), "at")
    assert rows.select("at").distinct().count() == 10
    spark.range(0).write.parquet(str(tmp_path / "none"))
    assert position.with_position(spark.read.parquet(str(tmp_path / "none")), "at").count() == 0
