"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words, and every document of it an expected number of copies in
proportion to its odds, at most `most`, such that the source's target results. The whole copies in that
number are certain. What is left of it is the document's inclusion probability for one more: it draws a
uniform number u, and documents are taken in the order of Pareto's ratio, odds(u) / odds(inclusion), until
the words still wanted are reached: a sample of fixed size with unequal probabilities.

Odds are whole numbers of a bounded range, so that expected copies are solved on sums of words per source
and odds. Taking documents in order needs no global sort: words are summed in 4096 bins of the ratio, the bin
in which the target falls is found per source, and only that bin is sorted. Documents below it are in,
documents above it are out. One last document whose size fits best closes what is then missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import WORD, hash_uniform, keep

BINS = 4096
MOST_ODDS = 10_000      # in hundredths
NEARLY = 1e-9           # an expected number of copies this close to a whole one is that


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(totals: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """One row per source: its weight and target, from (source, source_size).

    Sources in code point order, null last, take the weights in turn. A target above `most` times the
    source's size stops there and the excess goes to the others by weight: with sources ordered by
    limit / weight, the common level is the greatest that results if the first k stop at their limit.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    all_rows = Window.partitionBy()
    filling = Window.orderBy("reach", "place")
    return (totals.withColumn("place", place).withColumn("weight", weight)
            .withColumn("limit", F.col("source_size") * F.lit(float(most)))
            .withColumn("reach", F.col("limit") / F.col("weight"))
            .withColumn("stopped", F.coalesce(F.sum("limit").over(filling.rowsBetween(
                Window.unboundedPreceding, -1)), F.lit(0.0)))
            .withColumn("open_weight", F.sum("weight").over(filling.rowsBetween(
                Window.currentRow, Window.unboundedFollowing)))
            .withColumn("level", F.max((F.sum("source_size").over(all_rows) - F.col("stopped"))
                                       / F.col("open_weight")).over(all_rows))
            .withColumn("target", F.least("limit", F.col("weight") * F.col("level")))
            .select("source", "source_size", "weight", "target"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3, seed: int = 1,
                odds: str | None = None) -> DataFrame:
    """How often each document goes into the mix: doc_id, source, size, source_size, target, expected, copies, taken.

    docs: doc_id, text, source; further columns are ignored, but `odds` names one to which expected copies are
    proportional within a source, in steps of a hundredth from 0.01 to 100; what is below or above counts as these,
    null and NaN as 1. Without it a document's odds are the number of binary digits of its size, so that longer
    documents are likelier, slowly. `weights` are dealt to the sources in turn, `most` bounds copies.

    Null or empty texts have size 0 and may come along at no cost; very long ones count whole. A null source is a
    source of its own, a null doc_id an id of its own. Rows alike in source, doc_id, odds and size share their fate.
    Without words, all targets are 0. An empty table gives an empty mix.
    """
    size = word_count(F.col("text"))
    if odds is None:
        rows = docs.select("doc_id", "source", size.alias("size"))
        rows = rows.withColumn("odds", F.length(F.bin("size")).cast("long"))
    else:
        given = F.coalesce(F.nanvl(F.col(odds).cast("double"), F.lit(1.0)), F.lit(1.0))
        hundredths = F.round(F.least(F.greatest(given * 100, F.lit(1.0)), F.lit(float(MOST_ODDS)))).cast("long")
        rows = docs.select("doc_id", "source", size.alias("size"), hundredths.alias("odds"))
    rows = keep(rows, "mix-sizes")
    expected, targets = _expected_copies(rows, weights, most)

    u = hash_uniform(seed, F.col("doc_id"))
    part = F.col("expected") - F.col("whole")
    ratio = F.when(part > 0, u / (F.lit(1.0) - u) / (part / (F.lit(1.0) - part)))
    same = rows["source"].eqNullSafe(expected["of_source"]) & (rows["odds"] == expected["of_odds"])
    rows = rows.join(expected, same).select("doc_id", "source", "size", "expected", "whole", ratio.alias("z"))
    rows = keep(rows.withColumn("bin", _bin(F.col("z"))), "mix-rows")
    plan = _plan(rows.filter(F.col("z").isNotNull()), targets)
    mixed = rows.join(plan, rows["source"].eqNullSafe(plan["of_source"]))
    copies = _copies()
    return mixed.select("doc_id", "source", "size", "source_size", "target", "expected", copies.alias("copies"),
                        (copies * F.col("size")).alias("taken"))


def _expected_copies(rows: DataFrame, weights: Sequence[float], most: float) -> tuple[DataFrame, DataFrame]:
    """(of_source, of_odds, expected, whole), and per source its size, target and the words left after whole copies.

    Expected copies are `odds` times a source's level, but at most `most`. The level is the greatest that results
    if the k highest odds are held at `most`.
    """
    words = keep(rows.groupBy("source", "odds").agg(F.sum("size").alias("words")), "mix-words")
    targets = keep(source_targets(words.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most), "mix-targets")
    targets = targets.select(F.col("source").alias("of_source"), "source_size", "target")
    falling = Window.partitionBy("of_source").orderBy(F.col("odds").desc())
    held = F.coalesce(F.sum("words").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum(F.col("words") * F.col("odds")).over(falling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = F.max(F.when(F.col("open") > 0, (F.col("target") - F.lit(float(most)) * F.col("held")) / F.col("open"))).over(
        Window.partitionBy("of_source"))
    copies = F.coalesce(F.least(F.lit(float(most)), F.greatest(F.col("level") * F.col("odds"), F.lit(0.0))), F.lit(0.0))
    near = F.when(F.abs(F.col("e") - F.round("e")) < NEARLY, F.round("e")).otherwise(F.col("e"))
    solved = (words.join(targets, words["source"].eqNullSafe(targets["of_source"])).withColumn("held", held)
              .withColumn("open", open_).withColumn("level", level).withColumn("e", copies).withColumn("expected", near)
              .withColumn("whole", F.floor("expected").cast("long")))
    solved = keep(solved.select("of_source", F.col("odds").alias("of_odds"), "words", "source_size", "target", "expected",
                                "whole"), "mix-expected")
    left = solved.groupBy("of_source", "source_size", "target").agg(F.sum(F.col("whole") * F.col("words")).alias("certain"))
    left = left.withColumn("rest", F.col("target") - F.col("certain")).drop("certain")
    return solved.select("of_source", "of_odds", "expected", "whole"), keep(left, "mix-rest")


def repeat_mixed(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """The rows of `docs`, each as often as its `copies` in `mix` says: of rows there alike in doc_id, source and
    size the most. Further columns may have any names."""
    times = keep(mix.groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies")).filter("copies > 0"), "mix-copies")
    times = times.select(F.struct("doc_id", "source", "size").alias("of"), "copies")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), word_count(F.col("text")).alias("words"))
    same = (F.col("doc.doc_id").eqNullSafe(F.col("of.doc_id")) & F.col("doc.source").eqNullSafe(F.col("of.source"))
            & (F.col("words") == F.col("of.size")))
    return (own.join(times, same).select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
            .select("doc.*"))


def _bin(z: Column) -> Column:
    return F.least(F.floor(z / (F.lit(1.0) + z) * BINS), F.lit(BINS - 1)).cast("int")


def _place() -> Column:
    """A row's place in its source's order."""
    return F.struct("z", "doc_id", "size")


def _copies() -> Column:
    first = (F.col("bin") < F.col("edge")) | ((F.col("bin") == F.col("edge"))
                                              & F.coalesce(_place() <= F.col("last"), F.lit(False)))
    extra = first | F.coalesce(_place() == F.col("closing"), F.lit(False))
    return (F.col("whole") + F.when(F.coalesce(extra, F.lit(False)), 1).otherwise(0)).cast("long")


def _plan(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source: the place up to which documents get one more copy, and the closing one."""
    bins = keep(rows.groupBy("source", "bin").agg(F.sum("size").alias("words")), "mix-bins")
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bin")) - F.col("words")
    edges = (bins.withColumn("before", before)
             .join(targets.select("of_source", "rest"), F.col("source").eqNullSafe(F.col("of_source")))
             .filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
             .select("of_source", F.col("bin").alias("edge"), "before"))
    targets = keep(targets.join(edges.withColumnRenamed("of_source", "_s"),
                                F.col("of_source").eqNullSafe(F.col("_s")), "left").drop("_s"), "mix-edges")

    # Rows alike in all three count together, so a place decides for all of them.
    order = Window.partitionBy("source").orderBy("z", "doc_id", "size")
    on_edge = (rows.join(targets.select("of_source", "rest", "edge", "before"),
                         rows["source"].eqNullSafe(F.col("of_source")) & (F.col("bin") == F.col("edge")))
               .withColumn("upto", F.col("before") + F.sum("size").over(
                   order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
               .filter(F.col("upto") <= F.col("rest"))
               .groupBy(F.col("source").alias("_s"))
               .agg(F.max(_place()).alias("last"), F.max("upto").alias("reached")))
    plan = (targets.join(on_edge, F.col("of_source").eqNullSafe(F.col("_s")), "left").drop("_s")
            .withColumn("gap", F.col("rest") - F.coalesce("reached", "before", F.lit(0))))
    plan = keep(plan, "mix-cuts")

    # Beyond the cut, the document whose words come nearest to what is missing.
    beyond = (F.col("bin") > F.col("edge")) | ((F.col("bin") == F.col("edge"))
                                               & F.coalesce(_place() > F.col("last"), F.lit(True)))
    miss = F.abs(F.col("gap") - F.col("size"))
    best = (rows.join(plan.select("of_source", "edge", "last", "gap"),
                      rows["source"].eqNullSafe(F.col("of_source")) & (F.col("size") < 2 * F.col("gap")))
            .filter(beyond & (F.col("size") > 0))
            .groupBy(F.col("source").alias("_s")).agg(F.min(F.struct(miss.alias("miss"), _place().alias("at")))
                                                      .alias("best")))
    best = keep(best, "mix-closing")
    alike = (rows.join(best, rows["source"].eqNullSafe(F.col("_s")) & (_place() == F.col("best.at")))
             .groupBy(F.col("_s").alias("_t")).agg(F.sum("size").alias("adds")))
    best = best.join(alike, F.col("_s").eqNullSafe(F.col("_t"))).select("_s", "best.at", "adds")
    plan = (plan.join(best, F.col("of_source").eqNullSafe(F.col("_s")), "left")
            .withColumn("closing", F.when(F.abs(F.col("gap") - F.col("adds")) < F.col("gap"), F.col("at"))))
    return keep(plan.select("of_source", "source_size", "target", "edge", "last", "closing"), "mix-plan")
