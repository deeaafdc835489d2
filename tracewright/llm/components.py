"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import keep


def _state(edges: DataFrame) -> tuple:
    """A fingerprint of a set of edges; equal before and after a round that changed nothing."""
    low = F.col("checksum").bitwiseAND(F.lit((1 << 40) - 1))
    row = (edges.select(F.xxhash64("a", "b").alias("checksum"))
           .agg(F.count(F.lit(1)), F.sum(low), F.bit_xor("checksum")).first())
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least of its neighbours and itself."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = keep(both.groupBy(F.col("a").alias("of")).agg(F.least(F.min("b"), F.first("a")).alias("least")), "stars")
    return (both.join(least, F.col("a") == F.col("of")).filter(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("least").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the least of them. Edges point downwards."""
    least = keep(edges.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("least")), "stars")
    found = edges.join(least, F.col("a") == F.col("of"))
    return (found.select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b"))
            .filter(F.col("a") != F.col("b")).distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """node, label for every node of `edges` (a, b): the least node it is connected with.

    Loops and repeated edges do no harm; nulls are ignored; no edges give no rows. Each half round
    finds the least neighbour of every node by a partial aggregation and writes it, so that the join
    back to the edges shuffles two plain tables and adaptive execution can split the edges of a node
    that holds a large part of them. Nothing but checksums comes to the driver.
    """
    down = (edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    now = keep(down, "edges")
    state = _state(now)
    while state[0]:
        now = keep(_small_star(keep(_large_star(now), "edges")), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.union(nodes.select(F.col("label").alias("node"), "label").distinct())
