"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered in a fixed order. A keyed Feistel network with cycle walking permutes the numbers
0..n-1 among themselves, so that `p` = permuted number gives shard p % shards and slot p // shards: a
reproducible shuffle in which any row's place, and any place's row, can be computed without a table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import keep

ROUNDS = 6
# Odd multipliers below 2^32 and 2^31, so that products of 31- and 32-bit numbers fit 63 bits.
MULTIPLY = (0x9E3779B1, 0x2C1B3C6D)


def half_bits(rows: int) -> int:
    """Bits of one half of the smallest even-sized domain that holds `rows` numbers (at most 2^62)."""
    return max(1, (max(rows - 1, 1).bit_length() + 1) // 2)


def round_keys(seed: int) -> list[int]:
    return [(seed * 0x5851F42D + (i + 1) * 0x14057B7F) & 0xFFFFFFFF for i in range(ROUNDS)]


def _round(half: np.ndarray, key: int, mask: int) -> np.ndarray:
    x = (half * MULTIPLY[0] + key) & 0xFFFFFFFF
    x = ((x ^ (x >> 15)) * MULTIPLY[1]) & 0xFFFFFFFF
    return (x ^ (x >> 13)) & mask


def _network(x: np.ndarray, bits: int, keys: list[int]) -> np.ndarray:
    mask = (1 << bits) - 1
    left, right = x >> bits, x & mask
    for key in keys:
        left, right = right, left ^ _round(right, key, mask)
    return (left << bits) | right


def _inverse_network(x: np.ndarray, bits: int, keys: list[int]) -> np.ndarray:
    mask = (1 << bits) - 1
    left, right = x >> bits, x & mask
    for key in reversed(keys):
        left, right = right ^ _round(left, key, mask), left
    return (left << bits) | right


def _walk(x: np.ndarray, rows: int, seed: int, network) -> np.ndarray:
    """Apply the network until the number is below `rows`; the domain is at most 4 times as large."""
    bits, keys = half_bits(rows), round_keys(seed)
    x = network(np.asarray(x, np.int64), bits, keys)
    out = np.flatnonzero(x >= rows)
    while out.size:
        x[out] = network(x[out], bits, keys)
        out = out[x[out] >= rows]
    return x


def permute(numbers: np.ndarray, rows: int, seed: int) -> np.ndarray:
    """Where the rows with these numbers (0 to rows-1) go."""
    return _walk(numbers, rows, seed, _network)


def unpermute(places: np.ndarray, rows: int, seed: int) -> np.ndarray:
    """Which rows are at these places; the inverse of `permute`."""
    return _walk(places, rows, seed, _inverse_network)


def number_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """`df` with row_number from 0, in the order of the columns `order`, without one global task.

    Range partitions are sorted and written; a row's number is its place in its partition plus the rows
    of all partitions before. Rows alike in all of `order` are numbered as they come, which also spreads
    them over partitions.
    """
    first = keep(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    sort = [F.col(c).asc_nulls_first() for c in [*order, "_row"]]
    placed = keep(first.repartitionByRange(*sort).sortWithinPartitions(*sort)
                  .withColumn("_at", F.monotonically_increasing_id()).drop("_row"), "rows-sorted")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.orderBy("_part")) - F.col("rows")     # one row per partition
    starts = keep(sizes.select(F.col("_part").alias("_of"), before.alias("_before")), "rows-before")
    return (placed.join(starts, F.col("_part") == F.col("_of"))
            .withColumn("row_number", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("_at", "_part", "_of", "_before"))


def permuted(number: Column, rows: int, seed: int) -> Column:
    @F.pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), rows, seed))

    return place(number)


def assign_shards(df: DataFrame, order: list[str], shards: int = 16, seed: int = 20240601) -> DataFrame:
    """`df` with shard and slot: shards differ by one row at most, slots have no gaps and start at 0.

    Rows are numbered by `order` (nulls first), so the result depends on the rows alone, not on files or
    partitions; rows alike in all of `order` may swap places. All columns are kept; `shard`, `slot` and
    `row_number` are replaced. Null, empty or repeated values need no care, since rows are only
    numbered. An empty table gives an empty result.
    """
    numbered = number_rows(df.drop("shard", "slot", "row_number"), order)
    rows = numbered.count()
    place = permuted(F.col("row_number"), rows, seed)
    return (numbered.withColumn("_place", place)
            .withColumn("shard", (F.col("_place") % shards).cast("int"))
            .withColumn("slot", F.expr(f"_place div {shards}"))
            .drop("_place"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order inside each file."""
    (sharded.repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
