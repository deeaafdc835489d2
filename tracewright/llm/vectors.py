"""Vectors as rows of bytes, and what the two searches share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def read_vectors(df: DataFrame, keep_row: Callable[[np.ndarray], bool],
                 change: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> DataFrame:
    """vec_id, dim, data (doubles) of the rows of `df` (vec_id, embedding) that can be searched.

    Rows without an id or a vector, empty vectors and vectors with null or non-finite components are left
    out, as are those that `keep_row` refuses; rows that repeat id and vector count once.
    """
    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for vec_id, embedding in zip(batch["vec_id"], batch["embedding"]):
                x = np.asarray(embedding, dtype=np.float64)
                if len(x) and np.isfinite(x).all() and keep_row(x):
                    rows.append((int(vec_id), len(x), change(x).tobytes()))
            yield pd.DataFrame(rows, columns=["vec_id", "dim", "data"])

    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = rows.filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    return rows.mapInPandas(parsed, "vec_id long, dim int, data binary").distinct()


def least_ids(vectors: DataFrame, count: int) -> DataFrame:
    """Of equal vectors the `count` least ids. Equal vectors score equally and ties go to the least id, so
    a search for fewer than `count` neighbours beside the query itself never returns another one. Spark
    applies the limit before the shuffle, too, so a very common vector does not meet in one task."""
    place = F.row_number().over(Window.partitionBy("dim", "data").orderBy("vec_id"))
    return vectors.withColumn("_n", place).filter(F.col("_n") <= count).drop("_n")


def matrix(data: list[bytes] | pd.Series) -> np.ndarray:
    rows = list(data)
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def dots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row by row inner products, summed from the first component to the last, so that equal rows give
    equal results wherever they are computed."""
    total = np.zeros(len(left))
    for i in range(left.shape[1]):
        total += left[:, i] * right[:, i]
    return total


def sample_rows(vectors: DataFrame, rows: int) -> np.ndarray:
    """About `rows` and at most twice as many vectors, chosen by a hash of their ids."""
    total = max(1, vectors.count())
    chance = F.pmod(F.xxhash64(F.lit(11), "vec_id"), F.lit(1 << 30))
    chosen = (vectors.withColumn("_c", chance).filter(F.col("_c") < int(min(1.0, 1.2 * rows / total) * (1 << 30)) + 1)
              .orderBy("_c", "vec_id").limit(2 * rows).select("data"))
    return matrix([bytes(r["data"]) for r in chosen.collect()])
