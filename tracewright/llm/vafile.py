"""Exact top-k search by inner product with vector-approximation files.

Every vector is approximated by one cell number per component. Cells are cut at quantiles of a sample;
their bounds are the least and greatest component that any vector has in them, so bounds hold for all
rows. A scan over the approximations bounds every query's score with every vector from both sides: the
kth greatest lower bound is a threshold that the kth result cannot be below, and only vectors whose
upper bound reaches it are candidates. Their exact vectors are read in the order of upper bounds until
the kth exact score is above all that is left.

Queries and approximations meet in blocks: both are dealt into groups, and a cell of the grid of groups
is one task's work, of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import keep
from tracewright.llm.vectors import least_ids, matrix, read_vectors, sample_rows

BITS = 6
VECTOR_BLOCK, QUERY_BLOCK = 2048, 256
VECTOR_GROUP, QUERY_GROUP = 8, 4            # blocks of a group, on average
LONG = np.iinfo(np.int64)


def scaled(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x); what overflows a double stops at its bounds."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x), -1e300, 1e300)


def exact_scores(query: np.ndarray, vectors: np.ndarray) -> list[int]:
    """Integer inner products without rounding; beyond the bounds of a long they stop there."""
    if not query.any():
        return [0] * len(vectors)
    if np.abs(query).max() * np.abs(vectors).max(initial=0) * len(query) < 2.0 ** 62:
        return (vectors.astype(np.int64) @ query.astype(np.int64)).tolist()
    own = [int(x) for x in query]
    found = [sum(a * int(b) for a, b in zip(own, row)) for row in vectors]
    return [min(max(x, int(LONG.min)), int(LONG.max)) for x in found]


class Cells:
    """Cell bounds per component for vectors of one dimension."""

    def __init__(self, cuts: list[np.ndarray], low: np.ndarray, high: np.ndarray):
        self.cuts, self.low, self.high = cuts, low, high

    def codes(self, x: np.ndarray) -> np.ndarray:
        return cell_numbers(self.cuts, x)

    def corners(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.arange(codes.shape[1])
        return self.low[place, codes], self.high[place, codes]


def cell_numbers(cuts: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.searchsorted(c, x[:, i], "right") for i, c in enumerate(cuts)]).astype(np.uint8)


def fit_cells(vectors: DataFrame, dim: int, sample: int) -> Cells:
    """Cuts from a bounded sample, bounds from all rows: 2^BITS rows per component come to the driver."""
    own = vectors.filter(F.col("dim") == dim)
    drawn = sample_rows(own, sample)
    steps = np.linspace(0, 1, 1 << BITS, endpoint=False)[1:]
    cuts = [np.unique(np.quantile(drawn[:, i], steps, method="higher")) for i in range(dim)]

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, high = np.full((dim, 1 << BITS), np.inf), np.full((dim, 1 << BITS), -np.inf)
        for batch in batches:
            if len(batch):
                x = matrix(batch["data"])
                place, codes = np.broadcast_to(np.arange(dim), x.shape), cell_numbers(cuts, x)
                np.minimum.at(low, (place, codes), x)
                np.maximum.at(high, (place, codes), x)
        place, cell = np.nonzero(low <= high)
        yield pd.DataFrame({"i": place, "cell": cell, "lo": low[place, cell], "hi": high[place, cell]})

    found = (own.select("data").mapInPandas(bounds, "i int, cell int, lo double, hi double")
             .groupBy("i", "cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).toPandas())
    low, high = np.zeros((dim, 1 << BITS)), np.zeros((dim, 1 << BITS))
    low[found["i"], found["cell"]] = found["lo"]
    high[found["i"], found["cell"]] = found["hi"]
    return Cells(cuts, low, high)


def _blocks(vectors: DataFrame, size: int, cells: dict[int, Cells] | None) -> DataFrame:
    """Rows packed into blocks of one dimension: ids, and cell numbers or the vectors themselves."""
    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, rows in batch.groupby("dim"):
                for i in range(0, len(rows), size):
                    part = rows.iloc[i:i + size]
                    x = matrix(part["data"])
                    content = x if cells is None else cells[dim].codes(x)
                    yield pd.DataFrame({"dim": [dim], "ids": [part["vec_id"].to_numpy(np.int64).tobytes()],
                                        "content": [content.tobytes()]})

    return vectors.mapInPandas(packed, "dim int, ids binary, content binary")


def _grid(left: DataFrame, right: DataFrame, rows: int, columns: int):
    """Both sides dealt into the cells of a grid of groups, ready for cogroup."""
    own = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.withColumn("row", own(rows)).withColumn("col", every(columns))
    right = right.withColumn("col", own(columns)).withColumn("row", every(rows))
    return left.groupBy("dim", "row", "col").cogroup(right.groupBy("dim", "row", "col"))


def search(vectors: DataFrame, is_query: str, k: int, scale: float = 64.0, sample: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` greatest inner products of floor(scale * component).

    vectors: vec_id, embedding; further columns are ignored. `is_query` is a condition on vec_id; a
    query's candidates are all rows with other ids and as many components. Ties go to the smaller
    vec_id. Rows without id or vector, empty vectors and vectors with null or non-finite components take
    no part; rows that repeat id and vector count once. Scores beyond a long stop at its bounds. Queries
    with fewer than `k` candidates return them all. An empty table gives an empty result. The sample
    only places the cells' cuts; every row is searched.
    """
    own = keep(read_vectors(vectors, lambda x: True, lambda x: scaled(x, scale)), "vectors")
    queries = own.filter(is_query)
    known = keep(least_ids(own, k + 1), "candidates")
    dims = [r["dim"] for r in known.select("dim").distinct().collect()]
    cells = {dim: fit_cells(known, dim, sample) for dim in dims}

    approximations = keep(_blocks(known, VECTOR_BLOCK, cells), "approximations")
    asked = keep(_blocks(queries, QUERY_BLOCK, None), "queries")
    rows = approximations.count() // VECTOR_GROUP + 1
    columns = asked.count() // QUERY_GROUP + 1

    def scan(dim: int, left: pd.DataFrame, right: pd.DataFrame):
        """Per query block: its ids and vectors, the candidates' ids, lower and upper bounds."""
        for query_ids, query in zip(right["ids"], right["content"]):
            query_ids = np.frombuffer(query_ids, np.int64)
            query = np.frombuffer(query, np.float64).reshape(-1, dim)
            signs = np.hstack([np.maximum(query, 0), np.minimum(query, 0)])
            for ids, codes in zip(left["ids"], left["content"]):
                ids = np.frombuffer(ids, np.int64)
                low, high = cells[dim].corners(np.frombuffer(codes, np.uint8).reshape(-1, dim))
                # Sums of doubles may be off in their last places; the slack is far beyond that.
                slack = 1e-12 * (np.abs(query) @ np.maximum(np.abs(low), np.abs(high)).T)
                own_row = query_ids[:, None] == ids
                below = np.clip(signs @ np.hstack([low, high]).T - slack, -(2.0 ** 63), 2.0 ** 63)
                above = np.clip(signs @ np.hstack([high, low]).T + slack, -(2.0 ** 63), 2.0 ** 63)
                below[own_row] = above[own_row] = -np.inf
                yield query_ids, ids, below, above

    def thresholds(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        best: dict[int, np.ndarray] = {}
        for query_ids, _, below, _ in scan(_dim(left, right), left, right):
            top = -np.partition(-below, min(k, below.shape[1]) - 1, 1)[:, :k]
            for query_id, own_top in zip(query_ids.tolist(), top):
                merged = np.concatenate([best[query_id], own_top]) if query_id in best else own_top
                best[query_id] = -np.sort(-merged)[:k]
        return pd.DataFrame([(q, x) for q, found in best.items() for x in found if np.isfinite(x)],
                            columns=["query_id", "below"])

    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("below").desc()))
    limits = (_grid(approximations, asked, rows, columns).applyInPandas(thresholds, "query_id long, below double")
              .withColumn("n", place).filter(F.col("n") == k).select("query_id", "below"))
    limits = keep(limits, "thresholds")
    # Each group of queries takes its own thresholds along.
    limits = limits.select(F.col("query_id").alias("vec_id"), "below")
    asked = keep(_with_limits(queries.join(limits, "vec_id", "left")), "queries-limited")

    def candidates(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        limit = {}
        for ids, own_limits in zip(right["ids"], right["limits"]):
            limit |= dict(zip(np.frombuffer(ids, np.int64).tolist(), np.frombuffer(own_limits, np.float64)))
        for query_ids, ids, _, above in scan(_dim(left, right), left, right):
            least = np.array([limit[q] for q in query_ids.tolist()])
            x, y = np.nonzero((above >= least[:, None]) & np.isfinite(above))
            found.append(pd.DataFrame({"query_id": query_ids[x], "vec_id": ids[y], "above": above[x, y]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "above": []})

    grid = _grid(approximations, asked, rows, asked.count() // QUERY_GROUP + 1)
    pairs = grid.applyInPandas(candidates, "query_id long, vec_id long, above double").distinct()
    read = pairs.join(known.select("vec_id", "dim", "data"), "vec_id")
    groups = max(1, queries.count() // 64)
    read = read.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(groups)))
    wanted = queries.select(F.col("vec_id").alias("query_id"), "dim", F.col("data").alias("own"),
                            F.pmod(F.xxhash64("vec_id"), F.lit(groups)).alias("part"))

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        by_query = dict(tuple(left.groupby(["query_id", "dim"])))
        for query_id, dim, own_data in zip(right["query_id"], right["dim"], right["own"]):
            rows = by_query.get((query_id, dim))
            if rows is None:
                continue
            rows = rows.sort_values(["above", "vec_id"], ascending=[False, True])
            query, above, best = np.frombuffer(own_data, np.float64), rows["above"].to_numpy(), []
            for i in range(0, len(rows), 2 * k):
                if len(best) == k and -best[-1][0] > above[i]:
                    break               # nothing left can reach the kth score
                part = rows.iloc[i:i + 2 * k]
                scores = exact_scores(query, matrix(part["data"]))
                best = sorted(best + [(-s, v) for s, v in zip(scores, part["vec_id"].tolist())])[:k]
            out += [(query_id, n + 1, v, -s) for n, (s, v) in enumerate(best)]
        return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])

    return (read.groupBy("part").cogroup(wanted.groupBy("part"))
            .applyInPandas(nearest, "query_id long, rank int, vec_id long, score long"))


def _dim(left: pd.DataFrame, right: pd.DataFrame) -> int:
    return int((left if len(left) else right)["dim"].iloc[0])


def _with_limits(queries: DataFrame) -> DataFrame:
    """Query blocks with each query's threshold; without one, all its candidates count."""
    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, rows in batch.groupby("dim"):
                for i in range(0, len(rows), QUERY_BLOCK):
                    part = rows.iloc[i:i + QUERY_BLOCK]
                    limits = part["below"].astype(float).fillna(-np.inf).to_numpy(np.float64)
                    yield pd.DataFrame({"dim": [dim], "ids": [part["vec_id"].to_numpy(np.int64).tobytes()],
                                        "content": [matrix(part["data"]).tobytes()], "limits": [limits.tobytes()]})

    return queries.mapInPandas(packed, "dim int, ids binary, content binary, limits binary")
