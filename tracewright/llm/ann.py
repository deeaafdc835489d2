"""Approximate nearest neighbours with balanced posting lists.

Vectors are put on the unit sphere and into the posting lists of centroids. Centroids come from
splitting a bounded sample again and again until no part is larger than a list should be, so lists are
about equally long. A vector near a border goes to several lists: to further centroids that are hardly
farther than its nearest one, unless a centroid that already has it is nearer to the further one than
the vector is. Centroids are searched by a best-first walk over a neighbour graph in memory, for rows and
queries alike. A query's lists are those whose centroids are within a ratio of its nearest centroid's distance,
or of that of the list with which there are enough candidates; its walk widens until it has seen them all, and
where that would take longer than measuring all centroids, these are measured. The ratio is fitted to the
sample: it is the least with which nearly all neighbours there lie in such lists. Lists
that turn out long are scanned in parts, by several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import keep
from tracewright.llm.vectors import dots, least_ids, matrix, read_vectors, sample_rows

LIST_ROWS = 100            # vectors a list should have
MOST_CENTROIDS = 16_384    # centroids are held by every task: 16 MB of doubles with 128 components
SAMPLE_ROWS = 40_000
DEGREE, ENTRIES = 24, 16
COPIES, BORDER = 8, 1.15   # most lists of a vector, and how much farther their centroids may be
LEAST_BASE = 0.2           # a distance ratio counts from no less than this
FITTED, REACHED = 512, 0.96  # sample vectors the ratio is fitted to, and the share of their neighbours in its lists
FIRST_WALK, STEP = 64, 8   # centroids a query first looks for, and how many of them a step of its walk goes on from
WALK_COST = 32             # centroids that are measured without a walk in the time that a walk takes for one
PART_ROWS = 4096           # rows of a list that one task scans
SHELF_ROWS = 20_000        # posted rows whose parts one task scans together
ASKED_ROWS = 1024          # queries that meet a part at once
HELD_HITS = 500_000        # hits of a task that are held before only the best of each query are kept


def split_centroids(x: np.ndarray, most_rows: int, seed: int = 5) -> np.ndarray:
    """Means of parts of at most `most_rows` unit vectors, by repeated 8-means; equal vectors stay."""
    random, done, todo = np.random.default_rng(seed), [], [x]
    while todo:
        part = todo.pop()
        if len(part) <= most_rows or (part == part[0]).all():
            mean = part.mean(0)
            done.append(mean / max(np.linalg.norm(mean), 1e-12))
            continue
        ways = int(min(8, -(-len(part) // most_rows), len(part)))
        centres = part[random.choice(len(part), ways, replace=False)]
        for _ in range(8):
            near = (part @ centres.T).argmax(1)
            centres = np.stack([part[near == i].sum(0) if (near == i).any() else part[random.integers(len(part))]
                                for i in range(ways)])
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        near = (part @ centres.T).argmax(1)
        pieces = [part[near == i] for i in range(ways) if (near == i).any()]
        if len(pieces) == 1:        # no way to part them by means: halves, in some order
            order = np.argsort(part @ random.normal(size=part.shape[1]), kind="stable")
            pieces = [part[order[:len(part) // 2]], part[order[len(part) // 2:]]]
        todo += pieces
    return np.stack(done)


class CentroidGraph:
    """Centroids linked to their nearest others, searched best first from a few entries."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        n = len(centroids)
        degree = min(DEGREE, n - 1)
        links = np.zeros((n, max(1, degree)), np.int64)
        for i in range(0, n, 1024):
            near = centroids[i:i + 1024] @ centroids.T
            near[np.arange(len(near)), np.arange(i, i + len(near))] = -np.inf
            links[i:i + 1024] = np.argsort(-near, 1, kind="stable")[:, :max(1, degree)]
        if degree > 4:              # a few far links, so that no part of the graph is out of reach
            links[:, -4:] = np.random.default_rng(6).integers(0, n, (n, 4))
        self.links = links
        self.entries = np.unique(np.linspace(0, n - 1, min(n, ENTRIES)).astype(np.int64))

    def nearest(self, x: np.ndarray, count: int, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, cosines) of about the `count` nearest per row of `x`, nearest first; -1 pads.

        The walk goes on from the `step` nearest centroids that it has not gone on from.
        """
        n, rows = len(self.centroids), np.arange(len(x))[:, None]
        beam = min(count, n)
        found = np.broadcast_to(self.entries, (len(x), len(self.entries)))
        near = x @ self.centroids[self.entries].T
        seen = np.zeros((len(x), n), bool)
        seen[:, self.entries] = True
        spent = np.zeros(found.shape, bool)
        while True:
            order = np.argsort(-near, 1, kind="stable")[:, :beam]
            found, near, spent = found[rows, order], near[rows, order], spent[rows, order]
            waiting = ~spent & np.isfinite(near)
            if not waiting.any():
                break
            pick = np.argsort(~waiting, 1, kind="stable")[:, :step]
            going = waiting[rows, pick]
            spent[rows, pick] = True
            more = self.links[found[rows, pick]].reshape(len(x), -1)
            fresh = np.repeat(going, self.links.shape[1], 1) & ~seen[rows, more]
            # A link may come twice: one of them counts.
            fresh_first = np.where(fresh, more, n)
            ordered = np.argsort(fresh_first, 1, kind="stable")
            values = fresh_first[rows, ordered]
            fresh[rows, ordered[:, 1:]] &= values[:, 1:] != values[:, :-1]
            at, link = np.nonzero(fresh)
            seen[at, more[at, link]] = True
            gain = np.full(more.shape, -np.inf)
            gain[at, link] = np.einsum("ij,ij->i", x[at], self.centroids[more[at, link]])
            found, near = np.hstack([found, more]), np.hstack([near, gain])
            spent = np.hstack([spent, np.zeros(more.shape, bool)])
        return np.where(np.isfinite(near), found, -1), near

    def measured(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, cosines) of all per row of `x`, nearest first, without a walk."""
        near = x @ self.centroids.T
        order = np.argsort(-near, 1, kind="stable")
        return order, np.take_along_axis(near, order, 1)


def _distance(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cosines))


def lists_of(graph: CentroidGraph, x: np.ndarray) -> list[np.ndarray]:
    """The lists each unit vector goes to."""
    found, near = graph.nearest(x, 4 * COPIES)
    distance, out = _distance(np.where(found >= 0, near, -1)), []
    for own, far in zip(found, distance):
        chosen = [int(own[0])]
        for c, d in zip(own[1:].tolist(), far[1:]):
            if c < 0 or d > BORDER * far[0] or len(chosen) == COPIES:
                break
            if (_distance(graph.centroids[chosen] @ graph.centroids[c]) >= d).all():
                chosen.append(c)
        out.append(np.array(chosen))
    return out


def fitted_ratio(graph: CentroidGraph, sample: np.ndarray, k: int) -> float:
    """The distance ratio whose lists hold the share REACHED of the `k` nearest neighbours that FITTED vectors of
    the sample have in it.

    Neighbours among all vectors are nearer than those in a sample, and so in nearer lists.
    """
    asked = np.random.default_rng(7).permutation(len(sample))[:FITTED]
    ratios = [np.ones(1)]
    for i in range(0, len(asked), 64):
        own = asked[i:i + 64]
        near = sample[own] @ sample.T
        near[np.arange(len(own)), own] = -np.inf
        best = np.argsort(-near, 1, kind="stable")[:, :min(k, len(sample) - 1)]
        distance = _distance(sample[own] @ graph.centroids.T)
        base = np.maximum(distance.min(1), LEAST_BASE)
        homes = lists_of(graph, sample[best.ravel()]) if best.size else []
        row = np.repeat(np.arange(len(own)), best.shape[1])
        ratios.append(np.array([distance[r, h].min() / base[r] for r, h in zip(row, homes)]))
    return max(1.0, float(np.quantile(np.concatenate(ratios), REACHED)))


def probes_of(graph: CentroidGraph, homes: np.ndarray, least: int, ratio: float, x: np.ndarray) -> list[np.ndarray]:
    """The lists to scan for each unit vector.

    `homes` counts the vectors whose nearest list each is. Lists are taken in order until they are home to
    `least` vectors, which are then all different, or to all there are; the ratio counts from the last of them.
    The walk is repeated twice as wide until it sees a list beyond the ratio; where measuring all centroids takes no
    longer than that, all are measured, so that none within the ratio is missed.
    """
    n, out = len(graph.centroids), [None] * len(x)
    stored = lists_of(graph, x)     # the walk may miss a lone centroid, for near vectors and x alike
    todo, count = np.arange(len(x)), min(FIRST_WALK, n)
    while len(todo):
        open_rows = []
        for i in range(0, len(todo), 256):
            part = todo[i:i + 256]
            seen = graph.measured(x[part]) if FIRST_WALK < count == n else graph.nearest(x[part], count, STEP)
            for row, own, cosines in zip(part.tolist(), *seen):
                own, cosines = own[own >= 0], cosines[own >= 0]
                reached = np.cumsum(homes[own])
                if reached[-1] < least and count == n:      # what no link leads to
                    cosines = graph.centroids @ x[row]
                    own = np.argsort(-cosines, kind="stable")
                    cosines, reached = cosines[own], np.cumsum(homes[own])
                needed = min(int(np.searchsorted(reached, least)), len(own) - 1)
                distance = _distance(cosines)
                limit = ratio * max(distance[needed], LEAST_BASE)
                if count < n and (reached[-1] < least or distance[-1] <= limit):
                    open_rows.append(row)
                else:
                    out[row] = np.union1d(own[distance <= limit], stored[row])
        todo, count = np.array(open_rows, np.int64), 2 * count if 2 * count * WALK_COST < n else n
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares of very large or small components do not leave the range of doubles.
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _blocks(rows: DataFrame, known: dict[int, tuple], lists, schema: str, shown) -> DataFrame:
    """Frames that `shown` makes of blocks of vectors with one dim, and of the lists found for each of them."""
    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, own in batch.groupby("dim"):
                for i in range(0, len(own), 1024):
                    part = own.iloc[i:i + 1024]
                    yield from shown(dim, part, lists(*known[dim], _unit(matrix(part["data"]))))

    return rows.mapInPandas(routed, schema)


def _posted(dim: int, part: pd.DataFrame, found: list[np.ndarray]) -> Iterator[pd.DataFrame]:
    """One row per vector and list; home: whether the list is the vector's first."""
    times = [len(f) for f in found]
    home = np.concatenate([np.arange(n) == 0 for n in times])
    yield pd.DataFrame({"list": np.concatenate(found), "vec_id": np.repeat(part["vec_id"], times), "dim": dim,
                        "data": np.repeat(part["data"].to_numpy(object), times), "home": home})


def units_by_shelf(found: np.ndarray, parts: np.ndarray, dim: int, shelves: int) -> Iterator[tuple]:
    """(shelf, lists, parts) of the parts of the found lists: a part lies on shelf (dim + list + part) mod `shelves`."""
    times = parts[found]
    lists = np.repeat(found, times)
    places = np.arange(len(lists)) - np.repeat(np.cumsum(times) - times, times)
    shelf = (dim + lists + places) % shelves
    order = np.argsort(shelf, kind="stable")
    for own in np.split(order, np.nonzero(np.diff(shelf[order]))[0] + 1):
        if len(own):
            yield int(shelf[own[0]]), lists[own], places[own]


def scan_shelf(stock: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """query_id, vec_id, score: the k + 1 best of each query among the rows of the parts it asks for.

    stock: dim, list, vec_id, data, part; asked: dim, vec_id, data, lists, parts, one row per query. The hits of all
    parts are brought together here, so that their number does not grow with the lists a query looks into. Once a
    part has given a query k + 1 hits, only what comes up to them is looked at closer in the others.
    """
    none = pd.DataFrame({"query_id": np.array([], np.int64), "vec_id": np.array([], np.int64), "score": np.array([], float)})
    stored = dict(tuple(stock.groupby(["dim", "list", "part"])))
    times = asked["lists"].map(len).to_numpy(np.int64)
    if not stored or not times.sum():
        return none
    asking = pd.DataFrame({"row": np.repeat(np.arange(len(asked)), times), "dim": np.repeat(asked["dim"].to_numpy(), times),
                           "list": np.concatenate(asked["lists"].to_list()),
                           "part": np.concatenate(asked["parts"].to_list())})
    ids, data = asked["vec_id"].to_numpy(), asked["data"]

    def best(found: list[pd.DataFrame]) -> pd.DataFrame:
        hits = pd.concat(found).drop_duplicates()
        return (hits.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
                .groupby("query_id").head(k + 1))

    out, waiting, bars = [], 0, np.full(len(asked), -np.inf)
    for unit, ask in asking.groupby(["dim", "list", "part"]):
        rows = stored.get(unit)
        if rows is None:
            continue
        x = matrix(rows["data"])
        unit_x, here = _unit(x).T, ask["row"].to_numpy()
        for i in range(0, len(here), ASKED_ROWS):
            at = here[i:i + ASKED_ROWS]
            q = matrix(data.iloc[at])
            near = _unit(q) @ unit_x
            a, b = np.nonzero(near >= bars[at][:, None])
            full = np.flatnonzero(np.bincount(a, minlength=len(at)) > k)
            if len(full):       # rows of a part are all different, so these bar what is less
                bars[at[full]] = -np.partition(-near[full], k, 1)[:, k] - 1e-9
                still = near[a, b] >= bars[at[a]]
                a, b = a[still], b[still]
            out.append(pd.DataFrame({"query_id": ids[at][a], "vec_id": rows["vec_id"].to_numpy()[b],
                                     "score": cosines(q[a], x[b])}))
            waiting += len(a)
            if waiting > HELD_HITS + 4 * len(out[0]):
                out, waiting = [best(out)], 0
    return best(out) if out else none


def cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        plain = dots(left, right) / (np.sqrt(dots(left, left)) * np.sqrt(dots(right, right)))
    bad = ~np.isfinite(plain)
    if bad.any():               # squares beyond the range of doubles
        a, b = _unit(left[bad]), _unit(right[bad])
        plain[bad] = dots(a, b)
    return plain


def search(vectors: DataFrame, is_query: str, k: int, sample: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` nearest found, by cosine in double precision.

    vectors: vec_id, embedding; further columns are ignored. `is_query` is a condition on vec_id; a
    query's candidates are all rows with other ids and as many components. Ties go to the smaller
    vec_id. Rows without id or vector, empty and zero vectors and vectors with null or non-finite
    components take no part; rows that repeat id and vector count once. Centroids are fitted to at most
    2 * `sample` vectors, the ratio to FITTED of them; every row is indexed, and every query gets `k` rows if there are that many
    candidates. An empty table gives an empty result.
    """
    own = keep(read_vectors(vectors, lambda x: bool(x.any())), "vectors")
    known = keep(least_ids(own, k + 1), "candidates")
    sizes = {r["dim"]: r["n"] for r in known.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    graphs, ratios = {}, {}
    for dim, n in sizes.items():
        drawn = _unit(sample_rows(known.filter(F.col("dim") == dim), sample))
        lists = min(MOST_CENTROIDS, max(1, n // LIST_ROWS))
        graphs[dim] = CentroidGraph(split_centroids(drawn, max(2, -(-len(drawn) // lists))))
        ratios[dim] = fitted_ratio(graphs[dim], drawn, k)

    postings = keep(_blocks(known, {dim: (graph,) for dim, graph in graphs.items()}, lists_of,
                            "list long, vec_id long, dim int, data binary, home boolean", _posted), "postings")
    lengths = keep(postings.groupBy("dim", "list").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("home").alias("homes"))
        .select("dim", "list", "n", F.expr(f"n div {PART_ROWS} + 1").alias("parts"), "homes"), "list-lengths")
    homes = {dim: np.zeros(len(graph.centroids), np.int64) for dim, graph in graphs.items()}
    parts = {dim: np.zeros(len(graph.centroids), np.int64) for dim, graph in graphs.items()}
    posted = 0
    for r in lengths.collect():
        homes[r["dim"]][r["list"]], parts[r["dim"]][r["list"]] = r["homes"], r["parts"]
        posted += r["n"]
    shelves = posted // SHELF_ROWS + 12
    asking = {dim: (graph, homes[dim], k + 1, ratios[dim]) for dim, graph in graphs.items()}
    # Equal queries are searched once, under the least of their ids. Queries are few bytes and much work, so they are
    # dealt over partitions of a fixed number.
    asked = own.filter(is_query)
    first = asked.groupBy("dim", "data").agg(F.min("vec_id").alias("vec_id"))
    tasks = max(own.sparkSession.sparkContext.defaultParallelism * 4, 32)

    def wanted(dim: int, part: pd.DataFrame, found: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        """One row per query and shelf, whatever the number of lists."""
        for i in range(0, len(part), 64):
            some = part.iloc[i:i + 64]
            yield pd.DataFrame([(dim, vec_id, data, *unit)
                                for vec_id, data, lists in zip(some["vec_id"], some["data"], found[i:i + 64])
                                for unit in units_by_shelf(lists, parts[dim], dim, shelves)],
                               columns=["dim", "vec_id", "data", "shelf", "lists", "parts"])

    routes = keep(_blocks(first.select("vec_id", "dim", "data").repartition(tasks, "vec_id"), asking, probes_of, "dim int, vec_id long, data binary, "
                          "shelf long, lists array<long>, parts array<long>", wanted), "routes")
    part_of = F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    stored = (postings.drop("home").join(lengths.drop("n", "homes"), ["dim", "list"]).withColumn("part", part_of).drop("parts")
              .withColumn("shelf", F.pmod(F.col("dim") + F.col("list") + F.col("part"), F.lit(shelves))))

    def scanned(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return scan_shelf(left, right, k)

    hits = (stored.groupBy("shelf").cogroup(routes.groupBy("shelf"))
            .applyInPandas(scanned, "query_id long, vec_id long, score double").distinct())
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    hits = keep(hits.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
                .select(F.col("query_id").alias("first"), "vec_id", "score"), "hits")
    of_query = asked.select(F.col("vec_id").alias("query_id"), "dim", "data").join(
        first.withColumnRenamed("vec_id", "first"), ["dim", "data"]).select("query_id", "first")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return (of_query.join(hits, "first").filter(F.col("query_id") != F.col("vec_id"))
            .withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
