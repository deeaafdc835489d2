"""The two vector searches against brute force."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from llm_cases import folder  # noqa: F401

from tracewright.llm import ann, queries, vafile

SCHEMA = "vec_id long, embedding array<float>, label int, score int, data string, dim string, list string"


def frame(spark, rows):
    return spark.createDataFrame([(i, x, 0, 1, "d", "m", "l") for i, x in rows], SCHEMA)


def odd_rows():
    nan, inf = float("nan"), float("inf")
    return [(None, [1.0] * 8), (1000, None), (1001, []), (1002, [nan] + [1.0] * 7), (1003, [None] + [1.0] * 7),
            (1020, [inf] * 8), (1040, [0.0] * 8), (1060, [1e30, -1e30] * 4), (1061, [3e38] * 8), (1080, [1e-40] * 8),
            (1100, [1.0, 2.0]), (1101, [2.0, 1.0]), (1120, [-0.0] + [0.0] * 7), (1140, [1.0] * 9)]


def some_rows(seed):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(0, 0.3, 8).tolist()) for i in range(400)]
    rows += [(400 + i, rows[20][1]) for i in range(60)] + rows[:5]
    return rows + odd_rows()


def usable(rows, zero):
    out = {}
    for i, x in rows:
        if i is None or not x or any(v is None or not math.isfinite(v) for v in x):
            continue
        x = tuple(float(np.float32(v)) for v in x)
        if zero or any(x):
            out[i, x] = None
    return list(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_top_k(spark, seed):
    rows = some_rows(seed)
    got = vafile.search(frame(spark, rows), "vec_id % 20 = 0", k=7).collect()
    whole = [(i, [math.floor(64 * v) for v in x]) for i, x in usable(rows, True)]
    clip = lambda s: min(max(s, -2 ** 63), 2 ** 63 - 1)
    for i, x in whole:
        if i % 20 == 0:
            best = sorted((-clip(sum(a * b for a, b in zip(x, y))), j) for j, y in whole if j != i and len(x) == len(y))
            own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == i)
            assert own == [(n + 1, j, -s) for n, (s, j) in enumerate(best[:7])]
    assert {r.query_id for r in got} <= {i for i, _ in whole if i % 20 == 0}


def test_nearest(spark):
    rows = some_rows(3)
    got = ann.search(frame(spark, rows), "vec_id % 20 = 0", k=5).collect()
    whole, hits, total = usable(rows, False), 0, 0
    for i, x in whole:
        if i % 20:
            continue
        others = {j: y for j, y in whole if j != i and len(x) == len(y)}
        score = lambda y: (math.fsum(a * b for a, b in zip(x, y))
                           / math.sqrt(math.fsum(a * a for a in x)) / math.sqrt(math.fsum(b * b for b in y)))
        best = sorted(((-score(y), j) for j, y in others.items()))[:5]
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == i)
        assert [r for r, _, _ in own] == list(range(1, len(best) + 1))
        assert all(abs(s - score(others[j])) < 1e-9 for _, j, s in own)
        assert [(-s, j) for _, j, s in own] == sorted((-s, j) for _, j, s in own)
        hits += sum(s >= -best[-1][0] - 1e-9 for _, _, s in own)
        total += len(best)
    assert hits >= 0.95 * total
    copies = [r.vec_id for r in sorted((r for r in got if r.query_id == 440), key=lambda r: r.rank)]
    assert copies == [20, 400, 401, 402, 403]


def test_recall(spark, folder):
    folder = folder.replace("sf0.001", "sf0.1")
    table = queries.table(spark, folder, "embeddings").toPandas()
    x, ids = np.array(table["embedding"].tolist(), float), table["vec_id"].to_numpy()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own = queries.op10_posting_lists(spark, folder).toPandas().groupby("query_id")["vec_id"].apply(set)
    asked = np.flatnonzero(ids % 50 == 0)
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -2
    found = [len(own[ids[q]] & set(ids[best])) / 5 for q, best in zip(asked, np.argsort(-near, 1)[:, :5])]
    assert np.mean(found) >= 0.95


def test_isolated_groups_get_full_rows(spark):
    rng = np.random.default_rng(9)
    x = np.eye(64)[0] + 0.05 * rng.normal(size=(20_000, 64))
    rows, groups = [(50 * i + 1, v.tolist()) for i, v in enumerate(x)], []
    for g in range(60):                 # one to five vectors, equal or nearly equal, far from the rest
        centre = rng.normal(size=64)
        members = [2_000_000 + 500 * g + 50 * n for n in range(1 + g % 5)]
        groups.append(members)
        rows += [(i, (centre / 8 + (g % 2) * rng.normal(0, 1e-4, 64)).tolist()) for i in members]
    found = ann.search(frame(spark, rows), "vec_id % 50 = 0", k=5).toPandas().groupby("query_id")
    own = {q: r.sort_values("rank") for q, r in found}
    for members in groups:
        for i in members:
            assert own[i]["rank"].tolist() == [1, 2, 3, 4, 5]
            assert own[i]["vec_id"].is_unique and i not in set(own[i]["vec_id"])
            assert set(own[i]["vec_id"][:len(members) - 1]) == set(members) - {i}


def test_fitted_ratio_reaches_the_neighbours():
    rng = np.random.default_rng(8)
    x = ann._unit(rng.normal(size=(200_000, 64)))
    graph = ann.CentroidGraph(ann.split_centroids(x[:48_000], 24))
    asked = np.arange(0, len(x), 500)
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -2
    best = np.argpartition(-near, 5, 1)[:, :5]
    lists = {int(i): set(own.tolist()) for i, own in zip(best.ravel(), ann.lists_of(graph, x[best.ravel()]))}
    ratio = ann.fitted_ratio(graph, x[:48_000], 5)
    probes = ann.probes_of(graph, np.full(len(graph.centroids), 100), 6, ratio, x[asked])
    # The ratio alone selects: what the walk sees of the lists within it is nearly all of them.
    distance = ann._distance(x[asked] @ graph.centroids.T)
    within = distance <= ratio * np.maximum(distance.min(1, keepdims=True), ann.LEAST_BASE)
    assert sum(len(np.intersect1d(own, np.flatnonzero(w))) for own, w in zip(probes, within)) >= 0.97 * within.sum()
    assert np.mean([not lists[int(i)].isdisjoint(own.tolist()) for own, row in zip(probes, best) for i in row]) >= 0.94


def test_walk_visits_no_centroid_twice():
    rng = np.random.default_rng(11)
    graph = ann.CentroidGraph(ann._unit(rng.normal(size=(300, 8))))
    x = ann._unit(rng.normal(size=(50, 8)))
    for step in (1, 8):
        for count in (5, 40, 300):
            found, near = graph.nearest(x, count, step)
            for own, cosines, v in zip(found, near, x):
                own = own[own >= 0]
                assert len(set(own.tolist())) == len(own) <= count
                assert np.allclose(cosines[:len(own)], graph.centroids[own] @ v) and (np.diff(cosines[:len(own)]) <= 0).all()
            assert count < 300 or (np.sort(found, 1) >= 0).all()
            assert np.mean(found[:, 0] == (x @ graph.centroids.T).argmax(1)) > 0.95


def test_no_vectors(spark):
    for rows in ([], [(0, [1.0, 2.0])], odd_rows()[:5]):
        assert vafile.search(frame(spark, rows), "vec_id % 20 = 0", k=3).count() == 0
        assert ann.search(frame(spark, rows), "vec_id % 20 = 0", k=3).count() == 0


def test_parts_are_balanced():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 16))
    x[:700] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centroids = ann.split_centroids(x, 50)
    near = np.bincount((x @ centroids.T).argmax(1), minlength=len(centroids))
    assert np.median(near[near > 0]) <= 50 and len(centroids) >= 1300 / 50
    graph = ann.CentroidGraph(centroids)
    found, _ = graph.nearest(x[700:900], 10)
    assert np.mean(found[:, 0] == (x[700:900] @ centroids.T).argmax(1)) > 0.95 and random


def test_hits_do_not_grow_with_the_lists():
    rng = np.random.default_rng(12)
    x, q = rng.normal(size=(600, 8)), rng.normal(size=(5, 8))
    parts, shelves = np.array([1, 3, 0, 2] * 10), 4
    units = [(n, p) for n in range(40) for p in range(parts[n])]
    own = [units[i % len(units)] for i in range(600)]
    stock = pd.DataFrame({"dim": 8, "list": [n for n, _ in own], "vec_id": range(600), "data": [v.tobytes() for v in x],
                          "part": [p for _, p in own]})
    seen, found = [], []
    for shelf, lists, places in ann.units_by_shelf(np.arange(40), parts, 8, shelves):
        seen += zip(lists.tolist(), places.tolist())
        asked = pd.DataFrame({"dim": 8, "vec_id": range(1000, 1005), "data": [v.tobytes() for v in q],
                              "lists": [lists] * 5, "parts": [places] * 5})
        held = stock[(8 + stock["list"] + stock["part"]) % shelves == shelf]
        hits = ann.scan_shelf(held, asked, 3)
        assert hits.groupby("query_id").size().tolist() == [4] * 5      # however many lists lie on the shelf
        found.append(hits)
    assert sorted(seen) == sorted(units)
    best = pd.concat(found).sort_values("score", ascending=False).groupby("query_id")["vec_id"].apply(lambda v: v.tolist()[:3])
    near = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    assert best.tolist() == np.argsort(-near, 1)[:, :3].tolist()


def test_queries_are_routed_in_many_tasks(spark, monkeypatch):
    rng = np.random.default_rng(13)
    parts, plain = {}, ann.keep

    def kept(df, name):
        parts[name] = df.rdd.getNumPartitions()
        return plain(df, name)

    monkeypatch.setattr(ann, "keep", kept)
    rows = [(i, x) for i, x in enumerate(rng.normal(size=(400, 8)).tolist())]
    assert ann.search(frame(spark, rows), "vec_id % 50 = 0", k=5).count() == 40
    assert parts["routes"] >= 32


def test_weak_hits_are_not_looked_at_closer(monkeypatch):
    rng = np.random.default_rng(14)
    x, q, k = np.round(rng.normal(size=(3000, 6)), 1), rng.normal(size=(4, 6)), 3
    x[1000:1040] = x[999]           # ties
    lists = np.arange(60)
    stock = pd.DataFrame({"dim": 6, "list": np.arange(3000) % 60, "vec_id": range(3000), "data": [v.tobytes() for v in x],
                          "part": 0})
    again = stock.sample(600, random_state=1).assign(list=lambda d: (d["list"] + 1) % 60)   # rows lie in several lists
    stock = pd.concat([stock, again])
    asked = pd.DataFrame({"dim": 6, "vec_id": range(5000, 5004), "data": [v.tobytes() for v in q],
                          "lists": [lists] * 4, "parts": [np.zeros(60, np.int64)] * 4})
    looked, plain = [], ann.cosines
    monkeypatch.setattr(ann, "cosines", lambda a, b: looked.append(len(a)) or plain(a, b))
    hits = ann.scan_shelf(stock, asked, k)
    assert sum(looked) < 4 * 60 * (k + 1) / 2
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for n, v in enumerate(q):
        near = np.round(unit @ (v / np.linalg.norm(v)), 12)
        best = np.lexsort((np.arange(3000), -near))[:k + 1]
        own = hits[hits["query_id"] == 5000 + n]
        assert sorted(np.round(own["score"], 12).tolist(), reverse=True) == near[best].tolist()
        assert own["vec_id"].is_unique
