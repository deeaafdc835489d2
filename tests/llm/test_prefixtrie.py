"""The prefix trie against plain dictionaries of prefixes."""

import hashlib
import random
from collections import defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tracewright.llm import prefixtrie, queries, rebuilt

TURNS = "conv_id long, turn long, role string, text string, d string, len int, owner int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def table_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], TURNS)


def rebuilt_plainly(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv_id].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(turns)] for c, turns in own.items()}
    shared = {c: crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[:shared[c]] + turns[shared[c]:] for c, turns in own.items()}


def trie_plainly(conversations):
    nodes = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in nodes:
        if node:
            children[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(nodes, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[x] for x in below) or 1
        size = len(node[-1][1].encode()) if node else 0
        saved[node] = (len(nodes[node]) - 1) * size + sum(saved[x] for x in below)
        ends = sorted(c for c in nodes[node] if len(conversations[c]) == len(node))
        out.append((min(nodes[node]), len(node), min(nodes[node[:-1]]) if node else None, len(nodes[node]), len(below),
                    leaves[node], saved[node], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(map(repr, out))


def found(turns):
    rows = prefixtrie.prefix_trie(*rebuilt.rebuilt_conversations(turns)).select(COLUMNS).collect()
    return sorted(repr(tuple(r)) for r in rows)


def check(spark, rows):
    assert found(table_of(spark, rows)) == trie_plainly(rebuilt_plainly(rows))


def test_odd_conversations(spark):
    rows = [(0, 0, "user", "a"), (0, 1, "assistant", "b"), (0, None, "system", "first"), (1, 0, "user", "x"), (1, 0, "user", "x"),
            (2, 5, None, None), (2, 6, "", ""), (3, 0, "us", "er"), (4, 0, "u", "ser"), (None, 0, "user", "nobody"), (None, None, None, None),
            (7, 1, "user", "é" * 40_000), (8, 0, "user", "🤦🏼‍♂️"), (10**12, 3, "tool", "far"), (25, 0, "user", "only one")]
    check(spark, rows)


def test_small_tables(spark):
    assert found(table_of(spark, [(1, 0, "u", "t")]).limit(0)) == []
    check(spark, [(3, 0, "u", "t")])
    check(spark, [(c, 0, "u", "t") for c in (1, 2, 6, 7, 8)])


@pytest.mark.parametrize("segment", [3, 4096])
def test_many_shapes(spark, monkeypatch, segment):
    monkeypatch.setattr(prefixtrie, "SEGMENT", segment)     # so that long sequences and edges are cut
    monkeypatch.setattr(prefixtrie, "IDS", segment)
    rng, rows = random.Random(segment), []
    spine = [("user" if i % 2 else "assistant", f"turn {i}") for i in range(70)]
    for c in range(0, 500, 5):
        kind = rng.randrange(4)
        turns = (spine[:rng.randrange(70)] if kind == 0                                     # ends inside an edge
                 else spine[:rng.randrange(60)] + [("user", f"own {rng.randrange(9)}")] * 3 if kind == 1
                 else [("user", rng.choice("ab")) for _ in range(rng.randrange(1, 12))] if kind == 2
                 else [("system", "the same"), ("user", "of all")])
        rows += [(c, i, *t) for i, t in enumerate(turns)]
        for branch in range(1, rng.randrange(1, 5)):
            rows += [(c + branch, i, "user", rng.choice(["yes", "no", "more"])) for i in range(rng.randrange(1, 11))]
    check(spark, rows)


def test_rounds_follow_the_logarithm(spark, monkeypatch):
    names = []
    keep = prefixtrie.keep
    monkeypatch.setattr(prefixtrie, "keep", lambda df, name: names.append(name) or keep(df, name))
    rows = [(5 * c, i, "user", "step" if i < c else f"side {c}") for c in range(120) for i in range(c + 1)]
    check(spark, rows)
    assert names.count("nodes") <= 10       # a spine of 120 branches, one at each depth


def test_fattest(spark):
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 41)]
    frame = spark.createDataFrame(pairs, "a long, b long").withColumn("f", prefixtrie._fattest("a", "b"))
    for r in frame.collect():
        assert r["f"] == max(range(r["a"] + 1, r["b"] + 1), key=lambda x: x & -x)


def test_running_before(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "SEGMENT", 4)
    rows = [(g, i, i * 7 % 5) for g in ("a", "b") for i in range(0, 23, 2 if g == "a" else 3)]
    frame = spark.createDataFrame(rows, "g string, i long, v long")
    out = prefixtrie.running_before(frame, ["g"], "i", {"s": (F.sum, "v", lambda x, y: x + y), "m": (F.max, "i", F.greatest)})
    for r in out.collect():
        earlier = [(i, v) for g, i, v in rows if g == r["g"] and i < r["i"]]
        assert r["s"] == (sum(v for _, v in earlier) if earlier else None)
        assert r["m"] == max((i for i, _ in earlier), default=None)


def test_query(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 else "assistant", f"{c % 3} says {t}") for c in range(40) for t in range(c % 11 + 1)]
    table_of(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op12_prefix_trie(spark, str(tmp_path)).select(COLUMNS).collect()
    assert sorted(repr(tuple(r)) for r in got) == trie_plainly(rebuilt_plainly(rows))
