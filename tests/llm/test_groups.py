"""Near duplicates, components and tool calls against plain Python."""

import json
import random
from collections import defaultdict

import numpy as np
import pytest

from llm_cases import ODD, documents
from tracewright.llm import chat, neardup, queries
from tracewright.llm.components import connected_components


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(1, 2), (2, 1), (1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)],
    [(i, (i * 7 + 3) % 90) for i in range(0, 90, 2)] + [(None, 4), (5, None)]])
def test_components(spark, edges):
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    assert {r.node: r.label for r in got} == roots({x for e in real for x in e}, real)
    assert len(got) == len({r.node for r in got})


def word_set(text, words):
    found = (text or "").encode().lower().split()
    if not found:
        return None
    width = min(words, len(found))
    return frozenset(tuple(found[i:i + width]) for i in range(len(found) - width + 1))


def near_brute(rows, words, percent=80):
    """Rows are nodes; (doc_id, size of the set, component, kept)."""
    sets = [word_set(text, words) for _, text in rows]
    edges = []
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and rows[i][0] is not None and rows[j][0] is not None:
                if 100 * len(x & y) >= percent * len(x | y):
                    edges.append((i, j))
    root = roots(range(len(rows)), edges)
    least = defaultdict(lambda: None)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root[i]] = doc if least[root[i]] is None else min(least[root[i]], doc)
    return sorted(((d, len(s or ()), least[root[i]], d is None or d == least[root[i]])
                   for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10 ** 6)}"
    return " ".join(words)


@pytest.mark.parametrize("words,block", [(2, 1024), (5, 1024), (2, 16)])
def test_near_duplicates(spark, words, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(words)
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice([30, 80, 200]))) for _ in range(12)]
    texts = base + [edited(rng, rng.choice(base[:3]), rng.randrange(12)) for _ in range(150)] + base[:4] * 10
    texts += [t.upper() for t in base[:3]] + ["one", "ONE", "one two", "one two three four"]
    ids = rng.sample(range(1000), len(texts))
    rows = list(zip(ids, texts)) + [r[:2] for r in ODD]
    got = neardup.near_duplicates(documents(spark, rows), words=words).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr) == near_brute(rows, words)


def test_one_of_each_group_stays(spark):
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(120)) for _ in range(6)]
    texts = base + [edited(rng, base[0], 2) for _ in range(5)] + base[:2]
    rows = list(enumerate(texts))
    kept = neardup.without_near_duplicates(documents(spark, rows))
    want = {d for d, _, _, k in near_brute(rows, 5) if k}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == documents(spark, rows).columns
    repeated = rows + [rows[0]] * 3 + ODD + ODD
    got = sorted(((r.doc_id, r.text) for r in neardup.without_near_duplicates(documents(spark, repeated)).collect()),
                 key=repr)
    empty = [r[:2] for r in ODD + ODD if not (r[1] or "").split()]
    groups = near_brute([r[:2] for r in repeated], 5)
    assert [g for g in got if not (g[1] or "").split()] == sorted(empty, key=repr)
    assert len([g for g in got if (g[1] or "").split()]) == len(
        {(d, word_set(t, 5)) for d, t in [r[:2] for r in repeated] if word_set(t, 5)
         and (d, len(word_set(t, 5)), d, True) in groups or (d is None and word_set(t, 5))})


def test_no_documents(spark):
    assert neardup.near_duplicates(documents(spark, [])).count() == 0
    assert neardup.without_near_duplicates(documents(spark, [])).count() == 0


SCHEMAS = {"add": {"type": "object", "required": ["a"], "additionalProperties": False,
                   "properties": {"a": {"type": "integer", "minimum": 1, "maximum": 9},
                                  "b": {"type": ["array", "null"], "items": {"enum": [1, "x", True]}, "maxItems": 2},
                                  "c": {"type": "string", "minLength": 1, "maxLength": 3, "pattern": "^k"}}}}


@pytest.mark.parametrize("text,n,canonical", [
    ('{"a": 1}', 0, '{"a":1}'), ('{"c":"ké","a":1.0,"b":null}', 0, '{"a":1,"b":null,"c":"ké"}'),
    ('{"a": true}', 1, '{"a":true}'), ('{"a": 10, "c": "zzzz", "d": 1}', 4, '{"a":10,"c":"zzzz","d":1}'),
    ('{"b": [1, "x", 1.0]}', 2, '{"b":[1,"x",1]}'), ('[]', 1, '[]'), ('{"a": NaN}', 1, 'null'),
    ('{"a": 1, "a": 2}', 1, 'null'), ('{', 1, 'null'), ('', 1, 'null'), (None, 1, 'null'),
    ('[' * 100_000, 1, 'null'), ('{"a": 1, "c": "k\\ud800"}', 0, '{"a":1,"c":"k\\ud800"}')])
def test_arguments(text, n, canonical):
    value, errors = chat.check_arguments("add", text, SCHEMAS)
    assert len(errors) == n + (text == '{"b": [1, "x", 1.0]}') and chat.canonical_json(value) == canonical
    assert "unknown tool" in chat.check_arguments("other", text, SCHEMAS)[1]


CALLS = "conv_id long, position long, call_id string, name string, arguments string, depends_on array<string>, seq int"
RESULTS = "conv_id long, position long, call_id string, content string, status string"


@pytest.mark.parametrize("large", [10_000, 2])
def test_order_and_links(spark, large):
    rng = random.Random(3)
    calls, results = [], []
    for conv in range(30):
        n = rng.randint(1, 9)
        for i in range(n):
            needs = [f"c{rng.randrange(n + 1)}" for _ in range(rng.choice([0, 0, 1, 2]))]
            calls.append((conv, 2 * i, f"c{i}", rng.choice(["add", "sub"]), '{"a": 2}', needs, 9))
            if rng.random() < 0.7:
                results.append((conv, 2 * i + rng.choice([1, 1, 1, -5]), f"c{i}", f"r{i}", "x"))
    calls += [(0, 50, "c0", "add", "{}", None, 9), (None, 1, "n", "add", '{"a":1}', ["n"], 9), (1, 70, None, None, None, None, 9),
              (None, 3, None, "add", None, [None], 9), (1, 71, None, "add", '{"a":3}', [], 9)]
    results += [(0, 99, "c0", "again", "x"), (0, 98, "ghost", None, "x"), (None, 5, "n", "hi", "x"), (2, 5, None, "lost", "x")]
    got = chat.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS,
                          large=large).collect()
    asked = defaultdict(list)
    for c in calls:
        asked[c[0], c[2]].append(c)
    told = defaultdict(list)
    for r in results:
        told[r[0], r[2]].append(r)
    lone = lambda k: None in k
    assert len(got) == len(asked) + len([k for k in told if k not in asked or lone(k)])
    place = {(r.conv_id, r.call_id): r for r in got if r.seq is not None}
    for key, own in asked.items():
        row, first = place[key], min(own, key=lambda c: c[1])
        answers = [] if lone(key) else sorted(told.get(key, []), key=lambda r: r[1])
        status = "unanswered" if not answers else "linked" if answers[0][1] > first[1] else "misplaced"
        assert (row.n_calls, row.status, row.call_position) == (len(own), status, first[1])
        assert json.loads(row.message)["result"] == (answers[0][3] if answers else None)
        if "depends on itself" not in row.errors:
            for need in first[5] or []:
                other = place.get((key[0], need))
                if other is not None and not lone(key):
                    assert other.seq < row.seq
    for conv in {c[0] for c in calls}:
        seqs = sorted(r.seq for r in got if r.conv_id == conv and r.seq is not None)
        assert seqs == list(range(len(seqs)))


def test_cycles_are_found_alike(spark):
    calls = [(1, 0, "a", "add", "{}", ["b"], 0), (1, 1, "b", "add", "{}", ["a"], 0), (1, 2, "c", "add", "{}", ["b"], 0),
             (1, 3, "d", "add", "{}", [], 0), (1, 4, "e", "add", "{}", ["f"], 0), (1, 5, "f", "add", "{}", ["d"], 0)]
    frame = spark.createDataFrame(calls, CALLS)
    for large in (10_000, 1):
        got = {r.call_id: r.level for r in chat.call_levels(frame, large).collect()}
        assert got == {"a": None, "b": None, "c": None, "d": 0, "e": 2, "f": 1}


def test_long_chains_beyond_large(spark, monkeypatch):
    rounds = []

    def counted(df, name, keep=chat.keep):
        rounds.append(name)
        assert rounds.count("ready") <= 40      # a round per call of a chain would take 600
        return keep(df, name)

    monkeypatch.setattr(chat, "keep", counted)
    n, rng = 600, random.Random(5)
    far = list(range(n))
    rng.shuffle(far)
    after = dict(zip(far, far[1:]))
    rows = [(1, i, [i + 1]) for i in range(n)]                                      # reversed
    rows += [(2, i, [after[i]] if i in after else []) for i in range(n)]            # in any order
    rows += [(3, i, [i + 1, i + 2, i + 9]) for i in range(100)]                     # a ladder
    rows += [(4, i, [i + 1] if i % 50 else [i + 1, i + 49, i + 200]) for i in range(n)]
    rows += [(5, i, [i + 1 if i < 99 else 40]) for i in range(100)]                 # a cycle and what is behind it
    rows += [(5, i, [i + 1]) for i in range(100, 300)]
    calls = [(c, i, f"c{i}", "add", "{}", [f"c{d}" for d in own], 0) for c, i, own in rows]
    frame = spark.createDataFrame(calls, CALLS)
    whole, parted = ({(r.conv_id, r.call_id): r.level for r in chat.call_levels(frame, large).collect()}
                     for large in (10_000, 4))
    assert whole == parted and len(whole) == len(rows)
    assert whole[1, "c0"] == n - 1 and whole[2, f"c{far[0]}"] == n - 1
    assert whole[5, "c0"] is None and whole[5, "c100"] == 199


def test_no_calls(spark):
    none = spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS)
    assert chat.link_calls(*none, SCHEMAS).count() == 0
