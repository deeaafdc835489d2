"""Periodic runs against a search of every period, word by word."""

import hashlib
import random
from zlib import crc32

import numpy as np
import pytest

from llm_cases import DOCS, ODD, documents, folder  # noqa: F401
from tracewright.llm import periodic, queries

WHITE = " \t\n\x0b\x0c\r"


def words_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in WHITE:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def every_run(words, shortest=24, exponent=3):
    """(start, length, period) by comparing all words at every distance."""
    found, n = {}, len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, exponent * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((a, size, q) for (a, size), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for a, size, q in runs for i in range(a + q, a + size)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_words(rng, kinds, size):
    words = []
    while len(words) < size:
        part = [rng.randrange(kinds) for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 13, 16, 30, 40]))]
        for _ in range(rng.randrange(3)):
            part = (part * rng.choice([1, 2, 3, 5]) + [rng.randrange(kinds) for _ in range(rng.randrange(3))])[:250]
        words += part * rng.choice([1, 1, 2, 3, 4, 7, 10])
    return words[rng.randrange(5):][:600]


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_random_sequences(seed):
    rng = random.Random(seed)
    for _ in range(8):
        words = periodic_words(rng, rng.choice([1, 2, 3, 5, 20]), rng.randrange(1, 400))
        symbols = np.unique(words, return_inverse=True)[1]
        runs = [(a, e - a, q) for a, e, q in periodic.runs_of(symbols, 24, 3).tolist()]
        assert runs == every_run(words)


def test_successors():
    rng = np.random.default_rng(5)
    values = rng.permutation(500)
    tree = periodic.WaveletTree(values, 500)
    lo = rng.integers(0, 500, 800)
    hi = np.minimum(500, lo + rng.integers(0, 60, 800))
    least = rng.integers(0, 600, 800)
    wanted = [min([v for v in values[a:b] if v >= x], default=-1) for a, b, x in zip(lo, hi, least)]
    assert tree.successor(lo, hi, least, -1).tolist() == wanted


def test_other_hashes_are_tried(monkeypatch):
    monkeypatch.setattr(periodic, "PRIMES", ((3, 2), (3, 1)))      # nearly all stretches look alike
    words = periodic_words(random.Random(3), 3, 200)
    with pytest.raises(periodic.SameHash):
        periodic.runs_of(np.array(words), 24, 3)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(3_000)) + " tick tock" * 100
    rows = [*ODD, (8, long), (8, long), (9, "a b " * 11 + "a"), (10, "a b " * 12), (11, "a\tb\x0bc\r\n" * 8),
            (12, "x y z " * 9 + "q " + "x y z " * 9), (13, "a b " * 24)]
    found = periodic.periodic_runs(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    wanted = sorted((str(i), len(w := words_of(t)), every_run(w), collapsed(w, every_run(w))) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found) == wanted
    by = {r["doc_id"]: r["runs"] for r in found}
    assert not by[9] and [tuple(x) for x in by[10]] == [(0, 24, 2)] and len(by[12]) == 2
    assert periodic.periodic_runs(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(documents(spark, rows), shortest=10)


def test_batches_do_not_mix(spark, monkeypatch):
    rows = [(i, "la " * (5 + i % 40)) for i in range(200)]
    symbols = [list(periodic._batched([t for _, t in rows], most)) for most in (10, 10**6)]
    runs = [[len(periodic.runs_of(s, 24, 3)) for _, s, _ in batches] for batches in symbols]
    assert sum(runs[0]) == sum(runs[1]) == sum(5 + i % 40 >= 24 for i in range(200))


def test_query_against_brute_force(spark, folder):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    some = 0
    for row in queries.op13_periodic_runs(spark, folder).collect():
        words, h = words_of(docs[row["doc_id"]]), crc32(str(row["doc_id"]).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 4_000:       # every period of these would take long; the rest of the table is enough
            continue
        runs = every_run(words)
        some += bool(runs)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        lines = "".join(f"{a},{size},{q}\n" for a, size, q in runs)
        assert tuple(row) == (row["doc_id"], len(runs), *best, runs and 1000 * best[1] // best[2] or None,
                              hashlib.sha256(lines.encode()).hexdigest(),
                              hashlib.sha256(collapsed(words, runs).encode()).hexdigest())
    assert some > 5
