"""Fingerprints, edited texts and the search within a Hamming radius against plain Python."""

import hashlib
import random
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from llm_cases import DOCS, ODD, documents, folder  # noqa: F401
from test_periodic import words_of
from tracewright.llm import edits, queries, simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hashed(term):
    out = 0
    for start in simhash.HALVES:
        x = crc32(term.encode()) ^ start
        for _ in range(2):
            x = ((x ^ x >> 16) * simhash.MULTIPLY) & 0xFFFFFFFF
        out = out << 32 | x ^ x >> 16
    return out


def simhash_of(text, words=2):
    found = words_of((text or "").translate(LOWER))
    width = min(words, len(found))
    terms = [" ".join(found[i:i + width]) for i in range(len(found) - width + 1)] if found else []
    votes = [0] * 64
    for term, times in Counter(terms).items():
        value = hashed(term)
        for i in range(64):
            votes[i] += times if value >> i & 1 else -times
    return len(terms), format(sum(1 << i for i in range(64) if votes[i] > 0), "016x")


def differing(a, b):
    return bin(int(a, 16) ^ int(b, 16)).count("1")


@pytest.mark.parametrize("words", [1, 2, 5])
def test_fingerprints(spark, words):
    rows = [*ODD, (8, "Alpha beta"), (9, "alpha\tBETA "), (10, "one two three four five six seven")]
    texts = documents(spark, rows).withColumn("row", F.monotonically_increasing_id())
    found = simhash.fingerprints(texts, ["doc_id", "row"], words).collect()
    assert sorted((str(r["doc_id"]), r["n_terms"], r["fingerprint"]) for r in found) == sorted(
        (str(i), *simhash_of(t, words)) for i, t in rows)
    assert simhash.fingerprints(spark.createDataFrame([], DOCS), ["doc_id"]).count() == 0


@pytest.mark.parametrize("cell", [3, 2048])
def test_all_pairs_within_radius(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)      # so that hot fronts are cut
    rng = random.Random(cell)
    centres = [rng.getrandbits(64) for _ in range(6)]
    values = []
    for i in range(400):
        value = centres[i % 6]
        for _ in range(rng.randrange(6)):
            value ^= 1 << rng.randrange(64)
        values.append(format(value, "016x"))
    prints = spark.createDataFrame([(v, "clash", 1) for v in values] + [(None, "x", 2)], "fingerprint string, bits string, front int")
    for radius in (1, 3):
        found = {r["fingerprint"]: r for r in simhash.near_counts(prints, radius).collect()}
        assert set(found) == set(values)
        for value in set(values):
            assert found[value]["members"] == values.count(value)
            assert found[value]["n_near"] == sum(differing(value, v) <= radius for v in values) - 1
    assert simhash.near_counts(prints.limit(0)).count() == 0


def test_every_link_comes_once(spark):
    classes = spark.createDataFrame([(b, 1) for b in (0, 1, 3, 7, 15, -1, -2, 1 << 62)], "bits long, members long")
    links = [(r["a"], r["b"]) for r in simhash.links_within(classes, 3).collect()]
    assert len(links) == len(set(links)) and all(a < b for a, b in links)
    values = [r["bits"] for r in classes.collect()]
    near = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 3
    assert set(links) == {(a, b) for a in values for b in values if a < b and near(a, b)}


def edited_texts(rows):
    """(doc_id, text, edited) in the order of documents."""
    rows = [(i, t or "") for i, t in rows]
    key = lambda r: hashlib.md5(f"{'' if r[0] is None else r[0]}:{r[1]}".encode()).digest()
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, key(r)))
    after = rows[1:] + rows[:1]
    return [(i, t, t[:len(t) - len(t) // 4] + n[:len(t) // 4]) for (i, t), (_, n) in zip(rows, after)]


@pytest.mark.parametrize("rows", [ODD, [(1, "only one")], [(2, "twice twice"), (2, "twice twice"), (1, "other text")],
                                  [(5, "aaaa bbbb cccc"), (7, None), (6, "🤦🏼‍♂️ é中文" * 9)], []])
def test_edited_texts(spark, rows):
    places, texts = edits.with_edits(documents(spark, rows) if rows else spark.createDataFrame([], DOCS))
    found = texts.filter("kind <> 'own'").join(places, "row_number").withColumn(
        "times", F.when(F.col("kind") == "among", F.col("copies") - 1).otherwise(F.lit(1)))
    got = [(r["doc_id"], r["n_chars"], r["text"], r["text_sha256"]) for r in edits.repeat_rows(found, "times").collect()]
    wanted = [(i, len(t), e, hashlib.sha256(e.encode()).hexdigest()) for i, t, e in edited_texts(rows)]
    assert sorted(map(repr, got)) == sorted(map(repr, wanted))
    own = texts.filter("kind = 'own'").join(places, "row_number")
    assert sorted(map(repr, {(r["doc_id"], r["text"]) for r in own.collect()})) == sorted(
        map(repr, {(i, t) for i, t, _ in edited_texts(rows)}))


def test_repeated_rows(spark):
    rows = spark.createDataFrame([(n, i) for i, n in enumerate((0, 1, 4095, 4096, 4097, 10_000))], "n long, name int")
    assert {r["name"]: r["count"] for r in edits.repeat_rows(rows, "n").groupBy("name").count().collect()} == {
        1: 1, 2: 4095, 3: 4096, 4: 4097, 5: 10_000}


def test_query(spark, folder):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    found = {r["doc_id"]: r for r in queries.op11_simhash(spark, folder).collect()}
    rows = edited_texts(docs)
    prints = [simhash_of(t)[1] for _, t, _ in rows]
    assert len(found) == len(rows)
    for k, (i, text, edited) in enumerate(rows):
        row, other = found[i], simhash_of(edited)[1]
        assert (row["fingerprint"], row["edited_fingerprint"]) == (prints[k], other)
        assert row["near_edited"] == 1 - differing(prints[k], other) / 64
        assert row["near_next"] == 1 - differing(prints[k], prints[(k + 1) % len(rows)]) / 64
        assert row["n_near"] == sum(differing(prints[k], p) <= 3 for p in prints) - 1
    assert sum(r["near_edited"] > r["near_next"] for r in found.values()) > 0.97 * len(rows)
