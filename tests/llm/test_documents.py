"""Operators on documents against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm_cases import ODD, documents, folder  # noqa: F401
from tracewright.llm import linededup, mixing, packing, quality, queries, sharding, tokenstore
from tracewright.llm.tokens import Encoder

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lines_brute(rows, least_chars=20, least_docs=3):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(doc)
    small = lambda d: (d is not None, d or 0)
    bad = {k: max(v, key=small) for k, v in holders.items() if len(v) >= least_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [l for l in lines if key(l) not in bad or bad[key(l)] == doc]
        out.append((doc, len(lines), len(lines) - len(kept),
                    hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_lines(spark, seed):
    rng = random.Random(seed)
    pool = [" A shared Line of some length ", "a shared line OF some length\t", "short", "", "É" * 25, "é" * 25,
            "x" * 19, "X" * 20, "x" * 20, "only once " * 3]
    rows = [(rng.choice([*range(12), None]), "\n".join(rng.choices(pool, k=rng.randint(0, 9)))) for _ in range(40)]
    rows += [r[:2] for r in ODD] + rows[:3]
    found = linededup.dedup_lines(documents(spark, rows))
    assert {"size", "score", "key"} <= set(found.columns)
    got = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest())
           for r in found.collect()]
    assert sorted(got, key=repr) == lines_brute(rows)


def targets_brute(sizes, most=3):
    """Share by weight, stop at the limit, reshare the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while True:
        share = (total - sum(target.values())) / max(1, sum(weight[s] for s in free))
        above = {s for s in free if weight[s] * share > most * sizes[s]}
        if not above:
            return target | {s: weight[s] * share for s in free}
        target |= {s: most * sizes[s] for s in above}
        free -= above


@pytest.mark.parametrize("seed", range(3))
def test_mix(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["b", "a", None, "ä", "Z", "c"] + ["hot"] * 5))
            for i in range(600)] + ODD + ODD
    mix = mixing.mix_sources(documents(spark, rows)).collect()
    sizes = Counter()
    for r in documents(spark, rows).collect():
        sizes[r.source] += len(WORDS.findall(r.text or ""))
    target, taken, largest = targets_brute(sizes), Counter(), defaultdict(int)
    for r in mix:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for source in sizes:        # nearer than the smallest choice left, apart from documents that repeat
        assert abs(taken[source] - target[source]) <= max(60 if source != "s" else largest[source], 1)
    again = mixing.mix_sources(documents(spark, rows)).collect()
    assert sorted(map(str, mix)) == sorted(map(str, again))
    docs = documents(spark, rows)
    out = mixing.repeat_mixed(docs, mixing.mix_sources(docs))
    words = Counter()
    for r in out.collect():
        words[r.source] += len(WORDS.findall(r.text or ""))
    assert out.columns == docs.columns and words == +taken


def test_mix_follows_odds(spark):
    docs = documents(spark, [(i, "a b c d", "s") for i in range(3000)] + [(-i, "x " * 3000, "t") for i in (1, 2)])
    docs = docs.selectExpr("*", "IF(doc_id % 2 = 0, 9.0, 1.0) AS quality")
    rows = [r for r in mixing.mix_sources(docs, weights=(1, 5), odds="quality").collect() if r.source == "s"]
    # 750 copies, nine to one.
    assert {round(r.expected, 9) for r in rows} == {0.45, 0.05} and sum(r.copies for r in rows) == 750
    assert abs(sum(r.copies for r in rows if r.doc_id % 2 == 0) - 675) < 30


def expected_brute(docs, target, most):
    """docs: (size, odds). Raise the level until the expected words are the target."""
    low, high = 0.0, 1e9
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(s * min(most, level * o) for s, o in docs) < target else (low, level)
    return [min(most, high * o) for _, o in docs]


@pytest.mark.parametrize("seed", range(2))
def test_certain_copies_and_inclusion(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.randint(1, 9), rng.choice("ab"), rng.choice([0.5, 1.0, 4.0, 30.0])) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, quality double")
    mix = {r.doc_id: r for r in mixing.mix_sources(docs, weights=(3, 2), odds="quality", seed=seed).collect()}
    for source in "ab":
        own = [r for r in rows if r[2] == source]
        target = mix[own[0][0]].target
        expected = expected_brute([(len(r[1].split()), r[3]) for r in own], target, 3)
        for r, e in zip(own, expected):
            assert abs(mix[r[0]].expected - e) < 1e-6
            assert round(e, 6) // 1 <= mix[r[0]].copies <= -(-round(e, 6) // 1)      # whole copies are certain
        assert abs(sum(mix[r[0]].taken for r in own) - target) <= 9
        for q in (0.5, 1.0, 4.0, 30.0):
            group = [(mix[r[0]].copies, e) for r, e in zip(own, expected) if r[3] == q]
            assert abs(sum(c for c, _ in group) - sum(e for _, e in group)) < 4 * max(1, len(group)) ** 0.5 / 2


def test_mix_orders_by_pareto_ratio(spark):
    """Every document beside the closing one: taken if and only if its ratio is below the cut."""
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(1, 200), rng.choice("ab")) for i in range(500)]
    mix = mixing.mix_sources(documents(spark, rows)).collect()
    for source in "ab":
        placed = []
        for r in mix:
            part = r.expected - int(r.expected)
            if r.source == source and part > 0:
                u = (int(hashlib.md5(f"1:{r.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
                placed.append((u / (1 - u) / (part / (1 - part)), r.copies - int(r.expected)))
        taken = [extra for _, extra in sorted(placed)]
        cut = taken.index(0) if 0 in taken else len(taken)
        assert sum(taken[cut:]) <= 1 and (len(taken) < 20 or 0 < cut < len(taken))


def test_mix_with_odd_odds_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, "a b", "s", q, i, i, i, i) for i, q in enumerate([nan, None, inf, -inf, 0.0, -1.0, 1.0, 1e300])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, quality double, "
                                       "copies long, words long, doc long, `of.a` long")
    mix = mixing.mix_sources(docs, odds="quality")
    assert sum(r.taken for r in mix.collect()) == 16
    expected = {r.doc_id: r.expected for r in mix.collect()}
    assert expected[0] == expected[1] == expected[6] and expected[2] == expected[7] == 3
    assert expected[3] == expected[4] == expected[5] < expected[0]
    out = mixing.repeat_mixed(docs, mix)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in mix.collect() for _ in range(r.copies))


def test_feistel_is_a_permutation():
    for rows in (1, 2, 3, 5, 16, 17, 1000, 4097):
        places = sharding.permute(np.arange(rows), rows, 3)
        assert sorted(places) == list(range(rows))
        assert list(sharding.unpermute(places, rows, 3)) == list(range(rows))
    far = np.array([0, 1, 2 ** 60, 2 ** 61 - 2])
    assert list(sharding.unpermute(sharding.permute(far, 2 ** 61 - 1, 9), 2 ** 61 - 1, 9)) == list(far)


@pytest.mark.parametrize("copies", [0, 1, 7])
def test_shards(spark, copies):
    docs = documents(spark, ODD * copies)
    rows = sharding.assign_shards(docs, ["doc_id", "text"], shards=4).collect()
    assert len(rows) == len(ODD) * copies
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert not rows or max(map(len, slots.values())) - min(len(slots.get(i, [])) for i in range(4)) <= 1
    order = sorted(rows, key=lambda r: r.row_number)
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, (r.text or "").encode())
    assert [key(r) for r in order] == sorted(map(key, rows))
    places = sharding.permute(np.arange(len(rows)), max(1, len(rows)), 20240601)
    assert [(r.shard, r.slot) for r in order] == [(p % 4, p // 4) for p in places]


@pytest.fixture(scope="module")
def encoders():
    paths = {n: queries.tokenizer_path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}
    return {n: Encoder(open(p, encoding="utf-8").read()) for n, p in paths.items()}


@pytest.fixture(scope="module")
def library():
    """The tokenizers as the library reads them, to compare with."""
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(queries.tokenizer_path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_encode_like_whole_texts(encoders, library, name):
    encoder, rng = encoders[name], random.Random(5)
    assert encoder.by_piece
    parts = ["a", "b", "é", "Z", "'", " ", " ", "s", "t", "re", "\n", "\t", ".", "!", "1", "0", "²", "ª", "中",
             "́", "̸", "\xa0", "<|endoftext|>", "İ", "ß", "_", "<", "\x1c", "​", "<|StartOfText|>", "don't", "É", "Σ"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(5000)]
    whole = [np.array(e.ids, "<u4").tobytes()
             for e in library[name].encode_batch(texts, add_special_tokens=False)]
    assert [ids for group in encoder.batches(texts, 1000) for ids in group] == whole
    assert [ids for group in encoder.batches(texts, 1000, remember=50) for ids in group] == whole


def test_added_tokens_are_found_in_texts(encoders, library):
    texts = ["a <|endoftext|> b", "<|startoftext|>", "<|endoftext|", "x<|ENDOFTEXT|>y", "plain text"]
    for name, encoder in encoders.items():
        want = [library[name].encode(text, add_special_tokens=False).ids for text in texts]
        assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(texts)] == want
    assert library["word_bpe_49k.json"].encode(texts[0], add_special_tokens=False).ids == [320, 49407, 321]


def test_words_share_pieces(library):
    """Words that differ in the marks after them alone are learned once."""
    encoder = Encoder(open(queries.tokenizer_path("word_bpe_49k.json"), encoding="utf-8").read())
    texts = ["Thon. thon, thon### éa. don't", "", "THON.\n÷. ×, ÿ! a.b", "ÉA. x\x1cy.", " "]
    want = [np.array(e.ids, "<u4").tobytes()
            for e in library["word_bpe_49k.json"].encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == want and encoder.encode(texts[::-1]) == want[::-1]
    assert set(encoder.known) - {""} == {"thon", ".", ",", "###", "éa", "don", "'t", "÷.", "×,", "ÿ", "!", "a",
                                         ".b", "x\x1cy"}
    assert encoder.encode([]) == [] and encoder.encode([""]) == [b""]


def ids_of(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("rows", [[], ODD, ODD + [(i % 50, f"text {i} " * (i % 7)) for i in range(300)]])
def test_token_store(spark, library, tmp_path, rows, monkeypatch):
    monkeypatch.setattr(tokenstore, "SEGMENT_BYTES", 300)
    path = str(tmp_path / "store")
    tokenstore.write_store(documents(spark, rows), path, queries.tokenizer_path("word_bpe_49k.json"), end_id=1)
    got = sorted(tokenstore.read_documents(spark, path).collect(), key=lambda r: r.start)
    want = {(d, ids_of(library["word_bpe_49k.json"], t, 1).tobytes()) for d, t in rows}
    assert len(got) == len(rows) and {(r.doc_id, bytes(r.ids)) for r in got} == want
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])][:len(got)]
    key = lambda d: (d is not None, d or 0)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=key)
    index = tokenstore.read_index(spark, path).collect()
    assert sorted((r.start, r.n_tokens) for r in index) == [(r.start, r.n_tokens) for r in got]
    some = tokenstore.read_some(spark.createDataFrame([(3,), (6,), (999,)], "doc_id long"), path).collect()
    assert sorted((r.doc_id, r.start, bytes(r.ids)) for r in some) == sorted(
        (r.doc_id, r.start, bytes(r.ids)) for r in got if r.doc_id in (3, 6))


def check_plan(counts, capacity):
    plan = packing.plan_packing(counts, capacity)
    fill, ends = Counter(), defaultdict(list)
    seen = Counter()
    entries = sorted(plan.entries)
    for i, (length, rank, sequence, copies, offset) in enumerate(entries):
        following = entries[i + 1] if i + 1 < len(entries) and entries[i + 1][0] == length else None
        end = following[1] if following else counts[length]
        for past in range(end - rank):
            seen[length] += 1
            ends[sequence + past // copies].append((offset + past % copies * length, length))
    assert seen == Counter({k: v for k, v in counts.items() if v})
    for sequence, items in ends.items():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
        large = [length for _, length in items if 3 * length > capacity]
        assert len(large) <= 2
    assert set(ends) == set(range(plan.sequences))
    return plan


@pytest.mark.parametrize("seed", range(60))
def test_packing_plan(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 2, 3, 10, 12, 30, 64])
    items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 200))]
    plan = check_plan(dict(Counter(items)), capacity)
    bins = []                    # best fit, largest first, item by item
    for length in sorted(items, reverse=True):
        gaps = [g for g in bins if g >= length]
        if gaps:
            bins.remove(min(gaps))
            bins.append(min(gaps) - length)
        else:
            bins.append(capacity - length)
    assert plan.sequences <= len(bins)


@pytest.mark.parametrize("rows", [[], ODD, ODD + [(100 + i, f"word{i} " * (i % 40) * 5) for i in range(200)]])
def test_packing(spark, library, rows):
    out = packing.pack_documents(documents(spark, rows), queries.tokenizer_path("byte_bpe_50k.json"), capacity=64)
    got, fill = out.collect(), defaultdict(list)
    want = Counter()
    for doc, text in rows:
        ids = ids_of(library["byte_bpe_50k.json"], text, 2)
        cuts = [0, *range(len(ids) % 64 or 64, len(ids), 64), len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
    for items in fill.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 64
    assert set(fill) == set(range(len(fill)))


def test_quality_on_held_out_rows(spark, folder):
    small = folder.replace("sf0.001", "sf0.01")
    rows = {r.doc_id: r for r in queries.op8_quality_classifier(spark, small).collect()}
    labels = queries.table(spark, small, "labels").collect()
    assert len(rows) == queries.table(spark, small, "documents").count()
    assert all((zlib.crc32(str(d).encode()) % 5 == 0) == r.held_out and 0 <= r.score <= 1
               and r.predicted == (r.score >= 0.3) for d, r in rows.items())
    held = [(rows[r.doc_id].score, r.quality) for r in labels if rows[r.doc_id].held_out]
    good = [s for s, q in held if q == 1]
    bad = [s for s, q in held if q == 0]
    wins = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert wins > 0.95 and np.mean([s >= 0.3 for s in good]) > 0.97


def test_quality_against_plain_python(spark, folder):
    """Dictionaries, compressed sizes and scores, computed again text by text without the module's functions."""
    import zstandard

    docs, labels = (queries.table(spark, folder, name) for name in ("documents", "labels"))
    model = quality.fit_quality(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    known = {r.doc_id: r.quality for r in labels.collect()
             if r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5}
    for label, dictionary in ((1, model.good), (0, model.bad)):
        own = sorted((zlib.crc32(f"q{d}".encode()), d) for d, q in known.items() if q == label)[:1200]
        data = [texts[d].encode() for _, d in own if d in texts and len(texts[d]) <= 50_000]
        assert dictionary == zstandard.train_dictionary(
            112_640, [b[i:i + 2048] for b in data for i in range(0, len(b), 2048)]).as_bytes()

    def size(content, block):
        given = zstandard.ZstdCompressionDict(content) if content else None
        return len(zstandard.ZstdCompressor(3, given, write_content_size=False, write_checksum=False, write_dict_id=False).compress(block))

    scored = {r.doc_id: r.score for r in quality.score_documents(docs, labels).collect()}
    assert set(scored) == set(texts)
    for doc, text in sorted(texts.items())[::20]:
        data = text.encode()
        blocks = [data[i:i + 1024] for i in range(0, len(data), 1024)] or [b""]
        good, bad = (sum(size(content, b) for b in blocks) for content in (model.good, model.bad))
        n = max(len(data), 1)
        seen = [(good - bad) / n, good / n, bad / n, size(None, data) / n, np.log(1 + len(data))]
        z = [min(8, max(-8, (v - m) / d)) for v, m, d in zip(seen, model.mean, model.spread)]
        x = sum(w * v for w, v in zip(model.weights, [*z, *[v * v for v in z], 1]))
        assert scored[doc] == pytest.approx(1 / (1 + np.exp(-min(30, max(-30, x)))), abs=1e-9)


def test_quality_blocks_are_drawn_from_whole_texts():
    rng = random.Random(3)
    texts = [(label, "".join(rng.choices("abcdefgh" if label else "stuvwxyz", k=60_000))) for label in (0, 1, 1)]
    whole, few = (quality._dictionaries(texts, most) for most in (1000, 20))
    assert whole != few and few == quality._dictionaries(texts, 20) and all(few)
    # The last text has as good a chance as the first one.
    blocks = [text[i:i + 2048].encode() for label, text in texts if label for i in range(0, 60_000, 2048)]
    drawn = sorted(range(len(blocks)), key=lambda i: (zlib.crc32(blocks[i]), i))[:20]
    assert max(drawn) >= 30 and few[0] == tokenstore.train_dictionary([blocks[i] for i in sorted(drawn)], 112_640)


@pytest.mark.parametrize("labels", [[], [(3, 1)], [(3, 1), (4, 0)], [(i, i % 2) for i in range(10)]])
def test_quality_with_few_labels(spark, labels):
    frame = spark.createDataFrame([(*row, 0) for row in labels], "doc_id long, quality int, toxic int")
    for rows in (ODD, []):
        got = quality.score_documents(documents(spark, rows), frame).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        assert {r.held_out for r in got if r.doc_id is None} <= {True}


def test_quality_ignores_held_out_labels(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0)
    texts = [(i, ("good words here " if i % 2 else "B@D!! ") * 9 + str(i)) for i in range(200)]
    docs = documents(spark, texts)
    base = [(i, i % 2, 0) for i in range(200)]
    other = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in base]
    schema = "doc_id long, quality int, toxic int"
    a, b = (quality.fit_quality(docs, spark.createDataFrame(x, schema)) for x in (base, other))
    assert a == b and held is not None
