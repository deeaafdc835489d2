"""The stages of the pipeline, one after the other, against plain Python."""

import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as pipeline
from llm_cases import folder  # noqa: F401
from tracewright.llm import mixing, queries
from tracewright.llm.quality import score_documents

from test_documents import WORDS, ids_of, lines_brute, targets_brute
from test_groups import near_brute
from tokenizers import Tokenizer


def test_stages(spark, folder):
    docs = queries.table(spark, folder, "documents")
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "line_dedup", "minhash_near_dedup", "mix_sources", "best_fit_packing"]
    scored = score_documents(docs, queries.table(spark, folder, "labels")).collect()

    good = stages["quality_classifier"](spark, docs, folder)
    assert good.columns == docs.columns
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in scored if r.score >= 0.3}

    lines = stages["line_dedup"](spark, good, folder)
    assert lines.columns == docs.columns
    import hashlib
    rows = [(r.doc_id, r.text) for r in good.collect()]
    got = {r.doc_id: r for r in lines.collect()}
    for doc, _, dropped, digest in lines_brute(rows):
        assert hashlib.sha256((got[doc].text or "").encode()).hexdigest() == digest
        assert not dropped or got[doc].n_chars == len(got[doc].text)

    near = stages["minhash_near_dedup"](spark, lines, folder)
    rows = [(r.doc_id, r.text) for r in lines.collect()]
    assert near.columns == docs.columns
    assert {r.doc_id for r in near.collect()} == {d for d, _, _, kept in near_brute(rows, 5) if kept}

    mixed = stages["mix_sources"](spark, near, folder)
    assert mixed.columns == docs.columns
    size = lambda r: len(WORDS.findall(r.text or ""))
    sizes, taken = Counter(), Counter()
    for r in near.collect():
        sizes[r.source] += size(r)
    for r in mixed.collect():
        taken[r.source] += size(r)
    target = targets_brute(sizes)
    largest = max(size(r) for r in near.collect())
    assert all(abs(taken[s] - target[s]) <= largest for s in sizes)
    assert max(Counter(r.doc_id for r in mixed.collect()).values()) <= 3

    packed = stages["best_fit_packing"](spark, mixed, folder).collect()
    encoder = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    want = Counter()
    for r in mixed.collect():
        want[r.doc_id] += len(ids_of(encoder, r.text, 2))
    have = Counter()
    for r in packed:
        have[r.doc_id] += r.length
    assert have == want
    fill = Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024 and len(fill) >= sum(want.values()) / 1024


def test_run(spark, folder):
    assert pipeline.run(spark, folder).count() > 0 and mixing is not None


def test_odd_rows(spark, folder):
    """Nulls, empty and very long texts, repeated rows and an empty table pass all stages."""
    from llm_cases import ODD, documents

    for rows in (ODD + ODD, []):
        docs = documents(spark, rows)
        for _, stage in pipeline.STAGES:
            docs = stage(spark, docs, folder)
        assert (docs.count() > 0) == bool(rows)
