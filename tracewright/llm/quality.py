"""Quality classifier by compression: which class's dictionary makes a text smaller.

Two zstandard dictionaries are built, from texts labelled good and from texts labelled bad. A text is
compressed with each of them, in blocks so that a dictionary counts as much at the end of a long text
as at its start. The difference of the sizes, per byte of text, is the evidence; a logistic curve,
fitted to other labelled texts, turns it into a probability. The curve also sees the sizes themselves
and the text's length, since a given difference means less for text that is hardly compressible.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import keep
from tracewright.llm.tokenstore import train_dictionary

BLOCK_BYTES, DICTIONARY_BYTES, LEVEL = 1024, 112_640, 3


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries and the calibrated curve; without both classes only `prior` counts."""

    good: bytes | None
    bad: bytes | None
    mean: tuple[float, ...] = ()
    spread: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    prior: float = 0.5

    def features(self, texts: list[str | None]) -> np.ndarray:
        import zstandard

        def coder(content: bytes | None):
            shared = None if content is None else zstandard.ZstdCompressionDict(content)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=False,
                                            write_checksum=False, write_dict_id=False).compress

        good, bad, alone = coder(self.good), coder(self.bad), coder(None)
        rows = []
        for text in texts:
            data = (text or "").encode()
            blocks = [data[i:i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)] or [b""]
            rows.append((sum(len(good(b)) for b in blocks), sum(len(bad(b)) for b in blocks),
                         len(alone(data)), len(data)))
        sizes = np.array(rows, float).reshape(-1, 4)
        length = np.maximum(sizes[:, 3], 1)
        return np.column_stack([(sizes[:, 0] - sizes[:, 1]) / length, sizes[:, 0] / length, sizes[:, 1] / length,
                                sizes[:, 2] / length, np.log1p(sizes[:, 3])])

    def scores(self, features: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(features), self.prior)
        return _curve(_terms(features, np.array(self.mean), np.array(self.spread)) @ np.array(self.weights))


def _curve(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _terms(features: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    z = np.clip((features - mean) / spread, -8, 8)
    return np.column_stack([z, z ** 2, np.ones(len(z))])


def _fit_curve(terms: np.ndarray, labels: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton steps that are halved until they gain; the constant is free."""
    weights, penalty = np.zeros(terms.shape[1]), np.full(terms.shape[1], ridge)
    penalty[-1] = 1e-6

    def loss(w):
        x = terms @ w
        return np.logaddexp(0, np.where(labels == 1, -x, x)).sum() + (penalty * w * w).sum() / 2

    for _ in range(100):
        p = _curve(terms @ weights)
        slope = terms.T @ (p - labels) + penalty * weights
        bend = (terms * (p * (1 - p))[:, None]).T @ terms + np.diag(penalty + 1e-9)
        step, size, now = np.linalg.solve(bend, slope), 1.0, loss(weights)
        while size > 1e-6 and loss(weights - size * step) > now:
            size /= 2
        weights = weights - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return weights


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; rows with 0 are held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def _dictionaries(texts: list[tuple[int, str | None]], most_samples: int
                  ) -> tuple[bytes | None, bytes | None]:
    """Dictionaries of good and bad texts, None for a class without text.

    Of more than `most_samples` blocks those with the smallest hashes are taken, from whole texts.
    """
    def drawn(blocks: list[bytes]) -> list[bytes]:
        if len(blocks) <= most_samples:
            return blocks
        first = sorted(range(len(blocks)), key=lambda i: (zlib.crc32(blocks[i]), i))[:most_samples]
        return [blocks[i] for i in sorted(first)]

    found: dict[int, list[bytes]] = {0: [], 1: []}
    for label, text in texts:
        data = (text or "").encode()
        found[label] += [data[i:i + 2048] for i in range(0, len(data), 2048)]
    good, bad = (train_dictionary(drawn(found[label]), DICTIONARY_BYTES) if any(found[label]) else None
                 for label in (1, 0))
    return good, bad


def fit_quality(docs: DataFrame, labels: DataFrame, class_docs: int = 1200, curve_docs: int = 9000,
                most_chars: int = 50_000, most_samples: int = 16_000) -> QualityModel:
    """Learn from labelled rows outside the held-out fold.

    docs: doc_id, text. labels: doc_id, quality (1 good, 0 bad; other values and nulls are ignored).
    The model is fitted to a bounded sample, chosen by a hash of the id: at most `class_docs` documents
    of each class for the dictionaries and `curve_docs` documents for the curve, none of them longer
    than `most_chars`. A dictionary is trained on at most `most_samples` blocks of 2,048 bytes of its class,
    drawn by hash from the whole sampled texts. The sample is dealt into three parts, and the curve sees each part's texts as
    compressed with dictionaries of the two others, since a dictionary knows its own texts by heart.
    Without both classes every score is the share of good labels, 0.5 without any.
    """
    chance = F.crc32(F.concat(F.lit("q"), F.col("doc_id").cast("string")))
    known = (labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
             .filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
             .distinct().withColumn("chance", chance))
    of_class = [known.filter(F.col("quality") == label).orderBy("chance", "doc_id").limit(class_docs)
                for label in (0, 1)]
    lexicon = of_class[0].union(of_class[1]).withColumn("use", F.lit("dictionary"))
    for_curve = known.orderBy("chance", "doc_id").limit(curve_docs).withColumn("use", F.lit("curve"))
    # At most 2 * class_docs + curve_docs rows are broadcast.
    chosen = lexicon.union(for_curve).withColumnRenamed("doc_id", "_id")
    sample = (docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
              .filter(F.char_length(F.coalesce("text", F.lit(""))) <= most_chars)
              .withColumn("third", F.expr("chance div 64 % 3")))
    sample = keep(sample.select("doc_id", "text", "quality", "chance", "third", "use"), "quality-sample")

    rows = (sample.filter("use = 'dictionary'").orderBy("chance", "doc_id", "text").limit(2 * class_docs)
            .select("quality", "text", "third").collect())
    good, bad = _dictionaries([(r["quality"], r["text"]) for r in rows], most_samples)
    if good is None or bad is None:
        share = known.agg(F.avg("quality")).first()[0]
        return QualityModel(None, None, prior=0.5 if share is None else share)
    others = [QualityModel(*_dictionaries([(r["quality"], r["text"]) for r in rows if r["third"] != third], most_samples))
              for third in range(3)]

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for third, part in batch.groupby("third"):
                found = pd.DataFrame(others[third].features(part["text"].tolist()), columns=list("abcde"))
                yield found.assign(quality=part["quality"].to_numpy())

    whole = [third for third in range(3) if others[third].good and others[third].bad]
    rows = (sample.filter((F.col("use") == "curve") & F.col("third").isin(whole)).select("text", "quality", "third")
            .limit(2 * curve_docs).repartition(16)
            .mapInPandas(measured, "a double, b double, c double, d double, e double, quality int").toPandas())
    y, x = rows["quality"].to_numpy(float), rows[list("abcde")].to_numpy(float).reshape(-1, 5)
    if len(set(y)) < 2:         # too few labels for a curve: the sign of the difference decides
        return QualityModel(good, bad, (0.0,) * 5, (1.0,) * 5, (-40.0,) + (0.0,) * 9 + (0.5,))
    order = np.lexsort(x.T)
    x, y = x[order], y[order]   # sums do not depend on the order rows arrive in
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    weights = _fit_curve(_terms(x, mean, spread), y)
    return QualityModel(good, bad, tuple(mean), tuple(spread), tuple(weights))


def quality_score(text: Column, model: QualityModel) -> Column:
    """Probability that a text is good; null and empty texts are scored as empty."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.scores(model.features(batch.tolist())), dtype=float)

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """`docs` with held_out, score (0 to 1) and predicted (1 from `threshold` on).

    Scores depend on the text alone, on all of it, however long. Rows with a null doc_id are held out. Repeated rows score alike; an
    empty table gives an empty result. Columns named like the new ones are replaced.
    """
    model = fit_quality(docs, labels)
    scored = docs.withColumn("held_out", fold(F.col("doc_id")) == 0)
    scored = scored.withColumn("score", quality_score(F.col("text"), model))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
