"""Near-duplicate documents by MinHash.

Documents become sets of word shingles; equal sets form a class, of which one stands for all. Each class
has many universal-hash minima. Minima in bands of a few name the buckets a class falls into; classes
that share a bucket are candidates. Pairs are compared by their signatures, confirmed on the full sets,
and confirmed links give connected components.

A bucket of m classes is not expanded into its m * m pairs. First each class is confirmed against the
leader of its buckets that it shares most buckets with, which connects nearly all that belongs together.
Only classes of one bucket in different components are then compared, in blocks of bounded size: by
signature first, and where that leaves room for the threshold on the full sets, inside the task. A
pair is skipped once its two components are connected, and only links leave the task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import keep
from tracewright.llm.components import connected_components

# 32 bands of 5 minima find a pair of similarity 0.8 in at least one band with probability 0.999997.
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
BLOCK = 1024
MOST_WORDS = 100_000       # words whose hashes a worker process remembers
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_words: dict[bytes, int] = {}


@cache
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of the hashes x -> (factor * x + summand) mod 2^64 >> 32."""
    seeds = np.random.default_rng(20240601)
    return (seeds.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            seeds.integers(0, 1 << 63, HASHES, dtype=np.uint64))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; of its whole sequence if it has fewer words."""
    import xxhash

    found = (text or "").encode().lower().split()      # on bytes: A-Z, and the six white-space characters
    if not found:
        return np.empty(0, np.uint64)
    if len(_words) > MOST_WORDS:
        _words.clear()
    for word in set(found).difference(_words):
        _words[word] = xxhash.xxh64_intdigest(word)
    hashes = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    width = min(words, len(found))
    total = np.full(len(found) - width + 1, width, np.uint64)
    for i in range(width):
        total = (total ^ (total >> np.uint64(29))) * MIX[0] + hashes[i:len(found) - width + 1 + i]
        total ^= total >> np.uint64(32)
    return np.unique(total * MIX[1])


def signature(items: np.ndarray) -> np.ndarray:
    factor, summand = _multipliers()
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(items), 2048):
        part = (items[i:i + 2048, None] * factor + summand) >> np.uint64(32)
        least = np.minimum(least, part.min(0).astype(np.uint32))
    return least


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per row and band."""
    bands = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX[1] + np.zeros((len(bands), 1), np.uint64)
    for i in range(ROWS):
        keys = (keys ^ (keys >> np.uint64(29))) * MIX[0] + bands[:, :, i]
        keys ^= keys >> np.uint64(32)
    return (keys * MIX[1]).view(np.int64)


def _digest(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def _signatures(docs: DataFrame, words: int) -> DataFrame:
    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                items = shingles(text, words)
                rows.append((len(items), _digest(items) if len(items) else None,
                             signature(items).tobytes() if len(items) else None))
            out = pd.DataFrame(rows, columns=["n_shingles", "set_key", "signature"])
            out.insert(0, "doc_id", pd.array([None if pd.isna(i) else int(i) for i in batch["doc_id"]], "Int64"))
            yield out
        _words.clear()      # worker processes outlive their tasks

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(signed, "doc_id long, n_shingles long, set_key binary, signature binary")


def _buckets(classes: DataFrame) -> DataFrame:
    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                keys = band_keys(np.frombuffer(b"".join(batch["signature"]), np.uint32).reshape(-1, HASHES))
                yield pd.DataFrame({"bucket": keys.ravel(), "cls": np.repeat(batch["cls"].to_numpy(), BANDS)})

    return classes.select("cls", "signature").mapInPandas(dealt, "bucket long, cls long")


def _full_sets(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """cls, items: the full sets of the given classes, from the text of the document that stands for each."""
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingles(text, words) for text in batch["text"]]
            same = [_digest(items) == bytes(key) for items, key in zip(found, batch["set_key"])]
            yield pd.DataFrame({"cls": batch["cls"][same], "items": [i.tobytes() for i, s in zip(found, same) if s]})

    rows = docs.select("doc_id", "text").join(classes.select("cls", "rep", "set_key"), F.col("doc_id") == F.col("rep"))
    return rows.select("cls", "set_key", "text").mapInPandas(sets, "cls long, items binary").dropDuplicates(["cls"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            same = [_alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                    for x, y in zip(batch["left"], batch["right"])]
            yield batch.loc[same, ["a", "b"]]

    left = sets.select(F.col("cls").alias("_a"), F.col("items").alias("left"))
    right = sets.select(F.col("cls").alias("_b"), F.col("items").alias("right"))
    return (pairs.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b"))
            .select("a", "b", "left", "right").mapInPandas(alike, "a long, b long"))


def _whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of sorted rows, each whole although batches cut through them."""
    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(rows):
            continue
        values = rows[keys].to_numpy()
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1
        for a, b in zip([0, *cuts], cuts):
            yield rows.iloc[a:b]
        rest = rows.iloc[cuts[-1] if len(cuts) else 0:]
    if rest is not None and len(rest):
        yield rest


def _agreement(signatures: np.ndarray) -> np.ndarray:
    if len(signatures) <= 48:
        return (signatures[:, None] == signatures[None]).sum(2)
    total = np.zeros((len(signatures),) * 2, np.uint16)
    for column in signatures.T:
        total += column[:, None] == column
    return total


def _likely(group: pd.DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one cell that may reach the threshold and join different components, likeliest
    first. A pair in several common buckets counts in the first of them only."""
    comp, block = group["comp"].to_numpy(), group["block"].to_numpy()
    signatures = np.frombuffer(b"".join(group["signature"]), np.uint32).reshape(-1, HASHES)
    differ = np.triu(comp[:, None] != comp, 1)
    if group["bi"].iloc[0] != group["bj"].iloc[0]:
        differ &= block[:, None] != block
    if not differ.any():
        return np.empty(0, int), np.empty(0, int)
    agreement = _agreement(signatures)
    x, y = np.nonzero(differ & (agreement >= least))
    keys = band_keys(signatures)
    band = int(np.flatnonzero(keys[0] == group["bucket"].iloc[0])[0])
    for earlier in range(band):
        first = keys[x, earlier] != keys[y, earlier]
        x, y = x[first], y[first]
    order = np.argsort(-agreement[x, y].astype(int), kind="stable")
    return x[order], y[order]


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _links(group: pd.DataFrame, least: int, percent: int) -> list[tuple[int, int]]:
    """Confirmed links of one cell, as many as it takes to connect its components."""
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            root[c] = root.get(root[c], root[c])
            c = root[c]
        return c

    cls, comp = group["cls"].tolist(), group["comp"].tolist()
    sets = [np.frombuffer(items, np.uint64) for items in group["items"]]
    out = []
    x, y = _likely(group, least)
    for start in range(0, len(x), 10_000):
        for i, j in zip(x[start:start + 10_000].tolist(), y[start:start + 10_000].tolist()):
            a, b = find(comp[i]), find(comp[j])
            if a != b and _alike(sets[i], sets[j], percent):
                root[a] = b
                out.append((cls[i], cls[j]))
    return out


def _cross_links(shared: DataFrame, classes: DataFrame, sets: DataFrame, labels: DataFrame, least: int, percent: int
                 ) -> DataFrame | None:
    """Links between classes of one bucket and different components; None without such buckets.

    A bucket of m classes is cut into m / BLOCK + 1 blocks; every pair of blocks is a cell, so that no
    task holds more than about 2 * BLOCK classes of a bucket at a time.
    """
    rows = keep(shared.join(labels, F.col("cls") == F.col("node"), "left")
                .select("bucket", "cls", F.coalesce("label", "cls").alias("comp")), "bucket-rows")
    mixed = keep(rows.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                            F.count(F.lit(1)).alias("m"))
                 .filter("lo <> hi").select(F.col("bucket").alias("_bucket"), F.expr(f"m div {BLOCK} + 1").alias("nb")),
                 "mixed-buckets")
    if mixed.isEmpty():
        return None
    dealt = (rows.join(mixed, F.col("bucket") == F.col("_bucket"))
             .withColumn("block", F.pmod(F.xxhash64("cls"), F.col("nb")))
             .join(classes.select(F.col("cls").alias("_cls"), "signature"), F.col("cls") == F.col("_cls"))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
             .select("bucket", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"),
                     "block", "cls", "comp", "signature"))
    cell = ["bucket", "bi", "bj"]

    def promising(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _whole_groups(batches, cell):
            if len(group) > 1:
                x, y = _likely(group, least)
                if len(x):
                    yield group.iloc[np.unique(np.concatenate([x, y]))]

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _whole_groups(batches, cell):
            found = _links(group, least, percent)
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    few = dealt.repartition(*cell).sortWithinPartitions(*cell).mapInPandas(promising, dealt.schema)
    few = keep(few, "promising").join(sets.withColumnRenamed("cls", "_set"), F.col("cls") == F.col("_set")).drop("_set")
    return few.repartition(*cell).sortWithinPartitions(*cell).mapInPandas(linked, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, set_key for every row of `docs` (doc_id integer, text).

    Texts are lower-cased (A-Z) and split at white space; a document's set has its distinct shingles of
    `words` words, or its whole sequence if it has fewer. Documents with 100 * intersection >= `percent`
    * union are linked; component_id is the least doc_id in reach, `kept` marks the document that has
    it. Null and empty texts have no shingles and no links. Rows without a doc_id are linked with nothing:
    their component_id is null and they are kept. Rows that repeat a doc_id are documents of their own
    under the same name. Further columns are ignored. An empty table gives an empty result.
    """
    least = int(HASHES * (percent / 100 - 4.5 * (percent / 100 * (1 - percent / 100) / HASHES) ** 0.5))
    signed = keep(_signatures(docs, words), "signatures")
    classes = keep(signed.filter("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key")
                   .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members"),
                        F.first("signature").alias("signature"))
                   .withColumn("cls", F.monotonically_increasing_id()), "classes")
    buckets = keep(_buckets(classes), "buckets")
    leaders = keep(buckets.groupBy(F.col("bucket").alias("_bucket"))
                   .agg(F.min("cls").alias("leader"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m"), "leaders")
    shared = keep(buckets.join(leaders, F.col("bucket") == F.col("_bucket")).select("bucket", "cls", "leader"), "shared")
    labels = None
    if not shared.isEmpty():
        near = shared.select(F.col("cls").alias("_near")).distinct()
        sets = keep(_full_sets(docs, classes.join(near, F.col("cls") == F.col("_near")), words), "full-sets")
        often = shared.filter("cls <> leader").groupBy("cls", "leader").agg(F.count(F.lit(1)).alias("times"))
        pairs = often.groupBy(F.col("cls").alias("a")).agg(
            F.max_by("leader", F.struct("times", -F.col("leader"))).alias("b"))
        labels = keep(connected_components(_confirmed(pairs, sets, percent)), "labels")
        links = _cross_links(shared, classes, sets, labels, least, percent)
        if links is not None:
            labels = keep(_joined(labels, keep(links, "links")), "labels")
    return _result(signed, classes, labels)


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links: components of the graph between components."""
    ends = links
    for end in ("a", "b"):
        ends = (ends.join(labels, F.col(end) == F.col("node"), "left")
                .withColumn(end, F.coalesce("label", end)).drop("node", "label"))
    merged = keep(connected_components(ends.select("a", "b")), "merged")
    renamed = merged.select(F.col("node").alias("_of"), F.col("label").alias("_to"))
    known = (labels.join(renamed, F.col("label") == F.col("_of"), "left")
             .select("node", F.coalesce("_to", "label").alias("label")))
    return known.union(merged.join(labels.select(F.col("node").alias("_n")), F.col("node") == F.col("_n"), "left_anti"))


def _result(signed: DataFrame, classes: DataFrame, labels: DataFrame | None) -> DataFrame:
    rows = signed.select("doc_id", "n_shingles", "set_key")
    narrow = classes.select("cls", "set_key", "rep", "members")
    if labels is None:
        linked = narrow.withColumn("component", F.col("rep"))
    else:
        linked = narrow.join(labels, F.col("cls") == F.col("node"), "left").withColumn(
            "label", F.coalesce("label", "cls"))
        least = keep(linked.filter("node IS NOT NULL").groupBy(F.col("label").alias("_label"))
                     .agg(F.min("rep").alias("least")), "component-ids")
        linked = (linked.join(least, F.col("label") == F.col("_label"), "left")
                  .withColumn("component", F.coalesce("least", "rep")))
    # All other classes are one document, which stands for itself.
    linked = keep(linked.filter("members > 1 OR component <> rep")
                  .select(F.col("set_key").alias("_set"), "component"), "class-components")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return (rows.join(linked, F.col("set_key") == F.col("_set"), "left")
            .select("doc_id", "n_shingles", component.alias("component_id"),
                    F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "set_key"))


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one document of each group: the kept ones, and one of rows that repeat id and set."""
    found = keep(near_duplicates(docs, words, percent), "near-duplicates")
    gone = keep(found.filter(~F.col("kept")).select(F.col("doc_id").alias("_doc"), F.col("set_key").alias("_key"))
                .distinct(), "dropped")
    repeated = found.filter("kept AND set_key IS NOT NULL").groupBy("doc_id", "set_key").count().filter("count > 1")
    several = found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1")
    if repeated.isEmpty() and several.isEmpty():
        # Ids tell rows apart, so the texts need no second look.
        return docs.join(gone.select("_doc"), F.col("doc_id") == F.col("_doc"), "left_anti")
    return _one_per_set(docs, gone, words)


def _one_per_set(docs: DataFrame, gone: DataFrame, words: int) -> DataFrame:
    @F.pandas_udf("binary")
    def set_key(texts: pd.Series) -> pd.Series:
        found = [shingles(text, words) for text in texts]
        return pd.Series([_digest(items) if len(items) else None for items in found], dtype=object)

    marked = docs.withColumn("_set_key", set_key("text"))
    left = marked.join(gone, (F.col("doc_id") == F.col("_doc")) & (F.col("_set_key") == F.col("_key")), "left_anti")
    # Rows without a set are told apart by a number, so that they all stay.
    number = F.when(F.col("_set_key").isNull(), F.monotonically_increasing_id())
    return (left.withColumn("_number", number).dropDuplicates(["doc_id", "_set_key", "_number"])
            .drop("_set_key", "_number"))
