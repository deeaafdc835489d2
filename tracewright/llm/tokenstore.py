"""Token ids in binary files: one zstandard frame per document, one dictionary for all.

Short documents compress badly alone, so a dictionary is trained on serialised id arrays and shared.
Every document is a frame of its own; a segment joins the frames of consecutive documents up to a few
megabytes, and an index has each frame's segment and offset. A store is a folder that Spark writes and
reads, on any file system it knows:

* `dictionary`: one row with the dictionary, its SHA-256, the width of an id in bytes and the end id
* `segments`: part, seq, before (ids of the part's earlier segments), doc_ids, counts (ids per
  document), offsets (where frames begin, and the end of the last), payload, dictionary_hash
* `index`: doc_id, part, seq, place, start (ids of all documents before), n_tokens, offset, length

Documents are in ascending doc_id order over (part, seq, place).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm.tokens import Encoder, share_tokenizer
from tracewright.session import new_folder

SEGMENT_BYTES = 4_000_000
SEGMENTS = ("part long, seq long, before long, doc_ids array<long>, counts array<long>, "
            "offsets array<long>, payload binary, dictionary_hash string")


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary; the samples themselves where they are too few to train on."""
    import zstandard

    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b"\0"


def _coders(dictionary: bytes):
    import zstandard

    shared = zstandard.ZstdCompressionDict(dictionary)
    return (zstandard.ZstdCompressor(level=3, dict_data=shared, write_dict_id=False),
            zstandard.ZstdDecompressor(dict_data=shared))


def _sample(docs: DataFrame, rows: int) -> DataFrame:
    """About `rows` and at most 2 * `rows` documents, chosen by a hash of their ids."""
    total = max(1, docs.count())
    share = min(1.0, 1.5 * rows / total)
    chance = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 30))
    return docs.select("doc_id", "text", chance.alias("_c")).filter(
        F.col("_c") < int(share * (1 << 30)) + 1).orderBy("_c").limit(2 * rows).select("text")


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, dictionary_docs: int = 2000,
                dictionary_bytes: int = 65_536, sample_bytes: int = 100_000) -> None:
    """Encode every whole text, append `end_id` and write a store.

    docs: doc_id (integer), text; further columns are ignored. Null texts count as empty and give the end
    id alone. A null doc_id sorts first; repeated rows and ids are written as often as they come, in any
    order among themselves. An empty table gives a store without documents. The dictionary is fitted to
    a sample of at most 2 * `dictionary_docs` documents, of which each gives at most the first `sample_bytes`
    bytes of its ids; everything is encoded. Texts are encoded whole, however long.
    """
    spark = docs.sparkSession
    spec = share_tokenizer(spark, tokenizer)
    width = 2 if max(Encoder.of(spec.value).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def serialised(texts: list[str]) -> Iterator[tuple[int, bytes]]:
        end = np.array([end_id], f"<u{width}").tobytes()
        for group in Encoder.of(spec.value).batches(texts):
            for ids in group:
                data = np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes() + end
                yield len(data) // width, data

    def ids_only(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"ids": [data[:sample_bytes] for _, data in serialised(batch["text"].tolist())]})

    sample = _sample(docs, dictionary_docs).repartition(16).mapInPandas(ids_only, "ids binary").collect()
    dictionary = train_dictionary([bytes(row["ids"]) for row in sample], dictionary_bytes)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, dictionary, width, end_id)],
                          "hash string, dictionary binary, width int, end_id int"
                          ).coalesce(1).write.parquet(f"{path}/dictionary")

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compress, part = _coders(dictionary)[0].compress, TaskContext.get().partitionId()
        seq = before = held = 0
        ids, counts, frames = [], [], []

        def segment():
            ends = np.cumsum([0, *map(len, frames)])
            return pd.DataFrame({"part": [part], "seq": [seq], "before": [before], "doc_ids": [ids],
                                 "counts": [counts], "offsets": [ends], "payload": [b"".join(frames)],
                                 "dictionary_hash": [digest]})

        for batch in batches:
            names = [None if pd.isna(i) else int(i) for i in batch["doc_id"]]
            for name, (count, data) in zip(names, serialised(batch["text"].tolist())):
                ids.append(name)
                counts.append(count)
                frames.append(compress(data))
                held += len(frames[-1])
                if held >= SEGMENT_BYTES:
                    yield segment()
                    before += sum(counts)
                    seq, held, ids, counts, frames = seq + 1, 0, [], [], []
        if ids:
            yield segment()

    # Rows alike in doc_id are told apart by their place, so that they spread over partitions too.
    order = [F.col("doc_id").asc_nulls_first(), F.col("_row")]
    (docs.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order)
     .sortWithinPartitions(*order).drop("_row").mapInPandas(segments, SEGMENTS)
     .write.parquet(f"{path}/segments"))

    _starts(spark, path).write.parquet(f"{path}/parts")
    _index(spark, path).write.parquet(f"{path}/index")


def _segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).parquet(f"{path}/segments")


def _starts(spark: SparkSession, path: str) -> DataFrame:
    """part, part_start: ids of all documents in earlier parts; one row per part."""
    ids = F.aggregate("counts", F.lit(0).cast("long"), lambda total, count: total + count)
    totals = _segments(spark, path).groupBy("part").agg(F.sum(ids).alias("ids"))
    return totals.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("part_start"))


def _parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part long, part_start long").parquet(f"{path}/parts")


def _index(spark: SparkSession, path: str) -> DataFrame:
    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                counts, offsets = np.asarray(row.counts), np.asarray(row.offsets)
                n = len(counts)
                ids = pd.array([None if pd.isna(i) else int(i) for i in row.doc_ids], "Int64")
                yield pd.DataFrame({"doc_id": ids, "part": row.part, "seq": row.seq, "place": np.arange(n),
                                    "start": row.part_start + row.before + np.cumsum(counts) - counts,
                                    "n_tokens": counts, "offset": offsets[:-1], "length": np.diff(offsets)})

    return (_segments(spark, path).drop("payload", "dictionary_hash").join(_parts(spark, path), "part")
            .mapInPandas(listed, "doc_id long, part long, seq long, place long, start long, n_tokens long, "
                                 "offset long, length long"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")


def _decode(spark: SparkSession, path: str, wanted: DataFrame, digest_only: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids of the frames at `places` (null: all) of each row."""
    head = spark.read.parquet(f"{path}/dictionary").first()
    dictionary, digest, width = bytes(head["dictionary"]), head["hash"], head["width"]
    if hashlib.sha256(dictionary).hexdigest() != digest:
        raise ValueError("the dictionary is not the one this store was written with")

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        expand = _coders(dictionary)[1].decompress
        for batch in batches:
            for row in batch.itertuples():
                if row.dictionary_hash != digest:
                    raise ValueError("a segment was written with another dictionary")
                counts = np.asarray(row.counts)
                starts = row.part_start + row.before + np.cumsum(counts) - counts
                places = range(len(counts)) if row.places is None else row.places
                for some in (places[i:i + 1000] for i in range(0, len(places), 1000)):
                    ids = [np.frombuffer(expand(row.payload[row.offsets[i]:row.offsets[i + 1]]),
                                         f"<u{width}").astype("<u4").tobytes() for i in some]
                    names = [None if pd.isna(row.doc_ids[i]) else int(row.doc_ids[i]) for i in some]
                    yield pd.DataFrame({"doc_id": pd.array(names, "Int64"), "start": [starts[i] for i in some],
                                        "n_tokens": [len(x) // 4 for x in ids], "ids_crc32": [crc32(x) for x in ids]}
                                       | ({} if digest_only else {"ids": ids}))

    return wanted.mapInPandas(decoded, "doc_id long, start long, n_tokens long, ids_crc32 long"
                                       + ("" if digest_only else ", ids binary"))


def read_documents(spark: SparkSession, path: str, digest_only: bool = False) -> DataFrame:
    """Every document of a store: doc_id, start, n_tokens, ids_crc32 and, unless `digest_only`, ids (both
    over little-endian unsigned 32-bit integers)."""
    whole = _segments(spark, path).join(_parts(spark, path), "part")
    return _decode(spark, path, whole.withColumn("places", F.lit(None).cast("array<long>")), digest_only)


def read_some(wanted: DataFrame, path: str) -> DataFrame:
    """The documents whose ids are in `wanted` (doc_id), by way of the index: only their frames are read
    from the segments that hold them."""
    spark = wanted.sparkSession
    ids = wanted.select("doc_id").distinct()
    found = (read_index(spark, path).join(ids, "doc_id", "left_semi").groupBy("part", "seq")
             .agg(F.collect_list("place").alias("places")))
    segments = _segments(spark, path).join(_parts(spark, path), "part").join(found, ["part", "seq"])
    return _decode(spark, path, segments)


def store_folder(docs: DataFrame) -> str:
    return new_folder(docs.sparkSession, "token-store")
