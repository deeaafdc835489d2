"""Line dedup: lines that many documents share stay in one of them.

Lines are exploded, normalised and hashed; documents are counted per hash. Only hashes, ids and
positions are shuffled for that. Each document then loses the lines at its listed positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tracewright.llm.common import WHITE, ascii_lower, keep


@F.pandas_udf(StringType())
def _without(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Texts without the lines at the given positions; null where there is nothing to drop."""
    def cut(text, positions):
        if text is None:
            return None
        gone = set(positions.tolist())
        return "\n".join([line for i, line in enumerate(text.split("\n")) if i not in gone])

    for texts, positions in batches:
        yield pd.Series([cut(t, p) for t, p in zip(texts, positions)], dtype=object)


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_keys(docs: DataFrame, least_chars: int) -> DataFrame:
    """doc_id, text_key, position, key for every line whose normalised form is long enough."""
    lines = docs.select("doc_id", _text_key(F.col("text")).alias("text_key"),
                        F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("position", "line"))
    stripped = lines.withColumn("line", F.btrim("line", F.lit(WHITE))).filter(F.char_length("line") >= least_chars)
    return stripped.select("doc_id", "text_key", "position", F.unhex(F.md5(ascii_lower(F.col("line")))).alias("key"))


def repeated_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """key, last: keys found in at least `least_docs` documents and the largest doc_id holding each.

    One row per (key, document) is made first, on both columns, so that a line of a third of all
    documents is summed up in parts before its count meets.
    """
    per_doc = line_keys(docs, least_chars).groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
    return (per_doc.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last"))
            .filter(F.col("docs") >= least_docs).select("key", "last"))


def dedup_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """`docs` with `text` less its repeated lines, and the columns n_lines and n_dropped.

    docs: doc_id, text and any others, which are kept. Lines end at \\n; null or empty texts are one
    empty line. A line's key is the line without white space at both ends and with A-Z in lower case;
    keys shorter than `least_chars` code points are never dropped. Keys in `least_docs` or more documents
    lose all their lines but those of the largest doc_id.

    Rows that share a doc_id, null included, count as one document and keep its lines alike; a null id
    is smaller than all others. Repeated rows are cleaned alike. Texts that lose all lines become empty, null texts stay null.
    An empty table gives an empty result. Columns named n_lines and n_dropped are replaced.
    """
    bad = keep(repeated_lines(docs, least_chars, least_docs).withColumnRenamed("key", "bad"), "line-keys")
    hits = line_keys(docs, least_chars)
    hits = hits.join(bad, hits["key"] == bad["bad"]).filter(~F.col("doc_id").eqNullSafe(F.col("last")))
    drops = (hits.groupBy(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"))
             .agg(F.collect_set("position").alias("_gone")))
    own = docs.drop("n_lines", "n_dropped").withColumn("_own_key", _text_key(F.col("text")))
    joined = own.join(drops.hint("shuffle_hash"), own["doc_id"].eqNullSafe(drops["_doc"])
                      & (own["_own_key"] == drops["_key"]), "left")
    lost = F.col("_gone").isNotNull()
    kept = F.when(lost, _without(F.when(lost, F.col("text")), F.col("_gone"))).otherwise(F.col("text"))
    return joined.select(*[kept.alias("text") if c == "text" else own[c] for c in own.columns if c != "_own_key"],
                         F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"),
                         F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"))
