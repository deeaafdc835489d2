"""Texts whose last part gives way to the beginning of the text after them, in the order of documents.

Only ids, sizes and digests are numbered; texts are shuffled once, by the digest of their row, and the
beginnings of texts a second time, to the rows before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import keep
from tracewright.llm.sharding import number_rows

STEP = 4096


def repeat_rows(df: DataFrame, times: str) -> DataFrame:
    """`df` with every row as often as its column `times` says, by lists of at most times / STEP numbers."""
    first = F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(STEP).cast("long"))
    rest = F.sequence(F.lit(1), F.least(F.col(times) - F.col("_from"), F.lit(STEP)).cast("int"))
    return (df.filter(F.col(times) > 0).withColumn("_from", F.explode(first)).withColumn("_one", F.explode(rest))
            .drop("_from", "_one"))


def _key(docs: DataFrame) -> Column:
    """The same 16 bytes for rows with equal doc_id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text"))))


def with_edits(docs: DataFrame, share: int = 4) -> tuple[DataFrame, DataFrame]:
    """(places, texts): the rows of `docs` in order, and their whole and edited texts.

    places: row_number, doc_id, n_chars, copies; one row for all rows with equal doc_id and text, numbered
    by ascending doc_id, null first. texts: row_number, kind, text_sha256, text, where kind is `own`, `edited`
    or, where a row has copies, `among`: of all its copies but the last, the row after is a copy too. The
    edited text has its last floor(n_chars / share) code points replaced by the first as many (or all) of the
    next document, the first document coming after the last. Null texts count as empty.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("row_key", _key(rows))
    groups = (rows.groupBy("doc_id", "row_key").agg(F.first(F.char_length("text").cast("long")).alias("n_chars"),
                                                    F.count(F.lit(1)).alias("copies")))
    places = keep(number_rows(groups, ["doc_id", "row_key"]), "places")
    total = places.count()
    after = places.select(F.pmod(F.col("row_number") - 1, F.lit(max(total, 1))).alias("_row"), F.col("row_key").alias("next_key"))
    gone = F.expr(f"n_chars div {share}")
    takes = places.join(after, F.col("row_number") == F.col("_row"))
    kinds = F.array(F.struct(F.lit("edited").alias("kind"), F.col("next_key").alias("of")),
                    F.when(F.col("copies") > 1, F.struct(F.lit("among").alias("kind"), F.col("row_key").alias("of"))))
    takes = keep(takes.select(F.col("row_key").alias("to_key"), gone.alias("n"), F.explode(kinds).alias("e"))
                 .filter("e IS NOT NULL").select("to_key", "n", "e.kind", "e.of"), "takes")

    texts = rows.select("row_key", "text")
    if not places.filter("copies > 1").isEmpty():
        texts = texts.dropDuplicates(["row_key"])
    heads = (texts.join(takes, F.col("row_key") == F.col("of"))
             .select("to_key", "kind", F.substring(F.col("text"), F.lit(1), F.col("n").cast("int")).alias("head")))
    numbers = places.select(F.col("row_key").alias("_key"), "row_number", "n_chars")
    whole = texts.join(numbers, F.col("row_key") == F.col("_key")).join(heads, F.col("row_key") == F.col("to_key"))
    kept = F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - gone).cast("int"))
    edited = whole.select("row_number", "kind", "text", F.concat(kept, "head").alias("edited"))
    row = lambda kind, text, sha: F.struct(kind.alias("kind"), text.alias("text"), sha.alias("text_sha256"))
    own = F.when(F.col("kind") == "edited", row(F.lit("own"), F.col("text"), F.lit(None).cast("string")))
    both = F.array(own, row(F.col("kind"), F.col("edited"), F.sha2("edited", 256)))
    return places, edited.select("row_number", F.explode(both).alias("e")).filter("e IS NOT NULL").select(
        "row_number", "e.kind", "e.text_sha256", "e.text")
