"""Conversations whose first turns are those of another conversation, as branches of a dialogue have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import keep
from tracewright.llm.sharding import number_rows
from tracewright.llm.simhash import bits_of

BRANCHES, MOST_SHARED = 5, 9


def numbered_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): conv_id, place (from 0, by turn, null first), a, b (two halves of the digest of role
    and text), bytes (UTF-8, of the text); and conv_id, n.

    Null roles and texts count as empty. Rows without a conv_id take no part. Turns of equal number are ordered
    by digest; repeated rows are turns of their own. Further columns are ignored.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = (turns.filter("conv_id IS NOT NULL")
            .select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                    digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")))
    rows = keep(number_rows(rows, ["conv_id", "turn", "digest"]), "numbered-turns")
    convs = keep(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("row_number").alias("first")), "conversations")
    place = F.col("row_number") - F.col("first")
    firsts = convs.select(F.col("conv_id").alias("_conv"), "first")
    rows = rows.join(firsts, F.col("conv_id") == F.col("_conv")).select(
        "conv_id", place.alias("place"), bits_of(F.col("digest")).alias("a"),
        bits_of(F.substring("digest", 17, 16)).alias("b"), "bytes")
    return rows, convs.select("conv_id", "n")


def rebuilt_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) for `prefixtrie.prefix_trie`: every conv_id c begins with the first h turns of the
    conversation c - c % 5 (all if it has fewer, none if there is no such) and goes on with its own turns after its
    first h, where h is the checksum of c in decimals % 9. Remainders are never negative."""
    rows, convs = numbered_turns(turns)
    rows = keep(rows, "placed-turns")
    h = F.crc32(F.col("conv_id").cast("string")) % MOST_SHARED
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(BRANCHES))
    convs = convs.withColumn("h", h).withColumn("base", base)
    sizes = convs.select(F.col("conv_id").alias("_base"), F.col("n").alias("base_n"))
    convs = keep(convs.join(sizes, F.col("base") == F.col("_base"), "left").select(
        "conv_id", "n", "h", "base", F.least("h", F.coalesce("base_n", F.lit(0).cast("long"))).alias("shared")), "rebuilt")
    heads = rows.filter(F.col("place") < MOST_SHARED - 1).withColumnRenamed("conv_id", "_conv")
    begun = convs.join(heads, (F.col("base") == F.col("_conv")) & (F.col("place") < F.col("h"))).select(
        "conv_id", (F.col("place") + 1).alias("d"), "a", "b", "bytes")
    own = convs.withColumnRenamed("conv_id", "_conv")
    rest = rows.join(own, (F.col("conv_id") == F.col("_conv")) & (F.col("place") >= F.col("h"))).select(
        "conv_id", (F.col("place") - F.col("h") + F.col("shared") + 1).alias("d"), "a", "b", "bytes")
    length = F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return begun.union(rest), convs.select("conv_id", length.cast("long").alias("len"))
