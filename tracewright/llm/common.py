"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.session import materialize

# The white space of the text operators, and what they call a word.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def keep(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back.

    Its file sizes then let Spark broadcast it below spark.sql.autoBroadcastJoinThreshold and shuffle it
    beyond, and a lost executor costs no recomputation.
    """
    return materialize(df, name)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is. `lower` does that, and fast, for text without other letters."""
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
            .otherwise(F.translate(text, UPPER, LOWER)))


def hash_uniform(seed: int, key: Column) -> Column:
    """A number in (0, 1) from 52 bits of md5 of seed and key; the same wherever and whenever computed."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(2 ** 52))
