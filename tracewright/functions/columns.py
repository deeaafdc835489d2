"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(value: Column) -> Column:
    """Strip Unicode whitespace; blank becomes NULL (Spark's trim only strips spaces)."""
    return F.nullif(F.regexp_replace(value.cast("string"), r"(?U)^\s+|\s+$", ""), F.lit(""))


def or_else(value: Column, fallback: Column) -> Column:
    """`value` unless it is NULL or the empty string."""
    return F.coalesce(F.nullif(value, F.lit("")), fallback)


def parse_time(text: Column) -> Column:
    """ISO-8601 text, `Z` or an offset included, as a timestamp; unreadable text becomes NULL."""
    return F.try_to_timestamp(text)


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from `start` to `end`, exact to the microsecond."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def without_keys(attributes: Column | str, *names: str) -> Column:
    """A map without some keys, before entries of these names are added."""
    return F.map_filter(attributes, lambda k, _: ~k.isin(*names))


def last_wins(pairs: Column, key: str) -> Column:
    """Entries whose key does not come again later in the array."""
    return F.filter(pairs, lambda pair, i: ~F.exists(
        F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda later: later[key] == pair[key]))


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def minted(prefix: str, *parts: Column) -> Column:
    """`prefix::part::part`; NULL as soon as one part is NULL."""
    pieces: list[Column] = [F.lit(prefix)]
    for part in parts:
        pieces += [F.lit("::"), part.cast("string")]
    return F.concat(*pieces)


def instance_id(case: Column) -> Column:
    return minted("ci", case)


def participant_id(participant: Column) -> Column:
    return minted("part", participant)


def local_case_id(case: Column, participant: Column) -> Column:
    return minted("lc", case, participant)


def event_id(case: Column, index: Column) -> Column:
    return minted("e", case, index)


def message_id(send_event: Column) -> Column:
    return minted("msg", send_event)


def no_nulls(attributes: Column) -> Column:
    """Map without its NULL values."""
    return F.map_filter(attributes, lambda _, value: value.isNotNull())


def columns_to_map(names: list[str]) -> Column:
    """Non-null values of the named columns, as text, by column name."""
    if not names:
        return F.expr("cast(map() as map<string,string>)")
    pairs = [item for name in names for item in (F.lit(name), attribute_text(name))]
    return no_nulls(F.create_map(*pairs))


def attribute_text(name: str) -> Column:
    return F.col(f"`{name}`").cast("string")
