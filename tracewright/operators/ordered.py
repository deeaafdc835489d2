"""Ordered scans inside groups: running and look-ahead values without oversized tasks.

Most operators of this library look at the rows before or after a row of the same group: the
next event of a case, messages still to be sent, participants active at a moment. `OrderedGroups`
states them once:

* ordinary groups become plain Spark windows, all on one exchange by the group keys. Look-ahead
  scans use the mirrored order with a frame that ends before the current row, because Spark
  recomputes frames that end at "unbounded following" for every row;
* oversized groups are range-partitioned on (keys, order), which also cuts through equal
  timestamps. The segments are scanned with the same windows, one small row per segment is carried
  across the segments, and both are combined. No task holds more than a segment.
"""

from __future__ import annotations

from collections.abc import Callable
from copy import copy
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.skew import Skew
from tracewright.session import materialize

SEGMENT = "_segment"


@dataclass(frozen=True)
class Scan:
    """An aggregate over the rows before, after or all around the current row."""

    how: str  # sum, min, max, nearest
    span: str  # before, after, all
    value: Column


def sum_before(value: Column) -> Scan:
    return Scan("sum", "before", value)


def sum_after(value: Column) -> Scan:
    return Scan("sum", "after", value)


def sum_all(value: Column) -> Scan:
    return Scan("sum", "all", value)


def min_before(value: Column) -> Scan:
    return Scan("min", "before", value)


def max_after(value: Column) -> Scan:
    return Scan("max", "after", value)


def min_all(value: Column) -> Scan:
    return Scan("min", "all", value)


def max_all(value: Column) -> Scan:
    return Scan("max", "all", value)


def previous(value: Column) -> Scan:
    """Nearest non-null value before the row."""
    return Scan("nearest", "before", value)


def following(value: Column) -> Scan:
    """Nearest non-null value after the row. Wrap in a struct to keep NULLs in view."""
    return Scan("nearest", "after", value)


_FOLD: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "min": F.min, "max": F.max}


class OrderedGroups:
    """Rows of a DataFrame, grouped by `keys` and ordered by `order` (ascending, NULLs last).

    `order` must identify a row inside its group. Oversized groups are looked for by the columns `by`
    (a part of the keys, all of them by default) in `sizes`, a frame that is cheaper to count than
    `df`; one of its rows, an event unless `of` says otherwise, stands for at most `fanout` rows of
    `df`.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], skew: Skew | None = None,
                 by: list[str] | None = None, sizes: DataFrame | None = None, fanout: int = 1,
                 of: str = "events"):
        self.keys, self.order = list(keys), list(order)
        by = list(by or keys)
        hot = skew.find(df if sizes is None else sizes, by, fanout, of) if skew else None
        self._plain, self._cut, self._scanned = df, None, False
        self._by, self._segments = by, hot.segments if hot else 0
        if hot is not None:
            # Both parts read the table, so that what led to it is not computed twice.
            self._plain, rows = hot.split(materialize(df, "rows"), by)
            self._cut = self._cut_up(rows)

    def _cut_up(self, rows: DataFrame) -> DataFrame:
        ranges = [F.col(c).asc_nulls_last() for c in self.keys + self.order]
        cut = rows.repartitionByRange(self._segments, *ranges)
        # The partition number is only stable once written.
        return materialize(cut.withColumn(SEGMENT, F.spark_partition_id()), "segments")

    def regroup(self, keys: list[str], order: list[str]) -> "OrderedGroups":
        """The same rows in other groups, which must lie inside the old ones' `by` columns.

        Ordinary groups stay on their exchange; only the rows of oversized groups are cut again.
        """
        if not set(self._by) <= set(keys):
            raise ValueError(f"keys must contain {self._by}")
        other = self._copy(self._plain, None, False)
        other.keys, other.order = list(keys), list(order)
        if self._cut is not None:
            other._cut = other._cut_up(self._cut.drop(SEGMENT))
        return other

    def _copy(self, plain: DataFrame, cut: DataFrame | None, scanned: bool) -> "OrderedGroups":
        other = copy(self)
        other._plain, other._cut, other._scanned = plain, cut, scanned
        return other

    def apply(self, change: Callable[[DataFrame], DataFrame]) -> "OrderedGroups":
        """Row-wise change of all rows, such as withColumns or filter."""
        cut = None if self._cut is None else change(self._cut)
        return self._copy(change(self._plain), cut, self._scanned)

    def with_columns(self, columns: dict[str, Column]) -> "OrderedGroups":
        return self.apply(lambda df: df.withColumns(columns))

    def scan(self, **scans: Scan) -> "OrderedGroups":
        """Add one column per scan."""
        local = {name: self._over(s, self.keys, self.order) for name, s in scans.items()}
        plain = self._plain.select("*", *[c.alias(n) for n, c in local.items()])
        return self._copy(plain, None if self._cut is None else self._scan_segments(scans), True)

    def df(self) -> DataFrame:
        if self._cut is None:
            return self._plain
        return self._plain.unionByName(self._cut.drop(SEGMENT))

    @staticmethod
    def _over(scan: Scan, keys: list[str], order: list[str]) -> Column:
        if scan.span == "all":
            return _FOLD[scan.how](scan.value).over(Window.partitionBy(*keys))
        if scan.span == "before":
            ordered = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])
        else:
            ordered = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_first() for c in order])
        ordered = ordered.rowsBetween(Window.unboundedPreceding, -1)
        if scan.how == "nearest":
            return F.last(scan.value, ignorenulls=True).over(ordered)
        return _FOLD[scan.how](scan.value).over(ordered)

    def _scan_segments(self, scans: dict[str, Scan]) -> DataFrame:
        # Segments are read twice, so an earlier scan is written down before the next one.
        cut = materialize(self._cut, "segments") if self._scanned else self._cut
        parts = self.keys + [SEGMENT]
        position = F.struct(*[x for c in self.order for x in (F.col(c).isNull(), F.col(c))])

        def summary(scan: Scan) -> Column:
            if scan.how != "nearest":
                return _FOLD[scan.how](scan.value)
            end = F.max_by if scan.span == "before" else F.min_by
            return end(scan.value, F.when(scan.value.isNotNull(), position))

        totals = cut.groupBy(*parts).agg(*[summary(s).alias(f"_t_{n}") for n, s in scans.items()])
        carried = totals.select(
            *[F.col(c).alias(f"_c_{c}") for c in parts],
            *[self._over(Scan(s.how, s.span, F.col(f"_t_{n}")), self.keys, [SEGMENT])
              .alias(f"_c_{n}") for n, s in scans.items()])
        same = F.lit(True)
        for c in parts:
            same = same & F.col(c).eqNullSafe(F.col(f"_c_{c}"))

        local = cut.select("*", *[self._over(s, parts, self.order).alias(n)
                                  for n, s in scans.items() if s.span != "all"])
        # One row per segment and group. Groups may be as many as rows, so nothing is promised about
        # the size: the join shuffles by group and segment unless Spark sees that one side is small.
        joined = local.join(carried, same)

        def combined(name: str, scan: Scan) -> Column:
            carry, own = F.col(f"_c_{name}"), F.col(name)
            if scan.span == "all":
                return carry
            if scan.how == "nearest":
                return F.coalesce(own, carry)
            if scan.how == "sum":
                return F.when(own.isNotNull() | carry.isNotNull(),
                              F.coalesce(own, F.lit(0)) + F.coalesce(carry, F.lit(0)))
            return (F.least if scan.how == "min" else F.greatest)(own, carry)

        return joined.select(*[F.col(c) for c in cut.columns],
                             *[combined(n, s).alias(n) for n, s in scans.items()])


def next_row(*columns: str) -> Scan:
    """The named columns of the row right after this one, as a struct (NULL on the last row)."""
    return following(F.struct(*columns))
