"""Finding groups too large for one task.

One case, participant, object or log may hold a large part of all rows. A window over such a
group would run in a single task, so `OrderedGroups` cuts it into segments. This module decides
which groups need that.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.session import materialize


@dataclass(frozen=True)
class HotGroups:
    """Keys of oversized groups, how many rows they have, and how many a segment should have."""

    keys: DataFrame
    rows: int
    segment_rows: int

    @property
    def segments(self) -> int:
        return self.rows // self.segment_rows + 1

    def split(self, df: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
        """(other rows, rows of the oversized groups).

        The broadcast is bounded: each key stands for more than `limit` rows and `limit` grows
        with the data, so there are never more keys than `Skew.most_segments`.
        """
        keys = F.broadcast(self.keys.select(*[F.col(n).alias(f"_hot_{n}") for n in names]))
        same = F.lit(True)
        for n in names:
            same = same & F.col(n).eqNullSafe(F.col(f"_hot_{n}"))
        return df.join(keys, same, "left_anti"), df.join(keys, same, "left_semi")


@dataclass(frozen=True)
class Skew:
    """How many rows of one group a task may hold, and how large the source is.

    One instance belongs to one source. Groups are looked up once per set of key columns and kind of
    row, so frames derived from the source must name equal things equally.
    """

    rows: int
    limit: int = 2_000_000
    most_segments: int = 50_000
    enough_segments: int = 500
    _found: dict[tuple[str, ...], HotGroups | None] = field(default_factory=dict, compare=False)

    @classmethod
    def of(cls, source: DataFrame, limit: int = 2_000_000) -> "Skew":
        """Count the source once; for file sources Spark answers from the footers."""
        return cls(rows=source.count(), limit=limit)

    def find(self, df: DataFrame, keys: list[str], fanout: int = 1, of: str = "events"
             ) -> HotGroups | None:
        """Groups of `df`, which holds one row per `of`, by `keys` above the limit, or None.

        `fanout` bounds how many rows of the frame to be scanned one row of `df` stands for. A source
        no larger than the limit cannot have such a group and costs no job.
        """
        if self.rows * fanout <= self.limit:
            return None
        if (of, *keys) not in self._found:
            self._found[of, *keys] = self._look_up(df, keys, fanout)
        return self._found[of, *keys]

    def _look_up(self, df: DataFrame, keys: list[str], fanout: int) -> HotGroups | None:
        limit = max(self.limit, self.rows * fanout // self.most_segments)
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        hot = materialize(sizes.filter(F.col("_rows") * fanout > limit), "hot-groups")
        found = hot.agg(F.count(F.lit(1)).alias("groups"), F.sum("_rows").alias("total")).first()
        if found["groups"] == 0:
            return None
        # A lower limit finds more groups, but segments only get smaller than usual while they are few:
        # every segment is a task, and has its bounds sampled on the driver.
        rows = found["total"] * fanout
        return HotGroups(hot.drop("_rows"), rows, max(limit, min(Skew.limit, rows // self.enough_segments)))
