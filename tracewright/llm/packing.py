"""Best-fit packing of tokenised documents into sequences, with matching of large items.

Only a document longer than a sequence is cut: into full pieces, after a first piece with the rest.
Pieces of equal length are interchangeable, so the packing is planned on the histogram of lengths, at
most `capacity` numbers whatever the data: items above a third of the capacity, of which at most two
share a sequence, are matched greedily, each largest with the largest that still fits; the others go,
largest first, where the least room is left over. The plan says which ranks of a length go to which
sequences and offsets; pieces then look up their place by (length, rank).
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import keep
from tracewright.llm.tokens import MOST_PIECES, Encoder, share_tokenizer

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"
PLACE_BITS = 44


@dataclass
class Plan:
    """Where the ranks of every length go. Entries are (length, first rank, sequence, copies, offset):
    `copies` pieces side by side from `offset` on in each sequence from `sequence` on."""

    capacity: int
    sequences: int = 0
    entries: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    used: dict[int, int] = field(default_factory=dict)

    def place(self, length: int, sequence: int, bins: int, copies: int, offset: int) -> None:
        rank = self.used.get(length, 0)
        self.entries.append((length, rank, sequence, copies, offset))
        self.used[length] = rank + bins * copies

    def open(self, bins: int) -> int:
        self.sequences += bins
        return self.sequences - bins


def plan_packing(counts: dict[int, int], capacity: int) -> Plan:
    """Pack `counts` items of each length (1 to capacity). Work and size depend on the lengths only."""
    plan, left = Plan(capacity), {n: c for n, c in counts.items() if c}
    room: list[tuple[int, int, int]] = []           # (gap, first sequence, sequences), sorted

    def leave(gap: int, sequence: int, bins: int) -> None:
        if gap and bins:
            insort(room, (gap, sequence, bins))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        first = large[-1]
        partner = bisect_left(large, capacity - first + 1) - 1
        second = large[partner] if partner >= 0 else None
        if second is None or (second == first and left[first] == 1):
            # Nothing fits beside it, or only itself and it is the last: look for a smaller one.
            second = large[partner - 1] if second == first and partner > 0 else None
        if second is None:
            bins = left.pop(first)
            at = plan.open(bins)
            plan.place(first, at, bins, 1, 0)
            leave(capacity - first, at, bins)
        elif second == first:
            bins = left[first] // 2
            at = plan.open(bins)
            plan.place(first, at, bins, 2, 0)
            leave(capacity - 2 * first, at, bins)
            left[first] -= 2 * bins
        else:
            bins = min(left[first], left[second])
            at = plan.open(bins)
            plan.place(first, at, bins, 1, 0)
            plan.place(second, at, bins, 1, first)
            leave(capacity - first - second, at, bins)
            left[first] -= bins
            left[second] -= bins
        large = [n for n in large if left.get(n)]

    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        count = left[length]
        while count:
            spot = bisect_left(room, (length, -1, -1))
            if spot < len(room):
                gap, at, bins = room.pop(spot)
            else:
                gap, bins = capacity, -(-count // (capacity // length))
                at = plan.open(bins)
            copies = gap // length
            full = min(bins, count // copies)
            if full:
                plan.place(length, at, full, copies, capacity - gap)
                leave(gap - copies * length, at, full)
                count -= full * copies
            if full < bins and 0 < count < copies:
                plan.place(length, at + full, 1, count, capacity - gap)
                leave(gap - count * length, at + full, 1)
                count, full = 0, full + 1
            leave(gap, at + full, bins - full)
    return plan


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, remember: int) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32; `part` and `nth` number the
    pieces of a length within a task, which is sound once the result is written."""
    spec = share_tokenizer(docs.sparkSession, tokenizer)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seen = TaskContext.get().partitionId(), {}
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            names = [None if pd.isna(i) else int(i) for i in batch["doc_id"]]
            rows, place = [], 0
            for group in Encoder.of(spec.value).batches(batch["text"].tolist(), remember=remember):
                for ids in group:
                    ids += end
                    total = len(ids) // 4
                    starts = [0, *range(total % capacity or capacity, total, capacity)]
                    for piece, (a, b) in enumerate(zip(starts, [*starts[1:], total])):
                        nth = seen[b - a] = seen.get(b - a, -1) + 1
                        rows.append((names[place], piece, a, b - a, crc32(ids[4 * a:4 * b]), part, nth))
                    place += 1
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")]).astype({"doc_id": "Int64"})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(cut, PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024,
                   remember: int = MOST_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    docs: doc_id (integer), text; further columns are ignored. Null texts count as empty: one piece with
    the end id alone. Repeated rows are packed as often as they come; a null doc_id stays null. An empty
    table gives an empty result. `remember` bounds the word pieces a worker process keeps: fewer take
    less memory and more time.
    """
    pieces = keep(cut_pieces(docs, tokenizer, end_id, capacity, remember), "pieces")
    counts = keep(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    # At most `capacity` rows come to the driver.
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_packing(totals, capacity)
    entries = np.array(sorted(plan.entries) or [(0, 0, 0, 1, 0)], dtype=np.int64)
    keys = (entries[:, 0] << PLACE_BITS) + entries[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def look_up(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(), rank.to_numpy()
        found = entries[np.searchsorted(keys, (length << PLACE_BITS) + rank, "right") - 1]
        past = rank - found[:, 1]
        return pd.DataFrame({"sequence_id": found[:, 2] + past // found[:, 3],
                             "offset": found[:, 4] + past % found[:, 3] * length})

    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    before = keep(counts.select(F.col("part").alias("_part"), F.col("length").alias("_length"),
                                earlier.alias("_before")), "piece-ranks")
    ranked = pieces.join(before, (F.col("part") == F.col("_part")) & (F.col("length") == F.col("_length")))
    placed = ranked.withColumn("at", look_up("length", F.col("_before") + F.col("nth")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
