"""Periodic runs of words, found by internal pattern matching.

A run is a maximal stretch of words with smallest period q that is at least `exponent` periods and at
least `shortest` words long. A run whose period lies in [b, 2b), b a power of two, holds a whole aligned
block of b words in its first words, and that block occurs again q words later. So every dyadic block
asks for its own occurrences that begin between b and 2b words after it:

* Substrings of length 2^k are named by prefix doubling, which ends in a suffix array; a block's
  occurrences are an interval of it. Only places whose `BASE` words occur again take part.
* The first places of an interval that are not before a given one are range successors, answered by a
  wavelet tree over the suffix array.
* Up to two occurrences give their distances as candidate periods. More of them form a progression whose
  difference d is the block's own period; then the stretches of period d around the block and around its
  occurrences end, or begin, exactly one period of the run apart, which leaves two candidates.
* Candidates are extended both ways by comparing hashes, and checked word by word.

Documents are handled in batches: words of different documents are different symbols, so no block has
occurrences outside its document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Blocks of 4 words also find the periods 1 to 3, as multiples between 4 and 7.
BASE = 4
BATCH_WORDS = 250_000
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
# Two primes below 2^31 and bases for the hashes that extend candidates.
PRIMES = ((2_147_483_647, 1_000_003), (2_147_483_629, 998_244_353))


class SameHash(ArithmeticError):
    """Two different stretches of words have the same hashes."""


class WaveletTree:
    """Range successors over a list of distinct numbers below `bound`, by bits from high to low."""

    def __init__(self, values: np.ndarray, bound: int):
        self.bits = max(1, int(bound).bit_length())
        self.ones, self.zeros = [], []
        for bit in range(self.bits - 1, -1, -1):
            high = ((values >> bit) & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(high, dtype=np.int32)]))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate([values[~high], values[high]])

    def _below(self, lo: np.ndarray, hi: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many numbers at places lo to hi are less than `limit`."""
        found = np.zeros(len(lo), np.int64)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            high = ((limit >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b = ones[lo], ones[hi]
            found += np.where(high, (hi - b) - (lo - a), 0)
            lo, hi = np.where(high, zeros + a, lo - a), np.where(high, zeros + b, hi - b)
        return found

    def _smallest(self, lo: np.ndarray, hi: np.ndarray, rank: np.ndarray) -> np.ndarray:
        value = np.zeros(len(lo), np.int64)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            a, b = ones[lo], ones[hi]
            low = (hi - b) - (lo - a)
            high = rank >= low
            rank = np.where(high, rank - low, rank)
            value += high.astype(np.int64) << (self.bits - 1 - level)
            lo, hi = np.where(high, zeros + a, lo - a), np.where(high, zeros + b, hi - b)
        return value

    def successor(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, none: int) -> np.ndarray:
        """The smallest number at places lo to hi that is at least `least`, else `none`."""
        rank = self._below(lo, hi, np.minimum(least, (1 << self.bits) - 1))
        found = np.full(len(lo), none, np.int64)
        some = np.flatnonzero((rank < hi - lo) & (least < 1 << self.bits))
        found[some] = self._smallest(lo[some], hi[some], rank[some])
        return found


class Extender:
    """How far two places of a sequence agree, forwards and backwards, for many pairs of places at once."""

    def __init__(self, symbols: np.ndarray, attempt: int = 0):
        self.n = len(symbols)
        self.hashes, self.powers = [], []
        for prime, base in PRIMES:
            powers, step = np.ones(1, np.uint64), (base + 7919 * attempt) % prime
            while len(powers) <= self.n:
                powers = np.concatenate([powers, powers * np.uint64(step) % np.uint64(prime)])
                step = step * step % prime
            terms = (symbols.astype(np.uint64) + np.uint64(1)) * powers[:self.n] % np.uint64(prime)
            self.hashes.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)]) % np.uint64(prime))
            self.powers.append(powers[:self.n + 1])

    def _same(self, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the `size` symbols from x on equal those from y on, y not before x."""
        same = np.ones(len(x), bool)
        for (prime, _), sums, powers in zip(PRIMES, self.hashes, self.powers):
            prime = np.uint64(prime)
            left = (sums[x + size] + prime - sums[x]) % prime * powers[y - x] % prime
            same &= left == (sums[y + size] + prime - sums[y]) % prime
        return same

    def _most(self, x: np.ndarray, y: np.ndarray, least: np.ndarray, most: np.ndarray, sign: int) -> np.ndarray:
        lo, hi = least, most
        while (open_ := lo < hi).any():
            middle = np.where(open_, (lo + hi + 1) // 2, lo)
            same = (self._same(x, y, middle) if sign > 0 else self._same(x - middle, y - middle, middle))
            lo, hi = np.where(open_ & same, middle, lo), np.where(open_ & ~same, middle - 1, hi)
        return lo

    def around(self, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The stretch [begin, end) of the given period around each place."""
        later = at + period
        forward = self._most(at, later, np.zeros_like(at), self.n - later, 1)
        back = self._most(at, later, np.zeros_like(at), at.copy(), -1)
        return at - back, later + forward


def _names(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(dense name, count of equal keys) of every key."""
    _, name, count = np.unique(keys, return_inverse=True, return_counts=True)
    return name, count[name]


def _repeated(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, name) where the next BASE symbols occur elsewhere too."""
    n = len(symbols)
    often = np.bincount(symbols)[symbols] > 1
    places = np.arange(n - BASE + 1)
    for i in range(BASE):
        places = places[often[places + i]]
    if not len(places):
        return places, places
    # Pairs are named where either half of such a place needs them.
    wanted = np.unique(np.concatenate([places, places + 2]))
    name, count = _names(symbols[wanted] * (int(symbols.max()) + 1) + symbols[wanted + 1])
    pair, many = np.zeros(n, np.int64), np.zeros(n, bool)
    pair[wanted], many[wanted] = name, count > 1
    places = places[many[places] & many[places + 2]]
    name, count = _names(pair[places] * n + pair[places + 2])
    return places[count > 1], name[count > 1]


def _blocks(symbols: np.ndarray) -> Iterator[tuple]:
    """First the suffix array of all places whose BASE symbols are repeated, then per length 2^k
    (length, places, lo, hi): every aligned block that is repeated, and its interval of the array."""
    n = len(symbols)
    places, name = _repeated(symbols)
    order = np.argsort(name, kind="stable")
    suffixes, sorted_name = places[order], name[order]
    m = len(suffixes)
    rank = np.arange(n + 1) + m             # single places keep a rank of their own
    size, levels = BASE, []
    first = np.concatenate([[True], sorted_name[1:] != sorted_name[:-1]]) if m else np.empty(0, bool)
    active = np.arange(m)                   # places of the array in groups that are not single
    while len(active):
        starts = np.flatnonzero(first)
        lo = active[starts][np.cumsum(first) - 1]
        counts = np.diff(np.append(starts, len(active)))[np.cumsum(first) - 1]
        at = suffixes[active]
        rank[at] = lo
        aligned = (at % size == 0) & (counts > 1)
        levels.append((size, at[aligned], lo[aligned], (lo + counts)[aligned]))
        many = counts > 1
        active, at, lo = active[many], at[many], lo[many]
        if not len(active):
            break
        key = lo * (m + n + 1) + rank[at + size]
        order = np.argsort(key, kind="stable")
        suffixes[active] = at[order]
        key = key[order]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        size *= 2
    yield suffixes
    yield from levels


def runs_of(symbols: np.ndarray, shortest: int, exponent: int) -> np.ndarray:
    """(begin, end, period) of every run of a sequence of non-negative numbers, by begin, then period."""
    for attempt in range(10):
        try:
            return _runs(symbols, shortest, exponent, attempt)
        except SameHash:        # other hashes tell the stretches apart
            continue
    raise SameHash


def _runs(symbols: np.ndarray, shortest: int, exponent: int, attempt: int) -> np.ndarray:
    none = np.empty((0, 3), np.int64)
    n = len(symbols)
    if n < shortest:
        return none
    levels = _blocks(symbols)
    suffixes = next(levels)
    if not len(suffixes):
        return none
    tree, extender, found = WaveletTree(suffixes, n), Extender(symbols, attempt), []
    for size, at, lo, hi in levels:
        hits = []
        for _ in range(3):
            least = hits[-1] + 1 if hits else at + size
            hit = tree.successor(lo, hi, least, n)
            hit[hit >= at + 2 * size] = n
            keep = hit < n if not hits else slice(None)
            at, lo, hi, hits = at[keep], lo[keep], hi[keep], [h[keep] for h in [*hits, hit]]
        if not len(at):
            continue
        one, two, three = hits
        pairs = [(at, one - at)] + [(at[two < n], (two - at)[two < n])]
        many = three < n
        if many.any():
            block, step = at[many], (two - one)[many]
            begin, end = extender.around(block, step)
            begin_next, end_next = extender.around(one[many], step)
            pairs += [(block, end_next - end), (block, begin_next - begin)]
        places, periods = (np.concatenate(x) for x in zip(*pairs))
        good = (periods >= size) & (periods < 2 * size) & (places + periods < n)
        begin, end = extender.around(places[good], periods[good])
        long = end - begin >= np.maximum(shortest if size == BASE else 0, exponent * periods[good])
        found.append(np.stack([begin, end, periods[good]], 1)[long])
    found = np.unique(np.concatenate(found or [none]), axis=0)
    # Of a stretch with several periods the smallest counts; the multiples came along.
    same = np.zeros(len(found), bool)
    same[1:] = (found[1:, :2] == found[:-1, :2]).all(1)
    found = found[~same]
    for i in np.flatnonzero(found[:, 2] < 2 * BASE):
        begin, end, period = found[i].tolist()
        for p in range(1, period):
            if period % p == 0 and (symbols[begin:begin + period - p] == symbols[begin + p:begin + period]).all() \
                    and (symbols[begin:end - p] == symbols[begin + p:end]).all():
                found[i, 2] = p
                break
    for begin, end, period in found.tolist():
        if not ((symbols[begin:end - period] == symbols[begin + period:end]).all()
                and (begin == 0 or symbols[begin - 1] != symbols[begin - 1 + period])
                and (end == n or symbols[end] != symbols[end - period])):
            raise SameHash
    found = found[found[:, 1] - found[:, 0] >= np.maximum(shortest, exponent * found[:, 2])]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _collapsed(words: list[bytes], runs: np.ndarray) -> str:
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    return b" ".join([words[i] for i in kept]).decode()


def _batched(texts: list[str | None], most: int) -> Iterator[tuple[list[list[bytes]], np.ndarray, np.ndarray]]:
    """(words of each text, symbols of all, where each text's symbols begin) for texts of about `most` words."""
    group, symbols, starts, base, held = [], [], [0], 0, 0
    for i, text in enumerate(texts):
        words = (text or "").encode().split()       # on bytes: the six ASCII white-space characters
        number = {word: base + k for k, word in enumerate(dict.fromkeys(words))}
        group.append(words)
        symbols.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        base, held = base + len(number), held + len(words)
        starts.append(held)
        if held >= most or i + 1 == len(texts):
            yield group, np.concatenate(symbols), np.array(starts)
            group, symbols, starts, base, held = [], [], [0], 0, 0


def periodic_runs(docs: DataFrame, shortest: int = 24, exponent: int = 3) -> DataFrame:
    """doc_id, n_words, runs and collapsed for every row of `docs` (doc_id integer, text).

    Words are what ASCII white space leaves; they are numbered from 0. runs lists (start, length, period)
    of every run of at least `shortest` (8 or more, at least 8 times `exponent`) words and `exponent` (3
    or more) periods, by start, then period. collapsed is the text without the words that a run holds
    after its first period, joined by one space. Null, empty and blank texts have no words, no runs and
    an empty collapsed text. Rows are treated one by one, so that null, repeated and clashing doc_ids
    and copies of texts need no care; further columns are ignored, and an empty table gives an empty result.
    Texts are treated whole, in a worker's memory of about 300 bytes a word of the longest text.
    """
    if exponent < 3 or shortest < 8 * exponent:
        raise ValueError("runs need at least 3 periods and 8 times as many words")

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names = pd.array([None if pd.isna(i) else int(i) for i in batch["doc_id"]], "Int64")
            at = 0
            for group, symbols, starts in _batched(batch["text"].tolist(), BATCH_WORDS):
                runs = runs_of(symbols, shortest, exponent)
                cuts = np.searchsorted(runs[:, 0], starts)
                rows = []
                for i, words in enumerate(group):
                    own = runs[cuts[i]:cuts[i + 1]] - [starts[i], starts[i], 0]
                    listed = [{"start": a, "length": e - a, "period": q} for a, e, q in own.tolist()]
                    rows.append((len(words), listed, _collapsed(words, own) if len(own) else b" ".join(words).decode()))
                out = pd.DataFrame(rows, columns=["n_words", "runs", "collapsed"])
                out.insert(0, "doc_id", names[at:at + len(group)])
                at += len(group)
                yield out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(found, f"doc_id long, n_words long, runs {RUNS}, collapsed string")
