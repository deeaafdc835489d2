"""Document fingerprints by SimHash, and all fingerprints within a Hamming radius.

Every term of a text, a few consecutive words, has a 64-bit hash and votes with its number of
occurrences: for a bit of the fingerprint where the bit of its hash is set, against it where it is not.
Alike texts get alike fingerprints: the share of equal bits estimates the angle between the texts.

A pair of fingerprints that differ in at most r of 64 bits agrees in at least b - r of b blocks of bits. So
there is one table for every choice of b - r blocks, in which the chosen blocks are moved to the front;
fingerprints that share that front in a table are compared in full.

All of it is DataFrame functions. The votes of two bits are summed in one number, 32 bits each, which no
text can overflow: a text of less than 2^31 bytes has fewer than 2^30 words.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import WHITE, ascii_lower, keep

BITS = 64
SPARE_BLOCKS = 3        # blocks that agree for certain, at the front of a table
CELL = 2048             # fingerprints of one front that meet in one group of a join
# What sets the two halves of a hash apart, and their odd multiplier below 2^27.
HALVES = (0x9E3779B9, 0x7F4A7C15)
MULTIPLY = 0x45D9F3B
MASK = 0xFFFFFFFF


def word_array(text: Column) -> Column:
    """The words of a text: what ASCII white space leaves. Empty for null and blank texts."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def term_hash(term: Column) -> Column:
    """64 bits from the checksum of a term, each half mixed twice; no product exceeds 2^59."""
    crc = F.crc32(term)

    def half(start: int) -> Column:
        x = crc.bitwiseXOR(F.lit(start))
        for _ in range(2):
            x = (x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(MULTIPLY)).bitwiseAND(F.lit(MASK))
        return x.bitwiseXOR(F.shiftright(x, 16))

    return F.shiftleft(half(HALVES[0]), 32).bitwiseOR(half(HALVES[1]))


def fingerprints(texts: DataFrame, keys: list[str], words: int = 2) -> DataFrame:
    """`keys`, n_terms and fingerprint (16 lowercase hex digits) for every distinct value of `keys`.

    texts: `keys` and text. Words are lower-cased (A-Z) and split at ASCII white space; terms are `words`
    consecutive words, the whole sequence if there are fewer. Null, empty and blank texts have no terms
    and the fingerprint 0. Null keys count as values; rows that share all keys vote together. Other columns
    are ignored. An empty table gives an empty result. Texts are treated whole; one text's words are held in
    one task's memory, only counters of votes leave it.
    """
    n = F.size("_words")
    starts = F.greatest(n - (words - 1), F.lit(1))
    slices = [F.slice("_words", i + 1, F.greatest(F.least(starts, n - i), F.lit(0))) for i in range(words)]
    split = texts.select(*keys, word_array(ascii_lower(F.col("text"))).alias("_words"))
    terms = split.select(*keys, F.explode_outer(F.arrays_zip(*(s.alias(f"w{i}") for i, s in enumerate(slices))))
                         .alias("_term"))
    hashed = terms.select(*keys, F.when(F.col("_term").isNotNull(), term_hash(
        F.concat_ws(" ", *(F.col(f"_term.w{i}") for i in range(words))))).alias("_hash"))
    pair = F.lit((1 << 32) | 1)
    votes = hashed.groupBy(*keys).agg(
        F.count("_hash").alias("n_terms"),
        *(F.sum(F.shiftrightunsigned("_hash", i).bitwiseAND(pair)).alias(f"_v{i}") for i in range(32)))
    bits = []
    for i in range(32):
        low = F.col(f"_v{i}").bitwiseAND(F.lit(MASK))
        high = F.shiftrightunsigned(f"_v{i}", 32)
        bits += [F.when(count * 2 > F.col("n_terms"), F.shiftleft(F.lit(1).cast("long"), place)).otherwise(F.lit(0).cast("long"))
                 for count, place in ((low, i), (high, 32 + i))]
    number = reduce(Column.bitwiseOR, bits)
    return votes.select(*keys, "n_terms", F.lpad(F.lower(F.hex(number)), 16, "0").alias("fingerprint"))


def bits_of(fingerprint: Column) -> Column:
    """The fingerprint as a number, from its hex digits (`conv` is unsigned, long is not)."""
    half = lambda start: F.conv(F.substring(fingerprint, start, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits of two fingerprints."""
    return 1 - F.bit_count(bits_of(a).bitwiseXOR(bits_of(b))) / F.lit(float(BITS))


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(lowest bit, number of bits) of radius + SPARE_BLOCKS blocks."""
    count = radius + SPARE_BLOCKS
    edges = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _part(bits: Column, block: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(bits, block[0]).bitwiseAND(F.lit((1 << block[1]) - 1))


def permuted_tables(classes: DataFrame, radius: int) -> DataFrame:
    """front, last and all columns of `classes` (bits long) once for every table: front is the table and its
    chosen blocks, last the highest of them."""
    blocks, entries = _blocks(radius), []
    for number, chosen in enumerate(combinations(range(len(blocks)), SPARE_BLOCKS)):
        front, shift = F.lit(number).cast("long"), 0
        for i in chosen:
            front = F.shiftleft(front, blocks[i][1]).bitwiseOR(_part(F.col("bits"), blocks[i]))
        entries.append(F.struct(front.alias("front"), F.lit(chosen[-1]).alias("last")))
    return classes.withColumn("_entry", F.explode(F.array(*entries))).select(
        "_entry.front", "_entry.last", *classes.columns)


def links_within(classes: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b, members_a, members_b): every pair of `classes` (bits long, distinct; members long) within `radius`
    bits, once, a < b.

    Fronts with more than CELL fingerprints are cut into cells: one side of the join is dealt over them, the
    other copied to each, so that no task holds more than CELL fingerprints of a front. A pair that shares
    several fronts comes from the first of them.
    """
    blocks = _blocks(radius)
    # A front has the number of its table and about half of all bits.
    most = max(sum(blocks[i][1] for i in chosen) for chosen in combinations(range(len(blocks)), SPARE_BLOCKS))
    if most + len(list(combinations(blocks, SPARE_BLOCKS))).bit_length() > 63:
        raise ValueError("the radius is too small for 64-bit fronts")
    rows = keep(permuted_tables(classes.select("bits", "members"), radius), "permuted-tables")
    shared = keep(rows.groupBy("front").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
                  .select(F.col("front").alias("_front"), F.expr(f"m div {CELL} + 1").alias("cells")), "shared-fronts")
    rows = rows.join(shared, F.col("front") == F.col("_front")).drop("_front")
    left = rows.select("front", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("cell"),
                       F.col("last"), F.col("bits").alias("a"), F.col("members").alias("members_a"))
    right = rows.select(F.col("front").alias("_front"), F.pmod(F.xxhash64("bits"), F.col("cells")).alias("_cell"),
                        F.col("bits").alias("b"), F.col("members").alias("members_b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    agreeing = sum(((F.lit(i) <= F.col("last")) & (_part(differ, block) == 0)).cast("int")
                   for i, block in enumerate(blocks))
    near = ((F.col("front") == F.col("_front")) & (F.col("cell") == F.col("_cell")) & (F.col("a") < F.col("b"))
            & (F.bit_count(differ) <= radius) & (agreeing == SPARE_BLOCKS))
    return left.join(right, near).select("a", "b", "members_a", "members_b")


def near_counts(prints: DataFrame, radius: int = 3) -> DataFrame:
    """fingerprint, members, n_near for every distinct fingerprint: how many rows have it, and how many other
    rows one such row has within `radius` bits.

    prints: fingerprint, and copies (long) where a row stands for several. Rows without a fingerprint take no
    part; other columns are ignored; an empty table gives an empty result. Links are summed as they are found.
    """
    copies = F.sum("copies") if "copies" in prints.columns else F.count(F.lit(1))
    classes = keep(prints.filter("fingerprint IS NOT NULL").groupBy("fingerprint").agg(copies.alias("members"))
                   .withColumn("bits", bits_of(F.col("fingerprint"))), "fingerprint-classes")
    links = links_within(classes, radius)
    both = links.select(F.explode(F.array(F.struct(F.col("a").alias("bits"), F.col("members_b").alias("n")),
                                          F.struct(F.col("b").alias("bits"), F.col("members_a").alias("n")))).alias("e"))
    near = both.groupBy(F.col("e.bits").alias("_bits")).agg(F.sum("e.n").alias("others"))
    return classes.join(near, F.col("bits") == F.col("_bits"), "left").select(
        "fingerprint", "members", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"))
