"""A z-fast trie of conversations: every shared beginning once.

Sequences of turns are held as a compacted trie: a node ends where sequences part or end, and its edge
spans the turns since the node above. A node is found by its handle, the hash of its first f turns, where f is
the 2-fattest depth of its edge: the one divisible by the highest power of two. A fat binary search
halves the depths at which a sequence may leave the trie by looking for handles, so that it takes a
number of joins in the logarithm of the length, whatever the height of the trie.

The trie is built in batches. In every batch all open sequences search the trie as it is. Those that end inside
it cut an edge; of those that leave it at one place with the same next turn one, by a hash of its id, becomes
a new leaf, and the others go on from there in the next batch. As in a random search tree, the
number of batches grows with the logarithm of the number of sequences, not with the length of what they share.

A beginning is known by the exclusive or of two 64-bit hashes over its turns and their places, so that
running windows over segments of a sequence give all of them and no sequence is held in one row or task.
Values of subtrees are summed by doubling: in round k every node hands its sum to the node 2^k above.
Then edges are expanded to one row per depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import keep

SEGMENT = 4096      # turns or cuts that one window scans in a row
STEPS = 3           # of a search, between two written tables
IDS = 50_000        # ids of a group of equal sequences that make one text
EMPTY = hashlib.sha256(b"").hexdigest()
EDGE = ["owner", "e"]


def running_before(df: DataFrame, keys: list[str], order: str,
                   values: dict[str, tuple[Callable, str, Callable]]) -> DataFrame:
    """`df` with, for every name in `values`, an aggregate over the rows of the same `keys` before a row.

    values: name -> (aggregate function, column, how a pair of results is combined). Groups are scanned in
    segments of SEGMENT values of `order` (distinct whole numbers from 0 in a group), then one row per segment.
    """
    segment, inside = [*keys, "_segment"], Window.unboundedPreceding
    rows = df.withColumn("_segment", F.expr(f"{order} div {SEGMENT}"))
    own = Window.partitionBy(*segment).orderBy(order).rowsBetween(inside, -1)
    totals = rows.groupBy(*segment).agg(*(fn(col).alias(f"_t_{name}") for name, (fn, col, _) in values.items()))
    over = Window.partitionBy(*keys).orderBy("_segment").rowsBetween(inside, -1)
    carry = totals.select(*(F.col(c).alias(f"_c_{c}") for c in segment),
                          *(fn(f"_t_{name}").over(over).alias(f"_o_{name}") for name, (fn, _, _) in values.items()))
    same = [F.col(c) == F.col(f"_c_{c}") for c in segment]
    for name, (fn, col, _) in values.items():
        rows = rows.withColumn(name, fn(col).over(own))
    rows = rows.join(carry, same)
    for name, (_, _, both) in values.items():
        rows = rows.withColumn(name, F.when(F.col(name).isNull(), F.col(f"_o_{name}")).when(
            F.col(f"_o_{name}").isNull(), F.col(name)).otherwise(both(F.col(name), F.col(f"_o_{name}"))))
    return rows.drop("_segment", *(f"_c_{c}" for c in segment), *(f"_o_{name}" for name in values))


def beginnings(turns: DataFrame) -> DataFrame:
    """conv_id, d, p1, p2, cum, bytes: the hashes and the size of the first d turns of every sequence.

    turns: conv_id, d (from 1, without gaps), a, b (two hashes of the turn's content), bytes.
    """
    mark = lambda seed: F.xxhash64(F.lit(seed), "d", "a", "b")
    xor, plus = lambda x, y: x.bitwiseXOR(y), lambda x, y: x + y
    rows = running_before(turns.withColumn("m1", mark(1)).withColumn("m2", mark(2)), ["conv_id"], "d", {
        "p1": (F.bit_xor, "m1", xor), "p2": (F.bit_xor, "m2", xor), "cum": (F.sum, "bytes", plus)})
    none = F.lit(0).cast("long")
    return rows.select("conv_id", "d", *(F.coalesce(f"p{i}", none).bitwiseXOR(F.col(f"m{i}")).alias(f"p{i}") for i in (1, 2)),
                       (F.coalesce("cum", none) + F.col("bytes")).alias("cum"), "bytes")


def _fattest(low: str, high: str) -> Column:
    """The number in (low, high] that is divisible by the highest power of two."""
    shift = f"(length(bin({low} ^ {high})) - 1)"
    return F.expr(f"shiftleft(shiftright({high}, {shift}), {shift})")


def _with_hash(rows: DataFrame, begin: DataFrame, who: str, depth: str, name: str) -> DataFrame:
    """`rows` with name1, name2: the hashes of the first `depth` turns of `who`; 0 at depth 0, else null."""
    known = begin.select(F.col("cls").alias("_c"), F.col("d").alias("_d"), F.col("p1").alias(f"{name}1"),
                         F.col("p2").alias(f"{name}2"))
    found = rows.join(known, (F.col(who) == F.col("_c")) & (F.col(depth) == F.col("_d")), "left").drop("_c", "_d")
    for i in (1, 2):
        found = found.withColumn(f"{name}{i}", F.when(F.col(depth) == 0, F.lit(0).cast("long")).otherwise(F.col(f"{name}{i}")))
    return found


def _equal(a: str, b: str) -> Column:
    return F.coalesce((F.col(f"{a}1") == F.col(f"{b}1")) & (F.col(f"{a}2") == F.col(f"{b}2")), F.lit(False))


def _hashed_nodes(edges: DataFrame, begin: DataFrame) -> DataFrame:
    """Nodes from (owner, e, pe): with the handle's depth f and the hashes of extent h, handle k, name n (the
    first turn of the edge) and parent u."""
    edges = edges.withColumn("f", _fattest("pe", "e"))
    depths = {"h": F.col("e"), "k": F.col("f"), "n": F.col("pe") + 1, "u": F.col("pe")}
    asked = edges.select("owner", "e", "pe", "f", F.explode(F.array(*(
        F.struct(F.lit(k).alias("what"), depth.alias("at")) for k, depth in depths.items()))).alias("q"))
    asked = _with_hash(asked.select("owner", "e", "pe", "f", "q.what", "q.at"), begin, "owner", "at", "q")
    return asked.groupBy("owner", "e", "pe", "f").agg(*(
        F.max(F.when(F.col("what") == k, F.col(f"q{i}"))).alias(f"{k}{i}") for k in depths for i in (1, 2)))


def _steps(state: DataFrame, step: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """`step` until no row of `state` has lo < hi."""
    while not state.filter("lo < hi").isEmpty():
        for _ in range(STEPS):
            state = step(state)
        state = keep(state, name)
    return state


def locate(open_: DataFrame, nodes: DataFrame, begin: DataFrame) -> DataFrame:
    """Where sequences leave the trie: cls, len, x (turns that they share with it) and, if that is inside an edge,
    the edge's owner, e and pe (else null).

    open_: cls, len, l (the depth of a node that they pass).
    """
    columns = ["owner", "e", "pe", "f", "h1", "h2"]
    node = nodes.select(*(F.col(c).alias(f"n_{c}") for c in columns), "k1", "k2")

    def probe(state: DataFrame) -> DataFrame:
        state = state.withColumn("at", F.when(F.col("lo") < F.col("hi"), _fattest("lo", "hi")))
        state = _with_hash(state, begin, "cls", "at", "q")
        state = state.join(node, (F.col("at") == F.col("n_f")) & (F.col("q1") == F.col("k1")) & (F.col("q2") == F.col("k2")), "left")
        hit = F.col("n_e").isNotNull()
        kept = [F.when(hit, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in columns]
        return state.select("cls", "len", "l", F.when(hit, F.col("n_e")).otherwise(F.col("lo")).alias("lo"),
                            F.when(F.col("at").isNotNull() & ~hit, F.col("at") - 1).otherwise(F.col("hi")).alias("hi"), *kept)

    none = [F.lit(None).cast("long").alias(c) for c in columns]
    state = _steps(open_.select("cls", "len", "l", F.col("l").alias("lo"), F.col("len").alias("hi"), *none), probe, "search")

    # The deepest node whose handle was met: either the sequence passes it, and leaves on the edge to a child or
    # at the node, or it leaves on the edge to that node.
    state = state.withColumn("base", F.coalesce("e", "l")).withColumn("check", F.least("base", "len"))
    state = _with_hash(state, begin, "cls", "check", "q")
    passed = F.col("e").isNull() | ((F.col("e") <= F.col("len")) & _equal("q", "h"))
    state = state.withColumn("passed", passed).withColumn("next", F.when(
        F.col("passed") & (F.col("base") < F.col("len")), F.col("base") + 1))
    state = _with_hash(state, begin, "cls", "next", "r")
    child = nodes.select(*(F.col(c).alias(f"c_{c}") for c in columns), (F.col("pe") + 1).alias("c_at"), "n1", "n2")
    state = state.join(child, (F.col("next") == F.col("c_at")) & (F.col("r1") == F.col("n1")) & (F.col("r2") == F.col("n2")), "left")
    below, leaves = F.col("passed") & F.col("c_e").isNotNull(), ~F.col("passed")
    edge = [F.when(leaves, F.col(c)).otherwise(F.col(f"c_{c}")).alias(c) for c in ("owner", "e", "pe")]
    low = F.when(leaves, F.col("f")).when(below, F.col("next")).otherwise(F.col("base"))
    high = (F.when(leaves, F.least(F.col("len"), F.col("e") - 1))
            .when(below, F.greatest(F.col("next"), F.least(F.col("len"), F.col("c_f") - 1))).otherwise(F.col("base")))
    state = keep(state.select("cls", "len", low.alias("lo"), high.alias("hi"), *edge), "exits")

    def halve(state: DataFrame) -> DataFrame:
        state = state.withColumn("at", F.when(F.col("lo") < F.col("hi"), F.expr("(lo + hi + 1) div 2")))
        state = _with_hash(_with_hash(state, begin, "cls", "at", "q"), begin, "owner", "at", "r")
        same, open_now = _equal("q", "r"), F.col("at").isNotNull()
        return state.select("cls", "len", F.when(open_now & same, F.col("at")).otherwise(F.col("lo")).alias("lo"),
                            F.when(open_now & ~same, F.col("at") - 1).otherwise(F.col("hi")).alias("hi"), "owner", "e", "pe")

    state = _steps(state, halve, "parting")
    inside = F.col("lo") < F.col("e")
    return state.select("cls", "len", F.col("lo").alias("x"), *(F.when(inside, F.col(c)).alias(c) for c in ("owner", "e", "pe")))


def compacted_trie(sequences: DataFrame, begin: DataFrame) -> DataFrame:
    """The nodes (without the root) of the compacted trie of `sequences` (cls, len > 0, all different).

    begin: cls, d, p1, p2 for d from 1 to len of each. Nodes: owner, a sequence that has the node on its way; e and
    pe, its own and its parent's depth; f and hashes as in `_hashed_nodes`.
    """
    spark = sequences.sparkSession
    nodes = None
    open_ = keep(sequences.select("cls", "len", F.lit(0).cast("long").alias("l")), "open")
    while not open_.isEmpty():
        if nodes is None:
            none = [F.lit(None).cast("long").alias(c) for c in ("owner", "e", "pe")]
            found = open_.select("cls", "len", F.col("l").alias("x"), *none)
        else:
            found = locate(open_, nodes, begin)
        going = F.when(F.col("x") < F.col("len"), F.col("x") + 1)
        found = keep(_with_hash(found.withColumn("next", going), begin, "cls", "next", "g"), "located")
        leaving = found.filter("next IS NOT NULL")
        first = keep(leaving.groupBy("next", "g1", "g2").agg(
            F.max_by("cls", F.struct(F.xxhash64(F.lit(7), "cls"), "cls")).alias("cls")).select("cls"), "leaves")
        leaves = leaving.join(first, "cls").select(F.col("cls").alias("owner"), F.col("len").alias("e"), F.col("x").alias("pe"))
        cuts = found.filter("e IS NOT NULL").select(*EDGE, "pe", "x").distinct()
        ends = cuts.select(*EDGE, "pe").distinct().select(*EDGE, "pe", F.col("e").alias("x"))
        pieces = running_before(cuts.union(ends), EDGE, "x", {"above": (F.max, "x", F.greatest)})
        pieces = keep(pieces.select("owner", F.col("e").alias("whole"), F.col("x").alias("e"),
                                    F.coalesce("above", "pe").alias("pe")), "pieces")
        grown = _hashed_nodes(pieces.select("owner", "e", "pe").union(leaves), begin)
        if nodes is not None:
            cut = pieces.select("owner", F.col("whole").alias("e")).distinct()
            grown = nodes.join(cut, EDGE, "left_anti").select(*grown.columns).union(grown)
        nodes = keep(grown, "nodes")
        open_ = keep(leaving.join(first, "cls", "left_anti").select("cls", "len", F.col("x").alias("l")), "open")
    if nodes is None:
        longs = ["owner", "e", "pe", "f", "h1", "h2", "k1", "k2", "n1", "n2", "u1", "u2"]
        return spark.createDataFrame([], ", ".join(f"{c} long" for c in longs))
    return nodes


def subtree_values(nodes: DataFrame, sums: list[str], least: str) -> DataFrame:
    """`nodes` (id, parent, values) with `sums` summed and `least` minimised over each node and all below it."""
    values = [*sums, least]
    now = keep(nodes.select("id", F.col("parent").alias("up"), *values), "subtree")
    while not now.filter("up IS NOT NULL").isEmpty():
        given = now.filter("up IS NOT NULL").groupBy(F.col("up").alias("_to")).agg(
            *(F.sum(c).alias(f"_{c}") for c in sums), F.min(least).alias(f"_{least}"))
        higher = now.select(F.col("id").alias("_of"), F.col("up").alias("_up"))
        zero = F.lit(0).cast("long")
        now = keep(now.join(given, F.col("id") == F.col("_to"), "left").join(higher, F.col("up") == F.col("_of"), "left").select(
            "id", F.col("_up").alias("up"), *((F.col(c) + F.coalesce(f"_{c}", zero)).alias(c) for c in sums),
            F.least(least, f"_{least}").alias(least)), "subtree")
    return nodes.drop(*values).join(now.drop("up"), "id")


def end_digests(members: DataFrame) -> DataFrame:
    """cls, ends_sha256: of the ascending decimal conv_ids of every class, joined by commas.

    Ids are sorted over all partitions and joined to texts of up to IDS ids; then a class's texts go through one
    hash after the other, without being held together.
    """
    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, cls = [], None
        for batch in batches:
            for own, conv_id in zip(batch["cls"].tolist(), batch["conv_id"].tolist()):
                if held and (own != cls or len(held) == IDS):
                    yield pd.DataFrame({"cls": [cls], "first": [held[0]], "ids": [",".join(map(str, held))]})
                    held = []
                cls = own
                held.append(conv_id)
        if held:
            yield pd.DataFrame({"cls": [cls], "first": [held[0]], "ids": [",".join(map(str, held))]})

    def digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest, cls = None, None
        for batch in batches:
            done = []
            for own, ids in zip(batch["cls"].tolist(), batch["ids"].tolist()):
                if digest is not None and own == cls:
                    digest.update(b",")
                else:
                    done += [] if digest is None else [(cls, digest.hexdigest())]
                    digest, cls = hashlib.sha256(), own
                digest.update(ids.encode())
            if done:
                yield pd.DataFrame(done, columns=["cls", "ends_sha256"])
        if digest is not None:
            yield pd.DataFrame([(cls, digest.hexdigest())], columns=["cls", "ends_sha256"])

    alone = members.filter("members = 1").select("cls", F.sha2(F.col("conv_id").cast("string"), 256).alias("ends_sha256"))
    texts = (members.filter("members > 1").select("cls", "conv_id").repartitionByRange("cls", "conv_id")
             .sortWithinPartitions("cls", "conv_id").mapInPandas(joined, "cls long, first long, ids string"))
    several = (texts.repartition("cls").sortWithinPartitions("cls", "first")
               .mapInPandas(digested, "cls long, ends_sha256 string"))
    return alone.union(several)


def expanded(edges: DataFrame) -> DataFrame:
    """`edges` once for every depth d from pe + 1 to e, by lists of at most length / SEGMENT numbers."""
    step = F.lit(SEGMENT).cast("long")
    return (edges.withColumn("_from", F.explode(F.sequence(F.col("pe") + 1, F.col("e"), step)))
            .withColumn("d", F.explode(F.sequence("_from", F.least(F.col("_from") + (SEGMENT - 1), F.col("e")))))
            .drop("_from"))


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per distinct sequence of first turns: conv_id (the smallest that begins with it), depth, parent_conv_id,
    n_convs, n_children, n_leaves (nodes without children at or below it), saved_tokens, n_ends, ends_sha256.

    turns: conv_id, d, a, b, bytes as for `beginnings`; conversations: conv_id (not null, each once), len, its number
    of turns, which may be 0. saved_tokens sums (n_convs - 1) * bytes of its last turn over a node and all below it;
    the conversations that end at a node give n_ends and ends_sha256. Equal sequences are inserted once. Without
    conversations there are no nodes, not even a root; empty turns count as any other turn.
    """
    begin = keep(beginnings(turns), "beginnings")
    last = begin.select(F.col("conv_id").alias("_conv"), F.col("d").alias("_d"), "p1", "p2", "cum")
    zero = F.lit(0).cast("long")
    whole = (conversations.select("conv_id", "len").join(last, (F.col("conv_id") == F.col("_conv")) & (F.col("len") == F.col("_d")), "left")
             .select("conv_id", "len", *(F.coalesce(c, zero).alias(c) for c in ("p1", "p2", "cum"))))
    whole = keep(whole, "whole-sequences")
    classes = keep(whole.groupBy("len", "p1", "p2", "cum").agg(F.min("conv_id").alias("cls"), F.count(F.lit(1)).alias("members")), "sequence-classes")
    members = whole.join(classes.select(F.col("len").alias("_l"), F.col("p1").alias("_1"), F.col("p2").alias("_2"), "cls", "members"),
                         (F.col("len") == F.col("_l")) & (F.col("p1") == F.col("_1")) & (F.col("p2") == F.col("_2")))
    digests = keep(end_digests(members.select("cls", "conv_id", "members")), "end-digests")
    stand = classes.select(F.col("cls").alias("_cls"))
    begin = keep(begin.join(stand, F.col("conv_id") == F.col("_cls"), "left_semi").withColumnRenamed("conv_id", "cls"), "class-beginnings")
    edges = compacted_trie(classes.filter("len > 0").select("cls", "len"), begin)

    root = classes.groupBy().agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(
        *(F.lit(v).cast("long").alias(c) for c, v in (("owner", None), ("e", 0), ("pe", None), ("h1", 0), ("h2", 0), ("u1", None), ("u2", None))))
    nodes = keep(edges.select(*root.columns).union(root).withColumn("id", F.monotonically_increasing_id()), "trie-nodes")
    above = nodes.select(F.col("id").alias("parent"), F.col("e").alias("_e"), F.col("h1").alias("_1"), F.col("h2").alias("_2"))
    nodes = nodes.join(above, (F.col("pe") == F.col("_e")) & (F.col("u1") == F.col("_1")) & (F.col("u2") == F.col("_2")), "left").drop("_e", "_1", "_2")
    size = lambda at, name: begin.select(F.col("cls").alias("_c"), F.col("d").alias("_d"), F.col("cum").alias(name))
    for at, name in (("e", "to_e"), ("pe", "to_pe")):
        nodes = nodes.join(size(at, name), (F.col("owner") == F.col("_c")) & (F.col(at) == F.col("_d")), "left").drop("_c", "_d")
    ending = classes.select("cls", "members", "cum", F.col("len").alias("_l"), F.col("p1").alias("_1"), F.col("p2").alias("_2"))
    nodes = nodes.join(ending, (F.col("e") == F.col("_l")) & (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2")), "left").drop("_l", "_1", "_2")
    nodes = keep(nodes.withColumn("to_e", F.coalesce("to_e", zero)).withColumn("to_pe", F.coalesce("to_pe", zero)), "linked-nodes")
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("_p")).agg(F.count(F.lit(1)).alias("children"))
    nodes = nodes.join(children, F.col("id") == F.col("_p"), "left").drop("_p").withColumn("children", F.coalesce("children", zero))
    own = {"n_convs": F.coalesce("members", zero), "walked": F.coalesce(F.col("members") * F.col("cum"), zero),
           "spanned": F.col("to_e") - F.col("to_pe"), "n_leaves": (F.col("children") == 0).cast("long"), "smallest": F.col("cls")}
    nodes = keep(nodes.select("*", *(v.alias(c) for c, v in own.items())), "valued-nodes")
    nodes = subtree_values(nodes, ["n_convs", "walked", "spanned", "n_leaves"], "smallest")
    nodes = keep(nodes.join(digests, "cls", "left"), "summed-nodes")

    up = nodes.select(F.col("id").alias("_id"), F.col("smallest").alias("above"))
    top = nodes.filter("owner IS NULL").withColumn("d", zero).withColumn("bytes", zero)
    deep = expanded(nodes.filter("owner IS NOT NULL"))
    here = begin.select(F.col("cls").alias("_c"), F.col("d").alias("_d"), F.col("cum").alias("to_d"), "bytes")
    deep = deep.join(here, (F.col("owner") == F.col("_c")) & (F.col("d") == F.col("_d"))).drop("_c", "_d")
    rows = deep.unionByName(top.withColumn("to_d", zero)).join(up, F.col("parent") == F.col("_id"), "left")
    is_end, before = F.col("d") == F.col("e"), F.col("to_d") - F.col("bytes")
    # All turns of its conversations from here on, less every distinct one of them once.
    saved = F.col("walked") - F.col("n_convs") * before - (F.col("spanned") - (before - F.col("to_pe")))
    return rows.select(
        F.col("smallest").alias("conv_id"), F.col("d").alias("depth"),
        F.when(F.col("d") > F.col("pe") + 1, F.col("smallest")).otherwise(F.col("above")).alias("parent_conv_id"), "n_convs",
        F.when(is_end, F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves",
        saved.alias("saved_tokens"), F.when(is_end, F.coalesce("members", zero)).otherwise(zero).alias("n_ends"),
        F.when(is_end, F.coalesce("ends_sha256", F.lit(EMPTY))).otherwise(F.lit(EMPTY)).alias("ends_sha256"))
