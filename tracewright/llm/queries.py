"""The registered queries of the operators: each applies one to its whole table and returns digests."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import (ann, chat, edits, linededup, mixing, neardup, oracles, packing, periodic,
                             prefixtrie, quality, rebuilt, sharding, simhash, tokenstore, vafile)
from tracewright.llm.common import WORD, keep

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; LLM_TOKENIZERS names a folder to use instead."""
    folder = os.environ.get("LLM_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Tools that the derived calls name; texts of the tables meet and break these rules.
TOOLS = {
    "search": {"type": "object", "required": ["query", "limit"], "additionalProperties": False,
               "properties": {"query": {"type": "string", "minLength": 60}, "turn": {"type": "integer"},
                              "limit": {"type": "integer", "minimum": 0, "maximum": 300}}},
    "quote": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string", "maxLength": 250}}},
}


def derived_calls(turns: DataFrame) -> DataFrame:
    """Every user turn as a call of one of three tools, one of them unknown. A call depends on the user
    turn before; in a tenth of the conversations on the one after, in another the first two on each other."""
    turn, kind = F.col("turn"), F.pmod("conv_id", F.lit(10))
    call = lambda t: F.concat(F.lit("call-"), t.cast("string"))
    need = (F.when(kind == 3, F.array(call(turn + 2)))
            .when((kind == 7) & (turn < 2), F.array(call(turn + 2)))
            .when(turn >= 2, F.array(call(turn - 2))).otherwise(F.array().cast("array<string>")))
    name = F.element_at(F.array(F.lit("search"), F.lit("quote"), F.lit("paint")),
                        (F.pmod(F.col("conv_id") + turn, F.lit(3)) + 1).cast("int"))
    arguments = F.to_json(F.struct(turn, F.col("text").alias("query"), F.char_length("text").alias("limit")))
    return (turns.filter("role = 'user'")
            .select("conv_id", turn.alias("position"), call(turn).alias("call_id"), name.alias("name"),
                    arguments.alias("arguments"), need.alias("depends_on")))


def derived_results(turns: DataFrame) -> DataFrame:
    """Every assistant turn as the result of the call before it."""
    call = F.concat(F.lit("call-"), (F.col("turn") - 1).cast("string"))
    return turns.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("position"),
                                                     call.alias("call_id"), F.col("text").alias("content"))


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    linked = chat.link_calls(derived_calls(turns), derived_results(turns), TOOLS)
    return linked.select("conv_id", "seq", "call_id", "name", "status", "call_position", "result_position",
                         "valid", F.size("errors").cast("long").alias("n_errors"),
                         F.sha2("message", 256).alias("message_sha256"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), words=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op4_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.search(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharding.assign_shards(docs, ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = tokenstore.store_folder(docs)
    tokenstore.write_store(docs, folder, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return tokenstore.read_documents(spark, folder, digest_only=True)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score_documents(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted")


def op9_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5)


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also n_near: how many other documents have a fingerprint within 3 bits."""
    places, texts = edits.with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
    prints = keep(simhash.fingerprints(texts, ["row_number", "kind", "text_sha256"]), "fingerprints")
    own = prints.filter("kind = 'own'").select(F.col("row_number").alias("_row"), "fingerprint")
    rows = keep(places.join(own, F.col("row_number") == F.col("_row")).drop("_row"), "own-fingerprints")
    after = F.pmod(F.col("row_number") - 1, F.lit(max(1, rows.count())))
    after = rows.select(after.alias("_row"), F.col("fingerprint").alias("next_fingerprint"))
    edited = prints.filter("kind <> 'own'").select(
        F.col("row_number").alias("_of"), "kind", F.col("text_sha256").alias("edited_sha256"),
        F.col("fingerprint").alias("edited_fingerprint"))
    near = keep(simhash.near_counts(rows.select("fingerprint", "copies")), "near-counts").select(
        F.col("fingerprint").alias("_print"), "n_near")
    among = F.col("kind") == "among"
    found = (rows.join(after, F.col("row_number") == F.col("_row")).join(edited, F.col("row_number") == F.col("_of"))
             .join(near, F.col("fingerprint") == F.col("_print"))
             .withColumn("times", F.when(among, F.col("copies") - 1).otherwise(F.lit(1)))
             .withColumn("next_fingerprint", F.when(among, F.col("fingerprint")).otherwise(F.col("next_fingerprint"))))
    return edits.repeat_rows(found, "times").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        simhash.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        simhash.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"), "n_near")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(*rebuilt.rebuilt_conversations(table(spark, sf_dir, "conversations"))).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id, text: a tenth of the documents, by the hash of their id, repeat a stretch of words up to their end."""
    hashed = F.crc32(F.col("doc_id").cast("string"))
    rest = F.expr("hashed div 10")
    words = F.when(F.col("hashed") % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})")))
    n = F.size("words").cast("long")
    period = (1 + F.floor((F.col("n") - F.col("a")) / (3 + rest % 8))).cast("long")
    index = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    repeated = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1),
                                        lambda i: F.get("words", index(i))), " ")
    return (docs.select("doc_id", "text", hashed.alias("hashed")).withColumn("words", words)
            .withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, rest % F.col("n"))).withColumn("p", period)
            .select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_periodic_tails(table(spark, sf_dir, "documents")))
    # Greatest length / period first, compared as whole numbers.
    first = lambda x, y: (F.when(x["length"] * y["period"] > y["length"] * x["period"], -1)
                          .when(x["length"] * y["period"] < y["length"] * x["period"], 1)
                          .when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1)
                          .otherwise(F.signum(x["period"] - y["period"]).cast("int")))
    line = lambda run: F.concat_ws(",", run["start"], run["length"], run["period"])
    lines = F.array_join(F.transform("runs", lambda run: F.concat(line(run), F.lit("\n"))), "")
    best = F.get(F.array_sort("runs", first), F.lit(0))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_tool_calls, op2_mix_sources, op3_near_duplicates, op4_va_file, op5_line_dedup, op6_feistel_shards, op7_token_store, op8_quality_classifier,
    op9_pack_sequences, op10_posting_lists, op11_simhash, op12_prefix_trie,
    op13_periodic_runs)}


def registered() -> dict[str, Query]:
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    return oracles.all_oracles()
