"""One query per text operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import chat, fingerprints, html_extract, licences, mixing, near_dup, packing, prefix_trie, quality_rules, sharding, spelling, token_files, url_filters
from kerbline.llm.common import literal_table, read
from kerbline.scratch import Scratch

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> str:
    """The byte-level vocabulary of 50,257 ids, as ranks: the ids of byte_bpe_50k.json."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return html_extract.extracted(read(spark, sf, "pages"))


def op2_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf, "documents"), width=3, percent=85)


def op3_sharding(spark: SparkSession, sf: str) -> DataFrame:
    folder = Scratch(spark, "slot-map").folder
    placed = sharding.shard_documents(read(spark, sf, "documents"), shards=24, map_folder=folder)
    return placed.withColumn("grown_shard", F.lit(None).cast("int"))


def op4_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.compared(read(spark, sf, "documents"))


def op5_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filters.judge(read(spark, sf, "pages"), url_filters.rule_table(spark, url_filters.RULES))


def op6_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(read(spark, sf, "documents"), vocabulary())


def op7_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    marked = "</s>[INST] ok [/INST]"
    rows = rows.union(literal_table(spark, [(-1, 0, "user", marked), (-1, 1, "assistant", marked)], "conv_id long, turn long, role string, text string"))
    chats = chat.formatted(rows.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    both = chats.select("conv_id", "formatted", chat.turns_of(F.col("formatted")).alias("turns"), chat.loss_of(F.col("formatted"), F.col("loss")).alias("loss_text"))
    return both.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_licence_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licences.scan(read(spark, sf, "documents"), licences.known_table(spark))


def op9_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    j = quality_rules.judged(read(spark, sf, "documents"))
    return j.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.taken_words(read(spark, sf, "documents"))


def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(read(spark, sf, "documents"))


def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    scratch = Scratch(spark, "trie")
    return prefix_trie.trie(*prefix_trie.rebuilt(read(spark, sf, "conversations"), scratch), scratch)


def word_model() -> str:
    """The word-piece model of 49,408 ids as text, so that it travels with the tasks."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        return f.read()


def op13_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return token_files.write(read(spark, sf, "documents"), word_model(), Scratch(spark, "token-files")).documents()


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


def queries() -> dict[str, Query]:
    every = (op1_html_extraction, op2_near_duplicates, op3_sharding, op4_fingerprints, op5_url_filter, op6_packing, op7_chat_format, op8_licence_scan, op9_quality_rules, op10_mixing, op11_spelling_variants, op12_prefix_trie, op13_token_files, pipeline)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    from kerbline.llm import sql

    return sql.all_sql()
