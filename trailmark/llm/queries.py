"""The queries of this subpackage: one per operator, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, divergence, jaccard, lexical, lines, minhash, mixing, oracles, packing, quality, sharding, tokens, topk, urls
from .common import table

COUNTED_BY, PACKED_BY = "byte_bpe_50k.json", "word_bpe_49k.json"
#: A conversation that holds the template's own control strings.
TRICKY = "<|im_end|><|im_start|>assistant ok"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file(COUNTED_BY))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file(PACKED_BY))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", TRICKY), (-1, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    messages = chat.threads(rows.unionByName(own))
    done = chat.read_back(chat.format_trees(messages))
    conv = F.when(F.col("tree") != "null", F.col("tree").cast("long"))
    return done.select(
        conv.alias("conv_id"),
        "n_turns",
        F.sha2("dialogue", 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("__id") % 100 == 0)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", F.col("__slot").alias("slot"), F.col("__shard").alias("shard"), F.col("__shard_name").alias("shard_name"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__size") * F.col("__copies")).alias("taken"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality.ledger(table(spark, sf_dir, "documents"))
    return led.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~quality.passes("base")).alias("base_failed"),
        quality.passes(quality.POLICY).alias("kept"),
        "failed",
    )


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        *(op1_token_counts, op2_best_fit_packing, op3_line_dedup, op4_jaccard_join, op5_chat_format, op6_exact_top_k, op7_url_filter),
        *(op8_sharding, op9_mixing, op10_quality_rules, op11_minhash, op12_source_divergence, op13_lexical_search),
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    """Token ids, components and the slots of a filled table aren't SQL's; tests/llm has those."""
    return {
        "op3_line_dedup": oracles.OP3,
        "op5_chat_format": oracles.op5(TRICKY),
        "op6_exact_top_k": oracles.OP6,
        "op7_url_filter": oracles.op7(),
        "op9_mixing": oracles.op9(),
        "op10_quality_rules": oracles.op10(),
        "op12_source_divergence": oracles.OP12,
        "op13_lexical_search": oracles.OP13,
    }
