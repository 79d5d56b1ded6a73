"""The numbered queries: each operator with production parameters on its whole
table. Digest columns are derived from the operators' own output."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import articles, bagminhash, chat, decontaminate, language, merkle, packing, parsing, quality, ring, urls, variants
from . import materialise as mat
from .common import shared_folder, table

TOKENIZER = "byte_bpe_50k.json"


def op1_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated 100-byte strings."""
    return parsing.repeat_report(table(spark, sf_dir, "documents")).drop("spans")


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of them."""
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out)
    return language.identified(docs, ~F.col("held_out"), keep=["held_out"])


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token shards of all documents in training order, and where each stretch is."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "shards")
    return mat.materialise(docs, folder, public_tokenizers.path(TOKENIZER)).withColumnRenamed("key", "doc_id")


def op4_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op5_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures and verdict of every document."""
    return quality.quality_report(table(spark, sf_dir, "documents"), "doc_id")


URL_RULES = [*(urls.place_rule(*r) for r in urls.PLACE_RULES), *map(urls.pattern_rule, urls.PATTERNS)]


def op6_rare_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold, copied or edited."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL."""
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op8_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return articles.main_text(table(spark, sf_dir, "pages"))


def op9_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates of every document."""
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards whose counts are at most one apart."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = ring.shard_rows(rows, "doc_id", 16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "home",
    )


def op11_trie_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return variants.spelling_variants(variants.worn_vocabulary(table(spark, sf_dir, "documents")))


def op12_grammar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that quotes the marks, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role"))))
    odd = spark.range(1).select(F.lit(-7).alias("conv_id"), said.alias("t")).select("conv_id", "t.turn", "t.role", F.lit(chat.ODD).alias("text"))
    return chat.digests(chat.format_chats(rows.unionByName(odd)))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document, checked with some texts tampered with."""
    docs = merkle.tampered(table(spark, sf_dir, "documents"))
    proofs = merkle.manifest(docs, merkle.leaf(*[F.col(c) for c in merkle.FIELDS]), "lang", "doc_id", ["tampered"])
    found = merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof"))
    return proofs.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), found.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_prefix_free_parsing,
        op2_kneser_ney,
        op3_training_order,
        op4_bin_completion,
        op5_quality_cascade,
        op6_rare_seeds,
        op7_url_rules,
        op8_site_templates,
        op9_bagminhash,
        op10_ring,
        op11_trie_pairs,
        op12_grammar_round_trip,
        op13_merkle_manifest,
    )
}

ORACLES = {
    "op7_url_rules": urls.oracle(URL_RULES),
    "op11_trie_pairs": variants.ORACLE,
    "op12_grammar_round_trip": chat.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}
