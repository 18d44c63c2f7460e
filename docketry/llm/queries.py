"""The registered queries of the training-data operators: production parameters, whole tables, thin digests."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.bpe import encode_decode
from docketry.llm.common import read_table, scratch_root
from docketry.llm.embeddings import near_vectors
from docketry.llm.lines import repeated_lines
from docketry.llm.mixing import mixing_plan
from docketry.llm.oracles import EMBEDDINGS_SQL, quality_sql, substring_sql
from docketry.llm.pieces import encode_pieces
from docketry.llm.quality import score_quality
from docketry.llm.resampling import resample
from docketry.llm.resampling_sql import resampling_sql
from docketry.llm.sharding import shard_uniformly
from docketry.llm.simhash import simhash_components
from docketry.llm.substring import dedup_substrings
from docketry.llm.tokens import token_digest, write_tokens
from docketry.llm.toxicity import fit_toxicity, held_out, score_toxicity
from docketry.llm.whitening import whiten

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row; null and empty texts have no lines, and short lines match by equality alone."""
    docs = read_table(spark, sf_dir, "documents")
    found = repeated_lines(docs).withColumn("n_removed", F.size("removed").cast("long"))
    return found.select("doc_id", "n_lines", "n_removed", F.col("removed.line_no").alias("removed_lines"), "removed.of_doc", "removed.of_line")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row; null and empty texts have fingerprint zero, which links like any other."""
    found = simhash_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row; null and short texts lose nothing, the smallest doc_id keeps a passage."""
    kept = dedup_substrings(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row; null and empty texts have no words and fail."""
    scored = score_quality(read_table(spark, sf_dir, "documents"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return scored.select("doc_id", *names)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row, by law ``rows``; null texts have size 8; repeated ids are dealt apart."""
    docs = read_table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = shard_uniformly(sized, n_shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row; vectors that can't be compared link with nothing."""
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row, from the written files; null texts are empty and have the end id alone."""
    path = f"{scratch_root(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(read_table(spark, sf_dir, "documents"), TOKENIZER, path)
    return token_digest(spark, path)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row; null and empty texts have no ids."""
    return encode_decode(read_table(spark, sf_dir, "documents"), TOKENIZER, ("n_tokens", "ids_sha256", "decoded_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row; null and empty texts are scored by what the model says of no evidence, null ids aren't held out."""
    docs = read_table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, read_table(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= 0.3).cast("int").alias("predicted")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", predicted, "evidence")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row; null texts have size 0, null sources are a source of their own, the last."""
    plan = mixing_plan(read_table(spark, sf_dir, "documents"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return plan.select("doc_id", "size", "source_size", "target", taken, "source", "copies", "shards")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids with begin and end, decoded text, and the bytes that pieces' spans cover; null texts are empty."""
    docs = read_table(spark, sf_dir, "documents")
    return encode_pieces(docs, PIECES, ("n_tokens", "ids_sha256", "decoded_sha256", "covered", "spans_crc32"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four leading components; rows without a finite vector are left out, deviations beyond a long are null."""
    out = whiten(read_table(spark, sf_dir, "embeddings"), components=4)
    return out.withColumn("deviation", F.expr("try_cast(deviation as long)"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five in a hundred of the documents with twenty words, drawn towards the benchmark's texts."""
    drawn = resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), percent=5)
    return drawn.select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_sharding": op5_sharding,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_token_output": op7_token_output,
    "op8_bpe": op8_bpe,
    "op9_toxicity": op9_toxicity,
    "op10_mixing": op10_mixing,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_whitening": op12_whitening,
    "op13_resampling": op13_resampling,
}

ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": substring_sql(),
    "op4_quality_rules": quality_sql(),
    "op6_embedding_near_dedup": EMBEDDINGS_SQL,
    "op13_resampling": resampling_sql(),
}
