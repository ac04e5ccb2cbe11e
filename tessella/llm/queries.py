"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import secrets
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import audio_match, byte_codec, conversation_repair, jaccard_join, line_dedup, quality_cascade, reshard, source_mix, spelling, sql, surrogates
from tessella.llm.common import table
from tessella.llm.piece_codec import encode_decode
from tessella.llm.sst_shards import tokens_to_shards
from tessella.llm.token_counts import count_tokens

WORD_VOCABULARY = "word_bpe_49k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"
BYTE_VOCABULARY = "byte_bpe_50k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY))


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled good weigh 2, all others 1."""
    labels = table(spark, sf_dir, "labels").filter("quality = 1 and doc_id is not null")
    return labels.select("doc_id", F.lit(2.0).alias("weight"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = source_mix.plan_mix(table(spark, sf_dir, "documents"), quality_weights(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op3_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old layout: 16 shards by source, so that their sizes differ widely; new: 24 of even bytes."""
    docs = table(spark, sf_dir, "documents")
    old = F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(16))
    rows = reshard.reshard(docs, old, 24)
    return rows.select(
        "doc_id",
        reshard.size_of(F.col("text")).alias("size"),
        reshard.crc_of(F.col("text")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade.annotate(table(spark, sf_dir, "documents")).drop("rejected_by")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(table(spark, sf_dir, "documents"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_VOCABULARY))


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_to_shards(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY))


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed by the session's setting; where there is none, by a random key, so that surrogates differ from run to run."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    key = spark.conf.get("spark.tessella.surrogates.secret", None) or secrets.token_hex(32)
    return surrogates.replace(docs, key, count="n_entities").select("doc_id", "n_entities", "text")


def op9_audio_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio: each embedding is turned into a recording of its components as notes."""
    return audio_match.search(audio_match.sung(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(table(spark, sf_dir, "conversations")), "copies")


def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(table(spark, sf_dir, "documents"), slips=97)


def op13_byte_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_codec.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_source_mix": op2_source_mix,
        "op3_reshard": op3_reshard,
        "op4_pieces": op4_pieces,
        "op5_quality_rules": op5_quality_rules,
        "op6_surrogates": op6_surrogates,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_token_shards": op8_token_shards,
        "op9_audio_match": op9_audio_match,
        "op10_line_dedup": op10_line_dedup,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_spelling_groups": op12_spelling_groups,
        "op13_byte_pieces": op13_byte_pieces,
    }


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
