"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: all but the last
return documents (all columns of the table), the last one ids and digests.

Whatever the stage: a null identifier keeps its row and comes last where order counts, rows
equal in all columns are documents of their own unless the stage removes copies, extra
columns pass through whatever their names, texts are taken whole, and an empty table gives an
empty one. Each stage's docstring says what it makes of null and empty texts and of ties.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import jaccard_join, line_dedup, piece_codec, quality_cascade, queries, source_mix
from tessella.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the cascade. A null or empty text has no words and goes; repeated rows share one verdict."""
    return quality_cascade.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat earlier ones; n_chars follows the text.

    A null text stays, with a null n_chars; a text without words stays as it is; one that loses
    all its lines with words goes. Earlier is by identifier, a hash of the text, line; rows equal in
    identifier and text count as one document and get the same result.
    """
    rows = line_dedup.dedup(docs)
    return rows.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near copies: of least identifier, then of least hash; of rows equal in both, one.

    Null texts and texts without words are in no class and all stay.
    """
    return jaccard_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, quality labels read from the table ``labels``.

    A null or empty text has no words, fills nothing and comes only with complete epochs; a null
    source is a source of its own. Keys tie only for equal rows, which share their copies evenly.
    """
    return source_mix.draw(docs, source_mix.plan_mix(docs, queries.quality_weights(spark, sf_dir)))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, counts and digests of ids and decoded text; a null text counts as empty, and every row has one of its own."""
    return piece_codec.encode_decode(docs, public_tokenizers.path(queries.PIECE_VOCABULARY))


STAGES = [
    ("quality_rules", quality_rules),
    ("dedup_lines", dedup_lines),
    ("one_of_near_copies", one_of_near_copies),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]

#: SQL can't encode with the vocabulary; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
