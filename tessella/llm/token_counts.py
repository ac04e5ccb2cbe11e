"""Operator 1: token counts by overlap resynchronisation.

Texts up to ``huge_chars`` code points are counted where they lie, group by group
with a memo whose counts are the library's. A longer one
is cut into overlapping chunks which are dealt over the cluster by a hash of
(text, chunk). Each chunk is encoded with offsets; neighbouring chunks are
spliced at a boundary where both encodings start a token at the same character
and that character follows white space. White space is never part of a token of
the vocabularies taken here, so such a boundary is proven stable: what stands on
its left can't change the tokens on its right, nor the other way round. Where
the overlap holds no such boundary, the text is cut again with an overlap four
times as wide, and so on until it aligns or is one chunk.

Defined results: a null text counts as empty (0 bytes, 0 tokens); equal rows are
counted separately; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import small_batches, written
from tessella.llm.pieces_memo import PieceMemo, load

#: White space before a boundary, from what every library treats as such.
_SPACE = " \n\t\r"


@lru_cache(maxsize=2)
def _memo(path: str) -> PieceMemo:
    return PieceMemo(path)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    return load(path)


def _count_direct(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            counts = list(memo.counts(texts))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]
            )

    return run


def _boundaries(text: str, offsets: list[tuple[int, int]], lo: int, hi: int, base: int) -> tuple[list[int], list[int]]:
    """Positions in [lo, hi) where a token starts after white space, and the tokens before each."""
    at, before = [], []
    for i, (start, _) in enumerate(offsets):
        if lo <= start < hi and start > 0 and text[start - 1] in _SPACE and text[start] not in _SPACE:
            at.append(base + start)
            before.append(i)
    return at, before


def _encode_chunks(path: str, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for b in batches:
            rows = b.to_pylist()
            out = []
            for r in rows:
                text, base = r["chunk"], r["start"]
                e = tokenizer.encode(text, add_special_tokens=False)
                left = _boundaries(text, e.offsets, 0, overlap, base)
                right = _boundaries(text, e.offsets, max(0, len(text) - overlap), len(text), base)
                out.append((r["key"], r["chunk_no"], len(e.ids), *left, *right))
            columns = list(zip(*out)) if out else [[]] * 7
            longs = pa.list_(pa.int64())
            types = [pa.string(), pa.int64(), pa.int64(), longs, longs, longs, longs]
            names = ["key", "chunk_no", "n", "left_at", "left_before", "right_at", "right_before"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return run


_CHUNKS = "key string, chunk_no bigint, n bigint, left_at array<bigint>, left_before array<bigint>, right_at array<bigint>, right_before array<bigint>"


def _splice(encoded: DataFrame) -> DataFrame:
    """Tokens of each text, null where some neighbouring chunks share no stable boundary."""
    order = Window.partitionBy("key").orderBy("chunk_no")
    shared = F.array_min(F.array_intersect("right_at", "next_at"))
    at = lambda values, keys: F.get(values, (F.array_position(keys, F.col("cut")) - 1).cast("int"))
    return (
        encoded.withColumns({"next_at": F.lead("left_at").over(order), "next_before": F.lead("left_before").over(order), "more": F.lead("chunk_no").over(order)})
        .withColumn("cut", shared)
        .withColumn(
            "kept",
            F.when(F.col("more").isNull(), F.col("n")).otherwise(at(F.col("right_before"), F.col("right_at")) - at(F.col("next_before"), F.col("next_at"))),
        )
        .groupBy("key")
        .agg(F.sum("kept").alias("total"), F.count_if(F.col("kept").isNull()).alias("open"))
        .select("key", F.when(F.col("open") == 0, F.col("total")).alias("n_tokens"))
    )


def count_huge(texts: DataFrame, path: str, chunk_chars: int, overlap_chars: int) -> DataFrame:
    """(key, n_tokens) for frames of (key, text); equal keys hold equal texts."""
    todo, done, chunk, overlap = texts, None, chunk_chars, overlap_chars
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        step = chunk - overlap
        length = F.char_length("text")
        last = F.greatest(F.lit(0), F.ceil((length - F.lit(overlap)) / F.lit(float(step))).cast("bigint") - 1)
        chunks = (
            todo.select("key", "text", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("chunk_no"))
            .select("key", "chunk_no", (F.col("chunk_no") * step).alias("start"), F.expr(f"substring(text, int(chunk_no * {step} + 1), {chunk})").alias("chunk"))
            .repartition(n, "key", "chunk_no")  # by number, so that chunks, small but costly, aren't put together
            .groupBy("key", "chunk_no", "start")
            .agg(F.first("chunk").alias("chunk"))
        )
        spliced = written(_splice(chunks.mapInArrow(_encode_chunks(path, overlap), _CHUNKS)), "splice")
        ready = spliced.filter(F.col("n_tokens").isNotNull())
        done = ready if done is None else done.unionByName(ready)
        failed = spliced.filter(F.col("n_tokens").isNull()).select("key")
        if failed.isEmpty():
            return done
        todo = texts.join(failed, "key", "left_semi")
        chunk, overlap = chunk * 4, overlap * 4


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = 2048,
    huge_chars: int = 32_768,
    chunk_chars: int = 16_384,
    overlap_chars: int = 512,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (doc_id, text)."""
    if not 0 < overlap_chars < chunk_chars:
        raise ValueError("the overlap has to be shorter than the chunk")
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    huge = F.char_length("text") > huge_chars
    key = F.concat_ws(":", F.md5("text"), F.col("n_bytes"))
    direct = rows.filter(~huge).mapInArrow(_count_direct(tokenizer_path), "doc_id bigint, n_bytes bigint, n_tokens bigint")
    long = rows.filter(huge).withColumn("key", key)
    counted = count_huge(long.select("key", "text"), tokenizer_path, chunk_chars, overlap_chars)
    spliced = long.select("doc_id", "n_bytes", "key").join(counted, "key").select("doc_id", "n_bytes", "n_tokens")
    return direct.unionByName(spliced).withColumn("over_limit", F.col("n_tokens") > limit)
