"""Operator 13: byte-level BPE encoding and decoding by per-prefix dynamic programming.

Whole texts are encoded in Arrow batches where they lie, without a shuffle (see
``prefix_bpe``); each distinct piece is encoded once while it stays in a memo
bounded in bytes, and one text per batch is compared with the library.

Defined results: a null text counts as empty (no ids, the hash of nothing); the
string of a special token is that token, as the library has it; repeated rows and
null identifiers keep their rows; extra columns are ignored; an empty table gives
an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm.common import small_batches, text_or_empty
from tessella.llm.prefix_bpe import PrefixBpe

_SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


@lru_cache(maxsize=2)
def _bpe(path: str) -> PrefixBpe:
    return PrefixBpe(path)


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for b in batches:
            counts, ids_hash, text_hash = [], [], []
            for ids in bpe.batch(b.column(1).to_pylist()):
                counts.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for b in batches:
            ids = list(bpe.batch(b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return run


def _texts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for b in batches:
            texts = [bpe.decode(i or b"").decode("utf-8") for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the ids of each text of docs (doc_id, text) as little-endian uint32 bytes."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_ids(path), "doc_id bigint, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    small_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(_texts(path), "doc_id bigint, text string")


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of ids and decoded text of every row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_digests(path), _SCHEMA)
