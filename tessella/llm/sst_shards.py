"""Operator 8: documents as token ids in sorted-string-table shards.

The rows are range-partitioned by identifier (with a hash of the text and a number
per row behind it, so that one identifier, or one row repeated, on a third of the
table still splits), and each partition is sorted. Its task encodes it and writes
files of at most about ``file_bytes`` and ``file_rows``: each under a temporary
name, then moved, so that a repeated task leaves the same files. The files lie in
the folder that all executors share. They are read back by ranges: a task fetches
the footer, the index and its run of blocks, and hands on one block at a time.

Defined results: a null text has only the end id; a null identifier sorts first;
repeated identifiers keep one entry per row, in order of their texts' hashes;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import scratch, small_batches, written
from tessella.llm.pieces_memo import PieceMemo
from tessella.llm.sst_format import Reader, Writer

FILE_BYTES, FILE_ROWS = 256 << 20, 1_000_000
#: Blocks (of about 128 kB before compression) that one reading task takes in a run.
RUN_BLOCKS = 64
_MANIFEST = "part int, file int, path string, size bigint, n_docs bigint, n_tokens bigint, n_blocks int, first_id bigint, last_id bigint"
_TYPES = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]


@lru_cache(maxsize=1)
def _memo(path: str) -> PieceMemo:
    return PieceMemo(path)


def _open_store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///") if uri.startswith("file:/") else "file://" + uri)


class _Files:
    """The files of one task, one open at a time."""

    def __init__(self, folder: str, part: int, attempt: int, width: int, file_bytes: int, file_rows: int):
        self.folder, self.part, self.attempt, self.width = folder, part, attempt, width
        self.file_bytes, self.file_rows = file_bytes, file_rows
        self.store, self.root = _open_store(folder)
        self.store.create_dir(self.root, recursive=True)
        self.number, self.writer = 0, None

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[list]:
        if self.writer is None:
            self.name = f"shard-{self.part:06d}-{self.number:04d}.sst"
            self.temporary = f"{self.root}/.{self.name}-{self.attempt}"
            self.out = self.store.open_output_stream(self.temporary)
            self.writer, self.first = Writer(self.out, self.width), doc_id
        self.writer.add(doc_id, ids)
        self.last = doc_id
        if self.writer.at >= self.file_bytes or self.writer.rows >= self.file_rows:
            yield self.close()

    def close(self) -> list:
        """Ends the open file; its row of the manifest."""
        w = self.writer
        w.close()
        size = self.out.tell()
        self.out.close()
        self.store.move(self.temporary, f"{self.root}/{self.name}")
        row = [self.part, self.number, f"{self.folder}/{self.name}", size, w.rows, w.tokens, len(w.index), self.first, self.last]
        self.number, self.writer = self.number + 1, None
        return row


def _write_partition(folder: str, tokenizer_path: str, end_id: int, file_bytes: int, file_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        memo, context, files = _memo(tokenizer_path), TaskContext.get(), None
        width = 2 if len(memo.ends) <= 1 << 16 and end_id < 1 << 16 else 4
        end = end_id.to_bytes(4, "little")

        def listed(row: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES)], names=[f.split()[0] for f in _MANIFEST.split(", ")])

        for b in batches:
            if b.num_rows and files is None:
                files = _Files(folder, context.partitionId(), context.taskAttemptId(), width, file_bytes, file_rows)
            texts = [t or "" for t in b.column(1).to_pylist()]
            for doc_id, ids in zip(b.column(0).to_pylist(), memo.batch(texts)):
                for row in files.add(doc_id, ids + end):
                    yield listed(row)
        if files is not None and files.writer is not None:
            yield listed(files.close())

    return run


def write_shards(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, n_parts: int | None = None, file_bytes: int = FILE_BYTES, file_rows: int = FILE_ROWS
) -> DataFrame:
    """Write all rows below ``folder``; returns the manifest, one row per file."""
    spark = docs.sparkSession
    small_batches(spark)
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"tie": F.xxhash64("text"), "nth": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), "tie", "nth"]
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    manifest = ordered.select("doc_id", "text").mapInArrow(_write_partition(folder, tokenizer_path, end_id, file_bytes, file_rows), _MANIFEST)
    return written(manifest, "manifest")


def open_file(path: str) -> Reader:
    """A file of the shared folder, read by ranges."""
    store, inside = _open_store(path)
    file = store.open_input_file(inside)
    return Reader(lambda at, n: file.read_at(n, at), file.size())


def _read_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            for block in open_file(r["path"]).blocks(r["first"], r["last"]):
                doc_ids, before, ids = zip(*block)
                columns = (doc_ids, [r["base"] + x for x in before], [len(x) // 4 for x in ids], [zlib.crc32(x) for x in ids])
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(manifest: DataFrame, run_blocks: int = RUN_BLOCKS) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every entry, from the files alone."""
    # one row per file: files hold a million rows or 256 MB, so this stays small
    base = F.sum("n_tokens").over(Window.orderBy("part", "file")) - F.col("n_tokens")
    first = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1, F.lit(run_blocks))).alias("first")
    runs = manifest.withColumn("base", base).select("path", "base", "n_blocks", first)
    runs = runs.select("path", "base", "first", (F.least(F.col("first") + run_blocks, "n_blocks") - 1).cast("int").alias("last"))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return runs.repartition(n, "path", "first").mapInArrow(_read_runs, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def tokens_to_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write the shards, then read every entry back."""
    folder = folder or scratch(docs.sparkSession, "sst")
    return read_shards(write_shards(docs, folder, tokenizer_path, end_id))


def find(manifest: DataFrame, doc_id: int | None) -> list[list[int]]:
    """Ids of every entry of one identifier, from the files whose range holds it: a few ranges of bytes each."""
    null = F.col("first_id").isNull()
    holds = null if doc_id is None else (null | (F.col("first_id") <= doc_id)) & (F.col("last_id") >= doc_id)
    paths = [r["path"] for r in manifest.filter(holds).orderBy("part", "file").select("path").collect()]
    return [ids for p in paths for ids in _listed(open_file(p), doc_id)]


def _listed(reader: Reader, doc_id: int | None) -> list[list[int]]:
    return [np.frombuffer(v, "<u4").tolist() for v in reader.get(doc_id)]


def lookup(data: bytes, doc_id: int | None) -> list[list[int]]:
    """Ids of one identifier in one file held as bytes."""
    return _listed(Reader.of(data), doc_id)


def memory_table(rows: list[tuple[int | None, bytes]], width: int = 4, block_bytes: int = 1 << 17) -> bytes:
    """A table file of a few entries, made in memory."""
    out = io.BytesIO()
    writer = Writer(out, width, block_bytes)
    for doc_id, ids in rows:
        writer.add(doc_id, ids)
    writer.close()
    return out.getvalue()
