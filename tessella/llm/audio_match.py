"""Operator 9: chroma audio fingerprints of a media column, and their alignment.

Recordings are rows of (id, audio): PCM samples, 16 bits, little-endian, one
channel. Each becomes packed integers (see ``chroma``). Recordings with equal
fingerprints are a class, and classes are aligned: they are dealt to blocks of
about ``block_rows`` by a hash, every asked class visits every block, and a block
returns one row per asked class with the list of its matches there, its own class
among them. At each offset with MIN_OVERLAP positions the bit errors are summed, so
that no match within MAX_ERROR is missed and none is dropped; copies never expand to
pairs. The work is that of all queries against all classes, and what the lists hold
grows with both.

Defined results: null or too short audio has an empty fingerprint, no class, and
matches nothing; a recording of fewer than MIN_OVERLAP positions is compared whole; rows equal in id and fingerprint are one recording,
which doesn't match itself, and for other queries they count each; one id with
several fingerprints has several rows; null ids are never queries, and as
recordings can be matched; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import chroma
from tessella.llm.common import small_batches, written

RATE = 4_000
BLOCK_ROWS = 2_048
MIN_OVERLAP, MAX_ERROR = 20, 0.25

NOTE = 256


def _sing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    time = np.arange(NOTE) / RATE
    shape = np.hanning(NOTE + 2)[1:-1]
    for b in batches:
        out = []
        for values in b.column(1).to_pylist():
            v = np.array([x if x is not None else 0.0 for x in values or []], dtype=np.float64)
            if not len(v) or not np.isfinite(v).all():
                out.append(None)
                continue
            spread = v.max() - v.min()
            step = np.floor((v - v.min()) / spread * 11.999) if spread > 0 else np.zeros(len(v))
            hz = 440 * 2 ** (step / 12)
            wave = np.sin(2 * np.pi * hz[:, None] * time) * shape
            out.append((wave.ravel() * 20_000).astype("<i2").tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "audio"])


def sung(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """A recording per vector: each component is a note, its pitch class set by the value within the vector's range."""
    small_batches(vectors.sparkSession, 128)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(_sing, "id bigint, audio binary")


def _print(rate: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = []
            for audio in b.column(1):
                raw = audio.as_py() or b""
                samples = np.frombuffer(raw[: len(raw) // 2 * 2], dtype="<i2") / 32768
                prints.append(chroma.fingerprint(chroma.frames(samples, rate)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.binary())], names=["id", "print"])

    return run


def fingerprints(recordings: DataFrame, rate: int = RATE) -> DataFrame:
    """(id, print): the packed integers of each recording, as uint32 bytes."""
    small_batches(recordings.sparkSession, 128)
    return recordings.select("id", "audio").mapInArrow(_print(rate), "id bigint, print binary")


_FOUND = "asked string, found array<struct<error: double, less: bigint, least: bigint, most: bigint, class: string, rows: bigint, offset: bigint, overlap: bigint>>"
_PARTS = ["error", "less", "least", "most", "class", "rows", "offset", "overlap"]
_MATCHES = "array<struct<class: string, id: bigint, recordings: bigint, offset: bigint, error: double, overlap: bigint>>"


def _visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per asked class and block with all it matches there; rows come by block, its classes before the asked ones."""
    current, held, stack = None, [], None
    for b in batches:
        blocks = b.column("block").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for lo, hi in zip(edges, edges[1:]):
            if lo == hi:
                continue
            if blocks[lo] != current:
                current, held, stack = blocks[lo], [], None
            rows = b.slice(lo, hi - lo)
            if stack is None:
                held.append(rows.filter(pc.invert(rows.column("asks"))))
            rows = rows.filter(rows.column("asks"))
            if not rows.num_rows:
                continue
            if stack is None:
                known = pa.Table.from_batches(held).combine_chunks()
                stack, known = chroma.Stack(_integers(known.column("print"))), known.select(["least", "most", "class", "rows"])
            asked, who, offset, error, overlap = stack.matches(_integers(rows.column("print")), MIN_OVERLAP, MAX_ERROR)
            of = [c.combine_chunks() for c in known.take(pa.array(who)).columns]
            found = pa.StructArray.from_arrays([pa.array(error), pa.array(-overlap), *of, pa.array(offset), pa.array(overlap)], names=_PARTS)
            ends = np.searchsorted(asked, np.arange(rows.num_rows + 1))
            yield pa.RecordBatch.from_arrays([rows.column("class"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)], names=["asked", "found"])


def _integers(prints: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(p, "<u4") for p in prints.to_pylist()]


def _class(of: str = "print") -> Column:
    return F.when(F.length(of) > 0, F.sha2(F.col(of), 256))


def classes(prints: DataFrame) -> DataFrame:
    """(class, print, least, most, rows): what recordings with equal fingerprints have in common."""
    groups = prints.filter(F.length("print") > 0).groupBy("print").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("rows"))
    return groups.select(_class().alias("class"), "print", "least", "most", "rows")


def align(prints: DataFrame, queries: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row per query (id, print): its class, all its matches among ``prints`` by class, and the one with the least bit error rate.

    ``matches`` has for each class a member's id (the least other than the query's, or
    else the greatest) and the number of its recordings.
    """
    spark = prints.sparkSession
    held = written(classes(prints), "classes")
    n_blocks = max(1, -(-held.count() // block_rows))
    rows = queries.filter("id is not null").select("id", "print").distinct()
    own = prints.groupBy("id", "print").agg(F.count(F.lit(1)).alias("own"))
    rows = rows.join(own, ["id", "print"], "left").select("id", _class().alias("asked"), "print", F.coalesce("own", F.lit(0)).alias("own"))
    rows = written(rows, "queries")
    asked = rows.filter("asked is not null").select("asked", "print").distinct()
    held = held.withColumn("block", F.pmod(F.xxhash64("class"), F.lit(n_blocks)).cast("int")).withColumn("asks", F.lit(False))
    visits = asked.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.lit(True).alias("asks"), F.col("asked").alias("class"), "print")
    n = max(n_blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    visited = held.unionByName(visits, allowMissingColumns=True).repartition(n, "block").sortWithinPartitions("block", "asks").mapInArrow(_visit, _FOUND)
    found = F.transform(F.flatten(F.collect_list("found")), lambda m: m.withField("error", F.round(m["error"], 9)))
    lists = visited.groupBy("asked").agg(F.array_sort(found).alias("found"))
    rows = rows.join(lists, "asked", "left")
    others = lambda m: m["rows"] - F.when(m["class"] == F.col("asked"), F.col("own")).otherwise(0)
    member = lambda m: F.when(m["least"] != F.col("id"), m["least"]).when(m["most"] != F.col("id"), m["most"])
    listed = F.transform(
        F.filter(F.coalesce("found", F.array()), lambda m: others(m) > 0),
        lambda m: F.struct(m["class"].alias("class"), member(m).alias("id"), others(m).alias("recordings"), m["offset"].alias("offset"), m["error"].alias("error"), m["overlap"].alias("overlap")),
    )
    rows = rows.select("id", F.col("asked").alias("class"), listed.cast(_MATCHES).alias("matches"))
    total = F.aggregate("matches", F.lit(0).cast("bigint"), lambda a, m: a + m["recordings"])
    best = F.get("matches", F.lit(0))
    return rows.select("id", "class", total.alias("n_matches"), best["id"].alias("best_id"), best["offset"].alias("best_offset"), best["error"].alias("best_error"), "matches")


def search(recordings: DataFrame, every: int = 20) -> DataFrame:
    """A row per recording (id, fingerprint) with its class; those whose id is divisible by ``every`` are queries and have matches."""
    prints = written(fingerprints(recordings), "fingerprints")
    asks = F.col("id") % every == 0
    found = align(prints, prints.filter(asks))
    others = prints.filter(~F.coalesce(asks, F.lit(False))).select("id", "print").distinct().select("id", _class().alias("class"))
    return found.unionByName(others, allowMissingColumns=True)
