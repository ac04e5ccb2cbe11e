"""Feature collections read by byte ranges, so that no task holds a file.

A file is cut into blocks. What a block means depends on the text before it only by
three things: whether it starts inside a string, whether its first character is escaped,
and how deep it is nested. A first pass over all blocks returns, for each of the four starts,
where the block ends; chained in order, these few numbers give every block its true
start. A second pass then knows exactly which braces open a feature, whatever the
file's formatting, and reads on past the block's end to the last one's closing brace.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.scratch import kept

BLOCK = 8 << 20
#: Bytes before a brace that are searched for its key.
LOOK_BACK = 256
_OPEN, _CLOSE = b"{[", b"}]"
_CRS = re.compile(rb'"crs"\s*:\s*$')


def opened(uri: str):
    """A file for reading at any place; raises where the store is none that Python can reach."""
    if re.match(r"file:/[^/]", uri):
        uri = "file://" + uri.removeprefix("file:")
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def reachable(uri: str) -> bool:
    try:
        opened(uri).close()
    except Exception:  # an unknown scheme, a missing library or no access: Spark's own reader is left
        return False
    return True


class Structure:
    """Braces and brackets outside strings: places, and +1 or -1 for each."""

    def __init__(self, text: bytes, inside: bool = False, escaped: bool = False):
        raw = np.frombuffer(text, dtype=np.uint8)
        quotes = np.flatnonzero(raw == 34)
        if len(quotes):
            after = raw[np.maximum(quotes - 1, 0)] == 92
            after[0] |= quotes[0] == 0
            use = np.ones(len(quotes), dtype=bool)
            for i in np.flatnonzero(after).tolist():
                use[i] = not self._escaped(text, int(quotes[i]), escaped)
            quotes = quotes[use]
        step = np.zeros(256, dtype=np.int8)
        step[list(_OPEN)], step[list(_CLOSE)] = 1, -1
        places = np.flatnonzero(step[raw] != 0)
        outside = (np.searchsorted(quotes, places) + inside) % 2 == 0
        self.places = places[outside]
        self.steps = step[raw[self.places]].astype(np.int64)
        self.opens = raw[self.places] == 123
        self.inside = (len(quotes) + inside) % 2 == 1
        self.escaped = self._escaped(text, len(text), escaped)

    @staticmethod
    def _escaped(text: bytes, at: int, first: bool) -> bool:
        """True if the character at a place is escaped; ``first``: the text's first one is."""
        start = at
        while start and text[start - 1] == 92:
            start -= 1
        run = at - start
        return first if at == 0 else (run - (start == 0 and first)) % 2 == 1


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block and start (inside, escaped): the same at its end, and the change of depth."""
    names = ["file", "start", "ends"]
    for b in batches:
        rows = []
        for file, start, size in zip(*(c.to_pylist() for c in b.columns)):
            with opened(file) as f:
                f.seek(start)
                text = f.read(size)
            found = [Structure(text, bool(k & 1), bool(k & 2)) for k in range(4)]
            rows.append([x for s in found for x in (s.inside + 2 * s.escaped, int(s.steps.sum()))])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.list_(pa.int64()))], names=names)


def _cut(file: str, start: int, size: int, state: int, depth: int) -> Iterator[tuple[str, int, str, str]]:
    """(file, start, kind, text) of the features, and of the root's crs, that open in a block."""
    with opened(file) as f:
        back = min(LOOK_BACK, start)
        f.seek(start - back)
        head, text = f.read(back), f.read(size)
        own, more = len(text), 1 << 16
        while True:
            s = Structure(text, bool(state & 1), bool(state & 2))
            level = depth + np.cumsum(s.steps)
            if not len(level) or not ((s.places < own) & s.opens & (s.steps > 0)).any():
                return
            starts = [i for i in np.flatnonzero(s.opens & (s.places < own) & ((level == 3) | (level == 2))).tolist()]
            closes = {n: np.flatnonzero((s.steps < 0) & (level == n - 1)) for n in (2, 3)}
            last = max(starts, default=None)
            done = last is None or all((k := np.searchsorted(closes[int(level[i])], i)) < len(closes[int(level[i])]) for i in starts)
            if done:
                break
            extra = f.read(more)
            if not extra:
                raise ValueError(f"{file} ends inside a feature")
            text, more = text + extra, more * 2
        for i in starts:
            at, n = int(s.places[i]), int(level[i])
            end = int(s.places[closes[n][np.searchsorted(closes[n], i)]]) + 1
            if n == 3:
                yield file, start + at, "feature", text[at:end].decode("utf-8")
            elif _CRS.search((head + text[:at])[-LOOK_BACK:]):
                yield file, start + at, "crs", text[at:end].decode("utf-8")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = ["file", "start", "kind", "text"], [pa.string(), pa.int64(), pa.string(), pa.string()]
    for b in batches:
        for block in zip(*(c.to_pylist() for c in b.columns)):
            held, size = [], 0
            for row in _cut(*block):
                held.append(row)
                size += len(row[3])
                if size > BLOCK:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names and sizes, listed by Spark; contents aren't read. A missing path raises."""
    found = spark.read.format("binaryFile").load(path).select("path", "length").collect()
    return [(r["path"], r["length"]) for r in found]


def parts(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(file, start, kind, text): every element of the collections' arrays of objects (kind feature), and their crs.

    A few numbers per block reach the driver. Files may hold one collection or one per
    line. Where Python can't reach the store, ``reachable`` says so before.
    """
    pieces = [(f, start, min(block, size - start)) for f, size in files(spark, path) for start in range(0, size, block)]
    if not pieces:
        return spark.createDataFrame([], "file string, start bigint, kind string, text string")
    cores = spark.sparkContext.defaultParallelism
    n = min(len(pieces), 4 * cores) if len(pieces) < 64 * cores else len(pieces) // 16
    table = spark.createDataFrame(pieces, "file string, start bigint, size bigint").repartition(n, "file", "start")
    ends = {(r["file"], r["start"]): r["ends"] for r in table.mapInArrow(_ends, "file string, start bigint, ends array<bigint>").collect()}
    known, before = [], None
    for file, start, size in pieces:  # in the order of the file
        state, depth = before[1:] if before and before[0] == file else (0, 0)
        known.append((file, start, size, state, depth))
        to = ends[file, start]
        before = (file, to[2 * state], depth + to[2 * state + 1])
    rows = spark.createDataFrame(known, "file string, start bigint, size bigint, state int, depth bigint").repartition(n, "file", "start")
    return kept(rows.mapInArrow(_parts, "file string, start bigint, kind string, text string"), "geojson")


def crs_names(found: DataFrame) -> DataFrame:
    """(file, name) of the systems that files name."""
    name = F.from_json("text", "properties struct<name: string>")["properties"]["name"]
    return found.filter("kind = 'crs'").select("file", name.alias("name"))


def geometries(found: DataFrame) -> DataFrame:
    """(file, start, type, coordinates as text) of the features: of those elements that have a geometry."""
    body = F.from_json("text", "geometry struct<type: string, coordinates: string>").alias("f")
    return found.filter("kind = 'feature'").select("file", "start", body).filter("f.geometry is not null").select("file", "start", "f.geometry.*")
