"""Operator 11: conversation structure repair by Knuth's lightest-derivation agenda.

A conversation's rows are taken by turn (nulls first), then role and text. Faulty rows
are blank, duplicate (role and text of an earlier row) or cut short (no closing mark).
The cheapest edits (keep, rerole, delete, insert) that make the roles ``(s?(ua)+)?`` are
a lightest derivation over items (rows consumed, state), see ``repair_agenda``.

Duplicates are found before: rows equal in all four columns are counted, and of each role
and text of a conversation that comes more than once the first turn is kept in a written
table. Conversations are then dealt out by identifier and sorted, and each streams through
one task in order, as its digest is one of its whole text; a task holds a window of
rows, and of each of four states a cost, an audit and a digest, whatever the length.

Defined results: a null role or text is one space, so a null text is blank; null
identifiers form one conversation; rows equal in all columns are repeated rows, all but
the first duplicates; roles count by their first letter; a conversation of which
nothing is left has zeros, an empty audit and the digest of nothing; extra columns are
ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import small_batches, written
from tessella.llm.repair_agenda import NOTHING, Conversation, replay

_ORDER = ["conv_id", "turn", "role", "text"]
_SUMMARY = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_ROWS = "conv_id bigint, turn bigint, edit string, role string, text string, place bigint"


def filled(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text; a null role or text becomes one space."""
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def damaged(rows: DataFrame, one_in: int = 20) -> DataFrame:
    """Rows with ``copies``: by a hash of conversation and turn, some are dropped (0), emptied, stripped of closing marks, repeated (2) or given to the user."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = filled(rows).withColumn("kind", F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % one_in)
    kind, text = F.col("kind"), F.col("text")
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )


def _marked(rows: DataFrame) -> DataFrame:
    """Distinct rows with ``copies`` (0: only names a conversation) and ``late``: role and text come in an earlier turn."""
    rows = rows.groupBy(*_ORDER).agg(F.sum("copies").alias("copies"))
    of = [F.col("conv_id"), F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2")]
    nulls_first = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    seen = rows.filter("copies > 0").groupBy(*of).agg(F.min(nulls_first).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # written, so that the join of a role and text that fill much of a conversation is a plain one, which Spark splits
    seen = written(seen.select(F.col("conv_id").alias("conv"), "h1", "h2", "first"), "repeated-turns")
    keyed = rows.withColumns({"h1": of[1], "h2": of[2]})
    same = keyed["conv_id"].eqNullSafe(seen["conv"]) & (keyed["h1"] == seen["h1"]) & (keyed["h2"] == seen["h2"])
    late = F.coalesce(nulls_first > F.col("first"), F.lit(False)).alias("late")
    return keyed.join(seen, same, "left").select(*_ORDER, "copies", late)


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    small_batches(rows.sparkSession)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", *first, *_ORDER[1:])


def _groups(make: Callable[[], object], add: Callable[..., object], end: Callable[[object, object], object]):
    """Streams rows that come sorted by conversation: ``add(state, row)`` for each, ``end(state, conv_id)`` after its last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        current, state = None, None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if state is None or row[0] != current:
                    if state is not None:
                        yield from end(state, current)
                    current, state = row[0], make()
                yield from add(state, row)
        if state is not None:
            yield from end(state, current)

    return run


def _batched(rows: Iterator[tuple], types: list[pa.DataType], names: list[str], most: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def _names(schema: str) -> tuple[list[pa.DataType], list[str]]:
    fields = [f.split(" ") for f in schema.split(", ")]
    return [pa.int64() if t == "bigint" else pa.string() for _, t in fields], [n for n, _ in fields]


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def add(c: Conversation, row: tuple):
        _, turn, role, text, copies, late = row
        for k in range(copies):
            c.add(turn, role, text, late or k > 0)
        return ()

    stream = _groups(Conversation, add, lambda c, conv_id: [(conv_id, *c.result())])
    return _batched(stream(batches), *_names(_SUMMARY))


def _counted(rows: DataFrame, copies: str | None) -> DataFrame:
    """The four columns with ``copies``: 1, or the column of that name."""
    if copies is None:
        return filled(rows).withColumn("copies", F.lit(1).cast("bigint"))
    return rows.select(*_ORDER, F.col(copies).alias("copies"))


def repair(rows: DataFrame, copies: str | None = None) -> DataFrame:
    """A row per conversation of ``rows`` (conv_id, turn, role, text): its faults, the cheapest edits and the digest of the repaired rows.

    ``copies`` names a column that says how often a row comes; with 0 it only names its conversation.
    """
    rows = _counted(rows, copies)
    return _in_order(_marked(rows)).mapInArrow(_summarise, _SUMMARY)


class _Replayed:
    """The state of an audit that is applied row by row."""

    def __init__(self):
        self.audit, self.at, self.state, self.place = "", 0, NOTHING, 0


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from tessella.llm.repair_agenda import KEEPS, NEXT

    def out(r: _Replayed, conv_id, turn, own: list[tuple[str, str]], letter: str):
        ((edit, _, role, text),) = replay(own, r.state, letter)
        if letter != "D":
            r.state = KEEPS[r.state, own[0][0][:1]] if letter == "K" else NEXT[r.state][1]
        r.place, r.at = r.place + 1, r.at + 1
        return conv_id, turn, edit, role, text, r.place - 1

    def inserted(r: _Replayed, conv_id):
        while r.at < len(r.audit) and r.audit[r.at] == "I":
            yield out(r, conv_id, None, [], "I")

    def add(r: _Replayed, row: tuple):
        conv_id, turn, role, text, copies, audit = row
        if audit is not None:
            r.audit = audit
            return
        for _ in range(copies):
            yield from inserted(r, conv_id)
            yield out(r, conv_id, turn, [(role, text)], r.audit[r.at])

    stream = _groups(_Replayed, add, lambda r, conv_id: inserted(r, conv_id))
    return _batched(stream(batches), *_names(_ROWS))


def edits(rows: DataFrame, repaired: DataFrame, copies: str | None = None) -> DataFrame:
    """conv_id, turn, edit, role, text, place of every row as it is after the repair, deleted ones (edit D) and inserted ones (I, without turn) included."""
    rows = _counted(rows, copies).groupBy(*_ORDER).agg(F.sum("copies").alias("copies")).withColumn("audit", F.lit(None).cast("string"))
    none = F.lit(None).cast("string")
    heads = repaired.select("conv_id", F.lit(None).cast("bigint").alias("turn"), none.alias("role"), none.alias("text"), F.lit(0).cast("bigint").alias("copies"), "audit")
    both = heads.unionByName(rows).withColumn("body", F.col("audit").isNull())
    return _in_order(both, "body").drop("body").mapInArrow(_apply, _ROWS)


def repaired_rows(rows: DataFrame, copies: str | None = None) -> DataFrame:
    """conv_id, place, turn, role, text of the repaired conversations; inserted rows have no turn."""
    return edits(rows, repair(rows, copies), copies).filter("edit <> 'D'").drop("edit")
