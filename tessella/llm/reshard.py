"""Operator 3: resharding by minimum-cost flow.

Old shards send bytes to new shards of given capacities; staying costs nothing,
moving costs one per byte. Only the shard sizes (one row each) reach the driver,
where the flow is solved; the flows of an old shard are then intervals of its
byte range, staying bytes first, and a document goes where its middle byte falls.

A shard's byte range is laid out in hashed blocks of about ``block_rows`` rows:
block sizes are prefix-summed, and the rows of one block are ordered by
identifier. No window holds more than one block's rows or one shard's blocks.
The rows are shuffled once, by (old shard, block), and written by new shard; in
place, only the shards that send or receive bytes are written.

Defined results: a null text counts 8 bytes; null identifiers are ordinary rows,
first in their block; repeated rows keep their multiplicity and get slots of
their own; extra columns are kept, whatever their names; an empty table gives
empty shards.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import free_name, scratch, written

BLOCK_ROWS = 1_024
OVERHEAD = 8


@dataclass(frozen=True)
class Flow:
    """Bytes [lo, hi) of an old shard's range go to a new shard."""

    old: int
    new: int
    lo: int
    hi: int


def min_cost_flow(
    sizes: dict[int, int], capacities: dict[int, int], cost: Callable[[int, int], int] = lambda i, j: int(i != j)
) -> dict[tuple[int, int], int]:
    """Bytes on each (old, new) pair at least total cost; capacities have to sum to the sizes.

    Successive shortest augmenting paths over the shard graph (not the data).
    """
    if sum(sizes.values()) != sum(capacities.values()):
        raise ValueError("capacities have to add up to the sizes")
    nodes = [("s",), ("t",), *(("o", i) for i in sizes), *(("n", j) for j in capacities)]
    edges: list[list] = []  # [to, free, cost]; the reverse edge is at index ^ 1
    out: dict[tuple, list[int]] = {n: [] for n in nodes}

    def connect(a, b, free, price):
        out[a].append(len(edges))
        edges.append([b, free, price])
        out[b].append(len(edges))
        edges.append([a, 0, -price])

    for i, n in sizes.items():
        connect(("s",), ("o", i), n, 0)
        for j in capacities:
            connect(("o", i), ("n", j), n, cost(i, j))
    for j, n in capacities.items():
        connect(("n", j), ("t",), n, 0)
    while True:
        best, via, queue = {("s",): 0}, {}, deque([("s",)])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                b, free, price = edges[e]
                if free > 0 and best[a] + price < best.get(b, float("inf")):
                    best[b], via[b] = best[a] + price, e
                    queue.append(b)
        if ("t",) not in best:
            break
        path, at = [], ("t",)
        while at != ("s",):
            path.append(via[at])
            at = edges[via[at] ^ 1][0]
        amount = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= amount
            edges[e ^ 1][1] += amount
    return {
        (a[1], edges[e][0][1]): edges[e ^ 1][1]
        for a in nodes if a[0] == "o" for e in out[a] if e % 2 == 0 and edges[e ^ 1][1] > 0
    }


def even_capacities(total: int, n: int) -> dict[int, int]:
    return {j: total * (j + 1) // n - total * j // n for j in range(n)}


def lay_out(sizes: dict[int, int], moved: dict[tuple[int, int], int]) -> list[Flow]:
    flows = []
    for i in sorted(sizes):
        at = 0
        for j in sorted((j for o, j in moved if o == i), key=lambda j: (j != i, j)):
            flows.append(Flow(i, j, at, at + moved[i, j]))
            at += moved[i, j]
    return flows


def _which(flows: list[Flow], old: Column, middle: Column) -> Column:
    """New shard of a byte position: a literal lookup over at most old + new intervals."""
    per_old: dict[int, list[Flow]] = {}
    for f in flows:
        per_old.setdefault(f.old, []).append(f)
    case = None
    for i, fs in per_old.items():
        inner = F.lit(fs[-1].new)
        for f in reversed(fs[:-1]):
            inner = F.when(middle < f.hi, f.new).otherwise(inner)
        case = F.when(old == i, inner) if case is None else case.when(old == i, inner)
    return F.lit(None).cast("int") if case is None else case.cast("int")


@dataclass(frozen=True)
class Plan:
    flows: list[Flow]
    blocks: dict[int, int]
    offsets: DataFrame  # old, block, offset
    entries: DataFrame  # old, block, new, first, base

    @property
    def affected(self) -> set[int]:
        """Shards that send or receive bytes."""
        return {s for f in self.flows if f.old != f.new for s in (f.old, f.new)}

    @property
    def moved_bytes(self) -> int:
        return sum(f.hi - f.lo for f in self.flows if f.old != f.new)


def _with_block(rows: DataFrame, blocks: dict[int, int], old: str, doc_id: str, tie: str, block: str) -> DataFrame:
    count = F.lit(1)
    for i, n in blocks.items():
        count = F.when(F.col(old) == i, n).otherwise(count)
    return rows.withColumn(block, F.pmod(F.xxhash64(doc_id, tie), count).cast("int"))


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("bigint")


def crc_of(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")))


def plan_reshard(docs: DataFrame, old_shard: Column, n_new: int, block_rows: int = BLOCK_ROWS) -> Plan:
    """From the old shard of each row, the flows and where each block's rows go."""
    light = written(
        docs.select(old_shard.cast("int").alias("old"), F.col("doc_id"), size_of(F.col("text")).alias("size"), crc_of(F.col("text")).alias("tie")), "reshard-rows"
    )
    # one row per old shard
    stats = {r["old"]: (r["bytes"], r["n"]) for r in light.groupBy("old").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()}
    sizes = {i: b for i, (b, _) in stats.items()}
    flows = lay_out(sizes, min_cost_flow(sizes, even_capacities(sum(sizes.values()), n_new)))
    blocks = {i: -(-n // block_rows) for i, (_, n) in stats.items()}
    placed = _with_block(light, blocks, "old", "doc_id", "tie", "block")
    before = Window.partitionBy("old").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("old", "block").agg(F.sum("size").alias("bytes"))
    offsets = offsets.select("old", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("old", "block").orderBy("doc_id", "tie", "size")
    ranked = placed.withColumns({"rn": F.row_number().over(inside), "running": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    ranked = ranked.join(offsets, ["old", "block"])
    ranked = ranked.withColumn("new", _which(flows, F.col("old"), F.col("offset") + F.col("running") - F.col("size") / 2.0))
    entries = ranked.groupBy("old", "block", "offset", "new").agg(F.min("rn").alias("first"), F.count(F.lit(1)).alias("n"))
    by_shard = Window.partitionBy("new").orderBy("old", "block").rowsBetween(Window.unboundedPreceding, -1)
    entries = entries.withColumn("base", F.coalesce(F.sum("n").over(by_shard), F.lit(0)))
    entries = written(entries.select("old", "block", "offset", "new", "first", "base"), "reshard-blocks")
    return Plan(flows, blocks, entries.select("old", "block", "offset").distinct(), entries)


def assign(docs: DataFrame, old_shard: Column, plan: Plan, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """All columns of docs and the new ``shard`` and ``slot`` of each row; one shuffle of the rows."""
    names = {k: free_name(docs, f"{k}__") for k in ("old", "block", "tie", "size", "rn", "running")}
    old, block, tie, size, rn, running = names.values()
    rows = docs.withColumns({old: old_shard.cast("int"), tie: crc_of(F.col("text")), size: size_of(F.col("text"))})
    rows = _with_block(rows, plan.blocks, old, "doc_id", tie, block)
    inside = Window.partitionBy(old, block).orderBy("doc_id", tie, size)
    rows = rows.withColumns({rn: F.row_number().over(inside), running: F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    e = F.struct("new", "first", "base").alias("e")
    at = free_name(docs, "entries__")
    per_block = plan.entries.groupBy(F.col("old").alias(old), F.col("block").alias(block)).agg(F.first("offset").alias(f"{at}o"), F.collect_list(e).alias(at))
    rows = rows.join(per_block, [old, block])
    new = _which(plan.flows, F.col(old), F.col(f"{at}o") + F.col(running) - F.col(size) / 2.0)
    rows = rows.withColumn(shard, new)
    mine = F.element_at(F.filter(F.col(at), lambda x: x["new"] == F.col(shard)), 1)
    return rows.withColumn(slot, (mine["base"] + F.col(rn) - mine["first"]).cast("bigint")).select(*docs.columns, shard, slot)


def write_shards(docs: DataFrame, old_shard: Column, plan: Plan, folder: str, only_affected: bool = False) -> tuple[str, str]:
    """Write new shards as ``folder/<shard>=j``; returns the names of the shard and slot columns."""
    shard, slot = free_name(docs, "shard"), free_name(docs, "slot")
    rows = assign(docs, old_shard, plan, shard, slot)
    if only_affected:
        rows = rows.filter(F.col(shard).isin(sorted(plan.affected)))
    rows.write.partitionBy(shard).parquet(folder)
    return shard, slot


def reshard(docs: DataFrame, old_shard: Column, n_new: int, folder: str | None = None) -> DataFrame:
    """Plan, rewrite, and read the written shards: all columns with shard and slot."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "shards")
    shard, slot = write_shards(docs, old_shard, plan_reshard(docs, old_shard, n_new), folder)
    fields = docs.withColumns({slot: F.lit(0).cast("bigint"), shard: F.lit(0).cast("int")}).schema
    return spark.read.schema(fields).parquet(folder)
