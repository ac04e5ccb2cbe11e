"""Operator 7: similarity join on word shingles by a MinHash LSH forest.

Rows with equal shingle sets form one group and are compared once. Each group's
MinHash values make one label per tree; sorted labels are the tree's prefix trie.
Prefixes start at full depth and are shortened tree by tree, the deepest first: while
the expected recall of a pair just at the threshold, 1 - (1 - s^d1)(1 - s^d2)...,
is below the target. So the depths follow from the threshold alone. After the
verification they are shortened further, and the work is repeated, while the recall
shown by the links of the whole table is below the target: a link that no tree shows
counts as missed, and so do as many as the numbers of links that one tree and two
trees show let expect beyond those found (Chao's estimate). Groups that share a prefix in a tree become candidates: each bucket links its
members to its least one, and the components of these links are the clusters.

A cluster is verified exactly, by shingle intersection, in blocks of two chunks
of about ``chunk`` groups: no task holds more than one block, whatever the
cluster's size. A block returns the number of links of each group and a spanning
forest of its links, so neither candidates nor links are ever expanded to pairs
of rows. Classes are the components of the forests.

Defined results: texts without words (null, empty, white space) have no shingles
and link to nothing; texts of fewer than five words have one shingle, all their
words; repeated rows are separate documents with equal sets; null identifiers
take part, and a class is named by its least non-null identifier; extra columns
pass through ``keep_one``; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import shingles as sh
from tessella.llm.common import free_name, small_batches, written
from tessella.llm.components import components
from tessella.llm.source_mix import row_key

THRESHOLD = (4, 5)
TREES, MAX_DEPTH = 16, 5
RECALL = 0.9995
#: Texts that recall can be measured on by hand, and the bytes of one: a bound of what each task holds of them.
QUERIES, QUERY_BYTES = 256, 16 << 10
CHUNK = 256


def shortened(depths: list[int]) -> list[int]:
    """The first of the longest prefixes without its last value."""
    longest = depths.index(max(depths))
    return [d - (i == longest) for i, d in enumerate(depths)]


def depths_for(recall: float = RECALL, trees: int = TREES, deepest: int = MAX_DEPTH, similarity: float = THRESHOLD[0] / THRESHOLD[1]) -> list[int]:
    """The longest prefixes, one per tree, whose expected recall at the threshold reaches the target."""
    depths = [deepest] * trees
    while max(depths) > 1 and 1 - math.prod(1 - similarity**d for d in depths) < recall:
        depths = shortened(depths)
    return depths


def query_texts(docs: DataFrame, most: int = QUERIES, size: int = QUERY_BYTES) -> list[bytes]:
    """Distinct texts of at most ``size`` bytes, of least hash; at most ``most``. To measure recall against exact comparisons (``signatures``); the join takes nothing from them."""
    rows = docs.filter(F.octet_length("text").between(1, size)).select(F.xxhash64("text", F.lit(7)).alias("h"), F.col("text").cast("binary").alias("text"))
    least = [r["h"] for r in rows.select("h").distinct().orderBy("h").limit(most).collect()]
    if not least:
        return []
    return [bytes(r["text"]) for r in rows.filter(F.col("h") <= least[-1]).groupBy("h").agg(F.first("text").alias("text")).collect()]


def _sign(trees: int, queries: list[bytes]):
    distinct = {s.tobytes(): s for s in map(sh.shingle_set, queries) if len(s)}
    sets = list(distinct.values())
    values, owners = sh.merged(sets)
    lengths = np.array([len(s) for s in sets], dtype=np.int64)
    p, q = THRESHOLD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = sh.hash_family(trees * MAX_DEPTH)
        marks = [sh.labels(s, family, trees, MAX_DEPTH) for s in sets]
        for b in batches:
            keys, counts, rows, met = [], [], [], []
            for text in b.column(2).to_pylist():
                s = sh.shingle_set(text or b"")
                counts.append(len(s))
                keys.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
                label = sh.labels(s, family, trees, MAX_DEPTH) if len(s) else None
                rows.append(label)
                both = sh.overlaps_with(s, values, owners, len(sets))
                near = ((p + q) * both >= p * (len(s) + lengths)) & (both > 0) & ((both < len(s)) | (both < lengths))
                met.append([sh.common_depths(label, marks[i], MAX_DEPTH) for i in np.flatnonzero(near)])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(keys, pa.string()), pa.array(counts, pa.int64()), pa.array(rows, longs), pa.array(met, pa.list_(longs))],
                names=["doc_id", "row_key", "set_key", "n_shingles", "labels", "met"],
            )

    return run


def signatures(docs: DataFrame, queries: list[bytes], trees: int = TREES) -> DataFrame:
    """One row per document: its shingle set's key and size, its label in each tree, and for each query that
    it is near to without being equal, how many values they share in each tree."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row_key"), F.col("text").cast("binary").alias("text"))
    schema = "doc_id bigint, row_key string, set_key string, n_shingles bigint, labels array<bigint>, met array<array<bigint>>"
    return rows.mapInArrow(_sign(trees, queries), schema)


def shown_recall(met: DataFrame, depths: list[int]) -> float:
    """Share of the links (column ``common``: values shared per tree) whose two ends share a prefix; 1 without links."""
    hit = F.exists(F.zip_with("common", F.array(*[F.lit(d) for d in depths]), lambda n, d: n >= d), lambda x: x)
    share = met.agg(F.avg(hit.cast("double"))).first()[0]
    return 1.0 if share is None else share


def candidate_clusters(groups: DataFrame, depths: list[int]) -> DataFrame:
    """(node, root) over 64-bit hashes of set keys: groups joined by shared prefixes.

    Two keys with equal hashes would only share a cluster, and be verified apart.
    """
    prefixes = F.array(*[F.shiftright(F.col("labels")[i], sh.VALUE_BITS * (MAX_DEPTH - d)) for i, d in enumerate(depths)])
    entries = groups.select(F.xxhash64("set_key").alias("node"), F.posexplode(prefixes).alias("tree", "label"))
    buckets = entries.groupBy("tree", "label").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first < last")
    buckets = written(buckets, "buckets")  # like the other written tables of keys: the join of a frequent one is then a plain one, which Spark splits
    edges = entries.join(buckets.drop("last"), ["tree", "label"]).filter("node <> first")
    return components(edges.select(F.col("node").alias("a"), F.col("first").alias("b")))


def _to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [sh.shingle_set(t or b"").tobytes() for t in b.column(5).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*(b.column(k) for k in range(5)), pa.array(sets, pa.binary())], names=["root", "chunk", "chunks", "set_key", "copies", "shingles"]
        )


def _compare(members: list[tuple[int, str, int, bytes]], lo: int, hi: int) -> Iterator[tuple[str, str | None, int]]:
    """members: (chunk, key, copies, shingles). Links between the chunks lo and hi, or inside lo = hi."""
    members = list({m[1]: m for m in members}.values())
    if len(members) < 2:
        return
    sets = [np.frombuffer(m[3], dtype=np.uint64) for m in members]
    size = np.array([len(s) for s in sets], dtype=np.int64)
    both = sh.overlaps(sets)
    p, q = THRESHOLD
    linked = (p + q) * both >= p * (size[:, None] + size[None, :])
    side = np.array([m[0] for m in members])
    if lo != hi:
        linked &= side[:, None] != side[None, :]
    np.fill_diagonal(linked, False)
    copies = np.array([m[2] for m in members], dtype=np.int64)
    totals = linked @ copies
    parent = list(range(len(members)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in np.flatnonzero(totals):
        yield members[i][1], None, int(totals[i])
    for i, j in zip(*np.nonzero(np.triu(linked))):
        a, b = find(i), find(j)
        if a != b:
            parent[b] = a
            yield members[i][1], members[j][1], 0


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block; a block may continue in the next batch."""
    names = ["a", "b", "n"]
    types = [pa.string(), pa.string(), pa.int64()]
    current, members = None, []

    def result():
        rows = list(_compare(members, current[1], current[2]))
        columns = list(zip(*rows)) if rows else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    for b in batches:
        blocks = list(zip(*(b.column(k).to_pylist() for k in range(3))))
        rows = zip(*(b.column(k).to_pylist() for k in range(3, 7)))
        for block, row in zip(blocks, rows):
            if block != current:
                if len(members) > 1:
                    yield result()
                current, members = block, []
            members.append(row)
    if len(members) > 1:
        yield result()


def verified(docs: DataFrame, groups: DataFrame, clusters: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(a, null, links of a) and (a, b, 0) rows: link counts per block, and forests of links."""
    members = groups.select(F.xxhash64("set_key").alias("node"), "set_key", "copies", "row_key").join(clusters, "node")
    sizes = written(members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / float(chunk)).cast("int").alias("chunks")), "cluster-sizes")
    members = members.join(sizes, "root").select("root", F.pmod(F.xxhash64("set_key", F.lit(1)), "chunks").cast("int").alias("chunk"), "chunks", "set_key", "copies", "row_key")
    texts = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row_key"), F.col("text").cast("binary").alias("text"))
    rows = texts.join(members, "row_key").select("root", "chunk", "chunks", "set_key", "copies", "text")
    sets = rows.mapInArrow(_to_sets, "root bigint, chunk int, chunks int, set_key string, copies bigint, shingles binary")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    blocks = sets.select("root", "chunk", other, "set_key", "copies", "shingles")
    blocks = blocks.select("root", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "set_key", "copies", "shingles")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.repartition(n, "root", "lo", "hi").sortWithinPartitions("root", "lo", "hi")
    return written(dealt.mapInArrow(_verify, "a string, b string, n bigint"), "links")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per document (doc_id, row_key, set_key); per set key (set_key, class_key, class_id, n_links, first)."""
    signed = written(signatures(docs, []), "signatures")
    # 'first' orders the documents of a group: least identifier, null last
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    groups = signed.filter("n_shingles > 0").groupBy("set_key").agg(F.count(F.lit(1)).alias("copies"), F.min(first).alias("first"), F.first("labels").alias("labels"))
    groups = written(groups, "groups").withColumn("row_key", F.col("first.row_key"))
    depths = depths_for()
    links = verified(docs, groups, written(candidate_clusters(groups, depths), "clusters"))
    while max(depths) > 1 and shown_recall(with_unseen(linked_values(links, groups), depths), depths) < RECALL:
        depths = shortened(depths)
        links = verified(docs, groups, written(candidate_clusters(groups, depths), "clusters"))
    found = components(links.filter("b is not null").select("a", "b")).select(F.col("node").alias("set_key"), F.col("root").alias("class_key"))
    counts = links.filter("b is null").groupBy(F.col("a").alias("set_key")).agg(F.sum("n").alias("linked"))
    linked = groups.join(found, "set_key").join(counts, "set_key").select("set_key", "class_key", "linked", "first")
    heads = written(linked.groupBy("class_key").agg(F.min("first").alias("head")), "class-heads")
    linked = linked.join(heads, "class_key").select("set_key", "class_key", "linked", "head")
    per_set = groups.select("set_key", "copies", "first").join(linked, "set_key", "left")
    per_set = per_set.select(
        "set_key",
        F.coalesce("class_key", "set_key").alias("class_key"),
        F.coalesce("head", "first").alias("head"),
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    # written, so that the join with the copies of one set is a plain one, which Spark splits
    return signed.select("doc_id", "row_key", "set_key"), written(per_set, "sets")


def linked_values(links: DataFrame, groups: DataFrame) -> DataFrame:
    """A row per link of the forests: ``common``, the values that its ends share in each tree."""
    labels = groups.select("set_key", "labels")
    ends = links.filter("b is not null").select("a", "b")
    ends = ends.join(labels.select(F.col("set_key").alias("a"), F.col("labels").alias("at_a")), "a")
    ends = ends.join(labels.select(F.col("set_key").alias("b"), F.col("labels").alias("at_b")), "b")
    shared = lambda x, y: sum(((F.shiftright(x.bitwiseXOR(y), sh.VALUE_BITS * k) == 0).cast("bigint") for k in range(MAX_DEPTH)), F.lit(0).cast("bigint"))
    return written(ends.select(F.zip_with("at_a", "at_b", shared).alias("common")), "linked-values")


def with_unseen(common: DataFrame, depths: list[int]) -> DataFrame:
    """Adds a row without shared values for each link that is expected beyond those found: f1 (f1 - 1) / 2 (f2 + 1), where one tree shows f1 links and two trees show f2."""
    shows = F.size(F.filter(F.zip_with("common", F.array(*[F.lit(d) for d in depths]), lambda n, d: n >= d), lambda x: x))
    once, twice = common.agg(F.count_if(shows == 1), F.count_if(shows == 2)).first()
    unseen = common.sparkSession.range(once * (once - 1) // (2 * (twice + 1)))
    return common.unionByName(unseen.select(F.array(*[F.lit(0).cast("bigint") for _ in depths]).alias("common")))


def link_documents(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least identifier of its class), n_links (documents linked to it)."""
    signed, per_set = classes(docs)
    with_words = signed.filter("set_key is not null").join(per_set, "set_key")
    linked = with_words.select("doc_id", F.col("head.doc_id").alias("class_id"), "n_links")
    alone = signed.filter("set_key is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return linked.unionByName(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """The first document of each class and all documents without words, with all their columns."""
    signed, per_set = classes(docs)
    heads = per_set.select("class_key", F.col("head.row_key").alias("row_key")).distinct().select("row_key", F.lit(True).alias("once"))
    heads = heads.unionByName(signed.filter("set_key is null").select("row_key", F.lit(False).alias("once")).distinct())
    repeated = signed.groupBy("row_key").count().filter("count > 1").select("row_key", F.lit(True).alias("repeated"))
    key, once, many = free_name(docs, "row_key"), free_name(docs, "once"), free_name(docs, "repeated")
    heads = heads.join(repeated, "row_key", "left").select(F.col("row_key").alias(key), F.col("once").alias(once), (F.col("once") & F.coalesce("repeated", F.lit(False))).alias(many))
    heads = written(heads, "heads")  # written, so that the join with a row that many repeat is a plain one, which Spark splits
    kept = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text"))).join(heads, key)
    return kept.filter(~F.col(many)).unionByName(kept.filter(F.col(many)).dropDuplicates([key])).select(*docs.columns)
