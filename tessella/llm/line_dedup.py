"""Operator 10: line deduplication by a deletion-neighbourhood join.

A line is its sequence of words. A line goes when an earlier line of the corpus
is equal, or, where both have ``near_words`` words or more, when an earlier line is
within one inserted, missing or replaced word. Order: identifier, then a hash of
the text, then line number.

Equal lines meet by a 128-bit hash, with partial aggregation. For near ones, two
lines in reach share their first or their last half, so only lines that share a
half with another emit variants: their words with none or one left out, as hashed
keys. Lines with equal keys are linked to the earliest (same place left out), or
to the one line that is the key itself (a word inserted), so that a key shared by
many lines gives one link for each and never all pairs. Linked lines are compared
word by word before the later one goes.

Defined results: a null text stays null; lines without words are never duplicates
and stay; rows equal in identifier and text count as one document and get the
same result; null identifiers come last; extra columns pass through ``dedup``,
which drops a document if it had lines with words and none of them stays; an
empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm import line_keys
from tessella.llm.common import free_name, small_batches, written

#: Bytes of line numbers that may be sent to all executors; more are shuffled.
BROADCAST_BYTES = 32 << 20

_RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_kept", T.LongType())])
_ORDER = ["none", "doc_id", "rid", "line_no"]


def rid_of(text: Column) -> Column:
    return F.xxhash64(text)


def _scan(near_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "rid", "line_no", "n_words", "h1", "h2", "halves"]
        for b in batches:
            source, parts, sizes = [], [[], [], [], []], []
            halves = []
            texts = [t or b"" for t in b.column(2).to_pylist()]
            for lo, hi in line_keys.runs(np.array([len(t) for t in texts])):
                text, line, n, h1, h2, owner, key = line_keys.lines_of_many(texts[lo:hi], near_words)
                source.append(text + lo)
                for store, values in zip(parts, (line, n, h1, h2)):
                    store.append(values)
                halves.append(key[np.argsort(owner, kind="stable")])
                sizes.append(np.bincount(owner, minlength=len(line)))
            if not source:
                continue
            at = pa.array(np.concatenate(source))
            cat = [pa.array(np.concatenate(p).astype(np.int64)) for p in parts]
            offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(halves).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *cat, lists], names=names)

    return run


def scan_lines(docs: DataFrame, near_words: int = line_keys.NEAR_WORDS) -> DataFrame:
    """One row per line with words: where it is, its words, its hashes and half keys."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", rid_of(F.col("text")).alias("rid"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_scan(near_words), "doc_id bigint, rid bigint, line_no bigint, n_words bigint, h1 bigint, h2 bigint, halves array<bigint>")


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "rid", "line_no", "line", "keys"]
    for b in batches:
        source, numbers, lines, keys = [], [], [], []
        for row, (text, wanted) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
            all_lines = text.split(b"\n")
            for k in wanted:
                source.append(row)
                numbers.append(k)
                lines.append(all_lines[k].decode("utf-8"))
                keys.append(line_keys.deletions(all_lines[k]))
        at = pa.array(source, pa.int64())
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(at), b.column(1).take(at), pa.array(numbers, pa.int64()), pa.array(lines, pa.string()), pa.array(keys, longs)], names=names
        )


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return (a["rid"] == b["rid"]) & a["doc_id"].eqNullSafe(b["doc_id"])


@F.pandas_udf(T.BooleanType())
def _within_one(a: pd.Series, b: pd.Series) -> pd.Series:
    words = lambda s: [w for w in s.replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    return pd.Series([line_keys.one_edit(words(x), words(y)) for x, y in zip(a, b)])


def near_removed(docs: DataFrame, lines: DataFrame, near_words: int = line_keys.NEAR_WORDS) -> DataFrame:
    """(h1, h2) of the distinct lines that an earlier line is near to."""
    keyed = lines.filter(F.col("n_words") >= near_words).select(F.xxhash64("h1", "h2").alias("node"), F.explode("halves").alias("half"), *_ORDER)
    shared = keyed.groupBy("half").agg(F.min("node").alias("m"), F.max("node").alias("x")).filter("m < x").select("half")
    shared = written(shared, "shared-halves")  # like the other written tables of keys: a join with a frequent one is then a plain one, which Spark splits
    wanted = keyed.join(shared, "half", "left_semi").groupBy("doc_id", "rid").agg(F.collect_set("line_no").alias("wanted"))
    wanted = written(wanted, "near-lines")
    texts = docs.select("doc_id", rid_of(F.col("text")).alias("rid"), F.col("text").cast("binary").alias("text"))
    size = wanted.agg(F.sum(48 + 8 * F.size("wanted"))).first()[0] or 0
    few = size <= BROADCAST_BYTES
    joined = texts.join(F.broadcast(wanted) if few else wanted, _same_row(texts, wanted))
    joined = joined.select(texts["doc_id"], texts["rid"], "text", "wanted")
    found = joined.mapInArrow(_variants, "doc_id bigint, rid bigint, line_no bigint, line string, keys array<bigint>")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "line_no").alias("place")
    found = written(found.select(place, "line", "keys"), "variants")

    # left_out: 0 for all words, else the place of the missing word; most keys have one line and go before places are looked up
    line_id = F.xxhash64("place").alias("line_id")
    entries = found.select(line_id, F.posexplode("keys").alias("left_out", "key"))
    hits = entries.groupBy("key").agg(F.min("line_id").alias("m"), F.max("line_id").alias("x")).filter("m < x").select("key")
    entries = written(entries.join(written(hits, "variant-hits"), "key"), "shared-variants").join(found.select(line_id, "place"), "line_id")
    firsts = entries.filter("left_out > 0").groupBy("key", "left_out").agg(F.min("place").alias("other"))
    replaced = entries.join(written(firsts, "first-variants"), ["key", "left_out"]).select("place", "other")
    bases = entries.filter("left_out = 0").groupBy("key").agg(F.min("place").alias("other"))
    inserted = entries.filter("left_out > 0").join(written(bases, "whole-lines"), "key").select("place", "other")
    links = replaced.unionByName(inserted).filter("place <> other")
    links = links.select(F.greatest("place", "other").alias("later"), F.least("place", "other").alias("earlier")).distinct()
    # written, so that the join of a line that many are near to is a plain one, which Spark splits
    lines_once = written(found.select("place", "line").dropDuplicates(["place"]), "variant-lines")
    text_of = lambda name: lines_once.select(F.col("place").alias(name), F.col("line").alias(f"{name}_line"))
    links = links.join(text_of("later"), "later").join(text_of("earlier"), "earlier")
    return links.filter(_within_one("later_line", "earlier_line")).select("later.*").distinct()


def plan_lines(docs: DataFrame, near_words: int = line_keys.NEAR_WORDS) -> DataFrame:
    """(doc_id, rid, kept): the numbers of the lines with words that stay, per document that keeps any."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "line_no")).alias("first")
    lines = scan_lines(docs, near_words).groupBy("h1", "h2").agg(first, F.first("n_words").alias("n_words"), F.first("halves").alias("halves"))
    lines = written(lines.select("h1", "h2", "n_words", "halves", "first.*"), "lines")
    gone = near_removed(docs, lines, near_words)
    same = [lines[c].eqNullSafe(gone[c]) for c in _ORDER]
    stay = lines.join(gone, same[0] & same[1] & same[2] & same[3], "left_anti")
    return stay.groupBy("doc_id", "rid").agg(F.collect_set("line_no").alias("kept"))


@F.pandas_udf(_RESULT)
def _rebuild(texts: pd.Series, kept: pd.Series) -> pd.DataFrame:
    rows = []
    for text, keep in zip(texts, kept):
        if text is None:
            rows.append((None, 0, 0))
            continue
        keep = set() if keep is None else set(keep)
        lines = text.split("\n")
        worded = [bool(x.strip(" \t\n\r\x0b\x0c")) for x in lines]
        out = [x for i, x in enumerate(lines) if i in keep or not worded[i]]
        rows.append(("\n".join(out), sum(worded), len(keep)))
    return pd.DataFrame(rows, columns=["text", "n_lines", "n_kept"])


def apply_lines(docs: DataFrame, plan: DataFrame, result: str) -> DataFrame:
    """docs with a struct column ``result``: the text that stays, lines with words before and after."""
    small_batches(docs.sparkSession)
    rid, doc_id, kept = free_name(docs, "rid__"), free_name(docs, "doc_id__"), free_name(docs, "kept__")
    rows = docs.withColumn(rid, rid_of(F.col("text")))
    plan = plan.select(F.col("rid").alias(rid), F.col("doc_id").alias(doc_id), F.col("kept").alias(kept))
    joined = rows.join(plan, (rows[rid] == plan[rid]) & rows["doc_id"].eqNullSafe(plan[doc_id]), "left")
    return joined.withColumn(result, _rebuild("text", kept)).select(*[rows[c] for c in docs.columns], result)


def dedup(docs: DataFrame, near_words: int = line_keys.NEAR_WORDS) -> DataFrame:
    """docs without the lines that go, and without documents that lose all their lines."""
    result = free_name(docs, "result__")
    rows = apply_lines(docs, plan_lines(docs, near_words), result)
    r = F.col(result)
    rows = rows.filter((r["n_kept"] > 0) | (r["n_lines"] == 0))
    return rows.select(*[r["text"].alias("text") if c == "text" else F.col(c) for c in docs.columns])


def line_report(docs: DataFrame, near_words: int = line_keys.NEAR_WORDS) -> DataFrame:
    """doc_id, n_lines, n_kept and the remaining text of every row."""
    rows = apply_lines(docs.select("doc_id", "text"), plan_lines(docs, near_words), "result__")
    return rows.select("doc_id", "result__.n_lines", "result__.n_kept", "result__.text")
