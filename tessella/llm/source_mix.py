"""Operator 2: mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws a reproducible uniform u from a hash of its identifier and text,
and of its number among the rows equal in these (so that rows without an identifier
and repeated rows spread; equal rows are counted and dealt out again, never sorted), and
gets the key -ln(u) / quality weight; small keys come first. A source's target is filled by complete epochs of all its documents, then by the documents in key
order while their running size stays within the rest. While more than SLACK of a
target is still open and documents fit (few, long ones did not), further passes take those
that fit, in key order. Last, each source takes the one document more whose size is
nearest to what is open, if that brings it nearer to its target.

The running sizes are taken in two levels, so that a source with a third of all
rows spreads: a monotone function of the key deals its documents to buckets of
about BUCKET_ROWS, bucket sizes are summed and prefix-summed, and the running sum
of a document starts from its bucket's offset.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; a source of size 0 has target 0; repeated rows are separate
documents; extra columns pass through ``draw``; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import WORD, free_name, written

BUCKET_ROWS = 2_048
#: Equal rows that one task deals out.
COPIES = 4_096
SLACK = 0.001
SEED = "mix"


def uniform(seed: str, key: Column) -> Column:
    """In (0, 1], from the first 13 hex digits of an md5."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 1.0) / float(1 << 52)


def row_key(doc_id: Column, text: Column) -> Column:
    """Equal for rows with equal identifier and text alone; never null."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.xxhash64(text), F.coalesce(F.octet_length(text), F.lit(-1)))


def targets(sources: DataFrame, weights: tuple[int, ...], cap: int, share: float = 1.0) -> DataFrame:
    """Adds ``target`` to one row per source (source, source_size).

    Filling to a common level: in the order of cap over weight, a source is at its
    cap if the level that the rest would share reaches it; the level is the
    largest of those.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(w) for w in weights])
    s = sources.withColumn("weight", F.get(listed, (F.row_number().over(by_name) - 1) % len(weights)))
    s = s.withColumn("cap", (cap * F.col("source_size")).cast("double"))
    all_rows = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.lit(share) * F.sum("source_size").over(all_rows).cast("double")
    left = total - (F.sum("cap").over(order) - F.col("cap"))
    weight_left = F.sum("weight").over(all_rows) - F.sum("weight").over(order) + F.col("weight")
    s = s.withColumn("level", left / weight_left.cast("double"))
    return s.withColumn("target", F.least("cap", F.col("weight") * F.max("level").over(all_rows))).select("source", "source_size", "n_docs", "target")


def _dealt(rows: DataFrame, most: int) -> DataFrame:
    """Each row with ``copy`` numbering it among its equals from 0; many equals are dealt out by several tasks."""
    same = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n_same"))
    some = same.filter(F.col("n_same") <= most).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_same") - 1)))
    parts = same.filter(F.col("n_same") > most).withColumn("part", F.explode(F.expr(f"sequence(0L, (n_same - 1) div {most})")))
    first, last = F.col("part") * most, F.least((F.col("part") + 1) * most, F.col("n_same")) - 1
    many = parts.repartition(*rows.columns, "part").withColumn("copy", F.explode(F.sequence(first, last)))
    return some.drop("n_same").unionByName(many.drop("n_same", "part"))


def plan_mix(
    docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, share: float = 1.0, seed: str = SEED
) -> DataFrame:
    """row_key, doc_id, source, size, source_size, target, copies, taken of every row of docs.

    quality: (doc_id, weight of 1 or more); others weigh 1.
    """
    sized = docs.select(
        "doc_id",
        "source",
        row_key(F.col("doc_id"), F.col("text")).alias("row_key"),
        F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5("text")).alias("named"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
    )
    sized = _dealt(sized, COPIES)
    if quality is not None:
        best = quality.filter("doc_id is not null").groupBy("doc_id").agg(F.greatest(F.max("weight"), F.lit(1.0)).alias("weight"))
        # written, so that the join of an identifier on many rows is a plain one, which Spark splits; rows without one aren't joined
        best = written(best, "mix-weights")
        weighed = sized.filter("doc_id is not null").join(best, "doc_id", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
        sized = weighed.unionByName(sized.filter("doc_id is null").withColumn("weight", F.lit(1.0)))
    else:
        sized = sized.withColumn("weight", F.lit(1.0))
    named = F.when(F.col("copy") == 0, F.col("named")).otherwise(F.concat_ws(":", "named", "copy"))
    keyed = sized.withColumn("key", -F.log(uniform(seed, named)) / F.col("weight")).drop("named", "copy")
    keyed = written(keyed.withColumn("group", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))), "mix-keys")

    sources = keyed.groupBy("group").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    aims = targets(sources, weights, cap, share).withColumn("group", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")))
    aims = written(
        aims.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("buckets", F.ceil(F.col("n_docs") / float(BUCKET_ROWS)))
        .drop("source"),
        "mix-aims",
    )
    # 1 - exp(-key) lies in [0, 1); with weights up to w its density is at most w
    placed = keyed.join(aims, "group").withColumn(
        "bucket", F.least(F.floor((1 - F.exp(-F.col("key"))) * F.col("buckets")), F.col("buckets") - 1).cast("bigint")
    )
    per_bucket = placed.groupBy("group", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.select("group", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("group", "bucket").orderBy("key", "doc_id", "size")
    running = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = placed.withColumns({"nth": F.row_number().over(inside), "running": running}).join(per_bucket, ["group", "bucket"])
    ranked = ranked.withColumn("reach", F.col("offset") + F.col("running")).drop("offset", "running")
    ranked = written(ranked.withColumn("fits", (F.col("rest") > 0) & (F.col("reach") <= F.col("rest"))), "mix-ranks")

    reached = F.coalesce(F.max(F.when(F.col("fits"), F.col("reach"))), F.lit(0))
    filled = ranked.groupBy("group").agg(F.first("target").alias("goal"), (F.first("rest") - reached).alias("open"))
    pool = ranked.filter(~F.col("fits") & (F.col("size") > 0)).select("group", "bucket", "nth", "size")
    more = None
    while True:  # a pass takes at least one document of each source that has one that fits, so this ends
        found = _fitting(pool, filled.filter(F.col("open") > SLACK * F.col("goal")), per_bucket)
        if found.isEmpty():
            break
        used = found.groupBy("group").agg(F.sum("size").alias("used"))
        filled = written(filled.join(used, "group", "left").select("group", "goal", (F.col("open") - F.coalesce("used", F.lit(0))).alias("open")), "mix-open")
        pool = pool.join(found, ["group", "bucket", "nth"], "left_anti")
        more = found if more is None else more.unionByName(found)
    nearest = F.min(F.struct(F.abs(F.col("size") - F.col("open")).alias("gap"), "bucket", "nth"))
    last = pool.join(_by_bucket(filled, per_bucket), ["group", "bucket"]).groupBy("group", "open").agg(nearest.alias("last"))
    last = last.filter("last.gap < open").select("group", "last.bucket", "last.nth")
    extra = last if more is None else last.unionByName(more.select("group", "bucket", "nth"))
    ranked = ranked.join(extra.withColumn("more", F.lit(True)), ["group", "bucket", "nth"], "left")
    ranked = ranked.withColumn("copies", (F.col("epochs") + (F.col("fits") | F.coalesce("more", F.lit(False))).cast("int")).cast("bigint"))
    return ranked.select("row_key", "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _by_bucket(per_group: DataFrame, per_bucket: DataFrame) -> DataFrame:
    """A source's values per bucket, so that a large source's rows meet them in many tasks."""
    return per_bucket.select("group", "bucket").join(per_group, "group")


def _fitting(pool: DataFrame, opened: DataFrame, per_bucket: DataFrame) -> DataFrame:
    """Documents no larger than their source's open rest, in key order while their running size stays within it."""
    fit = pool.join(_by_bucket(opened, per_bucket), ["group", "bucket"]).filter(F.col("size") <= F.col("open"))
    sums = fit.groupBy("group", "bucket").agg(F.sum("size").alias("sum"))
    before = Window.partitionBy("group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("group", "bucket", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("group", "bucket").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fit = fit.withColumn("running", F.sum("size").over(inside)).join(sums, ["group", "bucket"])
    return written(fit.filter(F.col("offset") + F.col("running") <= F.col("open")).select("group", "bucket", "nth", "size"), "mix-fill")


def draw(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of docs as often as the plan takes them, with all their columns.

    Rows equal in identifier and text share their copies evenly, so no row is numbered
    among its equals; what doesn't divide comes from one of them.
    """
    key, each, more = free_name(docs, "row_key"), free_name(docs, "each"), free_name(docs, "more")
    per_key = plan.groupBy(F.col("row_key").alias(key)).agg(F.sum("copies").alias("sum"), F.count(F.lit(1)).alias("n")).filter("sum > 0")
    per_key = per_key.select(key, F.floor(F.col("sum") / F.col("n")).alias(each), (F.col("sum") % F.col("n")).alias(more))
    per_key = written(per_key, "mix-copies")  # written, so that the join with a row that many repeat is a plain one, which Spark splits
    rows = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text")))
    repeated = lambda df, times: df.withColumn(times, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(times)))).select(*docs.columns)
    evenly = repeated(rows.join(per_key.filter(F.col(each) > 0), key), each)
    left = per_key.filter(F.col(more) > 0).select(key, more)
    return evenly.unionByName(repeated(rows.join(left, key).dropDuplicates([key]), more))
