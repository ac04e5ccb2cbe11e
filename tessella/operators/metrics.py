"""Evaluation of predicted classes, and of training logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.scalar import ratio
from tessella.params import IGNORE

CLASSES = (0, 1)


def valid(pairs: DataFrame) -> DataFrame:
    """Pairs (y, pred) whose label isn't the ignored one."""
    return pairs.filter(F.col("y") != IGNORE)


def class_counts(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per class k (and group): tp, fp, fn, tn, and the pairs, valid and in total. One pass."""
    ok = F.col("y") != IGNORE
    y, p = F.col("y"), F.col("pred")
    aggs = [F.count_if(ok).alias("n_valid"), F.count(F.lit(1)).alias("n_total")]
    for k in CLASSES:
        hit = {"tp": (p == k) & (y == k), "fp": (p == k) & (y != k), "fn": (p != k) & (y == k), "tn": (p != k) & (y != k)}
        aggs += [F.count_if(ok & c).alias(f"{n}{k}") for n, c in hit.items()]
    wide = pairs.groupBy(*(by or [])).agg(*aggs)
    rows = [F.struct(F.lit(k).cast("bigint").alias("k"), *[F.col(f"{n}{k}").alias(n) for n in ("tp", "fp", "fn", "tn")]) for k in CLASSES]
    return wide.select(*(by or []), F.inline(F.array(*rows)), "n_valid", "n_total")


def scores(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, f1, accuracy and support to tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    out = counts.withColumns({"precision": precision, "recall": recall, "support": tp + fn})
    out = out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.withColumn("accuracy", F.try_divide(tp + tn, tp + fp + fn + tn))


def report(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    return scores(class_counts(pairs, by))


def report_lines(pairs: DataFrame, names: tuple[str, ...] = ("background", "foreground")) -> DataFrame:
    """(line, text): the evaluation as a text, with thousands separators and shares as percent of two digits."""
    whole = lambda c: F.format_number(c.cast("bigint"), 0)
    share = lambda c: F.format_string("%.2f%%", F.round(100 * F.col(c), 2))
    per = report(pairs).withColumn("name", F.get(F.array(*map(F.lit, names)), F.col("k").cast("int")))
    n, all_n = F.first("n_valid"), F.first("n_total")
    first = per.agg(F.lit(0).cast("bigint").alias("line"), F.concat(F.lit("Valid pixels: "), whole(n), F.lit(" / "), whole(all_n)).alias("text"))
    text = F.concat(
        F.lpad("name", 12, " "), F.lit(": Acc="), share("accuracy"), F.lit("  F1="), share("f1"), F.lit("  Prec="), share("precision"),
        F.lit("  Rec="), share("recall"), F.lit("  Samples="), whole(F.col("support")),
    )
    cell = lambda c: whole(F.first(F.when(F.col("k") == 1, F.col(c)), ignorenulls=True))
    matrix = F.concat(F.lit("TN="), cell("tn"), F.lit("  FP="), cell("fp"), F.lit("  FN="), cell("fn"), F.lit("  TP="), cell("tp"))
    rows = first.unionByName(per.select((F.col("k") + 1).alias("line"), text.alias("text")))
    return rows.unionByName(per.agg(F.lit(len(names) + 1).cast("bigint").alias("line"), matrix.alias("text")))


def confusion_matrix(pairs: DataFrame) -> DataFrame:
    """Rows are labels, columns predictions; values outside the classes don't count."""
    y, p = F.col("y"), F.col("pred")
    cells = [F.count_if((y == a) & (p == b)).alias(f"c{a}{b}") for a in CLASSES for b in CLASSES]
    rows = [F.struct(F.lit(a).cast("bigint").alias("y"), *[F.col(f"c{a}{b}").alias(f"pred_{b}") for b in CLASSES]) for a in CLASSES]
    return valid(pairs).agg(*cells).select(F.inline(F.array(*rows)))


def class_report(pairs: DataFrame) -> DataFrame:
    """Per class precision, recall, f1 and support; accuracy; macro and weighted averages; four digits."""
    per = report(pairs)
    rows = per.select(F.col("k").cast("string").alias("label"), "precision", "recall", "f1", "support")
    measures = ("precision", "recall", "f1")
    total = F.sum("support")
    macro = rows.agg(F.lit("macro avg").alias("label"), *[F.avg(c).alias(c) for c in measures], total.alias("support"))
    weighted = rows.agg(F.lit("weighted avg").alias("label"), *[(F.sum(F.col(c) * F.col("support")) / total).alias(c) for c in measures], total.alias("support"))
    accuracy = per.agg(F.lit("accuracy").alias("label"), *[F.first("accuracy").alias(c) for c in measures], total.alias("support"))
    out = rows.unionByName(accuracy).unionByName(macro).unionByName(weighted)
    return out.withColumns({c: F.round(c, 4) for c in measures})


def distinct_classes(labels: DataFrame, column: str = "y") -> DataFrame:
    return labels.agg(F.countDistinct(column).alias("n_classes"))


def epoch_mean(log: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean over an epoch's batches of each batch's mean, whatever the batch sizes."""
    per = log.groupBy(*by, "epoch_group", "batch").agg(F.avg(value).alias("batch_mean"))
    return per.groupBy(*by, "epoch_group").agg(F.avg("batch_mean").alias("mean"), F.count(F.lit(1)).alias("n_batches"))


def batch_f1(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Mean over batches of each batch's macro F1, the ignored label left out."""
    per = report(pairs, [*by, "batch"]).groupBy(*by, "batch").agg(F.avg("f1").alias("f1"))
    return per.groupBy(*by).agg(F.avg("f1").alias("f1"))


def running_mean(log: DataFrame, value: str, by: list[str], order: str = "batch") -> DataFrame:
    """Adds the mean so far, as a progress line shows it."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return log.withColumn("running", F.avg(value).over(w))


def learning_rates(epochs: DataFrame, rate: float, gamma: float) -> DataFrame:
    """Adds the exponentially decayed rate of each epoch, from 1."""
    return epochs.withColumn("lr", F.lit(rate) * F.pow(F.lit(gamma), (F.col("epoch") - 1).cast("double")))


def weighted_cross_entropy(rows: DataFrame, inputs: Column, weights: dict[int, float], by: list[str] | None = None) -> DataFrame:
    """Class-weighted mean of -log softmax(inputs)[y], the ignored label left out.

    ``inputs`` is an array of logits. Probabilities given as such are soft-maxed
    again, which is what the workflow this follows does.
    """
    weight = F.element_at(F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, w)]), F.col("y").cast("int"))
    peak = F.array_max(inputs)
    log_sum = F.log(F.aggregate(F.transform(inputs, lambda v: F.exp(v - peak)), F.lit(0.0), lambda a, x: a + x)) + peak
    loss = log_sum - F.get(inputs, F.col("y").cast("int"))
    rows = valid(rows).withColumns({"w": weight, "loss": loss})
    return rows.groupBy(*(by or [])).agg((F.sum(F.col("w") * F.col("loss")) / F.sum("w")).alias("loss"))
