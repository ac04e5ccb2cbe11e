"""A training loop of a class-weighted softmax model, one aggregation per update.

An epoch deals its windows to batches in a seeded order of its own and takes its
decayed rate; batches are taken in ``rounds`` of consecutive ones. The gradient
of a round is the mean over its batches of each batch's weighted mean gradient, so with as
many rounds as batches this is mini-batch descent, and with one round an epoch is a
single job. Sums are taken per window first: a window's pixels lie together in the
kept table, and only window sums meet the batch numbers. After each epoch the
validation loss goes through the early-stop fold, which decides on the end and on the
weights that are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.scalar import softmax
from tessella.operators import split
from tessella.operators.earlystop import early_stop
from tessella.operators.metrics import CLASSES, valid
from tessella.params import Stopping, Training
from tessella.sources.scratch import kept


@dataclass(frozen=True)
class Softmax:
    """Linear scores per class."""

    bands: tuple[str, ...]
    weights: tuple[tuple[float, ...], ...]
    bias: tuple[float, ...]

    @classmethod
    def zero(cls, bands: list[str], classes: int = len(CLASSES)) -> Softmax:
        return cls(tuple(bands), tuple(tuple(0.0 for _ in bands) for _ in range(classes)), (0.0,) * classes)

    def expression(self) -> str:
        """The scores before softmax, as an array in SQL."""
        terms = lambda row, b: " + ".join([f"{b!r}D", *(f"{w!r}D * `{x}`" for w, x in zip(row, self.bands, strict=True))])
        return f"array({', '.join(terms(row, b) for row, b in zip(self.weights, self.bias, strict=True))})"

    def score(self, pixels: DataFrame, prefix: str = "p") -> DataFrame:
        """Adds the class probabilities as prefix0, prefix1, ..."""
        out = pixels.withColumn("scores__", softmax(F.expr(self.expression())))
        return out.withColumns({f"{prefix}{k}": F.get("scores__", F.lit(k)) for k in range(len(self.bias))}).drop("scores__")

    def moved(self, gradient: dict[str, float], rate: float) -> Softmax:
        step = lambda v, name: v - rate * (gradient[name] or 0.0)
        weights = tuple(tuple(step(w, f"g{k}_{j}") for j, w in enumerate(row)) for k, row in enumerate(self.weights))
        return Softmax(self.bands, weights, tuple(step(b, f"g{k}") for k, b in enumerate(self.bias)))


def window_sums(rows: DataFrame, model: Softmax, training: Training, gradient: bool = True) -> DataFrame:
    """Per window (wid): the sums of weights, weighted losses, hits per class and, if asked, of the weighted gradient."""
    weight = " ".join(f"WHEN {k} THEN {float(w)!r}D" for k, w in training.class_weights.items())
    classes = range(len(model.bias))
    rows = valid(rows).selectExpr("wid", "int(y) AS y__", f"CASE int(y) {weight} END AS w__", f"{model.expression()} AS z__", *[f"`{b}` AS x{j}__" for j, b in enumerate(model.bands)])
    rows = rows.selectExpr("*", "array_max(z__) AS peak__", "int(array_position(z__, array_max(z__)) - 1) AS pred__")
    rows = rows.selectExpr("*", f"ln({' + '.join(f'exp(z__[{k}] - peak__)' for k in classes)}) + peak__ AS log_sum__")
    wrong = [f"w__ * (exp(z__[{k}] - log_sum__) - if(y__ = {k}, 1D, 0D)) AS e{k}__" for k in classes] if gradient else []
    rows = rows.selectExpr("*", "w__ * (log_sum__ - get(z__, y__)) AS loss__", *wrong)
    sums = ["sum(w__) AS w", "sum(loss__) AS loss"]
    for k in classes:
        sums += [f"count_if(pred__ = {k} AND y__ = {k}) AS tp{k}", f"count_if(pred__ = {k} AND y__ <> {k}) AS fp{k}", f"count_if(pred__ <> {k} AND y__ = {k}) AS fn{k}"]
        if gradient:
            sums += [f"sum(e{k}__) AS g{k}", *[f"sum(e{k}__ * x{j}__) AS g{k}_{j}" for j in range(len(model.bands))]]
    return rows.groupBy("wid").agg(*map(F.expr, sums))


def _batch_means(sums: DataFrame, batches: DataFrame, classes: int) -> DataFrame:
    """One row: means over batches of the weighted means, and of the macro F1; and the number of batches."""
    names = [c for c in sums.columns if c not in ("wid", "w")]
    per = sums.join(batches, "wid").groupBy("batch").agg(*[F.expr(f"sum({c}) AS {c}") for c in ("w", *names)])
    means = [f"avg(try_divide({c}, w)) AS {c}" for c in names if c == "loss" or c.startswith("g")]
    f1 = " + ".join(f"if(2 * tp{k} + fp{k} + fn{k} > 0, 2 * tp{k} / (2 * tp{k} + fp{k} + fn{k}), 0D)" for k in range(classes))
    return per.agg(*map(F.expr, [*means, f"avg(({f1}) / {classes}) AS f1", "count(1) AS n"]))


@dataclass(frozen=True)
class Trained:
    """The weights of the best epoch (of the last one while none counts), and a row per epoch: epoch, lr, train_loss, val_loss, val_f1."""

    model: Softmax
    log: DataFrame
    best_epoch: int | None
    stop_epoch: int | None


def train_epochs(
    train: DataFrame, validation: DataFrame, bands: list[str], training: Training = Training(), rule: Stopping = Stopping(), seed: int = 42, rounds: int = 1
) -> Trained:
    """Trains on pixel rows (wid, y, bands) of training windows, judged on those of validation windows.

    Rows are kept once, in the order of windows. At most ``training.max_epochs`` epochs; a
    validation table without valid pixels raises, as nothing could be judged.
    """
    spark = train.sparkSession
    order = lambda df, name: kept(df.select("wid", "y", *bands).repartition("wid").sortWithinPartitions("wid"), name)
    train, validation = order(train, "training"), order(validation, "validation")
    if valid(validation).isEmpty() or valid(train).isEmpty():
        raise ValueError("training and validation need valid pixels")
    windows, held = kept(train.select("wid").distinct(), "windows"), validation.select("wid").distinct()
    held = kept(split.batched(split.ranked(held, split.shuffle_key(seed, F.col("wid"))), training.batch_size).select("wid", "batch"), "held-batches")
    model, models, log, end = Softmax.zero(bands), {}, [], None
    for epoch in range(1, training.max_epochs + 1):
        rate = training.learning_rate * training.gamma ** (epoch - 1)
        batches = split.ranked(windows, split.shuffle_key(f"{seed}:{epoch}", F.col("wid")))
        n_batches = F.ceil(F.col("total") / float(training.batch_size))
        batches = split.batched(batches, training.batch_size).select("wid", "batch", F.floor(F.col("batch") * rounds / n_batches).alias("round"))
        batches = kept(batches, "batches") if rounds > 1 else batches
        losses = []
        for r in range(rounds):
            mine = batches.filter(F.col("round") == r).select("wid", "batch")
            rows = train.join(mine.select("wid"), "wid", "left_semi") if rounds > 1 else train
            found = _batch_means(window_sums(rows, model, training), mine, len(CLASSES)).first().asDict()
            if found["n"]:
                model = model.moved(found, rate)
                losses.append((found["loss"] or 0.0, found["n"]))
        judged = _batch_means(window_sums(validation, model, training, gradient=False), held, len(CLASSES)).first()
        models[epoch] = model
        log.append((epoch, rate, sum(v * n for v, n in losses) / sum(n for _, n in losses), judged["loss"], judged["f1"]))
        epochs = spark.createDataFrame([("", e, v) for e, _, _, v, _ in log], "experiment string, epoch bigint, val_loss double")
        end = early_stop(epochs.coalesce(1), "experiment", rule).first()
        models = {e: m for e, m in models.items() if e in (end["best_epoch"], epoch)}  # only the best so far can still be the result
        if end["stop_epoch"] is not None:
            break
    rows = spark.createDataFrame(log, "epoch bigint, lr double, train_loss double, val_loss double, val_f1 double")
    return Trained(models[end["best_epoch"] or epoch], rows, end["best_epoch"], end["stop_epoch"])
