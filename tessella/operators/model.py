"""Pixel classifiers: fixed scorers, and weighted models trained with MLlib."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.scalar import softmax
from tessella.params import IGNORE, Experiment, Training


def logits(bands: list[str], weights: dict[int, list[float]], bias: dict[int, float]) -> Column:
    """Linear scores, one per class."""
    terms = []
    for k in sorted(weights):
        z = F.lit(bias[k])
        for b, w in zip(bands, weights[k], strict=True):
            z = z + F.lit(w) * F.col(b)
        terms.append(z)
    return F.array(*terms)


def linear_scores(pixels: DataFrame, bands: list[str], weights: dict[int, list[float]], bias: dict[int, float], prefix: str = "p") -> DataFrame:
    """Adds the soft-maxed scores as prefix0, prefix1, ..."""
    out = pixels.withColumn("scores__", softmax(logits(bands, weights, bias)))
    return out.withColumns({f"{prefix}{i}": F.get("scores__", F.lit(i)) for i in range(len(weights))}).drop("scores__")


def late_fusion(a: DataFrame, b: DataFrame, stacker: Callable[[list[str]], Column]) -> DataFrame:
    """Joins the per-pixel scores (idx, a0, a1) and (idx, b0, b1) of two models and applies the stacker's logits."""
    both = a.join(b, "idx")
    names = [c for c in both.columns if c != "idx"]
    return both.withColumn("p", softmax(stacker(names)))


@dataclass(frozen=True)
class Setting:
    """Feature columns of an experiment, and what learns from them."""

    features: list[str]
    estimator: Callable[[], Estimator]


OPTICAL = ["b0", "b1", "b2", "b3"]
LIDAR = ["l0", "l1"]


def setting(e: Experiment, optical: list[str] = OPTICAL, lidar: list[str] = LIDAR) -> Setting:
    """The registry: optical bands alone, or with the LiDAR bands that the experiment takes."""
    chosen = lidar if e.lidar_bands is None else [lidar[i] for i in e.lidar_bands]
    features = {"optical": optical, "early": optical + chosen}  # late fusion has a model per source: fit_late
    if e.fusion not in features:
        raise ValueError(f"no single model has the fusion {e.fusion}")
    return Setting(features[e.fusion], lambda: LogisticRegression(weightCol="weight", labelCol="y", maxIter=25, regParam=1e-4))


def fit(pixels: DataFrame, features: list[str], training: Training = Training(), estimator: Estimator | None = None) -> PipelineModel:
    """A class-weighted classifier of pixels with label y, the ignored one left out."""
    weights = F.create_map(*[F.lit(x) for k, w in training.class_weights.items() for x in (k, w)])
    rows = pixels.filter(F.col("y") != IGNORE).withColumn("weight", F.element_at(weights, F.col("y").cast("int")))
    learner = estimator or LogisticRegression(weightCol="weight", labelCol="y", maxIter=25, regParam=1e-4)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), learner]).fit(rows)


def score(model: PipelineModel, pixels: DataFrame, prefix: str = "p", classes: int = 2) -> DataFrame:
    out = model.transform(pixels).withColumn("scores__", vector_to_array("probability"))
    drop = ["features", "rawPrediction", "probability", "prediction", "scores__"]
    return out.withColumns({f"{prefix}{i}": F.get("scores__", F.lit(i)) for i in range(classes)}).drop(*drop)


@dataclass(frozen=True)
class LateFusion:
    """A model per source, and one over their scores."""

    optical: PipelineModel
    lidar: PipelineModel
    stacker: PipelineModel

    def towers(self, pixels: DataFrame) -> DataFrame:
        return score(self.lidar, score(self.optical, pixels, "o"), "l_")

    def score(self, pixels: DataFrame) -> DataFrame:
        return score(self.stacker, self.towers(pixels)).drop("o0", "o1", "l_0", "l_1")


def fit_late(pixels: DataFrame, optical: list[str], lidar: list[str], training: Training = Training()) -> LateFusion:
    """Trains each source by itself, then the stacker on both sources' scores."""
    a, b = fit(pixels, optical, training), fit(pixels, lidar, training)
    scored = score(b, score(a, pixels, "o"), "l_")
    return LateFusion(a, b, fit(scored, ["o0", "o1", "l_0", "l_1"], training))


def score_batches(pixels: DataFrame, bands: list[str], scorer: Callable[[np.ndarray], np.ndarray], keys: list[str], classes: int = 2) -> DataFrame:
    """Scores by a function over arrays (rows, bands) -> (rows, classes), batch by batch."""
    fields = [f"{k} {pixels.schema[k].dataType.simpleString()}" for k in keys] + [f"p{i} double" for i in range(classes)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = scorer(b[bands].to_numpy(dtype=float))
            yield pd.concat([b[keys].reset_index(drop=True), pd.DataFrame(p, columns=[f"p{i}" for i in range(classes)])], axis=1)

    return pixels.select(*keys, *bands).mapInPandas(run, ", ".join(fields))

