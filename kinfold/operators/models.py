"""Boosted trees, isotonic calibration, cross-fitting and prior shift."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.operators.sampling import folds

#: Rows that a country needs for a calibrator of its own.
LEAST_ROWS = 5000
#: Steps of probability that histograms tell apart.
BINS = 10_000


@dataclass
class Trees:
    """A boosted-tree classifier of named columns."""

    columns: list[str]
    trees: int = 50
    depth: int = 6
    rate: float = 0.05
    subsample: float = 0.8
    column_share: str = "0.8"
    least_rows: int = 50
    bins: int = 63
    seed: int = 0
    model: PipelineModel | None = field(default=None, repr=False)

    def fit(self, df: DataFrame, label: str, weight: str | None = None, validate: str | None = None) -> Trees:
        """Train on ``df``; rows where the boolean ``validate`` holds only stop the training."""
        vector = VectorAssembler(inputCols=self.columns, outputCol="__x", handleInvalid="keep")
        gbt = GBTClassifier(
            featuresCol="__x", labelCol=label, maxIter=self.trees, maxDepth=self.depth, stepSize=self.rate, subsamplingRate=self.subsample,
            featureSubsetStrategy=self.column_share, minInstancesPerNode=self.least_rows, maxBins=self.bins, seed=self.seed, predictionCol="__p",
        )
        gbt = gbt.setRawPredictionCol("__r").setProbabilityCol("__q")
        if weight:
            gbt = gbt.setWeightCol(weight)
        if validate:
            gbt = gbt.setValidationIndicatorCol(validate)
        self.model = Pipeline(stages=[vector, gbt]).fit(df.withColumn(label, F.col(label).cast("double")))
        return self

    def predict(self, df: DataFrame, name: str = "prob") -> DataFrame:
        out = self.model.transform(df).withColumn(name, vector_to_array(F.col("__q"))[1])
        return out.drop("__x", "__r", "__q", "__p")

    def importances(self, top: int = 15) -> list[tuple[str, float]]:
        values = self.model.stages[-1].featureImportances.toArray()
        return sorted(zip(self.columns, map(float, values), strict=True), key=lambda p: (-p[1], p[0]))[:top]

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    def load(self, path: str) -> Trees:
        self.model = PipelineModel.load(path)
        return self


def judge(df: DataFrame, columns: list[str], label: str) -> PipelineModel:
    """A logistic judge of pair features, where no cross-encoder can run; its raw score stands for the logit."""
    steps = [VectorAssembler(inputCols=columns, outputCol="__x", handleInvalid="keep"), LogisticRegression(featuresCol="__x", labelCol=label, predictionCol="__p", rawPredictionCol="__r", probabilityCol="__q", regParam=1e-3)]
    return Pipeline(stages=steps).fit(df.withColumn(label, F.col(label).cast("double")))


def judged(pairs: DataFrame, model: PipelineModel, low: float = 0.03, high: float = 0.97, prob: str = "prob") -> DataFrame:
    """``pairs`` with ce_logit and ce_run: only uncertain pairs are judged, others hold 0 and 0."""
    gated = F.col(prob).between(low, high)
    some = model.transform(pairs.where(gated)).withColumn("ce_logit", vector_to_array(F.col("__r"))[1]).withColumn("ce_run", F.lit(1)).drop("__x", "__r", "__q", "__p")
    rest = pairs.where(~F.coalesce(gated, F.lit(False))).withColumn("ce_logit", F.lit(0.0)).withColumn("ce_run", F.lit(0))
    return some.unionByName(rest)


@dataclass
class Calibrator:
    """Isotonic curves: one for all, and one for every country with enough rows of both classes."""

    least_rows: int = LEAST_ROWS
    curves: dict[str | None, tuple[list[float], list[float]]] = field(default_factory=dict)

    def fit(self, df: DataFrame, prob: str, label: str, country: str | None = "country") -> Calibrator:
        """Probabilities are counted in steps of 1 / BINS first, so the fit sees at most BINS rows of a country."""
        step = (F.round(F.col(prob) * BINS) / BINS).alias("p")
        key = F.col(country) if country else F.lit(None).cast("string")
        bins = df.groupBy(key.alias("k"), step).agg(F.avg(F.col(label).cast("double")).alias("y"), F.count("*").cast("double").alias("w"), F.sum(F.col(label).cast("double")).alias("s"))
        bins = bins.cache()
        total = bins.groupBy("k").agg(F.sum("w").alias("n"), F.sum("s").alias("s")).collect()
        own = [r["k"] for r in total if r["k"] is not None and r["n"] >= self.least_rows and 0 < r["s"] < r["n"]]
        self.curves = {None: self._curve(bins)} | {k: self._curve(bins.where(F.col("k") == k)) for k in own}
        bins.unpersist()
        return self

    @staticmethod
    def _curve(bins: DataFrame) -> tuple[list[float], list[float]]:
        model = IsotonicRegression(featuresCol="p", labelCol="y", weightCol="w").fit(bins)
        return list(map(float, model.boundaries.toArray())), list(map(float, model.predictions.toArray()))

    def apply(self, prob: Column, country: Column) -> Column:
        """Calibrated probabilities; unknown countries use the common curve, values beyond its ends the ends."""
        curves = {k: (np.array(x), np.array(y)) for k, (x, y) in self.curves.items()}

        @F.pandas_udf(T.DoubleType())
        def run(p: pd.Series, k: pd.Series) -> pd.Series:
            out = np.interp(p, *curves[None])
            for name, curve in curves.items():
                if name is not None:
                    out = np.where(k == name, np.interp(p, *curve), out)
            return pd.Series(out)

        return run(prob, country)


    def state(self) -> dict:
        """The curves as plain lists; the common one under the empty name."""
        return {k or "": [list(x), list(y)] for k, (x, y) in self.curves.items()}

    @classmethod
    def of_state(cls, state: dict) -> Calibrator:
        return cls(curves={k or None: (x, y) for k, (x, y) in state.items()})


def rescaled(p: Column, old: float, new: float) -> Column:
    """A probability moved from one share of positives to another: its odds times the ratio of the shares' odds."""
    ratio = new / (1 - new) * (1 - old) / old
    return F.lit(ratio) * p / (1 + F.lit(ratio - 1) * p)


def em_prior(df: DataFrame, prob: str, trained: float, steps: int = 100, tolerance: float = 1e-6) -> float:
    """The share of positives that the probabilities imply, by expectation-maximisation over their histogram."""
    clipped = F.least(F.greatest(F.col(prob), F.lit(1e-6)), F.lit(1 - 1e-6))
    bins = df.groupBy((F.round(clipped * BINS) / BINS).alias("b")).agg(F.avg(clipped).alias("p"), F.count("*").alias("n")).collect()
    seen, rows = (np.array([r[c] for r in bins], float) for c in ("p", "n"))
    odds = seen / (1 - seen) * (1 - trained) / trained  # what a row says beside the share
    share = trained
    for _ in range(steps):
        moved = odds * share / (1 - share)
        implied = float(np.average(moved / (1 + moved), weights=rows)) if len(rows) else share
        if abs(implied - share) < tolerance:
            break
        share = implied
    return share


def prior_shift(df: DataFrame, trained: float, prob: str = "prob") -> DataFrame:
    """``df`` with probabilities moved to the share of positives that they imply."""
    return df.withColumn(prob, F.round(rescaled(F.col(prob), trained, em_prior(df, prob, trained)), 6))


def cross_fit(df: DataFrame, make, label: str, ids: list[str], name: str = "prob_oof") -> tuple[DataFrame, list[Trees]]:
    """Out-of-fold probabilities of two models, each trained on the other fold of ``ids``."""
    split = folds(df, *ids)
    models = [make().fit(split.where(F.col("fold") != k), label) for k in (0, 1)]
    parts = [models[k].predict(split.where(F.col("fold") == k), name) for k in (0, 1)]
    return parts[0].unionByName(parts[1]), models


def bagged(df: DataFrame, models: list[Trees], name: str = "prob") -> DataFrame:
    """The mean of the models' probabilities."""
    out = df
    for i, m in enumerate(models):
        out = m.predict(out, f"__b{i}")
    mean = sum((F.col(f"__b{i}") for i in range(len(models))), F.lit(0.0)) / len(models)
    return out.withColumn(name, mean).drop(*(f"__b{i}" for i in range(len(models))))


def _loss(prob: str, label: str) -> Column:
    """A row's log loss; null without a label or a probability. Probabilities are held 1e-7 from 0 and 1, where one wrong row would make all infinite."""
    p = F.least(F.greatest(F.col(prob), F.lit(1e-7)), F.lit(1 - 1e-7))
    return F.when(F.col(prob).isNotNull() & ~F.isnan(prob), -(F.col(label) * F.log(p) + (1 - F.col(label)) * F.log(1 - p)))


def log_loss(df: DataFrame, prob: str, label: str, *by: str, before: str | None = None) -> DataFrame:
    """log_loss, prior and n of the rows that have a label and a probability; with ``before``, log_loss_before is that of another probability of the same rows."""
    loss = _loss(prob, label)
    mean = lambda c: F.round(F.avg(F.when(loss.isNotNull(), c)), 6)
    also = [mean(_loss(before, label)).alias("log_loss_before")] if before else []
    return df.groupBy(*by).agg(mean(loss).alias("log_loss"), *also, mean(F.col(label).cast("double")).alias("prior"), F.count(loss).alias("n"))
