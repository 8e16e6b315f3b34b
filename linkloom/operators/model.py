"""Gradient-boosted scoring with Spark ML."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.context import top_by
from linkloom.operators.labels import fold_of

SEED = 7


def _vector(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(df)


def fit(df: DataFrame, features: list[str], rounds: int = 100, depth: int = 7, validation: str | None = None, least: int = 100) -> GBTClassificationModel:
    """A binary model of ``y``; with ``validation``, a boolean column, boosting stops when those rows gain no more."""
    gbt = GBTClassifier(featuresCol="_x", labelCol="_label", stepSize=0.08, maxDepth=depth, minInstancesPerNode=least, subsamplingRate=0.8, featureSubsetStrategy="0.8", maxIter=rounds, seed=SEED, maxMemoryInMB=512)
    rows = _vector(df, features).withColumn("_label", F.col("y").cast("double"))
    if validation is not None:
        gbt = gbt.setValidationIndicatorCol(validation)
    keep = ["_x", "_label", *([validation] if validation else [])]
    return gbt.fit(rows.select(*keep))


def score(model: GBTClassificationModel, df: DataFrame, features: list[str], into: str) -> DataFrame:
    scored = model.setProbabilityCol("_prob").transform(_vector(df, features))
    return scored.withColumn(into, F.element_at(vector_to_array("_prob"), 2)).select(*df.columns, into)


def out_of_fold(df: DataFrame, features: list[str], rounds: int, folds: int = 3, **how) -> DataFrame:
    """``df`` with ``oof``: each left record scored by a model that never saw it."""
    df = df.withColumn("_fold", fold_of("i", folds))
    out = None
    for f in range(folds):
        model = fit(df.where(F.col("_fold") != f), features, rounds, **how)
        part = score(model, df.where(F.col("_fold") == f), features, "oof")
        out = part if out is None else out.unionByName(part)
    return out.drop("_fold")


def prune(scored: DataFrame, tau: float, k: int = 12, override: str | None = None) -> DataFrame:
    """Pairs of p2 (or its override, where there is one) of at least tau, at most k for each i."""
    if override is not None:
        scored = scored.withColumn("p2", F.coalesce(F.when(~F.isnan(override), F.col(override)), F.col("p2")))
    return top_by(scored.where(F.col("p2") >= tau), k)


def importance(model: GBTClassificationModel, features: list[str], k: int = 25) -> list[tuple[str, float]]:
    gains = zip(features, model.featureImportances.toArray().tolist(), strict=True)
    return sorted(gains, key=lambda x: -x[1])[:k]
