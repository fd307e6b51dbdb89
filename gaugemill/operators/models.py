"""Models: a fixed stub scorer, MLlib candidates with isotonic calibration, champion choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import hash_uniform
from ..sources.tables import MODEL_FEATURES, TARGET
from .rules import c


class LabelLeakageError(ValueError):
    pass


def guard_features(df: DataFrame, features=MODEL_FEATURES) -> None:
    """Refuses a frame that holds the target, and one that lacks a feature."""
    if TARGET in df.columns:
        raise LabelLeakageError(f"{TARGET} must not be there when scoring")
    if gone := [x for x in features if x not in df.columns]:
        raise KeyError(f"missing features: {gone}")


def stub_score(u: Column) -> Column:
    """Logistic in one value in (0, 1): a deterministic stand-in for a model."""
    return 1.0 / (1.0 + F.exp(-(4.0 * u - 2.0)))


def class_ratio(df: DataFrame, y: str = "y") -> DataFrame:
    return df.agg((F.count_if(c(y) == 0) / F.count_if(c(y) == 1)).alias("neg_pos"), F.count(F.lit(1)).alias("rows"))


def assemble(matrix: DataFrame, features=MODEL_FEATURES) -> DataFrame:
    """Adds the vector; column names with signs are quoted away first."""
    from pyspark.ml.feature import VectorAssembler

    names = [f"f{i}" for i in range(len(features))]
    plain = matrix.select("*", *[c(x).cast("double").alias(n) for x, n in zip(features, names, strict=True)])
    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="error").transform(plain).drop(*names)


def _weighted(train: DataFrame) -> DataFrame:
    """Rows with the weights of their classes, in partitions of ``FIT_ROWS`` rows or more where they are few: each level of each
    tree is a job over all partitions."""
    ratio, rows = class_ratio(train).first()
    return train.withColumn("y", c("y").cast("double")).withColumn("w", F.when(c("y") == 1, float(ratio or 1.0)).otherwise(1.0)).coalesce(max(1, rows // FIT_ROWS))


#: Rows of a partition that is fitted on, where there are as many.
FIT_ROWS = 1 << 14
#: Fixed value: the trees of the boosted candidate.
TREES = 400


def _boosted(seed: int, trees: int):
    from pyspark.ml.classification import GBTClassifier

    return GBTClassifier(labelCol="y", weightCol="w", maxIter=trees, maxDepth=4, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed)


def fit_boosted(train: DataFrame, seed: int = 20260920, trees: int = TREES):
    """The boosted trees of ``fit_candidates`` alone. Each tree's errors stand on those of the trees before: with a folder for
    checkpoints Spark cuts that chain every ten trees."""
    return _boosted(seed, trees).fit(_weighted(train))


def fit_candidates(train: DataFrame, seed: int = 20260920, trees: int = TREES) -> dict:
    """Balanced logistic regression on scaled features, and gradient-boosted trees. ``train`` has y and features."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler

    weighted = _weighted(train)
    logistic = Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True), LogisticRegression(featuresCol="scaled", labelCol="y", weightCol="w", maxIter=100)])
    return {"logistic": logistic.fit(weighted), "boosted": _boosted(seed, trees).fit(weighted)}


def scores(model, df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(df).withColumn("p", vector_to_array("probability")[1]).drop("prediction", "rawPrediction", "probability")


def calibrate(model, part: DataFrame):
    """Isotonic regression of y on the frozen model's score, on a part it was not trained on."""
    from pyspark.ml.regression import IsotonicRegression

    return IsotonicRegression(featuresCol="p", labelCol="y").fit(scores(model, part).select("p", c("y").cast("double").alias("y")))


def calibrated(model, isotonic, df: DataFrame) -> DataFrame:
    return isotonic.transform(scores(model, df)).withColumn("p", F.col("prediction")).drop("prediction")


def gain_shares(model, features=MODEL_FEATURES) -> dict[str, float]:
    """Normalised gains; equal shares where the model tells none."""
    found = getattr(model, "featureImportances", None)
    values = found.toArray().tolist() if found is not None else []
    total = sum(values)
    return {f: v / total for f, v in zip(features, values, strict=True)} if total else {f: 1 / len(features) for f in features}


def gain_table(model, spark, features=MODEL_FEATURES) -> DataFrame:
    """``feature, gain_share``: one row for each feature."""
    return spark.createDataFrame(sorted(gain_shares(model, features).items()), "feature string, gain_share double")


def refits(train: DataFrame, test: DataFrame, seeds: list[int], trees: int = TREES, at_once: int = 4) -> DataFrame:
    """``model, seed, auc``: both candidates fitted anew for each seed on a part of ``train`` (four of five rows by a hash of
    the seed and ``row_id``) and measured on ``test``. Fits share the cached matrices and run a few at a time; each gives one row."""
    from concurrent.futures import ThreadPoolExecutor

    from .metrics import ranking

    train, test = train.persist(), test.persist()
    try:
        train.count(), test.count()

        def fit(seed: int) -> list[tuple]:
            part = train.where(hash_uniform(f"refit:{seed}", "row_id") < 0.8)
            return [(name, seed, ranking(scores(m, test).select("y", "p")).first()["auc"]) for name, m in fit_candidates(part, seed, trees).items()]

        with ThreadPoolExecutor(at_once) as pool:
            rows = [r for rs in pool.map(fit, seeds) for r in rs]
    finally:
        train.unpersist()
        test.unpersist()
    return train.sparkSession.createDataFrame(rows, "model string, seed int, auc double")
