"""Text classifier job (X4, X5, X6, S11), re-aimed from a fine-tuned transformer to a Spark ML
pipeline: words -> hashed term frequencies -> IDF -> multinomial logistic regression.

Fitting is distributed (IDF and the gradient are tree-aggregated over partitions); nothing is
collected except the evaluator's scalar metrics.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.operators.textprep import TOKEN_SPLIT
from cohortkit.session import materialize

WEIGHT_DECAY = 0.01
EPOCHS = 3


def classifier(max_iter: int = EPOCHS, reg: float = WEIGHT_DECAY, num_features: int = 1 << 18) -> Pipeline:
    return Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="words", pattern=TOKEN_SPLIT, gaps=True, toLowercase=True),
        HashingTF(inputCol="words", outputCol="tf", numFeatures=num_features),
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="label", family="multinomial", regParam=reg,
                           maxIter=max_iter),
    ])


METRICS = {"accuracy": "accuracy", "weightedFMeasure": "weighted_f1", "logLoss": "log_loss"}


def _metrics(pred: DataFrame) -> dict:
    """The metrics of one prediction frame, which is computed once."""
    pred = materialize(pred.select("label", "prediction", "probability"))
    return {name: MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction", probabilityCol="probability",
                                                    metricName=m).evaluate(pred) for m, name in METRICS.items()}


def fit_evaluate(spark: SparkSession, split: DataFrame, max_iter: int = EPOCHS) -> tuple[PipelineModel, DataFrame]:
    """Fit on ``is_test = false`` rows; the model, and accuracy, weighted F1 and log loss per split.
    ``split`` should be materialized."""
    train = split.filter(~F.col("is_test"))
    model = classifier(max_iter).fit(train)
    counts = {r["is_test"]: r["n"] for r in split.groupBy("is_test").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = []
    for name, is_test in (("train", False), ("test", True)):
        if counts.get(is_test):
            m = _metrics(model.transform(split.filter(F.col("is_test") == is_test)))
            rows.append((name, counts[is_test], m["accuracy"], m["weighted_f1"], m["log_loss"]))
    return model, spark.createDataFrame(rows, "split string, n_rows long, accuracy double, weighted_f1 double, log_loss double")


def fit_best(spark: SparkSession, split: DataFrame, grid=(1, 2, EPOCHS)) -> tuple[PipelineModel, DataFrame]:
    """Fit with each number of passes and evaluate on the test rows; the model of the lowest log loss (ties: fewer
    passes), and the scores with ``is_best`` (X5). ``split`` should be materialized."""
    train, test = split.filter(~F.col("is_test")), split.filter(F.col("is_test"))
    best, scores = None, []
    for k in grid:
        model = classifier(k).fit(train)
        loss = _metrics(model.transform(test))["log_loss"]
        if best is None or loss < best[0]:
            best = (loss, k, model)
        scores.append((k, loss))
    return best[2], spark.createDataFrame([(k, x, k == best[1]) for k, x in scores],
                                          "max_iter int, log_loss double, is_best boolean")


def save(model: PipelineModel, vocabulary: DataFrame, path: str) -> None:
    """Persist the fitted pipeline (tokenizer settings, IDF weights, coefficients) and the vocabulary."""
    model.write().overwrite().save(f"{path}/model")
    vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame]:
    """The stored pipeline and vocabulary, for batch scoring."""
    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/vocabulary")
