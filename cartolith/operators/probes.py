"""Linear models on embeddings: out-of-fold hints and probes."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.operators.metrics import class_weights, confusion, overall, per_class


def _features(df: DataFrame) -> DataFrame:
    good = df.filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)))
    return good.withColumn("raw", array_to_vector(F.col("embedding").cast("array<double>")))


def _weighted(df: DataFrame) -> DataFrame:
    return df.join(F.broadcast(class_weights(df, "label").select("label", "weight")), "label")  # a row for each class


def fit_predict(train: DataFrame, test: DataFrame, reg: float = 0.01, rounds: int = 60) -> DataFrame:
    """test with probability (array) and pred: standardised, balanced multinomial logistic regression."""
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(train)
    model = LogisticRegression(labelCol="label", weightCol="weight", regParam=reg, maxIter=rounds, family="multinomial").fit(_weighted(scaler.transform(train)))
    out = model.transform(scaler.transform(test))
    return out.withColumn("p", vector_to_array("probability")).withColumn("pred", F.col("prediction").cast("int"))


def out_of_fold(df: DataFrame, folds: int = 5, **how) -> DataFrame:
    """id, suggests, p_top, p_label of every row by a model that saw none of its fold. df: id, label (0..), embedding, fold."""
    rows = _features(df).cache()
    out = None
    for k in range(folds):
        part = fit_predict(rows.filter(F.col("fold") != k), rows.filter(F.col("fold") == k), **how)
        part = part.select("id", F.col("pred").alias("suggests"), F.round(F.array_max("p"), 3).alias("p_top"), F.round(F.coalesce(F.try_element_at("p", F.col("label") + 1), F.lit(0.0)), 3).alias("p_label"))
        out = part if out is None else out.unionByName(part)
    return out


def probe(df: DataFrame, classes: int, grid=(0.001, 0.01, 0.1)) -> DataFrame:
    """Predictions on the test rows by the regularisation with the best macro F1 on the validation rows. df: id, label, embedding, split."""
    rows = _features(df).cache()
    train = rows.filter("split = 'train'")
    best, score = None, -1.0
    for reg in grid:
        found = fit_predict(train, rows.filter("split = 'val'"), reg).select(F.col("label").cast("int").alias("truth"), "pred")
        macro = overall(per_class(confusion(found, classes)), present=True).first()["macro_f1"]
        if macro > score:
            best, score = reg, macro
    return fit_predict(train, rows.filter("split = 'test'"), best).select("id", F.col("label").cast("int").alias("truth"), "pred")
