"""Classifiers over array features, on pyspark.ml."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import vector_column


def _fit_predict(estimator, train: DataFrame, test: DataFrame, features: str, label: str) -> DataFrame:
    rows = vector_column(train.withColumn("label", F.col(label).cast("double")), features)
    model = estimator.fit(rows)
    return model.transform(vector_column(test, features)).drop("features")


def classify(train: DataFrame, test: DataFrame, features: str, label: str, kind: str = "gbt", seed: int = 1, **options) -> DataFrame:
    """Test rows with ``prediction``: kind gbt, forest, tree, svm, logistic or perceptron."""
    from pyspark.ml import classification as C

    kinds = {"gbt": C.GBTClassifier, "forest": C.RandomForestClassifier, "tree": C.DecisionTreeClassifier, "svm": C.LinearSVC, "logistic": C.LogisticRegression, "perceptron": C.MultilayerPerceptronClassifier}
    if kind in ("gbt", "forest", "tree", "perceptron"):
        options.setdefault("seed", seed)
    return _fit_predict(kinds[kind](featuresCol="features", labelCol="label", **options), train, test, features, label)


def one_vs_rest(train: DataFrame, test: DataFrame, features: str, label: str, kind: str = "svm", **options) -> DataFrame:
    """Multi-class by one binary model a class."""
    from pyspark.ml import classification as C

    base = {"svm": C.LinearSVC, "gbt": C.GBTClassifier, "logistic": C.LogisticRegression}[kind](featuresCol="features", labelCol="label", **options)
    return _fit_predict(C.OneVsRest(classifier=base, featuresCol="features", labelCol="label"), train, test, features, label)


def multi_label(train: DataFrame, test: DataFrame, features: str, labels: str, classes: list, kind: str = "gbt", **options) -> DataFrame:
    """Test rows with a 0/1 prediction for each class of an array of labels."""
    out = test
    for c in classes:
        part = train.withColumn("is_", F.array_contains(labels, c).cast("int"))
        one = classify(part, out, features, "is_", kind, **options)
        out = one.withColumn(f"is_{c}", F.col("prediction").cast("int")).select(*out.columns, f"is_{c}")
    return out


def by_group(df: DataFrame, group: str, values: list, features: str, label: str, part: str = "part", kind: str = "gbt", **options) -> DataFrame:
    """One binary model for each listed group, fitted on its train rows; predictions of its test rows."""
    out = None
    for v in values:
        rows = df.where(F.col(group) == v)
        one = classify(rows.where(F.col(part) == "train"), rows.where(F.col(part) == "test"), features, label, kind, **options)
        one = one.select(group, label, F.col("prediction").cast("int").alias("prediction"))
        out = one if out is None else out.unionByName(one)
    return out


def save(model, path: str, overwrite: bool = False) -> None:
    writer = model.write()
    (writer.overwrite() if overwrite else writer).save(path)
