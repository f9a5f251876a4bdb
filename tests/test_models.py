"""Predictions of every kind of model on rows whose classes are known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clonoscape.operators import models as mo


@pytest.fixture(scope="module")
def rows(spark):
    """Three clouds, and whether the first number is positive; a fifth of the rows is kept back."""
    rng = np.random.default_rng(4)
    centres = np.array([[4.0, 0, 0], [-4.0, 3, 0], [-4.0, -3, 2]])
    out = []
    for i in range(240):
        k = i % 3
        x = centres[k] + rng.normal(size=3) * 0.6
        out.append((i, [float(v) for v in x], k, int(x[0] > 0), ["a"] * int(x[0] > 0) + ["b"] * int(x[1] > 0), "test" if i % 5 == 0 else "train", i % 2))
    return spark.createDataFrame(out, "id long, x array<double>, kind int, y int, labels array<string>, part string, grp int").cache()


def split(rows):
    return rows.where("part = 'train'"), rows.where("part = 'test'")


@pytest.mark.parametrize(("kind", "options"), [("gbt", {"maxIter": 5}), ("forest", {"numTrees": 8}), ("tree", {}), ("svm", {"maxIter": 20}), ("logistic", {})])
def test_two_classes(rows, kind, options):
    train, test = split(rows)
    got = mo.classify(train, test, "x", "y", kind, **options)
    assert got.count() == test.count() == 48
    assert got.where(F.col("prediction") != F.col("y")).count() <= 1


@pytest.mark.parametrize(("kind", "options"), [("forest", {"numTrees": 10}), ("tree", {}), ("logistic", {}), ("perceptron", {"layers": [3, 6, 3], "maxIter": 100})])
def test_three_classes(rows, kind, options):
    train, test = split(rows)
    assert mo.classify(train, test, "x", "kind", kind, **options).where(F.col("prediction") != F.col("kind")).count() <= 2


@pytest.mark.parametrize("kind", ["svm", "gbt", "logistic"])
def test_one_model_a_class(rows, kind):
    train, test = split(rows)
    options = {"maxIter": 5} if kind == "gbt" else {}
    assert mo.one_vs_rest(train, test, "x", "kind", kind, **options).where(F.col("prediction") != F.col("kind")).count() <= 2


def test_several_labels(rows):
    train, test = split(rows)
    got = mo.multi_label(train, test, "x", "labels", ["a", "b"], "tree")
    wrong = got.where((F.col("is_a") != F.array_contains("labels", "a").cast("int")) | (F.col("is_b") != F.array_contains("labels", "b").cast("int")))
    assert got.count() == 48 and wrong.count() <= 6  # the second number crosses 0 within a cloud


def test_a_model_for_each_group(rows):
    got = mo.by_group(rows, "grp", [0, 1], "x", "y", kind="forest", numTrees=5).collect()
    assert len(got) == 48 and {r["grp"] for r in got} == {0, 1}
    assert sum(r["prediction"] != r["y"] for r in got) <= 1


def test_a_saved_model_predicts_the_same(spark, rows, tmp_path):
    from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel

    from clonoscape.operators.cluster import vector_column

    train, test = split(rows)
    model = LogisticRegression(featuresCol="features", labelCol="label").fit(vector_column(train.withColumn("label", F.col("y").cast("double")), "x"))
    path = f"file://{tmp_path}/model"
    mo.save(model, path)
    with pytest.raises(Exception, match="already exists"):
        mo.save(model, path)
    mo.save(model, path, overwrite=True)
    again = LogisticRegressionModel.load(path)
    mine, theirs = (m.transform(vector_column(test, "x")).orderBy("id").select("prediction").collect() for m in (model, again))
    assert mine == theirs
