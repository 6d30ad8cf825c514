import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitweave.llm.rule_ensemble import FEATURES, fit, fit_arrays, lasso_logistic, quality_scores, with_statistics


def auc(score, y):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_expression_scores_as_the_rules_do(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = fit(docs, labels)
    assert 0 < len(model.rules) < 200
    x = with_statistics(docs, ["doc_id"]).select("doc_id", "__x.*", model.column().alias("score")).limit(500).toPandas()
    assert np.allclose(model.score(x[list(FEATURES)].to_numpy()), x["score"])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert all((zlib.crc32(str(d).encode()) % 5 == 0) for d in out.doc_id)
    y = out.quality.to_numpy()
    print("held-out", len(y), auc(out.score.to_numpy(), y), (out.predicted == y).mean(), (out.predicted[y == 1] == 1).mean(), (out.predicted[y == 0] == 0).mean())
    assert auc(out.score.to_numpy(), y) > 0.9
    assert (out.predicted[y == 1] == 1).mean() > 0.97


def test_lasso_drops_noise():
    rng = np.random.default_rng(0)
    z = (rng.random((2000, 20)) < 0.5).astype(float)
    y = (rng.random(2000) < 1 / (1 + np.exp(-(3 * z[:, 0] - 3 * z[:, 1])))).astype(float)
    _, w = lasso_logistic(z, y, 0.02)
    assert w[0] > 1 and w[1] < -1 and np.abs(w[2:]).max() < 0.2


@pytest.mark.parametrize(("y", "score"), [([], 0.5), ([1, 1], 0.75)])
def test_without_two_classes(y, score):
    model = fit_arrays(np.zeros((len(y), len(FEATURES))), np.array(y, float))
    assert np.allclose(model.score(np.zeros((1, len(FEATURES)))), score)


def test_odd_rows(spark):
    rows = [(None, "a b", 1.0), (1, None, 2.0), (2, "", 3.0), (2, "", 3.0), (3, "w" * 200000, 4.0), (4, "a ! | # 1\n\n" * 500, 5.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    out = quality_scores(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.held_out is not None for r in out)
    assert quality_scores(docs.filter(F.lit(False)), labels).collect() == []
