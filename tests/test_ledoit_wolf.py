from __future__ import annotations

import numpy as np
import pytest

from skylode.operators import models


@pytest.mark.parametrize("n, p", [(12, 5), (400, 5), (400, 2)])
def test_shrinkage_is_estimated(spark, n, p):
    rng = np.random.default_rng(n + p)
    x = rng.normal(size=(n, p)) * np.arange(1, p + 1) + 3
    centred = x - x.mean(0)
    cov = centred.T @ centred / n
    # By the definition: distance of each vector's own product from the covariance, over that of the covariance from its target.
    target = np.eye(p) * np.trace(cov) / p
    away = ((cov - target) ** 2).sum()
    noise = sum(((np.outer(v, v) - cov) ** 2).sum() for v in centred) / n**2
    shrink = min(noise, away) / away
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(n, None)], "i long, v array<double>")
    assert models.ledoit_wolf(df, "v", *models.moments(df, "v")) == pytest.approx(shrink)
    want = np.sqrt(np.einsum("ij,jk,ik->i", centred, np.linalg.inv((1 - shrink) * cov + shrink * target), centred))
    got = {r["i"]: r["distance"] for r in models.mahalanobis(df, "v", df).collect()}
    assert [got[k] for k in range(n)] == pytest.approx(list(want)) and got[n] is None


def test_equal_vectors_in_one_dimension_have_no_shrinkage(spark):
    df = spark.createDataFrame([(k, [float(k)]) for k in range(5)], "i long, v array<double>")
    assert models.ledoit_wolf(df, "v", *models.moments(df, "v")) == 0.0
