import math

import numpy as np
from pyspark.sql import functions as F

from scarp.operators import models


def _many(spark):
    """3000 tokens, far beyond the positions of the hash; 'good' and 'bad' decide the label."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        y = i % 2
        rows.append((i, y, sorted({f"t{t}" for t in rng.integers(0, 3000, 8)} | {"good" if y else "bad"})))
    return spark.createDataFrame(rows, "key long, y int, toks array<string>")


def test_every_token_has_its_own_position(spark):
    sets = _many(spark)
    index = models.token_index(sets)
    n = index.count()
    assert n > models.BITS and index.agg(F.countDistinct("at"), F.min("at"), F.max("at")).first() == (n, 0, n - 1)
    rows = models.indexed(sets, index)
    assert all(r.features.size == n and r.features.numNonzeros() == len(r.toks) for r in rows.collect())
    told = models.token_importance(models.fit("logreg", rows), sets, index=index).orderBy(F.col("importance").desc()).collect()
    assert {r.token for r in told[:2]} == {"good", "bad"} and len(told) == n
    assert sum(abs(abs(r.coefficient) - abs(told[0].coefficient)) < 1e-9 for r in told) <= 2
    assert models.indexed(spark.createDataFrame([(1, []), (2, ["new"])], "key long, toks array<string>"), index).count() == 2


def test_wide_projection_against_svd(spark):
    sets = _many(spark).limit(60)
    rows = models.indexed(sets, models.token_index(sets)).select("key", "features").cache()
    got, variances = models.projected_wide(rows)
    x = np.array([r.features.toArray() for r in rows.orderBy("key").collect()])
    x -= x.mean(0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    mine = np.array([[r.pc1, r.pc2] for r in got.orderBy("key").collect()])
    assert np.allclose(np.abs(mine), np.abs(u[:, :2] * s[:2]), atol=1e-6) and math.isclose(variances[0], s[0] ** 2 / (s**2).sum(), rel_tol=1e-6)
    assert models.projected_wide(rows.limit(0))[0].count() == 0
