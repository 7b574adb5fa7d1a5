import pickle

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from scarp.operators import linear, models, splits, trees


def _rows(spark, n=600, size=60, seed=3):
    """Sparse presence, a feature that nearly all rows have, rows without any; y is null for a few."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        has = np.unique(np.append(rng.zipf(1.3, 6) % size, size)) if i % 50 else np.array([], int)
        y = int((3 in has) ^ (5 in has) ^ (rng.random() < 0.2))
        rows.append((i, None if i % 37 == 36 else y, Vectors.sparse(size + 1, has.tolist(), [1.0] * len(has)), *["test" if (i + t) % 4 == 0 else "train" for t in (0, 1)]))
    return spark.createDataFrame(rows, ["key", "y", "features", "a", "b"])


@pytest.mark.parametrize("kind", models.LINEAR)
def test_linear_models_are_those_of_mllib(spark, kind, monkeypatch):
    """Where one task holds all rows MLlib fits nothing. The loss has the minimum of MLlib's: after as many steps it is not above
    its, and for the smooth one, where MLlib arrives, the probabilities are its own."""
    rows = _rows(spark)
    model = models.fit(kind, rows.where("a = 'train'"))
    expected = {r.key: (r.p, r.y) for r in models.probability(model, rows.where("a = 'test'")).collect()}
    monkeypatch.setattr(models, "fit", None)
    kept = spark.conf.get("scarp.chunkRows")
    spark.conf.set("scarp.chunkRows", "100000")
    try:
        told = models.evaluate_splits(rows, ["a", "b"], (kind,))
    finally:
        spark.conf.set("scarp.chunkRows", kept)
    got = {r.key: (r.p, r.y) for r in told.where("repeat = 0").collect()}
    assert got.keys() == expected.keys() and all(got[k][1] == expected[k][1] for k in got)
    assert told.groupBy("repeat").count().count() == 2
    if kind == "logreg":
        assert max(abs(got[k][0] - expected[k][0]) for k in got) < 1e-3

    found = rows.collect()
    x = np.array([r.features.toArray() for r in found])
    y = np.array([-1 if r.y is None else r.y for r in found])
    train = np.array([r.a == "train" for r in found]) & (y >= 0)
    features = [r.features.indices for r in found]
    block = trees.Block(pickle.dumps((np.arange(len(y)), y, train[None], ~train[None], np.array([len(f) for f in features]), np.concatenate(features).astype(np.int32))))
    w, b = linear.fitted(block, linear.Plan(0, kind, 50, 0.01))
    assert max(abs(1 / (1 + np.exp(-(x[k][block.features] @ w + b))) - got[k][0]) for k in got) < 1e-9

    def held(w, b):
        loss, _ = linear.LOSSES[kind](x[train] @ w + b, 2.0 * y[train] - 1)
        return loss / train.sum() + 0.005 * (w * x[train].std(0, ddof=1)) @ (w * x[train].std(0, ddof=1))

    whole = np.zeros(x.shape[1])
    whole[block.features] = w
    assert held(whole, b) <= held(model.coefficients.toArray(), model.intercept) + 1e-5


def test_vectors_are_for_mllib_only(spark, monkeypatch):
    """Rows that say which features they have give the scores of rows with vectors; in one block no vector is made."""
    rows = _rows(spark, 200)
    flat = rows.withColumn("f", F.udf(models._sparse, "size int, indices array<int>, values array<double>")("features")).select("key", "y", "a", "f.size", "f.indices")
    kinds = ("logreg", "boosted")
    told = lambda part: {(r.model, r.key): r.p for r in models.evaluate_splits(part, ["a"], kinds).collect()}
    many, sparse = told(rows), told(flat)
    assert many.keys() == sparse.keys() and max(abs(many[k] - sparse[k]) for k in many) < 1e-9
    monkeypatch.setattr(models, "presence", None)
    kept = spark.conf.get("scarp.chunkRows")
    spark.conf.set("scarp.chunkRows", "100000")
    try:
        one = told(flat)
    finally:
        spark.conf.set("scarp.chunkRows", kept)
    assert one.keys() == many.keys() and max(abs(one[k] - many[k]) for k in many) < 5e-3


def test_draws_of_all_seeds_in_one_pass(spark):
    """The parts are those of one draw after another."""
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, int(rng.integers(-50, 50)) * 12_345_678, int(rng.random() < 0.4)) for i in range(400)], "key long, g long, y int")
    cuts = splits.grouped_parts(rows, "y", "g", 0.2, [0, 3, 1])
    groups = {}
    for r in rows.collect():
        groups.setdefault(r.g, []).append(r.y)
    base = sum(map(sum, groups.values())) / 400
    for seed, cut in zip((0, 3, 1), cuts):
        tried = []
        for t in range(seed * 256, seed * 256 + 256):
            test = [g for g in groups if ((g * 7919 + 104_729 + 15_485_863 * t) % 1_000_003) ** 2 % 1_000_003 < 200_000]
            if test:
                off = round(abs(sum(sum(groups[g]) for g in test) / sum(len(groups[g]) for g in test) - base), 9)
                tried.append((0.0 if off <= 0.02 else off, t, set(test)))
        assert {r.g for r in rows.where(cut == "test").select("g").distinct().collect()} == min(tried)[2]
