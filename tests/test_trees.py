import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from scarp.operators import metrics, models, trees
from scarp.store import Scratch


def _rows(spark, n=150, size=40, seed=5):
    """Sparse presence, some of it telling; y is null for a few."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        has = np.unique(rng.zipf(1.3, 6) % size)
        y = int((3 in has) ^ (5 in has) ^ (rng.random() < 0.2))
        rows.append((i, None if i % 37 == 36 else y, Vectors.sparse(size, has.tolist(), [1.0] * len(has)), "test" if i % 4 == 0 else "train"))
    return spark.createDataFrame(rows, ["key", "y", "features", "part"])


def _blocks(spark, rows, chunk):
    kept = spark.conf.get("scarp.chunkRows")
    spark.conf.set("scarp.chunkRows", str(chunk))
    try:
        split = F.udf(models._sparse, "size int, indices array<int>, values array<double>")
        flat = rows.withColumn("f", split("features")).select("key", "y", "f.indices", F.array((F.col("part") == "train") & F.coalesce(F.col("y").isin(0, 1), F.lit(False))).alias("train"), F.array(F.col("part") == "test").alias("test"))
        return trees.Blocks(*trees.packed(flat, Scratch(spark, "trees")))
    finally:
        spark.conf.set("scarp.chunkRows", kept)


def _told(blocks, plan):
    return {r.key: r.p for r in blocks.scored([plan], blocks.fitted([plan])).collect()}


@pytest.mark.parametrize("chunk", [10_000, 100])
def test_trees_are_those_of_mllib(spark, chunk):
    """One tree of all rows and all features, and boosted trees, have nothing random: the same probabilities, in one block or many.
    (Where features tie, MLlib's rounding decides; these rows have no such ties.)"""
    for n, seed, kind in ((150, 5, "tree"), (400, 7, "boosted")):
        rows = _rows(spark, n, seed=seed)
        blocks = _blocks(spark, rows, chunk)
        assert (blocks.n == 1) == (chunk == 10_000)
        train = rows.where("part = 'train' and y is not null")
        zeros, ones = train.where("y = 0").count(), train.where("y = 1").count()
        weights = ((zeros + ones) / (2 * zeros), (zeros + ones) / (2 * ones))
        weighed = train.withColumn("weight", F.when(F.col("y") == 1, weights[1]).otherwise(weights[0]))
        model = DecisionTreeClassifier(labelCol="y", weightCol="weight", maxDepth=8) if kind == "tree" else GBTClassifier(labelCol="y", maxIter=20, maxDepth=3)
        plan = trees.Plan(0, kind, 40, 1, 8, weights) if kind == "tree" else trees.Plan(0, kind, 40, 20, 3, step=0.1)
        expected = {r.key: r.p for r in model.fit(weighed).transform(rows.where("part = 'test'")).select("key", vector_to_array("probability")[1].alias("p")).collect()}
        got = _told(blocks, plan)
        assert got.keys() == expected.keys() and max(abs(got[k] - expected[k]) for k in got) < 1e-9


def test_forests_do_not_depend_on_blocks(spark):
    rows = _rows(spark, 90)
    plan = trees.Plan(0, "balanced_forest", 40, 12, 8, (0.8, 1.3))
    one, many = (_told(_blocks(spark, rows, chunk), plan) for chunk in (10_000, 30))
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-12 for k in one) and len(set(one.values())) > 10


def test_bags_are_poisson(spark):
    times = trees.bag(np.arange(200_000), 0, 3)
    assert abs(times.mean() - 1) < 0.02 and abs(times.var() - 1) < 0.03 and abs((times == 0).mean() - np.exp(-1)) < 0.01
    assert abs(np.corrcoef(times, trees.bag(np.arange(200_000), 0, 4))[0, 1]) < 0.01
    plan = trees.Plan(0, "forest", 900, 300, 8)
    assert len(set(trees.drawn(plan, 2, 0, 1))) == 30 and (trees.drawn(plan, 2, 0, 1) != trees.drawn(plan, 3, 0, 1)).any()


def test_many_features_cost_nothing(spark):
    """Rows hold what they have: with 2,000,000 features the trees of MLlib would hold 2,000,000 numbers a row."""
    rng = np.random.default_rng(6)
    size, rows = 2_000_000, []
    for i in range(200):
        has = sorted({*rng.integers(10, size, 5).tolist(), i % 2})
        rows.append((i, i % 2, Vectors.sparse(size, has, [1.0] * len(has)), *["test" if (i + t) % 5 < 2 else "train" for t in (0, 1)]))
    cut = spark.createDataFrame(rows, ["key", "y", "features", "a", "b"])
    told = models.evaluate_splits(cut, ["a", "b"], ("boosted",))
    assert {(r["repeat"], r.model): r.auroc for r in metrics.ranking(told, ["repeat", "model"]).collect()} == {(0, "boosted"): 1.0, (1, "boosted"): 1.0}
    assert told.count() == 160


def test_every_kind_in_every_split(spark):
    rows = _rows(spark, 120).withColumn("other", F.when(F.col("key") % 5 == 1, "test").otherwise("train")).withColumn("none", F.lit("test"))
    told = models.evaluate_splits(rows, ["part", "other", "none"])
    assert {(r["repeat"], r.model, r["count"]) for r in told.groupBy("repeat", "model").count().collect()} == {(t, kind, n) for t, n in ((0, 30), (1, 24)) for kind in models.KINDS}
    assert models.evaluate_splits(rows, ["none"]).count() == 0
    assert all(r.auroc > 0.55 for r in metrics.ranking(told, ["repeat", "model"]).where("model like '%forest' or model = 'boosted'").collect())
