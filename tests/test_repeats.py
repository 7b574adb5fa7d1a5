import inspect

from pyspark.sql import functions as F

from scarp.operators import metrics, models, splits
from scarp.plans import modelling


def test_counts_of_the_reference(spark):
    assert inspect.signature(metrics.bootstrap_mean).parameters["resamples"].default == 2000
    assert (modelling.REPEATS, modelling.SCRAMBLES) == (10, 30) and models._estimator("forest", 0).getNumTrees() == 300


def test_repeats_are_numbered_and_differ(spark):
    sets = spark.createDataFrame([(i, i % 2, [f"t{i % 7}", "good" if i % 2 else "bad"]) for i in range(40)], "key long, y int, toks array<string>")
    told = models.cross_validated(models.hashed(sets, 32), "logreg", 2, repeats=3)
    assert {r.fold: r["count"] for r in told.groupBy("fold").count().collect()} == {i: 20 for i in range(6)}
    assert {r["count"] for r in told.groupBy("key").count().collect()} == {3}
    rows = sets.select("key", "y", F.expr("key div 2").alias("g"))
    parts = [tuple(r.part for r in splits.grouped(rows, "key", "y", "g", 0.3, trials=16, seed=s).orderBy("key").collect()) for s in range(3)]
    assert len(set(parts)) == 3
