import math

import numpy as np
from pyspark.sql import functions as F

from scarp.operators import clustering, metrics, models, similarity
from scarp.plans import cliffs


def _greedy(pairs):
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for k in sorted(near, key=lambda k: (-len(near[k]), k)):
        if k not in out:
            for o in [k, *near[k]]:
                out.setdefault(o, k)
    return out


def _pairs_of(found):
    return {(r.a, r.b) for r in similarity.expanded(found).collect()}


def test_butina_against_greedy(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(t)) for i in range(60) for t in rng.choice(10, rng.integers(2, 5), replace=False)] + [(i, t) for i in range(70, 76) for t in (1, 2)]
    found = similarity.similar_classes(spark.createDataFrame(rows, "key long, tok long"), 0.5)
    assert {r.key: r.centroid for r in clustering.butina(found).collect()} == _greedy(_pairs_of(found))
    nothing = similarity.similar_classes(spark.createDataFrame([], "key long, tok long"), 0.5)
    assert clustering.butina(nothing).count() == 0 and similarity.expanded(nothing).count() == 0


def test_counts_and_components_of_classes(spark):
    rows = [(i, t) for i in range(30) for t in ("a", "b", "c", "d")] + [(40, t) for t in ("a", "b", "c", "d", "e")] + [(50, "z"), (51, "z"), (60, "q")]
    found = similarity.similar_classes(spark.createDataFrame(rows, "key long, tok string"), 0.8)
    counts = {r.key: r.n_neighbors for r in similarity.neighbor_counts(found).collect()}
    assert counts == {**{i: 30 for i in range(30)}, 40: 30, 50: 1, 51: 1}
    groups = {r.key: r.group_key for r in similarity.class_components(found).collect()}
    assert groups == {**{i: 0 for i in range(30)}, 40: 0, 50: 50, 51: 50}


def test_votes(spark):
    sets = {1: "abcd", 2: "abc", 3: "abx", 4: "abcd", 5: "q"}
    labels = {1: 1, 2: 0, 3: 1, 4: None, 5: 1}
    rows = spark.createDataFrame([(k, labels[k], list(t)) for k, t in sets.items()], "key long, y int, toks array<string>")
    got = {r.key: (r.p, r.n_votes) for r in clustering.nearest_votes(rows.where("key in (1, 4)"), rows, 2).collect()}
    assert got == {1: (0.5, 2), 4: (0.5, 2)}


def test_votes_against_all_pairs(spark, monkeypatch):
    """Hubs, copies, empty sets, and many blocks; the best of each query over all rows."""
    rng = np.random.default_rng(11)
    sets = {i: sorted({*(["hub"] if rng.random() < 0.9 else []), *(["half"] if rng.random() < 0.5 else []), *(f"t{t}" for t in rng.zipf(1.6, rng.integers(0, 7)) if t < 40)}) for i in range(300)}
    labels = {i: None if i % 9 == 0 else int(rng.random() < 0.5) for i in sets}
    rows = spark.createDataFrame([(i, labels[i], t) for i, t in sets.items()], "key long, y int, toks array<string>")
    expected = {}
    for q in range(0, 300, 3):
        sims = sorted((-(len({*sets[q]} & {*sets[i]}) / max(1, len({*sets[q]} | {*sets[i]}))), i) for i in sets if i != q and labels[i] is not None)[:7]
        expected[q] = (round(sum(labels[i] for _, i in sims) / len(sims), 9), len(sims))
    for blocks in ((10_000, 10_000), (20, 40)):
        monkeypatch.setattr(similarity, "QUERY_BLOCK", blocks[0])
        monkeypatch.setattr(similarity, "TABLE_BLOCK", blocks[1])
        monkeypatch.setattr(clustering, "STEP", 500)
        got = clustering.nearest_votes(rows.where("key % 3 = 0"), rows, 7).collect()
        assert {r.key: (round(r.p, 9), r.n_votes) for r in got} == expected


def test_blocks_repeat_few_rows(spark):
    """What a comparison with all rows shuffles: each row once per block of queries, which are large."""
    rows = spark.range(60_000).selectExpr("id as key", "array(id % 7) as toks")
    left, right = similarity.blocked(rows.where("key % 20 = 0").toDF("q", "qtoks"), rows)
    assert left.count() + right.count() <= 3_000 * 10 + 60_000
    assert similarity.against_all(rows.where("key < 3").toDF("q", "qtoks"), rows.limit(100)).groupBy("q").count().where("count = 99").count() == 3


def test_landscape_compares_numbers(spark):
    """Sets of numbers take less of the shuffle than sets of texts and have the same similarities."""
    folder = "/root/testdata/sf0.001"
    as_texts, as_numbers = cliffs.molecule_sets(spark, folder), cliffs.numbered_molecules(spark, folder)
    assert as_numbers.schema["toks"].dataType.elementType.typeName() == "long"
    sims = [sorted((r.q, r.key, r.sim) for r in similarity.against_all(t.where("key % 20 = 0").selectExpr("key as q", "toks as qtoks"), t.select("key", "toks")).collect()) for t in (as_texts, as_numbers)]
    assert sims[0] == sims[1] and len(sims[0]) > 100


def _sets(spark, n=240):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.4)
        toks = {f"t{t}" for t in rng.integers(0, 30, 6)} | ({"signal"} if y ^ (rng.random() < 0.1) else set())
        rows.append((i, y, sorted(toks)))
    return spark.createDataFrame(rows, "key long, y int, toks array<string>")


def test_models_learn_and_scrambled_labels_do_not(spark):
    sets = _sets(spark)
    rows = models.hashed(sets)
    held_out = metrics.ranking(models.cross_validated(rows, "logreg", 3).withColumn("all", F.lit(1)), ["all"]).first()
    assert held_out.auroc > 0.8
    told = models.evaluate(rows.withColumn("part", F.when(F.col("key") % 4 == 0, "test").otherwise("train")), ("linear_svm", "balanced_forest"))
    assert all(r.auroc > 0.7 for r in metrics.ranking(told, ["model"]).collect()) and told.count() == 120
    best = models.token_importance(models.fit("logreg", rows), sets).orderBy(F.col("importance").desc()).first()
    assert best.token == "signal" and best.coefficient > 0
    assert models.fit("logreg", rows.where("y = 1")) is None
    assert models.cross_validated(rows.where("y = 1"), "logreg", 3).count() == 0


def test_folds_leave_no_model_in_the_plan(spark):
    rows = models.hashed(_sets(spark, 80), 64)
    told = models.cross_validated(rows, "logreg", 2, repeats=2)
    assert "UDF" not in told._jdf.queryExecution().toString() and told.count() == 160
    for turn in range(2):  # the folds are those of ``folds``
        expected = {(r.key, turn * 2 + r.fold) for r in models.folds(rows, 2, turn).collect()}
        assert {(r.key, r.fold) for r in told.where(F.col("fold").between(turn * 2, turn * 2 + 1)).collect()} == expected


def test_fits_side_by_side_fit_the_heap(spark):
    rows = models.hashed(_sets(spark, 10), 400_000)
    assert models.fits_at_once(rows, 750 << 20) == 2 and models.fits_at_once(rows, 64 << 20) == 1 and models.fits_at_once(models.hashed(_sets(spark, 10), 64), 750 << 20) == models.AT_ONCE


def test_permuted_keeps_the_values(spark):
    df = spark.createDataFrame([(i, float(i % 7), i) for i in range(50)] + [(99, None, 99)], "key long, v double, other long")
    got = models.permuted(df, "v", 3).collect()
    assert sorted(r.v for r in got if r.v is not None) == sorted(float(i % 7) for i in range(50)) and len(got) == 51
    assert all(r.key == r.other for r in got) and [r.v for r in sorted(got)] != [r.v for r in df.collect()]


def test_descriptors(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0, None), (2, 3.0, 5.0, None), (3, float("nan"), 5.0, None), (4, float("inf"), 5.0, None), (5, 8.0, 5.0, None)], "k long, a double, flat double, none double")
    got = models.descriptors(df, "k", ["a", "flat", "none"])
    values = np.array([1.0, 3.0, 3.0, 3.0, 8.0])
    assert got.columns == ["key", "a"] and np.allclose([r.a for r in got.orderBy("key").collect()], (values - values.mean()) / values.std())
    twins = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 4.0, 0.0), (3.0, 6.1, 5.0)], "a double, b double, c double")
    assert models.uncorrelated(twins, ["a", "b", "c"]) == ["a", "c"]


def test_projection_against_svd(spark):
    rows = models.hashed(_sets(spark, 60), 32).select("key", "features")
    got, variances = models.projected(rows)
    x = np.array([r.features.toArray() for r in rows.orderBy("key").collect()])
    x -= x.mean(0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    mine = np.array([[r.pc1, r.pc2] for r in got.orderBy("key").collect()])
    assert np.allclose(np.abs(mine), np.abs(u[:, :2] * s[:2]), atol=1e-6) and math.isclose(variances[0], s[0] ** 2 / (s**2).sum(), rel_tol=1e-6)
    assert models.projected(rows.limit(0))[0].count() == 0


def test_importance_by_permutation(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(a > 0), float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(200, 2)))]
    got = {r.column: r.loss for r in models.permutation_importance(spark.createDataFrame(rows, "key long, y int, a double, b double"), ["a", "b"]).collect()}
    assert got["a"] > 0.3 and abs(got["b"]) < 0.05
    assert similarity.item_sets(spark.createDataFrame([], "k long, t string"), "k", F.col("t")).count() == 0
