import math

import numpy as np
from pyspark.sql import functions as F

from scarp.operators import fragments


def _ranked(spark, values):
    return fragments.ranked_importance(spark.createDataFrame([(f"f{i:04d}", float(v)) for i, v in enumerate(values)], "fragment string, importance double"))


def _knee(y, s):
    """Kneedle for a convex, falling curve, step by step."""
    y = np.asarray(y, float)
    n = len(y)
    d = 1 - (y - y.min()) / (y.max() - y.min() + 1e-9) - np.arange(n) / (n - 1)
    left, right = np.r_[d[0], d[:-1]], np.r_[d[1:], d[-1]]
    peak, valley = (d >= left) & (d >= right), (d <= left) & (d <= right)
    limit = top = None
    for i in range(n - 1):
        if peak[i]:
            top, limit = i, d[i] - s / (n - 1)
        if valley[i] and top is not None:
            limit = 0.0
        if top is not None and d[i + 1] < limit:
            return top + 1
    return None


def test_knee_against_the_plain_walk(spark):
    rng = np.random.default_rng(1)
    for values in (1 / np.arange(1, 80) ** 0.7, rng.random(50), np.r_[np.linspace(9, 5, 20), np.linspace(1, 0, 40)]):
        y = np.sort(values)[::-1]
        row = fragments.knee_points(_ranked(spark, y)).first()
        assert [row[f"knee{i}"] for i in range(3)] == [_knee(y, s) for s in fragments.SENSITIVITIES]


def test_cutoffs_of_small_and_flat_curves(spark):
    count = lambda values, mode: fragments.cutoff(_ranked(spark, values), mode).first().n_selected
    assert count(range(10), "knee") == 10 and count([0.0] * 40, "knee") >= 15
    assert count([1.0] * 10, "cumulative") == 8 and count(range(9), "stability") == 4 and count(range(50), "rank_step_up") == 5
    assert count(range(40), "no such mode") == count(range(40), "knee")


def test_drop_is_looked_for_beyond_the_least(spark):
    # The steepest fall is after rank 3, the steepest beyond rank 15 after rank 20; at most 80 % may be kept.
    y = [1000, 900, 800] + [100 - i for i in range(17)] + [20 - 0.1 * i for i in range(20)]
    assert fragments.knee_cutoff(_ranked(spark, y), with_knee=False).first().n_selected == 20
    y = [100 - i for i in range(19)] + [1.0]
    assert fragments.knee_cutoff(_ranked(spark, y), with_knee=False).first().n_selected == 10  # 19 of 20 is too many


def test_exact_permutation_p(spark):
    labels = spark.createDataFrame([(i, int(i < 8)) for i in range(20)] + [(50, None)], "key long, y int")
    members = spark.createDataFrame([(i, "mark") for i in range(6)] + [(i, "all") for i in range(20)] + [(i, "odd") for i in range(10, 14)] + [(50, "none")], "key long, fragment string")
    got = {r.fragment: r for r in fragments.label_fdr(members, labels).collect()}
    assert math.isclose(got["mark"].p_value, math.comb(8, 6) * math.comb(12, 0) / math.comb(20, 6), rel_tol=1e-9)
    assert math.isclose(got["all"].p_value, 1.0, rel_tol=1e-9) and math.isclose(got["odd"].p_value, 1.0, rel_tol=1e-9)
    assert [got[f].is_accepted for f in ("mark", "all", "odd")] == [True, False, False] and "none" not in got
    n = np.array([0, 1, 5, 31, 32, 33, 1000, 10**6])
    assert np.allclose(fragments._log_factorial(n), [math.lgamma(k + 1) for k in n], rtol=1e-13)
    assert fragments.label_fdr(members.limit(0), labels).count() == 0


def test_pairs_behind_the_enrichment(spark):
    pairs = spark.createDataFrame([(1, 2, 8.0, 6.0, 5.0), (3, 3, 1.0, 1.0, 9.0)], "a long, b long, pa double, pb double, sali double")
    members = spark.createDataFrame([(1, "x"), (1, "z"), (2, "y"), (2, "z")], "key long, fragment string")
    rows = fragments.enrichment_pairs(pairs, members).select("fragment", "signed", fragments.pair_text(F.col("a"), F.col("b")).alias("pair"))
    assert {tuple(r) for r in rows.collect()} == {("x", 5.0, "1|2"), ("y", -5.0, "1|2")}
