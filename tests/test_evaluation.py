import math

import numpy as np
import pytest

from scarp.operators import evaluation, metrics


def test_chain_against_plain_counts(spark):
    rng = np.random.default_rng(3)
    y = {i: int(rng.random() < 0.4) for i in range(60)}
    held = {i: sorted({f"f{t}" for t in rng.integers(0, 8, 4)} | ({"signal"} if y[i] else set())) for i in range(58)}  # 58 and 59 have none
    rows = spark.createDataFrame([(i, y[i], i // 3) for i in range(60)], "key long, y long, group_id long")
    members = spark.createDataFrame([(i, f) for i, fs in held.items() for f in fs], "key long, fragment string")
    parts = evaluation.repeated_splits(rows, repeats=2, trials=8)
    told = {(r.repeat, r.key): r.part for r in parts.collect()}
    assert len(told) == 120 and {p for p in told.values()} == {"fit", "valid", "test"}
    for repeat in (0, 1):
        tested = {k for (r, k), part in told.items() if r == repeat and part == "test"}
        assert all((k in tested) == (k // 3 * 3 in tested) for k in range(60))
    scores = {(r.model, r.repeat, r.part, r.key): r.p for r in evaluation.count_scores(parts, members).collect()}
    for (repeat, key), part in told.items():
        if part == "fit":
            continue
        fitted = [k for k in range(60) if told[repeat, k] in (("fit",) if part == "valid" else ("fit", "valid"))]
        n, n1 = len(fitted), sum(y[k] for k in fitted)
        odds, rates = math.log((n1 + 1) / (n - n1 + 1)), []
        for f in held.get(key, []):
            having = [k for k in fitted if f in held.get(k, [])]
            if having:
                k1 = sum(y[k] for k in having)
                odds += math.log((k1 + 1) / (n1 + 2)) - math.log((len(having) - k1 + 1) / (n - n1 + 2))
                rates.append((k1 + n1 / n) / (len(having) + 1))
        assert abs(scores["bayes", repeat, part, key] - 1 / (1 + math.exp(-odds))) < 2e-6
        assert abs(scores["rates", repeat, part, key] - (np.mean(rates) if rates else n1 / n)) < 2e-6


def test_runs_and_nothing(spark):
    scores = spark.createDataFrame(
        [("m", 0, p, k, yy, s) for p, rows in (("valid", [(1, 0, 0.2), (2, 1, 0.3), (3, 1, 0.9)]), ("test", [(4, 0, 0.25), (5, 1, 0.26), (6, 1, 0.8)])) for k, yy, s in rows],
        "model string, repeat long, part string, key long, y long, p double",
    )
    nodes = spark.createDataFrame([(0, 5)], "repeat long, key long")
    row = evaluation.run_metrics(scores, nodes).first()
    assert row.threshold == 0.21 and row.auroc == 1.0 and row.n_nodes == 1 and math.isclose(row.cliff_rmse, 0.74) and row.cliff_f1 == 1.0 and math.isclose(row.f1, 0.8)
    assert evaluation.run_metrics(scores, nodes.limit(0)).first().cliff_f1 is None
    assert evaluation.run_metrics(scores.limit(0), nodes).count() == 0
    parts = evaluation.repeated_splits(spark.createDataFrame([], "key long, y long, group_id long"), repeats=2, trials=4)
    assert parts.count() == 0


def test_bootstraps(spark):
    weights = metrics.poisson_weights(np.arange(2000) * 2654435761, 50)
    assert abs(weights.mean() - 1) < 0.02 and abs(weights.var() - 1) < 0.05 and not (weights[0] == weights[1]).all()
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 300)
    p = np.clip(0.3 * y + 0.5 * rng.random(300), 0, 1).round(3)
    rows = spark.createDataFrame([("m", i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))] + [("one", 900, 1, 0.5)], "model string, k long, y int, p double")
    exact = {r.model: r.auroc for r in metrics.ranking(rows, ["model"]).collect()}
    got = {r.model: r for r in metrics.bootstrap_auroc(rows, ["model"], "k", resamples=200).collect()}
    assert got["m"].ci_lower < exact["m"] < got["m"].ci_upper and abs(got["m"].median - exact["m"]) < 0.01 and got["one"].median is None
    curve = metrics.curve_points(rows, ["model"], 11).where("model = 'm'").orderBy("fpr").collect()
    assert len(curve) == 11 and curve[-1].tpr == 1.0 and all(a.tpr <= b.tpr for a, b in zip(curve, curve[1:]))
    wrong = {r.bin: r.error for r in metrics.reliability_error(rows.where("model = 'm'"), ["model"]).collect()}
    at = (p * 10).astype(int) == 3
    assert math.isclose(wrong[3], float(np.mean((p[at] >= 0.5) != (y[at] == 1))))


@pytest.mark.parametrize("name", ["evaluation_runs", "cutoffs", "similarity_classes"])
def test_against_sql(spark, name):
    from oracle import compare
    from scarp.plans import registry

    ours, theirs = compare(spark, "/root/testdata/sf0.001", name, registry.queries()[name], registry.oracle_sql()[name])
    assert ours == theirs
