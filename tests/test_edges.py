"""Readers, writers, feature columns and sampling state."""

import math

import numpy as np
from pyspark.sql import functions as F

from scarp.operators import features, sampling
from scarp.plans import features as plans
from scarp.sources import files


def test_rejects_are_kept(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('a;b\n1;x\nz;y\n2;"q;r"\n3;u;v\n')
    rows = files.read_csv(spark, str(path), "a int, b string", ";")
    assert {tuple(r) for r in rows.collect()} == {(1, "x"), (2, "q;r")}
    assert {r.line for r in files.read_rejects(spark, str(path), "a int, b string", ";").collect()} == {"z;y", "3;u;v"}
    assert rows.count() == 2


def test_small_sources_and_sinks(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    (tmp_path / "c.json").write_text('{"best_model": "forest",\n "seed": 42}')
    (tmp_path / "k.txt").write_text("Backbone: ecfp\n\nno pair\nNote: a: b\n")
    assert files.read_config(spark, at("c.json"))["seed"] == 42 and files.best_model(spark, at("c.json")) == "forest"
    assert {tuple(r) for r in files.read_key_values(spark, at("k.txt")).collect()} == {("Backbone", "ecfp"), ("Note", "a: b")}
    assert files.first_existing(spark, [at("none"), at("c.json")]) == at("c.json") and files.first_existing(spark, [at("none")]) is None
    df = spark.createDataFrame([(2, "b"), (1, "a"), (1, "a"), (3, None)], "k int, v string")
    files.write_json(df, at("j"))
    files.write_lines(df, "v", at("l"))
    files.write_library(df, "v", at("lib"))
    assert spark.read.json(at("j")).count() == 4 and files.read_lines(spark, at("l")).count() == 3
    tagged = files.read_tagged(spark, {"one": at("lib"), "two": at("lib")}, "v string")
    assert sorted(map(tuple, tagged.collect())) == [("a", "one"), ("a", "two"), ("b", "one"), ("b", "two")]
    built = []
    for _ in range(2):
        assert files.stage(spark, at("stage"), lambda: built.append(1) or df).count() == 4
    assert built == [1]
    assert files.report_lines(df.where("k = 3")).first().value == "k: 3; v: N/A"


def test_names_and_scales(spark):
    assert features.aligned_names(["a", "a", "b"], 4) == ["a", "a__dup1", "b", "f3"] and features.aligned_names(["a", "b"], 1) == ["a"]
    row = spark.range(1).select(features.logit(F.lit(1.0)).alias("top"), features.logit(F.lit(0.5)).alias("half"), features.feature_index(F.lit("x_0042"), 1).alias("i"), features.feature_index(F.lit("x")).alias("none"), features.clean_name(F.lit("[a]<b>")).alias("n")).first()
    assert math.isclose(row.top, math.log((1 - 1e-6) / 1e-6), rel_tol=1e-6) and row.half == 0 and row.i == 41 and row.none is None and row.n == "ab"
    rows = spark.createDataFrame([(1, 1.0, 5.0, None), (2, 2.0, 5.0, None), (3, 9.0, 5.0, None)], "k int, a double, b double, c double")
    assert features.distinct_columns(rows, ["a", "b", "c", "a"]) == ["a"] and features.by_variance(rows, ["b", "a"], 1) == ["a"]
    assert features.named_frame(rows, ["x"]).columns == ["f0", "f1", "f2", "f3"]
    assert features.gathered(rows, spark.createDataFrame([(1,), (1,), (8,)], "k int"), "k").count() == 2
    assert [features.top_k_for(n, 1000) for n in (50, 150, 300, 999)] == [64, 96, 128, 256]


def test_information_against_counts(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 60)
    has = (y ^ (rng.random(60) < 0.2)).astype(int)
    members = spark.createDataFrame([(i, "x") for i in range(60) if has[i]] + [(i, "all") for i in range(60)], "key long, fragment string")
    labels = spark.createDataFrame([(i, int(y[i])) for i in range(60)], "key long, y int")
    expected = 0.0
    for a in (0, 1):
        for b in (0, 1):
            p = np.mean((has == a) & (y == b))
            expected += p * math.log(p / (np.mean(has == a) * np.mean(y == b))) if p else 0.0
    got = {r.fragment: r for r in features.by_information(members, labels, 5).collect()}
    assert math.isclose(got["x"].information, expected, rel_tol=1e-9) and abs(got["all"].information) < 1e-12 and got["x"]["rank"] == 1


def test_shadows_reject_noise(spark):
    rng = np.random.default_rng(7)
    rows = [(i, int(i % 2), float(i % 2 + rng.normal() * 0.2), float(rng.normal())) for i in range(120)]
    df = spark.createDataFrame(rows, "key long, y int, signal double, noise double")
    got = {r.column: r.is_kept for r in features.shadow_selection(df, ["signal", "noise"], rounds=5, trees=10).collect()}
    assert got == {"signal": True, "noise": False}


def test_display_sample(spark):
    rows = spark.range(100).selectExpr("id", "case when id < 60 then 'low' when id < 90 then 'middle' else 'high' end as c")
    got = {r.c: r["count"] for r in features.stratified_sample(rows, "id", "c", {"low": 7, "middle": 50}).groupBy("c").count().collect()}
    assert got == {"low": 7, "middle": 30, "high": 10}


def test_bandit(spark):
    state = spark.createDataFrame([("a", 0.5, 3, 1.0), ("b", 0.5, 0, 0.0)], "fragment string, probability double, attempts long, reward double")
    got = {r.fragment: r.updated for r in sampling.bandit_update(state).collect()}
    a, b = 0.5 * 3 * 0.95 + 0.025, 0.5 * 0.95 + 0.025
    assert math.isclose(got["a"], a / (a + b)) and math.isclose(got["b"], b / (a + b))
    library = spark.createDataFrame([("a",), ("b",), (None,)], "fragment string")
    used = sampling.usage(spark.createDataFrame([("a", 1, 0.5), ("a", 0, 1.5), ("z", 1, 1.0), (None, 1, 1.0)], "fragment string, success int, reward double"), library)
    assert {(r.fragment, r.attempts, r.successes, r.reward) for r in used.collect()} == {("a", 2, 1, 1.0), ("b", 0, 0, 0.0)}
    assert sampling.coverage(used).first().coverage == 0.5


def test_enrichment_does_not_depend_on_the_order_of_rows(spark, tmp_path):
    values = [0.1, 0.2, 0.3, 1e3, -1e3, 7.0005, -0.6]
    rng = np.random.default_rng(3)
    rows = [(m, f"{m}_{i}[*]", float(v)) for m in range(60) for i, v in enumerate(rng.permutation(values))]
    members = [(m, f) for m, f, _ in rows] + [(0, "unknown[*]"), (60, "unknown[*]"), (61, "plain")]
    spark.createDataFrame(members, "mol_id long, fragment string").write.parquet(str(tmp_path / "fragment_membership.parquet"))
    spark.createDataFrame([r[1:] for r in rows] + [("0_0[1*]", None)], "fragment_smiles string, ac_enrichment double").write.parquet(str(tmp_path / "selected_fragments.parquet"))
    got = {r.mol_id: (r.enrichment, r.n_known) for r in plans.enrichment_of_members(spark, str(tmp_path)).collect()}
    assert got.pop(60) == (0.0, 0) and len(got) == 60 and len(set(got.values())) == 1, set(got.values())
