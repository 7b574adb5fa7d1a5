from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from scarp.llm import groups, mixing, packing, set_join


def test_groups_against_union_find(spark):
    rng = np.random.default_rng(5)
    pairs = [(f"m{a}", f" m{b}\t") for a, b in rng.integers(0, 120, (70, 2)).tolist()] + [("x", None), ("", "y"), ("z", "z")]
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in pairs:
        if a and b and b.strip():
            parent[root(a)] = root(b.strip())
    series = {}
    for v in list(parent):
        series.setdefault(root(v), []).append(v)
    expected = {(min(m), v) for m in series.values() for v in m}
    got = groups.consolidate(spark.createDataFrame(pairs, "a string, b string"), "a", "b")
    assert {(r.group_mol, r.mol) for r in got.collect()} == expected


@pytest.mark.parametrize("t", [Fraction(1, 2), Fraction(3, 5), Fraction(7, 10), Fraction(4, 5), Fraction(9, 10), Fraction(1)])
def test_similar_sets_at_every_threshold(spark, t):
    rng = np.random.default_rng(int(100 * t))
    sets = {i: set(rng.choice(30, int(rng.integers(1, 26)), replace=False).tolist()) for i in range(50)}
    for i in range(50, 130):
        sets[i] = set(sets[int(rng.integers(0, i))])
        for _ in range(int(rng.integers(0, 5))):
            sets[i].symmetric_difference_update({int(rng.integers(0, 30))})
    expected = {(i, j): Fraction(len(sets[i] & sets[j]), len(sets[i] | sets[j])) for i in sets for j in sets if i < j and sets[i] | sets[j]}
    expected = {pair: float(sim) for pair, sim in expected.items() if sim >= t}
    df = spark.createDataFrame([(i, f"t{x}") for i, s in sets.items() for x in s], "k long, t string")
    got = {(r.mol_i, r.mol_j): r.sim for r in set_join.similar_pairs(df, "k", F.col("t"), t, left_out=2 if t < 1 and t.denominator == 5 else 1).collect()}
    assert got.keys() == expected.keys() and all(abs(got[p] - expected[p]) < 1e-12 for p in got)


def test_links_of_copies_are_counted_not_made(spark):
    df = spark.createDataFrame([(i, t) for i in range(40) for t in "abcd"] + [(50, t) for t in "abcde"] + [(60, "z"), (70, None)], "k long, t string")
    got = {r.k: (r.class_id, r.copies, r.n_links) for r in set_join.linked_members(df, "k", F.col("t")).collect()}
    assert got == {**{i: (0, 40, 40) for i in range(40)}, 50: (50, 1, 40), 60: (60, 1, 0)}


@pytest.mark.parametrize("most", [1, 2])
def test_small_sets_leave_out_few_tokens(most):
    for t in (Fraction(1, 2), Fraction(3, 5), Fraction(7, 10), Fraction(4, 5), Fraction(9, 10)):
        limit = set_join.small_limit(t, most)
        assert max(skip for _, skip, _ in set_join.subset_plan(limit, t)) <= most
        assert limit == set_join.MOST_SMALL or max(skip for _, skip, _ in set_join.subset_plan(limit + 1, t)) > most


def test_similar_sets_against_brute_force(spark):
    rng = np.random.default_rng(9)
    base = [rng.choice(60, n, replace=False).tolist() for n in (3, 5, 9, 14, 15, 20, 25)]
    sets = {}
    for i in range(70):
        s = set(base[i % len(base)])
        for _ in range(int(rng.integers(0, 3))):
            s.symmetric_difference_update({int(rng.integers(0, 60))})
        sets[i] = s
    df = spark.createDataFrame([(i, str(t)) for i, s in sets.items() for t in s] + [(500, None)], "k long, t string")
    got = {(r.mol_i, r.mol_j) for r in set_join.similar_pairs(df, "k", F.col("t")).collect()}
    assert got == {(i, j) for i in sets for j in sets if i < j and sets[i] | sets[j] and Fraction(len(sets[i] & sets[j]), len(sets[i] | sets[j])) >= Fraction(4, 5)}


def test_packing_keeps_all_tokens_within_capacity(spark):
    sizes = spark.createDataFrame([(i, int(1 + (i * 37) % 70)) for i in range(300)] + [(900, 250), (901, 0), (902, None)], "doc_id long, n_tokens long")
    packed = packing.pack(sizes, spark.createDataFrame([("s", 64), ("none", None)], "budget_name string, capacity_tokens int"))
    boxes = packed.groupBy("container_no").agg(F.sum("n_tokens").alias("n")).collect()
    assert max(r.n for r in boxes) <= 64
    assert sum(r.n for r in boxes) == sum(1 + (i * 37) % 70 for i in range(300)) + 250


def test_quotas():
    targets = {"a": (0.5, 2), "b": (0.5, 1), "c": (0.1, 1)}
    assert mixing.quotas({"a": 500, "b": 1000}, targets, 600) == {"a": 300, "b": 300}
    # a gives all it has twice, b what is left of the total
    assert mixing.quotas({"a": 100, "b": 1000}, targets, 600) == {"a": 200, "b": 400}
    assert mixing.quotas({"a": 100, "b": 1000}, targets, 9999) == {"a": 200, "b": 1000}
    assert mixing.quotas({"a": 100, "b": 1000}, targets) == {"a": 200, "b": 900}
    assert mixing.quotas({}, targets) == {}


def test_slots_reach_every_turn(spark):
    for turns in ({"a": 1, "b": 400}, {"a": 7, "b": 7, "c": 90}, {"a": 1}):
        shares = {s: k / sum(turns.values()) for s, k in turns.items()}
        n = mixing.slots_for(turns, shares)
        counts = {r.source: r.n for r in mixing.schedule(n, sorted(shares.items()), spark.range(n)).groupBy("source").agg(F.count("*").alias("n")).collect()}
        assert all(counts[s] >= k for s, k in turns.items())
