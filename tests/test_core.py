import http.server
import json
import math
import threading
from urllib.parse import parse_qs, urlparse

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scarp import skew
from scarp.functions import units
from scarp.operators import candidates, fragments, metrics, preparation, similarity, splits
from scarp.operators.packed_fields import explode_packed, split_array
from scarp.plans import registry
from scarp.sources import files, paged

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "text, kind, expected",
    [
        ("[*]C; [*]N", "value", ["[*]C", "[*]N"]),
        ('["a", "b"]', "value", ["a", "b"]),
        ("('a|b'), ", "value", None),
        ("a|b; c|d", "pair", ["a|b", "c|d"]),
        ("1, 2;3", "index", ["1", "2", "3"]),
        ("3,4-dichloro; x", "value", ["3,4-dichloro", "x"]),
        ("nan", "value", []),
        ("", "value", []),
        (None, "value", []),
    ],
)
def test_packed(text, kind, expected):
    rows, pos, items = split_array(pa.array([text], pa.string()), kind)
    if expected is not None:
        assert items.to_pylist() == expected
        assert list(pos) == list(range(1, len(expected) + 1))


def test_packed_frame(spark):
    df = spark.createDataFrame([(1, "a;b", 0), (2, None, 0), (3, "x;" * 30_000 + "y", 0)], "id long, item string, pos int")
    got = explode_packed(df, "id", "item", "t.f")
    assert got.groupBy("row_id").count().collect() and got.where("row_id = 3").count() == 30_001
    assert explode_packed(df.limit(0), "id", "item", "t.f").count() == 0


def test_units(spark):
    df = spark.createDataFrame([(">= 1,234.5 nM",), ("2.5 x 10^3",), ("abc",), (None,)], "v string")
    got = [r.p.number for r in df.select(units.parse_value(F.col("v")).alias("p")).collect()]
    assert got == [1234.5, 2500.0, None, None]


def test_pic50_goldens(spark):
    got = spark.createDataFrame([(4.0,), (48.0,), (414.0,), (0.0,), (None,)], "v double").select(preparation.pic50(F.col("v")).alias("p")).collect()
    assert [None if r.p is None else round(r.p, 9) for r in got] == [8.397940009, 7.318758763, 6.382999659, None, None]


def test_sali_golden(spark):
    row = spark.range(1).select(similarity.sali(F.lit(0.819672131147541), F.lit(1.1930347845847482)).alias("s")).first()
    assert math.isclose(row.s, 6.615883480979756, rel_tol=1e-12)


def test_score_goldens(spark):
    row = spark.range(1).select(
        candidates.aggregate_score(F.lit(0.8108265556828209), F.lit(0.802741249904775), F.lit(0.9220142940106776)).alias("s"),
        candidates.late_adjusted(F.lit(0.5), F.lit(0.5)).alias("half"),
        candidates.late_adjusted(F.lit(0.9), F.lit(0.5)).alias("high"),
    ).first()
    assert math.isclose(row.s, 0.8298299810371739, rel_tol=1e-9) and math.isclose(row.half, 0.5 * 0.9 + 0.1 * 0.85) and row.high == 0.9


def test_tanimoto_against_brute_force(spark):
    rng = np.random.default_rng(3)
    sets = {i: frozenset(rng.choice(12, rng.integers(1, 8), replace=False).tolist()) for i in range(60)}
    df = spark.createDataFrame([(i, int(t)) for i, s in sets.items() for t in s] + [(999, None)], "k long, t long")
    for t in (0.5, 0.8, 1.0):
        got = {(r.a, r.b) for r in similarity.tanimoto_join(similarity.tokens(df, "k", F.col("t")), t).collect()}
        assert got == {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) - 1e-12}


def test_large_vocabularies_are_numbered_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BROADCAST_TOKENS", 3)
    rows = [(1, "a"), (1, "b"), (2, "A"), (2, "b"), (3, "b"), (3, "c"), (3, "d"), (4, "-")]
    clean = lambda tok: F.when(tok != "-", F.lower(tok))
    found = similarity.similar_classes(spark.createDataFrame(rows, "key long, tok string"), 0.2, clean)
    assert {(r.a, r.b): round(r.sim, 6) for r in similarity.expanded(found).collect()} == {(1, 2): 1.0, (1, 3): 0.25, (2, 3): 0.25}


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200)] + [(300, 300 + i) for i in range(1, 30)]
    got = {r.key: r.group_key for r in similarity.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and all(got[300 + i] == 300 for i in range(30)) and 200 not in got
    assert similarity.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_percentile(spark):
    for values in ([0.2, 0.4, 0.9], [1.0], list(np.random.default_rng(1).random(500)), [2.0] * 50 + [3.0]):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
        for q in (0.0, 0.5, 0.99, 1.0):
            assert math.isclose(skew.exact_percentile(df, "v", q), float(np.percentile(values, q * 100)), rel_tol=1e-9)
    assert skew.exact_percentile(spark.createDataFrame([], "v double"), "v", 0.5) is None


def test_ranking_ties(spark):
    rows = [("a", 1, 0.5), ("a", 0, 0.5), ("a", 1, 0.9), ("a", 0, 0.1), ("b", 1, 0.3), ("a", None, 0.4), ("a", 1, None)]
    got = {r.m: r for r in metrics.ranking(spark.createDataFrame(rows, "m string, y int, p double"), ["m"]).collect()}
    assert math.isclose(got["a"].auroc, 0.875) and got["b"].auroc is None
    assert math.isclose(got["a"].average_precision, 0.5 * 1 + 0.5 * 2 / 3)


def test_group_split_does_not_straddle(spark):
    rows = spark.range(400).selectExpr("id as k", "cast(id % 3 = 0 as int) as y", "id div 5 as g")
    got = splits.grouped(rows, "k", "y", "g", 0.2, trials=16)
    assert got.groupBy("g").agg(F.countDistinct("part").alias("n")).where("n > 1").count() == 0 and 0 < got.where("part = 'test'").count() < 400


def test_front_and_empty(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 1.0), (3, 0.5, 0.5), (4, None, 9.0), (5, 2.0, float("nan"))], "k long, a double, b double")
    assert {r.k for r in candidates.pareto_front(df, ["a", "b"]).collect()} == {1, 2}
    assert candidates.pareto_front(df.limit(0), ["a", "b"]).count() == 0


@pytest.mark.parametrize("few", [0, 4096])
def test_front_against_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(candidates, "FEW", few)
    rng = np.random.default_rng(2)
    free, line = rng.random((300, 3)).round(2), np.linspace(0, 1, 200)
    for points in (free, np.c_[line, 1 - line, np.zeros(200)]):  # independent objectives, and opposed ones: all on the front
        df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "k long, a double, b double, c double")
        expected = {i for i, p in enumerate(points) if not ((points >= p).all(axis=1) & (points > p).any(axis=1)).any()}
        assert {r.k for r in candidates.pareto_front(df, ["a", "b", "c"], levels=4).collect()} == expected


def test_first_k(spark):
    values = [(i, float(v)) for i, v in enumerate(np.random.default_rng(5).integers(0, 40, 300))] + [(900, None), (901, float("nan"))]
    df = spark.createDataFrame(values, "k long, v double")
    order = sorted(values[:300], key=lambda r: (r[1], r[0]))
    for k in (0, 1, 7, 150, 302, 999):
        got = {r.k: r.rank for r in skew.first_k(df, F.col("v"), ["k"], k).collect()}
        assert got == {key: i + 1 for i, key in enumerate([r[0] for r in order] + [900, 901]) if i < k}
    assert skew.first_k(df.limit(0), F.col("v"), ["k"], 3).count() == 0


def test_hot_keys_keep_all_rows(spark):
    left = spark.createDataFrame([(i % 3 if i % 2 else 7, i) for i in range(400)] + [(None, 1)], "k long, i long")
    right = spark.createDataFrame([(0, "a"), (7, "h")], "k long, v string")
    for how in ("left", "inner"):
        assert sorted(map(str, skew.lookup_join(left, right, "k", how).collect())) == sorted(map(str, left.join(right, "k", how).collect()))
    two = left.select("k", F.col("i").alias("j"))
    assert sorted(map(tuple, skew.blocked_join(left, two, "k").collect())) == sorted(map(tuple, left.join(two, "k").collect()))


def test_ranks_and_sums_of_hot_groups(spark):
    df = spark.createDataFrame([("hot" if i % 3 else f"g{i}", i, 1 + i % 5) for i in range(300)], "g string, i long, v long").withColumn("h", F.xxhash64("i"))
    ranks = skew.salted_rank(df, ["g"], [F.col("i")], "r", id_cols=["i"]).groupBy("g").agg(F.sort_array(F.collect_list("r")).alias("r")).collect()
    assert all(r.r == list(range(1, len(r.r) + 1)) for r in ranks)
    for g in ("hot", "g0"):
        total = 0
        for r in sorted((r for r in skew.running_sum(df, ["g"], "h", ["i"], "v", "before").collect() if r.g == g), key=lambda r: r.h):
            assert r.before == total
            total += r.v


def test_diverse_choice_against_the_plain_rule(spark, monkeypatch):
    monkeypatch.setattr(candidates, "LOOK_AHEAD", 5)
    rng = np.random.default_rng(9)
    sets = [sorted({f"t{t}" for t in rng.integers(0, 9, rng.integers(0, 5))}) for _ in range(80)]
    df = spark.createDataFrame([(100 + i, i + 1, s) for i, s in enumerate(sets)], "id long, rank int, toks array<string>")
    sim = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0
    chosen = []
    while len(chosen) < 30:
        chosen.append(min((i for i in range(80) if i not in chosen), key=lambda i: (max((sim(sets[i], sets[c]) for c in chosen), default=-1.0), i)))
    got = {r.id - 100: r.pick for r in candidates.greedy_diverse(df, "id", "toks", 30).collect()}
    assert got == {c: i + 1 for i, c in enumerate(chosen)}
    assert candidates.greedy_diverse(df.limit(0), "id", "toks", 3).count() == 0


def test_potency_of_records_by_identifier_and_structure(spark, tmp_path):
    from scarp.plans import cliffs, preparation as plan

    space = [(1, "CHEMBL7", "CC"), (2, "CHEMBL8", "CN"), (3, "CHEMBL9", "CO")]
    spark.createDataFrame(space, "mol_id long, chembl_id string, canonical_smiles string").write.parquet(str(tmp_path / "chemical_space.parquet"))
    records = [(1, "chembl-007", None, 10.0), (2, None, "\tCC ", 1000.0), (3, "CHEMBL 8", "wrong", 100.0), (3, "CHEMBL 8", "wrong", 100.0), (4, None, "  ", 5.0), (5, "CHEMBL9", "CO", None)]
    spark.createDataFrame(records, "record_id long, chembl_id string, canonical_smiles string, standard_value double").write.parquet(str(tmp_path / "removed_compounds.parquet"))
    assert {r.key: round(r.p, 9) for r in cliffs.potency(spark, str(tmp_path)).collect()} == {1: 7.0, 2: 7.0}
    assert plan.removed_antijoin(spark, str(tmp_path)).count() == 0


def test_enrichment_is_one_sided(spark):
    pairs = spark.createDataFrame([(1, 2, 8.0, 6.0, 5.0)], "a long, b long, pa double, pb double, sali double")
    members = spark.createDataFrame([(1, "x"), (1, "z"), (2, "y"), (2, "z")], "key long, fragment string")
    assert {r.fragment: r.enrichment for r in fragments.cliff_enrichment(pairs, members).collect()} == {"x": 5.0, "y": -5.0}


def test_own_compounds(spark, tmp_path):
    path = tmp_path / "own.csv"
    path.write_text("ID;SMILES;activity_flag;standard_value;standard_units\nA;CC; Active ;2;uM\n;CN;inactive;5;\nB;;active;1;nM\n")
    rows = files.read_own_compounds(spark, str(path)).collect()
    assert [(r.id, r.smiles, r.activity_flag, r.nm) for r in rows] == [("OWN_A", "CC", "active", 2000.0), (None, "CN", "inactive", 5.0)]


def test_paged_source(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: int(v[0]) for k, v in parse_qs(urlparse(self.path).query).items() if k in ("offset", "limit")}
            items = [{"molecule_chembl_id": f"C{i}", "standard_value": i} for i in range(q["offset"], min(25, q["offset"] + q["limit"]))]
            body = json.dumps({"page_meta": {"total_count": 25}, "activities": items}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    paged.register(spark)
    df = spark.read.format("paged_json").schema("molecule_chembl_id string, standard_value string").options(url=f"http://127.0.0.1:{server.server_port}/a", limit="10").load()
    assert df.rdd.getNumPartitions() == 3 and df.distinct().count() == 25
    server.shutdown()


@pytest.mark.parametrize("name", ["activity_cliffs", "clean_compounds", "fragment_freq_by_class", "classification_metrics", "pareto_front"])
def test_against_sql(spark, name):
    from oracle import compare

    ours, theirs = compare(spark, SF, name, registry.queries()[name], registry.oracle_sql()[name])
    assert ours == theirs
