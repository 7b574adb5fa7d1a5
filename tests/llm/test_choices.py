from datetime import datetime

from pyspark.sql import functions as F

from scarp.llm import mixing, representatives, varied_subset

RECORDS = "record_id long, chembl_id string, canonical_smiles string, activity_flag string, standard_value double, pic50 double, source_name string, curated_at timestamp, extra string"


def _tables(spark, records):
    space = spark.createDataFrame([("CHEMBL12", "CC"), ("CHEMBL7", "CN")], "chembl_id string, canonical_smiles string")
    sources = spark.createDataFrame([("good", 1), ("also", 1), ("poor", 9)], "source_name string, trust_rank int")
    return spark.createDataFrame(records, RECORDS), space, sources


def test_best_readings(spark):
    day = lambda d: datetime(2020, 1, d)
    nan = float("nan")
    records = [
        (1, " chembl:0012", None, "Active", nan, -999.0, "good", day(1), "x"),
        (2, "CHEMBL12", "CC", None, 5.0, 6.0, "poor", day(9), "x"),
        (3, None, " CC ", "n.d.", 7.0, 7.0, None, None, "x"),
        (4, "CHEMBL12", None, "IN-ACTIVE", -1.0, nan, "also", day(2), "x"),
        (4, "CHEMBL12", None, "IN-ACTIVE", -1.0, nan, "also", day(2), "x"),
        (5, "CHEMBL7", "CN", "active", 1.0, 5.0, "good", day(1), "x"),
        (5, "CHEMBL7", "CN", "active", 1.0, 5.0, "good", day(1), "x"),
        (6, "", "  ", "active", 1.0, 5.0, "good", day(1), "x"),
        (9, "CHEMBL99", None, "active", 2.0, None, "good", None, "x"),
        (8, "CHEMBL99", None, "active", 3.0, None, "good", None, "x"),
    ]
    got = {(r.chembl_id, r.field_name): r.record_id for r in representatives.best_readings(*_tables(spark, records)).collect()}
    assert got == {
        ("CHEMBL12", "activity_flag"): 4, ("CHEMBL12", "standard_value"): 2, ("CHEMBL12", "pic50"): 2,
        ("CHEMBL99", "activity_flag"): 8, ("CHEMBL99", "standard_value"): 8,
    }
    merged = {r.chembl_id: r for r in representatives.merged_records(*_tables(spark, records)).collect()}
    assert merged["CHEMBL12"].is_active == 0 and merged["CHEMBL12"].standard_value == 5.0 and merged["CHEMBL99"].pic50 is None
    assert representatives.best_readings(*_tables(spark, [])).count() == 0


def test_varied_subset_spreads(spark):
    crowd = [(i, "CCCCCCCCCC" + "CN"[i % 2] * (i % 5), "ring", 0.8) for i in range(300)]
    rare = [(1000 + i, chr(65 + i) * 4 + f"xyz{i * 7919}" + chr(97 + i) * 5, f"core{i}", 0.8) for i in range(12)]
    odd = [(2000, None, "ring", 0.9), (2001, "", None, None), (2002, "Zq!" * 4, None, float("nan")), (2003, "A", None, -1.0)]
    hits = spark.createDataFrame(crowd + rare + odd, "hit_id long, smiles string, core string, score double")
    got = varied_subset.varied_subset(hits, 12).collect()
    assert len(got) == 12 and len({r.smiles for r in got}) == 12 and sorted(r.draw_rank for r in got) == list(range(1, 13))
    assert sum(r.hit_id >= 1000 for r in got) >= 9
    assert varied_subset.varied_subset(hits, 10_000).count() == hits.where("smiles <> ''").select(F.trim("smiles")).distinct().count()
    assert varied_subset.varied_subset(hits.limit(0), 5).count() == 0


def test_mixture_meets_shares(spark):
    posts = [(i, ("a", "b", "b", "b", "none", None)[i % 6], 20 + i % 50) for i in range(3000)] + [(9000, "a", 0), (9001, "b", None)]
    sizes = spark.createDataFrame(posts, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1), ("empty", 0.0, 1)], "doc_source string, target_share double, max_repeats int")
    mixed = mixing.mix(sizes, targets, total=60_000)
    report = {r.doc_source: r for r in mixing.share_report(mixed, targets).collect()}
    assert abs(report["a"].reached_share - 0.5) < 0.001 and report["a"].repeats == 2 and report["b"].repeats == 1 and report["empty"].tokens == 0
    assert mixed.groupBy("doc_id", "repeat_no").count().where("count > 1").count() == 0
    half = mixed.agg(F.expr("percentile(slot, 0.5)")).first()[0]
    early = {r.source: r.n for r in mixed.where(F.col("slot") < half).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    assert abs(early["a"] / sum(early.values()) - 0.5) < 0.05
    assert mixing.mix(sizes.limit(0), targets).count() == 0


def test_schedule_ranks_the_slots(spark):
    rows = mixing.schedule(1000, [("a", 0.25), ("b", 0.75)], spark.range(1000)).collect()
    for source, share in (("a", 0.25), ("b", 0.75)):
        own = sorted((r.slot, r.turn) for r in rows if r.source == source)
        assert [t for _, t in own] == list(range(len(own))) and abs(len(own) - 1000 * share) <= 10
