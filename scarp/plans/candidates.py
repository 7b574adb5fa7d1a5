"""The candidate funnel over hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates as C
from ..operators.packed_fields import explode_packed
from ..skew import lookup_join
from ..store import Scratch
from ..tables import table
from .cliffs import plain_fragment


#: Fixed values of the funnel: most structures that leave the Pareto front, that are ranked, and that are picked in the end.
FRONT, RANKED, FINAL = 75_000, 25_000, 100


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "hits")


def aggregate_score(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(spark, folder).select("hit_id", F.round(C.aggregate_score(F.col("qsar"), F.col("sa"), F.col("qed")), 6).alias("total"))


def cafe_adjust(spark: SparkSession, folder: str) -> DataFrame:
    by = C.boost(F.col("cafe_enrichment"))
    adjusted = C.late_adjusted(F.col("qsar"), by)
    return _hits(spark, folder).select("hit_id", F.round(by, 6).alias("boost"), F.round(adjusted, 6).alias("adjusted"), ((F.col("qsar") < 0.5) & (adjusted >= 0.5)).alias("rescued"))


def cafe_boost(spark: SparkSession, folder: str) -> DataFrame:
    """Enrichment of each hit's own fragments, by the enrichment table."""
    used = explode_packed(_hits(spark, folder), "hit_id", "fragments", "hits.fragments").select(F.col("row_id").alias("key"), plain_fragment(F.regexp_replace("item", r"\s*\(AC\)$", "")).alias("fragment"))
    known = table(spark, folder, "ac_enrichment").select(plain_fragment(F.col("fragment_smiles")).alias("fragment"), "ac_enrichment").groupBy("fragment").agg(F.max("ac_enrichment").alias("enrichment")).where("fragment is not null")
    return C.fragment_boost(used, known).withColumnRenamed("key", "hit_id")


def enrichment_bins(spark: SparkSession, folder: str) -> DataFrame:
    x = F.col("cafe_enrichment")
    name = F.when((x >= 0) & (x <= 10), "0-10").when((x > 10) & (x <= 20), "10-20").when((x > 20) & (x <= 40), "20-40").when(x > 40, "40+").otherwise("none")
    return _hits(spark, folder).groupBy(name.alias("bin")).agg(F.count("*").alias("n"))


def reject_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """How many candidates are dropped for what: quality floor, known structure, repeat of an earlier one."""
    known = table(spark, folder, "chemical_space").select(F.col("canonical_smiles").alias("smiles"), F.lit(True).alias("known")).dropDuplicates(["smiles"])
    hits = lookup_join(_hits(spark, folder).select("hit_id", "smiles", "qed"), known, "smiles")
    first = hits.groupBy("smiles").agg(F.min("hit_id").alias("first"))
    reason = F.when(F.coalesce(F.col("qed") < 0.5, F.lit(True)), "qed").when(F.col("known"), "known").when(F.col("hit_id") != F.col("first"), "repeat").otherwise("kept")
    return lookup_join(hits, first, "smiles").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def pareto_front(spark: SparkSession, folder: str) -> DataFrame:
    return C.pareto_front(_hits(spark, folder).select("hit_id", "qsar", "sa", "qed"), ["qsar", "sa", "qed"]).select("hit_id", "qsar", "sa", "qed")


def rank_topk(spark: SparkSession, folder: str) -> DataFrame:
    return C.top_k(_hits(spark, folder).select("hit_id", "score"), "score", "hit_id", 100).select("hit_id", "rank")


def scaffold_balance(spark: SparkSession, folder: str) -> DataFrame:
    return C.per_group(_hits(spark, folder).select("hit_id", "core", "score").where("core is not null"), "core", "score", "hit_id", 5).select("hit_id", "core", F.col("group_rank").cast("int").alias("group_rank"))


def _distinct_hits(spark: SparkSession, folder: str) -> DataFrame:
    """The best scored hit of each structure; a hit without one stands for itself."""
    hits = _hits(spark, folder).select("hit_id", "score", "smiles", "qsar", "sa", "qed").dropDuplicates(["hit_id"])
    structure = F.coalesce(F.col("smiles"), F.concat(F.lit("#"), F.col("hit_id").cast("string")))
    score = F.coalesce(F.nanvl("score", F.lit(None).cast("double")), F.lit(float("-inf")))
    firsts = hits.groupBy(structure.alias("structure")).agg(F.max_by(F.struct("hit_id", "score", "qsar", "sa", "qed"), F.struct(score, -F.col("hit_id"))).alias("h"))
    return Scratch(spark, "funnel").save(firsts.select("h.*"), "kept")


def diverse_hits(spark: SparkSession, folder: str) -> DataFrame:
    """The selection funnel: distinct structures, Pareto front, the best by score, a diverse choice of them, final rank by score.

    As in the reference, a front is taken only of more than FRONT structures; RANKED are ranked and FINAL picked.
    """
    kept = _distinct_hits(spark, folder)
    if kept.count() > FRONT:
        kept = C.top_k(C.pareto_front(kept, ["qsar", "sa", "qed"]), "score", "hit_id", FRONT).drop("rank")
    best = C.top_k(kept, "score", "hit_id", RANKED)
    items = explode_packed(_hits(spark, folder), "hit_id", "fragments", "f").groupBy(F.col("row_id").alias("hit_id")).agg(F.array_sort(F.collect_set("item")).alias("toks"))
    ranked = Scratch(spark, "funnel").save(best.join(items, "hit_id", "left").withColumn("toks", F.coalesce("toks", F.array().cast("array<string>"))), "ranked")
    picked = C.greedy_diverse(ranked, "hit_id", "toks", FINAL)
    final = C.top_k(Scratch(spark, "funnel").save(picked.join(ranked.select("hit_id", "score"), "hit_id"), "picked"), "score", "hit_id", FINAL)
    return final.select("hit_id", "pick", "rank")


def selection_marks(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct structure with the stages of the funnel that it reaches."""
    kept = _distinct_hits(spark, folder)
    front = C.pareto_front(kept, ["qsar", "sa", "qed"]).select("hit_id", F.lit(True).alias("is_pareto"))
    ranked = C.top_k(kept, "score", "hit_id", 100).select("hit_id", F.lit(True).alias("is_rank_topk"))
    no = F.lit(False)
    return kept.select("hit_id").join(front, "hit_id", "left").join(ranked, "hit_id", "left").select("hit_id", F.coalesce("is_pareto", no).alias("is_pareto"), F.coalesce("is_rank_topk", no).alias("is_rank_topk"))


def core_usage(spark: SparkSession, folder: str) -> DataFrame:
    """How often each core is used, in percent of the most used."""
    usage = _hits(spark, folder).where("core is not null").groupBy("core").agg(F.count("*").alias("n_used"))
    most = usage.agg(F.max("n_used").alias("most"))
    return usage.crossJoin(F.broadcast(most)).select("core", "n_used", F.round(F.col("n_used") * 100.0 / F.col("most"), 4).alias("usage_pct"))  # most: one row


def weighted_fragments(spark: SparkSession, folder: str) -> DataFrame:
    """A draw of 20 fragments by importance."""
    return C.weighted_sample(table(spark, folder, "selected_fragments").select("row_id", "importance"), "row_id", F.col("importance"), 20).select("row_id")


QUERIES = {f.__name__: f for f in (aggregate_score, cafe_adjust, cafe_boost, enrichment_bins, reject_reasons, pareto_front, rank_topk, scaffold_balance, diverse_hits, selection_marks, core_usage, weighted_fragments)}

_BOOST = "CASE WHEN cafe_enrichment > 0 THEN 1 - exp(-cafe_enrichment / 30) ELSE 0 END"
ORACLE_SQL = {
    "aggregate_score": "SELECT hit_id, round(0.4 * qsar + 0.4 * sa + 0.2 * qed, 6) AS total FROM hits",
    "cafe_adjust": f"""WITH b AS (SELECT hit_id, qsar, {_BOOST} AS b FROM hits), w AS (SELECT *, CASE WHEN qsar < 0.5 THEN 0.4 * b ELSE 0.2 * b END AS w, CASE WHEN qsar < 0.5 THEN 0.75 ELSE 0.85 END AS t FROM b), a AS (SELECT *, greatest(qsar, least(greatest((1 - w) * qsar + w * t, 0), 1)) AS a FROM w)
        SELECT hit_id, round(b, 6) AS boost, round(a, 6) AS adjusted, qsar < 0.5 AND a >= 0.5 AS rescued FROM a""",
    "enrichment_bins": "SELECT CASE WHEN cafe_enrichment BETWEEN 0 AND 10 THEN '0-10' WHEN cafe_enrichment > 10 AND cafe_enrichment <= 20 THEN '10-20' WHEN cafe_enrichment > 20 AND cafe_enrichment <= 40 THEN '20-40' WHEN cafe_enrichment > 40 THEN '40+' ELSE 'none' END AS bin, count(*) AS n FROM hits GROUP BY 1",
    "pareto_front": "WITH u AS (SELECT hit_id, qsar, sa, qed FROM hits WHERE qsar IS NOT NULL AND sa IS NOT NULL AND qed IS NOT NULL AND NOT isnan(qsar) AND NOT isnan(sa) AND NOT isnan(qed)) SELECT * FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.qsar >= a.qsar AND b.sa >= a.sa AND b.qed >= a.qed AND (b.qsar > a.qsar OR b.sa > a.sa OR b.qed > a.qed))",
    "rank_topk": "SELECT hit_id, row_number() OVER (ORDER BY CASE WHEN isnan(score) THEN NULL ELSE score END DESC NULLS LAST, hit_id) AS rank FROM hits QUALIFY rank <= 100",
    "scaffold_balance": "SELECT hit_id, core, CAST(row_number() OVER (PARTITION BY core ORDER BY CASE WHEN isnan(score) THEN NULL ELSE score END DESC NULLS LAST, hit_id) AS INT) AS group_rank FROM hits WHERE core IS NOT NULL QUALIFY group_rank <= 5",
    "selection_marks": """WITH o AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY coalesce(smiles, '#' || hit_id) ORDER BY CASE WHEN isnan(score) THEN NULL ELSE score END DESC NULLS LAST, hit_id) = 1),
        u AS (SELECT hit_id, qsar, sa, qed FROM o WHERE NOT isnan(qsar) AND NOT isnan(sa) AND NOT isnan(qed)),
        f AS (SELECT hit_id FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.qsar >= a.qsar AND b.sa >= a.sa AND b.qed >= a.qed AND (b.qsar > a.qsar OR b.sa > a.sa OR b.qed > a.qed)))
        SELECT hit_id, hit_id IN (SELECT hit_id FROM f) AS is_pareto, row_number() OVER (ORDER BY CASE WHEN isnan(score) THEN NULL ELSE score END DESC NULLS LAST, hit_id) <= 100 AS is_rank_topk FROM o""",
    "core_usage": "SELECT core, count(*) AS n_used, round(count(*) * 100.0 / max(count(*)) OVER (), 4) AS usage_pct FROM hits WHERE core IS NOT NULL GROUP BY core",
    "weighted_fragments": "SELECT row_id FROM selected_fragments WHERE importance > 0 ORDER BY round(-ln(((row_id * 7919 + 104729) % 1000003 + 1) / 1000004.0::DOUBLE) / importance, 9), row_id LIMIT 20",
    "reject_reasons": """WITH h AS (SELECT qed, smiles, hit_id, min(hit_id) OVER (PARTITION BY smiles) AS f FROM hits)
    SELECT CASE WHEN coalesce(qed < 0.5, true) THEN 'qed' WHEN smiles IN (SELECT canonical_smiles FROM chemical_space) THEN 'known' WHEN smiles IS NOT NULL AND hit_id <> f THEN 'repeat' ELSE 'kept' END AS reason, count(*) AS n FROM h GROUP BY 1""",
}
