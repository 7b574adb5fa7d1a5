"""Names, scales, information and use of features, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import models, sampling
from ..operators import preparation as P
from ..operators.packed_fields import explode_packed
from ..skew import lookup_join
from ..store import Scratch
from ..tables import table
from .cliffs import _BASE, attached_fragment, potency
from .evaluation import _members

#: Other spellings of measured quantities, and how many rows of each class a display shows.
ALIASES = {"ic50": "IC50", "ec50": "EC50", "ki": "Ki", "kd": "Kd", "pic50": "pIC50", "-log(ic50)": "pIC50", "pec50": "pEC50", "pki": "pKi"}
CAPS = {"low": 50, "middle": 100}
BAND = (200.0, 500.0)


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    return potency(spark, folder).select("key", P.label_ge(F.col("p"), 1000.0).alias("y"))


def scaled_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Logit of the probability, score from 0 to 1 within a run, and its clip."""
    rows = X.min_max(table(spark, folder, "hits").select("hit_id", "run_no", "qsar", "score"), "score", ["run_no"], "scaled")
    return rows.select("hit_id", F.round(X.logit(F.col("qsar")), 6).alias("logit"), F.round("scaled", 6).alias("scaled"), F.round(X.clipped(F.col("scaled") * 1.5 - 0.25), 6).alias("clipped"))


def feature_names(spark: SparkSession, folder: str) -> DataFrame:
    """Fragments as feature names: without brackets, marked and unmarked, and with their position."""
    named = table(spark, folder, "selected_fragments").select("row_id", X.clean_name(F.col("fragment_smiles")).alias("name"), F.format_string("bit_%04d", "row_id").alias("bit"))
    return named.select("row_id", "name", X.prefixed(F.col("bit")).alias("marked"), X.unprefixed(X.prefixed(F.col("bit"))).alias("plain"), X.feature_index(F.col("bit"), 1).alias("position"))


def canonical_types(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per canonical name of the measured quantity; unknown spellings stay, trimmed."""
    written = F.trim("standard_type")
    name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair]), F.lower(written)), written)
    return table(spark, folder, "raw_activities").groupBy(name.alias("quantity")).agg(F.count("*").alias("n"))


def fragment_information(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 fragments that say most about the label."""
    best = X.by_information(_members(spark, folder), _labels(spark, folder), 50)
    return best.select("fragment", "n", F.round("information", 6).alias("information"), "rank")


def descriptor_choice(spark: SparkSession, folder: str) -> DataFrame:
    """Descriptors in order of variance, with whether shadow features let them pass."""
    columns = ["mol_wt", "alogp", "max_phase"]
    rows = models.descriptors(table(spark, folder, "chemical_space"), "mol_id", columns)
    kept = X.distinct_columns(rows, rows.columns[1:])
    labelled = Scratch(spark, "choice").save(rows.join(_labels(spark, folder), "key"), "rows")
    chosen = X.shadow_selection(labelled, kept, rounds=5)
    order = X.by_variance(table(spark, folder, "chemical_space"), kept, len(kept))
    ranks = spark.createDataFrame([(c, i + 1) for i, c in enumerate(order)], "column string, variance_rank int")
    return chosen.join(F.broadcast(ranks), "column")  # a row per descriptor


def display_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Few hits of low and middling score and all others, for a plot."""
    score = F.col("score")
    rows = table(spark, folder, "hits").select("hit_id", F.when(score < 0.6, "low").when(score < 0.8, "middle").when(score >= 0.8, "high").alias("class"))
    return X.stratified_sample(rows.where("class is not null"), "hit_id", "class", CAPS)


def core_order(spark: SparkSession, folder: str) -> DataFrame:
    """Best and mean score of each core."""
    score = F.nanvl("score", F.lit(None).cast("double"))
    return table(spark, folder, "hits").where("core is not null").groupBy("core").agg(F.max(score).alias("best"), F.round(F.avg(score), 6).alias("mean"), F.count("*").alias("n"))


def weight_window(spark: SparkSession, folder: str) -> DataFrame:
    """Molecules within the weight band."""
    return table(spark, folder, "chemical_space").where(F.col("mol_wt").between(*BAND)).select("mol_id", "mol_wt")


def pre_boost(spark: SparkSession, folder: str) -> DataFrame:
    """Probability before the boost and whether the boost rescued the hit."""
    before = F.col("qsar") - F.col("cafe_boost")
    rows = table(spark, folder, "hits").where("qsar is not null and cafe_boost is not null")
    return rows.select("hit_id", F.round(before, 6).alias("before"), ((before < 0.5) & (F.col("qsar") >= 0.5)).alias("rescued"))


def tagged_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of several tables one under the other, with their origin."""
    read = lambda name, key, source: table(spark, folder, name).select(F.lit(name).alias("origin"), F.col(key).alias("row_key"), F.col(source).alias("source_name"))
    return read("raw_activities", "activity_id", "source_name").unionByName(read("removed_compounds", "record_id", "source_name")).groupBy("origin", "source_name").agg(F.countDistinct("row_key").alias("n"))


def _library(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "selected_fragments").select(attached_fragment(F.col("fragment_smiles")).alias("fragment"), F.col("ac_enrichment").alias("enrichment"))


def _usage(spark: SparkSession, folder: str) -> DataFrame:
    hits = table(spark, folder, "hits")
    used = explode_packed(hits, "hit_id", "fragments", "hits.fragments").select(F.col("row_id").alias("hit_id"), attached_fragment(F.regexp_replace("item", r"\s*\(AC\)$", "")).alias("fragment"))
    told = hits.groupBy("hit_id").agg(F.max(F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.0))).alias("reward"))
    uses = used.join(told, "hit_id").select("fragment", (F.col("reward") >= 0.8).cast("int").alias("success"), "reward")
    return Scratch(spark, "usage").save(sampling.usage(uses, _library(spark, folder)), "usage")


def fragment_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Use of every fragment of the library by hits, its reward, the weight by inverse use and the bandit's next probability."""
    state = sampling.normalised(_usage(spark, folder), sampling.inverse_usage(F.col("attempts")), "probability")
    return sampling.bandit_update(state).select("fragment", "attempts", "successes", *[F.round(c, 9).alias(c) for c in ("reward", "probability", "updated")])


def fragment_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.coverage(_usage(spark, folder)).withColumn("coverage", F.round("coverage", 6))


def enrichment_of_members(spark: SparkSession, folder: str) -> DataFrame:
    """Every molecule's fragments with their enrichment, 0 for those without one, summed up from the smallest on, so that no order of rows decides what a tie is rounded to."""
    known = _library(spark, folder).where("fragment is not null").groupBy("fragment").agg(F.max("enrichment").alias("enrichment"))
    members = Scratch(spark, "members").save(_members(spark, folder), "members")
    told = lookup_join(members, known, "fragment")
    values = told.groupBy(F.col("key").alias("mol_id")).agg(F.array_sort(F.collect_list("enrichment")).alias("x"), F.count("enrichment").alias("n_known"))
    return values.select("mol_id", F.round(F.aggregate("x", F.lit(0.0), lambda total, x: total + x), 3).alias("enrichment"), "n_known")


QUERIES = {f.__name__: f for f in (scaled_scores, feature_names, canonical_types, fragment_information, descriptor_choice, display_sample, core_order, weight_window, pre_boost, tagged_records, fragment_usage, fragment_coverage, enrichment_of_members)}

_PLAIN = r"nullif(regexp_replace(trim({c}), '\[(?:\d+\*|\*:\d+|\d+\*:\d+)\]', '[*]', 'g'), '')"
_DRAWN = "(({k} * 7919 + 104729 + 15485863 * 42) % 1000003)"
ORACLE_SQL = {
    "scaled_scores": """WITH s AS (SELECT hit_id, qsar, (score - min(score) OVER (PARTITION BY run_no)) / (max(score) OVER (PARTITION BY run_no) - min(score) OVER (PARTITION BY run_no) + 1e-9) AS s FROM hits)
        SELECT hit_id, round(ln(least(greatest(qsar, 1e-6), 1 - 1e-6) / (1 - least(greatest(qsar, 1e-6), 1 - 1e-6))), 6) AS logit, round(s, 6) AS scaled, round(least(greatest(s * 1.5 - 0.25, 0), 1), 6) AS clipped FROM s""",
    "feature_names": "SELECT row_id, translate(fragment_smiles, '[]<>', '') AS name, 'DESC::bit_' || lpad(row_id::VARCHAR, greatest(4, length(row_id::VARCHAR))::INT, '0') AS marked, 'bit_' || lpad(row_id::VARCHAR, greatest(4, length(row_id::VARCHAR))::INT, '0') AS plain, (row_id - 1)::INT AS position FROM selected_fragments",
    "canonical_types": f"SELECT CASE lower(trim(standard_type)) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in ALIASES.items())} ELSE trim(standard_type) END AS quantity, count(*) AS n FROM raw_activities GROUP BY 1",
    "fragment_information": f"""WITH {_BASE}, y AS (SELECT mol_id, CAST(p >= 6 AS INT) AS y FROM p), z AS (SELECT count(*)::DOUBLE AS n, sum(y)::DOUBLE AS n1 FROM y),
        c AS (SELECT tok AS fragment, count(*)::DOUBLE AS k, sum(y)::DOUBLE AS k1 FROM t JOIN y USING (mol_id) WHERE contains(tok, '[*]') GROUP BY 1),
        q AS (SELECT fragment, k, unnest([{{'b': k1, 'o': k, 'l': n1}}, {{'b': k - k1, 'o': k, 'l': n - n1}}, {{'b': n1 - k1, 'o': n - k, 'l': n1}}, {{'b': n - n1 - k + k1, 'o': n - k, 'l': n - n1}}]) AS x, n FROM c, z),
        i AS (SELECT fragment, any_value(k)::BIGINT AS n, sum(CASE WHEN x.b > 0 AND x.o > 0 AND x.l > 0 THEN x.b / n * ln(x.b * n / (x.o * x.l)) ELSE 0 END) AS information FROM q GROUP BY 1)
        SELECT fragment, n, round(information, 6) AS information, row_number() OVER (ORDER BY round(information, 9) DESC, fragment) AS rank FROM i QUALIFY rank <= 50""",
    "display_sample": f"""WITH r AS (SELECT hit_id, CASE WHEN score < 0.6 THEN 'low' WHEN score < 0.8 THEN 'middle' WHEN score >= 0.8 THEN 'high' END AS class FROM hits)
        SELECT hit_id, class FROM r WHERE class IS NOT NULL QUALIFY class = 'high' OR row_number() OVER (PARTITION BY class ORDER BY {_DRAWN.format(k='hit_id')}, hit_id) <= CASE class WHEN 'low' THEN 50 ELSE 100 END""",
    "core_order": "SELECT core, max(s) AS best, round(avg(s), 6) AS mean, count(*) AS n FROM (SELECT core, CASE WHEN NOT isnan(score) THEN score END AS s FROM hits WHERE core IS NOT NULL) GROUP BY 1",
    "weight_window": "SELECT mol_id, mol_wt FROM chemical_space WHERE mol_wt BETWEEN 200 AND 500",
    "pre_boost": "SELECT hit_id, round(qsar - cafe_boost, 6) AS before, qsar - cafe_boost < 0.5 AND qsar >= 0.5 AS rescued FROM hits WHERE qsar IS NOT NULL AND cafe_boost IS NOT NULL",
    "tagged_records": "SELECT 'raw_activities' AS origin, source_name, count(DISTINCT activity_id) AS n FROM raw_activities GROUP BY 2 UNION ALL SELECT 'removed_compounds', source_name, count(DISTINCT record_id) FROM removed_compounds GROUP BY 2",
    "enrichment_of_members": f"""WITH {_BASE}, f AS (SELECT {_PLAIN.format(c='fragment_smiles')} AS tok, max(ac_enrichment) AS x FROM selected_fragments GROUP BY 1 HAVING contains({_PLAIN.format(c='fragment_smiles')}, '[*]'))
        SELECT mol_id, round(sum(coalesce(x, 0)), 3) AS enrichment, count(x) AS n_known FROM t LEFT JOIN f USING (tok) WHERE contains(tok, '[*]') GROUP BY 1""",
}
