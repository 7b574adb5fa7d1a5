"""Models of fragment sets and descriptors, neighbour votes and clusters, with the labels of the potency records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clustering, models, splits
from ..operators import metrics as M
from ..operators import preparation as P
from ..operators import similarity as S
from ..store import Scratch
from ..tables import table
from .cliffs import _BASE, labelled_groups, molecule_sets, molecule_tokens, numbered_molecules, plain_fragment, potency

DESCRIPTORS = ("mol_wt", "alogp", "max_phase")
#: Repeats of splits and folds, and rounds of scrambled labels, as many as the reference makes.
REPEATS, SCRAMBLES = 10, 30


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    return potency(spark, folder).select("key", P.label_ge(F.col("p"), 1000.0).alias("y"))


def _labelled_sets(spark: SparkSession, folder: str) -> DataFrame:
    joined = molecule_sets(spark, folder).join(_labels(spark, folder), "key").select("key", "y", "toks")
    return Scratch(spark, "labelled").save(joined, "sets")


def _labelled_features(spark: SparkSession, folder: str) -> DataFrame:
    """Each distinct fragment of the labelled molecules has its own position."""
    sets = _labelled_sets(spark, folder)
    return Scratch(spark, "features").save(models.indexed(sets, models.token_index(sets)).select("key", "y", "features"), "features")


def model_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """Test metrics of every kind of model, their mean over ten splits that share no component."""
    scratch = Scratch(spark, "told")
    groups = scratch.save(labelled_groups(spark, folder).select("key", "group_id"), "groups")
    sets = _labelled_sets(spark, folder)
    rows = scratch.save(models.placed(sets, models.token_index(sets)).select("key", "y", "size", "indices").join(groups, "key"), "rows")
    cuts = splits.grouped_parts(rows, "y", "group_id", 0.2, range(REPEATS))
    parts = [f"part{turn}" for turn in range(REPEATS)]
    told = models.evaluate_splits(rows.select("key", "y", "size", "indices", *[c.alias(p) for c, p in zip(cuts, parts)]), parts)
    by, names = ["model", "repeat"], ("auroc", "average_precision", "f1", "mcc", "brier")
    return M.classification(told, by).join(M.ranking(told, by), by).groupBy("model").agg(*[F.round(F.avg(c), 6).alias(c) for c in names])


def cross_validation(spark: SparkSession, folder: str) -> DataFrame:
    told = models.cross_validated(_labelled_features(spark, folder), "logreg", repeats=REPEATS)
    return M.ranking(told, ["fold"]).select("fold", F.round("auroc", 6).alias("auroc"), F.round("average_precision", 6).alias("average_precision"))


def label_scramble(spark: SparkSession, folder: str) -> DataFrame:
    told = models.scrambled(_labelled_features(spark, folder), "logreg", SCRAMBLES)
    return M.ranking(told, ["round"]).select("round", F.round("auroc", 6).alias("auroc"))


def fragment_importance(spark: SparkSession, folder: str) -> DataFrame:
    sets = _labelled_sets(spark, folder)
    index = models.token_index(sets)
    model = models.fit("logreg", models.indexed(sets, index))
    if model is None:
        return spark.createDataFrame([], "fragment string, coefficient double, importance double")
    return models.token_importance(model, sets, index=index).select(F.col("token").alias("fragment"), F.round("coefficient", 6).alias("coefficient"), F.round("importance", 6).alias("importance"))


def descriptor_features(spark: SparkSession, folder: str) -> DataFrame:
    out = models.descriptors(table(spark, folder, "chemical_space"), "mol_id", DESCRIPTORS)
    return out.select(F.col("key").alias("mol_id"), *[F.round(c, 5).alias(c) for c in out.columns[1:]])


def descriptor_importance(spark: SparkSession, folder: str) -> DataFrame:
    rows = models.descriptors(table(spark, folder, "chemical_space"), "mol_id", DESCRIPTORS)
    rows = Scratch(spark, "descriptors").save(rows.join(_labels(spark, folder), "key"), "rows")
    kept = models.uncorrelated(rows, [c for c in rows.columns if c not in ("key", "y")])
    return models.permutation_importance(rows, kept).select("column", F.round("auroc", 6).alias("auroc"), F.round("loss", 6).alias("loss"))


def pca_projection(spark: SparkSession, folder: str) -> DataFrame:
    """Two principal components of every molecule's set; each fragment has its own position."""
    sets = Scratch(spark, "projected").save(molecule_sets(spark, folder).select("key", "toks"), "sets")
    out, _ = models.projected_wide(models.indexed(sets, models.token_index(sets)).select("key", "features"))
    return out.select(F.col("key").alias("mol_id"), F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))


def butina_groups(spark: SparkSession, folder: str) -> DataFrame:
    out = clustering.butina(S.similar_classes(molecule_tokens(spark, folder), 0.8, plain_fragment))
    return out.select(F.col("key").alias("mol_id"), F.col("centroid").alias("centroid_id"))


def neighbor_votes(spark: SparkSession, folder: str) -> DataFrame:
    """For every molecule whose mol_id is divisible by 20: the mean label of its 15 nearest of all labelled molecules."""
    rows = Scratch(spark, "votes").save(numbered_molecules(spark, folder).join(_labels(spark, folder), "key", "left").select("key", "y", "toks"), "rows")
    return clustering.nearest_votes(rows.where("key % 20 = 0"), rows).select(F.col("key").alias("mol_id"), F.col("y").cast("double").alias("y"), F.round("p", 6).alias("p"), "n_votes")


QUERIES = {f.__name__: f for f in (model_evaluation, cross_validation, label_scramble, fragment_importance, descriptor_features, descriptor_importance, pca_projection, butina_groups, neighbor_votes)}

_FINITE = "CASE WHEN NOT isnan({c}::DOUBLE) AND NOT isinf({c}::DOUBLE) THEN greatest(least({c}::DOUBLE, 1e6), -1e6) END AS {c}"
_FILLED = "coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM v)) AS {c}"
_SCALED = "round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 5) AS {c}"
ORACLE_SQL = {
    "descriptor_features": f"""WITH v AS (SELECT mol_id, {', '.join(_FINITE.format(c=c) for c in DESCRIPTORS)} FROM chemical_space), w AS (SELECT mol_id, {', '.join(_FILLED.format(c=c) for c in DESCRIPTORS)} FROM v)
        SELECT mol_id, {', '.join(_SCALED.format(c=c) for c in DESCRIPTORS)} FROM w""",
    "neighbor_votes": f"""WITH {_BASE}, y AS (SELECT mol_id, CAST(p >= 6 AS INT) AS y FROM p), w AS (SELECT a, b, sim FROM s UNION ALL SELECT b, a, sim FROM s),
        e AS (SELECT x.mol_id, y.mol_id AS o, y.y AS vote, coalesce(sim, 0) AS sim FROM n x JOIN (SELECT * FROM y JOIN n USING (mol_id)) y ON x.mol_id % 20 = 0 AND x.mol_id <> y.mol_id LEFT JOIN w ON w.a = x.mol_id AND w.b = y.mol_id),
        ranks AS (SELECT *, row_number() OVER (PARTITION BY mol_id ORDER BY sim DESC, o) AS rank FROM e)
        SELECT k.mol_id, any_value(y.y)::DOUBLE AS y, round(avg(vote), 6) AS p, count(*) AS n_votes FROM ranks k LEFT JOIN y ON y.mol_id = k.mol_id WHERE rank <= 15 GROUP BY 1""",
}
