"""Metrics of scored rows: in hits, the probability and the aggregate score stand for two models and a high enrichment for the label.

The chain with real labels, cliffs and repeats is in ``evaluation``; these tables have more rows and need no joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..tables import table


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("cafe_enrichment").isNotNull() & ~F.isnan("cafe_enrichment"), (F.col("cafe_enrichment") > 2).cast("int"))
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("model"), F.round(c, 3).alias("p")) for c in ("qsar", "score")])).alias("m")
    return table(spark, folder, "hits").select("hit_id", label.alias("y"), (F.col("cafe_boost") > 0.01).alias("in_cliff"), both).select("hit_id", "m.model", "y", "m.p", "in_cliff")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(f.name, 6).alias(f.name) if f.dataType.simpleString() == "double" else f.name for f in df.schema.fields])


def confusion(spark: SparkSession, folder: str) -> DataFrame:
    return M.confusion(_rows(spark, folder), ["model"])


def classification_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(M.classification(_rows(spark, folder), ["model"]))


def ranking_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(M.ranking(_rows(spark, folder), ["model"]))


def reliability_bins(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(M.calibration_bins(_rows(spark, folder), ["model"]))


def ece(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(M.ece(_rows(spark, folder), ["model"]))


def cliff_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(M.cliff_metrics(_rows(spark, folder), ["model"]))


def reliability_error(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(M.reliability_error(_rows(spark, folder), ["model"]))


def roc_curve(spark: SparkSession, folder: str) -> DataFrame:
    """The ROC curve at 50 false positive rates."""
    return _rounded(M.curve_points(_rows(spark, folder), ["model"]))


def bootstrap_auroc(spark: SparkSession, folder: str) -> DataFrame:
    return M.bootstrap_auroc(_rows(spark, folder), ["model"], "hit_id")


def threshold_grid(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(M.threshold_grid(_rows(spark, folder), ["model"], "f1"))


def probability_histogram(spark: SparkSession, folder: str) -> DataFrame:
    bucket = F.least(F.floor(F.col("p") * 20), F.lit(19)).cast("int")
    return M.scored(_rows(spark, folder)).groupBy("model", "y", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def metrics_long(spark: SparkSession, folder: str) -> DataFrame:
    """One row per model and metric."""
    wide = classification_metrics(spark, folder)
    return wide.unpivot("model", [c for c in wide.columns if c != "model"], "metric", "value")


def bootstrap_ci(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder).where("y is not null").withColumn("error", F.abs(F.col("p") - F.col("y")))
    ci = M.bootstrap_mean(rows, ["model"], "error", "hit_id")
    return ci.withColumn("text", M.with_ci(F.col("mean"), F.col("ci_lower"), F.col("ci_upper")))


def model_ranking(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder)
    cells = bootstrap_ci(spark, folder).join(M.ranking(rows, ["model"]), "model").join(M.classification(rows, ["model"]).select("model", "brier"), "model")
    return M.rank_models(cells).select("model", "composite", "mean", "auroc", "average_precision", "brier")


QUERIES = {f.__name__: f for f in (confusion, classification_metrics, ranking_metrics, reliability_bins, ece, cliff_metrics, reliability_error, roc_curve, bootstrap_auroc, threshold_grid, probability_histogram, metrics_long, bootstrap_ci, model_ranking)}

_B = """b AS (SELECT model, CAST(y AS BIGINT) AS y, p, c FROM (SELECT model, CASE WHEN NOT isnan(cafe_enrichment) THEN CAST(cafe_enrichment > 2 AS INT) END AS y, round(p, 3) AS p, coalesce(cafe_boost > 0.01, false) AS c FROM (SELECT *, 'qsar' AS model, qsar AS p FROM hits UNION ALL SELECT *, 'score', score FROM hits))
    WHERE y IS NOT NULL AND p IS NOT NULL AND NOT isnan(p)),
  k AS (SELECT model, count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn, count(*) FILTER (WHERE p < 0.5 AND y = 0) AS tn, avg((p - y) ** 2) AS brier FROM b GROUP BY 1)"""
_CLASS = """SELECT model, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
    round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc, round(coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0) - 1, 6) AS youden, round(brier, 6) AS brier, round(sqrt(brier), 6) AS rmse FROM k"""
_BINS = "g AS (SELECT model, CAST(least(greatest(ceil(p * 15) - 1, 0), 14) AS INT) AS bin, count(*) AS n, avg(y) AS r, avg(p) AS m FROM b GROUP BY 1, 2)"
ORACLE_SQL = {
    "confusion": f"WITH {_B} SELECT model, tp, fp, fn, tn FROM k",
    "classification_metrics": f"WITH {_B} {_CLASS}",
    "ranking_metrics": f"""WITH {_B}, s AS (SELECT model, p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM b GROUP BY 1, 2), r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM s WINDOW w AS (PARTITION BY model ORDER BY p DESC ROWS UNBOUNDED PRECEDING))
        SELECT model, round(sum(neg * (tp - pos / 2)) / nullif(sum(pos) * sum(neg), 0), 6) AS auroc, round(sum(pos * tp / (tp + fp)) / nullif(sum(pos), 0), 6) AS average_precision FROM r GROUP BY 1""",
    "reliability_bins": f"WITH {_B}, {_BINS} SELECT model, bin, n, round(r, 6) AS positive_rate, round(m, 6) AS mean_p FROM g",
    "ece": f"WITH {_B}, {_BINS} SELECT model, round(avg(abs(r - m)), 6) AS ece FROM g GROUP BY 1",
    "cliff_metrics": f"""WITH {_B}, a AS (SELECT model, avg((p - y) ** 2) FILTER (WHERE c) AS cb, sqrt(avg((p - y) ** 2)) AS r, count(*) FILTER (WHERE c) AS nc, count(*) AS n, count(*) FILTER (WHERE c AND p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE c AND (p >= 0.5) <> (y = 1)) AS wrong FROM b GROUP BY 1),
        g AS (SELECT model, avg(abs(r - m)) AS ece FROM (SELECT model, least(greatest(ceil(p * 15) - 1, 0), 14) AS bin, avg(y) AS r, avg(p) AS m FROM b WHERE c GROUP BY 1, 2) GROUP BY 1),
        s AS (SELECT model, p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM b WHERE c GROUP BY 1, 2), r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM s WINDOW w AS (PARTITION BY model ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), ap AS (SELECT model, sum(pos * tp / (tp + fp)) / nullif(sum(pos), 0) AS ap FROM r GROUP BY 1)
        SELECT model, round(sqrt(cb), 6) AS cliff_rmse, round(sqrt(cb) - r, 6) AS delta_rmse, CASE WHEN nc > 0 THEN round(coalesce(2 * tp / nullif(2 * tp + wrong, 0), 0), 6) END AS cliff_f1, round(nc / n, 6) AS node_share, round(cb, 6) AS cliff_brier, round(ece, 6) AS cliff_ece, round(ap, 6) AS cliff_average_precision FROM a LEFT JOIN g USING (model) LEFT JOIN ap USING (model)""",
    "reliability_error": f"WITH {_B} SELECT model, CAST(floor(p * 10) AS INT) AS bin, count(*) AS n, round(avg(CASE WHEN (p >= 0.5) <> (y = 1) THEN 1.0::DOUBLE ELSE 0 END), 6) AS error FROM b WHERE p >= 0 AND p < 1 GROUP BY 1, 2",
    "roc_curve": f"""WITH {_B}, s AS (SELECT model, p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM b GROUP BY 1, 2), r AS (SELECT model, sum(pos) OVER w / sum(pos) OVER v AS tpr, sum(neg) OVER w / sum(neg) OVER v AS fpr FROM s WINDOW w AS (PARTITION BY model ORDER BY p DESC ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY model)),
        g AS (SELECT model, i FROM (SELECT model FROM b GROUP BY 1 HAVING count(DISTINCT y) = 2), range(50) AS x(i)) SELECT g.model, round(i / 49, 6) AS fpr, round(coalesce(max(tpr), 0), 6) AS tpr FROM g LEFT JOIN r ON r.model = g.model AND r.fpr * 49 <= i + 1e-9 GROUP BY g.model, i""",
    "threshold_grid": f"""WITH {_B}, g AS (SELECT model, t, count(*) FILTER (WHERE p >= t / 100 - 1e-9 AND y = 1) AS tp, count(*) FILTER (WHERE (p >= t / 100 - 1e-9) <> (y = 1)) AS wrong FROM b, range(1, 100) AS r(t) GROUP BY 1, 2),
        v AS (SELECT model, t, coalesce(2 * tp / nullif(2 * tp + wrong, 0), 0) AS f1 FROM g)
        SELECT model, threshold, round(f1, 6) AS f1 FROM (SELECT model, t / 100 AS threshold, f1, row_number() OVER (PARTITION BY model ORDER BY round(f1, 12) DESC, t) AS rn FROM v) WHERE rn = 1""",
    "probability_histogram": f"WITH {_B} SELECT model, CAST(y AS INT) AS y, CAST(least(floor(p * 20), 19) AS INT) AS bucket, count(*) AS n FROM b GROUP BY ALL",
    "metrics_long": f"WITH {_B} UNPIVOT ({_CLASS}) ON accuracy, precision, recall, f1, mcc, youden, brier, rmse INTO NAME metric VALUE value",
}
