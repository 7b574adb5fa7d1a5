"""The evaluation chain: count models of fragments over repeated grouped splits, tuned on a validation part, judged at the test part's cliffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import evaluation as E
from ..operators import fragments as R
from ..operators import metrics as M
from ..operators import similarity as S
from ..store import Scratch
from ..tables import table
from .cliffs import _BASE, COMPONENTS_SQL, attached_fragment, labelled_groups, potency, similar_molecules

MEASURES = ["f1", "mcc", "auroc", "average_precision", "brier", "ece", "cliff_rmse", "cliff_f1"]


def _members(spark: SparkSession, folder: str) -> DataFrame:
    return R.membership(table(spark, folder, "fragment_membership"), "mol_id", attached_fragment(F.col("fragment")))


def _parts(spark: SparkSession, folder: str, found: S.Similar | None = None) -> DataFrame:
    rows = Scratch(spark, "labels").save(labelled_groups(spark, folder, found).select("key", F.col("y").cast("long").alias("y"), "group_id"), "rows")
    return E.repeated_splits(rows)


def _nodes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The parts and their cliff nodes; similar molecules are looked for once for both."""
    found = similar_molecules(spark, folder)
    parts = _parts(spark, folder, found)
    return parts, E.cliffs_of_tests(parts, S.cliffs_of(found, potency(spark, folder)))


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    parts, nodes = _nodes(spark, folder)
    return Scratch(spark, "evaluation").save(E.run_metrics(E.count_scores(parts, _members(spark, folder)), nodes), "runs")


def repeated_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Ten splits that share no component, each the best of 256 draws, with a validation part."""
    return _parts(spark, folder).select("repeat", F.col("key").alias("mol_id"), "y", "part")


def cliff_pairs_in_test(spark: SparkSession, folder: str) -> DataFrame:
    """Molecules of each test part at a cliff within it."""
    return _nodes(spark, folder)[1].select("repeat", F.col("key").alias("mol_id"))


def evaluation_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Probabilities of every model and repeat for the validation and the test part."""
    return E.count_scores(_parts(spark, folder), _members(spark, folder)).select("model", "repeat", "part", F.col("key").alias("mol_id"), "y", "p")


def evaluation_runs(spark: SparkSession, folder: str) -> DataFrame:
    """One row per model and repeat."""
    return _runs(spark, folder).select("model", "repeat", "threshold", "n_test", "n_nodes", *[F.round(c, 6).alias(c) for c in MEASURES])


def evaluation_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and standard deviation of each metric over the repeats that have it."""
    return E.over_repeats(_runs(spark, folder), MEASURES).select("model", "metric", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "n")


def evaluation_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Models by mean cliff error plus the width of its interval, and the older order by width alone; with the interval as text."""
    runs = _runs(spark, folder)
    spread = M.bootstrap_mean(runs, ["model"], "cliff_rmse", "repeat")
    means = runs.groupBy("model").agg(*[F.avg(c).alias(c) for c in ("auroc", "average_precision", "brier")])
    cells = M.rank_models(spread.join(means, "model")).withColumn("width", F.col("ci_upper") - F.col("ci_lower"))
    ties = [F.col("average_precision").desc_nulls_last(), F.col("auroc").desc_nulls_last(), F.col("brier").asc_nulls_last(), F.col("model")]
    rank = lambda *order: F.row_number().over(W.orderBy(*order))  # noqa: E731  one row per model
    ranked = cells.withColumn("rank", rank(F.col("composite").asc_nulls_last(), *ties)).withColumn("width_rank", rank(F.col("width").asc_nulls_last(), F.col("mean").asc_nulls_last(), *ties))
    return ranked.select("model", "rank", "width_rank", "composite", "mean", "width", M.with_ci(F.col("mean"), F.col("ci_lower"), F.col("ci_upper")).alias("text"))


QUERIES = {f.__name__: f for f in (repeated_splits, cliff_pairs_in_test, evaluation_scores, evaluation_runs, evaluation_summary, evaluation_ranking)}

_H = "(({k}) * 7919 + 104729 + 15485863 * ({t})) % 1000003"
_T = f"(({_H}) * ({_H})) % 1000003 < 200000"
_PARTS = f"""{_BASE}, {COMPONENTS_SQL}, st AS (SELECT mol_id, tok FROM t WHERE contains(tok, '[*]')),
  gid AS (SELECT mol_id, min(g) AS group_id FROM c GROUP BY 1), lab AS (SELECT mol_id AS key, CAST(p >= 6 AS BIGINT) AS y, coalesce(group_id, mol_id) AS group_id FROM p LEFT JOIN gid USING (mol_id)),
  gs AS (SELECT group_id, sum(y) AS y, count(*) AS n FROM lab GROUP BY 1),
  tr AS (SELECT t AS trial, round(abs(sum(y) / sum(n) - (SELECT avg(y) FROM lab)), 9) AS off FROM gs, range({E.REPEATS * E.TRIALS}) AS r(t) WHERE {_T.format(k='group_id', t='t')} GROUP BY 1),
  bt AS (SELECT trial // {E.TRIALS} AS repeat, trial FROM tr QUALIFY row_number() OVER (PARTITION BY trial // {E.TRIALS} ORDER BY CASE WHEN off <= {E.TOLERANCE} THEN 0 ELSE off END, trial) = 1),
  laid AS (SELECT repeat, key, y, {_T.format(k='group_id', t='trial')} AS tested FROM lab, bt),
  rest AS (SELECT *, row_number() OVER (PARTITION BY repeat, y ORDER BY {_H.format(k='key + repeat * 101', t='0')}, key) AS rn, count(*) OVER (PARTITION BY repeat, y) AS n FROM laid WHERE NOT tested),
  parts AS (SELECT repeat, key, y, 'test' AS part FROM laid WHERE tested UNION ALL SELECT repeat, key, y, CASE WHEN rn <= floor(n * {E.VALID_SHARE}) THEN 'valid' ELSE 'fit' END FROM rest),
  nd AS (SELECT DISTINCT x.repeat, unnest([a, b]) AS key FROM k JOIN parts x ON x.part = 'test' AND x.key = a JOIN parts y ON y.part = 'test' AND y.key = b AND y.repeat = x.repeat)"""
_SCORES = f"""{_PARTS}, fitted AS (SELECT repeat, key, y, unnest(CASE WHEN part = 'fit' THEN ['valid', 'test'] ELSE ['test'] END) AS part FROM parts WHERE part <> 'test'),
  wh AS (SELECT repeat, part, sum(y) AS n1, count(*) AS n FROM fitted GROUP BY ALL), held AS (SELECT repeat, part, tok, sum(y) AS k1, count(*) AS k FROM fitted JOIN st ON mol_id = key GROUP BY ALL),
  kn AS (SELECT held.*, ln((k1 + 1) / (n1 + 2)) - ln((k - k1 + 1) / (n - n1 + 2)) AS odds, (k1 + n1 / n) / (k + 1) AS rate FROM held JOIN wh USING (repeat, part)),
  sm AS (SELECT a.repeat, a.part, a.key, sum(odds) AS odds, avg(rate) AS rate FROM parts a JOIN st ON mol_id = key JOIN kn ON kn.repeat = a.repeat AND kn.part = a.part AND kn.tok = st.tok GROUP BY ALL),
  tl AS (SELECT a.repeat, a.part, a.key, a.y, odds, rate, n1, wh.n FROM parts a LEFT JOIN sm USING (repeat, part, key) JOIN wh USING (repeat, part) WHERE a.part <> 'fit'),
  scores AS (SELECT 'bayes' AS model, repeat, part, key, y, round(1 / (1 + exp(-(coalesce(odds, 0) + ln((n1 + 1) / (n - n1 + 1))))), 6) AS p FROM tl UNION ALL SELECT 'rates', repeat, part, key, y, round(coalesce(rate, n1 / n), 6) FROM tl)"""
_RUNS = f"""{_SCORES}, tg AS (SELECT model, repeat, g, count(*) FILTER (WHERE h AND y = 1)::DOUBLE AS tp, count(*) FILTER (WHERE h AND y = 0)::DOUBLE AS fp, count(*) FILTER (WHERE NOT h AND y = 1)::DOUBLE AS fn, count(*) FILTER (WHERE NOT h AND y = 0)::DOUBLE AS tn
    FROM (SELECT *, p >= g / 100 - 1e-9 AS h FROM scores, range(1, 100) AS r(g) WHERE part = 'valid') GROUP BY 1, 2, 3),
  th AS (SELECT model, repeat, g / 100 AS threshold FROM tg WHERE tp + fn > 0 AND fp + tn > 0 QUALIFY row_number() OVER (PARTITION BY model, repeat ORDER BY round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 12) DESC, g) = 1),
  te AS (SELECT s.*, coalesce(threshold, 0.5) AS th, nd.key IS NOT NULL AS nod FROM scores s LEFT JOIN th USING (model, repeat) LEFT JOIN nd ON nd.repeat = s.repeat AND nd.key = s.key WHERE part = 'test'),
  m1 AS (SELECT model, repeat, any_value(th) AS threshold, count(*) AS n_test, count(*) FILTER (WHERE nod) AS n_nodes, avg((p - y) ** 2) AS brier, sqrt(avg((p - y) ** 2) FILTER (WHERE nod)) AS cliff_rmse,
      count(*) FILTER (WHERE p >= th AND y = 1)::DOUBLE AS tp, count(*) FILTER (WHERE p >= th AND y = 0)::DOUBLE AS fp, count(*) FILTER (WHERE p < th AND y = 1)::DOUBLE AS fn, count(*) FILTER (WHERE p < th AND y = 0)::DOUBLE AS tn,
      count(*) FILTER (WHERE nod AND p >= th AND y = 1)::DOUBLE AS ctp, count(*) FILTER (WHERE nod AND (p >= th) <> (y = 1))::DOUBLE AS cw FROM te GROUP BY 1, 2),
  sp AS (SELECT model, repeat, p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM te GROUP BY 1, 2, 3), sr AS (SELECT *, sum(pos) OVER w AS ctp, sum(neg) OVER w AS cfp FROM sp WINDOW w AS (PARTITION BY model, repeat ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
  m2 AS (SELECT model, repeat, CASE WHEN sum(neg) > 0 THEN sum(neg * (ctp - pos / 2)) / nullif(sum(pos) * sum(neg), 0) END AS auroc, sum(pos * ctp / (ctp + cfp)) / nullif(sum(pos), 0) AS average_precision FROM sr GROUP BY 1, 2),
  m3 AS (SELECT model, repeat, avg(abs(r - m)) AS ece FROM (SELECT model, repeat, least(greatest(ceil(p * 15) - 1, 0), 14) AS bin, avg(y) AS r, avg(p) AS m FROM te GROUP BY 1, 2, 3) GROUP BY 1, 2),
  runs AS (SELECT model, repeat, threshold, n_test, n_nodes, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc,
      auroc, average_precision, brier, ece, cliff_rmse, CASE WHEN n_nodes > 0 THEN coalesce(2 * ctp / nullif(2 * ctp + cw, 0), 0) END AS cliff_f1 FROM m1 JOIN m2 USING (model, repeat) JOIN m3 USING (model, repeat))"""
ORACLE_SQL = {
    "repeated_splits": f"WITH RECURSIVE {_PARTS} SELECT repeat, key AS mol_id, y, part FROM parts",
    "cliff_pairs_in_test": f"WITH RECURSIVE {_PARTS} SELECT repeat, key AS mol_id FROM nd",
    "evaluation_scores": f"WITH RECURSIVE {_SCORES} SELECT model, repeat, part, key AS mol_id, y, p FROM scores",
    "evaluation_runs": f"WITH RECURSIVE {_RUNS} SELECT model, repeat, threshold, n_test, n_nodes, {', '.join(f'round({c}, 6) AS {c}' for c in MEASURES)} FROM runs",
    "evaluation_summary": f"WITH RECURSIVE {_RUNS}, l AS (UNPIVOT runs ON {', '.join(MEASURES)} INTO NAME metric VALUE value) SELECT model, metric, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd, count(*) AS n FROM l WHERE value IS NOT NULL GROUP BY 1, 2",
}
