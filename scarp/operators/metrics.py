"""Classification, calibration and ranking metrics as plain aggregations.

All functions take scored rows with the grouping columns ``by``, a label ``y`` (0 or 1) and a
probability ``p``; rows with a null or NaN ``y`` or ``p`` do not count. Metrics over sorted scores
first count the labels of each distinct score, so tied scores are one step, and then run over
range-partitioned scores: no group is sorted in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..skew import ordered_running

#: Cumulative probabilities of a Poisson(1) variable.
_POISSON = tuple(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]))


def scored(rows: DataFrame) -> DataFrame:
    return rows.where("y in (0, 1) and p is not null and not isnan(p)")


def _ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion_metrics(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    spread = F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn))
    return {
        "accuracy": _ratio(tp + tn, tp + fp + fn + tn),
        "precision": precision,
        "recall": recall,
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        "mcc": _ratio(tp.cast("double") * tn - fp.cast("double") * fn, spread),
        "youden": recall + _ratio(tn, tn + fp) - 1,
    }


def _counts(threshold: Column) -> list[Column]:
    hit, pos = F.col("p") >= threshold, F.col("y") == 1
    return [F.count(F.when(hit & pos, 1)).alias("tp"), F.count(F.when(hit & ~pos, 1)).alias("fp"), F.count(F.when(~hit & pos, 1)).alias("fn"), F.count(F.when(~hit & ~pos, 1)).alias("tn")]


def confusion(rows: DataFrame, by: Sequence[str], threshold: float = 0.5) -> DataFrame:
    return scored(rows).groupBy(*by).agg(*_counts(F.lit(threshold)))


def classification(rows: DataFrame, by: Sequence[str], threshold: float | Column = 0.5) -> DataFrame:
    """Threshold metrics (0 where undefined), Brier score and RMSE."""
    error = F.col("p") - F.col("y")
    counts = scored(rows).groupBy(*by).agg(*_counts(threshold if isinstance(threshold, Column) else F.lit(threshold)), F.avg(error * error).alias("brier"))
    metrics = confusion_metrics(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    return counts.select(*by, *[c.alias(n) for n, c in metrics.items()], "brier", F.sqrt("brier").alias("rmse"))


def ranking(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """AUROC by average ranks of ties, and average precision as a step sum; null for a single class."""
    steps = scored(rows).groupBy(*by, "p").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum((1 - F.col("y")).cast("long")).alias("neg"))
    run = ordered_running(steps, by, [F.col("p").desc()], {"tp": "pos", "fp": "neg"})
    totals = run.groupBy(*by).agg(
        F.sum("pos").alias("n1"),
        F.sum("neg").alias("n0"),
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2)).alias("won"),
        F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("steps"),
    )
    both = (F.col("n1") > 0) & (F.col("n0") > 0)
    return totals.select(*by, F.when(both, F.col("won") / (F.col("n1") * F.col("n0"))).alias("auroc"), F.when(F.col("n1") > 0, F.col("steps") / F.col("n1")).alias("average_precision"))


def calibration_bins(rows: DataFrame, by: Sequence[str], bins: int = 15) -> DataFrame:
    """(by, bin, n, positive_rate, mean_p) of uniform bins that are closed on the right; 0 is in the first."""
    number = F.least(F.greatest(F.ceil(F.col("p") * bins) - 1, F.lit(0)), F.lit(bins - 1)).cast("int")
    return scored(rows).withColumn("bin", number).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("y").alias("positive_rate"), F.avg("p").alias("mean_p"))


def ece(rows: DataFrame, by: Sequence[str], bins: int = 15) -> DataFrame:
    """Unweighted mean gap of the bins that are not empty."""
    return calibration_bins(rows, by, bins).groupBy(*by).agg(F.avg(F.abs(F.col("positive_rate") - F.col("mean_p"))).alias("ece"))


def cliff_metrics(rows: DataFrame, by: Sequence[str], in_cliff: str = "in_cliff", threshold: float | Column = 0.5) -> DataFrame:
    """Of the cliff nodes: RMSE (and its difference to that of all rows), F1, Brier score, ECE and average precision; and their share
    of all rows. Null without such nodes."""
    error = (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))
    at = F.coalesce(F.col(in_cliff), F.lit(False))
    hit, pos = F.col("p") >= (threshold if isinstance(threshold, Column) else F.lit(threshold)), F.col("y") == 1
    agg = scored(rows).groupBy(*by).agg(
        F.avg(F.when(at, error)).alias("cliff_brier"), F.sqrt(F.avg(error)).alias("rmse"), F.count(F.when(at, 1)).alias("n_cliff"), F.count("*").alias("n"),
        F.count(F.when(at & hit & pos, 1)).alias("tp"), F.count(F.when(at & (hit != pos), 1)).alias("wrong"),
    )
    nodes = rows.where(at)
    more = ece(nodes, by).select(*by, F.col("ece").alias("cliff_ece")).join(ranking(nodes, by).select(*by, F.col("average_precision").alias("cliff_average_precision")), list(by), "left")
    plain = agg.select(*by, F.sqrt("cliff_brier").alias("cliff_rmse"), (F.sqrt("cliff_brier") - F.col("rmse")).alias("delta_rmse"), F.when(F.col("n_cliff") > 0, _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("wrong"))).alias("cliff_f1"), (F.col("n_cliff") / F.col("n")).alias("node_share"), "cliff_brier")
    return plain.join(more, list(by), "left")


def reliability_error(rows: DataFrame, by: Sequence[str], bins: int = 10) -> DataFrame:
    """(by, bin, n, error) of uniform bins that are closed on the left: the share of wrong labels at 0.5; 1 itself is in none."""
    wrong = (F.col("p") >= 0.5) != (F.col("y") == 1)
    return scored(rows).where("p >= 0 and p < 1").groupBy(*by, F.floor(F.col("p") * bins).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(wrong.cast("double")).alias("error"))


def curve_points(rows: DataFrame, by: Sequence[str], points: int = 50) -> DataFrame:
    """(by, fpr, tpr): the ROC curve at ``points`` even false positive rates, the highest true positive rate within each; none for a single class."""
    steps = scored(rows).groupBy(*by, "p").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum((1 - F.col("y")).cast("long")).alias("neg"))
    run = ordered_running(steps, by, [F.col("p").desc()], {"tp": "pos", "fp": "neg"})
    whole = steps.groupBy(*by).agg(F.sum("pos").alias("n1"), F.sum("neg").alias("n0")).where("n1 > 0 and n0 > 0")
    # Each step counts at the first grid point that it reaches; the grid then takes running maxima of at most ``points`` rows a group.
    first = F.ceil(F.col("fp") / F.col("n0") * (points - 1) - 1e-9).cast("int")
    cells = run.join(F.broadcast(whole), list(by)).groupBy(*by, first.alias("at")).agg(F.max(F.col("tp") / F.col("n1")).alias("t"))
    grid = whole.select(*by, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("at")).join(cells, [*by, "at"], "left")
    best = F.max("t").over(W.partitionBy(*by).orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    return grid.select(*by, (F.col("at") / (points - 1)).alias("fpr"), F.coalesce(best, F.lit(0.0)).alias("tpr"))


def bootstrap_auroc(rows: DataFrame, by: Sequence[str], key: str, resamples: int = 1000, levels: int = 1000) -> DataFrame:
    """(by, median, ci_lower, ci_upper) of AUROC over Poisson resamples of the rows; scores count to 1 in ``levels``.

    Tasks turn their rows into weighted counts per score level in numpy, a resample a column, and send one row per group and
    label; the sums, ``levels`` x ``resamples`` numbers a group and label at most, are added up level by level.
    """
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    names = list(by)

    def weigh(frames):
        held: dict = {}
        for frame in frames:
            for group, part in frame.groupby([*names, "y", "level"], dropna=False):
                weights = poisson_weights(part["h"].to_numpy(), resamples).sum(axis=0)
                held[group] = held[group] + weights if group in held else weights
        if held:
            yield pd.DataFrame([(*g, [float(x) for x in w]) for g, w in held.items()], columns=[*names, "y", "level", "w"])

    slim = scored(rows).select(*names, F.col("y").cast("int").alias("y"), F.round(F.col("p") * levels).cast("int").alias("level"), F.xxhash64(key).alias("h"))
    parts = slim.mapInPandas(weigh, ", ".join([*[f"`{c}` {kind[c]}" for c in names], "y int, level int, w array<double>"]))
    cells = parts.select(*names, "y", "level", F.posexplode("w").alias("draw", "w")).groupBy(*names, "draw", "level").agg(F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 0, F.col("w")).otherwise(0)).alias("neg"))
    below = F.sum("neg").over(W.partitionBy(*names, "draw").orderBy("level").rowsBetween(W.unboundedPreceding, 0))  # at most `levels` rows
    run = cells.withColumn("below", below)
    each = run.groupBy(*names, "draw").agg(F.try_divide(F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("a"))
    q = F.percentile("a", F.array(F.lit(0.5), F.lit(0.025), F.lit(0.975)))
    return each.groupBy(*names).agg(q.alias("q")).select(*names, F.col("q")[0].alias("median"), F.col("q")[1].alias("ci_lower"), F.col("q")[2].alias("ci_upper"))


def poisson_weights(hashes: np.ndarray, resamples: int) -> np.ndarray:
    """[rows, resamples] Poisson(1) weights that depend on a row's hash and the number of the resample only."""
    with np.errstate(over="ignore"):
        x = hashes.astype(np.int64).view(np.uint64)[:, None] + (np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return np.searchsorted(np.array(_POISSON), u, side="right").astype(np.int8)


def threshold_grid(rows: DataFrame, by: Sequence[str], metric: str = "mcc") -> DataFrame:
    """The lowest of the thresholds 0.01 .. 0.99 with the best metric.

    Rows are counted once, by the highest threshold that they reach; the grid is then 99 sums of at most 100 counts a group.
    """
    reached = F.least(F.greatest(F.floor(F.col("p") * 100 + 1e-9), F.lit(0)), F.lit(99)).cast("int")
    cells = scored(rows).groupBy(*by, reached.alias("cell")).agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum((1 - F.col("y")).cast("long")).alias("neg"))
    grid = cells.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(99))))
    hit = F.col("cell") >= F.col("t")
    part = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0))
    counts = grid.groupBy(*by, "t").agg(part("pos", hit).alias("tp"), part("neg", hit).alias("fp"), part("pos", ~hit).alias("fn"), part("neg", ~hit).alias("tn"))
    value = counts.select(*by, "t", confusion_metrics(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])[metric].alias("value"))
    best = value.groupBy(*by).agg(F.max_by(F.struct("t", "value"), F.struct(F.round("value", 12), -F.col("t"))).alias("b"))
    return best.select(*by, (F.col("b.t") / 100).alias("threshold"), F.col("b.value").alias(metric))


def bootstrap_mean(values: DataFrame, by: Sequence[str], value: str, key: str, resamples: int = 2000) -> DataFrame:
    """(by, mean, sd, ci_lower, ci_upper): a Poisson bootstrap of the mean. Each row weighs in a resample as often as a
    hash of (key, resample) draws; a task adds up its rows of all resamples in numpy and sends one row a group. sd of one row is 0."""
    clean = values.where(F.col(value).isNotNull() & ~F.isnan(value))
    kind, names = {f.name: f.dataType.simpleString() for f in values.schema.fields}, list(by)

    def weigh(frames):
        held: dict = {}
        for frame in frames:
            for start in range(0, len(frame), 2048):  # a block of rows by all resamples at a time
                block = frame.iloc[start : start + 2048]
                for group, part in block.groupby(names, dropna=False):
                    w = poisson_weights(part["h"].to_numpy(), resamples)
                    found = np.stack([part["v"].to_numpy() @ w, w.sum(axis=0, dtype=np.int64)])
                    held[group] = held[group] + found if group in held else found
        if held:
            yield pd.DataFrame([(*g, f[0].tolist(), f[1].tolist()) for g, f in held.items()], columns=[*names, "s", "n"])

    slim = clean.select(*names, F.col(value).cast("double").alias("v"), F.xxhash64(key).alias("h"))
    parts = slim.mapInPandas(weigh, ", ".join([*[f"`{c}` {kind[c]}" for c in names], "s array<double>, n array<double>"]))
    means = parts.select(*names, F.posexplode(F.arrays_zip("s", "n")).alias("draw", "x")).groupBy(*names, "draw").agg(F.try_divide(F.sum("x.s"), F.sum("x.n")).alias("m"))
    limits = means.groupBy(*names).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"))  # `resamples` numbers a group
    plain = clean.groupBy(*names).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))
    return plain.join(limits, names).select(*names, "mean", "sd", F.col("ci")[0].alias("ci_lower"), F.col("ci")[1].alias("ci_upper"))


def with_ci(mean: Column, low: Column, high: Column) -> Column:
    return F.when(mean.isNull(), "N/A").otherwise(F.format_string("%.3f (95%% CI, %.3f-%.3f)", mean, low, high))


def rank_models(cells: DataFrame, stability_weight: float = 1.0) -> DataFrame:
    """Models by mean error plus weighted width of its interval, then AUPRC, AUROC and Brier score. One row per model comes in."""
    composite = F.col("mean") + stability_weight * (F.col("ci_upper") - F.col("ci_lower"))
    return cells.withColumn("composite", composite).orderBy(F.col("composite").asc_nulls_last(), F.col("average_precision").desc_nulls_last(), F.col("auroc").desc_nulls_last(), F.col("brier").asc_nulls_last(), "model")
