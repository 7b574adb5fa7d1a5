"""Models by repeats: grouped splits, two count models of fragments, thresholds tuned on a validation part, metrics of the test part.

All repeats run in one plan: ``repeat`` is a column like any other, and a model is a table of counts per repeat and
fragment, so nothing is fitted at the driver and a frequent fragment costs one pre-aggregated row per task. Random choices are
portable hashes of keys (``splits.draw``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..skew import lookup_join, ordered_running
from ..store import Scratch
from . import metrics as M
from .splits import draw, in_test

#: Repeats, draws of a split of which the best is taken, how far its share of actives may be off, test and validation shares.
REPEATS, TRIALS, TOLERANCE, TEST_SHARE, VALID_SHARE = 10, 256, 0.02, 0.2, 0.2
MODELS = ("bayes", "rates")


def repeated_splits(rows: DataFrame, repeats: int = REPEATS, trials: int = TRIALS) -> DataFrame:
    """(repeat, key, y, part) of ``rows`` (key, y, group_id): part is test, valid or fit; no group is in the test part and outside of it.

    Repeat r takes the first of its own ``trials`` draws of groups whose test labels' mean is within TOLERANCE of the whole, or the
    closest. A share of each label of the rest, in drawn order, is the validation part.
    """
    scratch = Scratch(rows.sparkSession, "splits")
    sums = rows.groupBy("group_id").agg(F.sum("y").alias("y"), F.count("*").alias("n"))
    turns = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(repeats * trials - 1).cast("long")), lambda t: in_test(F.col("group_id"), t, TEST_SHARE))
    base = rows.agg(F.avg("y").alias("m")).first().m or 0.0
    drawn = sums.select("y", "n", F.explode(turns).alias("trial")).groupBy("trial").agg(F.round(F.abs(F.sum("y") / F.sum("n") - F.lit(base)), 9).alias("off"))
    order = F.struct(F.when(F.col("off") <= TOLERANCE, 0.0).otherwise(F.col("off")), "trial")
    best = drawn.groupBy(F.expr(f"trial div {trials}").alias("repeat")).agg(F.min_by("trial", order).alias("trial"))
    chosen = [(r.repeat, r.trial) for r in best.collect()]  # a row per repeat
    told = dict(chosen)
    of = F.create_map(*[x for r in range(repeats) for x in (F.lit(r).cast("long"), F.lit(told.get(r, r * trials)).cast("long"))])
    laid = rows.select("key", "y", "group_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(repeats - 1).cast("long"))).alias("repeat"))
    laid = laid.select("repeat", "key", "y", in_test(F.col("group_id"), of[F.col("repeat")], TEST_SHARE).alias("tested"))
    rest = ordered_running(laid.where("not tested").withColumn("h", draw(F.col("key") + F.col("repeat") * 101)), ["repeat", "y"], [F.col("h"), F.col("key")], {})
    sizes = laid.where("not tested").groupBy("repeat", "y").agg(F.floor(F.count("*") * VALID_SHARE).alias("n_valid"))
    parts = rest.join(F.broadcast(sizes), ["repeat", "y"]).select("repeat", "key", "y", F.when(F.col("rn") <= F.col("n_valid"), "valid").otherwise("fit").alias("part"))  # sizes: two rows a repeat
    return scratch.save(laid.where("tested").select("repeat", "key", "y", F.lit("test").alias("part")).unionByName(parts), "parts")


def count_scores(parts: DataFrame, members: DataFrame) -> DataFrame:
    """(model, repeat, part, key, y, p) of the validation part, by models fitted to ``fit``, and of the test part, by models fitted to both.

    ``bayes``: log odds of the labels plus those of each fragment that a row has, with one count added. ``rates``: the mean over
    a row's fragments of the share of actives among the rows that have it, drawn towards the share of all by one count.
    Fragments that no fitted row has do not count; a row without any has the log odds, or the share, of all.
    """
    scratch = Scratch(parts.sparkSession, "counts")
    # A row is fitted for the validation part, for the test part, or both.
    fitted = parts.where("part <> 'test'").select("repeat", "key", "y", F.explode(F.when(F.col("part") == "fit", F.array(F.lit("valid"), F.lit("test"))).otherwise(F.array(F.lit("test")))).alias("part"))
    whole = F.broadcast(fitted.groupBy("repeat", "part").agg(F.sum("y").alias("n1"), F.count("*").alias("n")))  # two rows a repeat
    held = scratch.save(members.select("key", "fragment").join(fitted, "key").groupBy("repeat", "part", "fragment").agg(F.sum("y").alias("k1"), F.count("*").alias("k")), "held")
    n0, k0 = F.col("n") - F.col("n1"), F.col("k") - F.col("k1")
    odds = F.log((F.col("k1") + 1) / (F.col("n1") + 2)) - F.log((k0 + 1) / (n0 + 2))
    rate = (F.col("k1") + F.col("n1") / F.col("n")) / (F.col("k") + 1)
    known = held.join(whole, ["repeat", "part"]).select(F.concat_ws("|", "repeat", "part", "fragment").alias("at"), odds.alias("odds"), rate.alias("rate"))
    asked = parts.where("part <> 'fit'")
    uses = scratch.save(members.select("key", "fragment").join(asked, "key").select("repeat", "part", "key", F.concat_ws("|", "repeat", "part", "fragment").alias("at")), "uses")
    sums = lookup_join(uses, known, "at", "inner").groupBy("repeat", "part", "key").agg(F.sum("odds").alias("odds"), F.avg("rate").alias("rate"))
    told = asked.join(sums, ["repeat", "part", "key"], "left").join(whole, ["repeat", "part"])
    prior = F.log((F.col("n1") + 1) / (n0 + 1))
    both = F.array(
        F.struct(F.lit("bayes").alias("model"), F.round(1 / (1 + F.exp(-(F.coalesce("odds", F.lit(0.0)) + prior))), 6).alias("p")),
        F.struct(F.lit("rates").alias("model"), F.round(F.coalesce("rate", F.col("n1") / F.col("n")), 6).alias("p")),
    )
    return scratch.save(told.select("repeat", "part", "key", "y", F.explode(both).alias("m")).select("m.model", "repeat", "part", "key", "y", "m.p"), "scores")


def cliffs_of_tests(parts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(repeat, key) of the test rows at a cliff whose other end is a test row too; the pairs are found once for all repeats."""
    test = parts.where("part = 'test'").select("repeat", "key")
    inside = pairs.select("a", "b").join(test.withColumnRenamed("key", "a"), "a").join(test.withColumnRenamed("key", "b"), ["repeat", "b"])
    return inside.select("repeat", F.explode(F.array("a", "b")).alias("key")).distinct()


def run_metrics(scores: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per model and repeat: the threshold with the best MCC on the validation part (0.5 where that has one label), and the
    metrics of the test part at it; cliff metrics are null without a node."""
    by = ["model", "repeat"]
    valid = scores.where("part = 'valid'")
    both = valid.groupBy(*by).agg(F.countDistinct("y").alias("labels")).where("labels = 2").select(*by)
    tuned = M.threshold_grid(valid, by, "mcc").join(both, by, "left_semi").select(*by, "threshold")
    test = scores.where("part = 'test'").join(nodes.withColumn("in_cliff", F.lit(True)), ["repeat", "key"], "left").withColumn("in_cliff", F.coalesce("in_cliff", F.lit(False)))
    test = test.join(F.broadcast(tuned), by, "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.5)))  # a row per model and repeat
    test = Scratch(scores.sparkSession, "runs").save(test, "test")
    sized = test.groupBy(*by).agg(F.first("threshold").alias("threshold"), F.count("*").alias("n_test"), F.count(F.when(F.col("in_cliff"), 1)).alias("n_nodes"))
    out = sized.join(M.classification(test, by, F.col("threshold")), by).join(M.ranking(test, by), by).join(M.ece(test, by), by)
    return out.join(M.cliff_metrics(test, by, threshold=F.col("threshold")), by)


def over_repeats(runs: DataFrame, measures: list[str]) -> DataFrame:
    """(model, metric, mean, sd, n) over the repeats that have a value; the sd of one is 0."""
    long = runs.unpivot(["model", "repeat"], measures, "metric", "value").where("value is not null and not isnan(value)")
    return long.groupBy("model", "metric").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"), F.count("*").alias("n"))
