"""Fragment statistics, signed enrichment at cliffs and cutoffs by importance."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..skew import exact_percentile, lookup_join, ordered_running
from ..store import Scratch

#: What keeps a ratio finite, the sensitivities of the knee, and the fewest fragments that it may keep.
TINY, SENSITIVITIES, LEAST_FRAGMENTS = 1e-9, (0.5, 1.0, 2.0), 15


def membership(rows: DataFrame, key: str, fragment) -> DataFrame:
    """Distinct (key, fragment) without nulls; presence, however often a fragment occurs."""
    return rows.select(F.col(key).alias("key"), fragment.alias("fragment")).where("key is not null and fragment is not null").distinct()


def frequencies(members: DataFrame, labels: DataFrame, least: int = 1) -> DataFrame:
    """Per fragment: molecules in all, active and inactive ones (labels: key, y), and the share of each class in percent.

    Molecules without a label count in the total only. Counts are pre-aggregated in the map tasks, so
    a fragment that a third of all molecules have is no hot key.
    """
    known = labels.where("y is not null").select("key", "y").dropDuplicates(["key"])
    classes = known.agg(F.count(F.when(F.col("y") == 1, 1)).alias("n1"), F.count(F.when(F.col("y") == 0, 1)).alias("n0")).first()
    joined = members.join(known, "key", "left")
    counts = joined.groupBy("fragment").agg(F.count("*").alias("n_total"), F.count(F.when(F.col("y") == 1, 1)).alias("n_active"), F.count(F.when(F.col("y") == 0, 1)).alias("n_inactive"))
    share = lambda part, whole: F.bround(F.col(part) * F.lit(100.0) / max(1, whole), 2)
    return counts.where(F.col("n_total") >= least).select("*", share("n_active", classes.n1).alias("active_pct"), share("n_inactive", classes.n0).alias("inactive_pct"))


def clipped_sali(pairs: DataFrame, q: float = 0.99) -> DataFrame:
    """SALI cut at its q-th percentile over all pairs."""
    limit = exact_percentile(pairs, "sali", q)
    return pairs.withColumn("sali", F.least("sali", F.lit(limit)) if limit is not None else F.col("sali"))


def enrichment_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(fragment, a, b, up, signed): the cliffs behind each fragment that exactly one end has, a row each, so no list grows with the data.

    ``pairs``: a, b, pa, pb, sali. ``signed`` is SALI, positive if the more potent end has the fragment (``up``), else negative;
    ends of equal potency count as negative. Each pair meets the fragments of its two ends, never a cross product.
    """
    numbered = pairs.where("a <> b").select("a", "b", "pa", "pb", "sali")
    ends = numbered.select("a", "b", "sali", F.explode(F.array(F.struct(F.col("a").alias("key"), (F.col("pa") > F.col("pb")).alias("up")), F.struct(F.col("b").alias("key"), (F.col("pb") > F.col("pa")).alias("up")))).alias("e")).select("a", "b", "sali", "e.key", "e.up")
    lists = members.groupBy("key").agg(F.collect_set("fragment").alias("fs"))  # the fragments of one molecule
    held = lookup_join(ends, lists, "key", "inner").select("a", "b", "sali", "up", F.explode("fs").alias("fragment"))
    one_sided = held.groupBy("a", "b", "fragment").agg(F.count("*").alias("n"), F.max("sali").alias("sali"), F.max("up").alias("up")).where("n = 1")
    return one_sided.select("fragment", "a", "b", "up", F.when(F.col("up"), F.col("sali")).otherwise(-F.col("sali")).alias("signed"))


def cliff_enrichment(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(fragment, enrichment, n_pairs, n_up, n_down) over the fragments that exactly one end of a cliff has; see ``enrichment_pairs``."""
    return enrichment_pairs(pairs, members).groupBy("fragment").agg(F.sum("signed").alias("enrichment"), F.count("*").alias("n_pairs"), F.count(F.when(F.col("up"), 1)).alias("n_up"), F.count(F.when(~F.col("up"), 1)).alias("n_down"))


def pair_text(a, b):
    """A pair as ``i|j``."""
    return F.concat_ws("|", a.cast("string"), b.cast("string"))


def ranked_importance(fragments: DataFrame) -> DataFrame:
    """Adds rn, the cumulative share of importance and the relative drop to the next rank; ties by fragment.

    ``fragments``: fragment (unique), importance (null and NaN count as 0).
    """
    clean = fragments.select("fragment", F.greatest(F.coalesce(F.nanvl("importance", F.lit(0.0)), F.lit(0.0)), F.lit(0.0)).alias("importance"))
    running = ordered_running(clean, [], [F.col("importance").desc(), F.col("fragment")], {"cum": "importance"})
    total = clean.agg(F.coalesce(F.sum("importance"), F.lit(0.0)).alias("total"), F.count("*").alias("n_all"))
    following = running.select((F.col("rn") - 1).alias("rn"), F.col("importance").alias("next"))
    share = F.try_divide(F.col("cum"), F.col("total"))
    return running.join(following, "rn", "left").crossJoin(F.broadcast(total)).select("fragment", "importance", "rn", share.alias("cum_share"), ((F.col("importance") - F.col("next")) / (F.col("importance") + TINY)).alias("drop"), "n_all")  # total: one row


def cumulative_cutoff(ranked: DataFrame, share: float = 0.8) -> DataFrame:
    """One row: the first rank at which the cumulative share is reached, else all fragments."""
    return ranked.agg(F.coalesce(F.min(F.when(F.col("cum_share") >= share - 1e-12, F.col("rn"))), F.count("*")).alias("n_selected"))


def knee_points(ranked: DataFrame, sensitivities: Sequence[float] = SENSITIVITIES) -> DataFrame:
    """One row: the rank of the knee (``knee0`` ..) of the importance curve at each sensitivity, null where there is none.

    Kneedle for a convex, falling curve: the difference of the turned curve and the diagonal has peaks; a peak is a knee if the
    difference falls below the peak less ``sensitivity`` mean steps before the next peak, and below 0 once it has passed a valley.
    Neighbours meet by rank and peaks are counted over range partitions, so the curve is never in one task.
    """
    scratch = Scratch(ranked.sparkSession, "knee")
    ends = F.broadcast(ranked.agg(F.min("importance").alias("lo"), F.max("importance").alias("hi"), F.count("*").alias("n")))  # one row
    height = 1 - (F.col("importance") - F.col("lo")) / (F.col("hi") - F.col("lo") + TINY)
    step = F.try_divide(F.lit(1.0), F.col("n") - 1)
    curve = scratch.save(ranked.select("rn", "importance").crossJoin(ends).select("rn", (height - (F.col("rn") - 1) * step).alias("d"), step.alias("step")), "curve")
    before, after = curve.select((F.col("rn") + 1).alias("rn"), F.col("d").alias("was")), curve.select((F.col("rn") - 1).alias("rn"), F.col("d").alias("next"))
    turns = curve.join(before, "rn", "left").join(after, "rn", "left")
    at_least, at_most = lambda c: F.coalesce(F.col("d") >= F.col(c), F.lit(True)), lambda c: F.coalesce(F.col("d") <= F.col(c), F.lit(True))
    turns = turns.select("rn", "d", "step", (at_least("was") & at_least("next")).cast("long").alias("peak"), (at_most("was") & at_most("next")).cast("long").alias("valley"))
    run = scratch.save(ordered_running(turns.withColumnRenamed("rn", "at"), [], [F.col("at")], {"peaks": "peak", "valleys": "valley"}), "run")
    peaks = run.where("peak = 1").select(F.col("peaks").alias("after_peak"), F.col("at").alias("top"), F.col("d").alias("top_d"), (F.col("valleys") - F.col("valley")).alias("top_valleys"))
    seen = run.select("at", "d", "step", (F.col("peaks") - F.col("peak")).alias("after_peak"), (F.col("valleys") - F.col("valley")).alias("past")).join(peaks, "after_peak")
    limit = lambda s: F.when(F.col("past") > F.col("top_valleys"), 0.0).otherwise(F.col("top_d") - s * F.col("step"))
    return seen.agg(*[F.min_by(F.when(F.col("d") < limit(s), F.col("top")), F.when(F.col("d") < limit(s), F.col("at"))).alias(f"knee{i}") for i, s in enumerate(sensitivities)])


def knee_cutoff(ranked: DataFrame, least: int = LEAST_FRAGMENTS, most_share: float = 0.8, with_knee: bool = True) -> DataFrame:
    """One row ``n_selected``: the knee, else the largest drop, else the cumulative share.

    With ``least`` fragments or fewer: all. The first sensitivity whose knee lies beyond ``least`` gives it. Otherwise the rank
    after which importance falls most, counted from ``least`` + 1 on, unless that keeps more than ``most_share`` of all; otherwise
    where four fifths of the importance are reached, at least ``least`` and at most half of all.
    """
    eligible = (F.col("rn") > least) & F.col("drop").isNotNull()
    gap = F.max_by(F.when(eligible, F.col("rn")), F.when(eligible, F.struct(F.col("drop"), -F.col("rn"))))
    reached = F.min(F.when(F.col("cum_share") >= 0.8 - 1e-12, F.col("rn")))
    row = ranked.agg(F.count("*").alias("n"), gap.alias("gap"), reached.alias("reached"))
    knee = F.lit(None).cast("long")
    if with_knee:
        row = row.crossJoin(F.broadcast(knee_points(ranked)))  # one row each
        knee = F.coalesce(*[F.when(F.col(f"knee{i}") > least, F.col(f"knee{i}")) for i in range(len(SENSITIVITIES))])
    fallback = F.least(F.greatest(F.coalesce("reached", F.lit(1)), F.lit(least)), F.floor(F.col("n") / 2))
    drop = F.when((F.col("n") >= least + 2) & (F.col("gap") <= F.col("n") * most_share), F.col("gap"))
    return row.select(F.when(F.col("n") <= least, F.col("n")).otherwise(F.coalesce(knee, drop, fallback)).cast("long").alias("n_selected"))


def stability_cutoff(ranked: DataFrame) -> DataFrame:
    """One row: the number of stable fragments. A resample does not change the given importances, so the better half is always chosen."""
    return ranked.agg(F.greatest(F.lit(1), F.floor(F.count("*") / 2)).cast("long").alias("n_selected"))


def stability_flags(ranked: DataFrame) -> DataFrame:
    """(fragment, rn, stability): 1 for the better half by rank, else 0."""
    return ranked.select("fragment", "rn", (F.col("rn") <= F.greatest(F.lit(1), F.floor(F.col("n_all") / 2))).cast("double").alias("stability"))


def step_up_cutoff(ranked: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row: Benjamini-Hochberg on the ranks themselves (rank / (n + 1)), which accepts none below ``alpha`` 1, so that a
    tenth of all, at least 1, is kept. For parity; ``label_fdr`` tests fragments against permuted labels."""
    p = F.col("rn") / (F.col("n_all") + 1)
    last = F.max(F.when(p <= F.lit(alpha) * F.col("rn") / F.col("n_all"), F.col("rn")))
    return ranked.agg(F.coalesce(last, F.greatest(F.lit(1), F.floor(F.count("*") / 10))).cast("long").alias("n_selected"))


CUTOFFS = {"cumulative": cumulative_cutoff, "knee": knee_cutoff, "stability": stability_cutoff, "rank_step_up": step_up_cutoff}


def cutoff(ranked: DataFrame, mode: str) -> DataFrame:
    """One row ``n_selected`` by one of CUTOFFS; an unknown mode is the knee."""
    return CUTOFFS.get(mode, knee_cutoff)(ranked)


def _log_factorial(n: np.ndarray) -> np.ndarray:
    """log(n!) by Stirling's series, and by a table below 32."""
    small = np.r_[0.0, np.cumsum(np.log(np.arange(1, 32)))]
    x = np.maximum(n, 31) + 1.0
    series = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(n < 32, small[np.minimum(n, 31).astype(int)], series)


@F.pandas_udf(DoubleType())
def _at_least(hit: pd.Series, size: pd.Series, marked: pd.Series, total: pd.Series) -> pd.Series:
    """Probability that at least ``hit`` of ``size`` drawn rows are marked, of ``total`` with ``marked`` marked ones."""
    log_choose = lambda n, k: _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)
    out = np.empty(len(hit))
    for i, (x, k, m, n) in enumerate(zip(hit.to_numpy(), size.to_numpy(), marked.to_numpy(), total.to_numpy())):
        at = np.arange(max(x, k + m - n, 0), min(k, m) + 1)
        out[i] = min(1.0, np.exp(log_choose(m, at) + log_choose(n - m, k - at) - log_choose(n, k)).sum())
    return pd.Series(out)


def label_fdr(members: DataFrame, labels: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(fragment, n, n_active, p_value, is_accepted): is a fragment more frequent among actives than under permuted labels?

    Over all permutations of the labels the count of actives with a fragment is hypergeometric, so the p-value is exact and no
    permutation is drawn. Benjamini-Hochberg: all up to the last rank with p <= alpha * rank / n are accepted.
    """
    known = labels.where("y is not null").select("key", "y").dropDuplicates(["key"])
    whole = known.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("m"), F.count("*").alias("n")).first()
    counts = members.join(known, "key").groupBy("fragment").agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("n_active"))
    tested = Scratch(members.sparkSession, "fdr").save(counts.withColumn("p_value", _at_least("n_active", "n", F.lit(whole.m).cast("long"), F.lit(whole.n).cast("long"))), "tested")
    ranked = ordered_running(tested, [], [F.col("p_value"), F.col("fragment")], {})
    last = tested.agg(F.count("*").alias("tests"))
    limit = ranked.crossJoin(F.broadcast(last)).agg(F.max(F.when(F.col("p_value") <= F.lit(alpha) * F.col("rn") / F.col("tests"), F.col("p_value"))).alias("limit"))  # one row each
    return tested.crossJoin(F.broadcast(limit)).select("fragment", "n", "n_active", "p_value", F.coalesce(F.col("p_value") <= F.col("limit"), F.lit(False)).alias("is_accepted"))


def select_fragments(ranked: DataFrame, cutoff: DataFrame, enrichment: DataFrame) -> DataFrame:
    """(fragment, selected_by): those above the cutoff without the negatively enriched, and all positively enriched known ones."""
    chosen = ranked.crossJoin(F.broadcast(cutoff)).where("rn <= n_selected").select("fragment")  # cutoff: one row
    negative = enrichment.where("enrichment < 0").select("fragment")
    positive = enrichment.where("enrichment > 0").join(ranked.select("fragment"), "fragment", "left_semi").select("fragment")
    kept = chosen.join(negative, "fragment", "left_anti").withColumn("selected_by", F.lit("threshold"))
    added = positive.join(chosen, "fragment", "left_anti").withColumn("selected_by", F.lit("AC_added"))
    return kept.unionByName(added)
