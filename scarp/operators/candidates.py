"""Scoring, filtering and selection of generated candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..skew import blocked_join, first_k, hot_keys
from ..store import Scratch

# Weights of the aggregate score, of the late adjustment, its targets, and the scale of enrichment.
WEIGHTS = {"qsar": 0.4, "sa": 0.4, "qed": 0.2}
ADJUST_WEIGHT, LOW_TARGET, HIGH_TARGET, ENRICHMENT_SCALE = 0.4, 0.75, 0.85, 30.0
#: Cells of the Pareto grid along each objective.
LEVELS = 16
#: Values that one task compares with each other at once; more of them go through the grid.
FEW = 4096
#: Candidates that one round of the sequential choice looks at.
LOOK_AHEAD = 64


def normalised_sa(raw: Column) -> Column:
    """Raw accessibility 1 (easy) .. 10 (hard) to 1 .. 0."""
    return 1 - F.least((raw - 1) / 9, F.lit(1.0))


def aggregate_score(qsar: Column, sa: Column, qed: Column) -> Column:
    return WEIGHTS["qsar"] * qsar + WEIGHTS["sa"] * sa + WEIGHTS["qed"] * qed


def boost(enrichment: Column) -> Column:
    return F.when(enrichment > 0, 1 - F.exp(-enrichment / ENRICHMENT_SCALE)).otherwise(0.0)


def late_adjusted(qsar: Column, by: Column) -> Column:
    """The probability drawn towards a target by its boost; never lowered, and 0.5 counts as high."""
    weight = F.when(qsar < 0.5, ADJUST_WEIGHT * by).otherwise(ADJUST_WEIGHT * 0.5 * by)
    target = F.when(qsar < 0.5, LOW_TARGET).otherwise(HIGH_TARGET)
    return F.greatest(qsar, F.least(F.greatest((1 - weight) * qsar + weight * target, F.lit(0.0)), F.lit(1.0)))


def fragment_boost(used: DataFrame, enrichment: DataFrame) -> DataFrame:
    """(key, enrichment, boost) from used fragments (key, fragment; repeats count) and their enrichment (fragment unique).

    Uses are counted per key and fragment first; a fragment that many keys use meets its one value by broadcast.
    """
    counts = Scratch(used.sparkSession, "boost").save(used.where("fragment is not null").groupBy("key", "fragment").agg(F.count("*").alias("times")), "uses")
    positive = enrichment.where("enrichment > 0").select("fragment", "enrichment")
    hot = hot_keys(counts, "fragment").select("fragment")
    few = F.broadcast(positive.join(hot, "fragment"))
    met = counts.join(few, "fragment").unionByName(counts.join(F.broadcast(hot), "fragment", "left_anti").join(positive, "fragment"))
    total = met.groupBy("key").agg(F.sum(F.col("times") * F.col("enrichment")).alias("enrichment"))
    return total.withColumn("boost", boost(F.col("enrichment")))


def _undominated(values: np.ndarray) -> np.ndarray:
    """Mask of the rows that no other row beats: at least as good in all columns and better in one."""
    order = np.lexsort(tuple(-values[:, i] for i in range(values.shape[1] - 1, -1, -1)))
    front = np.empty_like(values)
    held = 0
    keep = np.zeros(len(values), bool)
    for i in order:  # a row can only be dominated by one before it in this order
        row = values[i]
        if not ((front[:held] >= row).all(axis=1) & (front[:held] > row).any(axis=1)).any():
            front[held] = row
            held += 1
            keep[i] = True
    return keep


def pareto_front(rows: DataFrame, objectives: list[str], levels: int = LEVELS) -> DataFrame:
    """Rows not dominated in all ``objectives`` (higher is better); equal rows all stay, rows with a null or NaN are left out.

    Distinct values lose what their own Arrow batch beats, and are then cut into a grid by ``levels`` quantiles of each
    objective. A cell that another beats by a level in every objective is empty of the front; what is left of a cell
    meets only the cells that are nowhere below it, in a join on the cell whose large cells are split into blocks. So
    neither the front nor a cell passes through one task, even where the front is the whole table. The cells, at most
    ``levels ** len(objectives)``, are the only thing that the driver sees. What the batches leave is counted first: up to
    FEW values need no grid.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "front")
    usable = rows
    for c in objectives:
        usable = usable.where(F.col(c).isNotNull() & ~F.isnan(c))
    values = usable.select(*[F.col(c).cast("double").alias(c) for c in objectives]).distinct()

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[_undominated(frame.to_numpy(float))]

    kept, seen = scratch.save_measured(values.mapInPandas(local, values.schema), "local")
    if seen["n"] <= FEW:

        def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if held := list(frames):
                yield from local([pd.concat(held)])

        front = kept.coalesce(1).mapInPandas(whole, kept.schema)
        return usable.join(F.broadcast(front), objectives, "left_semi")
    share = F.array(*[F.lit(i / levels) for i in range(1, levels)])
    edges = kept.agg(*[F.percentile_approx(c, share, 1000).alias(c) for c in objectives]).first()
    cell = F.lit(0)
    for c in objectives:
        level = sum((F.when(F.col(c) > e, 1).otherwise(0) for e in sorted(set(edges[c] or []))), F.lit(0))
        cell = cell * levels + level
    celled = kept.withColumn("cell", cell.cast("int"))
    filled = np.array([r.cell for r in celled.select("cell").distinct().collect()], int)
    grid = np.stack([filled // levels**i % levels for i in range(len(objectives) - 1, -1, -1)], axis=1) if len(filled) else np.empty((0, len(objectives)), int)
    open_ = [i for i in range(len(grid)) if not (grid > grid[i]).all(axis=1).any()]
    meets = [(int(filled[i]), int(filled[j])) for i in open_ for j in open_ if (grid[j] >= grid[i]).all()]
    rivals = F.broadcast(spark.createDataFrame(meets, "cell int, rival int"))
    near = [F.col(c).alias(f"__{c}") for c in objectives]
    asked = scratch.save(celled.join(F.broadcast(spark.createDataFrame([(int(filled[i]),) for i in open_], "cell int")), "cell"), "open")
    against = asked.join(rivals, "cell").select(F.col("rival").alias("cell"), *near)
    beaten = blocked_join(against, asked, "cell", seen["n"])
    for c in objectives:
        beaten = beaten.where(F.col(c) >= F.col(f"__{c}"))
    better = F.lit(False)
    for c in objectives:
        better = better | (F.col(c) > F.col(f"__{c}"))
    lost = scratch.save(beaten.where(better).select(*[F.col(f"__{c}").alias(c) for c in objectives]).distinct(), "lost")
    front = asked.drop("cell").join(lost, objectives, "left_anti")
    return usable.join(front, objectives, "left_semi")


def top_k(rows: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The best k rows, numbered from 1 as ``rank``; null and NaN scores come last and ties go by key."""
    return first_k(rows, -F.nanvl(F.col(score), F.lit(None).cast("double")), [key], k)


def per_group(rows: DataFrame, group: str, score: str, key: str, most: int) -> DataFrame:
    """At most ``most`` rows per group, the best first. A rank filter, so each map task sends ``most`` rows a group."""
    clean = F.nanvl(F.col(score), F.lit(None).cast("double"))
    ranked = rows.withColumn("group_rank", F.row_number().over(W.partitionBy(group).orderBy(clean.desc_nulls_last(), key)))
    return ranked.where(F.col("group_rank") <= most)


def greedy_diverse(candidates: DataFrame, key: str, tokens: str, size: int) -> DataFrame:
    """(key, pick): the first candidate by ``rank``, then always the one whose most similar pick is least similar (ties: rank).

    The rule is sequential, so the driver makes at most ``size`` picks, but it never holds the candidates: each round
    fetches the LOOK_AHEAD best of a distributed table of (similarity to the nearest pick, rank) and goes on among these
    as long as none outside of them can come before; then every candidate's similarity is brought up to date, in parallel,
    against the new picks. Two empty sets count as equal. Any number of candidates; fewer than ``size`` give fewer rows.
    """
    spark = candidates.sparkSession
    scratch = Scratch(spark, "diverse")
    state = scratch.save(candidates.select(F.col(key).alias("key"), F.col(tokens).alias("toks"), "rank", F.lit(-1.0).alias("near")), "state")
    chosen: list = []
    while len(chosen) < size:
        head = state.orderBy("near", "rank").limit(LOOK_AHEAD).collect()
        if not head:
            break
        edge = (head[-1].near, head[-1].rank) if len(head) == LOOK_AHEAD else (float("inf"), 0)
        left = [[r.near, r.rank, frozenset(r.toks), r] for r in head]
        fresh = []
        while left and len(chosen) < size:
            best = min(left, key=lambda x: (x[0], x[1]))
            if (best[0], best[1]) > edge:
                break
            left.remove(best)
            fresh.append(best[3])
            chosen.append(best[3].key)
            for other in left:
                union = len(other[2] | best[2])
                other[0] = max(other[0], len(other[2] & best[2]) / union if union else 1.0)
        if len(chosen) < size:
            sims = F.lit(-1.0)
            for pick in fresh:
                lit = F.array(*[F.lit(t) for t in pick.toks]).cast("array<string>")
                shared = F.size(F.array_intersect("toks", lit))
                sims = F.greatest(sims, F.coalesce(F.try_divide(shared.cast("double"), F.size("toks") + len(pick.toks) - shared), F.lit(1.0)))
            rest = state.where(~F.col("key").isin([p.key for p in fresh])).withColumn("near", F.greatest("near", sims))
            following = scratch.save(rest, "state")
            scratch.forget(state)
            state = following
    return spark.createDataFrame([(k, i + 1) for i, k in enumerate(chosen)], f"`{key}` {candidates.schema[key].dataType.simpleString()}, pick int")


def weighted_sample(rows: DataFrame, key: str, weight: Column, size: int, seed: int = 0) -> DataFrame:
    """``size`` rows without replacement, with probabilities by weight; weights of 0 or below, or null, are never drawn."""
    u = (F.pmod(F.col(key) * 7919 + (104_729 + 15_485_863 * seed), F.lit(1_000_003)) + 1) / 1_000_004.0
    clocked = rows.withColumn("__w", weight).where("__w > 0").withColumn("__clock", F.round(-F.log(u) / F.col("__w"), 9))
    return first_k(clocked, F.col("__clock"), [key], size, "__rank").drop("__w", "__clock", "__rank")
