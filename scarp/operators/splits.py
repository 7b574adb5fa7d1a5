"""Train/test splits drawn by hash order, so they repeat exactly and need no random state."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..skew import ordered_running

_PRIME = 1_000_003


def draw(key: Column, seed: int = 0) -> Column:
    """A portable pseudo-random order number of an integer key."""
    return F.pmod(key * 7919 + (104_729 + 15_485_863 * seed), F.lit(1_000_003))


def in_test(group: Column, trial: Column, share: float) -> Column:
    """Whether a draw puts a group into the test part; portable like ``draw``, and squared so that draws are no shifts of each other."""
    x = F.pmod(group * 7919 + (104_729 + 15_485_863 * trial), F.lit(1_000_003))
    return F.pmod(x * x, F.lit(1_000_003)) < int(share * 1_000_003)


def stratified(rows: DataFrame, key: str, label: str, share: float, seed: int = 0) -> DataFrame:
    """Adds ``part``: the first floor(n * share) keys of each label, in drawn order, are ``test``."""
    drawn = rows.withColumn("__h", draw(F.col(key), seed))
    ranked = ordered_running(drawn, [label], [F.col("__h"), F.col(key)], {})
    sizes = rows.groupBy(label).agg(F.floor(F.count("*") * share).alias("__test"))
    joined = ranked.join(F.broadcast(sizes), ranked[label].eqNullSafe(sizes[label])).drop(sizes[label])  # a row per label
    return joined.withColumn("part", F.when(F.col("rn") <= F.col("__test"), "test").otherwise("train")).select(*rows.columns, "part")


def cliffs_in_train(rows: DataFrame, key: str, label: str, in_cliff: str, share: float, seed: int = 0) -> DataFrame:
    """All keys at a cliff train; floor(n * share) of the others, stratified, are the test part (all of them if fewer)."""
    counts = rows.agg(F.count("*").alias("n"), F.count(F.when(~F.col(in_cliff), 1)).alias("free")).first()
    of_free = min(1.0, int(counts.n * share) / counts.free) if counts.free else 0.0
    free = stratified(rows.where(~F.col(in_cliff)), key, label, of_free, seed)
    return free.unionByName(rows.where(in_cliff).withColumn("part", F.lit("train")))


def grouped(rows: DataFrame, key: str, label: str, group: str, share: float, trials: int = 256, tolerance: float = 0.02, seed: int = 0) -> DataFrame:
    """No group is in both parts. Of ``trials`` draws of groups, the first whose test labels' mean is within
    ``tolerance`` of the whole, or else the closest, is taken; ``share`` is a share of groups. Each
    ``seed`` has draws of its own."""
    return rows.withColumn("part", grouped_part(rows, label, group, share, trials, tolerance, seed))


def grouped_part(rows: DataFrame, label: str, group: str, share: float, trials: int = 256, tolerance: float = 0.02, seed: int = 0) -> Column:
    """The ``part`` of ``grouped``."""
    return grouped_parts(rows, label, group, share, [seed], trials, tolerance)[0]


def grouped_parts(rows: DataFrame, label: str, group: str, share: float, seeds: Sequence[int], trials: int = 256, tolerance: float = 0.02) -> list[Column]:
    """``grouped_part`` of each of ``seeds``: one pass over the groups counts what every draw of every seed puts into the test part."""
    base = rows.agg(F.avg(label).alias("m")).first().m
    sums = rows.where(F.col(group).isNotNull()).groupBy(F.pmod(F.col(group) * 7919 + 104_729, F.lit(_PRIME)).alias("x")).agg(F.coalesce(F.sum(label), F.lit(0)).cast("double").alias("y"), F.count(label).alias("c"), F.count("*").alias("n"))
    turns = [t for seed in seeds for t in range(seed * trials, (seed + 1) * trials)]

    def count(batches):
        import pyarrow as pa

        square = np.arange(_PRIME, dtype=np.int64) ** 2 % _PRIME < int(share * _PRIME)
        hit = np.concatenate([square, square])
        held = np.zeros((len(turns), 3))
        for batch in batches:
            x, *columns = (batch.column(i).to_numpy() for i in range(4))
            values = np.stack(columns, -1).astype(float)
            for i, t in enumerate(turns):
                held[i] += values[hit[x + 15_485_863 * t % _PRIME]].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(turns, pa.int64()), *map(pa.array, held.T)], ["trial", "y", "c", "n"])

    drawn = sums.mapInArrow(count, "trial long, y double, c double, n double").groupBy("trial").agg(*[F.sum(c).alias(c) for c in "ycn"]).where("n > 0")
    means = drawn.select("trial", F.when(F.col("c") > 0, F.col("y") / F.col("n")).alias("m")).withColumn("off", F.round(F.abs(F.col("m") - F.lit(base)), 9))
    first = F.min(F.struct(F.when(F.col("off") <= tolerance, 0.0).otherwise(F.col("off")).alias("off"), "trial")).alias("best")
    best = {r.seed: r.best.trial for r in means.groupBy(F.floor(F.col("trial") / trials).alias("seed")).agg(first).collect()}  # a row per seed
    return [F.when(in_test(F.col(group), F.lit(best.get(seed, seed * trials)).cast("long"), share), "test").otherwise("train") for seed in seeds]
