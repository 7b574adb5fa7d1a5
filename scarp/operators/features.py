"""Feature names and columns: cleaning, alignment, slices, scales, and choice of columns by variance, information and shadow features."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..skew import first_k
from ..store import Scratch
from . import models
from .splits import draw

#: How far probabilities keep from 0 and 1 before their logit, what keeps a scale finite, and the mark of descriptors.
CLIP, TINY, PREFIX = 1e-6, 1e-9, "DESC::"


def clean_name(name: Column) -> Column:
    """A feature name without brackets."""
    return F.translate(name, "[]<>", "")


def prefixed(name: Column) -> Column:
    return F.concat(F.lit(PREFIX), name)


def unprefixed(name: Column) -> Column:
    return F.regexp_replace(name, f"^{PREFIX}", "")


def feature_index(name: Column, offset: int = 0) -> Column:
    """The number that a feature name ends in (``x_0042``), less ``offset``; null if it ends in none."""
    return F.regexp_extract(name, r"_(\d+)$", 1).try_cast("int") - offset


def aligned_names(names: Sequence[str], n: int) -> list[str]:
    """Exactly ``n`` names: cut, or filled up with ``f<position>``; a repeated name gets ``__dup<k>``."""
    out, seen = [], {}
    for i in range(n):
        name = names[i] if i < len(names) else f"f{i}"
        seen[name] = seen.get(name, -1) + 1
        out.append(f"{name}__dup{seen[name]}" if seen[name] else name)
    return out


def named_frame(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns renamed; ``f0`` .. if the number of names does not fit."""
    return df.toDF(*(names if len(names) == len(df.columns) else [f"f{i}" for i in range(len(df.columns))]))


def gathered(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows with the given keys, as often as a key is given."""
    return ids.select(key).join(rows, key)


def sliced(rows: DataFrame, column: str, indices: Sequence[int], out: str) -> DataFrame:
    return VectorSlicer(inputCol=column, outputCol=out, indices=list(indices)).transform(rows)


def logit(p: Column, clip: float = CLIP) -> Column:
    held = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.log(held / (1 - held))


def clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))


def min_max(rows: DataFrame, column: str, by: Sequence[str], out: str) -> DataFrame:
    """Adds ``column`` from 0 to 1 within each group (of few groups); nulls stay null."""
    ends = F.broadcast(rows.groupBy(*by).agg(F.min(column).alias("__lo"), F.max(column).alias("__hi")))
    return rows.join(ends, list(by)).withColumn(out, (F.col(column) - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + TINY)).drop("__lo", "__hi")


def distinct_columns(rows: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns that are neither null everywhere, nor constant, nor named twice; one aggregation."""
    once = list(dict.fromkeys(columns))
    told = rows.agg(*[F.min(c).alias(f"lo_{i}") for i, c in enumerate(once)], *[F.max(c).alias(f"hi_{i}") for i, c in enumerate(once)]).first()
    return [c for i, c in enumerate(once) if told[f"lo_{i}"] is not None and told[f"lo_{i}"] != told[f"hi_{i}"]]


def by_variance(rows: DataFrame, columns: Sequence[str], k: int) -> list[str]:
    """The ``k`` columns that vary most (population variance; ties: the earlier)."""
    told = rows.agg(*[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(columns)]).first()
    order = sorted(range(len(columns)), key=lambda i: (-(told[f"v{i}"] or 0.0), i))
    return [columns[i] for i in order[:k]]


def information(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(fragment, n, information): mutual information, in nats, of a fragment's presence and the label, from four counts.

    Counts are added up in the map tasks, so a frequent fragment is no hot key; molecules without a label do not count.
    """
    known = labels.where("y is not null").select("key", "y").dropDuplicates(["key"])
    whole = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("n1")).first()
    counts = members.join(known, "key").groupBy("fragment").agg(F.count("*").alias("k"), F.sum(F.col("y").cast("long")).alias("k1"))
    n, n1 = float(whole.n), float(whole.n1)

    def term(both: Column, one: Column, other: float) -> Column:
        return F.when((both > 0) & (one > 0) & F.lit(other > 0), both / n * F.log(both * n / (one * max(other, 1.0)))).otherwise(0.0)

    k, k1 = F.col("k").cast("double"), F.col("k1").cast("double")
    total = term(k1, k, n1) + term(k - k1, k, n - n1) + term(n1 - k1, n - k, n1) + term(n - n1 - k + k1, n - k, n - n1)
    return counts.select("fragment", F.col("k").alias("n"), total.alias("information"))


def by_information(members: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """The ``k`` most informative fragments, ranked from 1 (rounded to 9 digits; ties by fragment)."""
    told = Scratch(members.sparkSession, "information").save(information(members, labels), "told")
    return first_k(told, -F.round("information", 9), ["fragment"], k)


def top_k_for(n: int, d: int) -> int:
    """How many of ``d`` columns to choose for ``n`` rows."""
    for below, most, part in ((100, 64, 4), (200, 96, 3), (350, 128, 2)):
        if n < below:
            return min(most, d // part)
    return min(256, d // 2)


def shadow_selection(rows: DataFrame, columns: Sequence[str], rounds: int = 10, confidence: float = 0.05, trees: int = 50) -> DataFrame:
    """(column, hits, is_kept): columns that matter more than the best of all permuted copies of columns, more often than chance.

    ``rows``: key, y, columns. Each round deals the rows' values anew (a join of two hash orders by rank), fits a forest on both halves,
    and counts a hit for each column above the most important shadow. Kept are those whose hits are unlikely (binomial, one half).
    """
    scratch = Scratch(rows.sparkSession, "shadows")
    base = scratch.save(rows.where("y in (0, 1)").select("key", "y", *columns), "base")
    hits = dict.fromkeys(columns, 0)
    both = base.select("y").distinct().count() == 2
    for turn in range(rounds if both and columns else 0):
        dealt = models.permuted(base.select("key", F.struct(*columns).alias("__all")), "__all", turn)
        wide = base.join(dealt.select("key", *[F.col(f"__all.{c}").alias(f"__shadow{i}") for i, c in enumerate(columns)]), "key")
        shadows = [f"__shadow{i}" for i in range(len(columns))]
        vectors = VectorAssembler(inputCols=[*columns, *shadows], outputCol="features").transform(scratch.save(wide, "wide"))
        weight = RandomForestClassifier(labelCol="y", numTrees=trees, maxDepth=5, seed=turn).fit(vectors).featureImportances.toArray()
        bar = max(weight[len(columns) :], default=0.0)
        for c, w in zip(columns, weight):
            hits[c] += int(w > bar)
    chance = lambda h: sum(math.comb(rounds, j) for j in range(h, rounds + 1)) / 2**rounds
    return rows.sparkSession.createDataFrame([(c, h, chance(h) <= confidence) for c, h in hits.items()], "column string, hits int, is_kept boolean")


def stratified_sample(rows: DataFrame, key: str, group: str, caps: dict[str, int], seed: int = 42) -> DataFrame:
    """For display: of each group in ``caps`` that many rows in drawn order, of all others everything. A rank filter cuts in the map tasks."""
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy(group).orderBy(draw(F.col(key), seed), key))
    cap = F.lit(None).cast("int")
    for name, most in caps.items():
        cap = F.when(F.col(group) == name, most).otherwise(cap)
    few = rows.where(F.col(group).isin(*caps)).withColumn("__rank", rank).where(F.col("__rank") <= max(caps.values())).where(F.col("__rank") <= cap).drop("__rank")
    return few.unionByName(rows.where(~F.coalesce(F.col(group).isin(*caps), F.lit(False))))
