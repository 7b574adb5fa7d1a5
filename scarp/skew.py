"""Joins, ranks and running sums that hold when one key has a third of all rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .store import Scratch

#: A key is hot when it has more than one in HOT_KEYS of all rows, so there are at most HOT_KEYS hot keys.
HOT_KEYS = 1000
#: Rows of one key that any task can take; no key with fewer is called hot (``scarp.hotRows`` of the session).
HOT_ROWS = 50_000
#: Rows that one chunk of a group is meant to have; the number of chunks grows with the table (``scarp.chunkRows``).
CHUNK_ROWS = 200_000


def _setting(spark: SparkSession, name: str, default: int) -> int:
    return int(spark.conf.get(name, str(default)))


def least_hot(spark: SparkSession, rows: int) -> int:
    """Rows from which on a key of a table of ``rows`` rows is hot."""
    return max(_setting(spark, "scarp.hotRows", HOT_ROWS), rows // HOT_KEYS + 1)


def hot_keys(df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """(key, count) of the at most HOT_KEYS keys with too many rows for one task; pre-aggregated before the shuffle."""
    total = df.count() if rows is None else rows
    counted = df.where(F.col(key).isNotNull()).groupBy(key).count()
    return counted.where(F.col("count") >= least_hot(df.sparkSession, total))


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", rows: int | None = None, most: int | None = None) -> DataFrame:
    """Join a large, skewed ``left`` with ``right``, whose ``key`` is unique.

    Rows of hot keys get their one match by broadcast (at most HOT_KEYS rows of
    ``right``); all others go through an ordinary shuffled join. ``left`` is read
    more than once, so hand in a table or something cheap. Null keys match nothing.
    A caller that knows the number of ``rows``, or the ``most`` rows any key has, saves a count.
    """
    assert how in ("left", "inner")
    total = left.count() if rows is None else rows
    if (total if most is None else most) < least_hot(left.sparkSession, total):
        return left.join(right, key, how)  # no key can be hot
    hot = hot_keys(left, key, total).select(key)
    few = F.broadcast(hot.join(right, key, how).withColumn("__hot", F.lit(True)))
    names = [c for c in right.columns if c != key]
    out = [*left.columns, *names]
    is_hot = left.join(few, key, "inner").select(*out)
    keyed = left.where(F.col(key).isNotNull())
    rest = keyed.join(F.broadcast(hot), key, "left_anti").join(right, key, how).select(*out)
    if how == "inner":
        return is_hot.unionByName(rest)
    # Rows without a key need no shuffle, which would send them all to one task.
    empty = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in names]
    return is_hot.unionByName(rest).unionByName(left.where(F.col(key).isNull()).select(*left.columns, *empty))


def blocked_join(left: DataFrame, right: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """Inner join of two tables that both have many rows of a key: no task gets more than a block of a hot key.

    The rows that ``left`` has of a hot key are cut into blocks by hash, as many as its count asks for, and the
    rows of ``right`` with that key go to each block. Both sides may be the same table. At most HOT_KEYS keys
    are hot, so their table is broadcast. Columns other than ``key`` must differ in name.
    """
    total = left.count() if rows is None else rows
    least = least_hot(left.sparkSession, total)
    if total < least:
        return left.join(right, key)
    parts = F.broadcast(hot_keys(left, key, total).select(key, F.ceil(F.col("count") / least).cast("int").alias("__parts")))
    one = F.coalesce("__parts", F.lit(1))
    cut = left.join(parts, key, "left").withColumn("__block", F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), one)).drop("__parts")
    spread = right.join(parts, key, "left").withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), one.cast("long") - 1))).drop("__parts")
    return cut.join(spread, [key, "__block"]).drop("__block")


def salted_rank(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str, id_cols: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Number the rows of each ``by`` group 1..n without gathering a group in one task.

    The order is by salt (a hash of ``id_cols``), then ``order``: deterministic and
    arbitrary, for callers that need distinct ranks and not a sorted sequence. There are as many
    salts as the table has chunks of CHUNK_ROWS, so the largest piece of a group does not grow.
    """
    total = df.count() if rows is None else rows
    salts = max(1, math.ceil(total / _setting(df.sparkSession, "scarp.chunkRows", CHUNK_ROWS)))
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in id_cols]), F.lit(salts)))
    keys = [*by, "__salt"]
    counts = salted.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*by).orderBy("__salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*keys, before.alias("__before"))
    ranked = salted.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    cond = [ranked[k].eqNullSafe(offsets[k]) for k in keys]
    joined = ranked.join(offsets, cond, "inner")
    return joined.select(*[ranked[c] for c in df.columns], (F.col("__rn") + F.col("__before")).cast("long").alias(name))


def running_sum(df: DataFrame, by: Sequence[str], order: str, tie: Sequence[str], value: str, name: str, rows: int | None = None) -> DataFrame:
    """Sum of ``value`` over the rows before this one, in the order of the hash column ``order``.

    The order column is a well-mixed signed 64-bit hash; its upper bits cut each group into chunks of
    even size, whose sums are added up first. There are as many chunks as the table has CHUNK_ROWS.
    """
    total = df.count() if rows is None else rows
    bits = max(1, math.ceil(math.log2(max(1, total / _setting(df.sparkSession, "scarp.chunkRows", CHUNK_ROWS)))))
    cut = df.withColumn("__chunk", F.shiftright(F.col(order), 64 - bits))
    keys = [*by, "__chunk"]
    sums = cut.groupBy(*keys).agg(F.sum(value).alias("__s"))
    before = F.coalesce(F.sum("__s").over(W.partitionBy(*by).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(*keys, before.alias("__before"))
    within = F.coalesce(F.sum(value).over(W.partitionBy(*keys).orderBy(order, *tie).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = cut.withColumn("__within", within)
    cond = [ranked[k].eqNullSafe(offsets[k]) for k in keys]
    joined = ranked.join(offsets, cond, "inner")
    return joined.select(*[ranked[c] for c in df.columns], (F.col("__within") + F.col("__before")).cast("long").alias(name))


def ordered_running(df: DataFrame, by: Sequence[str], order: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """Sorted ranks and running sums without gathering a group, or the whole table, in one task.

    Rows are range-partitioned on ``by`` and ``order`` and written once; each partition numbers and
    sums its own rows of a group, and one row per (group, partition) carries what came before. ``order``
    must tell all rows of a group apart. Adds ``rn`` (from 1) and, for each ``{name: column}`` of
    ``sums``, the sum up to and including the row.
    """
    scratch = Scratch(df.sparkSession, "ordered")
    keys = [F.col(c) for c in by]
    ranged = scratch.save(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), "ranged")
    own = W.partitionBy(*by, "__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy(*by, "__part").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = totals.select(*by, "__part", zero("__n").alias("__b"), *[zero(f"__t_{n}").alias(f"__b_{n}") for n in sums])
    local = ranged.withColumn("__rn", F.count("*").over(own))
    for name, column in sums.items():
        local = local.withColumn(f"__s_{name}", F.sum(column).over(own))
    joined = local.join(offsets, [local[k].eqNullSafe(offsets[k]) for k in [*by, "__part"]], "inner")
    return joined.select(*[local[c] for c in df.columns], (F.col("__rn") + F.col("__b")).cast("long").alias("rn"), *[(F.col(f"__s_{n}") + F.col(f"__b_{n}")).alias(n) for n in sums])


def first_k(df: DataFrame, value: Column, tie: Sequence[str], k: int, name: str = "rank", rows: int | None = None) -> DataFrame:
    """The k rows with the smallest ``value`` (null and NaN last, then by ``tie``), numbered from 1 as ``name``.

    A quantile of the values cuts off what cannot be among them; the few rows at or below the cut are ranked over
    range partitions, so neither the choice nor the numbering of a large k goes through one task. ``tie`` must tell
    rows apart. ``df`` is read more than once, so hand in a table.
    """
    total = df.count() if rows is None else rows
    keyed = df.withColumn("__v", F.coalesce(F.nanvl(value.cast("double"), F.lit(None).cast("double")), F.lit(float("inf"))))
    share = (k + 1) / max(1, total)
    if share < 0.5:
        cut = keyed.agg(F.percentile_approx("__v", min(1.0, share * 1.05 + 1e-3), 10_000).alias("c")).first().c
        near = keyed.where(F.col("__v") <= cut) if cut is not None else keyed
        if near.count() >= k:
            keyed = near
    return ordered_running(keyed, [], [F.col("__v"), *[F.col(c) for c in tie]], {}).where(F.col("rn") <= k).drop("__v").withColumnRenamed("rn", name)


def exact_percentile(df: DataFrame, column: str, q: float) -> float | None:
    """The linearly interpolated percentile of the non-null values, exact at any size.

    Approximate quantiles bracket the answer; the rows below the bracket are counted and only the
    two rows in question are sorted out of it. None for a table without values.
    """
    values = df.where(F.col(column).isNotNull() & ~F.isnan(column)).select(F.col(column).cast("double").alias("v"))
    n = values.count()
    if not n:
        return None
    at = (n - 1) * q
    low_rank = int(at)
    slack = max(0.002, 2.0 / n)
    lo, hi = values.select(F.percentile_approx("v", F.array(F.lit(max(0.0, q - slack)), F.lit(min(1.0, q + slack))), F.lit(10_000)).alias("p")).first().p
    edge = values.agg(F.count(F.when(F.col("v") < lo, 1)).alias("below"), F.count(F.when(F.col("v") <= hi, 1)).alias("upto"), F.min(F.when(F.col("v") > hi, F.col("v"))).alias("next")).first()
    assert edge.below <= low_rank, "the bracket starts above the rank"
    inside = values.where((F.col("v") >= lo) & (F.col("v") <= hi)).groupBy("v").count()
    ranked = ordered_running(inside, [], [F.col("v")], {"c": "count"}).select("v", (F.col("c") + edge.below).alias("upto"))
    pick = ranked.agg(F.min(F.when(F.col("upto") > low_rank, F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > low_rank + 1, F.col("v"))).alias("b")).first()
    a = pick.a if pick.a is not None else edge.next
    b = a if low_rank + 1 >= n else (pick.b if pick.b is not None else edge.next)
    return a + (b - a) * (at - low_rank)
