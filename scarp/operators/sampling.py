"""Choice of building blocks by use and reward: weights, a bandit's state, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How much an average reward lifts a probability, what is kept of it, what all get back, and the least probability.
LIFT, KEEP, SHARE, FLOOR = 2.0, 0.95, 0.05, 1e-6


def usage(uses: DataFrame, library: DataFrame) -> DataFrame:
    """(fragment, attempts, successes, reward) of every fragment of ``library``, also of those never used.

    ``uses``: fragment, success (0 or 1), reward; counted in the map tasks, so a fragment in a third of all uses is no hot key.
    """
    counts = uses.where("fragment is not null").groupBy("fragment").agg(F.count("*").alias("attempts"), F.sum("success").alias("successes"), F.avg("reward").alias("reward"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return library.select("fragment").where("fragment is not null").distinct().join(counts, "fragment", "left").select("fragment", zero("attempts"), zero("successes"), F.coalesce("reward", F.lit(0.0)).alias("reward"))


def inverse_usage(attempts: Column) -> Column:
    """The weight of a fragment before normalising: the less used, the likelier."""
    return 1.0 / (attempts + 1)


def normalised(rows: DataFrame, weight: Column, out: str) -> DataFrame:
    """Adds ``weight`` over its sum; the sum is one row."""
    total = F.broadcast(rows.agg(F.sum(weight).alias("__sum")))
    return rows.crossJoin(total).withColumn(out, weight / F.col("__sum")).drop("__sum")


def bandit_update(state: DataFrame) -> DataFrame:
    """Adds ``updated`` to (fragment, probability, attempts, reward): probabilities of used fragments grow with their average reward, all are
    drawn towards the even share, none falls below FLOOR, and they add up to 1."""
    n = F.broadcast(state.agg(F.count("*").alias("__n")))  # one row
    raw = F.col("probability") * F.when(F.col("attempts") > 0, 1 + LIFT * F.col("reward")).otherwise(1.0) * KEEP + SHARE / F.col("__n")
    raised = state.crossJoin(n).withColumn("__raw", F.greatest(raw, F.lit(FLOOR))).drop("__n")
    return normalised(raised, F.col("__raw"), "updated").drop("__raw")


def coverage(state: DataFrame) -> DataFrame:
    """One row: fragments, those used at all and their share, and the attempts of the least and most used."""
    return state.agg(F.count("*").alias("n_fragments"), F.count(F.when(F.col("attempts") > 0, 1)).alias("n_used"), F.avg((F.col("attempts") > 0).cast("double")).alias("coverage"), F.min("attempts").alias("least_used"), F.max("attempts").alias("most_used"))
