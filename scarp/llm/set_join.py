"""All pairs of similar sets, by a size-aware overlap join.

Two sets of a and b tokens are similar (shared / united >= t) exactly if they
share at least c(a, b) = ceil(t (a + b) / (1 + t)) tokens. Small sets enumerate
their subsets of c tokens, each as the XOR of the hashes of the tokens that stay when
n - c of n tokens are left out, and meet where subsets are equal. Large sets scan the
inverted lists of their rarest tokens. Both lists of candidates are numbers only; they are
united, and what is left fetches its tokens once and is verified on them. Equal sets are joined
once, as one class.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.similarity import numbered_sets, tokens
from ..skew import blocked_join, lookup_join
from ..store import Scratch

#: Tokens that a small set leaves out at most; a set that would have to leave out more is large.
LEFT_OUT = 1
#: No set of more tokens is small, whatever the threshold.
MOST_SMALL = 32
DEFAULT_SIMILARITY = Fraction(4, 5)


def least_shared(a: int, b: int, t: Fraction) -> int:
    return math.ceil(t * (a + b) / (1 + t))


def subset_plan(small: int, t: Fraction) -> list[tuple[int, int, int]]:
    """(set size, tokens to leave out, subset size) that similar partners among the small sets make necessary."""
    rows = set()
    for a in range(1, small + 1):
        for b in range(1, small + 1):
            c = least_shared(a, b, t)
            if c <= min(a, b):
                rows.add((a, a - c, c))
    return sorted(rows)


def small_limit(t: Fraction, left_out: int = LEFT_OUT) -> int:
    """The largest size up to which no set has to leave out more than ``left_out`` tokens."""
    limit = 0
    while limit < MOST_SMALL and all(skip <= left_out for _, skip, _ in subset_plan(limit + 1, t)):
        limit += 1
    return limit


def _shared_sql(t: Fraction) -> str:
    """c(a, b) of columns a and b in exact integers."""
    p, q = t.numerator, t.denominator
    return f"({p}L * (a + b) + {p + q - 1}L) div {p + q}L"


def _small_candidates(sets: DataFrame, t: Fraction, limit: int, scratch: Scratch) -> DataFrame:
    """Pairs of small sets with an equal subset of the size they must share; only subsets seen twice are joined."""
    plan = sets.sparkSession.createDataFrame(subset_plan(limit, t), "n int, skip int, c int")  # at most MOST_SMALL ** 2 rows
    whole = F.aggregate("h", F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(x))
    one = F.transform("h", lambda x: F.col("whole").bitwiseXOR(x))
    two = F.flatten(F.transform("h", lambda x, i: F.transform(F.slice("h", i + 2, F.size("h")), lambda y: F.col("whole").bitwiseXOR(x).bitwiseXOR(y))))
    hashed = sets.where(F.col("n") <= limit).select("rep", "n", F.transform("s", lambda x: F.xxhash64(x)).alias("h")).withColumn("whole", whole)
    parts = F.when(F.col("skip") == 0, F.array("whole")).when(F.col("skip") == 1, one).when(F.col("skip") == 2, two).otherwise(F.raise_error(F.lit("a small set leaves out more than two tokens")))
    subsets = hashed.join(F.broadcast(plan), "n").select("rep", "n", "c", F.explode(parts).alias("part")).select("rep", "n", "c", F.xxhash64("c", "part").alias("part"))
    subsets, all_ = scratch.save_measured(subsets, "subsets")
    twice = subsets.groupBy("part").agg(F.count("*").alias("m")).where("m > 1").select("part")
    met, n = scratch.save_measured(lookup_join(subsets, twice, "part", "inner", rows=all_["n"]), "met")
    a, b = met.select("part", F.col("rep").alias("x"), F.col("n").alias("a"), "c"), met.select("part", F.col("rep").alias("y"), F.col("n").alias("b"))
    pairs = blocked_join(a, b, "part", n["n"])
    return pairs.where(f"x < y and c = {_shared_sql(t)}").select("x", "y")


def _large_candidates(sets: DataFrame, t: Fraction, limit: int, scratch: Scratch) -> DataFrame:
    """Pairs with a large set, from the inverted lists of each set's rarest tokens, which similar sets cannot all miss.

    A pair stays if the places of its first shared token leave room for all it must share.
    """
    p, q = t.numerator, t.denominator
    keep = F.col("n") - F.expr(f"cast(({p}L * n + {q - 1}L) div {q}L as int)") + 1
    lists = sets.where(F.col("n") >= math.ceil(t * (limit + 1))).select("rep", "n", F.posexplode(F.slice("s", 1, keep)).alias("at", "tok"))
    lists, n = scratch.save_measured(lists, "lists")
    a = lists.where(F.col("n") > limit).select("tok", F.col("rep").alias("x"), F.col("n").alias("a"), F.col("at").alias("i"))
    b = lists.select("tok", F.col("rep").alias("y"), F.col("n").alias("b"), F.col("at").alias("j"))
    once = (F.col("x") < F.col("y")) | (F.col("b") <= limit)
    met = blocked_join(a, b, "tok", n["n"]).where(once & (F.col("x") != F.col("y"))).where(f"least(a - i, b - j) >= {_shared_sql(t)}")
    return met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


class SimilarSets(NamedTuple):
    """``pairs`` (x, y, sim) of classes with x < y, ``classes`` (rep, copies), ``members`` (rep, key) and the number of pairs."""

    pairs: DataFrame
    classes: DataFrame
    members: DataFrame
    n_pairs: int


def similar_sets(rows: DataFrame, key: str, token: Column, t: Fraction = DEFAULT_SIMILARITY, clean: Callable[[Column], Column] | None = None, left_out: int = LEFT_OUT) -> SimilarSets:
    """The sets whose Tanimoto similarity is at least ``t`` (a fraction above 0), exactly, at any ``t``.

    A class is all keys with the same set, named by its smallest key; its members are all
    similar to each other. Keys without a token form no class; null tokens and repeats do not count.
    ``clean`` takes spellings to tokens, as in ``numbered_sets``.
    """
    assert 0 < t <= 1 and 0 <= left_out <= 2
    scratch = Scratch(rows.sparkSession, "sets")
    all_sets = numbered_sets(tokens(rows, key, token), scratch, clean)
    reps = scratch.save(all_sets.groupBy("s").agg(F.min("key").alias("rep"), F.count("*").alias("copies")).withColumn("n", F.size("s")), "classes")
    # Classes of one need no join back; the others' keys find their class by the set itself, however many copies it has.
    shared = reps.where("copies > 1").select("s", "rep")
    doubles = lookup_join(all_sets.select("key", "s"), shared, "s", "inner").select("rep", "key")
    members = scratch.save(reps.where("copies = 1").select("rep", F.col("rep").alias("key")).unionByName(doubles), "members")
    limit = small_limit(t, left_out)
    candidates = _small_candidates(reps, t, limit, scratch).unionByName(_large_candidates(reps, t, limit, scratch)).distinct()
    left, right = reps.select(F.col("rep").alias("x"), F.col("s").alias("xs")), reps.select(F.col("rep").alias("y"), F.col("s").alias("ys"))
    told = candidates.join(left, "x").join(right, "y").select("x", "y", F.size("xs").cast("long").alias("a"), F.size("ys").cast("long").alias("b"), F.size(F.array_intersect("xs", "ys")).cast("long").alias("o"))
    found = told.where(f"o >= {_shared_sql(t)}").select("x", "y", (F.col("o") / (F.col("a") + F.col("b") - F.col("o"))).alias("sim"))
    pairs, n = scratch.save_measured(found, "pairs")
    return SimilarSets(pairs, reps.select("rep", "copies"), members, n["n"])


def similar_pairs(rows: DataFrame, key: str, token: Column, t: Fraction = DEFAULT_SIMILARITY, clean: Callable[[Column], Column] | None = None, left_out: int = LEFT_OUT) -> DataFrame:
    """(mol_i, mol_j, sim) of all keys with mol_i < mol_j and a similarity of at least ``t``, copies included."""
    found = similar_sets(rows, key, token, t, clean, left_out)
    one = found.members.select(F.col("rep").alias("x"), F.col("key").alias("i"))
    two = found.members.select(F.col("rep").alias("y"), F.col("key").alias("j"))
    across = blocked_join(blocked_join(found.pairs, one, "x", found.n_pairs), two, "y").select("i", "j", "sim")
    several = found.members.join(found.classes.where("copies > 1"), "rep", "left_semi")
    same = blocked_join(several.toDF("x", "i"), several.toDF("x", "j"), "x").where("i < j").select("i", "j", F.lit(1.0).alias("sim"))
    return across.unionByName(same).select(F.least("i", "j").alias("mol_i"), F.greatest("i", "j").alias("mol_j"), "sim")


def linked_members(rows: DataFrame, key: str, token: Column, t: Fraction = DEFAULT_SIMILARITY, clean: Callable[[Column], Column] | None = None, left_out: int = LEFT_OUT) -> DataFrame:
    """(key, class_id, copies, n_links) of every key with a token: its class and to how many other keys it is similar; no pair of copies is made."""
    found = similar_sets(rows, key, token, t, clean, left_out)
    both = found.pairs.select(F.inline(F.array(F.struct("x", F.col("y").alias("rep")), F.struct(F.col("y").alias("x"), F.col("x").alias("rep")))))
    beside = lookup_join(both, found.classes, "rep", "inner", rows=2 * found.n_pairs).groupBy(F.col("x").alias("rep")).agg(F.sum("copies").alias("n"))
    counted = found.classes.join(beside, "rep", "left").select("rep", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return lookup_join(found.members, counted, "rep", "inner").select(F.col("key").alias(key), F.col("rep").alias("class_id"), "copies", "n_links")


def fragment_token(fragment: Column) -> Column:
    """A fragment without the numbering of its attachment points; blank ones count as null."""
    plain = F.regexp_replace(F.trim(fragment), r"\[(?:\d+\*|\*:\d+|\d+\*:\d+)\]", "[*]")
    return F.nullif(plain, F.lit(""))
