"""Pairwise links consolidated into groups.

Each round strips vertices of degree one and splices out vertices of degree two
(list ranking by random independent sets: a vertex goes if its random number of
this round beats those of its removable neighbours), so trees and chains of any
length shrink by a constant fraction a round. What then is left, a core in which
every vertex has three neighbours or more, is contracted around local maxima of
the random numbers, stripped again, and so on until no edge is left. Removed
vertices remember a neighbour that outlived them; pointer doubling over these
restores their labels.

Stripping needs three aggregations with partial sums and no join, so a hub with
a third of all links is harmless; joins on vertices go through ``lookup_join``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..skew import lookup_join
from ..store import Scratch

#: A round that removes less than this share of the edges by stripping is followed by a contraction.
STRIP_SHARE = 0.1


def _draw(vertex: Column, turn: int) -> Column:
    """The random number of a vertex in one round, with the vertex as tie-break."""
    return F.struct(F.xxhash64(vertex, F.lit(turn)).alias("p"), vertex.alias("x"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.inline(F.array(F.struct(F.col("u").alias("v"), F.col("w")), F.struct(F.col("w").alias("v"), F.col("u").alias("w")))))


def _strip(edges: DataFrame, turn: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """Remove an independent set of vertices of degree one and two: (removed v, parent; edges left; how many)."""
    degree = _both_ways(edges).groupBy("v").agg(F.count("*").alias("n"), F.min("w").alias("w1"), F.max("w").alias("w2")).where("n <= 2")
    own = F.struct(F.col("v").alias("x"), _draw(F.col("v"), turn).alias("mine"), F.lit(None).cast("struct<p:bigint,x:bigint>").alias("theirs"), "w1", "w2", "n")
    note = lambda w: F.struct(F.col(w).alias("x"), F.lit(None).cast("struct<p:bigint,x:bigint>").alias("mine"), _draw(F.col("v"), turn).alias("theirs"), F.lit(None).cast("bigint").alias("w1"), F.lit(None).cast("bigint").alias("w2"), F.lit(None).cast("bigint").alias("n"))
    messages = degree.select(F.inline(F.array(own, note("w1"), note("w2"))))
    met = messages.groupBy("x").agg(F.max("mine").alias("mine"), F.max("theirs").alias("theirs"), F.max("w1").alias("w1"), F.max("w2").alias("w2"), F.max("n").alias("n"))
    gone = scratch.save(met.where("mine is not null and (theirs is null or mine > theirs)").select(F.col("x").alias("v"), "w1", "w2", "n"), f"strip{turn}")
    pair = lambda a, b, cut: F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("w"), F.lit(cut).alias("cut"))
    cuts = gone.select(F.inline(F.array(pair("v", "w1", 1), pair("v", "w2", 1))))
    spliced = gone.where("n = 2").select(F.inline(F.array(pair("w1", "w2", 0))))
    left = edges.withColumn("cut", F.lit(0)).unionByName(cuts).unionByName(spliced).groupBy("u", "w").agg(F.max("cut").alias("cut")).where("cut = 0").select("u", "w")
    rest, found = scratch.save_measured(left, f"edges{turn}")
    return gone.select("v", F.col("w1").alias("parent")), rest, found["n"]


def _contract(edges: DataFrame, n: int, turn: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """Merge each vertex into its best neighbour where that is a local maximum: (merged v, parent; edges left; how many).

    No vertex is looked up more often than the highest degree, so without a hub no lookup needs to search for hot keys.
    """
    best = _both_ways(edges).groupBy("v").agg(F.max(_draw(F.col("w"), turn)).alias("best"), F.count("*").alias("degree"))
    best, seen = scratch.save_measured(best.select("v", F.col("best.x").alias("parent"), (_draw(F.col("v"), turn) > F.col("best")).alias("top"), "degree"), f"best{turn}", most=F.max("degree"))
    tops = best.where("top").select(F.col("v").alias("parent"))
    merged = scratch.save(lookup_join(best.where("not top").select("v", "parent"), tops, "parent", "inner", rows=seen["n"], most=seen["most"]).select("v", "parent"), f"merge{turn}")
    for end in ("u", "w"):
        moved = lookup_join(edges, merged.select(F.col("v").alias(end), F.col("parent").alias("to")), end, rows=n, most=seen["most"])
        edges = moved.withColumn(end, F.coalesce("to", end)).drop("to")
        if end == "u":
            edges = scratch.save(edges, f"move{turn}")
    left = edges.where("u <> w").select(F.least("u", "w").alias("u"), F.greatest("u", "w").alias("w")).distinct()
    rest, found = scratch.save_measured(left, f"edges{turn}")
    scratch.forget(best)
    return merged, rest, found["n"]


def vertex_labels(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, label) of every vertex that has an edge and is not its group's own label.

    ``edges`` has distinct rows (u, w) of bigint with u < w. Vertices that are missing
    from the result are labels themselves (of their group, or of themselves alone).
    """
    edges, seen = scratch.save_measured(edges, "edges")
    removed: list[DataFrame] = []
    turn, n = 0, seen["n"]
    while n:
        turn += 1
        gone, rest, left = _strip(edges, turn, scratch)
        removed.append(gone)
        if left and left > (1 - STRIP_SHARE) * n:
            turn += 1
            gone, core, kept = _contract(rest, left, turn, scratch)
            removed.append(gone)
            scratch.forget(rest)
            rest, left = core, kept
        scratch.forget(edges)
        edges, n = rest, left
    if not removed:
        return edges.select(F.col("u").alias("v"), F.col("w").alias("label"))
    up = removed[0]
    for more in removed[1:]:
        up = up.unionByName(more)
    up, seen = scratch.save_measured(up.select("v", F.col("parent").alias("label")), "up")
    for step in range(math.ceil(math.log2(len(removed) + 1))):
        onward = lookup_join(up, up.select(F.col("v").alias("label"), F.col("label").alias("further")), "label", rows=seen["n"])
        doubled = scratch.save(onward.select("v", F.coalesce("further", "label").alias("label")), f"up{step}")
        scratch.forget(up)
        up = doubled
    return up


def vertex_ids(names: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """Give each distinct ``mol`` a 64-bit hash as id, under a seed for which no two share one: ((id, mol), seed)."""
    for seed in range(16):
        ids = scratch.save(names.groupBy(vertex_id(F.col("mol"), seed).alias("id")).agg(F.min("mol").alias("mol"), F.max("mol").alias("other")), f"ids{seed}")
        if ids.where("mol <> other").isEmpty():
            return ids.select("id", "mol"), seed
        scratch.forget(ids)
    raise ValueError("no seed keeps the hashes of these names apart; number them first")


def vertex_id(name: Column, seed: int) -> Column:
    return F.xxhash64(name, F.lit(seed))


def clean_structure(text: Column) -> Column:
    """A structure without the blanks and tabs around it; null if nothing is left."""
    return F.nullif(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(""))


def consolidate(links: DataFrame, left: str, right: str) -> DataFrame:
    """(group_mol, mol): the smallest name, in byte order, of all that ``mol`` is linked to directly or through others.

    Links with a missing or blank end are none. Repeats, reversed repeats and self links are
    harmless; a name that occurs in self links only is a group of its own. An empty table gives no rows.
    """
    scratch = Scratch(links.sparkSession, "groups")
    pairs = links.select(clean_structure(F.col(left)).alias("a"), clean_structure(F.col(right)).alias("b")).where("a is not null and b is not null")
    names = pairs.select(F.explode(F.array("a", "b")).alias("mol"))
    ids, seed = vertex_ids(names, scratch)
    a, b = vertex_id(F.col("a"), seed), vertex_id(F.col("b"), seed)
    edges = pairs.where("a <> b").select(F.least(a, b).alias("u"), F.greatest(a, b).alias("w")).distinct()
    labels = vertex_labels(edges, scratch)
    named = scratch.save(ids.join(labels.withColumnRenamed("v", "id"), "id", "left").select("mol", F.coalesce("label", "id").alias("label")), "named")
    smallest = named.groupBy("label").agg(F.min("mol").alias("group_mol"))
    return lookup_join(named, smallest, "label", "inner").select("group_mol", "mol")
