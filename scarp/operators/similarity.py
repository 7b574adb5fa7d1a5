"""Tanimoto similarity joins, structure-activity cliffs and groups linked by them."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..skew import blocked_join, lookup_join, ordered_running
from ..store import Scratch

#: The cliff definition and the constant that keeps SALI finite.
CLIFF_SIMILARITY, CLIFF_DELTA, SALI_EPSILON = 0.8, 1.0, 1e-6
#: Distinct tokens whose numbers are broadcast; a larger vocabulary is joined by shuffle.
BROADCAST_TOKENS = 100_000
#: Query rows and table rows that meet in one block of a search without an index, at most.
QUERY_BLOCK, TABLE_BLOCK = 8192, 65536


def item_sets(rows: DataFrame, key: str, token: Column) -> DataFrame:
    """(key, toks, n): distinct non-null tokens of each key; keys without a token give no row."""
    pairs = rows.select(F.col(key).alias("key"), token.alias("tok")).where("key is not null and tok is not null")
    return pairs.groupBy("key").agg(F.array_sort(F.collect_set("tok")).alias("toks")).withColumn("n", F.size("toks"))


class Similar(NamedTuple):
    """Similar sets as classes of equal sets: ``pairs`` (x, y, sim) with x < y, ``classes`` (rep, copies), ``members`` (rep, key, copies)."""

    pairs: DataFrame
    classes: DataFrame
    members: DataFrame
    n_pairs: int


def tokens(rows: DataFrame, key: str, token: Column) -> DataFrame:
    """(key, tok): the non-null tokens of each key, repeats as they are."""
    return rows.select(F.col(key).alias("key"), token.alias("tok")).where("key is not null and tok is not null")


def numbered_sets(postings: DataFrame, scratch: Scratch, clean: Callable[[Column], Column] | None = None) -> DataFrame:
    """(key, s): the token sets of ``postings`` (key, tok) as sorted arrays of numbers; the rarest token has number 1.

    ``clean`` takes a spelling to its token (null: none) and is applied to the distinct spellings only.
    """
    spelled = postings.groupBy("tok").agg(F.count("*").alias("f")).withColumn("clean", clean(F.col("tok")) if clean else F.col("tok")).where("clean is not null")
    spelled, seen = scratch.save_measured(spelled, "spellings", rows=F.coalesce(F.sum("f"), F.lit(0)), most=F.coalesce(F.max("f"), F.lit(0)))
    counts = spelled.groupBy("clean").agg(F.sum("f").alias("f"))
    # The size of a vocabulary is checked: a small one is numbered in one window and goes to every task, any other is
    # numbered over ranges and joined by shuffle.
    small = seen["n"] <= BROADCAST_TOKENS
    if small:
        numbers = counts.select("clean", F.row_number().over(W.orderBy("f", "clean")).cast("long").alias("id"))
    else:
        numbers = ordered_running(counts, [], [F.col("f"), F.col("clean")], {}).select("clean", F.col("rn").alias("id"))
    numbers = spelled.join(numbers, "clean").select("tok", "id")
    numbered = postings.join(F.broadcast(numbers), "tok") if small else lookup_join(postings, numbers, "tok", "inner", rows=seen["rows"], most=seen["most"])
    return scratch.save(numbered.groupBy("key").agg(F.sort_array(F.collect_set("id")).alias("s")), "sets")


def similar_classes(postings: DataFrame, threshold: float, clean: Callable[[Column], Column] | None = None) -> Similar:
    """Keys of ``postings`` (key, tok) whose token sets have a Tanimoto similarity of at least ``threshold`` (above 0).

    Keys with equal sets are one class, named by its smallest key; its members are all similar to each other and
    are not expanded. Tokens are numbered from the rarest on, and a set is looked for under its first
    ``n - ceil(threshold * n) + 1`` tokens only: two similar sets share one of these. What meets there are
    (token, class, size, position), 32 bytes a row; a pair goes on if the positions of its first shared token leave
    room for enough more, and only such pairs fetch their sets. Repeats change nothing; keys without a token are in no class.
    """
    scratch = Scratch(postings.sparkSession, "tanimoto")
    sets = numbered_sets(postings, scratch, clean)
    size = F.size("s")
    keep = size - F.ceil(size * threshold - 1e-9).cast("int") + 1
    grouped = sets.groupBy("s").agg(F.min("key").alias("rep"), F.count("*").alias("copies"))
    classes, met = scratch.save_measured(grouped, "classes", probes=F.sum(keep))
    probes = classes.select("rep", size.alias("n"), F.posexplode(F.slice("s", 1, keep)).alias("i", "tok"))
    x, y = probes.toDF("x", "nx", "i", "tok"), probes.toDF("y", "ny", "j", "tok")
    needed = (F.col("nx") + F.col("ny")) * (threshold / (1 + threshold)) - 1e-9
    room = F.least(F.col("nx") - F.col("i"), F.col("ny") - F.col("j")) >= needed
    candidates = blocked_join(x, y, "tok", met["probes"] or 0).where((F.col("x") < F.col("y")) & room).select("x", "y").distinct()
    xs, ys = classes.select(F.col("rep").alias("x"), F.col("s").alias("xs")), classes.select(F.col("rep").alias("y"), F.col("s").alias("ys"))
    shared = F.size(F.array_intersect("xs", "ys"))
    sims = candidates.join(xs, "x").join(ys, "y").select("x", "y", (shared / (F.size("xs") + F.size("ys") - shared)).alias("sim"))
    pairs, found = scratch.save_measured(sims.where(F.col("sim") >= threshold - 1e-12), "pairs")
    alone = classes.where("copies = 1").select("rep", F.col("rep").alias("key"), "copies")
    several = classes.where("copies > 1").select("s", "rep", "copies")
    members = alone.unionByName(lookup_join(sets.select("s", "key"), several, "s", "inner").select("rep", "key", "copies"))
    return Similar(pairs, classes.select("rep", "copies"), members, found["n"])


def expanded(found: Similar) -> DataFrame:
    """(a, b, sim), a < b, of all keys in similar classes and of all members of one class."""
    one, two = found.members.select(F.col("rep").alias("x"), F.col("key").alias("a")), found.members.select(F.col("rep").alias("y"), F.col("key").alias("b"))
    across = blocked_join(blocked_join(found.pairs, one, "x", found.n_pairs), two, "y").select("a", "b", "sim")
    several = found.members.where("copies > 1")
    same = blocked_join(several.select(F.col("rep").alias("x"), F.col("key").alias("a")), several.select(F.col("rep").alias("x"), F.col("key").alias("b")), "x").where("a < b")
    return across.unionByName(same.select("a", "b", F.lit(1.0).alias("sim"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim")


def tanimoto_join(postings: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sim), a < b, of all keys whose sets have a Tanimoto similarity of at least ``threshold``, copies included."""
    return expanded(similar_classes(postings, threshold))


def neighbor_counts(found: Similar) -> DataFrame:
    """(key, n_neighbors) of the keys that have a neighbour, from classes: copies count as neighbours of each other."""
    both = found.pairs.select(F.inline(F.array(F.struct("x", F.col("y").alias("rep")), F.struct(F.col("y").alias("x"), F.col("x").alias("rep")))))
    beside = lookup_join(both, found.classes, "rep", "inner", rows=2 * found.n_pairs).groupBy(F.col("x").alias("rep")).agg(F.sum("copies").alias("n"))
    per_class = found.classes.join(beside, "rep", "left").select("rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_neighbors")).where("n_neighbors > 0")
    return lookup_join(found.members.select("rep", "key"), per_class, "rep", "inner").select("key", "n_neighbors")


def sali(similarity: Column, delta: Column) -> Column:
    """Structure-activity landscape index of a pair."""
    return delta / (1 - similarity + SALI_EPSILON)


def known_response(response: DataFrame) -> DataFrame:
    return response.where("p is not null and not isnan(p)").select("key", "p").dropDuplicates(["key"])


def cliffs(postings: DataFrame, response: DataFrame, similarity: float = CLIFF_SIMILARITY, delta: float = CLIFF_DELTA, clean: Callable[[Column], Column] | None = None) -> DataFrame:
    """(a, b, sim, pa, pb, delta, sali), a < b: pairs that are similar in structure and far apart in response.

    Members of a class get their response before classes are expanded, and only pairs far enough apart leave the join.
    """
    return cliffs_of(similar_classes(postings, similarity, clean), response, delta)


def cliffs_of(found: Similar, response: DataFrame, delta: float = CLIFF_DELTA) -> DataFrame:
    """As ``cliffs``, of classes that are found already."""
    told, n = Scratch(found.pairs.sparkSession, "cliffs").save_measured(found.members.join(known_response(response), "key").select("rep", "key", "p", "copies"), "told")
    one, two = told.select(F.col("rep").alias("x"), F.col("key").alias("a"), F.col("p").alias("pa")), told.select(F.col("rep").alias("y"), F.col("key").alias("b"), F.col("p").alias("pb"))
    apart = F.abs(F.col("pa") - F.col("pb"))
    across = blocked_join(blocked_join(found.pairs, one, "x", found.n_pairs), two, "y", max(found.n_pairs, n["n"])).where(apart >= delta).select("a", "b", "sim", "pa", "pb")
    several = told.where("copies > 1")
    same = blocked_join(several.select(F.col("rep").alias("x"), F.col("key").alias("a"), F.col("p").alias("pa")), several.select(F.col("rep").alias("x"), F.col("key").alias("b"), F.col("p").alias("pb")), "x", n["n"])
    same = same.where((F.col("a") < F.col("b")) & (apart >= delta)).select("a", "b", F.lit(1.0).alias("sim"), "pa", "pb")
    turned = F.col("a") > F.col("b")
    pick = lambda u, v: F.when(turned, F.col(v)).otherwise(F.col(u))
    return across.unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim", pick("pa", "pb").alias("pa"), pick("pb", "pa").alias("pb"), apart.alias("delta"), sali(F.col("sim"), apart).alias("sali"))


def blocked(queries: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with block numbers ``__b`` and ``__t``, such that every query meets every row under exactly one pair of numbers.

    ``queries``: q and more; ``rows``: key and more. What is shuffled is each row once per block of queries and each query once
    per block of rows, so blocks are large; a small table is cut further, into a few blocks per core, which repeats few queries.
    """
    n_q, n_r = queries.count(), rows.count()
    b, t = max(1, -(-n_q // QUERY_BLOCK)), max(1, -(-n_r // TABLE_BLOCK))
    t = max(t, min(-(-2 * queries.sparkSession.sparkContext.defaultParallelism // b), -(-n_r // 256)))
    left = queries.withColumn("__b", F.pmod(F.xxhash64("q"), F.lit(b))).withColumn("__t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(t - 1).cast("long"))))
    right = rows.withColumn("__t", F.pmod(F.xxhash64("key"), F.lit(t))).withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(b - 1).cast("long"))))
    return left, right


def against_all(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(q, key, sim, and what else both have) of every query with every other row, similar or not.

    For a stated set of queries: blocks of QUERY_BLOCK queries meet blocks of TABLE_BLOCK rows under an equi-join on the
    two block numbers, so no side is broadcast and no task sees more than one block of each. ``queries``: q, qtoks and
    more; ``rows``: key, toks and more; sets of numbers (``numbered_sets``) travel lighter than sets of texts. Two empty
    sets have similarity 0.
    """
    left, right = blocked(queries, rows)
    shared = F.size(F.array_intersect("qtoks", "toks"))
    met = left.join(right, ["__b", "__t"]).where("q <> key").withColumn("__o", shared)
    sim = F.coalesce(F.try_divide(F.col("__o").cast("double"), F.size("qtoks") + F.size("toks") - F.col("__o")), F.lit(0.0))
    return met.withColumn("sim", sim).drop("__b", "__t", "__o", "qtoks", "toks")


def ends(pairs: DataFrame) -> DataFrame:
    """Distinct keys at either end of a pair."""
    return pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(key, group_key): the smallest key of all that a key is linked to, directly or through others.

    Alternates star steps: every vertex tells its larger neighbours, then its smaller ones, of the
    smallest vertex it knows, until nothing moves. Every step is written, so none is computed twice.
    """
    scratch = Scratch(pairs.sparkSession, "components")
    edges, was = scratch.save_measured(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large, grown = scratch.save_measured(lookup_join(both, least, "u", "inner", rows=2 * was["n"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = lookup_join(large, low, "u", "inner", rows=grown["n"]).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        small, now = scratch.save_measured(small, "small")
        scratch.forget(large)
        if now["n"] == was["n"] and small.exceptAll(edges).isEmpty():
            break
        scratch.forget(edges)
        edges, was = small, now
    roots = edges.select(F.col("v").alias("key")).distinct()
    return edges.select(F.col("u").alias("key"), F.col("v").alias("group_key")).unionByName(roots.select("key", F.col("key").alias("group_key")))


def class_components(found: Similar) -> DataFrame:
    """(key, group_key) of every key with a neighbour: components of classes, handed to their members."""
    labels = components(found.pairs.select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("key", "rep")
    linked = found.classes.where("copies > 1").select("rep").join(labels, "rep", "left_anti").select("rep", F.col("rep").alias("group_key")).unionByName(labels)
    return lookup_join(found.members.select("rep", "key"), linked, "rep", "inner").select("key", "group_key")
