"""Sphere-exclusion clusters of a similarity graph, equal to the sequential greedy ones, and votes of neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..skew import lookup_join
from ..store import Scratch
from .similarity import Similar, blocked

#: A token that more than one in HOT rows of a block have is hot, at most MOST_HOT of them; the choice decides the work, not the result.
HOT, MOST_HOT = 20, 6
#: Shared tokens that are counted at a time.
STEP = 1_000_000


def butina(found: Similar) -> DataFrame:
    """(key, centroid): Taylor-Butina groups of the keys (bigint) that have a neighbour.

    The greedy rule takes keys by number of neighbours (ties: the smaller key) and gives each its
    neighbours that are still free. Members of a class share all neighbours and are neighbours of each other, so the
    class goes as one. A class is a centroid exactly if no free neighbour comes before it, so every round finds all such
    at once, and each other belongs to the first of the centroids beside it. An empty table gives no rows.
    The rounds are as many as the longest chain of falling neighbour counts, not as the clusters.
    """
    scratch = Scratch(found.pairs.sparkSession, "butina")
    sizes = found.classes.toDF("o", "copies")
    both, met = scratch.save_measured(found.pairs.where("x <> y").select(F.inline(F.array(F.struct(F.col("x").alias("k"), F.col("y").alias("o")), F.struct(F.col("y").alias("k"), F.col("x").alias("o"))))).distinct(), "both")
    beside = lookup_join(both, sizes, "o", "inner", rows=met["n"]).groupBy("k").agg(F.sum("copies").alias("n"))
    counted = beside.join(sizes.toDF("k", "copies"), "k").select("k", F.struct((F.col("n") + F.col("copies") - 1).alias("n"), (-F.col("k")).alias("x")).alias("pk"))
    order = scratch.save(counted, "order")
    edges = lookup_join(lookup_join(both, order, "k", "inner", rows=met["n"]), order.toDF("o", "po"), "o", "inner", rows=met["n"])
    edges = scratch.save(edges.select("k", "pk", "o", "po"), "edges")
    live, left, chosen = edges, met["n"], []
    while left:
        centres = scratch.save(live.groupBy("k").agg(F.max("pk").alias("pk"), F.max("po").alias("best")).where("pk > best").select("k"), "centres")
        chosen.append(centres)
        covered = live.join(centres, "k", "left_semi").select(F.col("o").alias("k")).distinct()
        gone = scratch.save(centres.unionByName(covered), "gone")
        rest, seen = scratch.save_measured(live.join(gone, "k", "left_anti").join(gone.toDF("o"), "o", "left_anti").select("k", "pk", "o", "po"), "live")
        scratch.forget(gone, *([live] if live is not edges else []))
        live, left = rest, seen["n"]
    alone = found.classes.where("copies > 1").select(F.col("rep").alias("k")).join(order, "k", "left_anti")
    if not chosen:
        centroids = alone.select(F.col("k").alias("rep"), F.col("k").alias("centroid"))
    else:
        all_centres = chosen[0]
        for more in chosen[1:]:
            all_centres = all_centres.unionByName(more)
        joined = edges.join(all_centres.toDF("o"), "o", "left_semi").groupBy("k").agg(F.max_by("o", "po").alias("first"))
        # A key without a centroid beside it is one itself.
        named = order.select("k").unionByName(alone).join(joined, "k", "left").select(F.col("k").alias("rep"), F.coalesce("first", "k").alias("centroid"))
        centroids = named
    return lookup_join(found.members.select("rep", "key"), centroids, "rep", "inner").select("key", "centroid")


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, length of each row, token) of a column of sets."""
    sets = column.combine_chunks()
    sizes = sets.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(sets)), sizes), sizes, sets.flatten()


def _shared(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start .. start + length - 1, one range after the other."""
    before = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return np.repeat(starts - before, lengths) + np.arange(lengths.sum())


def _best(q: np.ndarray, row: np.ndarray, sim: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` first pairs of each ``q`` by falling similarity, then by key."""
    order = np.lexsort((keys[row], -sim, q))
    sorted_q = q[order]
    first = np.concatenate([[True], sorted_q[1:] != sorted_q[:-1]]) if len(order) else np.zeros(0, bool)
    return order[np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) < k]


def nearest_in_block(qkeys: np.ndarray, qsets: pa.ChunkedArray, keys: np.ndarray, sets: pa.ChunkedArray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, row, similarity), by position, of the ``k`` nearest rows of each query (ties: smaller key), in batches.

    Pairs that share a token that is not hot are counted over inverted lists. Of all others the similarity follows from
    which hot tokens a row has and from its size, and so is no more than that of the pair itself: of each such kind of query
    the ``k + 1`` first rows by this are enough, one of which may be the query.
    """
    n_q, n_r = len(qkeys), len(keys)
    if not n_q or not n_r:
        return
    (qrow, n, qtok), (row, m, tok) = _flat(qsets), _flat(sets)
    codes = pa.concat_arrays([qtok, tok]).dictionary_encode()
    at = codes.indices.to_numpy(zero_copy_only=False)
    qtok, tok, words = at[: len(qrow)], at[len(qrow) :], max(1, len(codes.dictionary))
    uses = np.bincount(tok, minlength=words)
    hot = [t for t in np.argsort(-uses, kind="stable")[:MOST_HOT] if uses[t] * HOT > n_r]
    qkind, kind, cold = np.zeros(n_q, np.int64), np.zeros(n_r, np.int64), np.ones(words, bool)
    for i, t in enumerate(hot):
        qkind[qrow[qtok == t]] |= 1 << i
        kind[row[tok == t]] |= 1 << i
        cold[t] = False
    ones = np.array([bin(x).count("1") for x in range(1 << len(hot))])

    def alike(shared: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        united = one + two - shared
        return np.where(united > 0, shared / np.maximum(united, 1), 0.0)

    # Of rows of one kind and size the smallest keys come first.
    order = np.lexsort((keys, m, kind))
    change = np.concatenate([[True], (kind[order][1:] != kind[order][:-1]) | (m[order][1:] != m[order][:-1])])
    head = order[np.arange(n_r) - np.maximum.accumulate(np.where(change, np.arange(n_r), 0)) <= k]
    kinds, which = np.unique(np.stack([qkind, n]), axis=1, return_inverse=True)
    which = which.reshape(-1)
    firsts = np.empty((kinds.shape[1], min(k + 1, len(head))), np.int64)
    least = np.full(kinds.shape[1], -1.0)
    for i, (of, size) in enumerate(kinds.T):
        sim = alike(ones[of & kind[head]], size, m[head])
        chosen = np.lexsort((keys[head], -sim))[: k + 1]
        firsts[i] = head[chosen]
        if len(chosen) > k:  # one of them may be the query
            least[i] = sim[chosen[k]]

    keep, qkeep = cold[tok], cold[qtok]
    by_token = np.argsort(tok[keep], kind="stable")
    listed = row[keep][by_token]
    begins = np.concatenate([[0], np.cumsum(np.bincount(tok[keep], minlength=words))])
    qrow, qtok = qrow[qkeep], qtok[qkeep]
    lengths = begins[qtok + 1] - begins[qtok]
    work = np.bincount(qrow, weights=lengths, minlength=n_q) + firsts.shape[1]
    turn = (np.cumsum(work) // STEP).astype(np.int64)
    bounds = np.concatenate([[0], np.flatnonzero(turn[1:] != turn[:-1]) + 1, [n_q]])
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        a, b = np.searchsorted(qrow, (lo, hi))
        pairs = np.repeat(qrow[a:b], lengths[a:b]) * n_r + listed[_shared(begins[qtok[a:b]], lengths[a:b])]
        also = (np.arange(lo, hi)[:, None] * n_r + firsts[which[lo:hi]]).reshape(-1)
        met, times = np.unique(np.concatenate([pairs, also]), return_counts=True)
        times[np.searchsorted(met, also)] -= 1
        q, r = met // n_r, met % n_r
        sim = alike(times + ones[qkind[q] & kind[r]], n[q], m[r])
        near = np.flatnonzero((sim >= least[which[q]]) & (qkeys[q] != keys[r]))
        q, r, sim = q[near], r[near], sim[near]
        best = _best(q, r, sim, keys, k)
        yield q[best], r[best], sim[best]


def nearest_votes(queries: DataFrame, labelled: DataFrame, k: int = 15) -> DataFrame:
    """(key, y, p, n_votes): the mean label of the ``k`` most similar labelled rows (ties: smaller key), whatever their similarity.

    ``queries``: key (bigint), y (may be null), toks; ``labelled``: key, y, toks; sets without repeats or nulls. A query is no
    neighbour of itself. Exact: each query is compared with all rows, block by block (``nearest_in_block``), and of every block
    only its best ``k`` travel on.
    """
    known = labelled.where("y is not null").select("key", F.col("y").alias("vote"), "toks")
    left, right = blocked(queries.select(F.col("key").alias("q"), "y", F.col("toks").alias("qtoks")), known)

    def nearest(asked: pa.Table, told: pa.Table) -> pa.Table:
        keys = [t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for t, c in ((asked, "q"), (told, "key"))]
        found = list(nearest_in_block(keys[0], asked.column("qtoks"), keys[1], told.column("toks"), k))
        q, r, sim = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        asked, told = asked.select(["q", "y"]).take(pa.array(q)), told.select(["key", "vote"]).take(pa.array(r))
        return pa.table([*asked.columns, *told.columns, pa.array(sim, pa.float64())], names=["q", "y", "key", "vote", "sim"])

    kinds = [f"{n} {t.schema[c].dataType.simpleString()}" for n, t, c in (("q", left, "q"), ("y", left, "y"), ("key", right, "key"), ("vote", right, "vote"))]
    met = left.groupBy("__b", "__t").cogroup(right.groupBy("__b", "__t")).applyInArrow(nearest, ", ".join([*kinds, "sim double"]))
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.col("sim").desc(), "key"))
    votes = met.withColumn("rank", rank).where(F.col("rank") <= k).groupBy("q").agg(F.first("y").alias("y"), F.avg("vote").alias("p"), F.count("*").alias("n_votes"))
    return votes.select(F.col("q").alias("key"), "y", "p", "n_votes")
