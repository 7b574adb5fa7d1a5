"""Texts packed into containers of fixed capacity by linear grouping.

Lengths are integers up to the capacity, so all that is decided at one place is
decided on histograms of at most ``capacity`` rows, whatever the number of texts:

1. Large lengths are cut into groups of equal cardinality and rounded up to the
   longest of their group; configurations of these few sizes are optimised, the
   fullest first, and used as often as the group sizes allow.
2. Every large text takes the slot that its rank in its group gives.
3. What the texts really leave over in each container is counted again, and the
   small lengths go best-fit, longest first, into the tightest space, in bulk.

Texts meet their places by rank: arithmetic on small arrays inside the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..skew import salted_rank
from ..store import Scratch

#: A length is large from this share of the capacity on.
LARGE_SHARE = 1 / 8
#: Groups of equal cardinality that large lengths are rounded up in.
GROUPS = 48


def fullest(sizes: np.ndarray, limits: np.ndarray, capacity: int) -> np.ndarray:
    """How often to take each size (up to its limit) so that the sum is as close to the capacity as possible."""
    reach = np.full(capacity + 1, -1, np.int64)  # index of the size last taken to reach a sum
    reach[0] = len(sizes)
    taken: list[np.ndarray] = []
    for i, (size, limit) in enumerate(zip(sizes, limits)):
        used = np.full(capacity + 1, -1, np.int64)
        used[reach >= 0] = 0
        for k in range(1, int(min(limit, capacity // size)) + 1):
            sums = np.flatnonzero(used[:-size] == k - 1) + size
            used[sums[used[sums] < 0]] = k
        reach[(used > 0) & (reach < 0)] = i
        taken.append(used)
    total = int(np.flatnonzero(reach >= 0)[-1])
    counts = np.zeros(len(sizes), np.int64)
    for i in range(len(sizes) - 1, -1, -1):
        counts[i] = taken[i][total]
        total -= int(counts[i] * sizes[i])
    return counts


def group_large(lengths: np.ndarray, counts: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(size of each group, its number of texts, texts per full group), longest first; lengths ascend."""
    n = int(counts.sum())
    per = max(1, -(-n // groups))
    tops = np.arange(0, n, per)
    ends = np.cumsum(counts[::-1])
    sizes = lengths[::-1][np.searchsorted(ends, tops, side="right")]
    return sizes, np.minimum(per, n - tops), per


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(times, how often each size) of the containers for the large texts."""
    demand, out = demand.copy(), []
    while demand.any():
        # Always place the longest left; fill up around it.
        lead = int(np.argmax(demand > 0))
        limits = demand.copy()
        limits[lead] -= 1
        counts = np.zeros(len(sizes), np.int64)
        room = capacity - int(sizes[lead])
        if room:
            open_ = np.flatnonzero((limits > 0) & (sizes <= room))
            if len(open_):
                counts[open_] = fullest(sizes[open_], limits[open_], room)
        counts[lead] += 1
        times = int((demand[counts > 0] // counts[counts > 0]).min())
        demand -= times * counts
        out.append((times, counts))
    return out


class LargePlan:
    """Where the k-th text of each group goes; arrays of at most groups x configurations rows."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, capacity: int, groups: int = GROUPS):
        self.first = np.zeros(capacity + 1, np.int64)  # texts longer than each length
        self.first[lengths] = (np.cumsum(counts[::-1]) - counts[::-1])[::-1]
        sizes, demand, self.per = group_large(lengths, counts, groups)
        self.containers = 0
        slots: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
        filled = np.zeros(len(sizes), np.int64)
        for times, taken in configurations(sizes, demand, capacity):
            for g in np.flatnonzero(taken):
                slots[g].append((int(filled[g]), self.containers, int(taken[g])))
                filled[g] += times * taken[g]
            self.containers += times
        self.slots = [np.array(s, np.int64).reshape(-1, 3) for s in slots]

    def place(self, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Container of the rank-th (from 0) text of a length."""
        overall = self.first[length] + rank
        group, at = overall // self.per, overall % self.per
        out = np.full(len(length), -1, np.int64)
        for g in np.unique(group):
            own = group == g
            table = self.slots[g]
            row = table[np.searchsorted(table[:, 0], at[own], side="right") - 1]
            out[own] = row[:, 1] + (at[own] - row[:, 0]) // row[:, 2]
        return out


class SmallPlan:
    """Best-fit of the small lengths, longest first, into spaces counted by size; runs of texts at a time."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, spaces: np.ndarray, capacity: int):
        """``spaces[r]`` containers have r tokens left; containers are numbered by r, then by rank."""
        self.offset = np.cumsum(spaces) - spaces
        runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        for r in np.flatnonzero(spaces):
            runs[r].append((int(self.offset[r]), int(spaces[r])))
        full = spaces.astype(bool)
        self.containers = int(spaces.sum())
        self.moves: dict[int, np.ndarray] = {}
        for length, n in sorted(zip(lengths.tolist(), counts.tolist()), reverse=True):
            moves, done = [], 0
            while done < n:
                tight = length + int(np.argmax(full[length:]))
                if not full[tight]:
                    fresh = -(-(n - done) // (capacity // length))
                    runs[capacity].append((self.containers, fresh))
                    full[capacity] = True
                    self.containers += fresh
                    continue
                start, size = runs[tight].pop()
                m = min(size, n - done)
                if m < size:
                    runs[tight].append((start + m, size - m))
                full[tight] = bool(runs[tight])
                moves.append((done, start))
                if tight > length:
                    runs[tight - length].append((start, m))
                    full[tight - length] = True
                done += m
            self.moves[length] = np.array(moves, np.int64)

    def place(self, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = np.full(len(length), -1, np.int64)
        for size in np.unique(length):
            own = length == size
            moves = self.moves[int(size)]
            row = moves[np.searchsorted(moves[:, 0], rank[own], side="right") - 1]
            out[own] = row[:, 1] + rank[own] - row[:, 0]
        return out


def _histogram(rows: list, column: str, size: int) -> np.ndarray:
    out = np.zeros(size + 1, np.int64)
    for row in rows:
        out[row[column]] = row["n"]
    return out


def pack(sizes: DataFrame, budgets: DataFrame, key: str = "doc_id", large_share: float = LARGE_SHARE, groups: int = GROUPS) -> DataFrame:
    """(budget_name, key, piece_no, start_token, n_tokens, container_no) of every text under every budget.

    ``sizes`` has one row (key, n_tokens) per text; sizes of 0 or null give no row. A text longer than the
    capacity is cut into full pieces and a rest, all others stay whole. Container numbers count from 0 in
    each budget. ``budgets`` is a small table of named capacities; budgets without a capacity of at
    least 1 are left out. Equal lengths are told apart by a rank over the key.
    """
    spark = sizes.sparkSession
    scratch = Scratch(spark, "pack")
    capacities = {r.budget_name: int(r.capacity_tokens) for r in budgets.where("capacity_tokens >= 1 and budget_name is not null").groupBy("budget_name").agg(F.max("capacity_tokens").alias("capacity_tokens")).collect()}
    schema = f"budget_name string, `{key}` {sizes.schema[key].dataType.simpleString()}, piece_no int, start_token long, n_tokens long, container_no long"
    if not capacities:
        return spark.createDataFrame([], schema)
    named = F.broadcast(spark.createDataFrame(list(capacities.items()), "budget_name string, capacity long"))
    last = F.expr("(n_tokens - 1) div capacity")
    pieces = (
        sizes.where(f"n_tokens > 0 and `{key}` is not null")
        .crossJoin(named)  # a few budgets, each of which takes every text
        .select("budget_name", key, "capacity", "n_tokens", F.posexplode(F.sequence(F.lit(0).cast("long"), last)).alias("piece_no", "p"))
        .select("budget_name", key, "piece_no", (F.col("p") * F.col("capacity")).alias("start_token"), F.least("capacity", F.col("n_tokens") - F.col("p") * F.col("capacity")).alias("n_tokens"))
    )
    pieces, laid = scratch.save_measured(pieces, "pieces")  # the tokenizer runs once, here
    ranked = scratch.save(salted_rank(pieces, ["budget_name", "n_tokens"], [F.col(key), F.col("piece_no")], "rank", id_cols=[key, "piece_no"], rows=laid["n"]), "ranked")
    scratch.forget(pieces)
    counted = ranked.groupBy("budget_name", "n_tokens").agg(F.count("*").alias("n")).collect()  # at most the sum of the capacities
    counts = {b: _histogram([r for r in counted if r.budget_name == b], "n_tokens", c) for b, c in capacities.items()}

    def is_large(b: str, c: int) -> np.ndarray:
        lengths = np.arange(c + 1)
        return (lengths >= max(2, c * large_share)) & (lengths < c)

    large: dict[str, LargePlan] = {}
    for b, c in capacities.items():
        lengths = np.flatnonzero(is_large(b, c) & (counts[b] > 0))
        if len(lengths):
            large[b] = LargePlan(lengths, counts[b][lengths], c, groups)
    edges = {b: max(2, c * large_share) for b, c in capacities.items()}
    limit = F.broadcast(spark.createDataFrame([(b, float(edges[b]), c) for b, c in capacities.items()], "budget_name string, edge double, capacity long"))
    split = ranked.join(limit, "budget_name")
    big = split.where("n_tokens >= edge and n_tokens < capacity").drop("edge")
    small = split.where("n_tokens < edge or n_tokens = capacity").drop("edge", "capacity")

    def placed(plans: dict, name: str):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = np.full(len(frame), -1, np.int64)
                for b in frame["budget_name"].unique():
                    own = (frame["budget_name"] == b).to_numpy()
                    out[own] = plans[b].place(frame["n_tokens"].to_numpy()[own], frame["rank"].to_numpy()[own] - 1)
                yield frame.assign(**{name: out})

        return run

    schema_of = lambda df, extra: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", {extra} long"
    big = scratch.save(big.mapInPandas(placed(large, "box"), schema_of(big, "box")), "big")
    left = big.groupBy("budget_name", "capacity", "box").agg(F.sum("n_tokens").alias("full")).select("budget_name", "box", (F.col("capacity") - F.col("full")).alias("space"))
    boxes = scratch.save(salted_rank(left, ["budget_name", "space"], [F.col("box")], "space_rank", id_cols=["box"]), "boxes")
    spaced = boxes.groupBy("budget_name", "space").agg(F.count("*").alias("n")).collect()  # at most the sum of the capacities
    fits: dict[str, SmallPlan] = {}
    for b, c in capacities.items():
        lengths = np.flatnonzero(~is_large(b, c) & (counts[b] > 0))
        fits[b] = SmallPlan(lengths, counts[b][lengths], _histogram([r for r in spaced if r.budget_name == b], "space", c), c)
    starts = spark.createDataFrame([(b, int(r), int(fits[b].offset[r])) for b in capacities for r in np.unique([x.space for x in spaced if x.budget_name == b])] or [("", 0, 0)], "budget_name string, space long, start long")
    numbered = boxes.join(F.broadcast(starts), ["budget_name", "space"]).select("budget_name", "box", (F.col("start") + F.col("space_rank") - 1).alias("container_no"))
    out = ["budget_name", key, "piece_no", "start_token", "n_tokens", "container_no"]
    return big.join(numbered, ["budget_name", "box"]).select(*out).unionByName(small.mapInPandas(placed(fits, "container_no"), schema_of(small, "container_no")).select(*out))


def fill_report(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per budget: texts, containers, tokens, the least possible number of containers and the share of space used."""
    boxes = packed.groupBy("budget_name", "container_no").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("pieces"))
    total = boxes.groupBy("budget_name").agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return total.join(F.broadcast(budgets), "budget_name").select(
        "budget_name", "capacity_tokens", "pieces", "containers", "tokens", "fullest", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"), (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill")
    )
