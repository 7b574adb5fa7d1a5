"""Forests and boosted trees of rows that have or lack each of many features, by counting what is present.

MLlib's trees hold a number for every feature of every row; here a row is the features it has. The rules are
MLlib's: Gini impurity and Poisson bags with the square root of the features drawn for every node, variance
and the log loss for boosting, splits while something is gained, and leaves merged that predict the same.
All random choices are hashes of keys and numbers of trees and nodes, so they do not depend on how rows lie.

Rows that a task can hold (BLOCK_ROWS, BLOCK_ENTRIES, or ``scarp.chunkRows`` if it is set) are one block, others are packed
into blocks of ``scarp.chunkRows``. With one block, tasks grow whole trees and fit whole linear models; with more, each level of all trees is one job in
which every block counts for itself and the counts are added up. What reaches the driver is models of trees.

A node is a slot: the rows without the feature of its split keep the slot, those with it get a new one.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.serializers import CloudPickleSerializer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..skew import CHUNK_ROWS, _setting, salted_rank
from ..store import Scratch
from .linear import probabilities
from .metrics import _POISSON

#: Parts that the trees are dealt to, for each core.
DEALS = 4
#: Rows of an only block and features that they have in all, at most: a task takes some 50 bytes for each.
BLOCK_ROWS, BLOCK_ENTRIES = 1_000_000, 8_000_000
#: Bytes of an only block that travel in one row.
PIECE = 1 << 20
#: Rows of the features drawn for the nodes of a tree that a task keeps for the other models' trees of that number.
KEPT_ENTRIES = 4_000_000
#: Scores that travel in one row.
TOLD = 8192
#: As MLlib's: nodes below this impurity are not split.
PURE = 2.220446049250313e-16


@dataclass(frozen=True)
class Plan:
    """Trees to grow of one model: ``step`` is None for a forest, ``weights`` are those of the labels."""

    turn: int
    kind: str
    size: int
    trees: int
    depth: int
    weights: tuple[float, float] = (1.0, 1.0)
    step: float | None = None
    seed: int = 0


class Block:
    """Rows, and for each feature the rows that have it."""

    def __init__(self, blob: bytes):
        self.key, self.y, train, test, counts, features = pickle.loads(blob)
        self.train, self.test = (marks if marks.dtype == bool else np.unpackbits(marks, axis=1, count=len(self.key)).view(bool) for marks in (train, test))
        self.row = np.repeat(np.arange(len(self.key), dtype=np.int32), counts)
        uses = np.bincount(features)
        self.features = np.flatnonzero(uses)
        self.at = (np.cumsum(uses > 0, dtype=np.int32) - 1)[features]
        self.start = np.append(0, np.cumsum(uses[self.features]))

    @cached_property
    def rows(self) -> np.ndarray:
        """The rows of each feature, from its ``start`` on."""
        return self.row[np.argsort(self.at, kind="stable")]

    def having(self, feature: int) -> np.ndarray:
        i = np.searchsorted(self.features, feature)
        return self.rows[self.start[i] : self.start[i + 1]] if i < len(self.features) and self.features[i] == feature else self.rows[:0]

    def route(self, slots: np.ndarray, splits) -> None:
        for slot, feature, new in splits:
            rows = self.having(feature)
            slots[rows[slots[rows] == slot]] = new


def bag(key: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row counts in a tree: Poisson(1) numbers from a hash (splitmix64) of its key."""
    with np.errstate(over="ignore"):
        x = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + tree + 1) * 0xD1B54A32D192ED03 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return np.searchsorted(_POISSON, (x >> np.uint64(11)) * 2.0**-53, side="right")


def drawn(plan: Plan, tree: int, slot: int, level: int) -> np.ndarray:
    """The features that a node may split on, in order."""
    k = math.ceil(math.sqrt(plan.size)) if plan.trees > 1 else plan.size
    return np.sort(np.random.default_rng([plan.seed, tree, slot, level]).choice(plan.size, k, replace=False)) if k < plan.size else np.arange(plan.size)


class Tree:
    """``stats`` of a slot: labels 0 and 1 in the bag, or count, sum and sum of squares of the targets."""

    def __init__(self, plan: Plan, total: np.ndarray):
        self.plan, self.stats, self.splits, self.level = plan, [total], [], 0
        self.active = [0] if self.weight(total) > 0 else []

    def weight(self, stats: np.ndarray) -> np.ndarray:
        return stats @ np.array(self.plan.weights) if self.plan.step is None else stats[..., 0]

    def impurity(self, stats: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            if self.plan.step is None:
                share = stats * np.array(self.plan.weights) / self.weight(stats)[..., None]
                return 1.0 - share[..., 0] ** 2 - share[..., 1] ** 2
            return (stats[..., 2] - stats[..., 1] ** 2 / stats[..., 0]) / stats[..., 0]

    def value(self, stats: np.ndarray) -> float:
        """NaN for a tree whose bag is empty."""
        weight = float(self.weight(stats))
        return float(stats[1] * (self.plan.weights[1] if self.plan.step is None else 1.0)) / weight if weight > 0 else math.nan

    def told(self, stats: np.ndarray) -> float:
        """What MLlib calls the prediction of a node."""
        return self.value(stats) if self.plan.step is not None else float(stats[1] * self.plan.weights[1] > stats[0] * self.plan.weights[0])

    def best(self, slot: int, features: np.ndarray, present: np.ndarray) -> tuple[int, np.ndarray] | None:
        """The first feature with the largest gain, and the stats of the rows that have it."""
        whole = self.stats[slot]
        absent = whole - present
        held = (lambda s: s.sum(-1)) if self.plan.step is None else (lambda s: s[:, 0])
        keep = (held(present) > 0) & (held(absent) > 0)
        if not keep.any():
            return None
        features, present, absent = features[keep], present[keep], absent[keep]
        w = self.weight(whole)
        gain = self.impurity(whole) - self.weight(absent) / w * self.impurity(absent) - self.weight(present) / w * self.impurity(present)
        i = int(gain.argmax())
        return (int(features[i]), present[i]) if gain[i] > 0 else None

    def grow(self, found: dict[int, tuple[int, np.ndarray] | None]) -> list[tuple[int, int, int]]:
        """Splits the active slots as found; the new splits."""
        begun, after = len(self.splits), []
        for slot in self.active:
            if found.get(slot):
                feature, present = found[slot]
                new = len(self.stats)
                self.splits.append((slot, feature, new))
                self.stats[slot] = self.stats[slot] - present
                self.stats.append(present)
                after += [s for s in (slot, new) if abs(self.impurity(self.stats[s])) >= PURE]
        self.level += 1
        self.active = after if self.level < self.plan.depth else []
        return self.splits[begun:]

    def finished(self) -> tuple[np.ndarray, np.ndarray]:
        """(splits, value of each slot), without splits into two leaves that predict the same."""
        leaf, inner, kept = list(self.stats), set(), []
        for slot, feature, new in reversed(self.splits):
            if slot not in inner and new not in inner and self.told(leaf[slot]) == self.told(leaf[new]):
                leaf[slot] = leaf[slot] + leaf[new]
            else:
                inner.add(slot)
                kept.append((slot, feature, new))
        return np.array(kept[::-1], np.int32).reshape(-1, 3), np.array([self.value(s) for s in leaf])


class Work:
    """One block's part in growing one tree; ``before``: the finished trees that it is boosted on.

    ``kept`` is shared by the trees of one number in all models, which have the same bags and drawn features.
    """

    def __init__(self, block: Block, plan: Plan, tree: int, before=(), kept: dict | None = None):
        self.block, self.plan, self.tree, self.kept = block, plan, tree, {} if kept is None else kept
        self.slots = np.zeros(len(block.key), np.int32)
        train = block.train[plan.turn]
        if plan.step is None:
            if plan.trees > 1 and (at := ("bag", plan.seed, tree)) not in self.kept:
                self.kept[at] = bag(block.key, plan.seed, tree)
            times = train * (self.kept[at] if plan.trees > 1 else 1.0)
            self.columns = [times * (block.y == 0), times * (block.y == 1)]
        else:
            sign = 2.0 * (block.y == 1) - 1.0
            target = 4.0 * sign / (1.0 + np.exp(2.0 * sign * margin(block, plan, before))) if before else sign
            self.columns = [train * 1.0, train * target, train * target * target]

    def total(self) -> np.ndarray:
        return np.array([c.sum() for c in self.columns])

    def counts(self, active: list[int], level: int):
        """For each active slot: features and the stats of its rows that have them."""
        b = self.block
        if self.plan.step is not None:  # every feature counts
            place = np.full(max([*active, int(self.slots.max(initial=0))]) + 1, -1)
            place[active] = np.arange(len(active))
            at = np.where(b.train[self.plan.turn], place[self.slots], -1)[b.row]
            use = at >= 0
            n, rows = len(b.features), b.row[use]
            cell = at[use] * n + b.at[use]
            sums = np.stack([np.bincount(cell, c[rows], len(active) * n) for c in self.columns], -1).reshape(len(active), n, -1)
            for one in sums:
                seen = one[:, 0] > 0
                yield b.features[seen], one[seen]
            return
        for slot in active:
            i, rows, cell = self.drawn(slot, level)
            use = self.slots[rows] == slot
            rows, cell = rows[use], cell[use]
            yield b.features[i], np.stack([np.bincount(cell, c[rows], len(i)) for c in self.columns], -1)

    def drawn(self, slot: int, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places of the features drawn for a node, the rows that have them, and for each of these the feature's number among them."""
        b, p = self.block, self.plan
        at = (p.seed, self.tree, p.size, p.trees > 1, slot, level)
        if at in self.kept:
            return self.kept[at]
        wanted = drawn(p, self.tree, slot, level)
        i = np.searchsorted(b.features, wanted)
        i = i[(b.features[np.minimum(i, len(b.features) - 1)] == wanted) & (i < len(b.features))] if len(b.features) else i[:0]
        length = b.start[i + 1] - b.start[i]
        ends = np.cumsum(length)
        rows = b.rows[np.arange(ends[-1] if len(i) else 0) + np.repeat(b.start[i] - ends + length, length)]
        found = i, rows, np.repeat(np.arange(len(i)), length)
        if self.kept.get("entries", 0) + len(rows) <= KEPT_ENTRIES:
            self.kept["entries"] = self.kept.get("entries", 0) + len(rows)
            self.kept[at] = found
        return found


def margin(block: Block, plan: Plan, trees) -> np.ndarray:
    """Each tree's value for each row: boosted trees by their steps, those of a forest by their mean; empty bags have no vote."""
    out, voters = np.zeros(len(block.key)), 0
    for at, (splits, values) in enumerate(trees):
        if math.isnan(values[0]):
            continue
        slots = np.zeros(len(block.key), np.int32)
        block.route(slots, splits.tolist())
        out += (plan.step if plan.step is not None and at else 1.0) * values[slots]
        voters += 1
    return out / max(1, voters) if plan.step is None else out


def grown(block: Block, plan: Plan, number: int, before=(), kept: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A tree of the rows of one block."""
    work = Work(block, plan, number, before, kept)
    tree = Tree(plan, work.total())
    while tree.active:
        found = {slot: tree.best(slot, *counts) for slot, counts in zip(tree.active, work.counts(tree.active, tree.level))}
        block.route(work.slots, tree.grow(found))
    return tree.finished()


def packed(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """((block, blob), blocks) of rows with key, y, indices, train, test; the last two are arrays with an entry a split."""
    seen = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("indices")), F.lit(0)).alias("entries")).first()
    spark, alone = rows.sparkSession, seen["entries"] <= BLOCK_ENTRIES and seen["n"] <= _setting(rows.sparkSession, "scarp.chunkRows", BLOCK_ROWS)
    chunk = max(1, seen["n"]) if alone else _setting(spark, "scarp.chunkRows", CHUNK_ROWS)
    blocks = max(1, math.ceil(seen["n"] / chunk))
    slim = rows.select("key", "y", "indices", "train", "test")
    if blocks > 1:
        placed = salted_rank(slim, [], [F.col("key")], "__rn", ["key"], seen["n"]).withColumn("block", ((F.col("__rn") - 1) / chunk).cast("int")).drop("__rn")
    else:
        placed = slim.withColumn("block", F.lit(0))

    def pack(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        column = {c: pa.concat_arrays(table[c].chunks) for c in table.column_names}
        key = column["key"].to_numpy()
        order = np.argsort(key, kind="stable")
        marks = [np.packbits(column[c].flatten().to_numpy(zero_copy_only=False).astype(bool).reshape(len(key), -1)[order].T, axis=1) for c in ("train", "test")]
        y = pc.fill_null(column["y"], -1).to_numpy()[order].astype(np.int8)
        counts = pc.list_value_length(column["indices"]).to_numpy().astype(np.int64)
        begins, counts = (np.cumsum(counts) - counts)[order], counts[order]
        ends = np.cumsum(counts)
        features = column["indices"].flatten().to_numpy()[np.arange(ends[-1]) + np.repeat(begins - ends + counts, counts)]
        blob = pickle.dumps((key[order], y, *marks, counts.astype(np.int32), features), 5)
        pieces = [blob[i : i + PIECE] for i in range(0, len(blob), PIECE)] if blocks == 1 else [blob]
        return pa.table({"block": pa.array([column["block"][0].as_py()] * len(pieces), pa.int32()), "piece": pa.array(range(len(pieces)), pa.int32()), "blob": pa.array(pieces, pa.binary())})

    return scratch.save(placed.groupBy("block").applyInArrow(pack, "block int, piece int, blob binary"), "blocks"), blocks


class Blocks:
    """Jobs over all blocks, each with the work dealt to parts."""

    def __init__(self, table: DataFrame, n: int):
        self.spark, self.n = table.sparkSession, n
        self.sc = self.spark.sparkContext
        self.rdd = (table.coalesce(1) if n == 1 else table).select("block", "piece", "blob").rdd  # all pieces of an only block meet
        self.width = self.rdd.getNumPartitions()

    def each(self, jobs: list, do):
        """An RDD of what ``do(number of the block, block, job)`` yields; every block meets every job."""
        parts = max(1, min(len(jobs), DEALS * self.sc.defaultParallelism))
        width, shared, alone = self.width, _shared(self.sc, jobs), self.n == 1

        def run(index, found):
            mine = pickle.loads(shared.value)[index // width :: parts]
            for number, blob in _only(found) if alone else ((r.block, bytes(r.blob)) for r in found):
                block = Block(blob)
                del blob
                for job in mine:
                    yield from do(number, block, job)

        return self.sc.union([self.rdd] * parts).mapPartitionsWithIndex(run)

    def forest_level(self, trees: dict, before: dict) -> dict:
        """{(model, tree): {slot: best split}} of the active slots, from counts that are added up over the blocks in their order."""
        jobs = [(name, t.plan, t.active, t.splits, t.level, before.get(name[0], ())) for name, t in trees.items()]

        def count(number, block, job):
            name, plan, active, splits, level, earlier = job
            work = Work(block, plan, name[1], earlier)
            block.route(work.slots, splits)
            for slot, (features, stats) in zip(active, work.counts(active, level)):
                if len(features):
                    yield (name, slot), (number, features, stats)

        known = _shared(self.sc, {name: (t.plan, {s: t.stats[s] for s in t.active}) for name, t in trees.items()})

        def choose(found):
            plans, held = pickle.loads(known.value), {}
            for at, part in found:
                held.setdefault(at, []).append(part)
            for (name, slot), parts in held.items():
                parts.sort(key=lambda p: p[0])
                features, i = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
                stats = np.concatenate([p[2] for p in parts])
                plan, whole = plans[name]
                tree = Tree(plan, whole[slot])
                best = tree.best(0, features, np.stack([np.bincount(i, c, len(features)) for c in stats.T], -1))
                if best:
                    yield name, slot, best

        out: dict = {}
        n = max(1, self.sc.defaultParallelism * DEALS)
        for name, slot, best in self.each(jobs, count).partitionBy(n, _spread).mapPartitions(choose).collect():
            out.setdefault(name, {})[slot] = best
        return out

    def together(self, plans: dict, numbers: list, before: dict) -> dict:
        """{(model, tree): finished tree}, level by level."""
        names = [(m, k) for m in plans for k in numbers if k < plans[m].trees]
        totals: dict = {}
        sums = self.each([(n, plans[n[0]], before.get(n[0], ())) for n in names], lambda at, block, job: [(job[0], at, Work(block, job[1], job[0][1], job[2]).total())])
        for name, _, total in sorted(sums.collect(), key=lambda x: x[:2]):
            totals[name] = totals.get(name, 0.0) + total
        trees = {name: Tree(plans[name[0]], totals[name]) for name in names}
        while open_ := {name: t for name, t in trees.items() if t.active}:
            found = self.forest_level(open_, before)
            for name, tree in open_.items():
                tree.grow(found.get(name, {}))
        return {name: t.finished() for name, t in trees.items()}

    def fitted(self, plans: list[Plan]) -> list[list]:
        """The trees of each model."""
        by = dict(enumerate(plans))
        forests, boosted = {m: p for m, p in by.items() if p.step is None}, {m: p for m, p in by.items() if p.step is not None}
        out: dict = {m: {} for m in by}
        if self.n == 1:

            def whole(_, block, job):
                m, plan, number = job
                if number is not None:
                    kept: dict = {}
                    for at, one in plan:
                        if number < one.trees:
                            yield at, number, grown(block, one, number, (), kept)
                    return
                done: list = []
                for k in range(plan.trees):
                    done.append(grown(block, plan, k, done))
                    yield m, k, done[-1]

            jobs = [(m, p, None) for m, p in boosted.items()] + [(None, list(forests.items()), k) for k in range(max([p.trees for p in forests.values()], default=0))]
            for m, k, tree in self.each(jobs, whole).collect():
                out[m][k] = tree
        else:
            rounds = [(forests, list(range(max([p.trees for p in forests.values()], default=0))))] + [(boosted, [k]) for k in range(max([p.trees for p in boosted.values()], default=0))]
            for some, numbers in rounds:
                earlier = {m: [out[m][k] for k in sorted(out[m])] for m in boosted}
                for (m, k), tree in (self.together(some, numbers, earlier) if some and numbers else {}).items():
                    out[m][k] = tree
        return [[out[m][k] for k in sorted(out[m])] for m in by]

    def scored(self, plans: list[Plan], trees: list[list]) -> DataFrame:
        """(repeat, model, key, y, p) of each model's test rows."""

        def score(_, block, job):
            plan, own = job
            at = np.flatnonzero(block.test[plan.turn])
            p = margin(block, plan, own)[at]
            yield from told(block, plan, at, 1.0 / (1.0 + np.exp(-2.0 * p)) if plan.step is not None else p)

        return self._told(self.each(list(zip(plans, trees)), score))

    def linear(self, plans: list) -> DataFrame:
        """As ``scored``, of linear models (``linear.Plan``) that one task each fits to the rows of the only block."""
        assert self.n == 1, "a linear model is fitted to one block"

        def score(_, block, plan):
            at = np.flatnonzero(block.test[plan.turn])
            yield from told(block, plan, at, probabilities(block, plan)[at])

        return self._told(self.each(plans, score))

    def _told(self, rows) -> DataFrame:
        packed = self.spark.createDataFrame(rows, "repeat int, model string, key array<long>, y array<int>, p array<double>", verifySchema=False)
        return packed.select("repeat", "model", F.inline(F.arrays_zip("key", "y", "p")))


def told(block: Block, plan, at: np.ndarray, p: np.ndarray):
    """The scores ``p`` of the rows ``at``, TOLD of them in a row."""
    key, y = block.key[at], block.y[at]
    for i in range(0, len(at), TOLD):
        part = slice(i, i + TOLD)
        yield plan.turn, plan.kind, key[part].tolist(), [v if v in (0, 1) else None for v in y[part].tolist()], p[part].tolist()


def _only(found):
    """(number, blob) of the only block, from its pieces."""
    pieces = sorted((r.piece, bytes(r.blob)) for r in found)
    if pieces:
        yield 0, b"".join(p[1] for p in pieces)


def _shared(sc, value):
    """A broadcast that workers without this package can read, as they can read functions."""
    return sc.broadcast(CloudPickleSerializer().dumps(value))


def _spread(at) -> int:
    """The same in every worker, as hashes of numbers are."""
    (model, tree), slot = at
    return (model * 1_000_003 + tree) * 1_009 + slot
