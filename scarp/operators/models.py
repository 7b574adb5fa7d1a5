"""Model fitting with MLlib: hashed set features, folds, permutations, importances, projection.

Rows have a unique bigint ``key``, a label ``y`` (0 or 1) and a vector ``features``. Random choices are
hashes of the key, so they repeat; permutations pair two hash orders by rank, and no column is gathered in
one task. What reaches the driver is a model, whose size depends on the number of features only.
"""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, HashingTF, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..skew import exact_percentile, lookup_join, ordered_running
from ..store import Scratch
from . import linear, metrics, trees

BITS = 1024
KINDS = ("logreg", "linear_svm", "forest", "balanced_forest", "boosted")
TREES = ("forest", "balanced_forest", "boosted")
LINEAR = tuple(linear.LOSSES)
#: Fixed value: descriptor values are cut to this range.
LIMIT = 1e6


def hashed(sets: DataFrame, bits: int = BITS) -> DataFrame:
    """Adds ``features``: presence of the tokens ``toks``, folded to ``bits`` positions; no vocabulary is kept."""
    return HashingTF(inputCol="toks", outputCol="features", numFeatures=bits, binary=True).transform(sets)


def token_index(sets: DataFrame) -> DataFrame:
    """(token, at): every distinct token of ``toks`` and its own position from 0, in token order."""
    tokens = sets.select(F.explode("toks").alias("token")).distinct()
    return Scratch(sets.sparkSession, "index").save(ordered_running(tokens, [], [F.col("token")], {}).select("token", (F.col("rn") - 1).alias("at")), "index")


def placed(sets: DataFrame, index: DataFrame) -> DataFrame:
    """Adds ``indices``, the positions in ``index`` of the tokens ``toks``, and ``size``, how many it has; tokens outside of it do not count."""
    size = max(1, index.count())
    uses = Scratch(sets.sparkSession, "uses").save(sets.select("key", F.explode_outer("toks").alias("token")), "uses")
    found = lookup_join(uses, index, "token").groupBy("key").agg(F.array_sort(F.collect_set("at")).cast("array<int>").alias("indices"))
    return sets.join(found, "key").withColumn("size", F.lit(size))


def presence(rows: DataFrame) -> DataFrame:
    """Adds ``features``: 1 at the ``indices`` of a vector of ``size``."""
    vector = F.udf(lambda size, at: Vectors.sparse(size, at, [1.0] * len(at)), VectorUDT())
    return rows.withColumn("features", vector("size", "indices"))


def indexed(sets: DataFrame, index: DataFrame) -> DataFrame:
    """Adds ``features``: presence of the tokens ``toks`` at their positions in ``index``; tokens outside of it do not count."""
    return presence(placed(sets, index)).drop("indices", "size")


def _estimator(kind: str, seed: int):
    common = {"labelCol": "y", "weightCol": "weight"}
    if kind == "logreg":
        return LogisticRegression(maxIter=50, regParam=0.01, **common)
    if kind == "linear_svm":
        return LinearSVC(maxIter=50, regParam=0.01, **common)
    if kind in ("forest", "balanced_forest"):
        return RandomForestClassifier(numTrees=300, maxDepth=8, seed=seed, **common)
    if kind == "boosted":
        return GBTClassifier(maxIter=20, maxDepth=3, seed=seed, **common)
    raise ValueError(f"unknown kind of model: {kind}")


#: Fits that run side by side, at most; each is many small jobs.
AT_ONCE = 8
#: Jobs of an evaluation that run side by side, at most: each fit has threads and heap at the driver, and the trees fill the executors.
BESIDE = 2
#: Vectors as long as the number of features that one linear fit has at the driver (20 of them are the optimiser's memory), and
#: the share of the driver's heap that the fits side by side may take.
FIT_VECTORS, FIT_SHARE = 40, 0.4


def side_by_side(jobs: list, most: int = AT_ONCE) -> list:
    """The results of argument-free functions, in order; they share the executors as concurrent jobs, ``most`` at a time."""
    with ThreadPool(min(most, max(1, len(jobs)))) as pool:
        return pool.map(lambda job: job(), jobs, chunksize=1)


def fits_at_once(rows: DataFrame, heap: int | None = None) -> int:
    """How many linear fits of ``features`` the driver's heap (bytes) holds side by side, from 1 to AT_ONCE; the models do not depend on it."""
    heap = heap or rows.sparkSession._jvm.java.lang.Runtime.getRuntime().maxMemory()
    first = rows.select("features").first()
    size = first.features.size if first else 1
    return max(1, min(AT_ONCE, int(heap * FIT_SHARE / (8 * FIT_VECTORS * max(1, size)))))


def fit(kind: str, train: DataFrame, seed: int = 0):
    """A fitted model of one of KINDS, or None if the rows do not have both labels. Balanced: classes weigh the same."""
    n = {r.y: r["count"] for r in train.where("y in (0, 1)").groupBy("y").count().collect()}  # two rows
    if len(n) < 2:
        return None
    weight = F.when(F.col("y") == 1, sum(n.values()) / (2.0 * n[1])).otherwise(sum(n.values()) / (2.0 * n[0])) if kind.startswith("balanced") else F.lit(1.0)
    return _estimator(kind, seed).fit(train.where("y in (0, 1)").select("features", "y", weight.alias("weight")))


def probability(model, rows: DataFrame) -> DataFrame:
    """(key, y, p); models without probabilities give the logistic function of their margin."""
    out = model.transform(rows)
    p = vector_to_array("probability")[1] if "probability" in out.columns else 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    return out.select("key", "y", p.alias("p"))


def _union(frames: list[DataFrame]) -> DataFrame | None:
    whole = frames[0] if frames else None
    for more in frames[1:]:
        whole = whole.unionByName(more)
    return whole


def evaluate(rows: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """(model, key, y, p) of the rows whose ``part`` is ``test``, by models fitted on ``train``; none without both labels."""
    return evaluate_splits(rows, ["part"], kinds).select("model", "key", "y", "p")


def _plan(kind: str, turn: int, size: int, labels: tuple[int, int]) -> trees.Plan:
    """The trees of ``_estimator``, with its numbers."""
    own = _estimator(kind, 0)
    if kind == "boosted":
        return trees.Plan(turn, kind, size, own.getMaxIter(), own.getMaxDepth(), step=own.getStepSize())
    weights = tuple(sum(labels) / (2.0 * n) for n in labels) if kind.startswith("balanced") else (1.0, 1.0)
    return trees.Plan(turn, kind, size, own.getNumTrees(), own.getMaxDepth(), weights)


def evaluate_splits(rows: DataFrame, parts: Sequence[str], kinds: Sequence[str] = KINDS) -> DataFrame:
    """(repeat, model, key, y, p): as ``evaluate`` for each column of ``parts``, numbered from 0.

    Features of presence, all 0 or 1, get the trees of ``trees``, those of all splits together, and the linear models of
    ``linear`` if one task can hold the rows; other linear models and the models of other features are MLlib's,
    fitted side by side. Rows with ``size`` and ``indices`` (``placed``) in place of ``features`` get vectors only for MLlib.
    """
    scratch = Scratch(rows.sparkSession, "evaluate")
    sparse = "indices" in rows.columns
    split = F.udf(_sparse, "size int, indices array<int>, values array<double>")
    marks = [F.array(*[F.col(p).eqNullSafe(F.lit(part)) for p in parts]) for part in ("train", "test")]
    told = [F.col("size"), F.col("indices")] if sparse else [F.col("features"), split("features").alias("f")]
    known = F.coalesce(F.col("y").isin(0, 1), F.lit(False)).alias("__known")
    base = rows.select("key", "y", *told, known, marks[0].alias("__train"), marks[1].alias("test"))
    base = scratch.save(base.select("key", "y", *(["size", "indices"] if sparse else ["features", "f.*"]), F.transform("__train", lambda t: t & F.col("__known")).alias("train"), "test"), "base")
    counts = [F.count(F.when(F.col("train")[t] & (F.col("y") == y), 1)).alias(f"n{t}_{y}") for t in range(len(parts)) for y in (0, 1)]
    ones = F.lit(True) if sparse else F.coalesce(F.bool_and(F.forall("values", lambda v: v == 1.0)), F.lit(True))
    seen = base.agg(F.max("size").alias("size"), ones.alias("presence"), *counts).first()
    labels = {t: (seen[f"n{t}_0"], seen[f"n{t}_1"]) for t in range(len(parts))}
    wanted = [(t, kind) for t in labels if min(labels[t]) for kind in kinds]
    grows = [_plan(kind, t, seen["size"], labels[t]) for t, kind in wanted if seen.presence and kind in TREES]
    blocks = trees.Blocks(*trees.packed(base.select("key", "y", "indices", "train", "test"), scratch)) if seen.presence and wanted else None
    lines = [linear.Plan(t, kind, own.getMaxIter(), own.getRegParam(), own.getTol()) for t, kind in wanted if blocks and blocks.n == 1 and kind in LINEAR for own in [_estimator(kind, 0)]]

    rest = [(t, kind) for t, kind in wanted if not (seen.presence and kind in TREES or lines and kind in LINEAR)]
    vectors = scratch.save(presence(base), "vectors") if sparse and rest else base

    def fitted(t: int, kind: str) -> DataFrame:
        """Written, so that no plan keeps the model."""
        model = fit(kind, vectors.where(F.col("train")[t]), 0)
        told = probability(model, vectors.where(F.col("test")[t]).select("key", "y", "features"))
        saved = scratch.save(told.select(F.lit(t).alias("repeat"), F.lit(kind).alias("model"), "key", "y", "p"), f"told{t}-{kind}")
        rows.sparkSession._jvm.System.gc()  # else the driver's heap grows with what earlier fits have left
        return saved

    def grown() -> DataFrame:
        return scratch.save(blocks.scored(grows, blocks.fitted(grows)), "trees")

    jobs = [lambda: scratch.save(blocks.linear(lines), "lines")] * bool(lines) + [grown] * bool(grows)
    jobs += [lambda t=t, kind=kind: fitted(t, kind) for t, kind in rest]
    told = _union(side_by_side(jobs, min(BESIDE, fits_at_once(vectors) if rest else BESIDE)))
    return told if told is not None else _nothing(rows, "repeat int, model string")


def _nothing(rows: DataFrame, first: str) -> DataFrame:
    return rows.sparkSession.createDataFrame([], f"{first}, key long, y int, p double")


def folds(rows: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Adds ``fold`` 0 .. k-1, stratified by label: the rank in hash order, modulo k."""
    drawn = rows.withColumn("__h", F.xxhash64("key", F.lit(seed)))
    return ordered_running(drawn, ["y"], [F.col("__h"), F.col("key")], {}).select(*rows.columns, (F.col("rn") % k).cast("int").alias("fold"))


def cross_validated(rows: DataFrame, kind: str, k: int = 5, seed: int = 0, repeats: int = 1) -> DataFrame:
    """(fold, key, y, p): every row scored by the model that did not see its fold; fold ``r * k + i`` is the i-th of repeat r."""
    scratch = Scratch(rows.sparkSession, "folds")
    slim = rows.select("key", "y", "features")
    keys = rows.select("key", "y")
    cuts = side_by_side([lambda turn=turn: scratch.save(folds(keys, k, seed + turn).select("key", F.struct(F.lit(turn).alias("turn"), "fold").alias("cut")), f"cut{turn}") for turn in range(repeats)])
    dealt = _union(cuts).groupBy("key").agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    base = scratch.save(slim.join(dealt.select("key", F.col("cuts.fold").alias("folds")), "key"), "base")  # vectors are written once
    scratch.forget(*cuts)

    def held_out(turn: int, fold: int) -> DataFrame | None:
        """Written, so that no plan keeps the model."""
        at = F.col("folds")[turn]
        model = fit(kind, base.where(at != fold), seed + turn)
        told = probability(model, base.where(at == fold)).withColumn("fold", F.lit(turn * k + fold)) if model else None
        return scratch.save(told, f"fold{turn}-{fold}") if told is not None else None

    parts = side_by_side([lambda turn=turn, fold=fold: held_out(turn, fold) for turn in range(repeats) for fold in range(k)], fits_at_once(base))
    told = _union([p for p in parts if p is not None])
    return told.select("fold", "key", "y", "p") if told is not None else _nothing(rows, "fold int")


def permuted(rows: DataFrame, column: str, seed: int) -> DataFrame:
    """The rows with the values of ``column`` dealt anew: the n-th row of one hash order gets the value of the n-th of another."""
    order = lambda salt: [F.xxhash64("key", F.lit(seed), F.lit(salt)), F.col("key")]
    takers = ordered_running(rows.drop(column), [], order(0), {})
    givers = ordered_running(rows.select("key", column), [], order(1), {}).select("rn", column)
    return takers.join(givers, "rn").select(*rows.columns)


def scrambled(rows: DataFrame, kind: str, rounds: int = 5) -> DataFrame:
    """(round, key, y, p): labels permuted, a model fitted to them and asked about the same rows; the level of chance."""
    slim = rows.select("key", "y", "features")

    def chance(turn: int) -> DataFrame | None:
        mixed = Scratch(rows.sparkSession, "scramble").save(permuted(slim, "y", turn), f"round{turn}")
        model = fit(kind, mixed, turn)
        return probability(model, mixed).withColumn("round", F.lit(turn)) if model else None

    told = _union([p for p in side_by_side([lambda turn=turn: chance(turn) for turn in range(rounds)]) if p is not None])
    return told.select("round", "key", "y", "p") if told is not None else _nothing(rows, "round int")


def token_importance(model, sets: DataFrame, bits: int = BITS, index: DataFrame | None = None) -> DataFrame:
    """(token, coefficient, importance) of a linear model: the mean of |w (x - mean x)|, in closed form for presence.

    With the ``index`` that the features were made with each token has its own coefficient; without one,
    tokens that share a position of the hash share its coefficient.
    """
    total = sets.count()
    tokens = sets.select(F.explode("toks").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    if index is None:
        placed = hashed(tokens.withColumn("toks", F.array("token")), bits).select("token", "n", (F.array_position(vector_to_array("features"), 1.0) - 1).alias("at"))
    else:
        placed = tokens.join(index, "token")
    weights = sets.sparkSession.createDataFrame([(i, float(w)) for i, w in enumerate(model.coefficients)], "at long, coefficient double")
    share = F.col("n") / F.lit(max(1, total))
    return placed.join(F.broadcast(weights) if index is None else weights, "at").select("token", "coefficient", (F.abs("coefficient") * 2 * share * (1 - share)).alias("importance"))  # broadcast: `bits` rows


def descriptors(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, columns): infinite, NaN and null values become the median, the rest is cut to LIMIT; columns
    without spread or values are left out, all others have mean 0 and standard deviation (of the population) 1."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.greatest(F.least(c, F.lit(LIMIT)), F.lit(-LIMIT)))
    clean = rows.select(F.col(key).alias("key"), *[finite(F.col(c).cast("double")).alias(c) for c in columns])
    medians = {c: exact_percentile(clean, c, 0.5) for c in columns}
    kept = [c for c in columns if medians[c] is not None]
    filled = clean.select("key", *[F.coalesce(c, F.lit(medians[c])).alias(c) for c in kept])
    stats = filled.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in kept], *[F.stddev_pop(c).alias(f"s_{c}") for c in kept]).first()
    kept = [c for c in kept if stats[f"s_{c}"]]
    return filled.select("key", *[((F.col(c) - stats[f"m_{c}"]) / stats[f"s_{c}"]).alias(c) for c in kept])


def uncorrelated(rows: DataFrame, columns: Sequence[str], limit: float = 0.95) -> list[str]:
    """Columns that no earlier column is correlated with beyond ``limit``; earlier ones count whether kept or not."""
    if len(columns) < 2:
        return list(columns)
    r = Correlation.corr(VectorAssembler(inputCols=list(columns), outputCol="all").transform(rows), "all").first()[0].toArray()
    return [c for i, c in enumerate(columns) if not (np.nan_to_num(np.abs(r[i, :i])) > limit).any()]


def permutation_importance(rows: DataFrame, columns: Sequence[str], kind: str = "logreg") -> DataFrame:
    """(column, auroc, loss): AUROC with the column's values permuted and what that costs, for a model of all columns."""
    assembler = VectorAssembler(inputCols=list(columns), outputCol="features")
    base = Scratch(rows.sparkSession, "permute").save(rows.select("key", "y", *columns), "base")
    model = fit(kind, assembler.transform(base))
    if model is None:
        return rows.sparkSession.createDataFrame([], "column string, auroc double, loss double")
    told = [probability(model, assembler.transform(base)).withColumn("column", F.lit(""))]
    told += [probability(model, assembler.transform(permuted(base, c, 17))).withColumn("column", F.lit(c)) for c in columns]
    found = Scratch(rows.sparkSession, "permute").save(metrics.ranking(_union(told), ["column"]), "found")
    plain = F.broadcast(found.where("column = ''").select(F.col("auroc").alias("whole")))  # one row
    return found.where("column <> ''").crossJoin(plain).select("column", "auroc", (F.col("whole") - F.col("auroc")).alias("loss"))


def projected(rows: DataFrame, k: int = 2) -> tuple[DataFrame, list[float]]:
    """((key, pc1 .. pck), explained variances): centred principal components; the largest loading of each is positive."""
    if rows.isEmpty():
        return rows.select("key", *[F.lit(None).cast("double").alias(f"pc{i + 1}") for i in range(k)]), []
    centred = StandardScaler(inputCol="features", outputCol="centred", withMean=True, withStd=False).fit(rows).transform(rows)
    model = PCA(inputCol="centred", outputCol="pc", k=k).fit(centred)
    loadings = model.pc.toArray()
    signs = [1.0 if column[abs(column).argmax()] >= 0 else -1.0 for column in loadings.T]
    pc = vector_to_array("pc")
    return model.transform(centred).select("key", *[(pc[i] * s).alias(f"pc{i + 1}") for i, s in enumerate(signs)]), model.explainedVariance.toArray().tolist()


def _sparse(v) -> tuple[int, list[int], list[float]]:
    at = v.toArray().nonzero()[0] if not hasattr(v, "indices") else v.indices
    return v.size, [int(i) for i in at], [float(v[int(i)]) for i in at]


def projected_wide(rows: DataFrame, k: int = 2, block: int = 8, tolerance: float = 1e-9, most: int = 80) -> tuple[DataFrame, list[float]]:
    """As ``projected``, for many sparse features: block Lanczos steps, each one pass over the rows.

    Only ``block`` columns of features travel a pass, never the matrix of covariances; passes go on until the
    residuals of the ``k`` components are below ``tolerance`` of the first, and more than ``most`` raise an error.
    """
    spark = rows.sparkSession
    split = F.udf(_sparse, "size int, indices array<int>, values array<double>")
    flat = Scratch(spark, "wide").save(rows.select("key", split("features").alias("f")).select("key", "f.*"), "flat")
    first = flat.agg(F.max("size").alias("d"), F.count("*").alias("n")).first()
    if not first.n:
        return rows.select("key", *[F.lit(None).cast("double").alias(f"pc{i + 1}") for i in range(k)]), []
    d, n = first.d, first.n
    columns = flat.select(F.explode(F.arrays_zip("indices", "values")).alias("x")).groupBy("x.indices").agg(F.sum("x.values").alias("s"), F.sum(F.col("x.values") * F.col("x.values")).alias("q")).collect()  # a row per feature, like a model
    mean = np.zeros(d)
    mean[[r.indices for r in columns]] = [r.s / n for r in columns]
    total = sum(r.q for r in columns) - n * (mean @ mean)

    def times(v: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(v)

        def part(found):
            out, seen = np.zeros((d, v.shape[1])), False
            for r in found:
                at, x = np.asarray(r.indices, int), np.asarray(r["values"])
                out[at] += np.outer(x, x @ shared.value[at])
                seen = True
            return [out] if seen else []

        whole = flat.select("indices", "values").rdd.mapPartitions(part).treeReduce(np.add)
        return whole - n * np.outer(mean, mean @ v)

    v = np.linalg.qr(np.random.default_rng(0).normal(size=(d, min(block, d))))[0]
    q, cq = np.empty((d, 0)), np.empty((d, 0))
    for _ in range(most):
        cv = times(v)
        q, cq = np.hstack([q, v]), np.hstack([cq, cv])
        t = q.T @ cq
        w, u = np.linalg.eigh((t + t.T) / 2)
        w, u = w[::-1][:k], u[:, ::-1][:, :k]
        pc = q @ u
        if len(w) == k and np.linalg.norm(cq @ u - pc * w, axis=0).max() <= tolerance * max(w[0], 1e-300) or q.shape[1] >= d:
            break
        rest = cv - q @ (q.T @ cv)
        rest -= q @ (q.T @ rest)
        left, sizes, _ = np.linalg.svd(rest, full_matrices=False)
        v = left[:, sizes > 1e-10 * max(1.0, w[0])][:, : d - q.shape[1]]
        v -= q @ (q.T @ v)
        if not v.shape[1]:
            break
        v = np.linalg.qr(v)[0]
    else:
        raise ValueError(f"the components are not settled after {most} passes")
    pc = pc * np.where(pc[np.abs(pc).argmax(axis=0), np.arange(pc.shape[1])] >= 0, 1.0, -1.0)
    loads = spark.sparkContext.broadcast(pc)
    centre = mean @ pc

    def place(indices, values):
        return [float(x) for x in np.asarray(values) @ loads.value[np.asarray(indices, int)] - centre]

    told = flat.select("key", F.udf(place, "array<double>")("indices", "values").alias("pc"))
    return told.select("key", *[F.get("pc", F.lit(i)).alias(f"pc{i + 1}") for i in range(k)]), [float(x / total) if total else 0.0 for x in w]
