"""A varied subset of fixed size: draws inverse to local density.

Density is estimated from how full the buckets of repeated locality-sensitive
hashes are (MinHash pairs over 5-grams of the structure) and how often the core
occurs; the draw is one weighted sample without replacement.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..skew import first_k, lookup_join
from ..store import Scratch

GRAM = 5
REPEATS = 8
#: Exponent of the score in the weight: a score better by a tenth counts three times.
SCORE_POWER = 12.0


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash by multiplication and shifts."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def minhash_buckets(texts: pa.Array, repeats: int = REPEATS) -> np.ndarray:
    """[rows, repeats] bucket numbers; two texts share one with the square of their 5-gram similarity."""
    texts = pc.utf8_rpad(pc.fill_null(texts.cast(pa.string()), ""), GRAM, " ")
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]].astype(np.uint64)
    off = off - off[0]
    grams = np.zeros(len(data) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        grams = (grams << np.uint64(8)) | data[i : len(data) - GRAM + 1 + i]
    grams = np.r_[grams, np.zeros(GRAM - 1, np.uint64)]
    crosses = np.zeros(len(data), bool)
    for i in range(1, GRAM):
        crosses[off[1:] - i] = True  # 5-grams that reach into the next text
    out = np.empty((n, repeats), np.int64)
    with np.errstate(over="ignore"):
        for r in range(repeats):
            least = []
            for half in range(2):
                h = _mix(grams, 1 + 2 * r + half)
                h[crosses] = np.iinfo(np.uint64).max
                least.append(np.minimum.reduceat(h, off[:-1]))
            out[:, r] = _mix(least[0] * np.uint64(31) + least[1], 1000 + r).view(np.int64)
    return out


def varied_subset(rows: DataFrame, size: int, key: str = "hit_id", structure: str = "smiles", core: str = "core", score: str = "score", seed: int = 7, repeats: int = REPEATS) -> DataFrame:
    """``size`` molecules of good score that cover the variety of structures and cores.

    Gives (key, structure, core, score, density, draw_rank), fewer rows only if there are fewer
    distinct molecules. Copies of a molecule (same structure without blanks) are one candidate, its
    best scored row; rows without a structure are none. A missing core is a group like any other; a
    missing or negative score counts as 0, which still leaves a small weight. Ties are broken by key.
    """
    scratch = Scratch(rows.sparkSession, "varied")
    clean = F.nullif(F.trim(structure), F.lit(""))
    points = F.greatest(F.coalesce(F.nanvl(F.col(score), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    best = rows.select(clean.alias("structure"), F.col(key).alias("key"), F.coalesce(F.trim(core), F.lit("")).alias("core"), F.col(score).alias("score"), points.alias("points")).where("structure is not null and key is not null")
    best = best.groupBy("structure").agg(F.max_by(F.struct("key", "core", "score", "points"), F.struct(F.col("points"), -F.col("key"))).alias("b")).select("structure", "b.*")
    best = scratch.save(best, "molecules")

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = minhash_buckets(batch.column("structure"), repeats)
                keys = batch.column("key").take(pa.array(np.repeat(np.arange(len(found)), repeats)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(found.ravel())], ["key", "bucket"])

    key_type = best.schema["key"].dataType.simpleString()
    buckets = scratch.save(best.select("key", "structure").mapInArrow(bucket, f"key {key_type}, bucket long"), "buckets")
    near = lookup_join(buckets, buckets.groupBy("bucket").agg(F.count("*").alias("n")), "bucket", "inner").groupBy("key").agg(F.avg("n").alias("near"))
    cores = lookup_join(best, best.groupBy("core").agg(F.count("*").alias("n_core")), "core", "inner")
    density = F.col("near") * F.col("n_core")
    weight = F.pow(F.greatest("points", F.lit(0.01)), F.lit(SCORE_POWER)) / density
    # Exponential clocks: the first `size` to ring are a weighted sample without replacement.
    uniform = (F.shiftrightunsigned(F.xxhash64("key", F.lit(seed)), 11) + 0.5) / F.lit(float(1 << 53))
    drawn = cores.join(near, "key").withColumn("density", density).withColumn("clock", -F.log(uniform) / weight)
    ranked = first_k(scratch.save(drawn.drop("structure", "points", "near", "n_core"), "drawn"), F.col("clock"), ["key"], size, "draw_rank")
    named = ranked.drop("core", "score").join(best.select("key", "structure", "core", "score"), "key")
    return named.select(F.col("key").alias(key), F.col("structure").alias(structure), F.col("core").alias(core), F.col("score").alias(score), "density", F.col("draw_rank").cast("int").alias("draw_rank"))
