"""A mixture of sources by target shares of all tokens.

The size of the mixture is a parameter. A source whose posts, repeated as often as allowed, cannot fill its share gives
all it has; what it falls short of is spread over the others in proportion to their targets, and the report says so.

Each source's posts are shuffled by hash, once for every repeat, and laid end to
end; their running token count cuts them into blocks of equal size. The order of
the mixture is a low-discrepancy schedule: the i-th van der Corput point, mapped
through the cumulative weights, names the source of slot i, and the k-th slot of
a source holds its k-th block. So every stretch of the mixture has the same shares.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..skew import running_sum
from ..store import Scratch

BLOCK_TOKENS = 512
#: Posts of each source that are chosen by size to end its quota.
LAST_POSTS = 3
#: Slots ranked together; the counts of such runs are added up first.
RUN_SLOTS = 1 << 16
_BITS = 40


def quotas(available: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, int]:
    """Tokens to take of each source that has any, so that they add up to ``total`` or to all that is there.

    ``available`` are the tokens of each source, ``targets`` its (share, most repeats). A source takes its share of the total,
    or all it can give; the rest goes to the others in proportion to their shares, until all is placed. The default
    total is the number of tokens available without repeats.
    """
    open_ = {s: share for s, (share, repeats) in targets.items() if available.get(s, 0) > 0 and share > 0 and repeats > 0}
    most = {s: available[s] * targets[s][1] for s in open_}
    left = float(min(sum(available[s] for s in open_) if total is None else total, sum(most.values())))
    plan: dict[str, int] = {}
    while open_:
        weight = sum(open_.values())
        full = [s for s, share in open_.items() if most[s] <= left * share / weight]
        if not full:
            return plan | {s: round(left * share / weight) for s, share in open_.items()}
        for s in full:
            plan[s] = most[s]
            left -= most[s]
            del open_[s]
    return plan


def schedule(slots: int, shares: list[tuple[str, float]], df_range: DataFrame) -> DataFrame:
    """(slot, source, turn): the source of each slot and how many slots it had before."""
    reversed_bits = F.conv(F.reverse(F.lpad(F.bin("id"), _BITS, "0")), 2, 10).cast("double") / float(1 << _BITS)
    source, below = F.lit(shares[-1][0]), 0.0
    steps = []
    for name, share in shares[:-1]:
        below += share
        steps.append((below, name))
    for edge, name in reversed(steps):
        source = F.when(F.col("point") < edge, F.lit(name)).otherwise(source)
    drawn = df_range.withColumn("point", reversed_bits).select(F.col("id").alias("slot"), source.alias("source"), F.expr(f"id div {RUN_SLOTS}").alias("run"))
    counts = drawn.groupBy("source", "run").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("source", "run", before.alias("before"))
    within = F.row_number().over(W.partitionBy("source", "run").orderBy("slot")) - 1
    return drawn.withColumn("within", within).join(offsets, ["source", "run"]).select("slot", "source", (F.col("before") + F.col("within")).alias("turn"))


def slots_for(turns: dict[str, int], shares: dict[str, float]) -> int:
    """Slots after which every source has had its ``turns``.

    Of the first N van der Corput points an interval of length w has at least N w - log2(N) - 3 (its discrepancy is at most
    log2(N) + 1 at either end, halved), so N is raised until that is enough for each source.
    """
    n = max(1, sum(turns.values()))
    while any(n * shares[s] - math.log2(n) - 3 < k for s, k in turns.items()):
        n = math.ceil(max((k + math.log2(n) + 3) / shares[s] for s, k in turns.items())) + 1
    return n


def _last_posts(laid: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, key, repeat_no) of the posts that fill what whole posts leave of a quota, one a source and round.

    Each time it is the post that comes closest to the tokens still missing; a post that would miss by more than it mends is
    not taken. One row per source travels, never a group.
    """
    spark = laid.sparkSession
    missing = laid.where("stop <= quota").groupBy("source").agg((F.max("quota") - F.sum("n_tokens")).alias("missing"))
    missing = laid.select("source", "quota").distinct().join(missing, "source", "left").select("source", F.coalesce("missing", "quota").alias("missing"))
    todo = {r.source: r.missing for r in missing.collect()}  # one row per source
    spare = laid.where("stop > quota and repeat_no = last_repeat")
    extra: list[tuple] = []
    for _ in range(LAST_POSTS):
        todo = {s: m for s, m in todo.items() if m > 0}
        if not todo:
            break
        wanted = spark.createDataFrame(list(todo.items()), "source string, missing long")
        taken = spark.createDataFrame(extra or [("", None, -1)], f"source string, key {laid.schema['key'].dataType.simpleString()}, repeat_no int").select("source", "key")
        off = F.abs(F.col("missing") - F.col("n_tokens"))
        near = spare.join(F.broadcast(wanted), "source").where(off < F.col("missing")).join(F.broadcast(taken), ["source", "key"], "left_anti")
        found = near.groupBy("source").agg(F.min_by(F.struct("key", "repeat_no", "n_tokens"), F.struct(off, "shuffle", "key")).alias("p")).collect()  # one row per source
        extra += [(r.source, r.p.key, r.p.repeat_no) for r in found]
        todo = {r.source: todo[r.source] - r.p.n_tokens for r in found}
    return spark.createDataFrame(extra, f"source string, key {laid.schema['key'].dataType.simpleString()}, repeat_no int")


def mix(sizes: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", total: int | None = None, block: int = BLOCK_TOKENS, seed: int = 11) -> DataFrame:
    """(slot, position, source, key, repeat_no, n_tokens) of a mixture of about ``total`` tokens; order it by slot and position.

    ``sizes`` has one row (key, source, n_tokens) per post, ``targets`` one row (doc_source, target_share,
    max_repeats) per source; see ``quotas`` for what each source gives. Posts without a source or with one that has no
    target, and empty posts, are not mixed. A post is taken up to max_repeats times, never cut; the last posts of a
    source are chosen by size, so that its quota is met as closely as a few posts can.
    """
    spark = sizes.sparkSession
    scratch = Scratch(spark, "mix")
    wanted = {r.doc_source: (float(r.target_share), int(r.max_repeats)) for r in targets.where("doc_source is not null and target_share > 0 and max_repeats > 0").collect()}  # one row per source
    posts = sizes.where(f"n_tokens > 0 and `{key}` is not null").select(F.col(key).alias("key"), F.col(source).alias("source"), "n_tokens")
    posts = scratch.save(posts.where(F.col("source").isin(*wanted) if wanted else F.lit(False)), "posts")
    held = posts.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()  # one row per source
    available = {r.source: int(r.t) for r in held}
    plan = {s: q for s, q in quotas(available, wanted, total).items() if q > 0}
    if not plan:
        return spark.createDataFrame([], f"slot long, position long, `{source}` string, `{key}` {sizes.schema[key].dataType.simpleString()}, repeat_no int, n_tokens long")
    passes = {s: max(1, -(-q // available[s])) for s, q in plan.items()}
    limits = spark.createDataFrame([(s, q, available[s], passes[s] - 1) for s, q in sorted(plan.items())], "source string, quota long, available long, last_repeat int")
    laid = posts.join(F.broadcast(limits), "source").select("key", "source", "n_tokens", "quota", "available", "last_repeat", F.explode(F.sequence(F.lit(0), F.col("last_repeat"))).alias("repeat_no"))
    laid = laid.withColumn("shuffle", F.xxhash64("key", "repeat_no", F.lit(seed)))
    laid = running_sum(laid, ["source", "repeat_no"], "shuffle", ["key"], "n_tokens", "before", rows=sum(r.n * passes.get(r.source, 0) for r in held))
    start = F.col("repeat_no") * F.col("available") + F.col("before")
    laid = scratch.save(laid.withColumn("position", start).withColumn("stop", start + F.col("n_tokens")), "laid")
    last = _last_posts(laid, scratch)
    ended = laid.where("stop > quota").join(F.broadcast(last), ["source", "key", "repeat_no"], "left_semi").withColumn("position", F.col("quota") - 1)
    taken = laid.where("stop <= quota").unionByName(ended).withColumn("turn", F.expr(f"position div {block}"))
    turns = {s: (q - 1) // block + 1 for s, q in plan.items()}
    shares = {s: k / sum(turns.values()) for s, k in turns.items()}
    slots = slots_for(turns, shares)
    order = schedule(slots, sorted(shares.items()), spark.range(slots))
    placed = taken.join(order, ["source", "turn"], "left").withColumn("slot", F.coalesce("slot", F.raise_error(F.lit("the schedule is too short")).cast("long")))
    return placed.select("slot", "position", F.col("source").alias(source), F.col("key").alias(key), F.col("repeat_no").cast("int").alias("repeat_no"), "n_tokens")


def share_report(mixture: DataFrame, targets: DataFrame, source: str = "source") -> DataFrame:
    """Every target with what was reached: tokens, share of all tokens, posts and the most often a post is repeated.

    ``reached_of_target`` is the reached share over the target share: below 1 the source could not give more, above 1 it
    stands in for others.
    """
    own = mixture.groupBy(F.col(source).alias("doc_source")).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("posts"), (F.max("repeat_no") + 1).alias("repeats"))
    total = own.agg(F.sum("tokens").alias("all_tokens"))
    joined = targets.join(own, "doc_source", "left").crossJoin(F.broadcast(total))  # one row
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    reached = F.coalesce(F.try_divide(F.col("tokens"), F.col("all_tokens")), F.lit(0.0))
    return joined.select("doc_source", "target_share", "max_repeats", zero("tokens").alias("tokens"), zero("posts").alias("posts"), zero("repeats").cast("int").alias("repeats"), reached.alias("reached_share"), F.try_divide(reached, F.col("target_share")).alias("reached_of_target"))
