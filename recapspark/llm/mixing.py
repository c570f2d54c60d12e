"""Mixing sources to target weights by subset sums over exact document lengths.

The size of a document is its number of words. Sources, in code point order and NULL last,
weigh 5, 2, 1, 5, 2, 1, ... and share ``share`` times all words; a source's target stops at
``most`` times its own words, and what is left over goes to the others by weight until no
target is above. Each source takes every document ``target // size`` times (0, 1 or 2) and
fills the rest with different documents:

* documents are counted by exact length, per source;
* of every length a common fraction is taken, which leaves a small remaining budget;
* bounded-knapsack dynamic programming over the lengths not yet taken comes nearest that
  budget, from below or above;
* of each length as many documents as decided are picked, by a seeded hash of the id.

NULL texts have size 0 and so have texts without words; they are taken as often as the
whole source is. A source without words has target 0. Rows with equal id and length are
picked together as equals: which of them is taken is open, how many is not.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recapspark.operators.storage import stored

WEIGHTS = (5.0, 2.0, 1.0)
SEED = 7
#: Words left to the dynamic programme, at most; it keeps this many bits per length.
BUDGET = 20_000
#: Documents per bucket of equal source and length when a part of them is picked, at least;
#: lengths with more rows than a bucket are at most ``MAX_LARGE``, as a bucket holds no less
#: than that part of all rows.
BUCKET_ROWS = 2_000
MAX_LARGE = 10_000


def words_in(text: Column) -> Column:
    """Number of runs of characters other than space and 0x09-0x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row per source.

    Sources are numbered by a range sort: the rows of each range and of the ranges before.
    The water level is found by repeated sums, so no task or driver holds the sources.
    """
    ranged = stored(
        sources.repartitionByRange(F.col("source").isNull(), "source")
        .sortWithinPartitions(F.col("source").isNull(), "source")
        .withColumn("_place", F.monotonically_increasing_id()),
        "sources",
    )
    mono = F.col("_place")
    ranged = ranged.select(
        "source",
        "source_size",
        F.shiftright(mono, 33).alias("_range"),
        mono.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"),
    )
    sizes = {r["_range"]: r["n"] for r in ranged.groupBy("_range").agg(F.count("*").alias("n")).collect()}
    before, offset = [], 0
    for part in range(max(sizes, default=-1) + 1):
        before.append(offset)
        offset += sizes.get(part, 0)
    if not before:
        return sources.withColumn("target", F.lit(0.0))
    rank = F.get(F.array(*map(F.lit, before)), F.col("_range").cast("int")) + F.col("_at")
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), F.pmod(rank, F.lit(len(WEIGHTS))).cast("int"))
    weighed = stored(
        ranged.select(
            "source", "source_size", weight.alias("_w"), (most * F.col("source_size")).alias("_cap")
        ),
        "weights",
    )
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        # sources whose cap is at or below their part of the level are full
        row = weighed.agg(
            F.coalesce(F.sum(F.when(F.col("_cap") <= F.col("_w") * level, F.col("_cap"))), F.lit(0.0)).alias("caps"),
            F.count(F.when(F.col("_cap") <= F.col("_w") * level, 1)).alias("full"),
            F.coalesce(F.sum(F.when(F.col("_cap") > F.col("_w") * level, F.col("_w"))), F.lit(0.0)).alias("open"),
        ).first()
        if row["full"] == full or not row["open"]:
            break
        full, level = row["full"], (share * total - row["caps"]) / row["open"]
    target = F.least(F.col("_cap"), F.col("_w") * level)
    return weighed.select("source", "source_size", target.alias("target"))


def fit_lengths(
    lengths: np.ndarray, counts: np.ndarray, budget: int, fine: int = BUDGET, above: bool = False
) -> np.ndarray:
    """How many documents of each length to take so that their words come near ``budget``.

    ``counts`` bounds the take. A common fraction of every count comes first and leaves at
    least ``fine`` words if there are as many; longest first, single documents are added
    down to ``fine``; a bounded knapsack (each length's multiplicity split into powers of
    two) fits the rest as well as sums from below can. With ``above``, if no sum from below is
    exact, sums up to twice the rest are searched too and the nearest on either side is taken;
    of two as near, the lower.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    take = np.zeros(len(lengths), np.int64)
    real = lengths > 0
    total = int((lengths * counts).sum())
    budget = int(min(budget, total))
    if budget <= 0:
        return take
    common = max(0, budget - fine)
    if total:
        # counts are exact integers: floor(count * common / total)
        take[real] = [int(c) * common // total for c in counts[real]]
    left = budget - int((lengths * take).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if left <= fine:
            break
        n = min(int(counts[i] - take[i]), (left - fine) // max(1, int(lengths[i])))
        if real[i] and n > 0:
            take[i] += n
            left -= n * int(lengths[i])
    reach, steps = _sums(lengths, counts - take, left, left)
    at = reach.bit_length() - 1
    if above and at < left:
        # nothing taken is ``left`` away, so no sum beyond twice that is nearer
        wide, wide_steps = _sums(lengths, counts - take, left, 2 * left)
        over = wide >> (left + 1)
        nearest = left + (over & -over).bit_length()
        if over and nearest - left < left - at:
            at, steps = nearest, wide_steps
    for i, n, earlier in reversed(steps):
        if not earlier >> at & 1:
            take[i] += n
            at -= n * int(lengths[i])
    return take


def _sums(lengths: np.ndarray, free: np.ndarray, goal: int, most: int):
    """Bits of the sums up to ``most`` that free documents reach, and the steps to them.

    Each step is ``(length's place, documents, bits before it)``; it ends when ``goal`` is reached.
    """
    reach, steps = 1, []
    mask = (1 << (most + 1)) - 1
    for i in np.argsort(-lengths, kind="stable"):
        rest = min(int(free[i]), most // max(1, int(lengths[i])))
        n = 1
        while lengths[i] > 0 and rest > 0 and not reach >> goal & 1:
            n = min(n, rest)
            steps.append((i, n, reach))
            reach |= (reach << (n * int(lengths[i]))) & mask
            rest -= n
            n *= 2
    return reach, steps


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = 1.5,
    most: float = 2.0,
    seed: int = SEED,
) -> DataFrame:
    """All columns of ``docs`` and ``_size, _source_size, _target, _times``.

    ``_times`` (0 to 2) says how often the mix takes the document.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        words_in(F.col(text_col)).alias("size"),
    )
    by_length = stored(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "lengths")
    sources = by_length.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = targets(sources, share, most)

    def fit(frame):
        frame = frame.sort_values("size")
        target, words = float(frame["target"].iloc[0]), int(frame["source_size"].iloc[0])
        times = int(target // words) if words else 0
        rest = int(round(target - times * words))
        if times >= most:
            times, rest = int(most), 0
        frame["times"] = times
        frame["more"] = fit_lengths(frame["size"].to_numpy(), frame["n"].to_numpy(), rest, above=True)
        return frame

    plan = (
        by_length.join(goals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .select("source", "size", "n", "source_size", "target")
        .groupBy("source")
        .applyInPandas(
            fit,
            "source string, size long, n long, source_size long, target double, times int, more long",
        )
    )
    plan = stored(plan, "plan")

    total = by_length.agg(F.sum("n")).first()[0] or 0
    bucket_rows = max(BUCKET_ROWS, -(-total // MAX_LARGE))
    large = by_length.filter(F.col("n") > bucket_rows).select(
        F.col("source").alias("_s"),
        F.col("size").alias("_z"),
        F.ceil(F.col("n") / bucket_rows).alias("_buckets"),
    )
    marked = docs.select(
        *docs.columns,
        F.col(source_col).cast("string").alias("_source"),
        words_in(F.col(text_col)).alias("_size"),
        F.xxhash64(F.col(id_col), F.lit(seed)).alias("_hash"),
    )
    same = F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z"))
    marked = marked.join(F.broadcast(large), same, "left").drop("_s", "_z")
    buckets = F.coalesce("_buckets", F.lit(1))
    marked = marked.withColumn("_bucket", F.pmod("_hash", buckets)).drop("_buckets")
    before = Window.partitionBy("_s", "_z").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counted = (
        marked.groupBy(F.col("_source").alias("_s"), F.col("_size").alias("_z"), F.col("_bucket").alias("_b"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    )
    decided = plan.select(
        F.col("source").alias("_p"),
        F.col("size").alias("_q"),
        F.col("source_size").alias("_source_size"),
        F.col("target").alias("_target"),
        "times",
        "more",
    )
    decided = counted.join(
        decided, F.col("_s").eqNullSafe(F.col("_p")) & (F.col("_z") == F.col("_q"))
    ).drop("_p", "_q", "_n")
    joined = marked.join(
        decided,
        F.col("_source").eqNullSafe(F.col("_s"))
        & (F.col("_size") == F.col("_z"))
        & (F.col("_bucket") == F.col("_b")),
    )
    order = Window.partitionBy("_source", "_size", "_bucket").orderBy("_hash", id_col)
    picked = F.col("_before") + F.row_number().over(order) <= F.col("more")
    return joined.withColumn("_times", F.col("times") + picked.cast("int")).select(
        *docs.columns, "_size", "_source_size", "_target", "_times"
    )
