"""Shards of near equal bytes by sampled splitters.

The key of a document is the hash of its text, so equal texts lie side by side. A
size-weighted sample of keys gives quantile boundaries; they cut the documents into
many ranges of about equal bytes. The exact bytes and rows of every range are counted; a range that
holds clearly more than its part (one text with very many copies) is subdivided by a hash
of the id. Whole pieces, in order of their key, then fill the shards, so equal texts share a shard
unless their range had to be divided, and shards differ by about a piece.

NULL texts have size 1 and share a key with the empty text. NULL ids are ids like others.
Rows with equal id and text are told apart by no column: they get different slots, which
of them gets which is open. No rows in, no rows out.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recapspark.operators.storage import stored

RANGES = 4096
#: Size of the key sample; its rows reach the driver as quantiles only.
SAMPLE_ROWS = 200_000


def size_of(text: Column) -> Column:
    """UTF-8 bytes plus one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _splitters(sizes: DataFrame, total: int, ranges: int, sample_rows: int) -> list[int]:
    """Ascending keys that cut the documents into ``ranges`` parts of about equal bytes.

    A row is drawn with a probability in proportion to its size, so each drawn row stands for the
    same bytes; one larger than that is drawn surely and counts by its size. The weights of the
    sampled keys are added up in the order of the keys, and where the sum passes a multiple of its
    ``ranges``-th part a range begins. The draw is a function of key and id, so a lost task
    repeats it. About ``sample_rows`` rows are drawn, whatever the input: few enough for one task.
    """
    mean = total / sample_rows
    drawn = F.pmod(F.xxhash64("key", "id", F.lit(17)), F.lit(1 << 30)) < F.least(
        F.col("size") / mean, F.lit(1.0)
    ) * (1 << 30)
    weight = F.greatest(F.col("size") / mean, F.lit(1.0))
    sample = sizes.filter(drawn).groupBy("key").agg(F.sum(weight).alias("weight"))
    sample = stored(sample, "sample")
    whole = sample.agg(F.sum("weight")).first()[0]
    if not whole:
        return []
    before = F.sum("weight").over(Window.orderBy("key")) - F.col("weight")
    begins = F.ceil(before * ranges / whole).cast("int")
    first = sample.select("key", begins.alias("part")).groupBy("part").agg(F.min("key").alias("key"))
    return sorted(r["key"] for r in first.filter("part > 0").collect())


def _range_of(key: Column, splitters: list[int]) -> Column:
    """How many splitters are at or below ``key``: a binary search in a constant array."""
    array = F.from_json(F.lit(json.dumps(splitters)), "array<bigint>")
    steps = [1 << i for i in reversed(range(max(1, len(splitters)).bit_length()))]

    def walk(low, step):
        there = F.get(array, low + step - 1)
        return F.when(there <= key, low + step).otherwise(low)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), walk)


def placed(
    docs: DataFrame,
    ranges: int = RANGES,
    sample_rows: int = SAMPLE_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, int]:
    """Every row with its ``range`` of keys and ``part`` thereof, and the bytes of all."""
    text = F.col(text_col)
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    rows = stored(
        docs.select(
            F.col(id_col).alias("id"),
            size_of(text).alias("size"),
            crc.cast("long").alias("crc32"),
            _key(text).alias("key"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "sizes",
    )
    total, count = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not total:
        return rows.select("*", F.lit(0).alias("range"), F.lit(0).alias("part")), 0
    splitters = _splitters(rows, total, ranges, sample_rows)
    found = rows.withColumn("range", _range_of(F.col("key"), splitters))

    goal, row_goal = 2 * total / ranges, 2 * count / ranges
    ranged = found.groupBy("range").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")
    )
    parts = {
        r["range"]: math.ceil(max(r["bytes"] / (goal + 1), r["rows"] / (row_goal + 1)))
        for r in ranged.collect()
    }
    parts = {k: n for k, n in parts.items() if n > 1}
    divided = F.from_json(
        F.lit(json.dumps([parts.get(i, 1) for i in range(len(splitters) + 1)])), "array<int>"
    )
    spread = F.when(F.col("id").isNull(), F.xxhash64("row")).otherwise(F.xxhash64("id", F.lit(5)))
    part = F.pmod(spread, F.get(divided, F.col("range")))
    return found.withColumn("part", F.coalesce(part, F.lit(0)).cast("int")), total


def shard(
    docs: DataFrame,
    shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranges: int = RANGES,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``(id, size, crc32, shard, slot)`` for every row of ``docs``.

    The driver holds the splitters and one size per piece: fewer than ``ranges`` and three
    times ``ranges`` numbers. Slots count rows 0, 1, ... in a shard; they come from a sort
    within pieces, each about a ``ranges``-th of all, and the rows of earlier pieces.
    """
    spark = docs.sparkSession
    found, total = placed(docs, ranges, sample_rows, id_col, text_col)
    if not total:
        return found.select(
            "id", "size", "crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")
        )
    pieces = found.groupBy("range", "part").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")
    )
    before = dict.fromkeys(range(shards), 0)
    filled, plan = 0, []
    for p in sorted(pieces.collect(), key=lambda r: (r["range"], r["part"])):
        to = min(shards - 1, int(shards * (filled + p["bytes"] / 2) / total))
        plan.append((p["range"], p["part"], to, before[to]))
        filled += p["bytes"]
        before[to] += p["rows"]
    plan = spark.createDataFrame(plan, "range int, part int, shard int, before long")
    order = Window.partitionBy("range", "part").orderBy("key", "id", "size")
    numbered = found.withColumn("place", F.row_number().over(order) - 1)
    return numbered.join(F.broadcast(plan), ["range", "part"]).select(
        "id", "size", "crc32", "shard", (F.col("before") + F.col("place")).alias("slot")
    )
