"""SimHash near-duplicates: fingerprints, pigeonhole blocks, components.

Words are runs of bytes other than space and 0x09-0x0D after lower-casing A-Z. A text
shorter than a shingle is one shingle; a text without words (also NULL) has fingerprint
zero, which is linked like any other. Rows with equal ids, or NULL ids, are separate rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recapspark.llm.components import connected_components
from recapspark.operators.storage import stored

BITS = 64
SEED = 42


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """Majority of the XXH64 bits of all word shingles, as a signed 64-bit integer."""
    words = (text or b"").lower().split()  # of bytes: ASCII letters, ASCII white space
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        last = ends[width - 1 :].tolist()
        shingles = [joined[a:b] for a, b in zip(starts.tolist(), last)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(shingles))
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 65536):
        part = h[i : i + 65536].view(np.uint8)
        counts += np.unpackbits(part, bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(h), bitorder="little")
    return int(bits.view(np.int64)[0])


def text_hash(text: Column) -> Column:
    """Tells rows with equal ids and different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, hash, fp)`` per row of ``docs``: a hash of the text and the fingerprint, signed longs."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps, pa.int64())],
                names=["id", "hash", "fp"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(
        F.col(id_col).alias("id"),
        text_hash(F.col(text_col)).alias("hash"),
        F.col(text_col).cast("binary").alias("text"),
    ).mapInArrow(run, f"id {kind}, hash long, fp long")


def _masks(blocks: int, agreeing: int) -> list[int]:
    """Signed bit masks of all choices of ``agreeing`` out of ``blocks`` near equal blocks."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    of_block = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(of_block, agreeing)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _flips(mask: int, n: int) -> list[int]:
    """Signed masks that flip exactly ``n`` of the bits outside ``mask``."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    flips = [sum(1 << i for i in bits) for bits in combinations(free, n)]
    return [f - (1 << BITS) if f >> (BITS - 1) else f for f in flips]


def near_pairs(
    fps: DataFrame, distance: int = 3, blocks: int = 5, crowded: int = 4096
) -> DataFrame:
    """Edges ``(a, b)`` that connect all fingerprints of ``fps(fp)`` within ``distance`` bits.

    Of ``blocks`` blocks at least ``blocks - distance`` agree in a close pair, so every
    choice of that many blocks is a table keyed by their bits, and pairs of a key are
    verified inside the join. ``fps`` must be distinct. More blocks make longer
    keys, fewer chance candidates and more tables; the result is the same.

    A key shared by more than ``crowded`` fingerprints is not compared pair by pair:
    its members meet at the values one or two flipped bits away. Whatever is one flip from
    such a value and whatever is two flips from it are at most three apart, so all are
    linked to the smallest of the first kind: rows in proportion to the members, at most
    a few hundred per value, and every member within three bits is reached.
    """
    if distance != 3 and crowded is not None:
        raise ValueError("meeting points are worked out for distance 3")
    masks = _masks(blocks, blocks - distance)
    fp = F.col("fp")
    keyed = fps.select(
        fp,
        F.posexplode(F.array(*[fp.bitwiseAND(F.lit(m)) for m in masks])).alias("table", "key"),
    )
    full = stored(
        keyed.groupBy("table", "key").count().filter(F.col("count") > crowded).drop("count"),
        "crowded", len(masks) * fps.count() // max(1, crowded or 1),
    )
    sparse = keyed
    some = not full.isEmpty()
    if some:
        sparse = keyed.join(full, ["table", "key"], "left_anti")
    left = sparse.withColumnRenamed("fp", "a")
    right = sparse.withColumnRenamed("fp", "b")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    same = (
        (left["table"] == right["table"]) & (left["key"] == right["key"]) & (F.col("a") < F.col("b"))
    )
    pairs = left.join(right, same & close).select("a", "b")
    if some:
        pairs = pairs.union(_meeting_points(keyed.join(full, ["table", "key"], "left_semi"), masks))
    return pairs


def _meeting_points(members: DataFrame, masks: list[int]) -> DataFrame:
    one = F.array(*[F.array(*map(F.lit, [0, *_flips(m, 1)])) for m in masks])
    two = F.array(*[F.array(*map(F.lit, _flips(m, 2))) for m in masks])
    fp, table = F.col("fp"), F.col("table") + 1

    def met(flips, first):
        values = F.transform(F.element_at(flips, table), lambda m: fp.bitwiseXOR(m))
        return members.select("table", "key", "fp", F.explode(values).alias("at"), first)

    near = met(one, F.lit(True).alias("near"))
    far = met(two, F.lit(False).alias("near"))
    at = (
        near.union(far)
        .groupBy("table", "key", "at")
        .agg(F.min(F.when(F.col("near"), fp)).alias("a"), F.collect_set("fp").alias("all"))
        .filter(F.col("a").isNotNull() & (F.size("all") > 1))
    )
    return at.select("a", F.explode("all").alias("b")).filter("a <> b").distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    blocks: int = 5,
    crowded: int = 4096,
) -> DataFrame:
    """``(id, hash, fp, component, root)`` per row: the smallest id that close fingerprints lead to.

    Equal fingerprints are one node of the graph, however many rows share them. A component
    whose ids are all NULL has component NULL. ``root``, its smallest fingerprint, tells
    components of the same smallest id apart. No rows in, no rows out.
    """
    rows = stored(with_fingerprint(docs, id_col, text_col), "fingerprints")
    n = rows.count()
    first = stored(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct", n)
    pairs = near_pairs(first.select("fp"), blocks=blocks, crowded=crowded)
    reached = connected_components(pairs)
    rooted = first.join(reached, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = stored(rooted.join(named, "root").select("fp", "component", "root"), "components", n)
    return rows.join(named, "fp").select("id", "hash", "fp", "component", "root")
