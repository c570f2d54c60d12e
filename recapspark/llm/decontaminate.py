"""Benchmark passages in training documents, by a broadcast set of hashed word windows.

Texts are lower-cased (A-Z) and cut into words of digits, letters a-z and anything beyond
ASCII. Every run of ``WINDOW`` words of an item is a window; an item with fewer words, but not
none, is one window as a whole. The hashes of all windows form a sorted array that is
broadcast. Documents are scanned with rolling hashes; what meets the set is compared word by
word with the windows of that hash, so a hash never decides. Words inside any occurrence
are hit; runs of hit words are the spans that can be cut out.

A set is broadcast only up to ``BLOCK_WINDOWS`` rows of (window, item) of at most ``BLOCK_BYTES``
of text. A larger benchmark is dealt into blocks below that size; each is scanned by itself
and the findings of equal texts are put together.

NULL has no words. An item without id counts as one item with an empty name; items that share
an id count once. Rows that are equal or share an id are judged each by its own text. Empty
tables give no findings; other columns of both tables are never looked at.
"""

from __future__ import annotations

import math
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recapspark.operators.storage import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words of a window.
WINDOW = 10
#: Most rows (window, item) and bytes of windows of one broadcast.
BLOCK_WINDOWS, BLOCK_BYTES = 200_000, 32_000_000
#: Bytes of text that are hashed at once.
PIECE_BYTES = 2_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: What each byte counts as: 0 between words, else the byte in small letters.
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[65:91] += 32
_BYTES[[b < 48 or 57 < b < 97 or 122 < b < 128 for b in range(256)]] = 0
_BYTES[65:91] = np.arange(97, 123)

_ODD = 0x9E3779B97F4A7C15  # multipliers, odd, so that they have an inverse modulo 2**64
_ODD_WORD = 0xD6E8FEB86659FD93


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for NULL."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(window, n, item)``: the windows of every item, words with a blank between."""
    words = items.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
        words_of(F.col(text_col)).alias("w"),
    ).filter(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(WINDOW))
    starts = F.sequence(F.lit(1), F.size("w") - n + 1)
    cut = F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " "))
    return words.select(F.explode(cut).alias("window"), n.alias("n"), "item").distinct()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base & (2**64 - 1)))
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _kept() -> dict:
    """What this worker process keeps between batches and tasks."""
    return sys.modules.setdefault("_kept_windows", types.ModuleType("_kept_windows")).__dict__


def _both_powers(n: int) -> list[np.ndarray]:
    """Powers of the multiplier and of its inverse, up to the largest piece kept for later."""
    kept = _kept()
    if "powers" not in kept:
        kept["powers"] = [_powers(b, PIECE_BYTES) for b in (_ODD, pow(_ODD, -1, 2**64))]
    if n > PIECE_BYTES:  # a single word
        return [_powers(b, n) for b in (_ODD, pow(_ODD, -1, 2**64))]
    return kept["powers"]


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word of normalised bytes, piece by piece."""
    edge = np.diff((raw != 0).astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        lo = starts[first]
        past = max(int(np.searchsorted(ends, lo + PIECE_BYTES, side="right")), first + 1)
        hi = ends[past - 1]
        forward, backward = _both_powers(hi - lo)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(raw[lo:hi].astype(np.uint64) * forward[: hi - lo], out=sums[1:])
        a, b = starts[first:past] - lo, ends[first:past] - lo
        value = (sums[b] - sums[a]) * backward[a]
        out[first:past] = _mixed(value + (b - a).astype(np.uint64) * np.uint64(_ODD_WORD))
        first = past
    return starts, ends, out


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` consecutive words."""
    count = max(len(words) - n + 1, 0)
    out = np.full(count, np.uint64(n))
    for i in range(n):
        out = out * np.uint64(_ODD_WORD) + words[i : i + count]
    return _mixed(out)


class WindowSet:
    """The windows of a block: sorted hashes to look up, and their words and items."""

    def __init__(self, rows: pa.Table):
        items: dict[str, list[str]] = {}
        self.sizes: dict[str, int] = {}
        for window, n, item in zip(*(rows.column(c).to_pylist() for c in ("window", "n", "item"))):
            items.setdefault(window, []).append(item)
            self.sizes[window] = n
        self.items = items
        self.by_size = {}
        for n in sorted(set(self.sizes.values())):
            own = [w.encode() for w, k in self.sizes.items() if k == n]
            raw = np.frombuffer(b"\0".join(own), np.uint8)
            _, _, words = word_hashes(_BYTES[raw])
            hashes = window_hashes(words, n)[::n]
            order = np.argsort(hashes, kind="stable")
            same: dict[int, list[bytes]] = {}
            for i in order.tolist():
                same.setdefault(int(hashes[i]), []).append(own[i])
            self.by_size[n] = (np.unique(hashes), same)

    def find(self, raw, starts, ends, words, doc) -> list[tuple[int, int, str]]:
        """``(first word, number of words, window)`` of every occurrence; none crosses documents."""
        found = []
        for n, (known, same) in self.by_size.items():
            hashes = window_hashes(words, n)
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            for i in np.flatnonzero(known[at] == hashes).tolist():
                if doc[i] != doc[i + n - 1]:
                    continue
                own = b" ".join(raw[starts[k] : ends[k]].tobytes() for k in range(i, i + n))
                if own in same[int(hashes[i])]:
                    found.append((i, n, own.decode()))
        return found


def _slices(sizes: list[int]):
    """Runs of texts of together at most ``PIECE_BYTES``, a longer one by itself."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > PIECE_BYTES:
            yield start, i
            start, total = i, 0
        total += n + 1
    if start < len(sizes):
        yield start, len(sizes)


def _scan(texts: list[bytes], block: WindowSet):
    """Per text: number of words, hit words (numbers), their spans (bytes), and items."""
    for lo, hi in _slices([len(t) for t in texts]):
        part = texts[lo:hi]
        raw = _BYTES[np.frombuffer(b"\0".join(part), np.uint8)]
        starts, ends, words = word_hashes(raw)
        bounds = np.cumsum([0] + [len(t) + 1 for t in part])
        firsts = np.searchsorted(starts, bounds)
        doc = np.repeat(np.arange(len(part)), np.diff(firsts))
        hits: dict[int, list] = {}
        for hit in block.find(raw, starts, ends, words, doc):
            hits.setdefault(int(doc[hit[0]]), []).append(hit)
        for d in range(len(part)):
            first, n = int(firsts[d]), int(firsts[d + 1] - firsts[d])
            own = hits.get(d, [])
            hit_words = np.unique(
                np.concatenate([np.arange(i, i + k) for i, k, _ in own] or [np.empty(0, np.int64)])
            )
            items = {item for window in {w for _, _, w in own} for item in block.items[window]}
            place = np.stack([starts[hit_words], ends[hit_words]], axis=1) - bounds[d]
            yield n, (hit_words - first).tolist(), place.tolist(), sorted(items)


def _block_of(rows: pa.Table) -> WindowSet:
    """The set of this worker process, built once from what was broadcast."""
    kept = _kept()
    if kept.get("rows") is not rows:
        kept["rows"], kept["set"] = rows, WindowSet(rows)
    return kept["set"]


_HIT = "hits array<struct<word:int,first:int,past:int>>, items array<string>"
_HIT_TYPE = pa.list_(pa.struct([("word", pa.int32()), ("first", pa.int32()), ("past", pa.int32())]))


def _scanned(docs: DataFrame, block) -> DataFrame:
    """``docs`` (any columns, the text is ``_text``) with ``n_words``, ``hits`` and ``items``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(block)

    def run(batches):
        known = _block_of(shared.value)
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("_text"))
            texts = text.cast(pa.binary()).fill_null(b"").to_pylist()
            n_words, hits, items = [], [], []
            for n, words, places, names in _scan(texts, known):
                n_words.append(n)
                hits.append([(w, a, b) for w, (a, b) in zip(words, places)])
                items.append(names)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(n_words, pa.int64()),
                    pa.array(
                        [[{"word": w, "first": a, "past": b} for w, a, b in h] for h in hits],
                        _HIT_TYPE,
                    ),
                    pa.array(items, pa.list_(pa.string())),
                ],
                names=[*batch.schema.names, "n_words", "hits", "items"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, n_words long, {_HIT}")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``(id, text, n_words, hits, items)`` for every row of ``docs``.

    ``hits`` are the words inside an occurrence of a window: number, first byte and the byte
    behind it in UTF-8. ``items`` are the ids (as text) of the items whose windows occur.
    """
    known = stored(windows(benchmark, item_col, item_text_col), "windows")
    size = known.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("window")), F.lit(0)).alias("b")
    ).first()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    if size["n"] <= BLOCK_WINDOWS and size["b"] <= BLOCK_BYTES:
        return _scanned(own, known.toArrow()).withColumnRenamed("_text", "text")
    # dealt by hash into blocks half as large as a broadcast may be
    parts = 2 * math.ceil(max(size["n"] / BLOCK_WINDOWS, size["b"] / BLOCK_BYTES))
    dealt = stored(
        known.withColumn("part", F.pmod(F.xxhash64("window", "item"), F.lit(parts)).cast("int"))
        .repartitionByRange("part"),
        "windows",
    )
    mark = F.sha2(F.coalesce(F.col("_text"), F.lit("")), 256).alias("mark")
    texts = own.select(mark, "_text").dropDuplicates(["mark"])
    texts = stored(texts, "texts")
    found = None
    for part in range(parts):
        block = dealt.filter(F.col("part") == part).select("window", "n", "item").toArrow()
        one = stored(_scanned(texts, block).select("mark", "n_words", "hits", "items"), "found")
        found = one if found is None else found.unionByName(one)
    merged = found.groupBy("mark").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    marked = own.select("id", F.col("_text").alias("text"), mark)
    return marked.join(merged, "mark").select("id", "text", "n_words", "hits", "items")


def removed(found: DataFrame, whole: bool = False) -> DataFrame:
    """``(id, text)`` without what :func:`contamination` found.

    ``whole`` drops every document with a hit; else runs of hit words are cut out of its text
    with all that stands between them, and the rest is joined by a blank where both sides have some.
    """
    if whole:
        return found.filter(F.size("hits") == 0).select("id", "text")

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            texts = [
                t if not h else _cut(t, [(x["word"], x["first"], x["past"]) for x in h])
                for t, h in zip(texts, batch.column(2).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], names=["id", "text"]
            )

    kind = found.schema["id"].dataType.simpleString()
    return found.select("id", "text", "hits").mapInArrow(run, f"id {kind}, text string")


def _cut(text: bytes, hits: list[tuple[int, int, int]]) -> bytes:
    kept, at, last = [], 0, None
    for word, first, past in hits:
        if last is None or word != last + 1:
            kept.append(text[at:first])
        at, last = past, word
    kept.append(text[at:])
    return b" ".join(part for k in kept if (part := k.strip(b" ")))
