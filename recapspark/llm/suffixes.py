"""Removal of repeated byte strings: bounded prefixes by a Burrows-Wheeler transform.

Texts are UTF-8 bytes. A byte goes if it lies in a string of ``LENGTH`` bytes that also
starts earlier: in a document with a smaller id, or earlier in the same document. Strings never cross documents,
overlapping occurrences count, and all are judged on the input.

How equal strings meet without moving all text: every string (window) of ``LENGTH`` bytes names the
``GRAM``-byte piece in it with the smallest hash, the leftmost of equals, as its anchor. Equal windows have
equal anchors. Neighbouring windows with the same anchor form a run; only runs travel, as two hashes.

1. Runs with the same anchor and content: all but the first are covered as a whole. Each
   task settles its own repeats before the shuffle, so a frequent passage sends one row per task.
2. Anchors with one content only are unique and done with.
3. The first runs of anchors with several contents differ somewhere. Their text is cut out and brought
   together by anchor. What cannot be in an equal window, as no other run has the same bytes around the
   anchor, is left out (``may_repeat``); the Burrows-Wheeler transform of a block of the rest is searched
   breadth-first: level by level a backward step finds all places where neighbouring suffixes have a
   common prefix of just that length, until ``LENGTH``. What is then undivided are the
   windows that occur more than once.
4. An anchor with more than ``crowded`` contents is taken apart: each of its windows travels
   alone, with its own hash as anchor.

Runs meet by anchor, but those of anchors with ``heavy`` runs or more meet by anchor and content, so a
phrase that a third of all documents share, each time in other surroundings, spreads over all tasks;
how many contents it has is counted afterwards. Which anchors are heavy is found from the documents whose
hash is divisible by ``sample``. It only decides where a run travels: an anchor that the
sample misses meets in one task, with the same result.

A NULL text is empty. A NULL id comes after all others. Rows with equal id are one
document as far as order goes: a string at the same place in both is not earlier. No rows in, no
rows out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recapspark.operators.storage import stored

LENGTH = 100
GRAM = 24
CROWDED = 50_000
HEAVY = 4_000
SAMPLE = 64
BUFFER_BYTES = 1 << 20  # bytes hashed at once
BLOCK_BYTES = 2 << 20  # bytes of one transform
PARTS = 4  # strings that stand for the windows of a run
_LAST = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_GAP = 0xFF  # in no UTF-8 text


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(29)
    return x


class _Powers:
    """Powers of the hash base and of its inverse, as far as needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if n > len(self.up):
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                powers = np.full(n, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))


def _prefix_sums(data: np.ndarray, powers: _Powers) -> np.ndarray:
    """Hash sums of all prefixes; ``powers`` must have grown to ``len(data)``."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers.up[: len(data)], out=sums[1:])
    return sums


def _grams(sums: np.ndarray, powers: _Powers, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes at every place."""
    return _mixed((sums[gram:] - sums[:-gram]) * powers.down[: len(sums) - gram], 0)


def least_places(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where ``width`` neighbouring values have the least one, the leftmost of equals.

    ``(first, place)``: from each ``first`` up to the next one, windows that begin there share the place.
    """
    least, span = values, 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    last = np.append(first[1:], len(least)) - 1
    least = least[first]
    place = first + width - 1  # a smaller value has just come in
    rise = np.flatnonzero(np.append(True, least[1:] > least[:-1]))  # or the smallest has gone
    around = np.lib.stride_tricks.sliding_window_view(values, width)[first[rise]]
    place[rise] = first[rise] + (around == least[rise, None]).argmax(1)
    tied = np.flatnonzero(last > place)
    if len(tied):  # behind the place, later equals of its value take over one after another
        size = last[tied] - place[tied] + width - 1
        of = np.repeat(tied, size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + place[of] + 1
        equal = values[at] == least[of]
        of, at = of[equal], at[equal]
        begin = np.where(np.append(True, of[1:] != of[:-1]), place[of], np.append(0, at[:-1])) + 1
        used = begin <= last[of]
        first, place = np.append(first, begin[used]), np.append(place, at[used])
        order = np.argsort(first)
        first, place = first[order], place[order]
    return first, place


def runs(data: np.ndarray, ends: np.ndarray, powers: _Powers, length: int = LENGTH, gram: int = GRAM):
    """``(anchor hash, content hash, start, stop)`` of all runs in documents laid end to end.

    ``ends`` are the ends of the documents in ``data``; places count in ``data``.
    """
    n, width = len(data), length - gram + 1
    if n < length:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    powers.grow(n + 1)
    sums = _prefix_sums(data, powers)
    h = _grams(sums, powers, gram)
    first, at = least_places(h, width)
    last = np.append(first[1:], len(h) - width + 1) - 1
    # the windows of a run begin less than a window apart, so only one document can have whole ones
    own = np.searchsorted(ends, last, "right")
    begin = np.maximum(first, (ends - np.diff(ends, prepend=0))[own])
    stop = np.minimum(last + length, ends[own])
    inside = begin + length <= stop
    begin, stop, at = begin[inside], stop[inside], at[inside]
    content = (sums[stop] - sums[begin]) * powers.down[begin]
    shape = ((at - begin) * 1024 + (stop - begin)).astype(np.uint64)
    return h[at], _mixed(content + shape * np.uint64(_INVERSE), 0x51ED270B), begin, stop


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys (first key first), and which rows of it begin a new value of all but the
    last two keys."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        same = np.ones(len(order) - 1, bool)
        for key in keys[:-2]:
            sorted_key = key[order]
            same &= sorted_key[1:] == sorted_key[:-1]
        new[1:] = ~same
    return order, new


def _settle(anchor, content, doc, start) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are the first of their (anchor, content), and which come after it."""
    order, new = _groups(anchor, content, doc, start)
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    first = np.zeros(len(order), bool)
    first[order[new]] = True
    after = np.zeros(len(order), bool)
    after[order] = (doc[order] > doc[head]) | (start[order] > start[head])
    return first, after


# kinds of rows
_OPEN, _COVERED, _DIFFERS, _CROWDED, _SPREAD = range(5)
_ROW = pa.schema(
    [("key", pa.int64()), ("content", pa.int64()), ("doc", pa.int64()), ("tag", pa.int32()),
     ("start", pa.int64()), ("size", pa.int32()), ("kind", pa.int32())]
)
_ROW_SQL = "key long, content long, doc long, tag int, start long, size int, kind int"


def _rows(key, content, doc, tag, start, size, kind) -> pa.RecordBatch:
    columns = [
        np.asarray(key).view(np.int64), np.asarray(content).view(np.int64), doc,
        np.asarray(tag, np.int32), start, np.asarray(size, np.int32), np.asarray(kind, np.int32),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_ROW)


def _buffers(lists, limit: int = BUFFER_BYTES):
    """Row numbers in groups of about ``limit`` bytes; a longer text is a group of its own."""
    group, held = [], 0
    for i, size in enumerate(lists):
        if group and held + size > limit:
            yield group
            group, held = [], 0
        group.append(i)
        held += size
    if group:
        yield group


def _all_runs(docs: DataFrame, length: int) -> DataFrame:
    """Runs of all documents, repeats within a batch settled."""

    def run(batches):
        powers = _Powers()
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            tag = batch.column(1).to_numpy(zero_copy_only=False)
            sizes = [len(v.as_buffer()) if v.is_valid else 0 for v in batch.column(2)]
            found = []
            for group in _buffers(sizes):
                texts = [batch.column(2)[i].as_buffer() for i in group if sizes[i]]
                own = np.array([i for i in group if sizes[i]], np.int64)
                if not len(own):
                    continue
                data = np.frombuffer(b"".join(texts), np.uint8)
                ends = np.cumsum([sizes[i] for i in own])
                key, content, begin, stop = runs(data, ends, powers, length)
                which = np.searchsorted(ends, begin, "right")
                offset = ends[which] - np.array([sizes[i] for i in own])[which]
                row = own[which]
                found.append((key, content, doc[row], tag[row], begin - offset, stop - begin))
            if not found:
                continue
            key, content, of, mark, start, size = map(np.concatenate, zip(*found))
            first, after = _settle(key, content, of, start)
            keep = first | after
            kind = np.where(first, _OPEN, _COVERED)
            yield _rows(*(c[keep] for c in (key, content, of, mark, start, size, kind)))

    return docs.select("doc", "tag", "text").mapInArrow(run, _ROW_SQL)


def _heavy_anchors(docs: DataFrame, length: int, heavy: int, sample: int) -> DataFrame:
    """Anchors with about ``heavy`` runs or more, judged by the documents of the sample."""
    part = docs.filter(F.pmod("tag", F.lit(sample)) == 0)
    counted = _all_runs(part, length).filter(F.col("kind") == _OPEN).groupBy("key")
    return stored(
        counted.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * sample >= heavy).select("key"),
        "heavy",
    )


def _spread_heavy(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """The open runs of heavy anchors marked. Spark broadcasts the anchors only if they are few."""
    named = heavy.select(F.col("key").alias("_key"))
    marked = rows.join(named, F.col("key") == F.col("_key"), "left")
    spread = F.col("_key").isNotNull() & (F.col("kind") == _OPEN)
    return marked.withColumn("kind", F.when(spread, _SPREAD).otherwise(F.col("kind"))).drop("_key")


def _judge_spread(rows: DataFrame, crowded: int) -> DataFrame:
    """Runs whose anchors were spread, now by the number of contents of their anchor."""
    heads = rows.filter(F.col("kind") == _SPREAD)
    # one row per heavy anchor
    counts = heads.groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("_contents"))
    several = counts.filter("_contents > 1")
    kind = F.when(F.col("_contents") > crowded, _CROWDED).otherwise(_DIFFERS)
    judged = heads.join(several, F.col("key") == F.col("_key")).withColumn("kind", kind)
    return rows.filter(F.col("kind") != _SPREAD).union(judged.select(*rows.columns))


def _compare_runs(rows: DataFrame, crowded: int) -> DataFrame:
    """Runs brought together by anchor: what is covered, and what must be looked at.

    Of marked runs the first of every content stay marked.
    """
    spread = (
        F.when(F.col("kind") == _OPEN, F.col("key"))
        .when(F.col("kind") == _SPREAD, F.xxhash64("key", "content"))
        .otherwise(F.xxhash64("doc", "start"))
    )

    def run(batches):
        table = pa.Table.from_batches(list(batches), _ROW)
        if not table.num_rows:
            return
        c = {n: table.column(n).to_numpy() for n in _ROW.names}
        done = c["kind"] == _COVERED
        if done.any():
            yield _rows(*(c[n][done] for n in _ROW.names))
        c = {n: v[~done] for n, v in c.items()}
        first, after = _settle(c["key"], c["content"], c["doc"], c["start"])
        kinds = np.where(after, _COVERED, -1)
        heads = np.flatnonzero(first)
        _, which, counts = np.unique(c["key"][heads], return_inverse=True, return_counts=True)
        contents = counts[which]
        several = heads[contents > 1]
        kinds[several] = np.where(contents[contents > 1] > crowded, _CROWDED, _DIFFERS)
        kinds[heads[c["kind"][heads] == _SPREAD]] = _SPREAD
        keep = kinds >= 0
        c["kind"] = kinds
        yield _rows(*(c[n][keep] for n in _ROW.names))

    names = [f.name for f in _ROW]
    return rows.repartition(spread).mapInArrow(run, _ROW_SQL).select(*names)


def _cut(docs: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """Text of the runs that differ; of crowded anchors the text of every window."""
    wanted = (
        rows.filter(F.col("kind") >= _DIFFERS)
        .groupBy(F.col("doc").alias("_doc"), F.col("tag").alias("_tag"))
        .agg(F.collect_list(F.struct("key", "start", "size", "kind")).alias("runs"))
    )
    joined = docs.join(
        wanted, (F.col("doc") == F.col("_doc")) & (F.col("tag") == F.col("_tag"))
    ).select("doc", "tag", "text", "runs", "doc_id")

    def run(batches):
        powers = _Powers()
        for batch in batches:
            key, cut, doc, tag, start = [], [], [], [], []
            texts = batch.column(2)
            docs_, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, wanted in enumerate(batch.column(3)):
                text = texts[i].as_buffer().to_pybytes()
                for r in wanted.as_py():
                    a, n = r["start"], r["size"]
                    if r["kind"] == _DIFFERS:
                        pieces = [(r["key"], a, n)]
                    else:
                        piece = np.frombuffer(text[a : a + n], np.uint8)
                        powers.grow(n + 1)
                        sums = _prefix_sums(piece, powers)
                        m = n - length + 1
                        h = _mixed((sums[length:] - sums[:m]) * powers.down[:m], 0x2545F491)
                        pieces = [(int(x), a + j, length) for j, x in enumerate(h.view(np.int64))]
                    for k, at, size in pieces:
                        key.append(k)
                        cut.append(text[at : at + size])
                        doc.append(docs_[i])
                        tag.append(tags[i])
                        start.append(at)
            yield from _pieces(key, cut, doc, tag, start)

    return joined.mapInArrow(run, _PIECE_SQL)


_PIECE_SQL = "key long, cut binary, doc long, tag int, start long, kind int"


def _pieces(key, cut, doc, tag, start):
    """One batch of pieces; of equal pieces only the first stays open, later ones are covered."""
    seen: dict[tuple, int] = {}
    kind = [_OPEN] * len(key)
    for i, k in enumerate(zip(key, cut)):
        j = seen.setdefault(k, i)
        if j != i:
            if (doc[i], start[i]) < (doc[j], start[j]):
                seen[k], i, j = i, j, i
            if (doc[i], start[i]) > (doc[j], start[j]):
                kind[i] = _COVERED
    if key:
        yield pa.RecordBatch.from_arrays(
            [pa.array(key, pa.int64()), pa.array(cut, pa.binary()), pa.array(doc, pa.int64()),
             pa.array(tag, pa.int32()), pa.array(start, pa.int64()), pa.array(kind, pa.int32())],
            names=["key", "cut", "doc", "tag", "start", "kind"],
        )


def sorted_suffixes(text: np.ndarray, order: int = 128) -> np.ndarray:
    """Suffixes sorted by their first ``order`` bytes (at least).

    Ranks by eight bytes are doubled; only suffixes that still share a rank are sorted again. Equal
    ones may come in any order: the transform looks at no more than ``order`` bytes.
    """
    n = len(text)
    packed = np.zeros(n + 8, np.uint64)
    packed[:n] = text
    for span in (1, 2, 4):
        packed[:-span] = (packed[:-span] << np.uint64(8 * span)) | packed[span:]
    packed = packed[:n]
    suffixes = np.argsort(packed)
    ordered = packed[suffixes]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(n, np.int64)
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[suffixes] = head
    span = 8
    while span < order:
        shared = ~new
        shared[:-1] |= ~new[1:]
        rows = np.flatnonzero(shared)
        if not len(rows):
            break
        own = suffixes[rows]
        beyond = own + span
        following = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        both = rank[own] * (n + 1) + following  # below 2**63 for any text that fits
        again = np.argsort(both)
        own, both = own[again], both[again]
        suffixes[rows] = own
        new[rows[1:]] |= both[1:] != both[:-1]
        rank[own] = np.maximum.accumulate(np.where(new[rows], rows, 0))
        span *= 2
    return suffixes


def bounded_prefixes(text: np.ndarray, suffixes: np.ndarray, length: int) -> np.ndarray:
    """True where a suffix shares fewer than ``length`` bytes with the one sorted before it.

    Breadth-first over the Burrows-Wheeler transform. At level ``l`` the rows where the common prefix
    ends after exactly ``l`` bytes are known; each begins an interval of rows whose suffixes start with
    the same ``l`` + 1 bytes. Preceded by byte ``c``, the first row with ``c`` in such an interval leads
    by a backward step to the row where the prefix, longer by ``c``, begins to differ.
    Levels are worked off by increasing length and end at ``length``.
    """
    n = len(text)
    before = text[suffixes - 1]  # the transform; the text counts as a ring
    by_byte = np.argsort(before, kind="stable")
    step = np.empty(n, np.int64)  # backward step: where the suffix longer by one byte is sorted
    step[by_byte] = np.arange(n)
    previous = np.full(n, -1, np.int64)  # the row before with the same byte
    same = before[by_byte[1:]] == before[by_byte[:-1]]
    previous[by_byte[1:][same]] = by_byte[:-1][same]
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    new = np.zeros(1, np.int64)
    for _ in range(length):
        if not len(new):
            break
        border = np.flatnonzero(known)
        stop = border[np.searchsorted(border, new, "right")]
        size = stop - new
        offset = np.cumsum(size) - size
        row = np.arange(size.sum()) - np.repeat(offset, size) + np.repeat(new, size)
        begin = np.repeat(new, size)
        found = step[row[previous[row] < begin]]
        found = np.unique(found[~known[found]])
        known[found] = True
        new = found
    return known[:n]


def may_repeat(pieces: list[bytes], anchor: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """``(piece, begin, stop)``: of every piece what may hold a window that another piece has, too.

    Equal windows have their anchor at the same place. All windows that begin at least ``a`` and less than
    ``b`` bytes before it hold the ``length - (b - 1 - a)`` bytes from ``a`` bytes before it on. ``PARTS`` such
    strings stand for all windows of a piece; where no other piece of the anchor has the string,
    those windows occur once. Pieces without their anchor (windows on their own) are kept whole.
    """
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    powers = _Powers()
    powers.grow(len(data) + 1)
    sums = _prefix_sums(data, powers)
    anchor = np.asarray(anchor).view(np.uint64)
    hits = np.flatnonzero(_grams(sums, powers, gram) == np.repeat(anchor, sizes)[: len(data) - gram + 1])
    piece = np.searchsorted(ends, hits, "right")
    inside = hits + gram <= ends[piece]
    piece, which = np.unique(piece[inside], return_index=True)
    at = hits[inside][which]
    edges = np.linspace(0, length - gram + 1, PARTS + 1).astype(np.int64)
    low, high = ends.copy(), begins.copy()
    for a, b in zip(edges[:-1], edges[1:]):
        begin, stop = at - a, at + length - b + 1
        held = (begin >= begins[piece]) & (stop <= ends[piece])
        of, begin, stop = piece[held], begin[held], stop[held]
        content = (sums[stop] - sums[begin]) * powers.down[begin]
        content = _mixed(content, 0x3C6EF372) ^ anchor[of] * np.uint64(_BASE)
        _, group, count = np.unique(content, return_inverse=True, return_counts=True)
        several = count[group] > 1
        of, place = of[several], at[held][several]
        low[of] = np.minimum(low[of], place - b + 1)
        high[of] = np.maximum(high[of], place - a + length)
    alone = np.ones(len(pieces), bool)
    alone[piece] = False
    low = np.where(alone, begins, np.maximum(low, begins))
    high = np.where(alone, ends, np.minimum(high, ends))
    kept = np.flatnonzero(high - low >= length)
    return kept, (low - begins)[kept], (high - begins)[kept]


def repeated_windows(pieces: list[bytes], doc, start, length: int = LENGTH):
    """``(piece, offset)`` of the windows of ``length`` bytes that also start earlier."""
    text = np.frombuffer(b"".join(p + bytes([_GAP]) for p in pieces), np.uint8)
    sizes = np.array([len(p) + 1 for p in pieces], np.int64)
    ends = np.cumsum(sizes)
    suffixes = sorted_suffixes(text, max(128, length))
    begins = bounded_prefixes(text, suffixes, length)
    shared = ~(begins & np.append(begins[1:], True))  # the others have no equal
    group, suffixes = np.cumsum(begins)[shared], suffixes[shared]
    piece = np.repeat(np.arange(len(sizes)), sizes)[suffixes]
    offset = suffixes - (ends - sizes)[piece]
    whole = offset + length < sizes[piece]
    group, piece, offset = group[whole], piece[whole], offset[whole]
    if not len(group):
        return piece, offset
    of, at = np.asarray(doc)[piece], np.asarray(start)[piece] + offset
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(first, append=len(group))
    least = np.repeat(np.minimum.reduceat(of, first), size)  # the document of the first window
    place = np.minimum.reduceat(np.where(of == least, at, np.iinfo(at.dtype).max), first)
    later = (of > least) | (at > np.repeat(place, size))
    return piece[later], offset[later]


def _cover(pieces: DataFrame, length: int) -> DataFrame:
    """``(doc, tag, start, size)``: stretches covered by windows that also start earlier."""
    spread = F.when(F.col("kind") == _OPEN, F.col("key")).otherwise(F.xxhash64("doc", "start"))

    def blocks(table):
        """Rows in blocks of whole anchors of about ``BLOCK_BYTES``."""
        order = np.argsort(table.column("key").to_numpy(), kind="stable")
        key = table.column("key").to_numpy()[order]
        sizes = pc.binary_length(table.column("cut")).to_numpy()[order].tolist()
        begin, held = 0, 0
        for i in range(len(order)):
            held += sizes[i]
            if held >= BLOCK_BYTES and (i + 1 == len(order) or key[i + 1] != key[i]):
                yield order[begin : i + 1]
                begin, held = i + 1, 0
        if begin < len(order):
            yield order[begin:]

    def out(doc, tag, start, size):
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(tag, pa.int32()), pa.array(start, pa.int64()),
             pa.array(size, pa.int32())],
            names=["doc", "tag", "start", "size"],
        )

    def run(batches):
        batches = list(batches)
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        done = table.filter(pc.equal(table.column("kind"), _COVERED))
        if done.num_rows:
            size = pc.binary_length(done.column("cut")).to_numpy()
            yield out(*(done.column(n).to_numpy() for n in ("doc", "tag", "start")), size)
        table = table.filter(pc.equal(table.column("kind"), _OPEN))
        if not table.num_rows:
            return
        key, doc, tag, start = (table.column(n).to_numpy() for n in ("key", "doc", "tag", "start"))
        cuts = table.column("cut").combine_chunks()
        for rows in blocks(table):
            pieces = [cuts[int(i)].as_py() for i in rows]
            which, begin, stop = may_repeat(pieces, key[rows], length)
            if not len(which):
                continue
            pieces = [pieces[i][a:b] for i, a, b in zip(which, begin, stop)]
            rows = rows[which]
            places = start[rows] + begin
            piece, offset = repeated_windows(pieces, doc[rows], places, length)
            if not len(piece):
                continue
            order = np.lexsort((offset, piece))
            piece, offset = piece[order], offset[order]
            new = np.ones(len(piece), bool)  # neighbouring windows are one stretch
            new[1:] = (piece[1:] != piece[:-1]) | (offset[1:] != offset[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(piece)) - 1
            of = piece[first]
            row = rows[of]
            yield out(
                doc[row], tag[row], places[of] + offset[first], offset[last] - offset[first] + length
            )

    return pieces.repartition(spread).mapInArrow(run, "doc long, tag int, start long, size int")


def merged(row: np.ndarray, start: np.ndarray, size: np.ndarray, sizes: np.ndarray):
    """Maximal stretches ``(row, start, stop)``, in order, from ``(row, start, size)`` in any order.

    ``sizes`` are the lengths of the texts of all rows.
    """
    if not len(row):
        return tuple(np.empty(0, np.int64) for _ in range(3))
    shift = np.cumsum(sizes + 1) - (sizes + 1)  # texts end to end, a gap after each
    begin = start + shift[row]
    order = np.argsort(begin)
    begin, row = begin[order], row[order]
    stop = np.maximum.accumulate(begin + size[order])
    first = np.flatnonzero(np.append(True, begin[1:] > stop[:-1]))
    last = np.append(first[1:], len(begin)) - 1
    row = row[first]
    return row, begin[first] - shift[row], stop[last] - shift[row]


def repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    crowded: int = CROWDED,
    heavy: int = HEAVY,
    sample: int = SAMPLE,
) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)`` per row; ``kept`` are the bytes that stay."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    keyed = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"),
        F.pmod(F.xxhash64(text), F.lit(1 << 31)).cast("int").alias("tag"),
        text.alias("text"),
    )
    found = _all_runs(keyed, length)
    anchors = _heavy_anchors(keyed, length, heavy, sample)
    if anchors.isEmpty():
        rows = stored(_compare_runs(found, crowded), "runs")
    else:
        rows = stored(_compare_runs(_spread_heavy(found, anchors), crowded), "runs")
        rows = _judge_spread(rows, crowded)
    covered = rows.filter(F.col("kind") == _COVERED).select("doc", "tag", "start", "size")
    covered = covered.union(_cover(_cut(keyed, rows, length), length))
    per_doc = covered.groupBy(F.col("doc").alias("_doc"), F.col("tag").alias("_tag")).agg(
        F.collect_list(F.struct("start", "size")).alias("stretches")
    )
    # the documents are shuffled by the same columns as in _cut, so Spark reuses that exchange
    joined = keyed.join(
        per_doc, (F.col("doc") == F.col("_doc")) & (F.col("tag") == F.col("_tag")), "left"
    ).select("doc", "tag", "text", "stretches", "doc_id")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            sizes = pc.binary_length(batch.column(2)).to_numpy().astype(np.int64)
            each = pc.fill_null(pc.list_value_length(batch.column(3)), 0).to_numpy()
            found = batch.column(3).flatten()
            start, size = (found.field(n).to_numpy().astype(np.int64) for n in ("start", "size"))
            row, begin, stop = merged(np.repeat(np.arange(len(each)), each), start, size, sizes)
            spans = np.bincount(row, minlength=len(sizes))
            ends = np.cumsum(spans).tolist()
            begin, stop = begin.tolist(), stop.tolist()
            removed, kept, i = [], [], 0
            for text, end in zip(batch.column(2), ends):
                text, at, parts = memoryview(text.as_buffer()), 0, []
                for a, b in zip(begin[i:end], stop[i:end]):
                    parts.append(text[at:a])
                    at = b
                parts.append(text[at:])
                kept.append(b"".join(parts))
                removed.append(len(text) - len(kept[-1]))
                i = end
            yield pa.RecordBatch.from_arrays(
                [batch.column(4), pa.array(sizes), pa.array(removed, pa.int64()),
                 pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return joined.mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
    )
