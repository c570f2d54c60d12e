"""Byte-pair encoding by forced boundaries, and decoding.

A pair of neighbouring byte symbols that occurs inside no vocabulary token can never end
up in one token, whatever the merges do: it is a certain cut. Words are cut at all such
pairs, the fragments are encoded independently and remembered, and the results are put
together. NULL is encoded as the empty text; special tokens written in a text become
their ids, as the tokenizer file asks.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import sys
import types
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

_SPACES = r"\t-\r \x85\xa0  -     　"
#: From this character on (after the Latin ones) a run is left to the library's own splitting.
FIRST_RARE = "\u0250"
#: Fragments, and runs without white space, of each of a worker's two generations.
REMEMBERED = 80_000
#: Fragments up to these lengths are merged together, longer ones one by one.
WIDTHS = (1, 6, 10, 16, 32, 64)


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in plain)
    symbols = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [symbols[b] for b in range(256)]


class Memory:
    """What was worked out before, in two generations: the old one is asked, then dropped.

    Frequent keys move on into the new generation, so they stay; at most twice ``limit``
    entries and those of one call are held.
    """

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def all_of(self, keys: set, work_out) -> dict:
        """A value for every key; ``work_out`` gets the list of unknown ones."""
        if len(self.new) >= self.limit:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        lacking = keys.difference(new)
        for key in lacking.intersection(old):
            new[key] = old[key]
        lacking.difference_update(old)
        if lacking:
            new.update(work_out(list(lacking)))
        return new


class Codec:
    """Encoder and decoder for one tokenizer file with lower-casing and word ends."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"]:
            raise ValueError("a BPE vocabulary with word ends is expected")
        self.end = model["end_of_word_suffix"]
        self.vocab = model["vocab"]
        self.ranks = {}
        for rank, pair in enumerate(model["merges"]):
            self.ranks[tuple(pair if isinstance(pair, list) else pair.split(" "))] = rank
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()}
        self.names |= {i: t for t, i in self.special.items()}
        self.joined = set()
        for token in self.vocab:
            symbols = self._symbols(token)
            self.joined.update(zip(symbols, symbols[1:]))
        pattern = next(
            s["pattern"]["Regex"]
            for s in spec["pre_tokenizer"]["pretokenizers"]
            if s["type"] == "Split"
        )
        self.words = regex.compile(pattern.replace(r"\s", _SPACES))
        self.blanks = regex.compile(f"[{_SPACES}]+")
        self.odd = regex.compile(r"[\x1c-\x1f]")  # white space to str.split() alone
        self.library = Tokenizer.from_str(text)
        self.specials = regex.compile("|".join(map(regex.escape, self.special)))
        self.rank_of = {(self.vocab[a], self.vocab[b]): r for (a, b), r in self.ranks.items()}
        self._tables()
        self.forget()

    def forget(self) -> None:
        self.fragments = Memory(REMEMBERED)  # bytes of a fragment, a blank behind at word ends
        self.known = Memory(REMEMBERED)  # runs without white space

    def _symbols(self, token: str) -> list[str]:
        if not token.endswith(self.end) or token == self.end:
            return list(token)
        body = token[: -len(self.end)]
        return [*body[:-1], body[-1] + self.end]

    def _tables(self) -> None:
        """Arrays for many words at once: which byte pairs may join, and the merges by pair."""
        symbols = _byte_symbols()
        self.of_byte = np.array([self.vocab[x] for x in symbols], np.int64)
        self.of_last = np.array([self.vocab[x + self.end] for x in symbols], np.int64)
        self.to_byte = {x: b for b, x in enumerate(symbols)}
        self.inner = np.zeros((256, 256), bool)
        self.final = np.zeros((256, 256), bool)
        for left, right in self.joined:
            if left in self.to_byte:
                table = self.inner if right in self.to_byte else self.final
                table[self.to_byte[left], self.to_byte[right.removesuffix(self.end)]] = True
        self.width = max(self.vocab.values()) + 1
        pairs = [(self.vocab[a] * self.width + self.vocab[b], r) for (a, b), r in self.ranks.items()]
        keys, ranks = np.array(pairs, np.int64).reshape(-1, 2).T
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], ranks[order].astype(np.int32)
        self.merged = np.array([self.vocab[a + b] for a, b in self.ranks] + [0], np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, ``len(ranks)`` where the pair never merges."""
        none = len(self.ranks)
        pair = left * self.width + right
        at = np.minimum(np.searchsorted(self.pair_keys, pair), len(self.pair_keys) - 1)
        known = (self.pair_keys[at] == pair) & (left >= 0) & (right >= 0)
        return np.where(known, self.pair_ranks[at], none).astype(np.int32)

    def _merge(self, ids: np.ndarray) -> np.ndarray:
        """Rows of ids, padded with -1: the best pair of each row merges, leftmost first, until none is left."""
        none = len(self.ranks)
        out = ids.copy()
        rows = np.arange(len(ids))
        found = self._rank(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = found.argmin(axis=1)
            best = found[np.arange(len(rows)), at]
            going = best < none
            if not going.all():
                out[rows[~going], : ids.shape[1]] = ids[~going]
                out[rows[~going], ids.shape[1] :] = -1
                rows, ids, found, at, best = (x[going] for x in (rows, ids, found, at, best))
                if not len(rows):
                    break
            place = np.arange(len(rows))
            behind = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, behind + (behind > at[:, None]), axis=1)
            ids[place, at] = self.merged[best]
            if ids.shape[1] == 1:
                out[rows, :1], out[rows, 1:] = ids, -1
                break
            behind = behind[:-1]
            found = np.take_along_axis(found, behind + (behind >= at[:, None]), axis=1)
            before, after = at > 0, at < ids.shape[1] - 1
            p, i = place[before], at[before]
            found[p, i - 1] = self._rank(ids[p, i - 1], ids[p, i])
            p, i = place[after], at[after]
            found[p, i] = self._rank(ids[p, i], ids[p, i + 1])
        return out

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same for one long fragment: candidate pairs in a heap, neighbours as links."""
        none, rank = len(self.ranks), self.rank_of
        left, right = list(range(-1, len(ids) - 1)), list(range(1, len(ids) + 1))
        heap = [
            (r, i, a, b)
            for i, (a, b) in enumerate(zip(ids, ids[1:]))
            if (r := rank.get((a, b), none)) < none
        ]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue  # one of the two has merged since
            ids[i], ids[j] = int(self.merged[r]), -1
            right[i] = right[j]
            if right[i] < len(ids):
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < len(ids) and (q := rank.get((ids[x], ids[y]), none)) < none:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def _fragments(self, wanted: list[bytes]) -> dict[bytes, bytes]:
        """Ids of fragments, each encoded by itself; equally wide ones together."""
        out, by_width = {}, {}
        for key in wanted:
            n = len(key) - key.endswith(b" ")
            by_width.setdefault(next((w for w in WIDTHS if n <= w), None), []).append(key)
        for width, keys in by_width.items():
            sizes = np.array([len(k) for k in keys])
            closed = np.array([k.endswith(b" ") for k in keys])
            raw = np.frombuffer(b"".join(keys), np.uint8)
            ends = np.cumsum(sizes)
            ids = self.of_byte[raw]
            lasts = ends[closed] - 2
            ids[lasts] = self.of_last[raw[lasts]]
            blank = np.zeros(len(raw), bool)
            blank[ends[closed] - 1] = True
            ids, sizes = ids[~blank], sizes - closed
            if width is None:
                for key, own in zip(keys, np.split(ids, np.cumsum(sizes)[:-1])):
                    merged = self._merge_long(own.tolist())
                    out[key] = struct.pack(f"<{len(merged)}I", *merged)
                continue
            table = np.full((len(keys), width), -1, np.int64)
            table[np.arange(width) < sizes[:, None]] = ids
            table = self._merge(table) if width > 1 else table
            ends = np.cumsum((table >= 0).sum(axis=1)) * 4
            data = table[table >= 0].astype("<u4").tobytes()
            start = 0
            for key, end in zip(keys, ends.tolist()):
                out[key] = data[start:end]
                start = end
        return out

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Ids of words: cut at impossible pairs, encode each fragment, concatenate."""
        if not words:
            return []
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        joins = np.zeros(len(raw), bool)  # with the byte before
        joins[1:] = self.inner[raw[:-1], raw[1:]]
        last = ends - 1
        inside = last[np.diff(ends, prepend=0) > 1]
        joins[inside] = self.final[raw[inside - 1], raw[inside]]
        joins[0] = False
        joins[ends[:-1]] = False
        starts = np.flatnonzero(~joins)
        parts = np.diff(np.searchsorted(starts, ends), prepend=0).tolist()
        found, at = [], 0
        cuts = [*starts.tolist(), len(raw)]
        data = raw.tobytes()
        for n in parts:
            keys = [data[cuts[i] : cuts[i + 1]] for i in range(at, at + n)]
            keys[-1] += b" "
            found.append(keys)
            at += n
        ids = self.fragments.all_of({k for keys in found for k in keys}, self._fragments)
        return [b"".join([ids[k] for k in keys]) for keys in found]

    def _split(self, chunk: str) -> list[bytes]:
        """Words of a run without white space, as bytes: no word and no normal form reaches beyond it.

        Rarer scripts are normalised and split by the library, whose Unicode tables decide.
        """
        if max(chunk, default="") >= FIRST_RARE:
            chunk = self.library.normalizer.normalize_str(chunk)
            words = self.library.pre_tokenizer.pre_tokenize_str(chunk)
            return [bytes([self.to_byte[c] for c in plain]) for plain, _ in words]
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk)
        return [word.encode() for word in self.words.findall(chunk.lower())]

    def _chunks(self, chunks: list[str | bytes]) -> dict[str | bytes, bytes]:
        """Ids of runs without white space; the ids of a special token are known already."""
        out = {c: c for c in chunks if isinstance(c, bytes)}
        chunks = [c for c in chunks if c not in out] if out else chunks
        split = [self._split(c) for c in chunks]
        distinct = list(dict.fromkeys(w for words in split for w in words))
        ids = dict(zip(distinct, self._words(distinct)))
        for chunk, words in zip(chunks, split):
            out[chunk] = b"".join([ids[w] for w in words]) if len(words) != 1 else ids[words[0]]
        return out

    def _pieces(self, text: str) -> list[str | bytes]:
        """Runs without white space, and the ids of special tokens between them."""
        out, start = [], 0
        for m in self.specials.finditer(text):
            out += self._blank_cut(text[start : m.start()])
            out.append(np.array([self.special[m.group()]], "<u4").tobytes())
            start = m.end()
        last = self._blank_cut(text[start:] if start else text)
        return out + last if out else last

    def _blank_cut(self, text: str) -> list[str]:
        return self.blanks.split(text) if self.odd.search(text) else text.split()

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Per text its token ids as little-endian unsigned 32-bit integers."""
        pieces = [self._pieces(t) if t else [] for t in texts]
        ids = self.known.all_of(set().union(*pieces), self._chunks)
        return [b"".join(map(ids.__getitem__, found)) for found in pieces]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        """The tokens with a space between: the tokenizer file names no decoder."""
        names = self.names
        return " ".join([names[i] for i in ids if i in names])


def _codec(vocabulary: str) -> Codec:
    """The codec of this worker process: what it remembers serves all of its tasks."""
    kept = sys.modules.setdefault("_kept_codecs", types.ModuleType("_kept_codecs")).__dict__
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in kept:
        kept[key] = Codec(vocabulary)
    return kept[key]


def read_vocabulary(path: str) -> str:
    """The tokenizer file, read once on the driver and shipped with the tasks."""
    with open(path, encoding="utf-8") as file:
        return file.read()


#: Rows of a batch worked on at once, and the bytes of text after which a slice ends.
SLICE_ROWS, SLICE_BYTES = 500, 2_000_000


def _slices(batch):
    """Runs of rows of a batch with at most ``SLICE_ROWS`` rows and little more than ``SLICE_BYTES``."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i - start == SLICE_ROWS or (total and total + n > SLICE_BYTES):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _encoded(batches, codec: Codec):
    """Batches of (id, text) as batches of (id, ids)."""
    for batch in batches:
        for part in _slices(batch):
            tokens = [np.frombuffer(x, "<u4") for x in codec.encode_all(part.column(1).to_pylist())]
            ends = np.cumsum([0, *map(len, tokens)])
            if ends[-1] >= 2**31:
                raise ValueError("too many tokens in one batch")
            values = np.concatenate([*tokens, np.empty(0, "<u4")]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["id", "ids"])


def _decoded(batches, codec: Codec):
    """Batches of (id, ids) as batches of (id, ids, text)."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(start, SLICE_ROWS)
            lists = part.column(1)
            text = [codec.decode(x.values.to_numpy().tolist() if x.is_valid else ()) for x in lists]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), lists, pa.array(text, pa.string())], names=["id", "ids", "text"]
            )


def encode(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, ids)`` for every row of ``docs``; ``ids`` is an array of token ids."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        yield from _encoded(batches, _codec(shared.value))

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, ids array<int>"
    )


def decode(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """``(id, ids, text)`` from ``(id, ids)``: the decoded text; unknown ids are left out."""
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        yield from _decoded(batches, _codec(shared.value))

    kind = tokens.schema["id"].dataType.simpleString()
    return tokens.select("id", "ids").mapInArrow(run, f"id {kind}, ids array<int>, text string")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document the number and digest of its tokens and the digest of the decoded text.

    Encodes and decodes in one worker, so ids and texts needn't travel.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def sha(data: bytes) -> str:
        return hashlib.sha256(data).hexdigest()

    def run(batches):
        codec = _codec(shared.value)
        for batch in _decoded(_encoded(batches, codec), codec):
            raw = [np.asarray(x.values.to_numpy(), "<u4") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in raw], pa.int64()),
                    pa.array([sha(x.tobytes()) for x in raw], pa.string()),
                    pa.array([sha(t.as_py().encode()) for t in batch.column(2)], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
