"""Near-duplicate embeddings by navigable small-world graphs per shard.

Different vectors are dealt to shards by a hash. Each shard gets a hierarchical graph; every vector
queries every shard. The beam of a shard is widened until an audit against brute force, with
queries as far from its vectors as a link may be, finds enough of their links, and for a single
query while its beam holds nothing but links. A shard is only scanned if its graph failed the audit with
every beam; rows tell recall, beam and scan of their shard. What is found is verified by the cosine in double precision, and linked
vectors are united.

Vectors that are NULL or zero, or hold NULL or non-finite components, and rows without
id link with nothing. Vectors of different widths never link. Equal vectors are one node with a
count, so copies cost nothing; a row's copies count among its links. Rows with equal id
and unequal vectors are one node: their links are added up. No rows in, no rows out.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recapspark.llm.components import connected_components
from recapspark.operators.storage import stored

LEAST_COSINE = 0.95
SHARDS = 8  # as soon as each has ``LEAST_ROWS``
LEAST_ROWS = 2_000
SHARD_ROWS = 250_000  # about, at most
SHARD_BYTES = 64 << 20  # of a shard's vectors and links, about, at most
BLOCK_ROWS = 20_000  # queries a task sends to one shard, about; as many as a shard has, if more
QUERY_ROWS = 8_192  # of these at once
PAIR_ROWS = 20_000  # pairs verified at once
SEARCH_BYTES = 64 << 20  # of one search, about
SPREAD_ROWS = 1_024  # nodes whose links are chosen at once
LINKS = 16  # per node and layer; twice that on the lowest
BUILD_BEAM = 48
BEAM = 24
AUDIT_ROWS = 256
RECALL = 0.98
BATCH = 256
_SLACK = 1e-4  # single precision search; the double precision check follows


def _top(ids, scores, n):
    """The ``n`` best of every row, best first; ids of -1 are padding with score -inf."""
    if ids.shape[1] > n:
        part = np.argpartition(-scores, n - 1, axis=1)[:, :n]
        ids, scores = np.take_along_axis(ids, part, 1), np.take_along_axis(scores, part, 1)
    order = np.argsort(-scores, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def _vectors(x, ids):
    """Vectors of a table of ids; padding gets some vector."""
    flat = np.take(x, ids.ravel(), axis=0, mode="clip")
    return flat.reshape(*ids.shape, x.shape[1])


def _scores(x, queries, ids):
    found = np.matmul(_vectors(x, ids), queries[:, :, None])[:, :, 0]
    found[ids < 0] = -np.inf
    return found


def _without_repeats(ids, scores):
    """Repeats within a row become padding."""
    order = np.argsort(ids, axis=1, kind="stable")
    ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
    again = np.zeros(ids.shape, bool)
    again[:, 1:] = ids[:, 1:] == ids[:, :-1]
    ids[again], scores[again] = -1, -np.inf
    return ids, scores


def search(x, links, queries, entries, beam, expand=4):
    """Beam search of many queries in step: ``(ids, scores)``, best first."""
    n_queries, n = len(queries), len(x)
    seen = np.zeros((n_queries, n), bool)
    row = np.arange(n_queries)[:, None]
    seen[row, np.maximum(entries, 0)] = True
    ids, scores = _top(*_without_repeats(entries, _scores(x, queries, entries)), beam)
    if ids.shape[1] < beam:
        pad = ((0, 0), (0, beam - ids.shape[1]))
        ids = np.pad(ids, pad, constant_values=-1)
        scores = np.pad(scores, pad, constant_values=-np.inf)
    done = ids < 0
    active = np.arange(n_queries)
    while len(active):
        own_ids, own_scores, own_done = ids[active], scores[active], done[active]
        open_scores = np.where(own_done, -np.inf, own_scores)
        k = min(expand, beam)
        best = np.argpartition(-open_scores, k - 1, axis=1)[:, :k]
        is_open = np.take_along_axis(open_scores, best, 1) > -np.inf
        some = is_open.any(1)
        if not some.all():
            active = active[some]
            continue
        np.put_along_axis(own_done, best, True, 1)
        nodes = np.where(is_open, np.take_along_axis(own_ids, best, 1), -1)
        near = links[np.maximum(nodes, 0)]
        near[nodes < 0] = -1
        near = near.reshape(len(active), -1)
        near[seen[active[:, None], np.maximum(near, 0)]] = -1
        width = int((near >= 0).sum(1).max(initial=0))
        if width:
            near = -np.sort(-near, axis=1)[:, :width]
            again = np.zeros(near.shape, bool)
            again[:, 1:] = near[:, 1:] == near[:, :-1]
            near[again] = -1
            seen[active[:, None], np.maximum(near, 0)] |= near >= 0
            own_ids = np.concatenate([own_ids, near], 1)
            own_scores = np.concatenate([own_scores, _scores(x, queries[active], near)], 1)
            own_done = np.concatenate([own_done, near < 0], 1)
            part = np.argpartition(-own_scores, beam - 1, axis=1)[:, :beam]
            own_ids = np.take_along_axis(own_ids, part, 1)
            own_scores = np.take_along_axis(own_scores, part, 1)
            own_done = np.take_along_axis(own_done, part, 1)
        ids[active], scores[active], done[active] = own_ids, own_scores, own_done
    return _top(ids, scores, beam)


def _spread_links(x, ids, scores, m):
    """:func:`_spread`, some nodes at a time: the candidates of all would take much memory."""
    if len(ids) <= SPREAD_ROWS:
        return _spread(x, ids, scores, m)
    starts = range(0, len(ids), SPREAD_ROWS)
    return np.concatenate(
        [_spread(x, ids[i : i + SPREAD_ROWS], scores[i : i + SPREAD_ROWS], m) for i in starts]
    )


def _spread(x, ids, scores, m):
    """Of candidates, best first, those nearer to the node than to any chosen one; filled up with the best."""
    ids, scores = _top(ids, scores, min(ids.shape[1], 3 * m))
    vectors = _vectors(x, ids)
    between = np.matmul(vectors, vectors.transpose(0, 2, 1))
    chosen = np.zeros(ids.shape, bool)
    count = np.zeros(len(ids), int)
    for j in range(ids.shape[1]):
        nearest = np.where(chosen, between[:, j], -np.inf).max(1)
        take = (ids[:, j] >= 0) & (scores[:, j] > nearest) & (count < m)
        chosen[:, j] = take
        count += take
    rank = np.where(chosen, 1e3, 0) + scores
    rank[ids < 0] = -np.inf
    best, rank = _top(ids, rank, m)
    best[rank == -np.inf] = -1
    if best.shape[1] < m:
        best = np.pad(best, ((0, 0), (0, m - best.shape[1])), constant_values=-1)
    return best


def _insert(x, links, batch, candidates, scores):
    """Link a batch of new nodes and link back; full lists keep their most spread links."""
    m = links.shape[1]
    links[batch] = _spread_links(x, candidates, scores, m)
    to = links[batch].ravel()
    source = np.repeat(batch, m)
    source, to = source[to >= 0], to[to >= 0]
    order = np.argsort(to, kind="stable")
    source, to = source[order], to[order]
    nodes, first, count = np.unique(to, return_index=True, return_counts=True)
    width = int(min(count.max(initial=0), 2 * m))
    if not width:
        return
    place = np.arange(len(to)) - np.repeat(first, count)
    fits = place < width
    extra = np.full((len(nodes), width), -1, links.dtype)
    extra[np.repeat(np.arange(len(nodes)), count)[fits], place[fits]] = source[fits]
    both = np.concatenate([links[nodes], extra], 1)
    both, own = _without_repeats(both, _scores(x, x[nodes], both))
    links[nodes] = _spread_links(x, both, own, m)


class Graph:
    """Layers of links over the unit vectors ``x``; the highest layer is small."""

    def __init__(self, x: np.ndarray, seed: int = 1):
        self.x, n = x, len(x)
        self.searches = 0  # queries answered by the graph
        draw = np.random.default_rng(seed).random(n)
        level = np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(LINKS)).astype(int)
        order = np.argsort(-level, kind="stable")
        height = int(level.max(initial=0))
        while height > 0 and (level >= height).sum() < LINKS:
            height -= 1
        self.layers: list[np.ndarray] = []  # from the highest to the lowest
        inserted = 0
        for layer in range(height, -1, -1):
            m = 2 * LINKS if layer == 0 else LINKS
            links = np.full((n, m), -1, np.int32)
            if self.layers:
                links[:, :LINKS] = self.layers[-1]
            members = order[: int((level >= layer).sum())]
            while inserted < len(members):
                size = max(1, min(BATCH, inserted)) if inserted >= LINKS else LINKS
                batch = members[inserted : inserted + size]
                if inserted:
                    queries = x[batch]
                    ids, scores = search(x, links, queries, self._entries(queries, order), BUILD_BEAM)
                else:
                    ids = np.empty((len(batch), 0), np.int32)
                    scores = np.empty((len(batch), 0), x.dtype)
                among = x[batch] @ x[batch].T
                np.fill_diagonal(among, -np.inf)
                peers = np.broadcast_to(batch.astype(np.int32), among.shape).copy()
                np.fill_diagonal(peers, -1)
                peers, among = _top(peers, among, min(len(batch), BUILD_BEAM))
                _insert(
                    x, links, batch,
                    np.concatenate([ids, peers], 1).astype(np.int32),
                    np.concatenate([scores, among], 1),
                )
                inserted += len(batch)
            self.layers.append(links)
        self.start = order[:LINKS].astype(np.int32)

    def _entries(self, queries, order=None):
        """Where to enter the layer below those that are finished."""
        start = self.start if order is None else order[:LINKS].astype(np.int32)
        entries = np.broadcast_to(start, (len(queries), len(start))).copy()
        entries, _ = _top(entries, _scores(self.x, queries, entries), 4)
        upper = self.layers if order is not None else self.layers[:-1]
        for links in upper:
            entries, _ = search(self.x, links, queries, entries, 4, 2)
        return entries

    def _batch(self, beam: int) -> int:
        """Queries of one search: each marks the nodes seen and holds a beam several times over."""
        return max(1, min(BATCH, SEARCH_BYTES // (len(self.x) + 32 * beam)))

    def near(self, queries, beam):
        return search(self.x, self.layers[-1], queries, self._entries(queries), beam)

    def links_of(self, queries, beam, least, scan=False):
        """``(query, node)`` of all pairs found at ``least`` or nearer.

        Every query goes through the graph. Beams that end among links are doubled; a beam that
        would then see much of the shard becomes a scan, for those queries alone. ``scan`` is for
        shards whose graph did not pass its audit.
        """
        n = len(self.x)
        todo, found = np.arange(len(queries)), []
        while len(todo):
            again, size = [], self._batch(beam)
            for i in range(0, len(todo), size):
                rows = todo[i : i + size]
                if scan:
                    q, node = np.nonzero(queries[rows] @ self.x.T >= least)
                    found.append((rows[q], node))
                    continue
                ids, scores = self.near(queries[rows], beam)
                self.searches += len(rows)
                whole = scores[:, -1] < least
                q, place = np.nonzero((scores >= least) & whole[:, None])
                found.append((rows[q], ids[q, place]))
                again.append(rows[~whole])
            todo = np.concatenate(again) if again else todo[:0]
            beam *= 2
            scan = beam * LINKS >= n
        q, node = (np.concatenate(c) for c in zip(*found)) if found else (todo, todo)
        return q.astype(np.int64), node.astype(np.int64)

    def audited_beam(self, least: float, beam: int = BEAM) -> tuple[int, float, bool]:
        """The beam with which the graph finds ``RECALL`` of links, its recall, and whether to scan.

        Queries lie as far from some vectors of the shard as a link may be, in random directions:
        the hardest links, and every shard has them. Only where no beam short of the whole shard
        does, the shard is to be scanned.
        """
        n = len(self.x)
        rng = np.random.default_rng(2)
        own = self.x[rng.permutation(n)[:AUDIT_ROWS]]
        aside = rng.standard_normal(own.shape).astype(own.dtype)
        aside -= (aside * own).sum(1, keepdims=True) * own
        aside /= np.maximum(np.sqrt((aside * aside).sum(1, keepdims=True)), 1e-12)
        cosine = min(1.0, least + _SLACK)
        queries = cosine * own + np.sqrt(1 - cosine * cosine) * aside
        while True:
            found, of = 0, 0
            size = self._batch(beam)
            for i in range(0, len(queries), size):
                part = queries[i : i + size]
                truth = part @ self.x.T >= least
                ids, scores = self.near(part, beam)
                hit = np.zeros(truth.shape, bool)
                q, place = np.nonzero(scores >= least)
                hit[q, ids[q, place]] = True
                # a beam full of links is widened for its query alone, so it misses nothing
                hit[scores[:, -1] >= least] = True
                found, of = found + int((hit & truth).sum()), of + int(truth.sum())
            recall = found / max(1, of)
            if recall >= RECALL or beam >= n:
                return beam, recall, recall < RECALL
            beam *= 2


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)  # no overflow in the squares
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in single precision; in doubles only some rows at a time."""
    out = np.empty(vectors.shape, np.float32)
    for i in range(0, len(vectors), QUERY_ROWS):
        out[i : i + QUERY_ROWS] = unit(vectors[i : i + QUERY_ROWS])
    return out


def _table(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as the rows of a table."""
    flat = column.combine_chunks().flatten().to_numpy()
    return flat.reshape(len(column), -1)


def _packed(links: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """A layer without the nodes that have no link in it."""
    rows = np.flatnonzero((links >= 0).any(1)).astype(np.int32)
    return len(links), rows, links[rows]


def _unpacked(n: int, rows: np.ndarray, own: np.ndarray) -> np.ndarray:
    links = np.full((n, own.shape[1]), -1, np.int32)
    links[rows] = own
    return links


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edges with the same components: every node to the smallest it reaches."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def build(nodes: DataFrame, least: float) -> DataFrame:
    """``(width, shard, recall, beam, scan, graph)``: one serialised graph per shard, audited."""

    def run(key, table):
        own = table.column("node").to_numpy()
        order = np.argsort(own)
        vectors = _table(table.column("embedding"))[order]
        graph = Graph(units(vectors))
        beam, recall, scan = graph.audited_beam(least - _SLACK)
        data = pickle.dumps(
            {"vectors": vectors, "node": own[order], "n": table.column("n").to_numpy()[order],
             "layers": [_packed(x) for x in graph.layers], "start": graph.start, "beam": beam, "scan": scan}
        )
        return pa.table(
            {"width": [key[0].as_py()], "shard": [key[1].as_py()], "recall": [recall],
             "beam": [beam], "scan": [scan], "graph": pa.array([data], pa.binary())},
            schema=pa.schema([("width", pa.int32()), ("shard", pa.int32()), ("recall", pa.float64()),
                              ("beam", pa.int32()), ("scan", pa.bool_()), ("graph", pa.binary())]),
        )

    return nodes.groupBy("width", "shard").applyInArrow(
        run, "width int, shard int, recall double, beam int, scan boolean, graph binary"
    )


def query(graphs: DataFrame, nodes: DataFrame, blocks: int, shards: int, least: float) -> DataFrame:
    """``(a, b, links)``: links counted per vector ``a`` (``b`` NULL), and edges that span them."""

    def run(key, graph, queries):
        empty = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])
        if not graph.num_rows or not queries.num_rows:
            return empty.empty_table()
        parts = pickle.loads(graph.column("graph")[0].as_buffer())
        index = Graph.__new__(Graph)
        index.x = units(parts["vectors"])
        index.layers = [_unpacked(*x) for x in parts["layers"]]
        index.start, index.searches = parts["start"], 0
        every = _table(queries.column("embedding"))
        ids = queries.column("node").to_numpy()
        links = np.zeros(len(ids), np.int64)
        edges = [np.empty((2, 0), np.int64)]
        for start in range(0, len(ids), QUERY_ROWS):
            vectors, own = unit(every[start : start + QUERY_ROWS]), ids[start : start + QUERY_ROWS]
            q, node = index.links_of(
                vectors.astype(np.float32), parts["beam"], least - _SLACK, parts["scan"]
            )
            true = np.ones(len(q), bool)
            for i in range(0, len(q), PAIR_ROWS):
                part = slice(i, i + PAIR_ROWS)
                cosine = np.einsum("ij,ij->i", vectors[q[part]], unit(parts["vectors"][node[part]]))
                true[part] = cosine >= least
            q, node = q[true], node[true]
            other = own[q] != parts["node"][node]
            q, node = q[other], node[other]
            counts = np.bincount(q, weights=parts["n"][node], minlength=len(own))
            links[start : start + QUERY_ROWS] = counts
            edges.append(np.stack(spanning(own[q], parts["node"][node])))
        some = np.flatnonzero(links)
        a, b = spanning(*np.concatenate(edges, 1))
        none = pa.nulls(len(some), pa.int64())
        return pa.table(
            {"a": pa.concat_arrays([pa.array(ids[some]), pa.array(a)]),
             "b": pa.concat_arrays([none, pa.array(b)]),
             "links": pa.concat_arrays([pa.array(links[some]), pa.nulls(len(a), pa.int64())])},
            schema=empty,
        )

    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    graphs = graphs.select("width", "shard", "graph", every_block)
    block = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(blocks)).cast("int").alias("block")
    queries = nodes.select("width", "node", "embedding", block, every_shard)
    keys = ["width", "shard", "block"]
    return graphs.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(
        run, "a long, b long, links long"
    )


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    least: float = LEAST_COSINE,
    shards: int = SHARDS,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``(id, n_links, component, recall, beam, scanned)`` for every row of ``vectors``.

    The last three tell how the graph of the row's shard did in its audit; NULL for rows in none.
    """
    exact = vectors.schema[vector_col].dataType.simpleString() == "array<double>"
    kind = "array<double>" if exact else "array<float>"
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("embedding")
    )
    finite = F.forall("embedding", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    valid = F.coalesce(
        F.col("id").isNotNull() & finite & F.exists("embedding", lambda c: c != 0), F.lit(False)
    )
    rows = rows.select("id", F.when(valid, F.col("embedding")).alias("embedding"))
    good = rows.filter(F.col("embedding").isNotNull())
    nodes = good.groupBy("embedding").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n"))
    nodes = stored(nodes, "vectors")
    n = nodes.count()
    width = nodes.agg(F.max(F.size("embedding"))).first()[0] or 1
    size = 8 if exact else 4
    shard_rows = max(1, min(shard_rows, SHARD_BYTES // ((size + 4) * width + 8 * LINKS)))
    shards = max(min(shards, n // LEAST_ROWS), -(-n // shard_rows), 1)
    # blocks grow no faster than shards, or copies of the graphs would grow with the square of the rows
    blocks = max(1, -(-n // max(BLOCK_ROWS, -(-n // shards))))
    shard = F.pmod(F.xxhash64("embedding", F.lit(11)), F.lit(shards)).cast("int")
    nodes = nodes.withColumn("shard", shard).withColumn("width", F.size("embedding"))
    graphs = stored(build(nodes, least), "graphs")
    found = stored(query(graphs, nodes, blocks, shards, least), "links")
    links = found.filter(F.col("b").isNull()).groupBy("a").agg(F.sum("links").alias("links"))
    reached = connected_components(found.filter(F.col("b").isNotNull()).select("a", "b"))
    facts = (
        nodes.select("embedding", "node", "n", "width", "shard")
        .join(graphs.select("width", "shard", "recall", "beam", "scan"), ["width", "shard"])
        .join(links, F.col("node") == F.col("a"), "left")
        .join(reached.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
        .select(
            F.col("embedding").alias("_embedding"),
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("root", "node").alias("component"),
            "recall",
            "beam",
            F.col("scan").alias("scanned"),
        )
    )
    facts = stored(facts, "facts")
    return rows.join(facts, F.col("embedding") == F.col("_embedding"), "left").select(
        "id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component"),
        "recall",
        "beam",
        "scanned",
    )
