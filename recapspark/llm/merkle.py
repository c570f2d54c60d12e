"""A Merkle manifest of a dataset, built by appends that carry their witnesses along.

Rows become leaves; the leaves of a source, in order, are appended to a tree of runs of
``ARITY`` nodes. An :class:`Appender` keeps one open run per level. What lies below an open
run has a partial witness, which grows when the run is complete: the digests of its siblings
are attached. Sources are cut at aligned positions into blocks of ``ARITY ** LEVELS`` leaves,
each appended by one task. The roots of blocks are nodes like any others: they are appended
block by block again, until one is left, and so are the roots of the sources at last.

Only the digests of a block are ever together in a task; its leaves get their proofs in a
second round, when the witness of the block's own root is known.

Rows with equal keys are ordered by their digest; fully equal rows have equal leaves, so
their order decides nothing but which of them has which place. NULL keys come first. An
empty table has no root and gives no rows.
"""

from __future__ import annotations

import hashlib
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recapspark.operators.storage import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Nodes of a run.
ARITY = 16
#: Levels that one task builds: a block is ``ARITY ** LEVELS`` nodes.
LEVELS = 2

RESULT = ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Steps of a path from a node up; ``top`` marks those among the roots of sources.
_PATH = "array<struct<place:int,rest:string,top:boolean>>"
_STEP = pa.struct([("place", pa.int32()), ("rest", pa.string()), ("top", pa.bool_())])


def digest(*parts: str) -> str:
    """SHA-256 of the parts put together, as hexadecimal text."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Appender:
    """A tree that grows node by node; each node brings the witnesses of the leaves below it.

    A witness is a list of ``(place, rest)`` from the leaf up: the place of the path's node
    in its run and the digests of the others, left to right.
    """

    def __init__(self, arity: int = ARITY):
        self.arity = arity
        self.open: list[tuple[list[str], list[list]]] = []

    def append(self, node: str, witnesses: list[list], level: int = 0) -> None:
        if level == len(self.open):
            self.open.append(([], []))
        nodes, below = self.open[level]
        nodes.append(node)
        below.append(witnesses)
        if len(nodes) == self.arity:
            self._complete(level)

    def _complete(self, level: int) -> None:
        nodes, below = self.open[level]
        self.open[level] = ([], [])
        for place, witnesses in enumerate(below):
            step = (place, "".join(nodes[:place] + nodes[place + 1 :]))
            for witness in witnesses:
                witness.append(step)
        self.append(digest(*nodes), [w for under in below for w in under], level + 1)

    def close(self, height: int) -> str:
        """Complete what is open below ``height`` levels; the one node left there."""
        for level in range(height):
            if level < len(self.open) and self.open[level][0]:
                self._complete(level)
        (root,) = self.open[height][0]
        return root


def height_of(nodes: int, alone: bool) -> int:
    """Levels above the nodes of a block: all of them if it has blocks beside it."""
    height = 0
    while ARITY**height < nodes:
        height += 1
    return height if alone else LEVELS


def grow(nodes: list[str], alone: bool) -> tuple[str, list[list]]:
    """Root of a block and the witness of each of its nodes."""
    tree = Appender()
    witnesses: list[list] = [[] for _ in nodes]
    for node, witness in zip(nodes, witnesses):
        tree.append(node, [witness])
    return tree.close(height_of(len(nodes), alone)), witnesses


def fold(node: str, witness) -> str:
    """The root that a node and its witness lead to."""
    for place, rest in witness:
        cut = place * 64
        node = digest(rest[:cut], node, rest[cut:])
    return node


def field(value: Column) -> Column:
    """A value as leaves hold it: ``-`` if missing, else its bytes in UTF-8, ``:`` and itself."""
    text = value.cast("string")
    sized = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.coalesce(sized, F.lit("-"))


def leaf(*values: Column) -> Column:
    """Digest of a row."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their place (from 0) in the group, NULL first, and its ``total`` rows.

    Rows are sorted by range over the cluster, whatever the group; a group that spans many
    ranges starts in each of them where the ranges before ended.
    """
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = stored(
        rows.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumns({"_part": F.spark_partition_id(), "_row": inside}),
        "numbered",
    )
    pieces = stored(
        ranged.groupBy("_part", *group).agg(
            F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first")
        ),
        "pieces",
    )
    # as many rows per group as ranges it spans
    own = Window.partitionBy(*[F.col(c) for c in group] or [F.lit(0)])
    pieces = pieces.select(
        F.col("_part").alias("_p"),
        *[F.col(c).alias(f"_g_{c}") for c in group],
        F.col("_first"),
        (F.sum("_n").over(own.orderBy("_part")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(own).alias("total"),
    )
    same = F.col("_part") == F.col("_p")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    place = F.col("_before") + F.col("_row") - F.col("_first")
    return ranged.join(pieces, same).select(*rows.columns, place.alias("pos"), "total")


def _blocks(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """Nodes ``(tree, pos, total, node, carried...)`` gathered by aligned blocks, in order.

    A block holds at most ``ARITY ** LEVELS`` nodes; ``alone`` says that its tree has no other.
    """
    size = ARITY**LEVELS
    gathered = nodes.groupBy("tree", F.floor(F.col("pos") / size).cast("long").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "node", *carried))).alias("nodes"),
        F.max("total").alias("total"),
    )
    return stored(gathered.withColumn("alone", F.col("total") <= size), "blocks")


def _rows(batches):
    """Rows of Arrow batches one by one, each with the batch it is alone in."""
    for batch in batches:
        for i in range(batch.num_rows):
            part = batch.slice(i, 1)
            yield part, part.to_pylist()[0]


def _roots(blocks: DataFrame) -> DataFrame:
    """The root of each block, as a node of the next tier."""

    def run(batches):
        for part, row in _rows(batches):
            root, _ = grow(row["nodes"], row["alone"])
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], pa.array([root])], names=["tree", "pos", "total", "node"]
            )

    total = F.ceil(F.col("total") / ARITY**LEVELS).cast("long").alias("total")
    return blocks.select("tree", "block", total, F.col("nodes.node").alias("nodes"), "alone").mapInArrow(
        run, "tree string, pos long, total long, node string"
    )


def _paths(blocks: DataFrame, top: bool) -> DataFrame:
    """``(tree, pos, path)`` of every node: its witness in its block, then that of the block."""

    def run(batches):
        for _, row in _rows(batches):
            nodes = row["nodes"]
            _, witnesses = grow([n["node"] for n in nodes], row["alone"])
            paths = [
                [*({"place": p, "rest": r, "top": top} for p, r in w), *row["above"]]
                for w in witnesses
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["tree"]] * len(nodes), pa.string()),
                    pa.array([n["pos"] for n in nodes], pa.int64()),
                    pa.array(paths, pa.list_(_STEP)),
                ],
                names=["tree", "pos", "path"],
            )

    return blocks.select("tree", "block", "nodes", "alone", "above").mapInArrow(
        run, f"tree string, pos long, path {_PATH}"
    )


def _tiers(nodes: DataFrame, carried: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Blocks tier by tier, until every tree has one node left."""
    tiers = []
    while True:
        tiers.append(_blocks(nodes, [] if tiers else carried))
        nodes = stored(_roots(tiers[-1]), "roots")
        if nodes.filter("total > 1").isEmpty():
            return tiers, nodes


def _above(tier: DataFrame, paths: DataFrame) -> DataFrame:
    """Blocks of a tier with the path of their root, ``above``."""
    paths = paths.select(F.col("tree").alias("_t"), F.col("pos").alias("_p"), F.col("path").alias("above"))
    same = (F.col("tree") == F.col("_t")) & (F.col("block") == F.col("_p"))
    return tier.join(paths, same).drop("_t", "_p")


def manifest(rows: DataFrame, source: Column, key: Column, leaf_of: Column, seen: Column) -> DataFrame:
    """Leaves, roots and checked proofs of all rows.

    ``source`` names the tree of a row, ``key`` its order therein, ``leaf_of`` is its leaf
    in the manifest and ``seen`` the leaf as it is found now. Returns per row ``key``,
    ``leaf``, ``subroot`` (of its source), ``root``, ``proof_sha256`` (digest of all siblings from
    the leaf's run to the root), ``folded_root`` (from ``seen`` and these siblings) and ``verified``.
    """
    # a text that tells NULL from every name and sorts before all of them
    tree = F.coalesce(F.concat(F.lit("="), source), F.lit("-"))
    # stored first: sorting by range reads its input twice
    leaves = stored(
        rows.select(tree.alias("tree"), key.alias("key"), leaf_of.alias("node"), seen.alias("seen")),
        "leaves",
    )
    kind = leaves.schema["key"].dataType.simpleString()
    tiers, subroots = _tiers(numbered(leaves, ["tree"], ["key", "node"]), ["key", "seen"])
    ordered = numbered(subroots.select(F.col("tree").alias("name"), "node"), [], ["name"])
    ordered = stored(ordered.withColumn("tree", F.lit("")), "subroots")
    top, root = _tiers(ordered, [])

    start = F.lit(0).cast("long").alias("pos")
    paths = root.select("tree", start, F.array().cast(_PATH).alias("path"))
    for tier in reversed(top):
        paths = stored(_paths(_above(tier, paths), True), "paths")
    place = paths.select(F.col("pos").alias("_pos"), "path")
    paths = ordered.join(place, F.col("pos") == F.col("_pos"))
    paths = paths.select(F.col("name").alias("tree"), start, "path")
    for tier in reversed(tiers[1:]):
        paths = stored(_paths(_above(tier, paths), False), "paths")
    return _proofs(_above(tiers[0], paths), kind)


def _proofs(blocks: DataFrame, kind: str) -> DataFrame:
    """The rows of each block with their proofs."""

    def run(batches):
        for part, row in _rows(batches):
            nodes = row["nodes"]
            top, witnesses = grow(nodes, row["alone"])
            above = [(s["place"], s["rest"]) for s in row["above"]]
            subroot = fold(top, [(s["place"], s["rest"]) for s in row["above"] if not s["top"]])
            root = fold(top, above)
            rest = "".join(r for _, r in above)
            proofs = [digest(*[r for _, r in w], rest) for w in witnesses]
            folded = [fold(fold(now, w), above) for now, w in zip(row["seen"], witnesses)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0)[0].values,
                    pa.array(nodes, pa.string()),
                    pa.array([subroot] * len(nodes), pa.string()),
                    pa.array([root] * len(nodes), pa.string()),
                    pa.array(proofs, pa.string()),
                    pa.array(folded, pa.string()),
                    pa.array([f == root for f in folded], pa.bool_()),
                ],
                names=RESULT,
            )

    names = ", ".join(f"{n} string" for n in RESULT[1:-1])
    return blocks.select(
        F.col("nodes.key").alias("keys"),
        F.col("nodes.node").alias("nodes"),
        F.col("nodes.seen").alias("seen"),
        "alone",
        "above",
    ).mapInArrow(run, f"key {kind}, {names}, verified boolean")


def lowered(text: Column) -> Column:
    """``text`` with A-Z as small letters; other characters and NULL stay."""
    return F.translate(text, _UPPER, _LOWER)


def tampered(doc_id: Column, part: int = 5) -> Column:
    """Whether ``part`` divides the checksum of the decimal id; never for a missing id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(part)) == 0, F.lit(False))


def documents_manifest(docs: DataFrame) -> DataFrame:
    """:func:`manifest` of documents, found again with some texts in small letters.

    Columns beyond the five of a document are not part of a leaf.
    """
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    whole = leaf(*[F.col(c) for c in columns])
    changed = leaf(*[F.col(c) for c in columns[:-1]], lowered(F.col("text")))
    seen = F.when(tampered(F.col("doc_id")), changed).otherwise(whole)
    found = manifest(docs.select(*columns), F.col("source"), F.col("doc_id"), whole, seen)
    return found.withColumnRenamed("key", "doc_id")
