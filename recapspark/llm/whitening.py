"""Whitened embeddings: principal directions to double precision, scaled to unit variance.

Entries become integers, so sums and the covariance are exact whatever the partitioning: every
task adds up products of centred integers in pieces that fit a double, and Spark sums them
as decimals. The eigenvectors of the small covariance are found in single precision and then
corrected by the iteration of Ogita and Aishima, which consists of matrix products, here in
extended precision. Where eigenvalues lie closer than the iteration can tell apart, the space they
span is exact already; the covariance restricted to it, less its mean eigenvalue, is solved
by itself in the same way, at its own scale.

Rows whose vector is NULL, empty, or holds a NULL or non-finite entry, or one whose integer
leaves 2**62, are left out. Vectors of another length than that of most rows (the longer one on a tie)
can't share a covariance with them and are left out as well. Directions without variance can't
be scaled and are not components. Equal rows count each; their order plays no role. A
deviation beyond a long is NULL. No rows are left of an empty table; further columns are ignored.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recapspark.operators.storage import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What an entry is multiplied by before it is floored, and what is added then.
SCALE, SHIFT = 64, 1_000_000
#: Components returned at most.
COMPONENTS = 32
#: Longest vectors: their covariance is solved on the driver.
MAX_LENGTH = 4096
_LIMIT = float(2**62)
#: Bits of a limb and rows of a block: products of limbs add up below 2**53.
_BITS, _ROWS = 20, 4096
_Wide = np.longdouble


def integers(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, x)``: vectors as arrays of longs, those that have any."""
    c = F.col("_v")
    scaled = F.transform(c, lambda e: F.floor(e.cast("double") * SCALE))
    fine = F.forall(
        c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) * SCALE < _LIMIT)
    )
    return (
        vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("_v"))
        .filter(F.coalesce(fine & (F.size(c) > 0), F.lit(False)))
        .select("id", F.transform(scaled, lambda e: e.cast("long") + SHIFT).alias("x"))
    )


def _matrix(lists: pa.Array, length: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


@dataclass(frozen=True)
class Moments:
    """Number of vectors, exact sums per entry, and the extent of the entries."""

    n: int
    length: int
    sums: list[int]
    low: int
    high: int

    @property
    def reach(self) -> int:
        """No entry of ``n * x - sums`` is larger."""
        far = max(abs(self.n * self.low - s) for s in self.sums)
        return max(far, *(abs(self.n * self.high - s) for s in self.sums))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, exactly: longs where they fit, else Python integers."""
        if self.n * max(abs(self.low), abs(self.high)) >= 2**62 or self.reach >= 2**62:
            return x.astype(object) * self.n - np.array(self.sums, object)
        return x * self.n - np.array(self.sums, np.int64)


def moments(rows: DataFrame, length: int) -> Moments:
    """Exact sums of ``x``: each task adds its rows up, Spark adds the tasks up."""

    def run(batches):
        total, n, low, high = [0] * length, 0, None, None
        for batch in batches:
            x = _matrix(batch.column(0), length)
            if len(x):
                # two halves, so that no sum of a batch leaves a long
                big, small = (x >> 31).sum(axis=0), (x & (2**31 - 1)).sum(axis=0)
                total = [t + (int(b) << 31) + int(s) for t, b, s in zip(total, big, small)]
                n += len(x)
                low = min(int(x.min()), low if low is not None else int(x.min()))
                high = max(int(x.max()), high if high is not None else int(x.max()))
        if n:
            yield pa.RecordBatch.from_pydict(
                {
                    "i": pa.array(range(length), pa.int32()),
                    "n": pa.array([n] * length, pa.int64()),
                    "total": pa.array([str(t) for t in total]),
                    "low": pa.array([low] * length, pa.int64()),
                    "high": pa.array([high] * length, pa.int64()),
                }
            )

    parts = rows.select("x").mapInArrow(run, "i int, n long, total string, low long, high long")
    summed = parts.groupBy("i").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )
    found = summed.orderBy("i").collect()  # one row per entry of a vector
    return Moments(
        found[0]["n"],
        length,
        [int(r["total"]) for r in found],
        min(r["low"] for r in found),
        max(r["high"] for r in found),
    )


def _limbs(x: np.ndarray, reach: int) -> list[np.ndarray]:
    """Integers as sums of doubles times powers of ``2 ** _BITS``; all exact."""
    out = []
    while True:
        if reach < 2 ** (_BITS - 1) or len(out) > 12:
            return [*out, x.astype(np.float64)]
        low = x & (2**_BITS - 1)
        out.append(low.astype(np.float64))
        x, reach = x >> _BITS, reach >> _BITS


def products(x: np.ndarray, reach: int) -> np.ndarray:
    """``x.T @ x`` of integers as Python integers, from exact products of doubles."""
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for start in range(0, len(x), _ROWS):
        limbs = _limbs(x[start : start + _ROWS], reach)
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs[: i + 1]):
                part = (a.T @ b).astype(np.int64).astype(object)
                total += (part if i == j else part + part.T) * (1 << _BITS * (i + j))
    return total


def covariance(rows: DataFrame, m: Moments) -> np.ndarray:
    """The covariance of ``x`` with divisor ``n``, in extended precision.

    Sums of centred products are exact decimals; only if they may leave 38 digits they are
    added as doubles.
    """
    length, exact = m.length, m.n * m.reach**2 < 10**37
    upper = np.triu_indices(length)

    def run(batches):
        total = None
        for batch in batches:
            x = _matrix(batch.column(0), length)
            for start in range(0, len(x), _ROWS):
                d = m.centred(x[start : start + _ROWS])
                if exact:
                    part = products(d, m.reach)[upper]
                else:
                    d = (d / m.n).astype(np.float64)
                    part = (d.T @ d)[upper]
                total = part if total is None else total + part
        if total is not None:
            value = [str(v) if exact else repr(float(v)) for v in total]
            yield pa.RecordBatch.from_pydict(
                {
                    "i": pa.array(upper[0], pa.int32()),
                    "j": pa.array(upper[1], pa.int32()),
                    "value": pa.array(value, pa.string()),
                }
            )

    parts = rows.select("x").mapInArrow(run, "i int, j int, value string")
    kind = "decimal(38,0)" if exact else "double"
    summed = parts.groupBy("i", "j").agg(F.sum(F.col("value").cast(kind)).alias("value"))
    out = np.zeros((length, length), _Wide)
    divisor = m.n**3 if exact else m.n
    for r in summed.collect():  # length squared
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = _ratio(r["value"], divisor)
    return out


def _ratio(value, divisor: int):
    """A quotient of integers to extended precision."""
    if isinstance(value, float):
        return _Wide(value) / _Wide(divisor)
    whole, rest = divmod(int(value), divisor)
    return _wide(whole) + _wide((rest << 80) // divisor) / _Wide(2) ** 80


def _wide(value: int):
    """An integer as an extended float, by its digits of 32 bits."""
    out, sign = _Wide(0), -1 if value < 0 else 1
    value, scale = abs(value), _Wide(1)
    while value:
        out += _Wide(value & 0xFFFFFFFF) * scale
        value, scale = value >> 32, scale * _Wide(2**32)
    return sign * out


def _norm(a: np.ndarray) -> float:
    """Largest singular value; of tiny entries too."""
    most = np.abs(a).max()
    return float(most) * float(np.linalg.norm((a / most).astype(np.float64), 2)) if most > 0 else 0.0


def _orthonormal(x: np.ndarray) -> np.ndarray:
    """Columns that are nearly orthonormal, made so by matrix products."""
    eye = np.eye(x.shape[1], dtype=_Wide)
    for _ in range(8):
        r = eye - x.T @ x
        x = x + x @ (r / 2)
        if np.abs(r).max() < 1e-10:  # the step squares it
            break
    return x


def refined(a: np.ndarray, x: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, float]:
    """Ogita and Aishima's correction of approximate eigenvectors ``x`` of ``a``.

    Returns eigenvalues, vectors and the gap below which eigenvalues could not be told apart.
    """
    eye = np.eye(len(a), dtype=_Wide)
    size = _norm(a)
    least, idle = np.inf, 0
    for _ in range(rounds):
        r = eye - x.T @ x
        s = x.T @ a @ x
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(np.diag(s))
        # ten times what the method needs at least: many pairs at the limit would add up
        gap = 20 * (_norm(off) + size * _norm(r))
        apart = values[None, :] - values[:, None]
        near = np.abs(apart) <= gap
        e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, apart))
        x = _orthonormal(x + x @ e)
        change = np.abs(e).max()
        # pairs come within reach one after another, so the correction may grow for a while
        idle = 0 if change < least / 2 else idle + 1
        least = min(least, change)
        if change < np.finfo(_Wide).eps * len(a) or idle == 4:
            break
    return values, x, float(gap)


def eigen(a: np.ndarray, floor: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors of a symmetric matrix in extended precision."""
    n = len(a)
    size = np.abs(a).max() if n else _Wide(0)
    if floor is None:
        floor = 4 * n * np.finfo(_Wide).eps * size
    if n < 2 or size <= floor:
        return np.diag(a).copy(), np.eye(n, dtype=_Wide)
    for kind in (np.float32, np.float64):
        _, start = np.linalg.eigh((a / size).astype(kind))
        values, x, gap = refined(a, start.astype(_Wide))
        order = np.argsort(-values, kind="stable")
        values, x = values[order], x[:, order]
        ends = [*(np.flatnonzero(-np.diff(values) > gap) + 1).tolist(), n]
        if all(values[i] - values[j - 1] < size / 8 for i, j in zip([0, *ends], ends)):
            break  # else single precision told too little apart; start from double
    start = 0
    for end in ends:
        if end - start > 1:  # a cluster: solved in the space that it spans
            own = x[:, start:end]
            middle = values[start:end].mean()
            inner = own.T @ a @ own
            inner = (inner + inner.T) / 2 - middle * np.eye(end - start, dtype=_Wide)
            if np.abs(inner).max() < size / 2:
                shifts, turn = eigen(inner, floor)
                values[start:end], x[:, start:end] = middle + shifts, own @ turn
        start = end
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


@dataclass(frozen=True)
class Whitening:
    """What turns a vector into its whitened components."""

    moments: Moments
    vectors: np.ndarray  # one column per component
    values: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return (self.values / self.trace).astype(float).tolist()

    def apply(self, x: np.ndarray) -> tuple[list, np.ndarray]:
        """Deviations and whitened components of rows of ``x``."""
        d = self.moments.centred(x)
        if d.dtype == object or self.moments.length * self.moments.reach**2 >= 2**63:
            deviation = [int(v) for v in (d.astype(object) ** 2).sum(axis=1)]
            deviation = [v if v < 2**63 else None for v in deviation]
        else:
            deviation = (d**2).sum(axis=1).tolist()
        centre = (d / self.moments.n).astype(np.float64)
        scale = 1 / np.sqrt(self.values)
        return deviation, centre @ (self.vectors * scale).astype(np.float64)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of rows ``(id, x)`` of one length; None without rows or without any variance."""
    first = rows.select(F.size("x").alias("n")).first()
    if first is None:
        return None
    if first["n"] > MAX_LENGTH:
        raise ValueError(f"vectors of more than {MAX_LENGTH} entries")
    m = moments(rows, first["n"])
    v = covariance(rows, m)
    values, vectors = eigen(v)
    some = int((values > 16 * len(v) * np.finfo(np.float64).eps * values[0]).sum()) if values[0] > 0 else 0
    k = min(components, some)
    return Whitening(m, vectors[:, :k], values[:k], float(np.trace(v))) if k else None


def one_length(rows: DataFrame) -> DataFrame:
    """The rows whose vector has the length of most."""
    lengths = rows.groupBy(F.size("x").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    most = lengths.orderBy(F.desc("rows"), F.desc("n")).first()
    return rows if most is None else rows.filter(F.size("x") == most["n"])


def whitened(rows: DataFrame, how: Whitening) -> DataFrame:
    """``(id, deviation, z)`` of every row ``(id, x)``; ``z`` has one entry per component."""
    length = how.moments.length

    def run(batches):
        for batch in batches:
            deviation, z = how.apply(_matrix(batch.column(1), length))
            ends = np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(deviation, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(z.ravel())),
                ],
                names=["id", "deviation", "z"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "x").mapInArrow(run, f"id {kind}, deviation long, z array<double>")


def identity_error(z: DataFrame, components: int) -> float:
    """Largest entry of the covariance of ``z`` less the identity, from two passes over it."""

    def sums(batches):
        total, n = np.zeros(components), 0
        for batch in batches:
            x = _matrix(batch.column(0), components)
            total, n = total + x.sum(axis=0), n + len(x)
        yield pa.RecordBatch.from_pydict(
            {"i": pa.array(range(components), pa.int32()), "n": [n] * components, "v": total}
        )

    found = z.select("z").mapInArrow(sums, "i int, n long, v double")
    found = found.groupBy("i").agg((F.sum("v") / F.sum("n")).alias("mean"), F.sum("n").alias("n"))
    rows = found.orderBy("i").collect()
    mean, n = np.array([r["mean"] for r in rows]), rows[0]["n"]
    upper = np.triu_indices(components)

    def squares(batches):
        total = np.zeros((components, components))
        for batch in batches:
            x = _matrix(batch.column(0), components) - mean
            total += x.T @ x
        yield pa.RecordBatch.from_pydict(
            {
                "i": pa.array(upper[0], pa.int32()),
                "j": pa.array(upper[1], pa.int32()),
                "v": total[upper],
            }
        )

    found = z.select("z").mapInArrow(squares, "i int, j int, v double").groupBy("i", "j")
    off = F.abs(F.sum("v") / n - (F.col("i") == F.col("j")).cast("double"))
    return found.agg(off.alias("off")).agg(F.max("off")).first()[0]


RESULT = (
    "component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """One row per vector and component: ``id`` and the columns of ``RESULT``.

    Whatever is left of the table is fitted and whitened; ``identity_error`` is measured on the
    whitened rows themselves and is the same in all rows.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = stored(one_length(integers(vectors, id_col, vec_col)), "vectors")
    how = fit(rows, components)
    if how is None:
        return vectors.sparkSession.createDataFrame([], f"id {kind}, {RESULT}")
    z = stored(whitened(rows, how), "whitened")
    error = identity_error(z, len(how.values))
    share = F.lit(how.explained)
    return z.select("id", "deviation", F.posexplode("z").alias("place", "whitened")).select(
        "id",
        (F.col("place") + 1).alias("component"),
        F.lit(how.moments.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(share, F.col("place")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
