"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Every vector becomes whole numbers, so sums and centring are exact.  The fit list, each distinct
vector once, is the rows X of the problem, centred when read.  A step is one Spark job over the
fit list: each task forms its part of ``p = X v``, of the products with all left vectors so far,
and of ``X' p``; only sums leave the tasks.  A left vector is never stored: it is ``X w`` for a
``w`` of the dimension of the data, so any task can form its part of it again.  Left and right
vectors are reorthogonalised in full; where a left vector nearly lies in the span of the earlier
ones, the step is measured again on what is left of it.  The singular values of the small
bidiagonal matrix give the deviations, its right vectors the components.  Steps go on until the
leading components have settled or the whole space is spanned; settled ones are locked and a run
on the rest of the space proves that no equal or larger one was missed.

Defined results: rows whose vector is null or empty, holds nulls or values that are not finite or
of a size of 2**56 and more, or has another length than most (of equally many the longer), are
dropped; components that are no more than rounding (a variance below 1e-12 of all) do not exist,
so vectors that are all alike, or an empty table, give an empty result; a null or repeated
``vec_id`` is kept as it is; a deviation beyond 64 bits is null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import Scratch

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Rows that a task works on at a time.
ROWS = 2048
#: A residual below this share of the largest singular value has settled; a variance below that share of all is none.
SETTLED, NOTHING = 4e-15, 1e-12
_LARGE = 2.0**56
_LOW = (1 << 31) - 1


def whole_numbers(rows: DataFrame) -> DataFrame:
    """``vec_id, x`` of the rows that can be used, lengths still as they are."""
    entry = F.col("embedding").cast("array<double>")
    good = F.forall(entry, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < _LARGE))
    return (rows.filter(F.coalesce((F.size(entry) > 0) & good, F.lit(False)))
            .select("vec_id", F.transform(entry, lambda v: F.floor(v * SCALE).cast("long") + SHIFT).alias("x")))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        width = len(flat) // max(1, batch.num_rows)
        data = pa.py_buffer(flat.tobytes())
        fixed = pa.Array.from_buffers(pa.binary(8 * width), batch.num_rows, [None, data]) if width else pa.array([], pa.binary())
        rest = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*rest, fixed.cast(pa.binary())], batch.schema.names)


def _pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            piece = batch.slice(at, ROWS)
            yield piece, np.frombuffer(b"".join(piece.column("x").to_pylist()), np.int64).reshape(-1, width)


@dataclass(frozen=True)
class Centre:
    """The exact mean of the fit list: sums over a count."""

    count: int
    sums: tuple[int, ...]

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """``count * x - sums``, as 64-bit numbers or as objects where these do not hold it."""
        room = max(map(abs, self.sums)) + self.count * (int(np.abs(x).max()) if x.size else 0)
        if room < 1 << 62:
            return x * self.count - np.array(self.sums, np.int64)
        return x.astype(object) * self.count - np.array(self.sums, object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (self.offsets(x) / self.count).astype(np.float64)


def _sums(rows: DataFrame, work: Callable[[np.ndarray], np.ndarray], width: int, out: int, kind: str) -> np.ndarray:
    """``work`` over all vectors, added up; one row of ``out`` numbers leaves each task."""
    number = {"long": np.int64, "double": np.float64}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(out, number), False
        for _, x in _pieces(batches, width):
            total, some = total + work(x), True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["v"])

    added = np.zeros(out, number)
    parts = rows.mapInArrow(run, f"v array<{kind}>").select(F.posexplode("v").alias("slot", "v"))
    for slot, value in parts.groupBy("slot").agg(F.sum("v")).collect():
        added[slot] = value
    return added


class Bidiagonal:
    """Alternating products over the fit list, from one start vector."""

    def __init__(self, rows: DataFrame, centre: Centre, locked: np.ndarray):
        self.rows, self.centre, self.width = rows, centre, len(centre.sums)
        self.locked = locked  # right vectors that the run keeps clear of, as columns
        self.right = np.zeros((self.width, 0))
        self.weights = np.zeros((self.width, 0))  # left vector j is X @ weights[:, j]
        self.back = np.zeros((self.width, 0))  # X' @ left vector j
        self.diagonal: list[float] = []
        self.above: list[float] = []  # the last is the link to the step not taken yet
        self.random = np.random.default_rng(20)
        self.complete = False

    def _product(self, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """``|p|^2``, the products of p with the left vectors, and ``X' p``, for ``p = X w``."""
        k, centre = self.weights.shape[1], self.centre
        columns = np.column_stack([w, self.weights])

        def work(x: np.ndarray) -> np.ndarray:
            r = centre.rows(x)
            u = r @ columns
            out = np.zeros(1 + 2 * r.shape[1])
            out[: 1 + k] = u.T @ u[:, 0]
            out[1 + r.shape[1] :] = r.T @ u[:, 0]
            return out

        got = _sums(self.rows, work, self.width, 1 + 2 * self.width, "double")
        return float(got[0]), got[1 : 1 + k], got[1 + self.width :]

    def _clear(self, z: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for basis in (self.locked, self.right):
                z = z - basis @ (basis.T @ z)
        return z

    def _start(self) -> np.ndarray | None:
        """A direction at random outside all spanned ones, if there is any."""
        if self.right.shape[1] + self.locked.shape[1] >= self.width:
            return None
        z = self._clear(self.random.standard_normal(self.width))
        return z / np.linalg.norm(z)

    def step(self) -> bool:
        """One more right and left vector; false once the space is spanned."""
        v, largest = None, max([*self.diagonal, *self.above, 0.0])
        if self.diagonal and self.diagonal[-1]:
            z = self._clear(self.back[:, -1] - self.diagonal[-1] * self.right[:, -1])
            beta = float(np.linalg.norm(z))
            if beta > 1e-13 * largest and self.right.shape[1] + self.locked.shape[1] < self.width:
                v = z / beta
        if self.diagonal:
            self.above.append(beta if v is not None else 0.0)
        fresh = v is None
        if fresh and (v := self._start()) is None:
            self.complete = True
            return False
        size, c, back = self._product(v)
        if fresh and size <= (1e-13 * largest) ** 2:  # nothing is left outside the spanned directions
            self.complete = True
            return False
        w, whole = v, size
        for _ in range(2):
            w = w - self.weights @ c
            if size - c @ c > 0.01 * size or size <= 1e-24 * whole:
                size, back = size - c @ c, back - self.back @ c
                break
            size, c, back = self._product(w)
        alpha = float(np.sqrt(max(size, 0.0)))
        self.right = np.column_stack([self.right, v])
        if alpha <= 1e-13 * max(largest, np.sqrt(whole)):  # no new left vector: the next start is a new one
            alpha, w, back = 0.0, np.zeros(self.width), np.zeros(self.width)
        else:
            w, back = w / alpha, back / alpha
        self.weights, self.back = np.column_stack([self.weights, w]), np.column_stack([self.back, back])
        self.diagonal.append(alpha)
        return True

    def matrix(self) -> np.ndarray:
        k = len(self.diagonal)
        return np.diag(self.diagonal) + np.diag(self.above[: k - 1], 1)

    def leading(self, want: int) -> tuple[np.ndarray, np.ndarray, bool]:
        """Singular values, right vectors as columns, and whether the first ``want`` have settled."""
        left, values, right = np.linalg.svd(self.matrix())
        ready = self.complete
        if not ready and len(values) > want:
            z = self._clear(self.back[:, -1] - self.diagonal[-1] * self.right[:, -1])
            ready = bool((np.linalg.norm(z) * np.abs(left[-1, :want]) <= SETTLED * values[0]).all())
        return values[:want], self.right @ right.T[:, :want], ready

    def run(self, want: int) -> tuple[np.ndarray, np.ndarray]:
        while self.step():
            if len(self.diagonal) % 4 == 0 and self.leading(want)[2]:
                break
        if not self.diagonal:
            return np.zeros(0), np.zeros((self.width, 0))
        return self.leading(want)[:2]


def components(rows: DataFrame, centre: Centre, want: int) -> tuple[np.ndarray, np.ndarray]:
    """Variances, falling, and unit components as columns, of the centred rows."""
    first = Bidiagonal(rows, centre, np.zeros((len(centre.sums), 0)))
    values, vectors = first.run(want)
    complete = first.complete
    while not complete:
        rest = Bidiagonal(rows, centre, vectors)
        more, found = rest.run(1)
        if not len(more) or more[0] <= values[-1] * (1 - 1e-12):
            break
        values, vectors = np.append(values, more), np.column_stack([vectors, found])
        order = np.argsort(-values, kind="stable")
        values, vectors = values[order], vectors[:, order]
    return values[:want] ** 2 / centre.count, vectors[:, :want]


def _whitened(centre: Centre, vectors: np.ndarray, variance: np.ndarray, explained: np.ndarray, error: float):
    width, many = vectors.shape
    scaled = vectors / np.sqrt(variance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, x in _pieces(batches, width):
            n = len(x)
            offsets = centre.offsets(x)
            if offsets.dtype == object or n and width * int(np.abs(offsets).max()) ** 2 >= 1 << 63:
                squares = [sum(v * v for v in row) for row in offsets.tolist()]
                deviation = pa.array([s if s < 1 << 63 else None for s in squares], pa.int64())
            else:
                deviation = pa.array((offsets * offsets).sum(axis=1), pa.int64())
            z = (offsets / centre.count).astype(np.float64) @ scaled
            rows = pa.array(np.repeat(np.arange(n), many))
            yield pa.RecordBatch.from_arrays([
                piece.column("vec_id").take(rows), pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), n)),
                pa.array(np.full(n * many, centre.count)), deviation.take(rows), pa.array(z.ravel()),
                pa.array(np.tile(explained, n)), pa.array(np.full(n * many, error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


_RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(rows: DataFrame, want: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every row that can be used."""
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "whiten")
    usable = whole_numbers(rows)
    lengths = usable.groupBy(F.size("x").alias("length")).count()
    most = lengths.agg(F.max(F.struct("count", "length")).alias("m")).first().m
    if most is None:
        return spark.createDataFrame([], _RESULT)
    width = most.length
    usable = usable.filter(F.size("x") == width)
    fit = scratch.write(usable.select("x").distinct().mapInArrow(_packed, "x binary"), "fit")

    def split(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], (x & _LOW).sum(axis=0), (x >> 31).sum(axis=0)])

    count, *halves = _sums(fit, split, width, 1 + 2 * width, "long").tolist()
    centre = Centre(count, tuple(low + (high << 31) for low, high in zip(halves[:width], halves[width:])))
    variance, vectors = components(fit, centre, min(want, width))

    many = len(variance)
    scaled = vectors / np.sqrt(np.maximum(variance, np.finfo(float).tiny))

    def moments(x: np.ndarray) -> np.ndarray:
        r = centre.rows(x)
        z = r @ scaled
        return np.concatenate([[(r * r).sum()], z.sum(axis=0), (z.T @ z).ravel()])

    got = _sums(fit, moments, width, 1 + many + many * many, "double") / count
    trace, mean, square = got[0], got[1 : 1 + many], got[1 + many :].reshape(many, many)
    real = variance > NOTHING * trace
    if not real.any():
        return spark.createDataFrame([], _RESULT)
    error = float(np.abs(square - np.outer(mean, mean) - np.eye(many))[np.ix_(real, real)].max())
    packed = usable.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(_packed, "vec_id long, x binary")
    work = _whitened(centre, vectors[:, real], variance[real], variance[real] / trace, error)
    return packed.mapInArrow(work, _RESULT)
