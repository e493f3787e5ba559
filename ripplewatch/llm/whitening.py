"""Whitening of embeddings: leading components of their covariance by spectrum slicing, and the whitened vectors.

Spark sums over the rows: one pass for the means, one for the centred products, one for the covariance of the whitened
vectors. Only square matrices of the vectors' dimension reach the driver, whatever the number of rows.

The components come from that matrix. By Sylvester's law the pivots of an LDL' factorisation of ``V - s I`` have the signs
of its eigenvalues, so one factorisation counts the eigenvalues above ``s``. Bisection on the counts isolates every
leading eigenvalue; Rayleigh quotient iteration, held inside the bracket, converges cubically; and counts just below and
above the result certify its number. Eigenvalues that no bisection can part share a bracket, and their vectors are
kept orthogonal.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplewatch.llm.common import slices

SCALE, ORIGIN = 64.0, 1_000_000
COMPONENTS = 32
_EPS = np.finfo(np.float64).eps
_PIVOT = (1 + 17**0.5) / 8  # the least growth of elements that a choice between single and double pivots allows


def count_above(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of a symmetric matrix above ``shift``: the positive pivots of a pivoted LDL'."""
    a = matrix - shift * np.eye(len(matrix))
    n, i, positive = len(a), 0, 0
    while i < n:
        below = np.abs(a[i + 1 :, i])
        r = i + 1 + int(below.argmax()) if len(below) else i
        largest = below[r - i - 1] if len(below) else 0.0
        own, size = abs(a[i, i]), 1
        if own < _PIVOT * largest:
            others = np.abs(a[r, i:])
            others[r - i] = 0.0
            if own * others.max() < _PIVOT * largest**2:
                size = 1 if abs(a[r, r]) >= _PIVOT * others.max() else 2
                to = i + size - 1
                a[[to, r]] = a[[r, to]]
                a[:, [to, r]] = a[:, [r, to]]
        if size == 1:
            if a[i, i]:
                positive += a[i, i] > 0
                rest = a[i + 1 :, i].copy()
                a[i + 1 :, i + 1 :] -= np.outer(rest, rest / a[i, i])
        else:  # a double pivot is chosen only where it has one eigenvalue of either sign
            positive += 1
            rest = a[i + 2 :, i : i + 2].copy()
            a[i + 2 :, i + 2 :] -= rest @ np.linalg.solve(a[i : i + 2, i : i + 2], rest.T)
        i += size
    return int(positive)


def brackets(matrix: np.ndarray, wanted: int) -> list[tuple[float, float, int, int]]:
    """(low, high, first, last): intervals from the top that hold eigenvalues ``first`` to ``last``, numbered from 1.

    Each holds one eigenvalue, or several that lie closer together than rounding lets counts tell apart.
    """
    bound = float(np.abs(matrix).sum(axis=1).max()) * (1 + 1e-9) + np.finfo(np.float64).tiny
    todo, out = [(-bound, bound, len(matrix), 0)], []
    while todo:
        low, high, upto, before = todo.pop()
        if before >= wanted or upto == before:
            continue
        if upto - before == 1 or high - low <= 1e3 * _EPS * bound:
            out.append((low, high, before + 1, upto))
            continue
        middle = (low + high) / 2
        above = min(max(count_above(matrix, middle), before), upto)
        todo += [(low, middle, upto, above), (middle, high, above, before)]
    return sorted(out, key=lambda x: x[2])


def _refine(matrix: np.ndarray, low: float, high: float, number: int, mates: list[np.ndarray]) -> tuple[float, np.ndarray]:
    """The eigenpair ``number`` inside the bracket, orthogonal to the ``mates`` that share it."""
    norm = float(np.abs(matrix).sum(axis=1).max())
    unit, known = np.eye(len(matrix)), np.array(mates).reshape(len(mates), len(matrix))

    def step(shift, x):
        for nudge in (0.0, _EPS * norm, 4 * _EPS * norm):
            try:
                x = np.linalg.solve(matrix - (shift + nudge) * unit, x)
                break
            except np.linalg.LinAlgError:
                continue
        for _ in range(2):
            x = x - known.T @ (known @ x)
        return x / np.linalg.norm(x)

    def begin(shift):
        x = np.random.default_rng(number).standard_normal(len(matrix))
        return step(shift, step(shift, x))

    low_end, high_end, slack = low, high, 1e3 * _EPS * norm
    best: tuple = (np.inf, 0.0, None)
    for _ in range(64):
        x = begin((low + high) / 2)
        for _ in range(12):
            value = float(x @ (matrix @ x))
            missed = float(np.linalg.norm(matrix @ x - value * x))
            if not low_end - slack <= value <= high_end + slack:
                break
            if missed <= slack and missed >= best[0] / 2:
                return best[1:]
            if missed < best[0]:
                best = (missed, value, x)
            x = step(value, x)
        # It went for another eigenvalue, or came no closer: halve the bracket by a count and begin in its middle.
        middle = (low + high) / 2
        low, high = (middle, high) if count_above(matrix, middle) >= number else (low, middle)
    return best[1:]


def leading_components(matrix: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns, of a symmetric matrix.

    Only components that rounding can tell from zero are returned, so there may be fewer than ``wanted``.
    """
    values, vectors = [], []
    norm = float(np.abs(matrix).sum(axis=1).max()) if len(matrix) else 0.0
    floor = 8 * len(matrix) * _EPS * norm
    for low, high, first, last in brackets(matrix, wanted) if norm else []:
        mates: list[np.ndarray] = []
        found = []
        for number in range(first, last + 1):
            value, x = _refine(matrix, low, high, number, mates)
            mates.append(x)
            found.append((value, x))
        for number, (value, x) in enumerate(sorted(found, key=lambda p: -p[0]), first):
            margin = max(1e4 * _EPS * norm, high - low if last > first else 0.0)
            if value <= floor:
                continue
            if count_above(matrix, value - margin) < number or count_above(matrix, value + margin) >= number:
                raise ArithmeticError(f"counts do not confirm eigenvalue {number}")
            values.append(value)
            vectors.append(x)
    return np.array(values[:wanted]), np.array(vectors[:wanted]).reshape(-1, len(matrix)).T


def _vectors(batch: pa.RecordBatch):
    """Lengths (-1 for rows that are dropped), values and the offsets of each row's values."""
    lists = batch.column(1).cast(pa.list_(pa.float64()))
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64)  # null entries become NaN
    offsets = np.r_[0, np.cumsum(lengths)]
    with np.errstate(over="ignore"):
        bad = np.r_[0, np.cumsum(~(np.abs(values * SCALE) < 2.0**62))]
    dropped = (bad[offsets[1:]] > bad[offsets[:-1]]) | np.asarray(lists.is_null()) | (lengths == 0)
    return np.where(dropped, -1, lengths), values, offsets


def _integers(values: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * values).astype(np.int64) + ORIGIN


def _matrix_rows(sums: dict):
    """Rows (i, j, value) of the upper triangle of the one matrix summed in this task."""
    for total in sums.values():
        for i in range(len(total)):
            j = np.arange(i, len(total), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(j), i, np.int32)), pa.array(j), pa.array(total[i, i:])], names=["i", "j", "value"]
            )


def _summed(products: DataFrame, d: int) -> np.ndarray:
    """The symmetric matrix of order ``d`` whose upper triangles the tasks emitted."""
    rows = products.groupBy("i", "j").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros((d, d))
    i, j = rows.column("i").to_numpy(), rows.column("j").to_numpy()
    out[i, j] = out[j, i] = rows.column("value").to_numpy()
    return out


class Whitening:
    """What was learned from a table of embeddings: count, sums, components, and how white the result is."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums, self.dimension = n, np.array(sums, np.int64), len(sums)
        whole, part = np.divmod(self.sums, max(n, 1))
        self.whole, self.part = whole, part / max(n, 1)
        self.centre = self.values = self.vectors = None
        self.trace, self.identity_error = 0.0, 0.0

    def rows(self, batches):
        """(positions in the batch, batch, integers) of the rows that count, a thousand at a time."""
        for batch in slices(batches):
            lengths, values, offsets = _vectors(batch)
            at = np.flatnonzero(lengths == self.dimension)
            if len(at):
                yield at, batch, _integers(values[offsets[at][:, None] + np.arange(self.dimension)])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.part

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of squares of ``n x - S``; None where a long cannot hold the sum."""
        scaled = self.n * (x - self.whole) - (self.sums - self.n * self.whole)
        rough = (scaled.astype(np.float64) ** 2).sum(axis=1)
        exact = (scaled**2).sum(axis=1).tolist()
        return [e if r < 9.2e18 else None for e, r in zip(exact, rough.tolist(), strict=True)]


def _input(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def fit(embeddings: DataFrame, *, components: int = COMPONENTS) -> Whitening:
    """Means, covariance and leading components of all rows whose vector is whole.

    A row is left out if its vector is null or empty, holds a null or non-finite entry, or one whose integer no long can
    hold, or is shorter than the table's longest (its last entries are missing). The driver receives square matrices of
    the dimension only. A table without such rows has no components.
    """
    df = _input(embeddings)

    def count(batches):
        held: dict[int, tuple] = {}
        for batch in slices(batches):
            lengths, values, offsets = _vectors(batch)
            for d in np.unique(lengths[lengths > 0]).tolist():
                at = np.flatnonzero(lengths == d)
                x = _integers(values[offsets[at][:, None] + np.arange(d)])
                n, total = held.get(d, (0, 0))
                held[d] = n + len(at), total + x.sum(axis=0)
        for d, (n, total) in held.items():
            columns = [np.full(d, d, np.int32), np.arange(d, dtype=np.int32), np.full(d, n, np.int64), total]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["d", "i", "n", "total"])

    counts = df.mapInArrow(count, "d int, i int, n long, total long")
    by_place = counts.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    longest = by_place.groupBy("i").agg(F.max(F.struct("d", "n", "total")).alias("of"))
    top = sorted((r.i, r.of.d, r.of.n, r.of.total) for r in longest.collect())  # a row for each place of a vector
    found = Whitening(top[0][2] if top else 0, [r[3] for r in top])
    if not top:
        return found

    def products(batches):
        sums: dict[int, np.ndarray] = {}
        for _, _, x in found.rows(batches):
            c = np.c_[found.centred(x), np.ones(len(x))]  # the last column carries what rounding leaves of the mean
            sums[0] = sums.get(0, 0.0) + c.T @ c
        yield from _matrix_rows(sums)

    raw = _summed(df.mapInArrow(products, "i int, j int, value double"), found.dimension + 1)
    covariance = raw[:-1, :-1] / found.n
    found.trace = float(np.trace(covariance))
    found.values, found.vectors = leading_components(covariance, components)
    found.centre = raw[-1, :-1] / found.n @ found.vectors / np.sqrt(found.values)

    def check(batches):
        sums: dict[int, np.ndarray] = {}
        for _, _, x in found.rows(batches):
            z = found.whitened(x) - found.centre
            sums[0] = sums.get(0, 0.0) + z.T @ z
        yield from _matrix_rows(sums)

    if len(found.values):
        white = _summed(df.mapInArrow(check, "i int, j int, value double"), len(found.values)) / found.n
        found.identity_error = float(np.abs(white - np.eye(len(white))).max())
    return found


def whiten(embeddings: DataFrame, found: Whitening) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row for each kept row and component.

    ``deviation`` is null where a long cannot hold it. Components without variance are not returned, since nothing can
    be scaled to unit variance along them. Repeated rows stay repeated, a null vec_id is kept, further columns are
    ignored; a table without usable vectors gives an empty result.
    """
    schema = pa.schema(
        [("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64())]
        + [(name, pa.float64()) for name in ("whitened", "explained", "identity_error")]
    )

    def run(batches):
        k = 0 if found.values is None else len(found.values)
        if not k:
            return
        for at, batch, x in found.rows(batches):
            rows = len(at) * k
            each = pa.array(np.repeat(np.arange(len(at)), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)).take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(rows, found.n, np.int64)),
                    pa.array(found.deviations(x), pa.int64()).take(each),
                    pa.array(found.whitened(x).ravel()),
                    pa.array(np.tile(found.values / found.trace, len(at))),
                    pa.array(np.full(rows, found.identity_error)),
                ],
                schema=schema,
            )

    kinds = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return _input(embeddings).mapInArrow(run, kinds)
