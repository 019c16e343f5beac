"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi.

Vectors are put on an integer lattice, so every sum over the table is exact and
doesn't depend on the order of the rows.  Spark sums rows and entries, then the
products of entries that are centred on the whole number nearest to their mean;
what is left of the mean is taken off in exact arithmetic.  Only those sums, of
the size of the dimension squared, reach the driver.

There the covariance is factored by Cholesky with diagonal pivoting, and plane
rotations from the right make the columns of the triangular factor orthogonal
(one-sided Jacobi on the factor itself, all disjoint pairs of a round at once).
The squared norms of the rotated columns are the eigenvalues, and the columns
over their norms the components.  Spark then projects every row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_SWEEPS = 60
_LONG = 1 << 63


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """A factor G with G @ G.T = v; its rows are v's, its columns as many as v's numerical rank.

    Rows taken in the order of their pivots make G lower triangular.
    """
    d = len(v)
    rest, g = np.diag(v).copy(), np.zeros((d, d))
    floor = d * np.finfo(float).eps * rest.max(initial=0.0)
    for k in range(d):
        p = int(rest.argmax())
        if rest[p] <= floor:
            return g[:, :k]
        column = (v[:, p] - g[:, :k] @ g[p, :k]) / np.sqrt(rest[p])
        column[rest == -np.inf] = 0.0  # pivots of before: above the diagonal
        g[:, k] = column
        rest -= column**2
        rest[p] = -np.inf
    return g


def one_sided_jacobi(g: np.ndarray) -> np.ndarray:
    """``g`` times rotations that make its columns orthogonal to each other."""
    n = g.shape[1]
    rows = np.zeros((n + n % 2, g.shape[0]))  # a column of g is a row here
    rows[:n] = g.T
    players = np.arange(len(rows))
    for _ in range(MOST_SWEEPS):
        turned = False
        for _ in range(len(rows) - 1):
            p, q = players[: len(rows) // 2], players[len(rows) // 2 :][::-1]
            x, y = rows[p], rows[q]
            a, b, c = (np.einsum("ij,ij->i", u, w) for u, w in ((x, x), (y, y), (x, y)))
            turn = np.abs(c) > 4 * np.finfo(float).eps * np.sqrt(a * b)
            if turn.any():
                turned = True
                zeta = np.where(turn, b - a, 0.0) / np.where(turn, 2 * c, 1.0)
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                t = np.where(turn, t, 0.0)
                cos = 1 / np.hypot(1.0, t)
                sin = cos * t
                rows[p], rows[q] = cos[:, None] * x - sin[:, None] * y, sin[:, None] * x + cos[:, None] * y
            players = np.concatenate([players[:1], players[-1:], players[1:-1]])  # a round of a tournament
        if not turned:
            break
    return rows[:n].T


@dataclass(frozen=True)
class Space:
    """What was fitted to all vectors of one length."""

    n: int
    sums: tuple[int, ...]
    trace: float
    eigenvalues: np.ndarray
    components: np.ndarray  # a row for each

    @property
    def centre(self) -> np.ndarray:
        """The whole numbers nearest to the means."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    def rest(self, centre: np.ndarray) -> np.ndarray:
        """What is left of the sums after ``centre`` is taken off each vector."""
        return np.array([s - self.n * int(c) for s, c in zip(self.sums, centre, strict=True)], np.int64)


def fitted(n: int, sums: tuple[int, ...], centred: Callable[[int, int], int]) -> Space:
    """``centred(i, j)``: the sum of products of entries i and j, centred on ``Space.centre``."""
    space = Space(n, sums, 0.0, np.zeros(0), np.zeros((0, len(sums))))
    rest = [int(r) for r in space.rest(space.centre)]
    d = len(sums)
    v = np.zeros((d, d))
    for i in range(d):
        for j in range(i + 1):
            v[i, j] = v[j, i] = (n * centred(i, j) - rest[i] * rest[j]) / (n * n)  # whole numbers, rounded once
    rotated = one_sided_jacobi(pivoted_cholesky(v))
    norms = np.sqrt((rotated**2).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    components = (rotated[:, order] / norms[order]).T
    largest = np.abs(components).argmax(axis=1)
    signs = np.sign(components[np.arange(len(components)), largest]) if len(components) else np.zeros(0)
    return Space(n, sums, float(np.trace(v)), norms[order] ** 2, components * signs[:, None])


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def on_lattice(vectors: DataFrame, id_col: str, vector_col: str, scale: int, offset: int) -> DataFrame:
    """(id, x): usable vectors with each entry c as the whole number floor(scale * c) + offset."""
    x = F.transform(vector_col, lambda c: F.floor(c.cast("double") * F.lit(float(scale))) + F.lit(offset).cast("long"))
    return vectors.where(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), x.alias("x"))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, matrix of vectors) for each length that isn't 0."""
    lists = batch.column(batch.schema.get_field_index("x"))
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    first = np.concatenate([[0], lengths.cumsum()])[:-1]
    for d in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == d)
        yield rows, flat[first[rows][:, None] + np.arange(d)]


def _products(y: np.ndarray) -> np.ndarray:
    """y.T @ y of whole numbers, exactly."""
    bound = int(np.abs(y).max(initial=0)) ** 2 * len(y)
    if bound >= _LONG:
        raise OverflowError("entries are too far from their mean for exact sums")
    return (y.astype(float).T @ y.astype(float)).astype(np.int64) if bound < 1 << 53 else y.T @ y


def _summed(rows: DataFrame, each: Callable[[np.ndarray], np.ndarray], kind: str) -> dict[int, dict[tuple[int, int], float]]:
    """For each length, the sum over all rows of the matrices ``each`` makes of blocks of vectors.

    A task adds its blocks up; its matrix leaves as a row for each line, which
    Spark adds up entry by entry.
    """
    dtype = pa.int64() if kind == "long" else pa.float64()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _by_length(batch):
                add, d = each(x), x.shape[1]
                if d in sums and kind == "long" and (np.abs(sums[d].astype(float)) + np.abs(add.astype(float))).max(initial=0) >= _LONG:
                    raise OverflowError("the sums are too large to be exact")
                sums[d] = sums[d] + add if d in sums else add
        for d, matrix in sums.items():
            lines = pa.array(list(matrix), pa.list_(dtype))
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(matrix), pa.int32()), pa.array(range(len(matrix)), pa.int32()), lines], ["d", "i", "line"])

    lines = rows.select("x").mapInArrow(partial, f"d int, i int, line array<{kind}>")
    entries = lines.select("d", "i", F.posexplode("line").alias("j", "v")).groupBy("d", "i", "j").agg(F.sum("v").alias("v"))
    out: dict[int, dict[tuple[int, int], float]] = {}
    for d, i, j, v in zip(*(c.to_pylist() for c in entries.toArrow().columns), strict=True):
        out.setdefault(d, {})[i, j] = v
    return out


def fit(rows: DataFrame) -> dict[int, Space]:
    """The space of each length of the vectors of (id, x): two passes over the rows, exact sums."""
    sums = _summed(rows, lambda x: np.vstack([x.sum(axis=0), np.full(x.shape[1], len(x))]).astype(np.int64), "long")
    spaces = {d: Space(s[1, 0], tuple(s[0, j] for j in range(d)), 0.0, np.zeros(0), np.zeros((0, d))) for d, s in sums.items()}
    centres = {d: s.centre for d, s in spaces.items()}
    lower = _summed(rows, lambda x: np.tril(_products(x - centres[x.shape[1]])), "long")
    return {d: fitted(s.n, s.sums, lambda i, j, of=lower[d]: of[i, j]) for d, s in spaces.items()}


def _projection(spaces: dict[int, Space], most: int) -> Callable[[np.ndarray], np.ndarray]:
    centre = {d: s.centre for d, s in spaces.items()}
    rest = {d: s.rest(centre[d]) / s.n for d, s in spaces.items()}
    matrix = {d: (s.components[:most] / np.sqrt(s.eigenvalues[:most, None])).T for d, s in spaces.items()}

    def project(x: np.ndarray) -> np.ndarray:
        d = x.shape[1]
        return ((x - centre[d]) - rest[d]) @ matrix[d]

    return project


def _deviations(spaces: dict[int, Space]) -> Callable[[np.ndarray], list[int]]:
    centre = {d: s.centre for d, s in spaces.items()}
    rest = {d: s.rest(centre[d]) for d, s in spaces.items()}

    def deviations(x: np.ndarray) -> list[int]:
        d = x.shape[1]
        y, n = x - centre[d], spaces[d].n
        if d * (n * (int(np.abs(y).max(initial=0)) + 1)) ** 2 < _LONG:
            return ((n * y - rest[d]) ** 2).sum(axis=1).tolist()
        return [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, rest[d], strict=True)) for row in y]

    return deviations


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """One row per usable vector: id, n, deviation, whitened and explained (arrays), identity_error.

    ``whitened[k]`` is the projection of the centred vector on component k over
    the square root of its eigenvalue, ``explained[k]`` the eigenvalue over the
    trace of the covariance, ``deviation`` the exact sum over entries of
    ``(n * x - S) ** 2``, ``identity_error`` the largest entry, in absolute
    value, of the covariance of all whitened vectors minus the identity.

    Vectors that are null or hold a null, NaN or infinite entry are left out.
    Vectors of another length are another space: each length has its own n,
    components and error.  An empty vector has no components.  There are no
    more components than the rank of the covariance: equal vectors alone (or
    one vector) have none, and arrays are empty then.  Equal eigenvalues have
    some orthogonal components of their common space.  Null ids and repeated
    rows stay; other columns are not read.  An empty table gives an empty
    result.  An error is raised where a whole number doesn't fit: an entry
    beyond 2**56 of the lattice, or a sum of squares or a deviation beyond 64 bits.

    The fit runs when the frame is built: three passes over the vectors, whose
    sums (the dimension squared, for each length) reach the driver.
    """
    rows = on_lattice(vectors, id_col, vector_col, scale, offset)
    spaces = fit(rows)
    project, deviations = _projection(spaces, components), _deviations(spaces)

    def products(x: np.ndarray) -> np.ndarray:
        w = project(x)
        return np.vstack([w.T @ w, w.sum(axis=0)])

    errors: dict[int, float] = {}
    for d, found in _summed(rows, products, "double").items():
        n, k = spaces[d].n, min(components, len(spaces[d].eigenvalues))
        errors[d] = max((abs(found[i, j] / n - found[k, i] * found[k, j] / n**2 - (i == j)) for i in range(k) for j in range(k)), default=0.0)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            lengths, n, deviation = np.zeros(size, np.int32), np.zeros(size, np.int64), [0] * size
            out: list = [[]] * size
            for places, x in _by_length(batch):
                lengths[places], n[places] = x.shape[1], spaces[x.shape[1]].n
                for place, w, moved in zip(places.tolist(), project(x), deviations(x), strict=True):
                    out[place], deviation[place] = w, moved
            columns = [batch.column(0), pa.array(lengths), pa.array(n), pa.array(deviation, pa.int64()), pa.array(out, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "d", "n", "deviation", "whitened"])

    done = rows.mapInArrow(apply, f"id {rows.schema['id'].dataType.simpleString()}, d int, n long, deviation long, whitened array<double>")
    none = F.array().cast("array<double>")
    explained = none
    error = F.lit(0.0)
    for d, s in spaces.items():
        shares = F.array(*(F.lit(float(e / s.trace)) for e in s.eigenvalues[:components])) if len(s.eigenvalues) else none
        explained, error = F.when(F.col("d") == d, shares).otherwise(explained), F.when(F.col("d") == d, F.lit(float(errors.get(d, 0.0)))).otherwise(error)
    return done.select(F.col("id").alias(id_col), "n", "deviation", "whitened", explained.alias("explained"), error.alias("identity_error"))


def long_form(white: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """A row for each vector and component (from 1) of ``whitened``'s rows; none for a vector without components."""
    each = white.select(id_col, F.posexplode("whitened").alias("place", "whitened"), "n", "deviation", "explained", "identity_error")
    return each.select(
        id_col, (F.col("place") + 1).alias("component"), "n", "deviation", "whitened",
        F.get("explained", F.col("place")).alias("explained"), "identity_error",
    )
