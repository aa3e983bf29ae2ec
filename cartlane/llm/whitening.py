"""Embedding whitening by spectrum slicing.

Entries become integers ``x = floor(1024 c) + 100000``. Two scans add up, exactly and whatever the partitioning, the
number of vectors and the sums, then the products of the vectors centred at the rounded mean; what the rounding leaves
is taken off in whole numbers, so the covariance is right to the last bit of a double. Its leading eigenpairs are
found on the driver, whose input is one matrix of the vectors' width:

1. Slicing. An LDL' factorisation (Bunch and Kaufman's pivots of one or two rows) of the covariance less a shift has as
   many positive pivots as there are eigenvalues over the shift. Bisection on these counts isolates the k-th.
2. Rayleigh quotient iteration from the middle of its interval, with solves by the same factors, converges cubically.
3. Counts just below and above the result certify that it is eigenvalue number k.

A last scan projects every vector: ``(x - mean) . component / sqrt(eigenvalue)``.

Defined cases: a vector that is null or has a null or non-finite entry is dropped; a shorter vector than the longest
counts as zero where it ends; a null id stays a row; repeated rows count each; components beyond the width do not exist;
where an eigenvalue is zero to rounding, ``whitened`` is null and the component does not count for ``identity_error``;
``explained`` is null where nothing varies; a deviation too large for a long is null; an entry beyond 10^9 in size is
refused with an error; an empty table gives an empty result; other columns, whatever their names, are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: The largest ``floor(1024 c)``; squares of such numbers add up to 38 digits for 8e13 vectors.
LARGEST = 1 << 40
ALPHA = (1 + 17 ** 0.5) / 8
EPS = np.finfo(float).eps


# --- vectors as integers --------------------------------------------------------
def scaled(column: pa.Array, width: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Which of the vectors remain, and ``floor(1024 c)`` of those, one row each; at least ``width`` columns."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(column)
    values = pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(column)), lengths)
    finite = np.isfinite(values)
    stays = ~column.is_null().to_numpy(zero_copy_only=False)
    stays[owner[~finite]] = False
    place = np.cumsum(stays) - 1
    at = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    chosen = stays[owner]
    numbers = np.floor(SCALE * values[chosen])
    if len(numbers) and np.abs(numbers).max() > LARGEST:
        raise ValueError(f"an embedding has an entry beyond {LARGEST // SCALE} in size")
    out = np.zeros((int(stays.sum()), max([width, *lengths[stays]], default=0)), np.int64)
    out[place[owner[chosen]], at[chosen]] = numbers.astype(np.int64)
    return stays, out


def _products(y: np.ndarray) -> np.ndarray:
    """``y' y`` exactly, as whole numbers."""
    most = float(np.abs(y).max(initial=0)) ** 2 * len(y)
    if most < 1 << 53:
        part = y.astype(float)
        return (part.T @ part).astype(np.int64).astype(object)
    part = y if most < 1 << 62 else y.astype(object)
    return (part.T @ part).astype(object)


_WHOLE = pa.decimal128(38, 0)


def _sums(source) -> Iterator[pa.RecordBatch]:
    """(embedding) -> per task rows (dimension, sum of ``floor(1024 c)``); dimension -1 has the number of vectors."""
    n, total = 0, np.zeros(0, object)
    for batch in source:
        _, x = scaled(batch.column(0), len(total))
        total = np.concatenate([total, np.zeros(x.shape[1] - len(total), object)]) + x.sum(0).astype(object)
        n += len(x)
    yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()),
                                      pa.array([Decimal(int(v)) for v in (n, *total)], _WHOLE)], ["i", "total"])


def _grams(centre: np.ndarray):
    def grams(source) -> Iterator[pa.RecordBatch]:
        """(embedding) -> per task rows (i, j, sum of products of the centred entries), i <= j."""
        total, n = np.zeros((len(centre),) * 2, object), 0
        for batch in source:
            _, x = scaled(batch.column(0), len(centre))
            total, n = total + _products(x - centre), n + len(x)
        i, j = np.triu_indices(len(centre))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                                              pa.array([Decimal(int(v)) for v in total[i, j]], _WHOLE)], ["i", "j", "total"])

    return grams


class Moments(NamedTuple):
    """``n`` vectors, their sums ``S`` of x (whole numbers) and the covariance."""

    n: int
    sums: list[int]
    covariance: np.ndarray


def moments(vectors: DataFrame, embedding: str = "embedding") -> Moments:
    """Sums by Spark over all tasks' partial sums; the driver gets one number for each pair of dimensions."""
    column = vectors.select(F.col(embedding))
    sums = column.mapInArrow(_sums, "i int, total decimal(38,0)").groupBy("i").agg(F.sum("total").alias("total")).collect()
    total = {r["i"]: int(r["total"]) for r in sums}
    n, width = total.pop(-1, 0), max(total, default=-1) + 1
    if not n or not width:
        return Moments(n, [OFFSET * n] * width, np.zeros((width, width)))
    plain = [total[i] for i in range(width)]
    centre = [(2 * s + n) // (2 * n) for s in plain]
    rest = [s - n * c for s, c in zip(plain, centre, strict=True)]
    pairs = column.mapInArrow(_grams(np.array(centre, np.int64)), "i int, j int, total decimal(38,0)").groupBy("i", "j").agg(
        F.sum("total").alias("total")).collect()
    covariance = np.zeros((width, width))
    for r in pairs:
        i, j = r["i"], r["j"]
        # Whole numbers divided once: the nearest double.
        covariance[i, j] = covariance[j, i] = (n * int(r["total"]) - rest[i] * rest[j]) / (n * n)
    return Moments(n, [s + OFFSET * n for s in plain], covariance)


# --- the spectrum ---------------------------------------------------------------
class Factors:
    """``P A P' = L D L'`` of a symmetric matrix with diagonal blocks of one or two rows."""

    def __init__(self, matrix: np.ndarray):
        a = matrix.copy()
        n, k = len(a), 0
        self.order, self.blocks, self.lower = np.arange(n), [], a
        while k < n:
            size = self._pivot(a, k)
            end = k + size
            d, c = a[k:end, k:end].copy(), a[end:, k:end].copy()
            if size == 1 and d[0, 0] == 0:
                # The column below is zero too, else a block of two had been taken.
                ratio = np.zeros_like(c)
            else:
                ratio = c / d[0, 0] if size == 1 else np.linalg.solve(d, c.T).T
            a[end:, end:] -= ratio @ c.T
            a[end:, k:end] = ratio
            self.blocks.append((k, d))
            k = end

    def _swap(self, a: np.ndarray, i: int, j: int) -> None:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]
        self.order[[i, j]] = self.order[[j, i]]

    def _pivot(self, a: np.ndarray, k: int) -> int:
        if k == len(a) - 1:
            return 1
        column = np.abs(a[k + 1:, k])
        r = k + 1 + int(column.argmax())
        largest, own = column.max(), abs(a[k, k])
        if own >= ALPHA * largest:
            return 1
        row = np.abs(a[k:, r])
        row[r - k] = 0
        other = row.max()
        if own * other >= ALPHA * largest ** 2:
            return 1
        if abs(a[r, r]) >= ALPHA * other:
            self._swap(a, k, r)
            return 1
        self._swap(a, k + 1, r)
        return 2

    def positive(self) -> int:
        """The number of positive eigenvalues, by the law of inertia that of the blocks."""
        count = 0
        for _, d in self.blocks:
            if len(d) == 1:
                count += d[0, 0] > 0
            else:
                count += 1 if d[0, 0] * d[1, 1] < d[0, 1] * d[1, 0] else 2 * (d[0, 0] > 0)
        return int(count)

    def solve(self, b: np.ndarray, tiny: float) -> np.ndarray:
        x = b[self.order].copy()
        for k, d in self.blocks:
            end = k + len(d)
            x[end:] -= self.lower[end:, k:end] @ x[k:end]
        for k, d in reversed(self.blocks):
            end = k + len(d)
            if len(d) == 1:
                x[k] /= d[0, 0] if abs(d[0, 0]) > tiny else tiny
            else:
                x[k:end] = np.linalg.solve(d, x[k:end])
            x[k:end] -= self.lower[end:, k:end].T @ x[end:]
        out = np.empty_like(x)
        out[self.order] = x
        return out


class Spectrum:
    """Leading eigenpairs of a positive semidefinite matrix, one after another by falling eigenvalue."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        self.norm = float(np.abs(matrix).sum(0).max(initial=0))
        #: What rounding can move an eigenvalue by.
        self.blur = 4 * max(len(matrix), 1) * EPS * self.norm
        self.counts: dict[float, int] = {}
        self.found: list[np.ndarray] = []

    def above(self, shift: float) -> int:
        """How many eigenvalues are larger than ``shift``."""
        if shift not in self.counts:
            self.counts[shift] = self._shifted(shift).positive()
        return self.counts[shift]

    def _shifted(self, shift: float) -> Factors:
        return Factors(self.matrix - shift * np.eye(len(self.matrix)))

    def _unit(self, x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for v in self.found:
                x = x - (v @ x) * v
        return x / np.linalg.norm(x)

    def interval(self, k: int, low: float, high: float) -> tuple[float, float]:
        """Halve (low, high) until it and as much again on both sides hold eigenvalue ``k`` alone, or until its width
        is that of rounding."""
        while high - low > self.blur:
            width = high - low
            if self.above(low - width) == k and self.above(high + width) == k - 1:
                break
            middle = (low + high) / 2
            low, high = (middle, high) if self.above(middle) >= k else (low, middle)
        return low, high

    def next(self) -> tuple[float, np.ndarray] | None:
        """The next eigenpair; None where the eigenvalue is zero to rounding."""
        k = len(self.found) + 1
        if not self.norm or self.above(self.blur) < k:
            return None
        # Start from the counts that are known.
        low = max(s for s, c in self.counts.items() if c >= k)
        high = min([self.norm + self.blur, *(s for s, c in self.counts.items() if c < k)])
        while True:
            low, high = self.interval(k, low, high)
            value, vector, rest = self._iterate(k, low, high)
            margin = 2 * rest + self.blur
            if low - margin <= value <= high + margin and self.above(value - margin) >= k and self.above(value + margin) < k:
                self.found.append(vector)
                return value, vector
            if high - low <= self.blur:
                raise ArithmeticError(f"eigenvalue {k} is not certified")
            middle = (low + high) / 2
            low, high = (middle, high) if self.above(middle) >= k else (low, middle)

    def _iterate(self, k: int, low: float, high: float) -> tuple[float, np.ndarray, float]:
        middle, tiny = (low + high) / 2, EPS * self.norm
        x = self._unit(np.random.default_rng(k).standard_normal(len(self.matrix)))
        factors = self._shifted(middle)
        for _ in range(4):
            x = self._unit(factors.solve(x, tiny))
        best = (np.inf, 0.0, x)
        for _ in range(12):
            image = self.matrix @ x
            value = float(x @ image)
            rest = float(np.linalg.norm(image - value * x))
            if rest >= best[0]:
                break
            best = (rest, value, x)
            if rest <= EPS * self.norm:
                break
            x = self._unit(self._shifted(value).solve(x, tiny))
        rest, value, x = best
        return value, x * np.sign(x[np.abs(x).argmax()]), rest


# --- the operator ---------------------------------------------------------------
class Whitening(NamedTuple):
    """Components as columns; ``values`` is zero where a component does not vary."""

    moments: Moments
    values: np.ndarray
    components: np.ndarray
    explained: list[float | None]
    identity_error: float | None


def fit(vectors: DataFrame, components: int = COMPONENTS, embedding: str = "embedding") -> Whitening:
    found = moments(vectors, embedding)
    v = found.covariance
    count, spectrum = min(components, len(v)), Spectrum(v)
    values, basis = np.zeros(count), np.zeros((len(v), count))
    for k in range(count):
        pair = spectrum.next()
        if pair is None:
            break
        values[k], basis[:, k] = pair
    trace = float(np.trace(v))
    real = values > 0
    w = basis[:, real] / np.sqrt(values[real])
    error = float(np.abs(w.T @ v @ w - np.eye(real.sum())).max()) if real.any() else None
    return Whitening(found, values, basis, [float(e / trace) if trace > 0 else None for e in values], error)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int | None]]:
    """``n x - S`` in doubles, and the exact sum of its squares (None where that is no long)."""
    s = np.array(sums, object)
    if n * (int(np.abs(x).max(initial=0)) + OFFSET) < 1 << 61 and all(abs(v) < 1 << 61 for v in sums):
        away = n * (x + OFFSET) - s.astype(np.int64)
    else:
        away = n * (x.astype(object) + OFFSET) - s
    plain = away.astype(float)
    if away.dtype != object and float((plain ** 2).sum(1).max(initial=0)) < 2.0 ** 62:
        return plain, (away ** 2).sum(1).tolist()
    squares = (away.astype(object) ** 2).sum(1)
    return plain, [int(v) if v < 1 << 63 else None for v in squares]


def whitened_column(model: Whitening):
    """An Arrow function from embeddings to (deviation, whitened); null for vectors that are dropped."""
    n, sums = model.moments.n, model.moments.sums
    real = model.values > 0
    weights = np.where(real, model.components / np.sqrt(np.where(real, model.values, 1)), np.nan)
    width = len(sums)

    @F.arrow_udf("deviation long, whitened array<double>")
    def project(column: pa.Array) -> pa.Array:
        stays, x = scaled(column, width)
        away, squares = _deviations(x, n, sums)
        flat = ((away / n) @ weights).ravel() if n else np.empty(0)
        whitened = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * weights.shape[1], pa.int32()),
                                            pa.array(flat, pa.float64(), mask=np.isnan(flat)))
        place = pa.array(np.where(stays, np.cumsum(stays) - 1, 0), pa.int64(), mask=~stays)
        return pa.StructArray.from_arrays([pa.array(squares, pa.int64()).take(place), whitened.take(place)],
                                          ["deviation", "whitened"], mask=pa.array(~stays))

    return project


def whiten(vectors: DataFrame, model: Whitening, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Per remaining row: vec_id, deviation and the array whitened."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), whitened_column(model)(F.col(embedding)).alias("p"))
    return rows.where(F.col("p").isNotNull()).select("vec_id", "p.deviation", "p.whitened")


def component_rows(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
                   components: int = COMPONENTS) -> DataFrame:
    """Per remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    model = fit(vectors, components, embedding)
    rows = whiten(vectors, model, vec_id, embedding).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*[F.lit(e).cast("double") for e in model.explained]) if model.explained else F.array(F.lit(None).cast("double"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.moments.n).cast("long").alias("n"), "deviation",
                       "whitened", explained[F.col("at")].alias("explained"),
                       F.lit(model.identity_error).cast("double").alias("identity_error"))
