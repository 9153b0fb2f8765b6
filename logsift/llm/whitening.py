"""Whitening of embeddings by a polarisation covariance: only exact sums of squares, also for the cross terms.

Entries c become integers x = floor(scale * c) + shift. With S the sums of the n vectors and m the integers next to S / n, two
aggregates follow: of every dimension the sum of (x_i - m_i) ** 2, and of every pair of dimensions that of ((x_i - m_i) + (x_j - m_j)) ** 2.
All are exact integers, so half the difference (pair less both squares) is the exact cross sum, and the centring at S / n
is completed without rounding: cov = (n * cross - T_i * T_j) / n ** 2 with T = S - n * m. The matrix is rounded once to doubles
and goes to ``eigh``. Tasks add up in 64-bit integers while a slice cannot overflow, in Python's integers beyond.

Defined results. Rows whose vector is null, or has null or non-finite entries, are left out; so are empty vectors, which have no
component. Vectors of another length are another list with its own n, sums and components; each length's model (``top`` vectors) goes
with the tasks. Products beyond a double's range and x beyond a long's stay at the limit. Where a sum does not fit DECIMAL(38), the
values of that list are null; a deviation beyond a long is null. A component without variance (eigenvalue at most 1e-12 of the largest) has
null in ``whitened`` and takes no part in ``identity_error``, which is one number per list. Rows that repeat or have no id count and
come out as often as they are there.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import map_batches, shared

SCALE, SHIFT, TOP = 1024, 100_000, 8
#: Numbers of a slice that are held at once, and the share of the largest eigenvalue that counts as no variance.
HELD, NO_VARIANCE = 1 << 21, 1e-12
EXACT = "decimal(38,0)"


def finite_vectors(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part, as doubles."""
    entries = F.col(vector).cast("array<double>")
    bad = F.exists(entries, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.when(F.size(entries) > 0, ~bad)
    return rows.select(F.col(vec_id).alias("vec_id"), entries.alias("v")).where(F.coalesce(whole, F.lit(False)))


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) + SHIFT as int64."""
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(SCALE * values), -(2.0**63), 2.0**63 - 2**11)
    whole = whole.astype(np.int64)
    return np.where(whole > 2**63 - 1 - SHIFT, 2**63 - 1, whole + SHIFT)


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(length, rows, matrix of integers) of the rows of each length, some rows at a time."""
    lengths = np.diff(batch["v"].offsets.to_numpy())
    for length in map(int, np.unique(lengths)):
        rows = batch.take(pa.array(np.flatnonzero(lengths == length)))
        size = max(1, HELD // length)
        for low in range(0, rows.num_rows, size):
            part = rows.slice(low, size)
            yield length, part, integers(part["v"].flatten().to_numpy().reshape(-1, length))


def column_sums(values: np.ndarray) -> list[int]:
    """Exact sums of the columns."""
    high, low = values >> 32, values & 0xFFFFFFFF
    return [int(a) * 2**32 + int(b) for a, b in zip(high.sum(axis=0), low.sum(axis=0), strict=True)]


def square_sums(values: np.ndarray) -> list[int]:
    """Exact sums of the squares of the columns."""
    most = int(np.abs(values).max(initial=0)) if values.dtype != object else 2**63
    if most * most * len(values) >= 2**63:
        values = values.astype(object)
    return [int(total) for total in (values * values).sum(axis=0)]


def centred(values: np.ndarray, middle: list[int]) -> np.ndarray:
    """x - m; Python's integers where the sum of two differences might not fit a long."""
    if max(map(abs, middle), default=0) < 2**60 and int(values.max(initial=0)) < 2**60 and int(values.min(initial=0)) > -(2**60):
        return values - np.array(middle, np.int64)
    return values.astype(object) - np.array(middle, object)


def _emitted(totals: dict, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of integer keys with an exact total; totals that a DECIMAL(38) cannot hold become null."""
    keys = [pa.array(column, pa.int32()) for column in zip(*totals, strict=True)]
    texts = pa.array([str(x) if abs(x) < 10**38 else None for x in totals.values()], pa.string())
    if totals:
        yield pa.RecordBatch.from_arrays([*keys, texts], [*names, "total"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(length, i, total): sums of a task by dimension, the number of vectors under i = -1."""
    totals: dict[tuple[int, int], int] = defaultdict(int)
    for batch in batches:
        for length, rows, values in by_length(batch):
            totals[length, -1] += rows.num_rows
            for i, total in enumerate(column_sums(values)):
                totals[length, i] += total
    yield from _emitted(totals, ["length", "i"])


def _squares(middles: dict[int, list[int]]):
    """(length, i, j, total): sums of squares of a task, of one dimension under i = j, of the sum of two under i < j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int, int], int] = defaultdict(int)
        for batch in batches:
            for length, _, values in by_length(batch):
                values = centred(values, middles[length])
                for i in range(length):
                    pairs = values[:, i:] + values[:, i : i + 1]
                    pairs[:, 0] = values[:, i]
                    for j, total in enumerate(square_sums(pairs), i):
                        totals[length, i, j] += total
        yield from _emitted(totals, ["length", "i", "j"])

    return run


def added(rows: DataFrame, function, names: list[str]) -> DataFrame:
    """Totals of the tasks, added; null if one of them, or their sum, is beyond DECIMAL(38)."""
    fields = ", ".join(f"{name} int" for name in names)
    parts = rows.select("v").mapInArrow(function, f"{fields}, total string")
    total = F.col("total").cast(EXACT)
    return parts.groupBy(*names).agg(F.when(F.count_if(total.isNull()) == 0, F.try_sum(total)).alias("total"))


class Model:
    """Centre and components of the vectors of one length."""

    def __init__(self, n: int, sums: list[int], middle: list[int], squares: dict[tuple[int, int], int | None], top: int):
        self.n, self.middle, size = n, middle, len(sums)
        self.rest = [s - n * m for s, m in zip(sums, middle, strict=True)]
        self.values, self.vectors = None, None
        if None in squares.values():
            self.explained = np.full(min(top, size), np.nan)
            return
        self.covariance = np.empty((size, size))
        for i in range(size):
            for j in range(i, size):
                twice = 2 * squares[i, j] if i == j else squares[i, j] - squares[i, i] - squares[j, j]
                exact = n * twice - 2 * self.rest[i] * self.rest[j]
                self.covariance[i, j] = self.covariance[j, i] = exact / (2 * n * n)
        values, vectors = np.linalg.eigh(self.covariance)
        order = np.argsort(-values, kind="stable")[:top]
        trace = float(np.trace(self.covariance))
        self.values, self.vectors = values[order], vectors[:, order]
        self.explained = self.values / trace if trace > 0 else np.full(len(order), np.nan)
        self.varies = self.values > NO_VARIANCE * max(float(values.max()), 0.0)

    def whitened(self, values: np.ndarray) -> np.ndarray:
        """Rows of components, NaN for those that have no value."""
        if self.values is None:
            return np.full((len(values), len(self.explained)), np.nan)
        offsets = np.array([rest / self.n for rest in self.rest])
        scale = np.sqrt(np.where(self.varies, self.values, np.nan))
        return (centred(values, self.middle).astype(float) - offsets) @ self.vectors / scale

    def deviations(self, values: np.ndarray) -> list[int | None]:
        """Sums over the dimensions of (n * x - S) ** 2; None beyond a long."""
        parts = centred(values, self.middle)
        most = self.n * (1 + max((abs(int(x)) for x in (parts.max(initial=0), parts.min(initial=0))), default=0))
        kind = object if parts.dtype == object or most * most * values.shape[1] >= 2**63 else np.int64
        parts = parts.astype(kind) * self.n - np.array(self.rest, kind)
        return [int(x) if x < 2**63 else None for x in (parts * parts).sum(axis=1)]


def fit(vectors: DataFrame, top: int) -> dict[int, Model]:
    """The model of every length, from two aggregates over all vectors."""
    sums: dict[int, dict[int, int]] = defaultdict(dict)
    for row in added(vectors, _sums, ["length", "i"]).collect():
        sums[row["length"]][row["i"]] = int(row["total"])
    counts = {length: found.pop(-1) for length, found in sums.items()}
    lists = {length: [found[i] for i in range(length)] for length, found in sums.items()}
    middles = {length: [(2 * s + counts[length]) // (2 * counts[length]) for s in found] for length, found in lists.items()}
    squares: dict[int, dict] = defaultdict(dict)
    for row in added(vectors, _squares(middles), ["length", "i", "j"]).collect():
        squares[row["length"]][row["i"], row["j"]] = None if row["total"] is None else int(row["total"])
    return {length: Model(counts[length], lists[length], middles[length], squares[length], top) for length in lists}


def projected(vectors: DataFrame, models: dict[int, Model]) -> DataFrame:
    """(vec_id, length, n, deviation, whitened, explained): one row per vector, arrays over the components."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for length, rows, values in by_length(batch):
            model, count = models[length], rows.num_rows
            white, size = model.whitened(values), len(model.explained)
            offsets = pa.array(np.arange(count + 1) * size, pa.int32())
            parts = [pa.array(x, pa.float64(), from_pandas=True) for x in (white.ravel(), np.tile(model.explained, count))]
            lists, shares = (pa.ListArray.from_arrays(offsets, x) for x in parts)
            constants = [pa.array([length] * count, pa.int32()), pa.array([model.n] * count, pa.int64())]
            deviations = pa.array(model.deviations(values), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [rows["vec_id"], *constants, deviations, lists, shares],
                ["vec_id", "length", "n", "deviation", "whitened", "explained"],
            )

    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, length int, n long, deviation long, whitened array<double>, explained array<double>"
    return map_batches(vectors, run, schema)


def identity_errors(rows: DataFrame, top: int) -> DataFrame:
    """(length, identity_error): the largest absolute entry of the covariance of ``whitened`` less the identity."""

    def entry(i: int, j: int) -> Column:
        return F.abs(F.covar_pop(F.get("whitened", F.lit(i)), F.get("whitened", F.lit(j))) - F.lit(float(i == j)))

    entries = [entry(i, j) for i in range(top) for j in range(i, top)]
    return rows.groupBy("length").agg(F.array_max(F.array(*entries)).alias("identity_error"))


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", top: int = TOP) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every vector and its first ``top`` components."""
    vectors = finite_vectors(rows, vec_id, vector)
    found = shared(projected(vectors, fit(vectors, top)))
    errors = {row["length"]: row["identity_error"] for row in identity_errors(found, top).collect()}
    known = F.create_map(*[F.lit(x) for pair in errors.items() for x in pair]) if errors else F.create_map().cast("map<int,double>")
    parts = F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "part")
    out = found.select("vec_id", "n", "deviation", known[F.col("length")].alias("identity_error"), parts)
    component = (F.col("place") + 1).cast("int").alias("component")
    return out.select(F.col("vec_id").alias(vec_id), component, "n", "deviation", "part.whitened", "part.explained", "identity_error")
