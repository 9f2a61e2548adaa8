"""Embedding whitening by hierarchical SVD merging.

A task keeps of the vectors it has seen their number, their exact sums and mean, and all singular values and right vectors
of the centred rows. Two such states merge by stacking both scaled bases and one row that corrects for the means, and one
more SVD: the merged state is that of all rows together, nothing is cut off. States merge along a tree, eight at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casebench.llm.common import materialize, release

#: An entry c counts as floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: States that merge into one; doubles that one piece of a task holds at once.
FAN, PIECE = 8, 1 << 21
#: A component whose singular value is a smaller share of the largest has no variance but rounding.
LEAST = 1e-9
SAFE = 1 << 62
STATE = "part int, n long, mean array<double>, sums array<decimal(38,0)>, values array<double>, vectors array<double>"


@dataclass
class State:
    """n rows, their mean, their sums in whole numbers (none for rows that aren't whole), singular values and right vectors."""

    n: int
    mean: np.ndarray
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @property
    def variances(self) -> np.ndarray:
        return self.values**2 / self.n

    def covariance(self) -> np.ndarray:
        return (self.vectors.T * self.variances) @ self.vectors

    def widened(self, d: int) -> State:
        """With d dimensions; the new ones are constant, as shorter vectors end in zeros."""
        more = d - len(self.mean)
        if not more:
            return self
        sums = [*self.sums, *[OFFSET * self.n] * more] if self.sums else []
        return State(self.n, np.append(self.mean, np.full(more, float(OFFSET))), sums, self.values, np.pad(self.vectors, ((0, 0), (0, more))))


def state_of(centred: np.ndarray, n: int, mean: np.ndarray, sums: list[int]) -> State:
    """From rows whose products are those of the centred rows."""
    short = np.linalg.qr(centred, mode="r") if len(centred) > centred.shape[1] else centred
    _, values, vectors = np.linalg.svd(short, full_matrices=False)
    return State(n, mean, sums, values, vectors)


def merged(a: State, b: State) -> State:
    d = max(len(a.mean), len(b.mean))
    a, b = a.widened(d), b.widened(d)
    n = a.n + b.n
    correction = np.sqrt(a.n / n * b.n) * (a.mean - b.mean)
    sums = [x + y for x, y in zip(a.sums, b.sums, strict=True)]
    mean = np.array([x / n for x in sums]) if sums else a.mean + (b.mean - a.mean) * (b.n / n)
    return state_of(np.vstack([a.values[:, None] * a.vectors, b.values[:, None] * b.vectors, correction]), n, mean, sums)


def pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, row after the last, whole numbers of the rows); a shorter vector ends in zeros."""
    col = batch.column("embedding")
    offsets = np.asarray(col.offsets)
    flat = np.asarray(col.values, dtype=np.float64)
    lengths = np.diff(offsets)
    d = int(lengths.max(initial=0))
    step = max(1, PIECE // max(d, 1))
    for lo in range(0, len(col), step):
        hi = min(lo + step, len(col))
        rows = np.zeros((hi - lo, d))
        rows[np.arange(d) < lengths[lo:hi, None]] = flat[offsets[lo] : offsets[hi]]
        with np.errstate(over="ignore"):
            scaled = np.floor(SCALE * rows)
        yield lo, hi, np.clip(scaled, -float(1 << 61), float(1 << 61)).astype(np.int64) + OFFSET


def apart(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * row - sums, exact: 64 bits where they hold it and its squares' sum, else Python's numbers."""
    d = rows.shape[1]
    if not rows.size or (n * int(np.abs(rows).max()) < SAFE and max(map(abs, sums)) < SAFE):
        out = n * rows - np.array(sums, np.int64).reshape(1, d)
        if not out.size or d * int(np.abs(out).max()) ** 2 < SAFE:
            return out
        return out.astype(object)
    return n * rows.astype(object) - np.array(sums, object).reshape(1, d)


def whole_state(rows: np.ndarray) -> State:
    m = len(rows)
    exact = rows if not rows.size or m * int(np.abs(rows).max()) < SAFE else rows.astype(object)
    sums = [int(x) for x in exact.sum(axis=0)]
    return state_of(apart(rows, m, sums).astype(np.float64) / m, m, np.array([x / m for x in sums]), sums)


def plain_state(rows: np.ndarray) -> State:
    mean = rows.mean(axis=0)
    return state_of(rows - mean, len(rows), mean, [])


def as_batch(part: int, s: State) -> pa.RecordBatch:
    sums = pa.array([[Decimal(x) for x in s.sums]], pa.list_(pa.decimal128(38)))
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([s.n], pa.int64()), *(x if isinstance(x, pa.Array) else pa.array([np.ravel(x)], pa.list_(pa.float64())) for x in (s.mean, sums, s.values, s.vectors))], names=["part", "n", "mean", "sums", "values", "vectors"])


def from_row(row) -> State:
    return State(row["n"], np.array(row["mean"]), [int(x) for x in row["sums"]], np.array(row["values"]), np.array(row["vectors"]).reshape(len(row["values"]), len(row["mean"])))


def states(batches: Iterator[pa.RecordBatch], of: Callable[[np.ndarray], State]) -> Iterator[pa.RecordBatch]:
    """One state for a task."""
    from pyspark import TaskContext

    own = None
    for batch in batches:
        for _, _, rows in pieces(batch):
            new = of(rows)
            own = merged(own, new) if own else new
    if own:
        yield as_batch(TaskContext.get().partitionId(), own)


def merge_group(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    own = from_row(rows[0])
    for r in rows[1:]:
        own = merged(own, from_row(r))
    return pa.Table.from_batches([as_batch(rows[0]["part"] // FAN, own)])


def combined(rows: DataFrame, of: Callable[[np.ndarray], State]) -> State | None:
    """The state of all rows: tasks' states are written, then merged by groups of FAN until one is left, which the driver gets."""
    level = materialize(rows.mapInArrow(lambda it: states(it, of), STATE), "states")
    most = level.agg(F.max("part").alias("most")).first()["most"]
    tree = level
    while most is not None and most > 0:
        tree = tree.groupBy(F.expr(f"part div {FAN}")).applyInArrow(merge_group, STATE)
        most //= FAN
    last = tree.collect()
    release(level)
    return from_row(last[0]) if last else None


def usable(table: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows whose vector is there and holds only finite numbers."""
    given = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return given.filter(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


@dataclass
class Whitening:
    """What is learned of a table: number of rows, sums, the components kept (as columns), their variances, the total variance."""

    n: int
    sums: list[int]
    basis: np.ndarray
    variances: np.ndarray
    total: float

    def deviations(self, rows: np.ndarray) -> np.ndarray:
        """n * row - sums of rows that may be shorter than the longest vector."""
        d = len(self.sums)
        return apart(np.pad(rows, ((0, 0), (0, d - rows.shape[1])), constant_values=OFFSET), self.n, self.sums)

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations.astype(np.float64) / self.n) @ self.basis / np.sqrt(self.variances)


def fit(table: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a usable table; None if it is empty."""
    found = combined(table, whole_state)
    if found is None:
        return None
    kept = [k for k in range(min(components, len(found.values))) if found.values[k] > LEAST * found.values[0]] if found.values.size else []
    return Whitening(found.n, found.sums, found.vectors[kept].T, found.variances[kept], float(found.variances.sum()))


def emitted(batches: Iterator[pa.RecordBatch], model: Whitening, error: float) -> Iterator[pa.RecordBatch]:
    k = len(model.variances)
    explained = model.variances / model.total
    for batch in batches:
        for lo, hi, rows in pieces(batch):
            apart_ = model.deviations(rows)
            squares = [int(x) for x in (apart_ * apart_).sum(axis=1)]
            m = hi - lo
            ids = batch.column("vec_id").slice(lo, m).take(pa.array(np.repeat(np.arange(m), k)))
            deviation = pa.array([x if x < 1 << 63 else None for x in squares], pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), deviation, pa.array(model.whitened(apart_).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )


def whiten(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each usable row and component.

    Left out: rows whose vector is null or holds null or non-finite entries. A shorter vector counts as one with zeros at its
    end; null and repeated ids stay, rows with the same vector count each; other columns are ignored. Components without
    variance are left out, so fewer than `components` come of a table with few dimensions or different vectors, and none (no
    rows) of an empty one, of one row, or of equal rows. deviation is exact; beyond 64 bits it is null. An entry beyond 2**61
    in scale counts as 2**61. The table is read three times: fit, check of the covariance, result.
    """
    good = usable(table)
    model = fit(good, components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.variances):
        return table.sparkSession.createDataFrame([], schema)
    seen = combined(good, lambda rows: plain_state(model.whitened(model.deviations(rows))))
    error = float(np.abs(seen.covariance() - np.eye(len(model.variances))).max())
    return good.mapInArrow(lambda it: emitted(it, model, error), schema)


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
