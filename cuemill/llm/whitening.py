"""Whitening of embeddings by a tree of merged singular value decompositions.

Every task keeps of its vectors their number, exact sums, and all singular
values and right singular vectors of the centred rows.  Two such summaries merge
without loss: their scaled singular vectors are stacked with one row that
accounts for the two means, and decomposed again.  Tasks' summaries meet in
groups of a fixed size, level by level, so no task and no group grows with the
table; a summary has as many numbers as a vector's dimensions squared.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.common import staged

#: Components that are returned, summaries that one task merges, and rows that are decomposed at a time.
COMPONENTS, FAN, ROWS = 8, 16, 4096
#: x = floor(SCALE * entry) + SHIFT
SCALE, SHIFT = 1024, 100_000
#: Integers of this size and more don't fit; sums of rows are exact while they are below it.
_MOST = 1 << 62
#: Eigenvalues below this share of the largest one are rounding.
RANK = 1e-12


class Summary:
    """Number, exact sums per dimension (Python integers), and ``axes``: singular vectors times singular values, as rows, of the centred rows."""

    def __init__(self, n: int, sums: list[int], axes: np.ndarray):
        self.n, self.sums, self.axes = n, sums, axes

    @classmethod
    def of(cls, x: np.ndarray, sums: list[int]) -> Summary:
        """Of integers or doubles, row by row; ``sums`` in units of 1 or, for doubles, as they come."""
        n = len(x)
        mean = np.array([s / n for s in sums])
        return cls(n, sums, _axes(x - mean))

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def merged(self, other: Summary) -> Summary:
        n = self.n + other.n
        # exact before the division, as the sums are large and the means close
        apart = np.array([(a * other.n - b * self.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums, strict=True)])
        row = np.sqrt(self.n * other.n / n) * apart
        return Summary(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], _axes(np.vstack([self.axes, other.axes, row])))

    def to_row(self) -> dict:
        return {"n": self.n, "sums": json.dumps(self.sums), "axes": self.axes.astype("<f8").tobytes()}

    @classmethod
    def from_row(cls, row: dict) -> Summary:
        sums = json.loads(row["sums"])
        return cls(row["n"], sums, np.frombuffer(row["axes"], "<f8").reshape(-1, len(sums)))


def _axes(rows: np.ndarray) -> np.ndarray:
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * v


def _merged(found: list[Summary]) -> Summary:
    """Pairs of neighbours, until one is left."""
    while len(found) > 1:
        found = [a.merged(b[0]) if b else a for a, *b in (found[i : i + 2] for i in range(0, len(found), 2))]
    return found[0]


_DDL = "place long, n long, sums string, axes binary"
_ARROW = pa.schema([("place", pa.int64()), ("n", pa.int64()), ("sums", pa.string()), ("axes", pa.binary())])


def _matrix(column: pa.Array, dims: int, kind: str) -> np.ndarray:
    """Lists of ``dims`` numbers as rows."""
    flat = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, dims)


def summary(rows: DataFrame, dims: int, exact: bool = True) -> Summary | None:
    """The summary of ``rows`` (x: arrays of ``dims`` longs, or of doubles if not ``exact``); None if there are none.

    The driver gets one summary.
    """

    def of(x: np.ndarray) -> Summary:
        if not exact:
            return Summary.of(x, x.sum(0).tolist())
        safe = int(np.abs(x).max(initial=0)) * len(x) < _MOST
        sums = x.sum(0).tolist() if safe else [sum(c) for c in zip(*x.tolist(), strict=True)]
        # the whole part of the mean goes before integers become doubles
        near = np.array([s // len(x) for s in sums])
        return Summary(len(x), sums, _axes((x - near).astype(float) - np.array([(s - len(x) * int(m)) / len(x) for s, m in zip(sums, near, strict=True)])))

    def begin(parts):
        place, now = TaskContext.get().partitionId(), None
        for b in parts:
            x = _matrix(b.column(0), dims, "i8" if exact else "f8")
            for i in range(0, len(x), ROWS):
                part = of(x[i : i + ROWS])
                now = now.merged(part) if now else part
        if now:
            yield pa.RecordBatch.from_pylist([{"place": place, **now.to_row()}], _ARROW)

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        found = _merged([Summary.from_row(r) for r in t.sort_by("place").to_pylist()])
        return pa.Table.from_pylist([{"place": key[0].as_py(), **found.to_row()}], _ARROW)

    level = staged(rows.select("x").mapInArrow(begin, _DDL), "summaries")
    tasks = (level.agg(F.max("place")).first()[0] or 0) + 1
    while tasks > 1:
        level = level.groupBy(F.floor(F.col("place") / FAN).cast("long").alias("up")).applyInArrow(merge, _DDL)
        tasks = -(-tasks // FAN)
    last = level.collect()  # one row, or none
    return Summary.from_row(last[0].asDict()) if last else None


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, x) for vectors without null or non-finite entries, of the commonest length (of equally common ones the longest), and that length."""
    v = F.col("v")
    entries = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = entries.where(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    top = fine.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = top["d"] if top else 1
    # a cast to long ends at the largest long; the shift must not pass it
    x = F.transform(v, lambda c: F.floor(c * SCALE).cast("double"))
    x = F.transform(x, lambda c: F.greatest(F.least(c, F.lit(2.0**61)), F.lit(-(2.0**61))).cast("long") + SHIFT)
    return fine.where(F.size(v) == dims).select("id", x.alias("x")), dims


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each vector and component: id, component (from 1), n, deviation (long), whitened, explained, identity_error (doubles).

    Vectors with null or non-finite entries are left out, and so are those of
    another length than most have.  Entries become whole numbers x; all vectors
    are fitted.  ``whitened`` is x less the mean, projected on the component of
    the covariance, over the root of its eigenvalue; ``explained`` the share of
    the eigenvalue; ``deviation`` the exact sum of (n x - S)^2 over dimensions,
    null where it is no long; ``identity_error`` the largest entry of the
    covariance of ``whitened`` less the identity.

    A component whose eigenvalue is nothing but rounding has no rows; so one
    vector, or many equal ones, give none.  Entries beyond 2^51 count as 2^51.
    Rows that repeat and rows without an id count like any other; an empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    rows, dims = whole_numbers(vectors, id_col, vector_col)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, deviation long, w array<double>"
    fit = summary(rows, dims)
    if fit is None:
        return _shaped(rows.sparkSession.createDataFrame([], schema), id_col, 0, [], 0.0)
    _, s, v = np.linalg.svd(fit.axes, full_matrices=False)
    e = s**2 / fit.n
    many = min(components, int((e > RANK * max(e[0], 1e-300)).sum()))
    signs = np.sign(v[np.arange(many), np.abs(v[:many]).argmax(1)])
    base = (v[:many] * signs[:, None] / np.sqrt(e[:many, None])).T
    n, sums = fit.n, fit.sums

    def project(parts):
        total = np.array(sums, object)
        for b in parts:
            x = _matrix(b.column("x"), dims, "i8")
            for i in range(0, max(len(x), 1), ROWS):
                part = x[i : i + ROWS]
                most = int(np.abs(part).max(initial=0)) * n + max(map(abs, sums))
                away = part * n - total.astype("i8") if most < _MOST else part.astype(object) * n - total
                near = int(max(away.max(initial=0), -away.min(initial=0)))
                square = (away if near * near * dims < _MOST else away.astype(object)) ** 2
                deviation = [d if d < 1 << 63 else None for d in square.sum(1).tolist()] if len(part) else []
                w = (away / n).astype(float) @ base
                got = pa.array(w.tolist(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, len(part)), pa.array(deviation, pa.int64()), got], ["id", "deviation", "w"])

    done = staged(rows.mapInArrow(project, schema), "whitened")
    error = 0.0
    if many:
        again = summary(done.select(F.col("w").alias("x")), many, exact=False)
        error = float(np.abs(again.axes.T @ again.axes / again.n - np.eye(many)).max())
    return _shaped(done, id_col, n, (e[:many] / e.sum()).tolist() if many else [], error)


def _shaped(done: DataFrame, id_col: str, n: int, explained: list[float], error: float) -> DataFrame:
    parts = F.array(*[F.struct(F.lit(i + 1).alias("component"), F.get("w", F.lit(i)).alias("whitened"), F.lit(x).alias("explained")) for i, x in enumerate(explained)])
    if not explained:
        parts = F.array().cast("array<struct<component:int,whitened:double,explained:double>>")
    rows = done.select(F.col("id"), "deviation", F.inline(parts))
    return rows.select(
        F.col("id").alias(id_col), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error")
    )
