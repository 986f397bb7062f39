"""Whitening of embeddings by hierarchical SVD merging.

A summary of some vectors is their number, their sums, and the singular values and right vectors of the
centred matrix, all of them. Two summaries merge into the summary of the union without loss: the scaled
vectors of both are stacked, a row sqrt(n1 n2 / (n1 + n2)) (mean1 - mean2) corrects for the two means, and
the SVD of the stack gives the new values and vectors. Each partition folds its rows into one summary; rounds
merge them ``FAN_IN`` at a time until one is left. Eigenvalues of the covariance are the squared singular
values over n, its eigenvectors the singular vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import cut, let_go, load, quoted, settle

#: Summaries that one task merges; one of them has the size of a covariance matrix.
FAN_IN = 8
#: Rows that a partition holds before it folds them into its summary, at least; four times the width if that is more.
FOLD_ROWS = 4096
_SUMMARY = "width int, slot long, n long, sums binary, values binary, vectors binary"
_ARROW = pa.schema([("width", pa.int32()), ("slot", pa.int64()), ("n", pa.int64()), ("sums", pa.binary()), ("values", pa.binary()), ("vectors", pa.binary())])


@dataclass(frozen=True)
class Summary:
    """n vectors: their sums, and the singular values (falling) and right vectors (rows) of the centred matrix.

    Sums of whole numbers are exact up to 2^53.
    """

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def eigenvalues(self) -> np.ndarray:
        return self.values**2 / self.n


def _svd(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, s, v = np.linalg.svd(stack, full_matrices=False)
    return s, v


def summarize(x: np.ndarray) -> Summary:
    """The summary of the rows of ``x``, a matrix of doubles with at least one row."""
    n, sums = len(x), x.sum(0)
    # n * x - S is exact for whole numbers of moderate size, so centring adds one rounding and no more.
    return Summary(n, sums, *_svd((n * x - sums) / n))


def merge(a: Summary, b: Summary) -> Summary:
    n = a.n + b.n
    gap = (b.n * a.sums - a.n * b.sums) / (a.n * b.n)
    correction = np.sqrt(a.n / n * b.n) * gap
    s, v = _svd(np.vstack((a.values[:, None] * a.vectors, b.values[:, None] * b.vectors, correction[None, :])))
    d = len(a.sums)
    return Summary(n, a.sums + b.sums, s[:d], v[:d])


def _packed(done: dict[int, Summary], slot: int) -> pa.RecordBatch:
    rows = [{"width": w, "slot": slot, "n": s.n, "sums": s.sums.tobytes(), "values": s.values.tobytes(), "vectors": s.vectors.tobytes()} for w, s in done.items()]
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def _unpacked(row: dict) -> Summary:
    return Summary(row["n"], np.frombuffer(row["sums"]), np.frombuffer(row["values"]), np.frombuffer(row["vectors"]).reshape(-1, row["width"]))


def _by_width(v: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each width of an Arrow list column without nulls."""
    widths, flat = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(widths) - widths
    for w in np.unique(widths[widths > 0]).tolist():
        at = np.flatnonzero(widths == w)
        yield at, flat[starts[at][:, None] + np.arange(w)]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One summary a width from a partition of vectors."""
    held: dict[int, list[np.ndarray]] = {}
    done: dict[int, Summary] = {}

    def take(width: int) -> None:
        s = summarize(np.concatenate(held.pop(width)))
        done[width] = merge(done[width], s) if width in done else s

    for batch in batches:
        for _, x in _by_width(batch.column(0)):
            w = x.shape[1]
            held.setdefault(w, []).append(x)
            if sum(map(len, held[w])) >= max(FOLD_ROWS, 4 * w):
                take(w)
    for w in list(held):
        take(w)
    yield _packed(done, TaskContext.get().partitionId())


def _merge_group(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["slot"])
    total = _unpacked(rows[0])
    for r in rows[1:]:
        total = merge(total, _unpacked(r))
    return pa.Table.from_batches([_packed({rows[0]["width"]: total}, rows[0]["slot"] // FAN_IN)])


def fit(vectors: DataFrame, column: str) -> dict[int, Summary]:
    """The summary of all vectors of each width; the vectors hold no nulls and are finite.

    What comes to the driver is one matrix of width by width numbers a width.
    """
    settle(vectors.sparkSession)
    parts = cut(vectors.select(quoted(column).cast("array<double>").alias("v")).mapInArrow(_fold, _SUMMARY))
    while (parts.agg(F.max("slot")).first()[0] or 0) > 0:
        keyed = parts.withColumn("_g", F.floor(F.col("slot") / FAN_IN))
        merged = cut(keyed.groupBy("width", "_g").applyInArrow(lambda t: _merge_group(t.drop_columns("_g")), _SUMMARY))
        let_go(parts)
        parts = merged
    return {r["width"]: _unpacked(r.asDict()) for r in parts.collect()}


@dataclass(frozen=True)
class Whitener:
    """Mean, components (rows, by falling eigenvalue), their eigenvalues (0: no variance) and the trace of the covariance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.sums) / self.n

    def apply(self, x: np.ndarray) -> np.ndarray:
        e = self.eigenvalues
        return np.where(e > 0, self.centred(x) @ self.components.T / np.sqrt(np.where(e > 0, e, 1)), 0.0)


def whitener(s: Summary, components: int) -> Whitener:
    """The first ``components`` components; signs make the largest entry of each positive.

    A singular value that is rounding error beside the largest, or beside the mean, counts as none.
    """
    scale = max(s.values[0] if len(s.values) else 0.0, np.abs(s.sums).max(initial=0.0) / np.sqrt(s.n))
    least = scale * max(len(s.sums), 8) * np.finfo(float).eps
    e, v = np.where(s.values > least, s.eigenvalues, 0.0)[:components], s.vectors[:components]
    v = v * np.where(v[np.arange(len(v)), np.abs(v).argmax(1)] < 0, -1.0, 1.0)[:, None]
    return Whitener(s.n, s.sums, v, e, float(s.eigenvalues.sum()))


def _per_width(models: dict[int, Whitener], f, kind: pa.DataType):
    def rows(v: pa.Array) -> pa.Array:
        out: list = [None] * len(v)
        for at, x in _by_width(v):
            for i, y in zip(at, f(models[x.shape[1]], x), strict=True):
                out[i] = y
        return pa.array(out, kind)

    return rows


def whitened(vectors: DataFrame, column: str, models: dict[int, Whitener]) -> Column:
    """An expression: the whitened entries of the vector, one a component."""
    return F.arrow_udf(_per_width(models, lambda m, x: m.apply(x), pa.list_(pa.float64())), "array<double>")(quoted(column).cast("array<double>"))


def usable(column: str) -> Column:
    """Vectors with entries, none of them null or not finite."""
    v = quoted(column)
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def identity_error(table: DataFrame, column: str, models: dict[int, Whitener]) -> float:
    """The largest entry of |covariance - identity| of whitened vectors over components that have variance; 0.0 without any."""
    worst = 0.0
    for width, s in fit(table, column).items():
        live = np.all([m.eigenvalues > 0 for m in models.values() if len(m.eigenvalues) == width], axis=0)
        gap = s.vectors.T * s.eigenvalues @ s.vectors - np.eye(width)
        worst = max(worst, np.abs(gap[np.ix_(live, live)]).max(initial=0.0))
    return float(worst)


def whiten(table: DataFrame, column: str = "embedding", components: int | None = None) -> DataFrame:
    """The rows of ``table`` with a usable vector, the vector whitened (doubles; all components or the first ones).

    Null and empty vectors and vectors with null or non-finite entries go. Vectors of unlike widths are whitened
    apart, each width by its own fit. Components without variance (one row, repeated rows, fewer rows than
    entries) are 0.0. Repeated rows count as often as they are there; ties between eigenvalues are in the order
    of the SVD. Other columns stay, whatever their names; an empty table gives an empty one.
    """
    good = table.filter(usable(column))
    models = {w: whitener(s, components or w) for w, s in fit(good, column).items()}
    return good.withColumn(column, whitened(good, column, models)) if models else good.withColumn(column, quoted(column).cast("array<double>"))


def _deviations(m: Whitener, x: np.ndarray) -> list[int | None]:
    """Exact sums of (n * x - S)^2; null beyond a long."""
    if m.n * np.abs(x).max(initial=0.0) < 2**53 and len(m.sums) * float(np.square(m.n * x - m.sums).max(initial=0.0)) < 2**62:
        y = m.n * x.astype(np.int64) - m.sums.astype(np.int64)
        return (y * y).sum(1).tolist()
    s = [int(v) for v in m.sums]
    exact = (sum((m.n * int(c) - t) ** 2 for c, t in zip(row, s, strict=True)) for row in x)
    return [v if v < 2**63 else None for v in exact]


_FAR = 1 << 62


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component (1 to 8), n, deviation, whitened, explained and identity_error for every usable row of ``embeddings``.

    See ``whiten`` for vectors that go, widths, missing variance and empty tables; vec_id may be null or repeat.
    Entries become whole numbers, floor(1024 * c) + 100000, the floor between -2^62 and 2^62. A deviation beyond a long is null.
    """
    rows = load(spark, sf_dir, "embeddings").filter(usable("embedding"))
    whole = rows.select("vec_id", F.transform("embedding", lambda c: F.least(F.greatest(F.floor(1024 * c.cast("double")), F.lit(-_FAR)), F.lit(_FAR)) + 100000).alias("x"))
    models = {w: whitener(s, 8) for w, s in fit(whole, "x").items()}
    if not models:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    x = F.col("x").cast("array<double>")
    told = _per_width(models, lambda m, x: ({"n": m.n, "deviation": d, "explained": (m.eigenvalues / (m.trace or 1.0)).tolist()} for d in _deviations(m, x)), pa.struct([("n", pa.int64()), ("deviation", pa.int64()), ("explained", pa.list_(pa.float64()))]))
    done = cut(whole.select("vec_id", whitened(whole, "x", models).alias("w"), F.arrow_udf(told, "struct<n:bigint,deviation:bigint,explained:array<double>>")(x).alias("d")))
    error = identity_error(done, "w", models)
    each = done.select("vec_id", "d", F.posexplode("w").alias("i", "whitened"))
    return each.select("vec_id", (F.col("i") + 1).alias("component"), "d.n", "d.deviation", "whitened", F.get("d.explained", F.col("i")).alias("explained"), F.lit(error).alias("identity_error"))
