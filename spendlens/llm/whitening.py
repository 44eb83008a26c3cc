"""Whitening of vectors by a bidiagonal qd solver.

Centred rows shrink to one triangle R by blockwise QR: every task folds its rows into a triangle
of its own, and tasks fold ``FAN`` triangles into one until a single one is left. Only that triangle
(dimension by dimension, whatever the number of rows) reaches the driver, where ``bidiagonal`` finds
the singular values of R, the roots of n times the variances, and the right vectors. The covariance
itself is never formed, so small variances are not lost by squaring.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm.bidiagonal import EPS, right_vectors
from spendlens.llm.shared import named, stored, table
from spendlens.llm.vector_blocks import matrix

SCALE, OFFSET = 64, 1_000_000
#: Triangles folded by one task, and entries (not rows) worked on at once.
FAN, ENTRIES = 8, 2_000_000
RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def grid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id``, ``x`` (whole numbers) and ``dim`` of rows whose vector is neither null nor partly null, infinite or NaN."""
    most = 2 ** 63 - 1 - OFFSET
    whole = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where(
        F.coalesce(whole, F.lit(False)) & (F.size("vector") > 0))
    x = F.transform("vector", lambda c: F.least(F.floor(F.lit(SCALE) * c), F.lit(most)) + F.lit(OFFSET))
    return kept.select("vec_id", x.alias("x"), F.size("vector").alias("dim"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Dimension, rows and their ``x`` as a matrix, some ``ENTRIES`` at a time."""
    for batch in batches:
        dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
        for dim in np.unique(dims):
            part = batch if len(np.unique(dims)) == 1 else batch.filter(pa.array(dims == dim))
            rows = max(1, ENTRIES // int(dim))
            for start in range(0, part.num_rows, rows):
                some = part.slice(start, rows)
                yield int(dim), some, matrix(pa.chunked_array([some.column(some.schema.get_field_index("x"))]))


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and sums per dimension and place; halves of 32 bits, so that no sum overflows."""
    seen: dict[int, list] = {}
    for dim, _, x in _blocks(batches):
        had = seen.setdefault(dim, [0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)])
        had[0] += len(x)
        had[1] += (x >> 32).sum(0)
        had[2] += (x & 0xFFFFFFFF).sum(0)
    for dim, (n, high, low) in seen.items():
        yield pa.RecordBatch.from_pydict({"dim": pa.array([dim] * dim, pa.int32()), "place": pa.array(range(dim), pa.int32()),
                                          "n": pa.array([n] * dim, pa.int64()), "high": pa.array(high), "low": pa.array(low)})


class Centre:
    """Exact count and sums of a fit list, and rows relative to its mean."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.sums = n, sums
        self.floor = [s // n for s in sums]
        self.rest = np.array([(s - n * f) / n for s, f in zip(sums, self.floor, strict=True)])
        self.small = max(map(abs, self.floor), default=0) < 2 ** 61

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - mean`` in double precision: whole parts are subtracted before anything is rounded."""
        if self.small and np.abs(x).max(initial=0) < 2 ** 61:
            return (x - np.array(self.floor, np.int64)) - self.rest
        return x.astype(float) - np.array([float(f) for f in self.floor]) - self.rest

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Per row the exact sum of squares of ``n * x - sums``; null beyond 38 digits."""
        reach = max((max(abs(self.n * int(a) - s), abs(self.n * int(b) - s)) for a, b, s in
                     zip(x.min(0), x.max(0), self.sums, strict=True)), default=0)
        if reach < 2 ** 62 and len(self.sums) * reach ** 2 < 2 ** 63 and max(map(abs, self.sums)) < 2 ** 62:
            off = self.n * x - np.array(self.sums, np.int64)
            return pa.array((off * off).sum(1)).cast(pa.decimal128(38, 0))
        exact = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x]
        return pa.array([Decimal(v) if v < 10 ** 38 else None for v in exact], pa.decimal128(38, 0))


def centres(fit: DataFrame) -> dict[int, Centre]:
    """Per dimension; the driver gets one row for each place of a vector."""
    totals = fit.mapInArrow(_totals, "dim int, place int, n long, high long, low long").groupBy("dim", "place").agg(
        F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    sums: dict[int, dict[int, int]] = {}
    counts: dict[int, int] = {}
    for r in totals.collect():
        sums.setdefault(r["dim"], {})[r["place"]] = (int(r["high"]) << 32) + int(r["low"])
        counts[r["dim"]] = r["n"]
    return {dim: Centre(counts[dim], [places[i] for i in range(dim)]) for dim, places in sums.items()}


def triangles(fit: DataFrame, known: dict[int, Centre]) -> dict[int, np.ndarray]:
    """Per dimension the triangle R of the QR factorisation of all centred rows."""

    def fold(have: np.ndarray | None, more: np.ndarray) -> np.ndarray:
        return np.linalg.qr(more if have is None else np.vstack([have, more]), mode="r")

    def given(found: dict, slot: int) -> Iterator[pa.RecordBatch]:
        for (dim, at), r in found.items():
            yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "slot": pa.array([slot if at is None else at], pa.int32()),
                                              "triangle": pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())})

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for dim, _, x in _blocks(batches):
            rows = max(256, 4 * dim)
            for start in range(0, len(x), rows):
                found[dim, None] = fold(found.get((dim, None)), known[dim].centred(x[start:start + rows]))
        yield from given(found, TaskContext.get().partitionId())

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            for dim, slot, raw in zip(*(batch.column(c).to_pylist() for c in ("dim", "slot", "triangle")), strict=True):
                found[dim, slot] = fold(found.get((dim, slot)), np.frombuffer(raw).reshape(-1, dim))
        yield from given(found, 0)

    schema = "dim int, slot int, triangle binary"
    folded = stored(fit.mapInArrow(first, schema))
    slots = (folded.agg(F.max("slot")).first()[0] or 0) + 1
    while slots > 1:
        slots = -(-slots // FAN)
        dealt = folded.withColumn("slot", F.floor(F.col("slot") / FAN).cast("int")).repartitionById(slots, F.col("slot"))
        folded = stored(dealt.mapInArrow(further, schema))
    return {r["dim"]: np.frombuffer(bytes(r["triangle"])).reshape(-1, r["dim"]) for r in folded.toLocalIterator()}


class Directions:
    """Whitening directions of one dimension: columns ``axes``, variances and shares of the trace."""

    def __init__(self, r: np.ndarray, n: int, k: int) -> None:
        dim = r.shape[1]
        square = np.zeros((dim, dim))
        square[:len(r)] = r
        values, vectors = right_vectors(square, k)
        whole = float(np.sum(square * square))
        none = values <= (max(dim, 8) * EPS) ** 2 * (values[0] if len(values) else 0.0)
        self.variances = np.where(none, 0.0, values / n)
        self.axes = np.divide(vectors, np.sqrt(self.variances), out=np.full_like(vectors, np.nan), where=~none)
        self.explained = [float(v * n / whole) if whole > 0 else None for v in self.variances]


def identity_errors(fit: DataFrame, known: dict[int, Centre], found: dict[int, Directions]) -> dict[int, float | None]:
    """Per dimension the largest entry of the covariance of whitened fit rows less the identity."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for dim, _, x in _blocks(batches):
            w = known[dim].centred(x) @ found[dim].axes
            sums[dim] = sums.get(dim, 0) + np.vstack([w.T @ w, w.sum(0)])
        for dim, s in sums.items():
            yield pa.RecordBatch.from_pydict({"dim": pa.array([dim] * s.size, pa.int32()), "place": pa.array(range(s.size), pa.int32()),
                                              "total": pa.array(s.ravel())})

    parts = fit.mapInArrow(products, "dim int, place int, total double").groupBy("dim", "place").agg(F.sum("total").alias("total")).collect()
    errors: dict[int, float | None] = {}
    for dim, d in found.items():
        k, n = len(d.variances), known[dim].n
        sums = np.zeros((k + 1) * k)
        for r in parts:
            if r["dim"] == dim:
                sums[r["place"]] = r["total"]
        sums = sums.reshape(k + 1, k) / n
        live = d.variances > 0
        off = np.abs(sums[:-1] - np.outer(sums[-1], sums[-1]) - np.eye(k))[np.ix_(live, live)]
        errors[dim] = float(off.max()) if off.size else None
    return errors


def whitened(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows on the first ``components`` principal axes, each scaled to variance one.

    Rows whose vector is null, empty, partly null or not finite are left out. Each entry c counts as
    ``floor(64 * c) + 1000000`` (saturating where that passes 64 bits), and every distinct vector counts once in the fit,
    however often it is repeated. One row for each input row, repeated and null ids included, and component (all, if
    the dimension is lower): ``n`` distinct vectors; ``deviation``, the exact sum of ``(n * x - S)^2`` (null
    beyond 38 digits); ``whitened``; ``explained``, the axis' share of all variance; ``identity_error`` of
    the fit. An axis without variance has null ``whitened`` and explains 0 (null if nothing varies);
    ``identity_error`` concerns the others (null if there are none). Vectors of different lengths
    are fits of their own. Equal variances share their space in any orthonormal basis. An empty
    table gives no rows. Other columns are not read.
    """
    rows = grid(vectors, id_col, vector_col)
    fit = stored(rows.select("x", "dim").distinct())
    known = centres(fit)
    found = {dim: Directions(r, known[dim].n, components) for dim, r in triangles(fit, known).items()}
    errors = identity_errors(fit, known, found)
    return rows.mapInArrow(_projected(known, found, errors), RESULT)


def _projected(known: dict[int, Centre], found: dict[int, Directions], errors: dict[int, float | None]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, rows, x in _blocks(batches):
            at, axes = known[dim], found[dim]
            k, m = len(axes.variances), len(x)
            w = (at.centred(x) @ axes.axes).ravel()
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_pydict({
                "vec_id": rows.column(0).take(pa.array(each)), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                "n": pa.array(np.full(m * k, at.n)), "deviation": at.deviations(x).take(pa.array(each)),
                "whitened": pa.array(w, mask=np.isnan(w)), "explained": pa.array(axes.explained * m, pa.float64()),
                "identity_error": pa.array([errors[dim]] * (m * k), pa.float64())})

    return run


@named("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings on their first 16 whitened axes."""
    return whitened(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
