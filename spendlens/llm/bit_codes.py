"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector, taken from the centre of all vectors and scaled to length one, is rotated at random and
keeps the sign of each coordinate as a bit. With two scalars, its distance from the centre and
the inner product of itself and its code, the code estimates inner products with any query, with
an error that stays below a known bound with high probability. Vectors whose upper bound reaches
the kth best lower bound are scored exactly; the others cannot be among the nearest unless the
bound fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm.shared import named, stored, table
from spendlens.llm.vector_blocks import best_of_blocks, excluded, in_blocks, marked, matrix, pairs_table, usable

CODED = "vec_id long, vector array<double>, mark string, copies long, bits binary, spread double, aligned double"
FOUND = "query_id long, query_mark string, vec_id long, mark string, score double"


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random rotation (QR of a normal matrix), the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centers(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Mean vector per dimension: one array for each dimension and batch, added up."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for v in batch.column(0).to_pylist():
                got = sums.setdefault(len(v), [np.zeros(len(v)), 0])
                got[0] += v
                got[1] += 1
        for dim, (total, n) in sums.items():
            yield pa.RecordBatch.from_pydict({"dim": pa.array([dim] * dim, pa.int32()), "at": pa.array(range(dim), pa.int32()),
                                              "total": pa.array(total), "n": pa.array([n] * dim, pa.int64())})

    rows = vectors.select("vector").mapInArrow(add, "dim int, at int, total double, n long").groupBy("dim", "at").agg(
        (F.sum("total") / F.sum("n")).alias("mean")).collect()
    found: dict[int, np.ndarray] = {}
    for r in rows:
        found.setdefault(r["dim"], np.zeros(r["dim"]))[r["at"]] = r["mean"]
    return found


def coded(vectors: DataFrame, middle: dict[int, np.ndarray], seed: int) -> DataFrame:
    """Every row of ``vectors`` (as ``marked``) with its packed bits and scalars."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits: list[bytes] = []
            spread: list[float] = []
            aligned: list[float] = []
            for v in batch.column("vector").to_pylist():
                dim = len(v)
                beyond = np.asarray(v) - middle[dim]
                length = float(np.linalg.norm(beyond))
                turned = beyond / (length or 1.0) @ rotation_of(dim, seed)
                bits.append(np.packbits(turned > 0).tobytes())
                spread.append(length)
                aligned.append(float(np.abs(turned).sum() / np.sqrt(dim)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(bits, pa.binary()), pa.array(spread), pa.array(aligned)],
                                             [*kept, "bits", "spread", "aligned"])

    kept = ["vec_id", "vector", "mark", "copies"]
    return vectors.select(*kept).mapInArrow(encode, CODED)


_ROTATIONS: dict[tuple[int, int], np.ndarray] = {}


def rotation_of(dim: int, seed: int) -> np.ndarray:
    if (dim, seed) not in _ROTATIONS:
        _ROTATIONS[dim, seed] = rotation(dim, seed)
    return _ROTATIONS[dim, seed]


def reranked(left: pa.Table, right: pa.Table, middle: np.ndarray, k: int, sure: float, seed: int) -> pa.Table:
    """The ``k`` best of a block for each query: bounds from codes, exact scores for what they leave."""
    queries, query_ids, points, ids = matrix(left["vector"]), left["vec_id"].to_numpy(), matrix(right["vector"]), right["vec_id"].to_numpy()
    copies, bits, spread, aligned = right["copies"].to_numpy(), right["bits"].to_pylist(), right["spread"].to_numpy(), right["aligned"].to_numpy()
    dim = points.shape[1]
    signs = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(ids), -1), axis=1, count=dim) * 2.0 - 1.0
    good = np.where(aligned > 0, aligned, 1.0)
    scale = spread / good
    slack = np.sqrt(np.maximum(1 - good**2, 0)) * scale * sure / np.sqrt(max(dim - 1, 1))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for first in range(0, len(queries), 512):
        part = queries[first:first + 512]
        guess = (part @ rotation_of(dim, seed)) @ signs.T / np.sqrt(dim) * scale + (part @ middle)[:, None]
        error = np.linalg.norm(part, axis=1)[:, None] * slack
        own = excluded(query_ids[first:first + 512], part, ids, points, copies)
        low, high = np.where(own, -np.inf, guess - error), np.where(own, -np.inf, guess + error)
        worst = np.partition(low, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(part), -np.inf)
        for row in range(len(part)):
            at = np.flatnonzero((high[row] >= worst[row]) & ~own[row])
            scores = np.einsum("ij,j->i", points[at], part[row])
            order = np.lexsort((ids[at], -scores))[:k]
            out.append((np.full(len(order), first + row), at[order], scores[order]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0)] * 3
    return pairs_table(left, right, columns[0], columns[1], pa.array(columns[2], pa.float64()))


def nearest(queries: DataFrame, candidates: DataFrame, k: int, sure: float = 3.0, seed: int = 11,
            query_block: int = 1024, block: int = 8192) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` largest inner products found.

    ``sure`` is the number of deviations the error bound spans. Vectors meet those of their own
    dimension. Of a query only its own row is left out: others of its id are candidates, and
    rows may have ``copies`` that take ranks of their own. Every candidate is coded, and a block
    passes on its ``k`` best after exact scoring. Equal scores go to smaller ids.
    """
    queries, candidates = stored(marked(queries)), stored(marked(candidates))
    middle = centers(candidates)
    index = stored(coded(candidates, middle, seed))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pairs_table(left, right, np.empty(0, int), np.empty(0, int), pa.array([], pa.float64()))
        return reranked(left, right, middle[len(right["vector"][0])], k, sure, seed)

    return best_of_blocks(in_blocks(queries, index, ["bits", "spread", "aligned"], query_block, block, search, FOUND), queries, candidates, k)


@named("op10_bit_codes")
def op10_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector among all others."""
    vectors = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", nonzero=True)
    return nearest(vectors.where(F.col("vec_id") % 20 == 0), vectors, 20)
