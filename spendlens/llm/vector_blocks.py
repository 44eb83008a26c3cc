"""Vectors against a stated set of queries, block by block.

Rows are hashed to blocks; every pair of a query block and a candidate block is one group with a
bounded number of rows, and the best of all blocks are merged per query. Nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: What tells rows of one id apart: their vectors, as two hashes.
ROW = ("vec_id", "mark")


def usable(vectors: DataFrame, id_col: str, vector_col: str, nonzero: bool = False) -> DataFrame:
    """``vec_id``, ``vector`` (doubles) and ``copies`` of rows whose vector is whole and finite.

    Null, empty, partly null and non-finite vectors are left out, and with ``nonzero`` those of
    only zeros; so are rows without id. Rows with the same id and vector come as one with their
    number, so a row that is repeated often costs no more than others; rows that share only the
    id stay apart.
    """
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where(
        F.col("vec_id").isNotNull() & (F.size("vector") > 0) & F.coalesce(whole, F.lit(False)))
    if nonzero:
        kept = kept.where(F.exists("vector", lambda x: x != 0))
    return counted(kept.withColumn("copies", F.lit(1).cast("long")))


def counted(rows: DataFrame) -> DataFrame:
    """Rows of equal ``vec_id`` and ``vector`` as one, ``copies`` added up."""
    return rows.groupBy("vec_id", "vector").agg(F.sum("copies").alias("copies"))


def marked(rows: DataFrame) -> DataFrame:
    """``vec_id``, ``vector``, ``copies`` and ``mark``, two hashes of the vector; rows without ``copies`` are one each."""
    whole = rows if "copies" in rows.columns else rows.withColumn("copies", F.lit(1).cast("long"))
    return counted(whole).withColumn("mark", F.concat_ws(":", F.xxhash64("vector"), F.xxhash64(F.lit(1), "vector")))


def in_blocks(queries: DataFrame, candidates: DataFrame, columns: list[str], query_block: int, block: int,
              search: Callable[[pa.Table, pa.Table], pa.Table], result: str, block_bytes: int = 1 << 26) -> DataFrame:
    """Apply ``search`` to every pair of a query block and a candidate block of equal dimension.

    Both are ``marked``; ``candidates`` has ``columns`` besides. A block
    has about ``query_block`` or ``block`` rows, fewer if their vectors would pass ``block_bytes``.
    """

    def number(rows: DataFrame, most: int) -> int:
        n, values = rows.agg(F.count("*"), F.sum(F.size("vector"))).first()
        return max(1, -(-n // most), -(-8 * (values or 0) // block_bytes))

    query_blocks, blocks = number(queries, query_block), number(candidates, block)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("vec_id", "vector"), F.lit(n)).cast("int")
    left = queries.select("vec_id", "vector", "mark", F.size("vector").alias("dim"), own(query_blocks).alias("qb"), each(blocks).alias("cb"))
    right = candidates.select("vec_id", "vector", "mark", "copies", *columns, F.size("vector").alias("dim"),
                              own(blocks).alias("cb"), each(query_blocks).alias("qb"))
    keys = ["dim", "qb", "cb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, result)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of equal length as the rows of an array."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def excluded(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, points: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Row by row whether a candidate is the query itself and has no copy beside it."""
    own = (query_ids[:, None] == ids[None, :]) & (copies == 1)[None, :]
    i, j = np.nonzero(own)
    for start in range(0, len(i), 16384):
        a, b = i[start:start + 16384], j[start:start + 16384]
        own[a, b] = (queries[a] == points[b]).all(axis=1)
    return own


def pairs_table(left: pa.Table, right: pa.Table, at: np.ndarray, other: np.ndarray, scores: pa.Array) -> pa.Table:
    """Scored pairs of rows of two blocks as ``found`` rows of ``best_of_blocks``."""
    at, other = pa.array(at, pa.int64()), pa.array(other, pa.int64())
    return pa.table({"query_id": left["vec_id"].take(at), "query_mark": left["mark"].take(at),
                     "vec_id": right["vec_id"].take(other), "mark": right["mark"].take(other), "score": scores})


def best_of_blocks(found: DataFrame, queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Ranks from 1 among the highest scores per query, smaller ids first among equal ones.

    ``found`` has ``query_id``, ``query_mark``, ``vec_id``, ``mark`` and ``score``, the ``k`` best
    of each block at least. A candidate takes as many ranks as it has copies, the query's own row
    one less, and every copy of a query has its ranks.
    """
    order = Window.partitionBy("query_id", "query_mark").orderBy(F.desc("score"), "vec_id", "mark")
    best = found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k)
    repeated = candidates.where("copies > 1").select(*ROW, "copies")
    own = (F.col("query_id") == F.col("vec_id")) & (F.col("query_mark") == F.col("mark"))
    best = best.join(repeated, list(ROW), "left").withColumn("copies", F.coalesce("copies", F.lit(1)) - F.when(own, 1).otherwise(0))
    best = best.withColumn("before", F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    first = F.coalesce("before", F.lit(0)).cast("int") + 1
    last = F.least(first + F.col("copies"), F.lit(k + 1)).cast("int") - 1
    ranked = best.where(first <= k).withColumn("rank", F.explode(F.when(last >= first, F.sequence(first, last))))
    copied = queries.where("copies > 1").select(F.col("vec_id").alias("query_id"), F.col("mark").alias("query_mark"), F.col("copies").alias("times"))
    whole = ranked.join(copied, ["query_id", "query_mark"], "left").withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("times", F.lit(1)))))
    return whole.select("query_id", "rank", "vec_id", "score")
