"""Small helpers for models trained in numpy: labelled samples of bounded size, logistic fits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: Column) -> Column:
    """Every fifth id by checksum, which no model learns from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, most: dict[int, int], id_col: str = "doc_id",
                    text_col: str = "text", others: tuple[str, ...] = ()) -> DataFrame:
    """Labelled documents to learn from, at most ``most[label]`` of each label, spread by hash of the id.

    Held-out ids, null ids and null labels never take part. An id labelled twice counts once, with
    its smallest label. Columns are ``doc_id``, ``text``, ``others``, ``label``, ``turn`` (a hash
    from 0 to 999) and ``weight``, the labels of its class that a sampled one stands for, so weighted
    classes are mixed as they are among all labels to learn from; the broadcast side has at most
    ``sum(most.values())`` rows.
    """
    known = labels.select(F.col(id_col).cast("long").alias("known"), F.col(label_col).cast("int").alias("label")).where(
        F.col("known").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("known")))
    known = known.groupBy("known").agg(F.min("label").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = None
    for label, n in most.items():
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("known"), "known").limit(n).withColumn(
            "turn", F.pmod(F.xxhash64("known", F.lit(3)), F.lit(1000)).cast("int")).withColumn("weight", F.lit(max(1.0, counts.get(label, 0) / max(1, n))))
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *others)
    return texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("known")).drop("known")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, weight: np.ndarray | None = None, steps: int = 25) -> np.ndarray:
    """Weights (the last one is the constant) of a ridge logistic regression by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.ones(len(x)) if weight is None else weight
    penalty = np.full(x.shape[1], ridge * len(x) ** 0.5)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (weight * (p - y)) + penalty * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        largest = np.abs(step).max()
        w -= step * min(1.0, 5.0 / max(largest, 1e-12))
        if largest < 1e-6:
            break
    return w


def keep_rows(docs: DataFrame, columns: list[str], prepare: Callable[[], Callable[..., np.ndarray]], at_once: int = 500) -> DataFrame:
    """Rows of ``docs`` for which a decision on ``columns`` is true, with all their columns.

    ``prepare`` runs once per task and returns the decision, which gets a list per column.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = prepare()
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                part = batch.slice(start, at_once)
                yield part.filter(pa.array(decide(*(part.column(c).to_pylist() for c in columns)), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
