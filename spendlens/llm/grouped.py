"""Groups streamed through tasks, and connected components, for many small and a few huge groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.shared import stored

BLOCK = 1024


def block_pairs(members: DataFrame, group: str, member: str, size: str, block: int = BLOCK) -> DataFrame:
    """Deal each group into blocks of about ``block`` members and repeat a member for each pair of blocks.

    Adds ``low`` and ``high``, the numbers of the two blocks. Any two members of a group meet in
    one pair at least; a group of up to ``block`` members has one pair. ``size`` names the column
    with the number of members.
    """
    blocks = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(member, F.lit(5)), blocks).cast("int")
    with_own = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return with_own.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("own", "other")


def streamed_groups(rows: DataFrame, keys: list[str], work: Callable[[pa.Table], list[tuple]], schema: pa.Schema,
                    result: str) -> DataFrame:
    """Apply ``work`` to the rows of each key as they pass by in order, and return what it finds.

    Unlike a grouped function this has no cost per group in Spark, so millions of groups of two
    rows are as cheap as their rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            got = pa.Table.from_batches([batch])
            values = list(zip(*(got[k].to_pylist() for k in keys), strict=True))
            starts = [i for i in range(len(values)) if values[i] != (values[i - 1] if i else last)]
            found: list[tuple] = []
            if starts and waiting:
                found += work(pa.concat_tables([*waiting, got.slice(0, starts[0])]))
                waiting = []
            for start, stop in zip(starts[:-1], starts[1:]):
                found += work(got.slice(start, stop - start))
            waiting.append(got.slice(starts[-1]) if starts else got)
            last = values[-1]
            if found:
                yield _batch(found, schema)
        found = work(pa.concat_tables(waiting)) if waiting else []
        if found:
            yield _batch(found, schema)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, result)


def _batch(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)


class Union:
    """Union-find over 0..n-1."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b

    def roots(self) -> np.ndarray:
        return np.array([self.root(x) for x in range(len(self.parent))])


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node of its component, for every node of ``edges`` (``src``, ``dst``).

    Labels pass along edges and then jump to the label of the label, until nothing changes; each
    round is written to the shared folder, so lineage stays short.
    """
    links = stored(edges.select("src", "dst").union(edges.select("dst", "src")).distinct().toDF("src", "dst"))
    labels = stored(links.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("near")).select(
        "node", F.least("node", "near").alias("label")))
    while True:
        near = links.join(labels, links["dst"] == labels["node"]).groupBy("src").agg(F.min("label").alias("near"))
        passed = labels.join(near, labels["node"] == near["src"]).select(
            "node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        of_label = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        moved = stored(passed.join(of_label, passed["label"] == of_label["at"]).select(
            "node", F.least("label", "further").alias("label"), "old"))
        labels = moved.select("node", "label")
        if moved.where(F.col("label") != F.col("old")).isEmpty():
            return labels
