"""Documents packed into as few training sequences of fixed size as bin completion finds.

Documents are tokenized and cut in tasks, each piece numbered among the pieces of its length in
its partition. Only counts per length reach the driver (``capacity`` numbers at most), where
``bin_completion`` decides which lengths share a sequence. Pieces then find their sequence by
length and number alone, so no pieces are gathered: a length that a third of all pieces has is
spread like any other.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlens.llm.bin_completion import Pattern, bin_completion
from spendlens.llm.shared import named, new_folder, table
from spendlens.llm.token_files import library_encoder
from spendlens.llm.tokenizing import CHUNK_LIMIT, batch_slices

PIECES = "doc_id long, piece int, start long, length int, ids binary, part int, number long"


def pieces(docs: DataFrame, encode: Callable[[list[str | None]], list[bytes]], end_id: int | None, capacity: int,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of at most ``capacity`` ids, stored on the shared folder.

    Only longer documents are cut; the first piece takes what whole pieces leave over. Null texts
    count as empty; a document without any id (no ``end_id``) gives no piece. ``part`` and
    ``number`` count the pieces of each length per partition.
    """
    spark = docs.sparkSession
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    size = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        numbers: dict[int, int] = defaultdict(int)
        for batch in batches:
            for few in batch_slices(batch, 1):
                rows: list[tuple] = []
                for doc_id, coded in zip(few.column(0).to_pylist(), encode(few.column(1).to_pylist()), strict=True):
                    coded += end
                    bounds = [0, *range(len(coded) % size or size, len(coded) + 1, size)] if coded else [0]
                    for k in range(len(bounds) - 1):
                        length = (bounds[k + 1] - bounds[k]) // 4
                        rows.append((doc_id, k, bounds[k] // 4, length, coded[bounds[k]:bounds[k + 1]], part, numbers[length]))
                        numbers[length] += 1
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (
                            pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64()), strict=True)],
                        ["doc_id", "piece", "start", "length", "ids", "part", "number"])

    path = new_folder(spark, "pieces")
    cut_up = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)
    cut_up.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(cut_up.schema).parquet(path)


def places(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: from which number on, how many a sequence, first sequence, first offset."""
    found: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    base = 0
    for content, times in patterns:
        offset = 0
        for length in sorted(set(content), reverse=True):
            each = content.count(length)
            found[length].append((taken[length], each, base, offset))
            taken[length] += each * times
            offset += each * length
        base += times
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for k, v in found.items()}


def pack(cut_up: DataFrame, capacity: int, nodes: int = 6_000) -> DataFrame:
    """``cut_up`` (with ``length``, ``part``, ``number``) plus ``sequence_id`` and ``offset``.

    Every other column is kept. Sequences are numbered from 0; offsets leave no gap. Equal
    lengths are told apart by partition and number, so repeated rows each get a place.
    """
    per_part = cut_up.groupBy("length", "part").agg((F.max("number") + 1).alias("pieces"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = per_part.select("length", "part", F.coalesce(F.sum("pieces").over(before), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    lookup = places(bin_completion(counts, capacity, nodes))
    kept = [c for c in cut_up.columns if c not in ("part", "number")]
    numbered = cut_up.join(based, ["length", "part"]).select(*kept, (F.col("base") + F.col("number")).alias("rank"))
    schema = numbered.drop("rank").schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                size = int(length[rows[0]])
                first, each, base, at = lookup[size]
                k = np.searchsorted(first, rank[rows], side="right") - 1
                beyond = rank[rows] - first[k]
                sequence[rows] = base[k] + beyond // each[k]
                offset[rows] = at[k] + beyond % each[k] * size
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    return numbered.mapInArrow(place, schema)


def packed_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, remembered: int = CHUNK_LIMIT) -> DataFrame:
    """Pieces of all documents with checksum, sequence and offset; a worker remembers the ids of up to ``remembered`` chunks."""
    cut_up = pieces(docs, library_encoder(tokenizer, remembered), end_id, capacity)
    digests = cut_up.select("doc_id", "piece", "start", F.col("length"), F.crc32("ids").alias("ids_crc32"), "part", "number")
    return pack(digests, capacity).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"),
                                          "ids_crc32", "sequence_id", "offset")


@named("op2_best_fit_packing")
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 ids."""
    import public_tokenizers

    return packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
