"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

1. Each text becomes its set of word shingles, a fingerprint of that set and a signature. Equal
   sets share a fingerprint, the node of all further steps, so exact copies cost one node.
2. Nodes that share a band key are compared by signature. What comes out are not pairs but
   clusters: which nodes hang together through similar enough signatures.
3. Clusters are verified on full sets. Pairs are tried in order of their signatures' likeness and
   left out once both sides hang together, so a group of thousands needs about as many checks as
   members; pairs that do not link are all tried.
4. Components of verified links are the result.

Large buckets and clusters are dealt into blocks, and every pair of blocks is one bounded task.
Nothing is capped: any pair that shares a band key and whose signatures agree in at least
``alike`` of their coordinates is verified or already connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm.circulant import CirculantMinHash, Shingler, band_keys, same_share
from spendlens.llm.grouped import Union, block_pairs, components, streamed_groups
from spendlens.llm.shared import in_parts, named, stored, table

COORDINATES, ROWS = 112, 4
#: Signatures that agree in fewer coordinates are not verified. At a similarity of 0.8 a pair is
#: missed for this with a probability below one in a million, and as rarely by the bands.
ALIKE = 0.6
SIGNED = "doc_id long, n_shingles long, node binary, signature binary, keys array<long>"
#: Ids of clustered nodes are broadcast up to this many (24 bytes each), else joined by shuffle.
BROADCAST_NODES = 1_000_000
#: Number of a row while copies are dropped.
ROW = "_row_of_near_duplicates"
_EDGE = pa.schema([("src", pa.binary()), ("dst", pa.binary())])


def signed(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """Set size, fingerprint, signature (low bytes) and band keys of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles_of, signature_of = Shingler(words), CirculantMinHash(COORDINATES)
        for batch in in_parts(batches):
            sizes, nodes, signatures, keys = [], [], [], []
            for text in batch.column(1).to_pylist():
                shingles = shingles_of(text)
                sizes.append(len(shingles))
                if len(shingles):
                    signature = signature_of(shingles)
                    nodes.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                    signatures.append(signature.astype("u1").tobytes())
                    keys.append(band_keys(signature, ROWS))
                else:
                    nodes.append(None)
                    signatures.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(signatures, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "node", "signature", "keys"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SIGNED)


def agreement(signatures: list[bytes]) -> np.ndarray:
    """Coordinates in which each two signatures agree."""
    rows = np.frombuffer(b"".join(signatures), np.uint8).reshape(len(signatures), -1)
    same = np.zeros((len(rows), len(rows)), dtype=np.int16)
    for column in rows.T:
        same += column[:, None] == column[None, :]
    return same


def alike_clusters(bucket: pa.Table) -> list[tuple]:
    """Edges from each member of a bucket to the root of what it hangs together with by signature."""
    # in order, so that buckets with much the same members agree on the root and their edges coincide
    nodes, signatures = zip(*sorted(zip(bucket["node"].to_pylist(), bucket["signature"].to_pylist(), strict=True)), strict=True)
    if len(nodes) == 2:
        a, b = (np.frombuffer(s, np.uint8) for s in signatures)
        return [(nodes[0], nodes[1])] if (a == b).sum() >= ALIKE * len(a) else []
    union = Union(len(nodes))
    for a, b in np.argwhere(np.triu(agreement(signatures) >= ALIKE * len(signatures[0]), 1)).tolist():
        union.join(a, b)
    return [(nodes[i], nodes[r]) for i, r in enumerate(union.roots().tolist()) if i != r]


def verified_links(cluster: pa.Table, similarity: int) -> list[tuple]:
    """Edges from each member to the root of what it is linked with by full sets."""
    sets = {n: np.frombuffer(s, np.uint64) for n, s in zip(cluster["node"].to_pylist(), cluster["shingles"].to_pylist(), strict=True)}
    nodes = sorted(sets)
    if len(nodes) < 2:
        return []
    full = [sets[n] for n in nodes]
    if len(nodes) == 2:
        pairs = np.array([[0, 1]])
    else:
        signature_of = CirculantMinHash(COORDINATES)
        same = agreement([signature_of(s).astype("u1").tobytes() for s in full])
        pairs = np.argwhere(np.triu(same >= ALIKE * COORDINATES, 1))
        pairs = pairs[np.argsort(-same[pairs[:, 0], pairs[:, 1]], kind="stable")]
        sizes = np.array([len(s) for s in full])  # sets of too different size cannot be similar enough
        small, large = np.minimum(sizes[pairs[:, 0]], sizes[pairs[:, 1]]), np.maximum(sizes[pairs[:, 0]], sizes[pairs[:, 1]])
        pairs = pairs[100 * small >= similarity * large]
    union = Union(len(nodes))
    for a, b in pairs.tolist():
        if union.root(a) != union.root(b):
            common, either = same_share(full[a], full[b])
            if 100 * common >= similarity * either:
                union.join(a, b)
    return [(nodes[i], nodes[r]) for i, r in enumerate(union.roots().tolist()) if i != r]


def near_duplicates(docs: DataFrame, words: int = 5, similarity: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row.

    Rows are linked whose sets have ``100 * intersection >= similarity * union``;
    ``component_id`` is the smallest id reachable, ``kept`` tells whether it is the row's own.
    Null and empty texts, and those of white space only, have no shingles and are linked with
    nothing, nor are rows without id; those have no component and are kept. Rows that repeat an
    id are rows of their own. Other columns are not read.
    """
    rows = stored(signed(docs, words, id_col, text_col))
    nodes = rows.where("node is not null and doc_id is not null")
    # rows of a node have the same signature and keys
    one_each = stored(nodes.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("signature").alias("signature"),
                                                F.first("keys").alias("keys")))
    firsts = one_each.select("node", "first")
    banded = one_each.select("node", F.explode("keys").alias("key"))
    shared_keys = banded.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = stored(banded.join(shared_keys, "key"))
    dealt = block_pairs(members.join(one_each.select("node", "signature"), "node"), "key", "node", "members")
    alike = streamed_groups(dealt, ["key", "low", "high"], alike_clusters, _EDGE, "src binary, dst binary")
    clusters = components(alike.distinct())
    wanted = stored(clusters.join(firsts, "node").select("node", "label", "first"))

    sizes = wanted.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    few = wanted.count() <= BROADCAST_NODES
    asked = wanted.select(F.col("first").alias("asked"), F.col("node").alias("asked_node"))

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles_of = Shingler(words)
        for batch in in_parts(batches):
            kept = []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = shingles_of(text).tobytes()
                if xxhash.xxh3_128_digest(raw) == node:  # of rows that repeat an id, the one meant
                    kept.append((node, raw))
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*kept, strict=True)], ["node", "shingles"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = texts.join(F.broadcast(asked) if few else asked, F.col("doc_id") == F.col("asked")).select(
        F.col("asked_node").alias("node"), "text").mapInArrow(shingle, "node binary, shingles binary")
    placed = block_pairs(wanted.select("node", "label").join(sizes, "label"), "label", "node", "members")
    checked = streamed_groups(placed.join(sets, "node"), ["label", "low", "high"],
                              lambda c: verified_links(c, similarity), _EDGE, "src binary, dst binary")
    linked = components(checked.distinct())
    lowest = linked.join(firsts, "node").groupBy("label").agg(F.min("first").alias("component_id"))
    of_node = firsts.join(linked, "node", "left").join(lowest, "label", "left").select(
        F.col("node").alias("of"), F.coalesce("component_id", "first").alias("component_id"))
    found = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")).join(
        of_node, F.col("node") == F.col("of"), "left")
    component = F.coalesce("component_id", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"),
                        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, words: int = 5, similarity: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, one row of each group, with all their columns.

    Rows are told apart by a stored number, so rows that repeat an id go or stay each on its own; of
    a group the row of the smallest id stays. Rows without id are linked with nothing and stay.
    """
    numbered = stored(docs.withColumn(ROW, F.monotonically_increasing_id()))
    with_id = numbered.where(F.col(id_col).cast("long").isNotNull())
    copies = stored(near_duplicates(with_id, words, similarity, ROW, text_col).where(~F.col("kept")).select(
        F.col("doc_id").alias("member"), "component_id"))
    members = copies.union(copies.select(F.col("component_id").alias("member"), "component_id").distinct())
    few = copies.count() <= BROADCAST_NODES // 2
    ids = numbered.select(ROW, F.col(id_col).cast("long").alias("id")).join(
        F.broadcast(members) if few else members, F.col(ROW) == F.col("member")).select("member", "component_id", "id")
    stays = ids.groupBy("component_id").agg(F.min(F.struct("id", "member")).alias("first")).select(F.col("first.member").alias("stays"))
    gone = stored(members.join(stays, F.col("member") == F.col("stays"), "left_anti").select(F.col("member").alias("gone")))
    return numbered.join(F.broadcast(gone) if few else gone, F.col(ROW) == F.col("gone"), "left_anti").drop(ROW)


@named("op8_circulant_minhash")
def op8_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents by shingles of four words."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, similarity=80)
