"""Token ids on disk as patched frame-of-reference blocks, and their way back.

A shard file is: blocks, then doc ids (int64), ids per document (uint32), null flags of doc ids
(uint8), block starts (uint64), then a fixed trailer with the counts. A block of up to ``BLOCK``
ids holds its minimum, a bit width that fits ``share`` of the residuals, the residuals packed at
that width, and for the rest a list of positions with the bits that did not fit. Block starts let
a reader fetch any range of ids without the blocks before it.

Documents are written in ascending order of their id (null ids first, equal ids by text), shard
after shard. Tasks write files under names of their own and report them; only reported files
count, so a repeated or lost task leaves nothing wrong behind.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlens.llm.shared import named, new_folder, opened, stored, table
from spendlens.llm.tokenizing import CHUNK_LIMIT, encoder, text_slices

BLOCK = 4096
LANES = BLOCK // 32
MAGIC = b"PFORIDS1"
_HEAD = struct.Struct("<HHIBH")  # ids, exceptions, minimum, width, unused
_TRAILER = struct.Struct("<QQQQ8s")  # start of the tables, documents, ids, blocks, magic
MANIFEST = "shard long, file string, docs long, ids long"


def pack_lanes(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2**width to rows of ``width * LANES`` 32-bit words."""
    rows = values.reshape(-1, 32, LANES)
    out = np.zeros((len(rows), width, LANES), dtype="<u4")
    for i in range(32 if width else 0):
        word, shift = divmod(i * width, 32)
        out[:, word] |= rows[:, i] << np.uint32(shift)
        if shift + width > 32:
            out[:, word + 1] |= rows[:, i] >> np.uint32(32 - shift)
    return out.reshape(len(rows), -1)


def unpack_lanes(words: np.ndarray, width: int) -> np.ndarray:
    rows = words.reshape(len(words), width, LANES)
    out = np.zeros((len(rows), 32, LANES), dtype="<u4")
    mask = np.uint32((1 << width) - 1)
    for i in range(32 if width else 0):
        word, shift = divmod(i * width, 32)
        got = rows[:, word] >> np.uint32(shift)
        if shift + width > 32:
            got = got | rows[:, word + 1] << np.uint32(32 - shift)
        out[:, i] = got & mask
    return out.reshape(len(rows), BLOCK)


def encode_blocks(ids: np.ndarray, share: float = 0.9) -> list[bytes]:
    """Blocks of BLOCK ids, the last one maybe shorter."""
    blocks = []
    for start in range(0, len(ids), BLOCK * 64):
        part = ids[start:start + BLOCK * 64].astype("<u4")
        counts = [min(BLOCK, len(part) - i) for i in range(0, len(part), BLOCK)]
        full = np.concatenate([part, np.full(len(counts) * BLOCK - len(part), part[-1], dtype="<u4")]).reshape(-1, BLOCK)
        low = full.min(axis=1)
        residual = full - low[:, None]
        bound = np.partition(residual, int(share * (BLOCK - 1)), axis=1)[:, int(share * (BLOCK - 1))]
        widths = np.array([int(b).bit_length() for b in bound.tolist()])
        done: list[bytes] = [b""] * len(counts)
        for width in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == width)
            mask = np.uint32((1 << width) - 1)
            words = pack_lanes(residual[rows] & mask, width)
            for at, r in enumerate(rows.tolist()):
                over = np.flatnonzero(residual[r] > mask)
                head = _HEAD.pack(counts[r], len(over), int(low[r]), width, 0)
                high = (residual[r][over] >> np.uint32(width)).astype("<u4") if width < 32 else over[:0].astype("<u4")
                done[r] = head + words[at].tobytes() + over.astype("<u2").tobytes() + high.tobytes()
        blocks += done
    return blocks


def decode_blocks(raw: bytes) -> np.ndarray:
    """Ids of consecutive whole blocks."""
    heads, at = [], 0
    while at < len(raw):
        count, extra, low, width, _ = _HEAD.unpack_from(raw, at)
        body = at + _HEAD.size
        heads.append((count, extra, low, width, body))
        at = body + width * LANES * 4 + extra * 6
    out: list[np.ndarray] = [np.empty(0, "<u4")] * len(heads)
    widths = np.array([h[3] for h in heads])
    for width in np.unique(widths).tolist() if heads else []:
        rows = np.flatnonzero(widths == width).tolist()
        size = width * LANES
        words = np.stack([np.frombuffer(raw, "<u4", size, heads[r][4]) for r in rows])
        got = unpack_lanes(words, width)
        for k, r in enumerate(rows):
            count, extra, low, _, body = heads[r]
            row = got[k]
            if extra:
                place = np.frombuffer(raw, "<u2", extra, body + size * 4)
                row[place] |= np.frombuffer(raw, "<u4", extra, body + size * 4 + extra * 2) << np.uint32(width)
            out[r] = (row + np.uint32(low))[:count]
    return np.concatenate(out) if out else np.empty(0, "<u4")


class ShardWriter:
    """Streams documents into one file; holds one run of blocks and 13 bytes a document."""

    def __init__(self, path: str) -> None:
        system, name = opened(path)
        system.create_dir(name.rsplit("/", 1)[0], recursive=True)
        self.out = system.open_output_stream(name)
        self.at, self.ids = 0, 0
        self.starts: list[int] = []
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self.waiting: list[bytes] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.waiting.append(ids)
        self.held += len(ids) // 4
        if self.held >= BLOCK * 256:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for block in encode_blocks(ids[:whole]):
            self.starts.append(self.at)
            self.out.write(block)
            self.at += len(block)
        self.ids += whole
        self.waiting, self.held = [ids[whole:].tobytes()], len(ids) - whole

    def close(self) -> None:
        self._flush(last=True)
        self.out.write(np.array([d or 0 for d in self.docs], "<i8").tobytes())
        self.out.write(np.array(self.lengths, "<u4").tobytes())
        self.out.write(np.array([d is None for d in self.docs], "u1").tobytes())
        self.out.write(np.array(self.starts, "<u8").tobytes())
        self.out.write(_TRAILER.pack(self.at, len(self.docs), self.ids, len(self.starts), MAGIC))
        self.out.close()


class ShardReader:
    """Tables of one shard file, and its ids by range."""

    def __init__(self, path: str) -> None:
        system, name = opened(path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        tables, docs, self.ids, blocks, magic = _TRAILER.unpack(self.file.read_at(_TRAILER.size, size - _TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token shard")
        raw = self.file.read_at(size - _TRAILER.size - tables, tables)
        self.docs = np.frombuffer(raw, "<i8", docs)
        self.lengths = np.frombuffer(raw, "<u4", docs, docs * 8)
        self.nulls = np.frombuffer(raw, "u1", docs, docs * 12)
        self.starts = np.append(np.frombuffer(raw, "<u8", blocks, docs * 13).astype(np.int64), tables)

    def range(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` up to ``stop`` of this shard, read from the blocks that hold them."""
        if stop <= start:
            return np.empty(0, "<u4")
        first, last = start // BLOCK, (stop - 1) // BLOCK
        raw = self.file.read_at(int(self.starts[last + 1] - self.starts[first]), int(self.starts[first]))
        return decode_blocks(raw)[start - first * BLOCK:stop - first * BLOCK]

    def documents(self, at_once: int = BLOCK * 256) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Doc id, start in the shard and ids of every document, with about ``at_once`` ids held."""
        ends = np.cumsum(self.lengths, dtype=np.int64)
        first = 0
        while first < len(ends):
            begin = int(ends[first] - self.lengths[first])
            stop = max(first + 1, int(np.searchsorted(ends, begin + at_once, side="right")))
            ids = self.range(begin, int(ends[stop - 1]))
            for d in range(first, stop):
                start = int(ends[d] - self.lengths[d])
                yield (None if self.nulls[d] else int(self.docs[d])), start, ids[start - begin:int(ends[d]) - begin]
            first = stop


def write_token_shards(docs: DataFrame, encode: Callable[[list[str | None]], list[bytes]], end_id: int | None,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of every text in order of ``id_col``; returns the stored list of shards.

    ``encode`` maps a list of texts to little-endian unsigned 32-bit ids and runs in tasks. Null
    texts count as empty; each document gets ``end_id`` appended unless that is None. An empty
    table gives no shard. Other columns are not read.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "token-shards")
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    ordered = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, path = None, ""
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, stop in text_slices(texts):
                for doc_id, coded in zip(ids[start:stop], encode(texts[start:stop]), strict=True):
                    if writer is None:
                        path = f"{folder}/{uuid.uuid4().hex}.pfor"
                        writer = ShardWriter(path)
                    writer.add(doc_id, coded + end)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [TaskContext.get().partitionId()], "file": [path],
                                              "docs": [len(writer.docs)], "ids": [writer.ids]})

    return stored(ordered.mapInArrow(write, MANIFEST))


def read_token_shards(shards: DataFrame) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it) and ``ids`` (little-endian unsigned 32-bit)."""
    # one row a file: a short list, whatever the corpus holds
    begun = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = shards.select("shard", "file", F.coalesce(F.sum("ids").over(begun), F.lit(0)).alias("base"),
                          (F.row_number().over(Window.orderBy("shard")) - 1).alias("place"))
    dealt = based.repartitionById(max(1, shards.count()), F.col("place").cast("int")).select("file", "base")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                held = 0
                for doc_id, start, ids in ShardReader(file).documents():
                    rows.append((doc_id, base + start, ids.tobytes()))
                    held += len(ids)
                    if held >= BLOCK * 256 or len(rows) >= 10_000:
                        yield _rows(rows)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows)

    return dealt.mapInArrow(read, "doc_id long, start long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    doc_id, start, ids = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_id, pa.int64()), pa.array(start, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])


def library_encoder(path: str, limit: int = CHUNK_LIMIT) -> Callable[[list[str | None]], list[bytes]]:
    return lambda texts: encoder(path, limit).encode(texts)


@named("op1_token_files")
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as shards and read back, with a checksum of each."""
    import public_tokenizers

    shards = write_token_shards(table(spark, sf_dir, "documents"),
                                library_encoder(public_tokenizers.path("word_bpe_49k.json")), end_id=2)
    return read_token_shards(shards).select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
