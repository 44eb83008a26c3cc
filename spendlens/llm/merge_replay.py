"""Byte-level BPE by replaying merges over all words at once, and its way back.

The words of a large slice of the corpus lie end to end in flat arrays of tokens with links to
their neighbours. An inverted index leads from the rank of a token pair to the positions where
that pair stands. Ranks are taken in ascending order; one step merges a pair wherever it stands
and touches only the neighbours of those places, whose new pairs enter the index. Merging the
lowest rank first, from left to right, is what the rank files define for each single word.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm.shared import named, table
from spendlens.llm.tokenizing import spaced_chunks, text_slices

#: Characters whose words are merged together: a step costs the same however many words it meets.
SLICE = 8_000_000
#: Chunks and words that a worker remembers between slices.
CHUNK_LIMIT = 300_000
NO_PAIR = np.int32(2**31 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


class MergeTable:
    """Ranks of a vocabulary and of all token pairs that join to one of its tokens."""

    def __init__(self, path: str) -> None:
        self.ranks = ranks = read_ranks(path)
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], rank) for t, rank in ranks.items()
                 for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs], dtype=np.int64)
        self.joined = np.array([r for _, r in pairs], dtype=np.int32)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        #: every pair ranks behind its parts, so a merge never makes a pair that ranks before it
        self.rising = bool(np.all(self.joined > np.maximum(self.keys >> 32, self.keys & 0xFFFFFFFF)))

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.joined[at], NO_PAIR)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every word (distinct, not empty)."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        ends = np.cumsum(sizes)
        token = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        count = len(token)
        place = np.int32 if count < 2**31 else np.int64
        after = np.arange(1, count + 1, dtype=place)
        after[ends - 1] = -1
        before = np.arange(-1, count - 1, dtype=place)
        before[ends - sizes] = -1
        rank = np.full(count, NO_PAIR, dtype=np.int32)
        inner = np.flatnonzero(after >= 0)
        rank[inner] = self.pair_ranks(token[inner], token[inner + 1])
        alive = np.ones(count, dtype=bool)
        word_of = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enter(places: np.ndarray) -> None:
            ranks = rank[places]
            places, ranks = places[ranks != NO_PAIR], ranks[ranks != NO_PAIR]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = (np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist()
            starts = [0, *cuts] if len(places) else []
            for start, stop in zip(starts, [*cuts, len(places)]):
                key = int(ranks[start])
                if key in index:
                    index[key].append(places[start:stop])
                else:
                    index[key] = [places[start:stop]]
                    heapq.heappush(queue, key)

        enter(inner)
        while queue:
            current = heapq.heappop(queue)
            lists = index.pop(current)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[rank[at] == current]
            if not len(at):
                continue
            if not self.rising:  # one place a word: a lower rank may come first thereafter
                word = word_of[at]
                first = np.append(True, word[1:] != word[:-1])
                if not first.all():
                    index[current] = [at[~first]]
                    heapq.heappush(queue, current)
                at = at[first]
            gone = after[at]
            if len(at) > 1 and (gone[:-1] == at[1:]).any():  # overlapping places: from left to right
                keep, last = [], -1
                for p, q in zip(at.tolist(), gone.tolist()):
                    keep.append(p != last)
                    if p != last:
                        last = q
                at, gone = at[keep], gone[keep]
            beyond = after[gone]
            token[at] = current
            after[at] = beyond
            before[beyond[beyond >= 0]] = at[beyond >= 0]
            alive[gone] = False
            rank[gone] = NO_PAIR
            left = before[at]
            touched = np.unique(np.concatenate([at, left[left >= 0]]))
            right = after[touched]
            rank[touched] = np.where(right >= 0, self.pair_ranks(token[touched], token[right]), NO_PAIR)
            enter(touched)
        raw = token[alive].astype("<u4").tobytes()
        cuts = (np.append(0, np.cumsum(alive)[ends - 1]) * 4).tolist()
        return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


class ReplayEncoder:
    """Texts to ids; remembers up to ``limit`` chunks between slices of the corpus."""

    def __init__(self, path: str, pattern: str, limit: int = CHUNK_LIMIT) -> None:
        self.table = MergeTable(path)
        self.pattern = regex.compile(pattern)
        self.limit = limit
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        chunks: set[str] = set()
        for text in texts:  # cut again below: the chunks of a whole slice would take ten times its memory
            if text:
                chunks.update(spaced_chunks(text))
        fresh = chunks - self.known.keys()
        if len(self.known) + len(fresh) > self.limit:
            self.known, self.words = {}, {}
            fresh = chunks
        split = {chunk: self.pattern.findall(chunk) for chunk in fresh}
        unseen = {w for words in split.values() for w in words} - self.words.keys()
        merged = []
        for word in unseen:
            whole = self.table.ranks.get(word.encode())  # a word that is a token needs no merges
            if whole is None:
                merged.append(word)
            else:
                self.words[word] = np.uint32(whole).astype("<u4").tobytes()
        if merged:
            self.words.update(zip(merged, self.table.replay([w.encode() for w in merged]), strict=True))
        for chunk, words in split.items():
            self.known[chunk] = b"".join(map(self.words.__getitem__, words))
        get = self.known.__getitem__
        return [b"".join(map(get, spaced_chunks(text))) if text else b"" for text in texts]


def decode(ids: bytes, tokens: dict[int, bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[tuple[str, str], ReplayEncoder] = {}


def replay_encoder(path: str, pattern: str) -> ReplayEncoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = ReplayEncoder(path, pattern)
    return _ENCODERS[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` (little-endian unsigned 32-bit) of every text, one row a row.

    Matches of ``pattern`` are encoded separately, without special tokens; what it does not match
    is dropped, as in the public library. Null and empty texts give empty ids. Texts are read
    whole; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = replay_encoder(path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, stop in text_slices(texts, SLICE):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), pa.array(coder.encode(texts[start:stop]), pa.binary())],
                    ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, ids binary")


def decoded(coded: DataFrame, path: str) -> DataFrame:
    """``coded`` (``doc_id``, ``ids``) plus ``decoded``, the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {rank: token for token, rank in read_ranks(path).items()}
        for batch in batches:
            raw = pa.array([None if x is None else decode(x, tokens) for x in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), raw], ["doc_id", "ids", "decoded"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


@named("op3_merge_replay")
def op3_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and the bytes they decode to, as checksums."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = decoded(encoded(table(spark, sf_dir, "documents"), path, pattern), path)
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
