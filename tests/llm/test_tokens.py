"""Token files, packing, merge replay and token counts against the libraries themselves."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from spendlens.llm.bin_completion import best_fit, bin_completion, lower_bound
from spendlens.llm.merge_replay import ReplayEncoder, decoded, encoded
from spendlens.llm.packing import pack, packed_documents, pieces
from spendlens.llm.shared import opened
from spendlens.llm.token_counts import count_pieces, pre_tokens, token_counts
from spendlens.llm.token_files import (BLOCK, ShardReader, decode_blocks, encode_blocks, library_encoder, read_token_shards,
                                       write_token_shards)
from spendlens.llm.tokenizing import ChunkEncoder, batch_slices, encoder, spaced_chunks

ALPHABET = " \n\t    abcXYZéßñΣİ'sdt123.,!<|endoftext|></s>́中文🙂\x1c\x85\0▁\xa0"
SCHEMA = "text string, doc_id long, ids string, length string, start string"


def odd_texts(n=600, seed=4):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)] + [
        "", " ", "\n", "a" * 3000 + "ab" * 700, "!" * 1500, "<|endoftext|> and <s></s>", "DON'T don't  'll", "word " * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, nulls, repeated rows and columns whose names the operators use themselves."""
    rows = [(t, i * 3, "x", "y", "z") for i, t in enumerate(odd_texts(150))]
    rows += [(None, 5000, None, None, None), ("same text", 5001, "x", "y", "z"), ("same text", 5001, "x", "y", "z"), ("no id", None, "", "", "")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def rows_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("limit", [100, 700_000])
def test_chunk_encoder_equals_library(name, limit):
    texts = odd_texts()
    library = Tokenizer.from_file(P.path(name))
    coder = ChunkEncoder(P.path(name), limit)
    for part in (texts[:200], texts[200:], texts[:50]):
        want = [x.ids for x in library.encode_batch(part, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(part)] == want
    assert coder.encode([None, ""]) == [b"", b""]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_special_strings_beside_white_space(name):
    """What stands before a special string ends there, white space too."""
    rng = random.Random(8)
    pieces_of = ["<|endoftext|>", "<|startoftext|>", "<|endoftext|", "\n\n", "  ", "\n", " ", "\t \t", "\u3000\u3000", "a", "B c", ".", "'s", "\0", "é", "\u0301"]
    texts = ["a\n\n<|endoftext|>b"] + ["".join(rng.choice(pieces_of) for _ in range(rng.randint(1, 14))) for _ in range(2000)]
    want = [x.ids for x in Tokenizer.from_file(P.path(name)).encode_batch(texts, add_special_tokens=False)]
    coder = ChunkEncoder(P.path(name), 300)
    got = [np.frombuffer(x, "<u4").tolist() for i in range(0, len(texts), 50) for x in coder.encode(texts[i:i + 50])]
    assert got == want


@pytest.mark.parametrize("n", [0, 1, BLOCK - 1, BLOCK, BLOCK + 1, 70 * BLOCK + 3])
@pytest.mark.parametrize("kind", ["zipf", "equal", "wide"])
def test_blocks_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {"zipf": rng.zipf(1.3, n) % 50_000, "equal": np.full(n, 9), "wide": rng.integers(0, 2**32, n)}[kind].astype("<u4")
    blocks = encode_blocks(ids)
    assert (decode_blocks(b"".join(blocks)) == ids).all()
    if kind == "zipf" and n > BLOCK:
        assert sum(map(len, blocks)) < 2 * n  # below two bytes an id


def test_token_shards(spark, docs):
    shards = write_token_shards(docs, library_encoder(P.path("word_bpe_49k.json")), 2)
    got = sorted(((r["start"], r["doc_id"], bytes(r["ids"])) for r in read_token_shards(shards).collect()), key=lambda r: r[0])
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = sorted(rows_of(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    at = 0
    for (start, doc_id, raw), (want_id, text) in zip(got, want, strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert (start, doc_id, np.frombuffer(raw, "<u4").tolist()) == (at, want_id, ids)
        at += len(ids)
    shard = shards.orderBy("shard").first()
    reader = ShardReader(shard["file"])
    whole = np.concatenate([ids for _, _, ids in reader.documents()])
    assert len(whole) == shard["ids"]
    middle = len(whole) // 2
    assert (reader.range(middle, middle + 50) == whole[middle:middle + 50]).all()
    assert opened(shard["file"])[0] is not None


def test_token_shards_of_nothing(spark, docs):
    shards = write_token_shards(docs.limit(0), library_encoder(P.path("word_bpe_49k.json")), 2)
    assert shards.count() == 0 and read_token_shards(shards).count() == 0


def smallest(lengths, capacity):
    """Fewest bins, by trying all ways."""
    best = [len(lengths)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b >= lengths[i]}.values():
            place(i + 1, [*bins[:k], bins[k] - lengths[i], *bins[k + 1:]])
        place(i + 1, [*bins, capacity - lengths[i]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(40))
def test_bin_completion_is_as_good_as_trying_all(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 17, 30])
    lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 11))), reverse=True)
    counts = {k: lengths.count(k) for k in lengths}
    patterns = bin_completion(counts, capacity)
    used = [k for content, times in patterns for k in content * times]
    assert sorted(used) == sorted(lengths) and all(sum(c) <= capacity for c, _ in patterns)
    assert sum(n for _, n in patterns) == smallest(lengths, capacity)
    assert lower_bound(counts, capacity) <= smallest(lengths, capacity) <= sum(n for _, n in best_fit(counts, capacity))


def test_packing(spark, docs):
    got = packed_documents(docs, P.path("byte_bpe_50k.json"), capacity=64).toPandas()
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for doc_id, text in rows_of(docs):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 64 or 64
        bounds = [0, *range(first, len(ids) + 1, 64)]
        want += [(doc_id, k, bounds[k], bounds[k + 1] - bounds[k], zlib.crc32(ids[bounds[k]:bounds[k + 1]].tobytes())) for k in range(len(bounds) - 1)]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    pieces_got = [(None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()]
    assert sorted(pieces_got, key=key) == sorted(want, key=key)
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered["offset"] == ordered.groupby("sequence_id")["length"].cumsum() - ordered["length"]).all()
    assert ordered.groupby("sequence_id")["length"].sum().max() <= 64
    assert ordered["sequence_id"].nunique() <= sum(n for _, n in best_fit(got["length"].value_counts().to_dict(), 64))


def test_packing_of_nothing_and_of_no_tokens(spark, docs):
    assert packed_documents(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0
    cut = pieces(spark.createDataFrame([("", 1), (None, 2)], "text string, doc_id long"), library_encoder(P.path("byte_bpe_50k.json")), None, 8)
    assert pack(cut, 8).count() == 0


def test_a_worker_remembers_no_more_chunks_than_it_is_told():
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(1)
    encode = library_encoder(path, 1000)
    for _ in range(20):
        texts = [" ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(20)) for _ in range(10)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(encoder(path, 1000).known) + len(encoder(path, 1000).older) <= 1000


def test_chunks_are_cut_out_of_the_bytes_of_the_texts():
    """One copy of the texts holds all chunks, which are those of ``spaced_chunks`` but for empty ones."""
    coder = ChunkEncoder(P.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    whites = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
    texts = [t.replace("\0", "") for t in odd_texts()] + ["a b\nc", "\n", " a", "a\n", "\n b", "\ta\tb", "é \u3000x"] + [
        "".join(rng.choice("aé. \n" + rng.choice(whites)) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    chunks, starts = coder._split(texts)
    assert chunks.buffers()[2].size <= sum(len(t.encode()) for t in texts) + 64
    listed = chunks.to_pylist()
    assert [listed[a:b] for a, b in zip(starts, starts[1:])] == [[c for c in spaced_chunks(t) if c] for t in texts]
    assert coder.encode([]) == [] and coder.encode(["", None]) == [b"", b""]
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_batches_are_cut_by_characters():
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4, 5], "text": ["ab", None, "中文é", "", "x"]})
    assert [p.column(0).to_pylist() for p in batch_slices(batch, 1, 3)] == [[1, 2, 3], [4, 5]]
    assert not list(batch_slices(batch.slice(0, 0), 1))


def tiktoken_encoding():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("rising", [True, False])
def test_merge_replay_equals_library(rising):
    coder, library, texts = ReplayEncoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, 500), tiktoken_encoding(), odd_texts()
    if not coder.table.rising or not rising:
        coder.table.rising = False
    for part in (texts[:300], texts[300:]):
        assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(part)] == [library.encode_ordinary(t) for t in part]


def test_encode_and_decode_columns(spark, docs):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    got = decoded(encoded(docs, path, P.PATTERN), path).collect()
    library = tiktoken_encoding()
    sums = lambda rows: sorted((str(i), hashlib.sha256(a).hexdigest(), hashlib.sha256(b).hexdigest()) for i, a, b in rows)
    assert sums((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in got) == sums(
        (i, np.array(library.encode_ordinary(t), "<u4").tobytes(), t.encode()) for i, t in rows_of(docs))
    assert encoded(docs.limit(0), path, P.PATTERN).count() == 0


def test_pre_tokens_count_like_the_library():
    path = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for text in odd_texts(2000):
        words = pre_tokens(text)
        assert (sum(count_pieces(words, path)) if words else 0) == len(library.encode(text)), text


@pytest.mark.parametrize("head", [1, 200_000])
def test_token_counts(spark, docs, head):
    path = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_counts(docs, path, head=head).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == sorted(
        (str(i), len(t.encode()), len(library.encode(t))) for i, t in rows_of(docs))
    assert token_counts(docs.limit(0), path).count() == 0
