"""Token counts of whole texts without their ids: pieces per distinct pre-token, times frequency.

The vocabulary never joins characters across the blank that opens a pre-token, nor across a line
break, so a text has as many tokens as its pre-tokens have together. Each document becomes
pre-token frequencies. Common pre-tokens, found in a bounded sample, are counted once ahead and
their counts (a table of at most ``head`` entries) go to every task; the frequencies of all others
are joined to a table in which every distinct pre-token of the corpus is counted once. The sample
only decides which of both ways a pre-token goes; every text is counted whole either way.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm.shared import named, stored, table

_RUNS = re.compile(" +[^ \n]*|\n[^ \n]*")
_MODELS: dict = {}
#: Documents (about) whose pre-tokens decide which are common, and how many of those are kept.
SAMPLE_DOCS = 10_000
HEAD = 200_000
FREQUENCIES = "doc_id long, n_bytes long, row long, counted long, words array<string>, times array<int>"


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text, which is taken to start with a blank; each opens with its blanks or line break."""
    if not text:
        return []
    text = " " + text.replace("▁", " ")  # the mark that stands for a blank in the vocabulary
    if "  " in text or "\0" in text:
        return _RUNS.findall(text)
    return text.replace("\n", "\0\n").replace(" ", "\0 ").split("\0")[1:]


def piece_model(path: str):
    if path not in _MODELS:
        import sentencepiece

        _MODELS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _MODELS[path]


def count_pieces(words: list[str], path: str) -> list[int]:
    """Tokens of each pre-token. The library itself opens every text with one blank."""
    coded = piece_model(path).encode([w[1:] if w[0] == " " else w for w in words], num_threads=1)
    # alone, a blank gives no token as an empty text; before a line break the library's own blank is one too many
    return [len(ids) - 1 if w[0] == "\n" else len(ids) or 1 for w, ids in zip(words, coded)]


def frequencies(docs: DataFrame, path: str, head: dict[str, int], id_col: str, text_col: str) -> DataFrame:
    """Per document: tokens of its common pre-tokens, and its other pre-tokens with their frequency."""
    spread = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row = spread.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            counted, words, times = [], [], []
            for text in batch.column(2).to_pylist():
                total, rest = 0, []
                for word in pre_tokens(text or ""):
                    got = known.get(word)
                    if got is None:
                        rest.append(word)
                    else:
                        total += got
                freq = Counter(rest)
                counted.append(total)
                words.append(list(freq))
                times.append(list(freq.values()))
            rows = pa.array(range(row, row + len(counted)), pa.int64())
            row += len(counted)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), rows, pa.array(counted, pa.int64()),
                 pa.array(words, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int32()))],
                ["doc_id", "n_bytes", "row", "counted", "words", "times"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"),
                       F.col(text_col).alias("text")).mapInArrow(run, FREQUENCIES)


def common_pre_tokens(docs: DataFrame, path: str, text_col: str, sample_docs: int, head: int) -> dict[str, int]:
    """At most ``head`` pre-tokens, the most frequent of about ``sample_docs`` documents, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            freq: Counter = Counter()
            for text in batch.column(0).to_pylist():
                freq.update(pre_tokens(text or ""))
            yield pa.RecordBatch.from_pydict({"word": pa.array(list(freq), pa.string()), "times": pa.array(list(freq.values()), pa.int64())})

    share = min(1.0, sample_docs / max(1, docs.count()))
    seen = docs.select(F.col(text_col).alias("text")).sample(share, seed=7).mapInArrow(run, "word string, times long")
    top = seen.groupBy("word").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "word").limit(head)
    words = [r["word"] for r in top.select("word").toLocalIterator()]
    return dict(zip(words, count_pieces(words, path), strict=True))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 sample_docs: int = SAMPLE_DOCS, head: int = HEAD) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every row; null texts count as empty.

    Rows with equal or null ids stay apart. Other columns are not read.
    """
    known = common_pre_tokens(docs, path, text_col, sample_docs, head)
    per_doc = stored(frequencies(docs, path, known, id_col, text_col))
    rest = per_doc.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", "w.words", "w.times")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = count_pieces(batch.column(0).to_pylist(), path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32())], ["words", "pieces"])

    pieces = rest.select("words").distinct().mapInArrow(count, "words string, pieces int")
    summed = rest.join(pieces, "words").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("others"))
    return per_doc.select("doc_id", "n_bytes", "row", "counted").join(summed, "row", "left").select(
        "doc_id", "n_bytes", (F.col("counted") + F.coalesce("others", F.lit(0))).alias("n_tokens"))


@named("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents, and whether they exceed a context of 4096."""
    import public_tokenizers

    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)
