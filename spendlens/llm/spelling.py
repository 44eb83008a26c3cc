"""Spelling variants by words of a reduced alphabet.

Letters are hashed to a few symbols. One edit of a word is one edit, or none, of its reduced word,
so words that lie one edit apart meet where the reduced word of one is in the full one-edit
neighbourhood of the other's. Neighbourhoods are joined with the reduced vocabulary on 64-bit keys and
every pair that meets is verified on the words themselves.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm.shared import named, stored, table

_RUN, _LETTER = re.compile("[A-Za-z\u00C0-\u00FF]+"), re.compile("[A-Za-z\u00C0-\u00FF]")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Symbols of the reduced alphabet; distinct words a task holds before it passes their counts on; characters cut up at once.
SYMBOLS = 6
WORDS_HELD = 150_000
PIECE = 1_000_000


def runs(text: str) -> Iterator[list[str]]:
    """Maximal runs of letters with A-Z lowered, a list for each piece of a long text; pieces end between runs."""
    start = 0
    while start < len(text):
        stop = start + PIECE
        while stop < len(text) and _LETTER.match(text, stop):
            stop += 1
        piece = text[start:stop]
        yield _RUN.findall(piece.lower() if piece.isascii() else piece.translate(_LOWER))
        start = stop


def misspelt(word: str, crc: int, every: int) -> str:
    """The word, or where ``every`` divides its checksum the word without one of its letters."""
    if crc % every:
        return word
    at = crc % len(word)
    return word[:at] + word[at + 1:]


def vocabulary(docs: DataFrame, least_length: int = 6, least_n: int = 5, every: int | None = 199,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word`` and ``n``: words of ``least_length`` letters that occur ``least_n`` times in all texts.

    ``every`` plants misspellings: by the crc32 of ``<id>:<word>`` one run in ``every`` loses a letter; None
    plants none. Null texts have no words; a null id counts as an empty one. Every task adds up its
    words before the shuffle and passes them on whenever it holds ``WORDS_HELD``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                in_text: Counter = Counter()
                for some in runs(text or ""):
                    in_text.update(some)
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in in_text.items():
                    if len(word) >= least_length:
                        if every and (crc := zlib.crc32(word.encode(), prefix)) % every == 0:
                            word = misspelt(word, crc, every)
                            if len(word) < least_length:
                                continue
                        held[word] += n
                if len(held) > WORDS_HELD:
                    yield _counted(held)
                    held = Counter()
        yield _counted(held)

    seen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")
    return seen.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})


_MIX, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def symbols_of(word: str, symbols: int) -> list[int]:
    """The symbol of every letter, by a multiplicative hash of its code point."""
    return [((ord(c) * 2654435761 & 0xFFFFFFFF) >> 8) % symbols + 1 for c in word]


def _key(reduced: list[int]) -> int:
    key = 0
    for s in reduced:
        key = (key * _MIX + s) & _MASK
    return key


def reduced_key(word: str, symbols: int) -> int:
    """64-bit polynomial key of the reduced word; equal reduced words have equal keys."""
    return _key(symbols_of(word, symbols))


def neighbour_keys(word: str, symbols: int) -> set[int]:
    """Keys of the reduced word and of everything one symbol inserted, deleted or replaced away.

    Keys of heads and tails are added up, so a neighbour costs no pass over the word.
    """
    reduced = symbols_of(word, symbols)
    n = len(reduced)
    power, heads, tails = [1], [0], [0] * (n + 1)
    for s in reduced:
        heads.append((heads[-1] * _MIX + s) & _MASK)
    for _ in range(n + 1):
        power.append(power[-1] * _MIX & _MASK)
    for i in range(n - 1, -1, -1):
        tails[i] = (reduced[i] * power[n - 1 - i] + tails[i + 1]) & _MASK
    keys = {heads[n]}
    for i in range(n + 1):
        inserted = heads[i] * power[n - i + 1] + tails[i]
        keys.update([(inserted + s * power[n - i]) & _MASK for s in range(1, symbols + 1)])
        if i < n:
            after = tails[i + 1]
            keys.add((heads[i] * power[n - 1 - i] + after) & _MASK)
            replaced = heads[i] * power[n - i] + after
            keys.update([(replaced + s * power[n - 1 - i]) & _MASK for s in range(1, symbols + 1)])
    return keys


def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """``word``, ``near``, ``near_n`` for every ordered pair of words one edit apart; ``words`` has distinct ``word`` and ``n``.

    A word meets another once at most, since its neighbourhood is a set. Words whose reduced words
    agree are as many candidates only for the words around them, and the join deals hot keys out.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_signed(reduced_key(w, symbols)) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *batch.columns], ["key", "near", "near_n"])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                some = batch.column(0).slice(start, 2000)
                keys = [list(map(_signed, neighbour_keys(w, symbols))) for w in some.to_pylist()]
                rows = pa.array([i for i, k in enumerate(keys) for _ in k], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([k for ks in keys for k in ks], pa.int64()), some.take(rows)], ["key", "word"])

    # the vocabulary is small beside its neighbourhoods: spread before they are written out
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = words.select("word").repartition(parts).mapInArrow(around, "key long, word string")
    right = words.select("word", "n").mapInArrow(keyed, "key long, near string, near_n long")
    met = left.join(right, "key").where(F.abs(F.length("word") - F.length("near")) <= 1)
    return met.where(F.levenshtein("word", "near", 1) == 1).select("word", "near", "near_n")


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def spelling_forms(words: DataFrame, times: int = 5, symbols: int = SYMBOLS) -> DataFrame:
    """Words with the more common spelling each is taken to be a variant of.

    ``words`` has distinct words (at least one letter) and their ``n``; null words are left out. A word's ``form``
    is its near word of largest n (ties: smallest by code points) if that has at least ``times`` (above 1) its
    own n, else null; ``root`` follows forms to the last. ``n_near`` counts near words; ``form_n`` is
    the form's n. Roots are found by jumping to the root's form, each round written to the shared folder.
    """
    words = stored(words.where(F.col("word").isNotNull()).select("word", "n"))
    best = near_words(words, symbols).groupBy(F.col("word").alias("of")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    wins = -F.col("best.less") >= F.lit(times) * F.col("n")
    formed = stored(words.join(best, words["word"] == best["of"], "left").select(
        "word", F.when(wins, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(wins, -F.col("best.less")).alias("form_n")))
    links = formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        # a root that has a root itself is passed over; forms grow in n, so this ends
        onward = links.select(F.col("word").alias("at"), F.col("root").alias("further"))
        jumped = stored(links.join(onward, links["root"] == onward["at"], "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        links = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            break
    roots = links.select(F.col("word").alias("of"), "root")
    return formed.join(roots, formed["word"] == roots["of"], "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@named("op12_spelling_variants")
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling_forms(vocabulary(table(spark, sf_dir, "documents")))
