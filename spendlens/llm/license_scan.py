"""Short license notices in whole texts, with a bounded number of edits.

Texts are reduced to their words, A-Z lowered, one blank apart. A notice of k allowed edits is cut
into k + 1 pieces, of which an occurrence with at most k edits must hold one unchanged; pieces are
searched for exactly, the places around them are verified by the regex library's bounded-error
matching. Base phrases are found word by word on their own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm.shared import named, table

#: Phrases of the base scan and the labels they give (fixed values of the contract).
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: Sentences and names by which the licenses are known, beside the base phrases (fixed values).
NOTICES = [
    *BASE,
    ("creative commons attribution", "cc-by"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("licensed under the apache license", "apache"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
]
#: One edit is allowed for so many letters of a notice, up to a most.
LETTERS_PER_EDIT, MOST_EDITS = 8, 3
#: Bytes 0 to 127 that are no word characters become blanks, A-Z become a-z; everything above belongs to words.
_WORD_BYTES = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
FINDING = "struct<label string, notice string, first_word long, last_word long, edits int, matched string, char_start long, char_end long>"


def edits_allowed(phrase: str) -> int:
    return min(MOST_EDITS, sum(c != " " for c in phrase) // LETTERS_PER_EDIT)


@dataclass(frozen=True)
class Notice:
    """A notice with its allowed edits, the pieces one of which stays exact, and the pattern that verifies."""

    phrase: str
    label: str
    edits: int

    @cached_property
    def pieces(self) -> list[tuple[int, str]]:
        """Offset and text of ``edits + 1`` pieces of about equal length."""
        cuts = [len(self.phrase) * i // (self.edits + 1) for i in range(self.edits + 2)]
        return [(a, self.phrase[a:b]) for a, b in zip(cuts, cuts[1:])]

    @cached_property
    def pattern(self):
        body = regex.escape(self.phrase, special_only=True)
        return regex.compile(f"(?<![^ ])(?:{body}){{e<={self.edits}}}(?![^ ])", regex.ENHANCEMATCH)

    def places(self, norm: str) -> Iterator[tuple[int, int, int]]:
        """Start, end and edits of whole-word occurrences that do not overlap."""
        reach = len(self.phrase) + 2 * self.edits + 2
        windows: list[tuple[int, int]] = []
        for offset, piece in self.pieces:
            at = norm.find(piece)
            while at >= 0:
                start = max(0, at - offset - self.edits - 1)
                windows.append((start, start + reach + 1))
                at = norm.find(piece, at + 1)
        last = -1
        merged: list[tuple[int, int]] = []
        for start, stop in sorted(windows):
            if merged and start <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(stop, merged[-1][1]))
            else:
                merged.append((start, stop))
        for start, stop in merged:
            # a window ends between words, or its last word would be taken for a whole one
            stop = len(norm) if (end := norm.find(" ", stop)) < 0 else end
            for found in self.pattern.finditer(norm, max(start, last), stop):
                a, b = found.span()
                if a < b:
                    # blanks that an edit took in at either end are no part of the notice
                    a += len(found[0]) - len(found[0].lstrip(" "))
                    b -= len(found[0]) - len(found[0].rstrip(" "))
                    last = max(last, b)
                    yield a, b, sum(found.fuzzy_counts)


def whole_words(norm: str, phrase: str) -> Iterator[int]:
    """Starts of a phrase as whole words; places may overlap."""
    at = norm.find(phrase)
    while at >= 0:
        end = at + len(phrase)
        if (at == 0 or norm[at - 1] == " ") and (end == len(norm) or norm[end] == " "):
            yield at
        at = norm.find(phrase, at + 1)


class LicenseScanner:
    """Base places and fuzzy findings of a text; made once a worker."""

    def __init__(self, base: Sequence[tuple[str, str]] = BASE, notices: Sequence[tuple[str, str]] = NOTICES) -> None:
        self.base = list(base)
        self.notices = [Notice(p, label, edits_allowed(p)) for p, label in notices]
        self.seeds = sorted({piece.encode() for n in self.notices for _, piece in n.pieces} | {p.encode() for p, _ in self.base})
        # a seed that holds another one is found where that is
        self.seeds = [s for s in self.seeds if not any(o != s and o in s for o in self.seeds)]

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str]], list[tuple]]:
        """Number of words, base places as (first word, label), and findings as in ``FINDING``."""
        words = (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()
        raw = b" ".join(words)
        if not any(s in raw for s in self.seeds):
            return len(words), [], []
        norm = " " + raw.decode("utf-8", "surrogatepass")  # the library allows no insertion where a search begins
        base = [(at, label) for phrase, label in self.base for at in whole_words(norm, phrase)]
        found = [(a, b, edits, n) for n in self.notices for a, b, edits in n.places(norm)]
        number = _word_numbers(norm, [at for at, _ in base] + [a for a, *_ in found] + [b - 1 for _, b, *_ in found])
        spans = self._spans(text, words, {number[a] for a, *_ in found} | {number[b - 1] for _, b, *_ in found}) if found else {}
        findings = sorted((n.label, n.phrase, number[a], number[b - 1], edits, norm[a:b], spans[number[a]][0], spans[number[b - 1]][1])
                          for a, b, edits, n in found)
        return len(words), sorted((number[at], label) for at, label in base), sorted(findings, key=lambda f: f[2:4])

    @staticmethod
    def _spans(text: str, words: list[bytes], wanted: set[int]) -> dict[int, tuple[int, int]]:
        """Character range in the text of some words."""
        spans: dict[int, tuple[int, int]] = {}
        for i, m in enumerate(regex.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)):
            if i in wanted:
                spans[i] = m.span()
                if len(spans) == len(wanted):
                    break
        return spans


def _word_numbers(norm: str, places: list[int]) -> dict[int, int]:
    """Number of the word at each place behind the leading blank, counted once from the front."""
    numbers, at, word = {}, 1, 0
    for place in sorted(set(places)):
        word += norm.count(" ", at, place)
        numbers[place], at = word, place
    return numbers


_SCANNERS: dict = {}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  base: Sequence[tuple[str, str]] = BASE, notices: Sequence[tuple[str, str]] = NOTICES) -> DataFrame:
    """One row a document: ``doc_id``, ``n_words``, ``base`` and ``findings``.

    ``base`` lists (word, label) for every place where a base phrase's words stand consecutively.
    ``findings`` lists occurrences of ``notices`` with at most ``edits_allowed`` edits, whole words
    at both ends: label, notice, first and last word, edits, matched words and the range of
    characters in the text. Occurrences of one notice do not overlap; those of different notices
    may. Words are runs of digits, letters a-z (A-Z lowered) and all characters beyond ASCII. Null
    and empty texts have no words and no findings. Rows with repeated or null ids stay apart; other
    columns are not read.
    """
    key = (tuple(base), tuple(notices))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _SCANNERS.setdefault(key, LicenseScanner(*key))
        for batch in batches:
            scanned = [scanner.scan(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([s[0] for s in scanned], pa.int64()),
                pa.array([[dict(zip(("word", "label"), p)) for p in s[1]] for s in scanned], _PLACES),
                pa.array([[dict(zip(_FINDING.names, f)) for f in s[2]] for s in scanned], pa.list_(_FINDING))],
                ["doc_id", "n_words", "base", "findings"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, base array<struct<word long, label string>>, findings array<{FINDING}>")


_PLACES = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
_FINDING = pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                      ("edits", pa.int32()), ("matched", pa.string()), ("char_start", pa.int64()), ("char_end", pa.int64())])


def license_summary(scanned: DataFrame) -> DataFrame:
    """Counts and labels of ``scan_licenses``: labels are distinct, in order and joined by commas.

    ``score`` is 1 for a document with a base place or an exact notice, less the share of edited
    letters for one whose best finding has edits, and 0 without any.
    """
    best = F.array_max(F.transform("findings", lambda f: 1 - f["edits"] / F.length(f["notice"])))
    base_labels = F.transform("base", lambda b: b["label"])
    own = F.transform("findings", lambda f: f["label"])
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["word"])).alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["word"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, own)), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"))


@named("op13_license_scan")
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in all documents."""
    return license_summary(scan_licenses(table(spark, sf_dir, "documents")))
