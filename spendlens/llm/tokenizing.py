"""Whole texts to token ids with a bounded memory of chunks already encoded.

A text is cut where its tokenizer's pre-tokenization is certain to cut as well (see
``spaced_chunks``), so encoding chunk by chunk equals encoding the text. Every distinct chunk is
encoded once by the library and remembered, up to a bound, words apart from the signs behind them. Special strings
of the file are cut out first, as the library does, so what stands before them ends there.
"""

from __future__ import annotations

import gc
import json
import os
import re
import unicodedata
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space as Unicode defines it (fixed values).
WHITE = "\\t\\n\\v\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_COARSE = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
_TWO_WHITE = re.compile(r"\s\s")
#: The same for Arrow, whose expressions know only ASCII white space by that name.
_WHITE_TWICE = "[" + "".join(c for c in map(chr, range(0x3001)) if c.isspace()) + "]{2}"
#: ASCII signs that form one piece when they follow letters; the apostrophe starts contractions.
_SIGNS = '.,!?;:%&*$#()[]{}"/\\|+-=@<>~^_`'
#: Letters that neither compose with others nor change their number in lower case.
_LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha())
_WORD_AND_SIGNS = "^ ?[" + _LETTERS + "]+[" + re.escape(_SIGNS) + "]*$"
CHUNK_LIMIT = 1_000_000


def spaced_chunks(text: str) -> list[str]:
    """Cut for byte-level patterns: a word keeps one leading blank, white-space runs stand alone.

    Such patterns never join a character other than white space to white space behind it, and
    take a single blank before a word into the word; runs of white space lose their last
    character to what follows only if that is a blank before a word. Empty strings may occur.
    """
    if "\0" in text or _TWO_WHITE.search(text):
        return _COARSE.findall(text)
    return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")


def word_chunks(text: str) -> list[bytes]:
    """Cut at ASCII white space, for tokenizers that drop white space."""
    return text.encode().split()


def _taken(flat: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches ``at`` of ``flat``, which ``ends`` bounds, one after another, and their bounds."""
    sizes = (ends[1:] - ends[:-1])[at]
    bounds = np.append(0, np.cumsum(sizes))
    return flat[np.repeat(ends[at] - bounds[:-1], sizes) + np.arange(bounds[-1])], bounds


class ChunkEncoder:
    """Ids of texts by a ``tokenizers`` file, as little-endian unsigned 32-bit bytes.

    ``word_ends`` tells vocabularies that mark ends of words and drop white space from
    byte-level ones that keep a leading blank. Special strings in texts are treated as the
    library does by default.
    """

    def __init__(self, path: str, limit: int = CHUNK_LIMIT) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model, added = described["model"], described.get("added_tokens") or []
        self.special = {t["content"] for t in added}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=lambda t: (-len(t), t)))) + ")") if self.special else None
        #: special strings that take in what stands around them, or change with their surroundings, keep their text whole
        self.whole = any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word", "normalized"))
        suffix = model.get("end_of_word_suffix")
        self.word_ends = bool(suffix)
        size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.edge = np.zeros(size, dtype=bool)  # ids that end (start) a word
        for piece, at in model["vocab"].items():
            self.edge[at] = piece.endswith(suffix) if self.word_ends else piece.startswith("Ġ")
        self.limit = limit
        self.known: dict = {}
        self.older: dict = {}

    def cut(self, text: str) -> list:
        """Chunks of a text: bytes between white space for words with ends, else strings that keep their blank."""
        if self._special_inside(text):
            if self.whole:
                return [text.encode() if self.word_ends else text]
            parts = self.special_cut.split(text)
            return [c for i, part in enumerate(parts) for c in ([part] if i % 2 else spaced_chunks(part))]
        return word_chunks(text) if self.word_ends else spaced_chunks(text)

    def _special_inside(self, text: str) -> bool:
        return bool(self.special) and (self.whole or not self.word_ends) and any(t in text for t in self.special)

    def _split(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """Chunks of texts without special strings and, unless words have ends, without zero bytes; and where each text's chunks begin.

        Chunks that keep their blank are cut out of the texts' own bytes, one after another. Empty ones may occur.
        """
        rows = pa.array(texts, pa.large_string())
        if self.word_ends:
            split = pc.ascii_split_whitespace(rows)
            return split.flatten(), split.offsets.to_numpy()
        _, offsets, data = rows.buffers()
        starts = np.frombuffer(offsets, np.int64)[:len(texts) + 1]
        raw = np.frombuffer(data or b"", np.uint8)[:starts[-1]]
        begins = np.zeros(len(raw) + 1, dtype=bool)
        begins[:-1] = (raw == 32) | (raw == 10)
        begins[1:] |= raw == 10
        begins[starts] = True
        for i in np.flatnonzero(pc.match_substring_regex(rows, _WHITE_TWICE).to_numpy(zero_copy_only=False)).tolist():
            begins[starts[i] + 1:starts[i + 1]] = False
            begins[starts[i] + np.cumsum([len(c.encode()) for c in _COARSE.findall(texts[i])])] = True
        at = np.flatnonzero(begins)
        chunks = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), data or pa.py_buffer(b""))
        return chunks, np.searchsorted(at, starts)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """One bytes object a text; null texts count as empty.

        Chunks are told apart and numbered by Arrow, so Python sees each distinct one of a call once. Memory
        has two generations of ``limit // 2`` chunks: when the younger is full it becomes the older one, from
        which chunks that are met again come back.
        """
        rows = [t or "" for t in texts]
        alone = [i for i, t in enumerate(rows) if self._special_inside(t) or not self.word_ends and "\0" in t]
        parts = {i: self.cut(rows[i]) for i in alone}
        chunks, starts = self._split(["" if i in parts else t for i, t in enumerate(rows)] if parts else rows)
        numbered = chunks.dictionary_encode()
        collecting = gc.isenabled()
        gc.disable()  # many small objects, none in a cycle
        try:
            odd, words, pair = self._atoms(numbered.dictionary)
            coded = self._coded([*odd, *words], len(odd), set().union(*parts.values()))
        finally:
            if collecting:
                gc.enable()
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        # the ids of each distinct chunk, its word's and its signs', then those of all chunks
        flat, ends = _taken(np.frombuffer(b"".join(coded), "<u4"), np.append(0, np.cumsum(sizes)), pair.ravel())
        ids, ends = _taken(flat, ends[::2], numbered.indices.to_numpy())
        bounds = ends[starts]
        get = self.known.__getitem__
        return [b"".join(map(get, parts[i])) if i in parts else ids[a:b].tobytes()
                for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist()))]

    def _atoms(self, chunks: pa.Array) -> tuple[list, list, np.ndarray]:
        """Odd chunks, words and signs, and for every chunk the numbers of its two parts in the lists one after another.

        A chunk of letters with signs behind them has the ids of the word, then those of the signs; any other is odd.
        """
        simple = pc.match_substring_regex(chunks, _WORD_AND_SIGNS)
        if self.special:
            simple = pc.and_not(simple, pc.is_in(chunks, pa.array(sorted(self.special), chunks.type)))
        easy = chunks.filter(simple)
        core = pc.ascii_rtrim(easy, _SIGNS)
        core = (pc.ascii_lower(core) if self.word_ends else core).dictionary_encode()
        signs = pc.utf8_ltrim(easy, " " + _LETTERS).dictionary_encode()

        def listed(strings: pa.Array) -> list:
            return (strings.cast(pa.large_binary()) if self.word_ends else strings).to_numpy(zero_copy_only=False).tolist()

        odd = [b"" if self.word_ends else "", *listed(chunks.filter(pc.invert(simple)))]
        words = listed(core.dictionary) + listed(signs.dictionary)
        mask = simple.to_numpy(zero_copy_only=False)
        pair = np.zeros((len(chunks), 2), np.int64)  # number 0 is empty
        pair[~mask, 0] = np.arange(1, len(odd))
        pair[mask, 0] = core.indices.to_numpy() + len(odd)
        pair[mask, 1] = signs.indices.to_numpy() + (len(odd) + len(core.dictionary))
        return odd, words, pair

    def _coded(self, chunks: list, odd: int, more: set) -> list[bytes]:
        """Ids of chunks, of which the first ``odd`` are of any kind and the others words and signs; memory then holds ``more`` too."""
        coded = list(map(self.known.get, chunks))
        fresh = [i for i, c in enumerate(coded) if c is None]
        if len(self.known) + len(fresh) + len(more - self.known.keys()) > self.limit // 2:
            self.older, self.known = self.known, {}
            coded, fresh = [b""] * len(chunks), range(len(chunks))
        if fresh or more:
            words = self._not_recalled([chunks[i] for i in fresh if i >= odd])
            rest = self._not_recalled(list(more.union(chunks[i] for i in fresh if i < odd) - self.known.keys()))
            if words or rest:
                self._learn(words, rest)
            for i in fresh:
                coded[i] = self.known[chunks[i]]
        return coded

    def _not_recalled(self, fresh: list) -> list:
        """Chunks that the older generation does not hold either; those it holds come back."""
        if not self.older:
            return fresh
        found = list(map(self.older.get, fresh))
        self.known.update([(w, c) for w, c in zip(fresh, found) if c is not None])
        return [w for w, c in zip(fresh, found) if c is None]

    def _learn(self, parts: list, chunks: list) -> None:
        """Plain words are learnt together; chunks with signs behind a word as word and signs; anything else alone."""
        known, mixed = self.known, []
        if self.word_ends:
            plain = [c for c in chunks if c.isalpha()]  # of bytes: ASCII letters only
            words = {c.lower() for c in plain}
            rest = [c for c in chunks if not c.isalpha()]
        else:
            plain = []
            words = {c for c in chunks if c.isascii() and c[:1] == " " and c[1:].isalpha()}
            rest = [c for c in chunks if c not in words]
        odd = []
        for chunk in rest:
            text = chunk.decode() if self.word_ends else chunk
            core = text.rstrip(_SIGNS)
            letters = core if self.word_ends else core[1:] if core[:1] == " " else core
            # lower case can turn a letter into letter and mark, which would join the signs behind it
            if text not in self.special and (letters.isascii() and letters.isalpha() or (
                    letters.isalpha() and letters.lower().isalpha() and unicodedata.is_normalized("NFC", letters))):
                signs = text[len(core):]
                if self.word_ends:
                    core, signs = (core.lower() if letters.isascii() else core).encode(), signs.encode()
                mixed.append((chunk, core, signs))
            else:
                odd.append(chunk)
        words.update(w for _, core, signs in mixed for w in (core, signs))
        words = words.difference(parts) if words else words
        needed = parts + self._not_recalled([w for w in words if w not in known])
        joining, alone = self._joining(needed)
        self._learn_alone(alone + self._learn_joined(joining))
        known.update([(c, known[c.lower()]) for c in plain])
        known.update([(c, known[core] + known[signs]) for c, core, signs in mixed if signs])
        self._learn_alone(odd)

    def _joining(self, parts: list) -> tuple[list, list]:
        """Words that can be told from their neighbours by the marks of their pieces, and all other parts."""
        if self.word_ends:
            told = [p[-1:] >= b"a" and p.isalpha() or p.decode()[-1:].isalpha() for p in parts]
        else:
            told = [p[:1] == " " and p[-1:].isalpha() for p in parts]
        return list(compress(parts, told)), [p for p, t in zip(parts, told) if not t]

    def _learn_alone(self, parts: list) -> None:
        self.known.update(zip(parts, self._library([p.decode() if self.word_ends else p for p in parts])))

    def _library(self, texts: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(c.ids, dtype="<u4").tobytes() for c in coded]

    def _learn_joined(self, words: list, at_once: int = 1000) -> list:
        """Many words in one call; marked pieces tell where each word's ids end. Returns words for which they do not."""
        groups = [words[i:i + at_once] for i in range(0, len(words), at_once)]
        joined = [b" ".join(g).decode() if self.word_ends else "".join(g) for g in groups]
        coded = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        left = []
        for group, c in zip(groups, coded, strict=True):
            ids = np.array(c.ids, dtype="<u4")
            marks = np.flatnonzero(self.edge[ids])
            bounds = np.append(0, marks + 1) if self.word_ends else np.append(marks, len(ids))
            if len(bounds) != len(group) + 1 or bounds[0] != 0:
                left += group
                continue
            raw, cuts = ids.tobytes(), (bounds * 4).tolist()
            self.known.update(zip(group, map(raw.__getitem__, map(slice, cuts, cuts[1:]))))
        return left


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str, limit: int = CHUNK_LIMIT) -> ChunkEncoder:
    """One encoder per file and Python worker, which remembers up to ``limit`` chunks from now on."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    _ENCODERS[path].limit = limit
    return _ENCODERS[path]


def _ranges(lengths: list[int], chars: int):
    start = size = 0
    for at, length in enumerate(lengths):
        size += length
        if size >= chars:
            yield start, at + 1
            start, size = at + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def text_slices(texts: list[str | None], chars: int = 4_000_000):
    """Ranges of a batch that hold about ``chars`` characters each, so that few texts are cut up at once."""
    return _ranges([len(t or "") for t in texts], chars)


def batch_slices(batch: pa.RecordBatch, column: int, chars: int = 4_000_000):
    """Parts of a batch whose texts in ``column`` hold about ``chars`` characters each, so that few texts are Python strings at once."""
    for first, last in _ranges(pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_pylist(), chars):
        yield batch.slice(first, last - first)
