"""Word shingles as hashed sets, and circulant MinHash signatures of such sets.

Two permutations give every coordinate: the first scatters the elements over ``UNIVERSE`` places,
the second orders the places and is shifted circularly by one place per coordinate. The values an
element has in all coordinates then lie side by side, so one row copy per element and one
column-wise minimum make the whole signature.
"""

from __future__ import annotations

import numpy as np
import xxhash

UNIVERSE = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    values = (values ^ (values >> np.uint64(30))) * _MIX[0]
    values = (values ^ (values >> np.uint64(27))) * _MIX[1]
    return values ^ (values >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""

    def __init__(self, words: int = 4, limit: int = 250_000) -> None:
        self.words, self.limit = words, limit
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        """A-Z is lowered and ASCII white space parts words; a shorter text is one shingle, one without words none."""
        parts = (text or "").encode().lower().split()
        if not parts:
            return np.empty(0, np.uint64)
        known = self.known
        try:
            hashes = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
        except KeyError:
            if len(known) > self.limit:
                known.clear()
            for part in {p for p in parts if p not in known}:
                known[part] = xxhash.xxh3_64_intdigest(part)
            hashes = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
        size = min(self.words, len(parts))
        rows = len(parts) - size + 1
        total = hashes[:rows] + np.uint64(size)
        for k in range(1, size):
            total = mixed(total) * _MULTIPLIER + hashes[k:k + rows]
        return np.unique(mixed(total))


class CirculantMinHash:
    """Signatures of ``coordinates`` values from two permutations."""

    def __init__(self, coordinates: int = 96, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.scatter = np.uint64(rng.integers(1, 2**63) | 1)
        order = rng.permutation(UNIVERSE).astype(np.uint32)
        around = np.concatenate([order, order[:coordinates]])  # the shift runs around the end
        self.rows = np.lib.stride_tricks.sliding_window_view(around, coordinates)
        self.coordinates = coordinates

    def __call__(self, shingles: np.ndarray, at_once: int = 4096) -> np.ndarray:
        """Signature of a set that is not empty."""
        places = (mixed(shingles * self.scatter) & np.uint64(UNIVERSE - 1)).astype(np.int64)
        found = self.rows[places[:at_once]].min(axis=0)
        for start in range(at_once, len(places), at_once):
            found = np.minimum(found, self.rows[places[start:start + at_once]].min(axis=0))
        return found


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One signed 64-bit key per band of ``rows`` coordinates; the band's number is part of it."""
    bands = signature.reshape(-1, rows).astype(np.uint64)
    key = np.arange(1, len(bands) + 1, dtype=np.uint64)
    for k in range(rows):
        key = mixed(key * _MULTIPLIER + bands[:, k])
    return key.view(np.int64)


def same_share(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of intersection and union of two sorted sets of distinct numbers."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small):
        return 0, len(large)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return common, len(a) + len(b) - common
