"""Bin completion on counts per length: which lengths share a sequence, how often.

Works on a histogram of lengths, at most ``capacity`` numbers whatever the corpus holds. The
largest remaining length is completed with undominated fillings of the room beside it, least
waste first; a choice is repeated as long as its lengths last. Best-fit decreasing gives the
first incumbent, each completed dive may give a better one, and a branch ends once its waste
leaves no room for fewer sequences than the incumbent has. The search stops at a proven lower
bound or after ``nodes`` decisions; the incumbent is a whole packing in either case.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import chain, combinations, islice

Pattern = tuple[tuple[int, ...], int]  # lengths of one sequence, how many such sequences


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences any packing needs: total length, sharpened by lengths that exclude each other."""
    lengths = sorted(counts)
    best = -(-sum(k * n for k, n in counts.items()) // capacity)
    for small in [k for k in lengths if k <= capacity // 2]:
        alone = sum(n for k, n in counts.items() if k > capacity - small)
        half = [(k, n) for k, n in counts.items() if capacity // 2 < k <= capacity - small]
        rest = sum(k * n for k, n in counts.items() if small <= k <= capacity // 2)
        room = sum((capacity - k) * n for k, n in half)
        best = max(best, alone + sum(n for _, n in half) + max(0, -(-(rest - room) // capacity)))
    return max(best, sum(n for k, n in counts.items() if 2 * k > capacity))


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing, many equal sequences at a time."""
    open_: dict[int, list[list]] = {}  # room left -> [content, how many]
    rooms: list[int] = []

    def put(content: tuple[int, ...], times: int, room: int) -> None:
        if times:
            if room not in open_:
                open_[room] = []
                rooms.insert(bisect_left(rooms, room), room)
            open_[room].append([content, times])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                content, times, room = (), left, capacity
            else:
                room = rooms[at]
                content, times = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            each = room // length
            full = min(times, left // each)
            put(content + (length,) * each, full, room - each * length)
            left -= full * each
            times -= full
            if times and left and left < each:
                put(content + (length,) * left, 1, room - left * length)
                left, times = 0, times - 1
            if content:
                put(content, times, room)
    return [(tuple(c), n) for groups in open_.values() for c, n in groups]


def exact_fillings(room: int, counts: dict[int, int], lengths: list[int]) -> Iterator[tuple[int, ...]]:
    """Two or three lengths, not rising, that fill ``room`` exactly; those with large lengths first."""
    fit = lengths[:bisect_right(lengths, room)][::-1]
    for parts in (2, 3):
        for a in fit:
            rest = room - a
            if parts * a < room:
                break
            for b in (fit if parts == 3 else [rest]):
                c = rest - b
                if b > a or b <= 0 or c > b or c < 0:
                    continue
                if parts == 3 and 2 * b < rest:
                    break
                chosen = (a, b, c) if c else (a, b)
                if len(chosen) == parts and all(counts.get(k, 0) >= n for k, n in Counter(chosen).items()):
                    yield chosen


def fillings(room: int, counts: dict[int, int], lengths: list[int], waste: int, most: int) -> list[tuple[int, ...]]:
    """Undominated ways to fill ``room``, least waste first; up to ``most`` of each kind are looked at."""
    if counts.get(room):
        return [(room,)]  # an exact single length dominates all else
    found: dict[tuple[int, ...], int] = {}

    def walk(chosen: list[int], gap: int, largest: int) -> Iterator[tuple[int, ...]]:
        stop = bisect_right(lengths, min(gap, largest))
        used = Counter(chosen)
        grew = False
        for i in range(stop - 1, -1, -1):
            length = lengths[i]
            if used[length] < counts[length]:
                grew = True
                yield from walk([*chosen, length], gap - length, length)
        if not grew:
            yield tuple(chosen)

    for chosen in chain(islice(exact_fillings(room, counts, lengths), most // 4), islice(walk([], room, room), most)):
        gap = room - sum(chosen)
        if gap <= waste and chosen not in found and not dominated(chosen, gap, counts, lengths):
            found[chosen] = gap
    return sorted(found, key=lambda c: (found[c], len(c)))


def dominated(chosen: tuple[int, ...], gap: int, counts: dict[int, int], lengths: list[int]) -> bool:
    """Whether one unused length can take the place of some chosen ones and the gap beside them."""
    used = Counter(chosen)
    sizes = range(1, len(chosen) + 1) if len(chosen) <= 6 else (1, 2)
    for size in sizes:
        for part in set(combinations(chosen, size)):
            total = sum(part)
            first = bisect_left(lengths, total + (size == 1))
            for length in lengths[first:bisect_right(lengths, total + gap)]:
                if counts[length] > used[length]:
                    return True
    return False


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = 6_000, width: int = 48) -> list[Pattern]:
    """Patterns that use every length exactly as often as ``counts`` says."""
    counts = {k: n for k, n in counts.items() if n}
    if not counts:
        return []
    total = sum(k * n for k, n in counts.items())
    least = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    most = sum(n for _, n in best)
    left = dict(counts)
    path: list[Pattern] = []
    wasted = made = seen = 0
    branches: list[list[tuple[int, ...]]] = []

    def options() -> list[tuple[int, ...]]:
        lengths = sorted(k for k, n in left.items() if n)
        top = lengths[-1]
        left[top] -= 1
        inner = [k for k in lengths if left[k]]
        allowed = (most - 1) * capacity - total - wasted
        got = [(top, *f) for f in fillings(capacity - top, left, inner, allowed, width)] if allowed >= 0 else []
        left[top] += 1
        return got[::-1]

    while most > least and seen < nodes:
        if not any(left.values()):
            if made < most:
                best, most = list(path), made
            branches.append([])
        elif len(branches) == len(path):
            branches.append(options())
        while branches and not branches[-1]:  # back to the last choice that has another option
            branches.pop()
            if path:
                pattern, times = path.pop()
                for k in pattern:
                    left[k] += times
                made -= times
                wasted -= times * (capacity - sum(pattern))
        if not branches:
            break
        seen += 1
        pattern = branches[-1].pop()
        need = Counter(pattern)
        times = min(left[k] // n for k, n in need.items())
        spare = capacity - sum(pattern)
        if spare:  # no more of a wasteful choice than the waste still allowed
            times = max(1, min(times, ((most - 1) * capacity - total - wasted) // spare))
        for k in pattern:
            left[k] -= times
        path.append((pattern, times))
        made += times
        wasted += times * spare
    return best
