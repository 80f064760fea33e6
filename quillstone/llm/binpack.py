"""Bin completion for one-dimensional packing, on counts per length.

The packer sees how many items there are of each length, never the items, so its work
and memory depend on the capacity alone. It answers with patterns (lengths that share a
bin) and how often each is used.

Best-fit decreasing gives the first incumbent. If that doesn't reach the lower bound, a
branch and bound takes the largest length left and goes through all fillings of the room
beside it, least waste first: sets of lengths that waste no more than a better packing may,
to which nothing can be added, and which no filling before dominates (whose items could be
put into its items as into bins). A filling is used as often as the counts allow, or half
as often, a quarter, .. or once; with once among them the search is complete. Branches end
where bins so far and the lower bound of the rest reach the incumbent, and where the same
rest was met with as few bins. `nodes` bounds the number of branches tried: a search that ends
before has proven the best packing, and `Packing.proven` says so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

Pattern = tuple[int, ...]


class Packing(NamedTuple):
    """Patterns and how often each is used; the number of bins, a lower bound of it, and whether fewer bins are known to be impossible."""

    patterns: list[tuple[Pattern, int]]
    bins: int
    bound: int
    proven: bool


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The larger of the volume bound and the bound that pairs large items with what fits beside them."""
    number, volume = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * np.arange(capacity + 1))])
    half = capacity // 2
    k = np.arange(half + 1)  # items above capacity - k stand alone, those under k don't count
    alone = number[-1] - number[capacity - k + 1]
    large = number[capacity - k + 1] - number[half + 1]
    room = large * capacity - (volume[capacity - k + 1] - volume[half + 1])
    rest = volume[half + 1] - volume[k]
    beside = alone + large + np.maximum(0, -(-(rest - room) // capacity))
    return max(-(-int(volume[-1]) // capacity), int(beside.max()))


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over counts; equal bins are handled together."""
    open_bins: list[list[tuple[Pattern, int]]] = [[] for _ in range(capacity + 1)]
    residuals = np.zeros(capacity + 1, dtype=bool)

    def put(pattern: Pattern, n: int, room: int) -> None:
        open_bins[room].append((pattern, n))
        residuals[room] = True

    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            fits = np.flatnonzero(residuals[length:])
            room = length + int(fits[0]) if len(fits) else capacity
            pattern, n = open_bins[room].pop() if len(fits) else ((), left)
            if len(fits) and not open_bins[room]:
                residuals[room] = False
            each = room // length
            full = min(n, left // each)
            if full:
                put(pattern + (length,) * each, full, room - each * length)
                left -= full * each
                n -= full
            if n and left and left < each:
                put(pattern + (length,) * left, 1, room - left * length)
                left, n = 0, n - 1
            if n and pattern:
                put(pattern, n, room)
    return [x for room in open_bins for x in room]


def _fits_into(small: Pattern, large: Pattern) -> bool:
    """Whether the items of `small` can be dealt into slots as long as the items of `large`."""
    if not small:
        return True
    first, rest = small[0], small[1:]
    seen = set()
    for i, slot in enumerate(large):
        if slot >= first and slot not in seen:
            seen.add(slot)
            if _fits_into(rest, tuple(sorted((*large[:i], slot - first, *large[i + 1 :]), reverse=True))):
                return True
    return False


def _reach(lengths: list[int], copies: list[int], room: int) -> list[int]:
    """For each number of lengths, shortest first, the sums that they make up to `room`, as bits."""
    mask, now, out = (1 << (room + 1)) - 1, 1, [1]
    for length, n in zip(lengths, copies, strict=True):
        n, step = min(n, room // length), 1
        while n:  # copies by doubling
            step = min(step, n)
            now |= (now << (step * length)) & mask
            n -= step
            step *= 2
        out.append(now)
    return out


def _sums(lengths: list[int], copies: list[int], reach: list[int], upto: int, target: int) -> Iterator[Pattern]:
    """All sets of the first `upto` lengths that add up to `target`, long ones first."""
    # (what is still to be made, lengths that may be used, what is taken)
    stack: list[tuple[int, int, Pattern]] = [(target, upto, ())]
    while stack:
        left, i, taken = stack.pop()
        if not left:
            yield taken
            continue
        if not i or not reach[i] >> left & 1:
            continue
        length = lengths[i - 1]
        # the last pushed comes first: many copies before few
        stack.extend((left - n * length, i - 1, taken + (length,) * n) for n in range(min(copies[i - 1], left // length) + 1))


def fillings(counts: np.ndarray, room: int, slack: int) -> Iterator[Pattern]:
    """Undominated fillings of a room that waste at most `slack`, least waste first."""
    some = np.flatnonzero(counts[: room + 1]) if room > 0 else np.zeros(0, dtype=np.int64)
    if not len(some):
        if room <= slack:
            yield ()
        return
    lengths, copies = some.tolist(), counts[some].tolist()
    if lengths[-1] == room:
        yield (room,)  # one item that fits exactly dominates every other filling
        return
    reach = _reach(lengths, copies, room)
    kept: list[Pattern] = []
    for waste in range(min(slack, room) + 1):
        if not reach[-1] >> (room - waste) & 1:
            continue
        for p in _sums(lengths, copies, reach, len(lengths), room - waste):
            # another item would fit: a filling with less waste dominates
            if any(p.count(n) < c for n, c in zip(lengths, copies, strict=True) if n <= waste):
                continue
            if any(len(p) <= 6 and _fits_into(p, q) for q in kept[:64]):
                continue
            kept.append(p)
            yield p


def complete(counts: np.ndarray, capacity: int, best: int, bound: int, nodes: int) -> tuple[list[tuple[Pattern, int]] | None, bool]:
    """A packing with fewer than `best` bins, or None if none was found, and whether the search went to its end."""
    left, answer = counts.copy(), None
    total = int((counts * np.arange(capacity + 1)).sum())
    path: list[tuple[Pattern, int]] = []
    met: dict[bytes, int] = {}
    waste = bins = 0

    def choices() -> Iterator[tuple[Pattern, int]]:
        top = int(np.flatnonzero(left)[-1])
        left[top] -= 1
        rest = left.copy()
        left[top] += 1
        for f in fillings(rest, capacity - top, (best - 1) * capacity - total - waste):
            pattern = (top, *f)
            items, need = np.unique(np.array(pattern), return_counts=True)
            n = int((left[items] // need).min())
            while n:
                yield pattern, n
                n //= 2

    def change(pattern: Pattern, n: int) -> None:
        np.add.at(left, list(pattern), -n)

    levels = [choices()]
    while levels:
        choice = next(levels[-1], None)
        if choice is None:
            levels.pop()
            if path:
                pattern, n = path.pop()
                change(pattern, -n)
                waste, bins = waste - n * (capacity - sum(pattern)), bins - n
            continue
        if not nodes:
            return answer, False
        nodes -= 1
        pattern, n = choice
        change(pattern, n)
        waste, bins = waste + n * (capacity - sum(pattern)), bins + n
        path.append((pattern, n))
        if not left.any():
            if bins < best:
                answer, best = list(path), bins
                if best <= bound:
                    return answer, True
            levels.append(iter(()))
            continue
        key = hashlib.blake2b(left.tobytes(), digest_size=16).digest()
        if met.get(key, best) <= bins or bins + lower_bound(left, capacity) >= best:
            levels.append(iter(()))
            continue
        met[key] = bins
        levels.append(choices())
    return answer, True


def pack(counts: np.ndarray, capacity: int, nodes: int = 20_000) -> Packing:
    """Patterns and their multiplicities that use every item once.

    `counts[l]` items have length l, for l from 1 to `capacity`.
    """
    counts = np.asarray(counts, dtype=np.int64)
    if not counts.any():
        return Packing([], 0, 0, True)
    first = best_fit(counts, capacity)
    bins, bound = sum(n for _, n in first), lower_bound(counts, capacity)
    if bins <= bound:
        return Packing(first, bins, bound, True)
    better, ended = complete(counts, capacity, bins, bound, nodes)
    done = better or first
    return Packing(done, sum(n for _, n in done), bound, ended)
