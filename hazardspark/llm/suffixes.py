"""Suffix arrays by two-stage sorting, and adjacent common prefixes.

Used inside tasks on short collections of byte strings. A suffix is of type B if it is
smaller than its successor, else of type A. Only the B suffixes are sorted directly; the
A suffixes follow by one scan over the buckets of first symbols, since an A suffix comes
after its successor and in the order of it.

Every string ends in a separator of its own, smaller than all bytes and ordered by
position, so no comparison and no common prefix goes beyond a string.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_SYMBOLS = 6  # symbols of ten bits in one sort key


class Collection:
    """Byte strings one after the other, each followed by its separator."""

    def __init__(self, strings: Sequence[bytes]):
        lengths = np.array([len(s) for s in strings], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(strings) else lengths
        self.ends = self.starts + lengths  # places of the separators
        self.raw = np.frombuffer(b"\0".join([*strings, b""]), np.uint8)
        self.count = len(strings)
        self.symbols = self.raw.astype(np.int32) + self.count
        self.symbols[self.ends] = np.arange(self.count)


def smaller_than_next(symbols: np.ndarray) -> np.ndarray:
    """Type B flags. The last position, a separator, counts as B."""
    n = len(symbols)
    step = np.sign(np.diff(symbols))
    decided = np.append(np.where(step != 0, np.arange(n - 1), n), n - 1)
    decided = np.minimum.accumulate(decided[::-1])[::-1]
    return np.append(step, 1)[decided] > 0


def _refine(rank: np.ndarray, active: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Split the groups of ``active`` items by ``key``; returns the items still tied.

    The rank of an item is the number of items in earlier groups.
    """
    low = int(key.max()) + 1
    if low < (1 << 62) // len(rank):  # both fit one number, which sorts faster
        order = np.argsort(rank[active] * low + key)
    else:
        order = np.lexsort((key, rank[active]))
    items, old, key = active[order], rank[active][order], key[order]
    place = np.arange(len(items))
    new_group = np.append(True, old[1:] != old[:-1])
    new_part = new_group | np.append(True, key[1:] != key[:-1])
    group = np.maximum.accumulate(np.where(new_group, place, 0))
    part = np.maximum.accumulate(np.where(new_part, place, 0))
    rank[items] = old + part - group
    alone = new_part & np.append(new_part[1:], True)
    return items[~alone]


def _sorted_directly(c: Collection, is_b: np.ndarray) -> np.ndarray:
    """The B suffixes in order.

    The text from one B position to the next, with the types, is the first key: no such
    piece is the beginning of another, as both ends are B and all between is A. Ties are
    split by the ranks of 1, 2, 4, ... pieces further on.
    """
    places = np.flatnonzero(is_b)
    n = len(places)
    code = (c.raw.astype(np.int64) + 1) * 2 + is_b
    code[c.ends] = 1  # separators tie here and are told apart by their ranks
    code = np.append(code, np.zeros(_SYMBOLS, np.int64))
    last = np.append(places[1:], places[-1:])
    separator = c.symbols[places] < c.count
    rank = np.where(separator, c.symbols[places], c.count).astype(np.int64)
    tied = np.flatnonzero(~separator)
    depth = 0
    while len(tied):
        at = places[tied] + depth
        key = np.zeros(len(tied), np.int64)
        for k in range(_SYMBOLS):
            inside = at + k <= last[tied]
            key = (key << 10) | np.where(inside, code[np.minimum(at + k, len(code) - 1)], 0)
        tied = _refine(rank, tied, key)
        depth += _SYMBOLS
        tied, done = tied[places[tied] + depth <= last[tied]], tied[places[tied] + depth > last[tied]]
        if depth == _SYMBOLS:
            later = [done]
        else:
            later.append(done)
    tied = np.concatenate(later) if n > c.count else tied
    ahead = 1
    while len(tied):
        tied = _refine(rank, tied, rank[np.minimum(tied + ahead, n - 1)].copy())
        ahead *= 2
    out = np.empty(n, np.int64)
    out[rank] = places
    return out


def suffix_array(c: Collection) -> np.ndarray:
    """Start positions of all suffixes in order, separators first."""
    if not c.count:
        return np.zeros(0, np.int64)
    t = c.symbols
    is_b = smaller_than_next(t)
    direct = _sorted_directly(c, is_b)
    bounds = np.searchsorted(t[direct], np.arange(c.count, c.count + 257))
    incoming: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(done: np.ndarray) -> None:
        """Hand the larger predecessors of sorted suffixes to the buckets they belong to."""
        before = done[done > 0] - 1
        before = before[t[before] > t[before + 1]]
        symbol = c.raw[before]
        order = np.argsort(symbol, kind="stable")
        before, symbol = before[order], symbol[order]
        cuts = np.flatnonzero(np.diff(symbol)) + 1
        for part in np.split(before, cuts) if len(before) else []:
            incoming[c.raw[part[0]]].append(part)

    out = [direct[: bounds[0]]]
    induce(out[0])
    for value in range(256):
        parts = incoming[value]
        wave = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        smaller = [wave]
        while len(wave):  # an A suffix before one of the same bucket follows it in the order
            wave = wave[wave > 0] - 1
            wave = wave[t[wave] == value + c.count]
            smaller.append(wave)
        bucket = np.concatenate([*smaller, direct[bounds[value] : bounds[value + 1]]])
        if len(bucket):
            induce(bucket)
            out.append(bucket)
    return np.concatenate(out)


def common_prefixes(c: Collection, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per position the suffix before it in the order (-1: none) and their common prefix.

    Where the symbols in front of both agree, the prefix is that of the position before,
    less one; only the other positions are compared symbol by symbol, eight at a time.
    """
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    fresh = (place == 0) | (before <= 0)
    inner = ~fresh
    fresh[inner] = c.symbols[place[inner] - 1] != c.symbols[before[inner] - 1]
    words = np.ndarray(n, "<u8", np.append(c.raw, np.zeros(8, np.uint8)), strides=(1,))
    limit = c.ends[np.searchsorted(c.ends, place)] - place
    length = np.zeros(n, np.int64)
    live = place[fresh & (before >= 0)]
    depth = 0
    while len(live):
        other = before[live]
        room = np.minimum(limit[live], limit[other])
        live, other, room = live[room > depth], other[room > depth], room[room > depth]
        differ = words[live + depth] ^ words[other + depth]
        # The lowest bit in which they differ tells how many bytes agree.
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.log2(np.maximum(low, 1).astype(float)).astype(np.int64) >> 3)
        length[live] = np.minimum(depth + same, room)
        live = live[differ == 0]
        depth += 8
    source = np.maximum.accumulate(np.where(fresh, place, 0))
    return before, np.maximum(length[source] - (place - source), 0)


def repeated_starts(c: Collection, length: int) -> np.ndarray:
    """Flags of the positions whose ``length`` bytes start at another position too."""
    order = suffix_array(c)
    hit = np.zeros(len(order), bool)
    if len(order):
        before, prefix = common_prefixes(c, order)
        found = np.flatnonzero(prefix >= length)
        hit[found] = True
        hit[before[found]] = True
    return hit
