"""Suffix arrays by induced sorting and permuted longest common prefixes, in numpy.

One call handles one shard (a few megabytes). Where induced sorting reads one suffix after another, ranges of whole buckets are read
at once here: a range may be as long as nothing that is read in it belongs into it. Reduced strings recurse, whatever their
alphabet; with many small buckets the ranges are long, with few large ones they are single buckets.
"""

from __future__ import annotations

import numpy as np


#: A range of several buckets has so many suffixes at most: what is read beyond where a range turns out to end is read again.
RANGE = 8192


def suffix_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it; the sentinel at the end (unique, smallest) is."""
    n = len(t)
    small = np.ones(n, dtype=bool)
    differs = np.where(t[:-1] == t[1:], n, np.arange(n - 1))
    decides = np.minimum.accumulate(differs[::-1])[::-1]
    small[:-1] = (t[:-1] < t[1:])[decides]
    return small


def induce(t: np.ndarray, small: np.ndarray, leftmost: np.ndarray, k: int) -> np.ndarray:
    """The suffix array that ``leftmost`` (leftmost-smaller positions, in the order known so far) induces."""
    n = len(t)
    counts = np.bincount(t, minlength=k)
    ends = np.cumsum(counts)
    starts = ends - counts
    sa = np.full(n, -1, dtype=np.int32)
    by_bucket = leftmost[np.argsort(t[leftmost], kind="stable")]
    per = np.bincount(t[leftmost], minlength=k)
    at = np.repeat(ends - per, per) + np.arange(len(leftmost)) - np.repeat(np.cumsum(per) - per, per)
    sa[at] = by_bucket
    change = np.append(True, t[1:] != t[:-1])
    run = np.arange(n) - np.maximum.accumulate(np.where(change, np.arange(n), 0))  # how many equal symbols stand right before each

    def before(block: np.ndarray, kind: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The predecessors of one type of what has been placed in a block, their buckets, and which places of the block they come from."""
        p = np.maximum(block, 1) - 1
        from_ = np.flatnonzero((block > 0) & (small[p] == kind))
        p = p[from_]
        return p, t[p], from_

    def place(p: np.ndarray, symbol: np.ndarray, edge: np.ndarray, up: bool) -> None:
        """Into their buckets, in order, from ``edge`` on (up or down)."""
        if not len(p):
            return
        order = np.argsort(symbol, kind="stable")
        p, symbol = p[order], symbol[order]
        new = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1]))
        size = np.diff(np.append(new, len(p)))
        rank = np.arange(len(p)) - np.repeat(new, size)
        sa[edge[symbol] + rank if up else edge[symbol] - 1 - rank] = p
        edge[symbol[new]] += size if up else -size

    def sweep(up: bool) -> None:
        """Larger suffixes from their successors in rising order, or smaller ones in falling order."""
        edge = starts.copy() if up else ends.copy()
        c, width = (0, 1) if up else (k, 1)
        while c < k if up else c > 0:
            if up:
                e = max(c + 1, min(c + width, int(np.searchsorted(starts, starts[c] + RANGE, "right")) - 1))
            else:
                e = min(c - 1, max(c - width, int(np.searchsorted(ends, ends[c - 1] - RANGE))))
            lo, hi = (c, e) if up else (e, c)
            block = sa[starts[lo] : ends[hi - 1]]
            p, symbol, from_ = before(block if up else block[::-1], not up)
            inside = symbol[symbol < e] if up else symbol[symbol >= e]
            if len(inside):  # what belongs into the range must be there before it is read
                cut = int(inside.min()) if up else int(inside.max()) + 1
                if cut == c:  # the first bucket feeds itself: what was placed in it, then all of it one symbol on, then two symbols on, ..
                    b = c if up else c - 1
                    seeds = sa[starts[b] : edge[b]] if up else sa[edge[b] : ends[b]][::-1]
                    times = run[seeds]
                    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + 1
                    fed = (np.repeat(seeds, times) - step)[np.argsort(step, kind="stable")]
                    place(fed, t[fed], edge, up)
                    p, symbol, _ = before(sa[starts[b] : ends[b]] if up else sa[starts[b] : ends[b]][::-1], not up)
                    other = symbol != b
                    place(p[other], symbol[other], edge, up)
                    c = b + 1 if up else b
                    continue
                width = max(1, abs(cut - c))
                read = np.searchsorted(from_, ends[cut - 1] - starts[c] if up else ends[c - 1] - starts[cut])
                p, symbol, e = p[:read], symbol[:read], cut
            else:
                width *= 2
            place(p, symbol, edge, up)
            c = e

    sweep(True)
    sa[at] = -1  # these are found again among the smaller suffixes
    sa[0] = n - 1
    sweep(False)
    return sa


def order_of_names(names: np.ndarray) -> np.ndarray:
    """The suffixes of a reduced string in order (its last name is unique and smallest), by recursion.

    A name that occurs once decides every comparison that reaches it. So the string that is sorted next has the names that occur
    again and, after each run of them, the one that ends it.
    """
    counts = np.bincount(names)
    again = counts[names] > 1
    keep = again.copy()
    keep[1:] |= again[:-1]
    keep[-1] = True
    at = np.flatnonzero(keep)
    present = np.zeros(len(counts), dtype=bool)
    present[names[at]] = True
    short = (np.cumsum(present) - 1)[names[at]]
    sub = at[suffix_array(short.astype(np.uint8 if short.max() < 256 else np.uint16 if short.max() < 65536 else np.uint32))]
    starts = np.cumsum(counts) - counts
    order = np.empty(len(names), dtype=np.int64)
    single = np.flatnonzero(~again)
    order[starts[names[single]]] = single
    sub = sub[again[sub]]  # by name already, and rightly within a name
    new = np.flatnonzero(np.append(True, names[sub[1:]] != names[sub[:-1]])[: len(sub)])
    rank = np.arange(len(sub)) - np.repeat(new, np.diff(np.append(new, len(sub))))
    order[starts[names[sub]] + rank] = sub
    return order


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Of symbols ``t`` (unsigned integers) whose last one is 0 and occurs nowhere else."""
    n, k = len(t), int(t.max()) + 1
    small = suffix_types(t)
    is_left = np.zeros(n, dtype=bool)
    is_left[1:] = small[1:] & ~small[:-1]
    leftmost = np.flatnonzero(is_left)
    if len(leftmost) > 1:
        rough = induce(t, small, leftmost, k)
        rough = rough[is_left[rough]]
        size = np.zeros(n, dtype=np.int64)
        size[leftmost] = np.append(np.diff(leftmost) + 1, 1)
        a, b = rough[:-1].astype(np.int64), rough[1:].astype(np.int64)
        same = size[a] == size[b]
        live, offset = np.flatnonzero(same), 0
        while len(live):
            equal = t[a[live] + offset] == t[b[live] + offset]
            same[live[~equal]] = False
            offset += 1
            live = live[equal]
            live = live[size[a[live]] > offset]
        named = np.append(0, np.cumsum(~same))
        if named[-1] + 1 < len(rough):
            names = np.empty(n, dtype=np.int64)
            names[rough] = named
            leftmost = leftmost[order_of_names(names[leftmost])]
        else:
            leftmost = rough.astype(np.int64)
    return induce(t, small, leftmost, k)


def _common(t: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes at ``a`` and ``b`` (never the same) share: eight at a time; the sentinel ends every comparison."""
    width = 8 // t.itemsize
    padded = np.append(t, np.zeros(2 * width, t.dtype))
    words = np.ndarray((len(t) + 1,), dtype="<u8", buffer=padded, strides=(t.itemsize,))
    found, live, offset = np.zeros(len(a), dtype=np.int64), np.arange(len(a)), 0
    while len(live):
        differ = words[a[live] + offset] ^ words[b[live] + offset]
        done = differ != 0
        x, low = differ[done], np.zeros(int(done.sum()), dtype=np.int64)
        for n in range(1, width):
            low += x & np.uint64((1 << 8 * t.itemsize * n) - 1) == 0
        found[live[done]] = offset + low
        live, offset = live[~done], offset + width
    return found


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position, how many symbols its suffix shares with the one before it in the suffix array.

    In text order a value is its left neighbour's less one unless the symbols before the two suffixes differ; only those
    (irreducible) values are found by comparing.
    """
    n = len(t)
    phi = np.full(n, -1, dtype=np.int64)
    phi[sa[1:]] = sa[:-1]
    fresh = np.ones(n, dtype=bool)
    inner = np.flatnonzero(phi[1:] > 0) + 1
    fresh[inner] = t[inner - 1] != t[phi[inner] - 1]
    shared = np.zeros(n, dtype=np.int64)
    at = np.flatnonzero(fresh & (phi >= 0))
    shared[at] = _common(t, at, phi[at])
    source = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    return np.maximum(shared[source] - (np.arange(n) - source), 0)
