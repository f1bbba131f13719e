"""Suffix arrays by induced sorting, and winnowed anchors, in numpy.

The classic algorithm scans one suffix at a time; here a bucket at a time is
induced with array operations, which gives the same order: within a bucket the
entries placed by smaller characters come first and in scan order, and those
that the bucket places into itself follow in rounds. Names of the reduced string
are written as two digits where there are many, so that buckets stay few.
"""

from __future__ import annotations

import numpy as np

from gavel.llm.hashing import _BASE, _BYTES, _INVERSE, _powers, mix

#: Reduced strings with more names than this are written in two digits a name, if that is still shorter by a quarter than the string above.
BUCKETS = 1_024
#: Strings up to this long, or with more characters than MANY, are induced one suffix at a time.
SHORT, MANY = 1 << 15, 1 << 12


def _classify(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the last suffix is larger (the end is smallest)."""
    n = len(t)
    s = np.zeros(n, bool)
    differ = np.flatnonzero(t[:-1] != t[1:])
    if len(differ):
        # a run of equal characters has the class of its last one
        s[: differ[-1] + 1] = np.repeat(t[differ] < t[differ + 1], np.diff(differ, prepend=-1))
    return s


def _place(sa: np.ndarray, t: np.ndarray, j: np.ndarray, at: np.ndarray, step: int) -> None:
    """Put suffixes j, in order, at the pointers of their characters' buckets, which move by step (1 or -1)."""
    n = len(j)
    if not n:
        return
    c = t[j]
    order = c.argsort(kind="stable")
    c = c[order]
    edge = np.ones(n + 1, bool)
    np.not_equal(c[1:], c[:-1], out=edge[1:n])
    cut = edge.nonzero()[0]
    first = cut[:-1]
    size, buckets = cut[1:] - first, c[first]
    free = at[buckets]
    sa[(free - step * first).repeat(size) + np.arange(0, step * n, step)] = j[order]
    at[buckets] = free + step * size


def _induce_small(t: np.ndarray, small: np.ndarray, seeds: np.ndarray, sigma: int) -> np.ndarray:
    """_induce as the plain scan over positions, which is faster for short strings with many buckets."""
    n = len(t)
    end = np.cumsum(np.bincount(t, minlength=sigma))
    head, tail = [0, *end[:-1].tolist()], end.tolist()
    t, small, sa = t.tolist(), small.tolist(), [-1] * n
    for j in reversed(seeds.tolist()):
        tail[t[j]] -= 1
        sa[tail[t[j]]] = j
    seeded = set(seeds.tolist())
    sa_at = head[t[-1]]
    head[t[-1]] += 1
    sa[sa_at] = n - 1
    for i in range(n):
        j = sa[i] - 1
        if j >= 0 and not small[j]:
            sa[head[t[j]]] = j
            head[t[j]] += 1
        if sa[i] in seeded:
            sa[i] = -1
    tail = end.tolist()
    for i in range(n - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and small[j]:
            tail[t[j]] -= 1
            sa[tail[t[j]]] = j
    return np.array(sa, seeds.dtype)


def _induce(t: np.ndarray, small: np.ndarray, seeds: np.ndarray, sigma: int) -> np.ndarray:
    """Order of all suffixes, given leftmost-smaller suffixes (or substrings) in order of their rank."""
    n = len(t)
    if n <= SHORT or sigma > MANY:
        return _induce_small(t, small, seeds, sigma)
    size = np.bincount(t, minlength=sigma)
    end = np.cumsum(size)
    begin = end - size
    cut = np.searchsorted(t[seeds[order := np.argsort(t[seeds], kind="stable")]], np.arange(sigma + 1))
    seeds = seeds[order]
    sa = np.empty(n, seeds.dtype)
    used = np.flatnonzero(size)
    large_before = np.zeros(n, bool)
    large_before[1:] = ~small[:-1]
    head = begin.copy()
    sa[head[t[n - 1]]] = n - 1  # induced by the end
    head[t[n - 1]] += 1
    for c in used.tolist():
        i = begin[c]
        while i < head[c]:
            j = sa[i : head[c]]
            i = head[c]
            _place(sa, t, j[large_before[j]] - 1, head, 1)
        j = seeds[cut[c] : cut[c + 1]]
        _place(sa, t, j[large_before[j]] - 1, head, 1)
    small_before = np.zeros(n, bool)
    small_before[1:] = small[:-1]
    tail = end - 1
    for c in used[::-1].tolist():  # everything runs from the right end
        i = end[c] - 1
        while i > tail[c]:
            j = sa[tail[c] + 1 : i + 1][::-1]
            i = tail[c]
            _place(sa, t, j[small_before[j]] - 1, tail, -1)
        j = sa[begin[c] : head[c]][::-1]
        _place(sa, t, j[small_before[j]] - 1, tail, -1)
    return sa


def _reduced_order(names: np.ndarray, count: int, above: int) -> np.ndarray:
    """Order of the suffixes of a reduced string with names below count; above: the length of the string it was made of."""
    if count <= BUCKETS or 8 * len(names) >= 3 * above:
        return suffix_array(names.astype(np.uint16 if count <= 1 << 16 else np.int64), count)
    base = int(np.ceil(np.sqrt(count)))
    digits = np.empty(2 * len(names), np.uint16 if base <= 1 << 16 else np.int64)
    digits[::2], digits[1::2] = names // base, names % base
    # digits of equal number keep the order, so suffixes that begin with a name's first digit have the order of names
    order = suffix_array(digits, base)
    return order[order % 2 == 0] // 2


def suffix_array(t: np.ndarray, sigma: int = 256) -> np.ndarray:
    """All suffixes in order: classify, sort the leftmost-smaller substrings, recurse on their names, induce."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    small = _classify(t)
    left = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    left = left.astype(np.int32 if n < 1 << 31 else np.int64)
    if not len(left):
        return _induce(t, small, left, sigma)
    sa = _induce(t, small, left, sigma)
    is_left = np.zeros(n, bool)
    is_left[left] = True
    order = sa[is_left[sa]]
    # names: equal substrings from one leftmost-smaller position to the next
    length = np.empty(n, left.dtype)
    length[left[:-1]] = np.diff(left) + 1
    length[left[-1]] = n - left[-1] + 1  # holds the end, so it equals no other
    of = length[order]
    same = np.zeros(len(order), bool)
    same[1:] = (of[1:] == of[:-1]) & (order[1:] != left[-1]) & (order[:-1] != left[-1])
    pair = np.flatnonzero(same)
    a, b, left_over, k = order[pair], order[pair - 1], of[pair], 0
    while len(pair):
        equal = t[a + k] == t[b + k]
        same[pair[~equal]] = False
        k += 1
        equal &= left_over > k
        pair, a, b, left_over = pair[equal], a[equal], b[equal], left_over[equal]
    name_of = np.cumsum(~same, dtype=left.dtype) - 1
    names = np.empty(n, left.dtype)
    names[order] = name_of
    reduced, count = names[left], int(name_of[-1]) + 1
    if count == len(left):
        rank = order
    else:
        del sa, is_left, order, length, of, same, pair, a, b, left_over, name_of, names  # deeper levels need the room
        rank = left[_reduced_order(reduced, count, n)]
    return _induce(t, small, rank, sigma)


def permuted_lcp(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each position the common prefix with the suffix before it in order, at least right up to `most`.

    Only irreducible values (where the bytes in front differ) are compared; the
    others are one less than the value at the position in front.
    """
    n = len(t)
    phi = np.empty(n, np.int32 if n < 1 << 31 else np.int64)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = -1
    pos = np.arange(n, dtype=phi.dtype)
    first = np.ones(n, bool)
    first[1:] = (phi[1:] < 1) | (t[:-1] != t[np.maximum(phi[1:], 1) - 1])
    first[1:] |= phi[:-1] != phi[1:] - 1
    starts = pos[first & (phi >= 0)]
    other = phi[starts]
    value = np.zeros(n, phi.dtype)
    # values carry over to following positions, so they are compared on, past `most`, eight bytes at a time
    wide = np.zeros(n + 16, np.uint8)
    wide[:n] = t
    words = np.ndarray((n + 8,), np.uint64, wide, strides=(1,))
    live, k = np.arange(len(starts)), 0
    length = np.zeros(len(starts), np.int64)
    at_first = np.flatnonzero(first)
    reach = np.append(at_first[1:], n)[np.searchsorted(at_first, starts)] - starts + most
    while len(live):
        a, b = starts[live] + k, other[live] + k
        ok = (np.maximum(a, b) < n) & (k < reach[live])
        live, a, b = live[ok], a[ok], b[ok]
        differ = words[a] ^ words[b]
        bits = differ & (~differ + np.uint64(1))  # the lowest set bit is in the first byte that differs
        equal = np.where(differ == 0, 8, np.log2(np.maximum(bits, 1).astype(np.float64)).astype(np.int64) >> 3)
        length[live] = np.minimum(k + equal, n - np.maximum(starts[live], other[live]))
        live = live[equal == 8]
        k += 8
    value[starts] = length
    base = np.maximum.accumulate(np.where(first, pos, 0))
    return np.maximum(value[base] - (pos - base), 0)


def anchors(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, gram: int, block: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of winnowed grams: each string of `window` bytes within a text has its least gram among them.

    starts, ends: the bytes in buf of the texts, none of them empty, which fill it. The leftmost of equal grams counts, so the choice depends on the string alone.
    """
    width = window - gram + 1
    power, inverse = _anchor_powers(block + window)
    out_at, out_h = [], []
    for lo in range(0, max(len(buf) - window + 1, 0), block):
        b = buf[lo : lo + block + window - 1]
        n = len(b) - gram + 1
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTES[b] * power[: len(b)], out=sums[1:])
        h = mix((sums[gram:] - sums[:-gram]) * inverse[:n])
        packed = (h & ~np.uint64(0xFFFFF)) | np.arange(n, dtype=np.uint64)
        low, size = packed, 1
        while size * 2 <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < width:
            low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
        first, hi = np.arange(lo, lo + len(low)), lo + len(low)
        i, k = np.searchsorted(ends, [lo, hi - 1], side="right")  # texts of the block's first and last position
        own_end = ends[i : k + 1]
        low = low[first + window <= own_end.repeat(np.minimum(own_end, hi) - np.maximum(starts[i : k + 1], lo))]
        at = (low & np.uint64(0xFFFFF)).astype(np.int64)
        at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
        out_at.append(at + lo)
        out_h.append(h[at])
    if not out_at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, h = np.concatenate(out_at), np.concatenate(out_h)
    new = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool)
    return at[new], h[new]


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _anchor_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _POWERS:
        _POWERS[n] = _powers(_BASE, n), _powers(_INVERSE, n)
    return _POWERS[n]
