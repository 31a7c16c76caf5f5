"""Suffix arrays in numpy: Larsson-Sadakane refinement and Kasai common prefixes."""

from __future__ import annotations

import numpy as np

#: Symbols that are compared at once; nine bits each.
FIRST = 7
#: Blocks of so many symbols that are compared at once, once two agree.
AT_ONCE = 8
#: Bits of a place where a key holds three ranks and its own place, and of a rank where a key holds three.
PLACE_BITS, RANK_BITS = 16, 21
U = np.uint64


def in_order(key: np.ndarray, at: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys, ascending, and their places, ascending for equal keys; in a small array the places ride in the keys, which sorts faster than an argsort."""
    if small:
        key = np.sort(key << U(PLACE_BITS) | at.view(U))
        return key >> U(PLACE_BITS), (key & U((1 << PLACE_BITS) - 1)).view(np.int64)
    order = np.argsort(key, kind="stable")
    return key[order], at[order]


def suffix_array(symbols: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
    """Suffix order of symbols from 0 to 510.

    The first sort is by a few symbols. Each round trebles the depth by sorting the
    members of groups that are still tied by the ranks of the suffixes ``depth`` and twice
    ``depth`` further on, which with their own rank fit into one key (in a very large
    array, two ranks do, and the depth doubles); groups of one are never touched again.
    ``ends`` are the places of symbols 0 that end a text, ascending. No two of them are
    equal, the earlier comes first; so copies are told apart where they end.
    """
    n = len(symbols)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    small = n < 1 << PLACE_BITS
    ahead, bits = (2, PLACE_BITS) if small else (2, RANK_BITS) if n < 1 << RANK_BITS else (1, 31)
    # numbered as they occur, which mostly needs a byte each; 0 is the end
    codes = np.cumsum(np.bincount(symbols) > 0)
    wide = int(codes[-1]).bit_length()
    depth = (64 - PLACE_BITS if small else 63) // wide
    padded = np.zeros(n + depth, U)
    padded[:n] = codes[symbols]
    key = padded[:n].copy()
    for i in range(1, depth):
        key <<= U(wide)
        key |= padded[i : n + i]
    ended = np.zeros(n, bool)
    if ends is not None:
        # what follows an end doesn't count
        before = np.arange(depth)
        at = ends[:, None] - before
        on = at >= 0
        np.bitwise_and.at(key, at[on], np.broadcast_to(~U(0) << (wide * (depth - 1 - before)).astype(U), at.shape)[on])
        ended[at[on]] = True
    key, sa = in_order(key, np.arange(n), small)
    new = np.ones(n + 1, bool)
    np.not_equal(key[1:], key[:-1], out=new[1:-1])
    new[:-1] |= ended[sa]
    heads = np.flatnonzero(new)
    # from 1 on; 0 is the end
    rank = np.empty(n, U)
    rank[sa] = np.repeat((heads[:-1] + 1).view(U), np.diff(heads))
    alone = new[:-1] & new[1:]
    tied = np.flatnonzero(~alone)  # places in sa
    open_ = np.ones(n, bool)  # and in the text
    open_[sa[alone]] = False
    while len(tied):
        # made for the whole text, in its order, which reads memory straight on
        key = rank << U(bits * ahead)
        for i in range(1, ahead + 1):
            if i * depth < n:
                key[: n - i * depth] |= rank[i * depth :] << U(bits * (ahead - i))
        at = np.flatnonzero(open_)
        key, at = in_order(key[at], at, small)
        sa[tied] = at
        new = np.ones(len(at) + 1, bool)
        np.not_equal(key[1:], key[:-1], out=new[1:-1])
        heads = np.flatnonzero(new)
        rank[at] = np.repeat((tied[heads[:-1]] + 1).view(U), np.diff(heads))
        alone = new[:-1] & new[1:]
        open_[at[alone]] = False
        tied = tied[~alone]
        depth *= 1 + ahead
    return sa.astype(np.int32)


def common_prefixes(symbols: np.ndarray, sa: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
    """Common prefix of each suffix (by its place in the text) with the one before it in order.

    Kasai: the prefix of the suffix one further on is shorter by one at most, and by just
    one where the symbols before the two suffixes agree. So symbols are compared only at
    the places where they don't, FIRST at a time; the others count down from there.
    ``ends`` are as in ``suffix_array``: none is equal to another, so no prefix goes past one.
    """
    n = len(symbols)
    out = np.zeros(n, np.int32)
    if n < 2:
        return out
    unlike = np.zeros(n + FIRST * AT_ONCE, np.int32)
    unlike[:n] = symbols
    stops = np.array([n])
    if ends is not None:
        unlike[ends] = -1 - ends
        stops = np.append(ends, n)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    fresh = np.ones(n, bool)
    fresh[1:] = (before[1:] < 1) | (unlike[: n - 1] != unlike[before[1:] - 1])
    # blocks of FIRST symbols; those that reach an end, or past the last, are like no other
    padded = np.zeros(n + FIRST, np.int64)
    padded[:n] = symbols.astype(np.int64) + 1
    block = -1 - np.arange(n + FIRST * AT_ONCE)
    inside = np.zeros(n, np.int64)
    for i in range(FIRST):
        inside <<= 9
        inside |= padded[i : n + i]
    block[:n] = inside
    near = (stops[:, None] - np.arange(FIRST)).ravel()
    near = near[near >= 0]
    block[near] = -1 - near
    at = np.flatnonzero(fresh & (before >= 0))
    x, y = at.copy(), before[at].astype(np.int64)
    lanes = np.arange(len(at))
    for _ in range(2):
        lanes = lanes[block[x[lanes]] == block[y[lanes]]]
        x[lanes] += FIRST
        y[lanes] += FIRST
    # the few that go on, AT_ONCE blocks at a time
    steps = np.arange(AT_ONCE) * FIRST
    while len(lanes):
        same = block[x[lanes, None] + steps] == block[y[lanes, None] + steps]
        whole = same.all(axis=1)
        more = np.where(whole, AT_ONCE, same.argmin(axis=1)) * FIRST
        x[lanes] += more
        y[lanes] += more
        lanes = lanes[whole]
    # where two blocks part, their highest unlike bits tell how many symbols still agree; blocks that reach an end are looked at one by one
    a, b = block[x], block[y]
    inner = (a >= 0) & (b >= 0)
    apart = a ^ b
    agree = sum((apart < 1 << 9 * i).astype(np.int64) for i in range(1, FIRST)) * inner
    x += agree
    y += agree
    lanes = np.flatnonzero(~inner)
    while len(lanes):
        here = lanes[np.maximum(x[lanes], y[lanes]) < n]
        lanes = here[unlike[x[here]] == unlike[y[here]]]
        x[lanes] += 1
        y[lanes] += 1
    out[at] = x - at
    place = np.arange(n, dtype=np.int32)
    last = np.maximum.accumulate(np.where(fresh, place, 0))
    return out[last] - (place - last)


def repeated_flags(texts: list[bytes], windows: list[int], *lengths: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each text starts in a buffer with a free place after each, and for each length a flag for each place of the buffer.

    The flag says whether the string of that length at a window start also is at another window start. A text has so
    many window starts at its begin as ``windows`` says (fewer if a string doesn't fit).
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    # symbol 0 ends each text, so no window of bytes matches across an end
    symbols = np.frombuffer(b"".join(x for t in texts for x in (t, b"\0")), np.uint8).astype(np.int16)
    symbols += 1
    ends = np.cumsum(sizes + 1) - 1
    symbols[ends] = 0
    starts = ends - sizes
    own = np.minimum(np.array(windows, np.int64), sizes)
    # bytes left at each window start
    at = np.repeat(starts - np.cumsum(own) + own, own) + np.arange(own.sum())
    left = np.zeros(len(symbols), np.int64)
    left[at] = np.repeat(ends, own) - at
    sa = suffix_array(symbols, ends)
    prefix = common_prefixes(symbols, sa, ends)[sa]
    counted = np.flatnonzero(left[sa] > 0)
    at = sa[counted]
    out = []
    for n in lengths:
        # suffixes with one prefix of that length
        group = np.cumsum(prefix < n)[counted]
        found = np.zeros(len(symbols), bool)
        found[at] = (np.bincount(group) > 1)[group] & (left[at] >= n) if len(group) else False
        out.append(found)
    return starts, out


def repeated_windows(texts: list[bytes], windows: list[int], *lengths: int) -> list[list[np.ndarray]]:
    """For each length, and each text, the flags of its window starts."""
    starts, found = repeated_flags(texts, windows, *lengths)
    return [[x[s : s + max(0, min(w, len(t) - n + 1))] for s, t, w in zip(starts.tolist(), texts, windows)] for n, x in zip(lengths, found)]
