"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy."""

from __future__ import annotations

import numpy as np

#: From so many symbols an entry on, whole buckets are too small to be worth an array operation each
_WAVE = 48


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Places of the suffixes of ``text`` (numbers below ``symbols``) in order; the end counts as the smallest symbol.

    Suffixes are classified as smaller (S) or larger (L) than their right neighbour. The leftmost S ones of each run
    (LMS) are sorted first: their substrings by one induction, and, where some are equal, by the suffix array of the
    text of their names. Those induce all L suffixes from the left and all S suffixes from the right.
    """
    n = len(text)
    if n < 2:
        return np.arange(n)
    large = _larger(text)
    lms = np.flatnonzero(~large[1:] & large[:-1]) + 1
    if len(lms) < 2:
        return _induce(text, lms, large, symbols)
    names = _induced_names(text, lms, large, symbols) if n > _WAVE * symbols else _packed_names(text, lms, large, symbols)
    most = int(names.max()) + 1
    order = suffix_array(names, most) if most < len(lms) else np.argsort(names)
    return _induce(text, lms[order], large, symbols)


def _larger(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is larger than the one after it."""
    n = len(text)
    step = np.ones(n, np.int8)  # the last symbol is larger than the end
    step[:-1] = np.sign(text[:-1].astype(np.int64) - text[1:])
    # equal neighbours take the answer of the next place that differs
    places = np.where(step != 0, np.arange(n), n)
    following = np.minimum.accumulate(places[::-1])[::-1]
    return step[following] > 0


def _induced_names(text: np.ndarray, lms: np.ndarray, large: np.ndarray, symbols: int) -> np.ndarray:
    """Numbers of the LMS substrings in their order, equal for equal ones, sorted by one induction."""
    mark = np.zeros(len(text), bool)
    mark[lms] = True
    order = _induce(text, lms[np.argsort(text[lms], kind="stable")], large, symbols)
    order = order[mark[order]]
    size = _sizes(lms, len(text))
    a, b = order[:-1], order[1:]
    same = (size[a] == size[b]) & (size[a] > 0)
    depth, left = 0, np.flatnonzero(same)
    while len(left):
        differ = text[a[left] + depth] != text[b[left] + depth]
        same[left[differ]] = False
        depth += 1
        left = left[~differ & (size[a[left]] > depth)]
    of = np.zeros(len(text), np.int64)
    of[order] = np.concatenate([[0], np.cumsum(~same)])
    return of[lms]


def _sizes(lms: np.ndarray, n: int) -> np.ndarray:
    """Lengths of the LMS substrings by place: to the next LMS place, itself included; 0 for the last, which has the end."""
    size = np.zeros(n, np.int64)
    size[lms[:-1]] = np.diff(lms) + 1
    return size


def _packed_names(text: np.ndarray, lms: np.ndarray, large: np.ndarray, symbols: int) -> np.ndarray:
    """The same for many symbols: substrings are short then, and as many symbols as fit a number are sorted at once.

    A small suffix follows a large one with the same symbol, so a substring never ends where an equal one goes on.
    """
    n = len(text)
    typed = np.append(2 * text.astype(np.int64) + ~large + 1, 0)  # 0: the end
    bits = int(2 * symbols + 1).bit_length()
    step = max(1, 62 // bits)
    stop = np.append(lms[1:] + 1, n + 1)
    names = np.zeros(len(lms), np.int64)
    left, depth = np.arange(len(lms)), 0
    while len(left):
        key = np.zeros(len(left), np.int64)
        for i in range(step):
            at = lms[left] + depth + i
            key = (key << bits) + np.where(at < stop[left], typed[np.minimum(at, n)], 0)
        order = np.lexsort((key, names[left]))
        name, key = names[left][order], key[order]
        first = np.ones(len(order), bool)  # of its earlier name
        first[1:] = name[1:] != name[:-1]
        new = first.copy()
        new[1:] |= key[1:] != key[:-1]
        # names are places in the order, so those refined later fit between their neighbours
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        base = np.flatnonzero(first)[np.cumsum(first) - 1]
        names[left[order]] = name + start[group] - base
        depth += step
        tied = np.diff(np.append(start, len(order)))[group] > 1
        rest = left[order[tied]]
        left = rest[lms[rest] + depth < stop[rest]]
    return np.unique(names, return_inverse=True)[1]


def _induce(text: np.ndarray, lms: np.ndarray, large: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes in order from the LMS ones in order."""
    if len(text) > _WAVE * symbols:
        return _induce_by_bucket(text, lms, large, symbols)
    return _induce_by_entry(text, lms, large, symbols)


def _induce_by_bucket(text: np.ndarray, lms: np.ndarray, large: np.ndarray, symbols: int) -> np.ndarray:
    """For few symbols: a bucket's entries that are known induce their left neighbours in one array operation."""
    n = len(text)
    sizes = np.bincount(text, minlength=symbols)
    ends = np.cumsum(sizes)
    heads = ends - sizes
    middle = heads + np.bincount(text[large], minlength=symbols)
    sa = np.zeros(n, np.int32 if n < 1 << 31 else np.int64)
    free = heads.copy()
    # the left neighbour's kind, found at the entry itself; the whole text has none
    left_large = np.append(False, large)
    left_small = np.append(False, ~large)
    left_key = np.append(text[:1], text)

    def place(entries, wanted, step):
        right = entries[(left_large if wanted else left_small)[entries]]
        if not len(right):
            return
        key = left_key[right]
        order = np.argsort(key, kind="stable")
        key = key[order]
        count = np.bincount(key, minlength=symbols)
        base = free - (np.cumsum(count) - count) if step > 0 else free - 1 + (np.cumsum(count) - count)
        sa[base[key] + step * np.arange(len(key))] = right[order] - 1
        free[:] += step * count

    cut = np.concatenate([[0], np.cumsum(np.bincount(text[lms], minlength=symbols))])
    place(np.array([n], sa.dtype), True, 1)
    for c in np.flatnonzero(sizes):
        read = heads[c]
        while read < free[c]:
            block, read = sa[read : free[c]], free[c]
            place(block, True, 1)
        place(lms[cut[c] : cut[c + 1]], True, 1)
    free = ends.copy()
    for c in np.flatnonzero(sizes)[::-1]:
        read = ends[c]
        while read > free[c]:
            block, read = sa[free[c] : read][::-1], free[c]
            place(block, False, -1)
        place(sa[heads[c] : middle[c]][::-1], False, -1)
    return sa


def _induce_by_entry(text: np.ndarray, lms: np.ndarray, large: np.ndarray, symbols: int) -> np.ndarray:
    """For many symbols: one entry after the other."""
    sizes = np.bincount(text, minlength=symbols)
    ends = np.cumsum(sizes)
    heads = (ends - sizes).tolist()
    ends = ends.tolist()
    n, text = len(text), text.astype(np.int64)
    # the left neighbour's symbol, or -1 where it is not of the wanted kind
    left_large = np.append(-1, np.where(large, text, -1)).tolist()
    left_small = np.append(-1, np.where(large, -1, text)).tolist()
    sa = [0] * (n + 1)  # 0: nothing yet, or the whole text, which has no left neighbour either way
    free = ends.copy()
    for p, c in zip(lms[::-1].tolist(), text[lms[::-1]].tolist()):
        free[c] -= 1
        sa[free[c]] = p
    c = left_large[n]
    sa[heads[c]] = n - 1
    heads[c] += 1
    for p in sa:  # grows under way: entries to the right are filled before they are reached
        c = left_large[p]
        if c >= 0:
            sa[heads[c]] = p - 1
            heads[c] += 1
    for i in range(n - 1, -1, -1):
        p = sa[i]
        c = left_small[p]
        if c >= 0:
            ends[c] -= 1
            sa[ends[c]] = p - 1
    return np.array(sa[:n], np.int64)


def permuted_prefixes(text: np.ndarray, sa: np.ndarray, most: int, fresh: np.ndarray) -> np.ndarray:
    """For each place of the bytes ``text``: what its suffix has in common with the one before it in ``sa``.

    Where the symbols to the left of both are equal, the value is one less than its left neighbour's; only the others
    are compared, eight bytes at a time, up to ``most``. At the ``fresh`` places it is always compared, so a value is right
    up to ``most`` less the distance from the last of them.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    compared = np.ones(n, bool)
    compared[1:] = (before[1:] < 1) | (text[:-1] != text[before[1:] - 1])
    compared[fresh] = True
    padded = np.concatenate([text, np.zeros(most + 16, np.uint8)])
    words = np.zeros(n + most + 8, np.uint64)
    for i in range(8):
        words |= padded[i : i + len(words)].astype(np.uint64) << np.uint64(8 * i)
    value = np.zeros(n, np.int64)
    left = np.flatnonzero(compared & (before >= 0))
    depth = 0
    while len(left) and depth < most:
        differ = words[left + depth] ^ words[before[left] + depth]
        ends = differ != 0
        low = differ[ends] & (~differ[ends] + np.uint64(1))
        value[left[ends]] = depth + np.log2(low.astype(np.float64)).astype(np.int64) // 8
        left = left[~ends]
        depth += 8
    value[left] = depth
    value = np.minimum(value, n - np.maximum(np.arange(n), before))
    last = np.maximum.accumulate(np.where(compared, np.arange(n), 0))
    return np.maximum(value[last] - (np.arange(n) - last), 0)
