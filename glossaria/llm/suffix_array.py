"""Suffix arrays of a shard by induced sorting, and its permuted common prefixes, with numpy.

Induction goes bucket by bucket: what a bucket induces is put in place at once, and a bucket that induces into itself (a
run of one letter) takes a round for each letter of its longest run.
"""

from __future__ import annotations

import numpy as np

#: A reduced string of more names than this is sorted by doubling ranks instead of one more level of induction.
MOST_BUCKETS = 2048


def _types(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next; the last, a unique least letter, is."""
    n = len(text)
    less, equal = text[:-1] < text[1:], text[:-1] == text[1:]
    at = np.where(equal, n, np.arange(n - 1))
    decided = np.minimum.accumulate(at[::-1])[::-1]  # the next place at which neighbours differ
    small = np.ones(n, bool)
    small[:-1] = less[np.minimum(decided, n - 2)]
    return small


def _put(suffixes: np.ndarray, text: np.ndarray, out: np.ndarray, head: np.ndarray, step: int) -> None:
    """Append suffixes to their letters' buckets, in order, upwards or downwards."""
    if not len(suffixes):
        return
    letters = text[suffixes]
    order = np.argsort(letters, kind="stable")
    letters, suffixes = letters[order], suffixes[order]
    first = np.flatnonzero(np.concatenate([[True], letters[1:] != letters[:-1]]))
    counts = np.diff(np.append(first, len(letters)))
    rank = np.arange(len(letters)) - np.repeat(first, counts)
    out[head[letters] + step * rank] = suffixes
    head[letters[first]] += step * counts


def _induce(text: np.ndarray, seeds: np.ndarray, small: np.ndarray, letters: int) -> np.ndarray:
    """All suffixes in order, from leftmost-smaller suffixes in order (`seeds`)."""
    n = len(text)
    sizes = np.bincount(text, minlength=letters)
    start = np.concatenate([[0], np.cumsum(sizes)])
    seeds = seeds.astype(np.int32)
    large = np.bincount(text[~small], minlength=letters)
    out = np.zeros(n, np.int32)
    seed_count = np.bincount(text[seeds], minlength=letters)
    seed_start = np.concatenate([[0], np.cumsum(seed_count)])
    by_letter = seeds[np.argsort(text[seeds], kind="stable")]
    used = np.flatnonzero(sizes)

    head = start[:-1].copy()
    for c in used:
        a, b = start[c], head[c]
        while b > a:  # what the bucket holds, then what that induces into the same bucket
            before = out[a:b] - 1
            before = before[before >= 0]
            again = before[text[before] == c]
            out[b : b + len(again)] = again
            a, b = b, b + len(again)
        head[c] = b
        scanned = np.concatenate([out[start[c] : b], by_letter[seed_start[c] : seed_start[c + 1]]]) - 1
        scanned = scanned[scanned >= 0]
        _put(scanned[text[scanned] > c], text, out, head, 1)

    tail = start[1:] - 1
    out[0] = n - 1  # the least letter's own suffix
    tail[text[n - 1]] -= 1
    for c in used[::-1]:
        b, a = start[c + 1] - 1, tail[c]
        if c == text[n - 1]:
            b = a
        while b > a:
            before = out[a + 1 : b + 1][::-1] - 1
            before = before[before >= 0]
            again = before[text[before] == c]
            out[a - len(again) + 1 : a + 1] = again[::-1]
            b, a = a, a - len(again)
        tail[c] = a
        scanned = out[start[c] : start[c + 1]][::-1]
        scanned = scanned[: (start[c + 1] - 1 - a) + large[c]] - 1
        scanned = scanned[scanned >= 0]
        _put(scanned[text[scanned] < c], text, out, tail, -1)
    return out


def _names(text: np.ndarray, in_order: np.ndarray, next_: np.ndarray) -> np.ndarray:
    """Names, from 0, of sorted substrings that end at the next leftmost-smaller place."""
    a, b = in_order[:-1], in_order[1:]
    size = next_[a] - a + 1
    same = size == next_[b] - b + 1
    pairs = np.flatnonzero(same)
    if len(pairs):
        length = size[pairs]
        ends = np.cumsum(length)
        inner = np.arange(ends[-1]) - np.repeat(ends - length, length)
        equal = text[np.repeat(a[pairs], length) + inner] == text[np.repeat(b[pairs], length) + inner]
        same[pairs] = np.logical_and.reduceat(equal, ends - length)
    return np.concatenate([[0], np.cumsum(~same)])


def _by_doubling(rank: np.ndarray) -> np.ndarray:
    n, width = len(rank), 1
    rank = rank.astype(np.int64)
    while True:
        second = np.zeros(n, np.int64)
        second[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key)
        ordered = key[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        width *= 2
        if new[-1] == n - 1 or width >= n:
            return order


def suffix_array(text: np.ndarray, letters: int) -> np.ndarray:
    """Of a text of letters 1 to `letters` - 1 that ends in a single 0."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    small = _types(text)
    least = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(least) > 1:
        is_least = np.zeros(n, bool)
        is_least[least] = True
        rough = _induce(text, least, small, letters)
        in_order = rough[is_least[rough]]
        next_ = np.full(n, n - 1)
        next_[least[:-1]] = least[1:]
        names = _names(text, in_order, next_)
        if names[-1] == len(least) - 1:
            least = in_order
        else:
            name_at = np.empty(n, np.int64)
            name_at[in_order] = names
            reduced = name_at[least]
            most = int(names[-1]) + 1
            order = suffix_array(reduced, most) if most <= MOST_BUCKETS else _by_doubling(reduced)
            least = least[order]
    return _induce(text, least, small, letters)


#: The first places of so many are compared from their first letter; the others begin where these let them.
CARRY = 4


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """By place in the text: letters shared with the suffix before it in order, up to `most`.

    A place shares at least one letter less than the place before it, so only every `CARRY`-th place is compared from
    zero on; what it shares is carried on to the places after it.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    packed = np.concatenate([text.astype(np.uint64), np.zeros(most + 16, np.uint64)])  # four letters of 16 bits
    for width in (1, 2):
        packed[:-width] |= packed[width:] << np.uint64(16 * width)
    shared = np.zeros(n, np.int64)

    def extend(places: np.ndarray, at: np.ndarray) -> None:
        some = before[places] >= 0
        places, at = places[some], at[some]
        while len(places):
            differ = packed[places + at] ^ packed[before[places] + at]
            unlike = differ != 0
            lowest = differ[unlike]
            lowest &= ~lowest + np.uint64(1)
            shared[places[unlike]] = at[unlike] + (np.log2(lowest.astype(np.float64)).astype(np.int64) >> 4)
            places, at = places[~unlike], at[~unlike] + 4
            shared[places[at >= most]] = most
            places, at = places[at < most], at[at < most]

    first = np.arange(0, n, CARRY)
    extend(first, np.zeros(len(first), np.int64))
    for k in range(1, CARRY):
        later = first[first + k < n] + k
        extend(later, np.maximum(np.minimum(shared[later - k], most) - k, 0))
    return np.minimum(shared, most)
