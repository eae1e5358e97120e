"""Vectorised hashes of words and byte windows over a buffer of several texts.

A byte's term is a random value times a power of an odd base modulo 2**64; differences of prefix sums, multiplied by the
inverse power, are hashes of spans that don't depend on where these stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_rng = np.random.default_rng(20240229)
VALUE = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
CHAIN = np.uint64(0xD6E8FEB86659FD93)

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grown(known: np.ndarray, base: int, n: int) -> np.ndarray:
    while len(known) < n:
        known = np.concatenate([known, known * np.uint64(pow(base, len(known), 1 << 64))])
    return known


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    _powers, _inverses = _grown(_powers, BASE, n), _grown(_inverses, INVERSE, n)
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Of bytes, or of hashes."""
    sums = np.zeros(len(values) + 1, np.uint64)
    terms = VALUE[values] if values.dtype == np.uint8 else values
    np.cumsum(terms * powers(len(values) + 1)[0][: len(values)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def window_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """Of all windows of `width` bytes."""
    n = len(sums) - width
    return mix((sums[width:] - sums[:-width]) * powers(len(sums))[1][:n]) if n > 0 else np.empty(0, np.uint64)


def chunks(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together; one text is never cut."""
    start = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, k
            start, size = k, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


class Words:
    """Words of several texts: byte spans, hashes and the range of words of each text.

    `table` maps separating bytes to a space, and others to what counts for equality.
    """

    def __init__(self, texts: list[bytes], table: bytes):
        joined = b" ".join(texts).translate(table) + b" "
        self.buffer = np.frombuffer(joined, np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        inside = np.empty(len(self.buffer) + 1, bool)
        inside[0] = False
        np.not_equal(self.buffer, 0x20, out=inside[1:])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[0::2], edges[1::2]
        self.hash = span_hashes(prefix_sums(self.buffer), self.start, self.end)
        self.first = np.searchsorted(self.start, self.offsets[:-1])  # of each text
        self.last = np.append(self.first[1:], len(self.start))
        self.count = self.last - self.first
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def windows(self, width: int, whole_if_short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """First words of windows of `width` words of one text, and the windows' hashes. A shorter text, if asked for, is
        one window."""
        n = len(self.hash)
        at = np.arange(n)
        left = self.last[self.doc] - at
        keep = left >= width
        if whole_if_short:
            keep |= (at == self.first[self.doc]) & (left < width)
        padded = np.concatenate([self.hash, np.zeros(width, np.uint64)])
        total = np.zeros(n, np.uint64)
        for j in range(width):
            own = padded[j : j + n]
            total = total * CHAIN + (np.where(left > j, own, np.uint64(0)) if whole_if_short else own)
        first = at[keep]
        return first, mix(total[keep])


#: Places are kept in the low bits of a key while its minimum is sought; texts hashed together stay below 2**28 places.
PLACE = np.uint64((1 << 28) - 1)


def sliding_least(grams: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least gram among each `width` consecutive ones."""
    if len(grams) > int(PLACE):
        raise ValueError("a text is too long to be hashed at once")
    key, size = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64), 1
    while 2 * size <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < width:
        key = np.minimum(key[: size - width], key[width - size :])
    return (key & PLACE).astype(np.int64)


def anchored_runs(grams: np.ndarray, width: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, number and anchor of runs of consecutive window starts that have one anchor.

    A window's anchor is the least of the `width` grams in it, so equal windows have equal anchors at equal places.
    """
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    place = sliding_least(grams, width)[starts]
    new = np.flatnonzero(np.concatenate([[True], (starts[1:] != starts[:-1] + 1) | (place[1:] != place[:-1])]))
    return starts[new], np.diff(np.append(new, len(starts))), grams[place[new]]
