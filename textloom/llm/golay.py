"""The binary Golay code of length 23 as a fuzzy hash: words within distance 2 share a codeword index.

The code is perfect: every 23-bit word lies within distance 3 of exactly one codeword. A
word at distance 3 also lies at distance 4 from five others; a word nearer than that has
none at distance 4. Those one or six indices are the word's keys. If x and y differ in at
most one bit and c is x's codeword, y is within distance 4 of c, so c is among y's keys.
"""

from __future__ import annotations

import functools

import numpy as np

#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, the low bit being x^0.
GENERATOR = 0b110001110101


@functools.cache
def _remainders() -> np.ndarray:
    """Remainder modulo the generator of each value of a word's upper 12 bits."""
    r = np.arange(1 << 12, dtype=np.uint32) << np.uint32(11)
    for bit in range(22, 10, -1):
        r = np.where(r >> bit & 1, r ^ np.uint32(GENERATOR << (bit - 11)), r)
    return r


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator: a word's lower 11 bits are their own."""
    words = words.astype(np.uint32)
    return _remainders()[words >> np.uint32(11)] ^ (words & np.uint32(0x7FF))


@functools.cache
def key_errors() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2,048 syndromes: up to six error patterns that lead to key codewords, and how many."""
    single = np.uint32(1) << np.arange(23, dtype=np.uint32)
    patterns = {0: [np.zeros(1, np.uint32)]}
    for weight in range(1, 5):
        out = [p for p in _combinations(weight)]
        patterns[weight] = [np.array(out, np.uint32)]
    errors = np.zeros((2048, 6), np.uint32)
    count = np.zeros(2048, np.int64)
    weights = np.zeros(2048, np.int64)
    for weight in range(4):
        e = patterns[weight][0]
        s = _syndromes(e)
        errors[s, 0], count[s], weights[s] = e, 1, weight
    e = patterns[4][0]
    s = _syndromes(e)
    far = weights[s] == 3  # weight 4 patterns share a syndrome with a pattern of weight 3
    assert far.all() and len(single) == 23
    order = np.argsort(s, kind="stable")
    s, e = s[order], e[order]
    starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    rank = np.arange(len(s)) - np.repeat(starts, np.diff(np.r_[starts, len(s)]))
    errors[s, rank + 1] = e
    np.maximum.at(count, s, rank + 2)
    return errors, count


def _combinations(weight: int) -> list[int]:
    import itertools

    return [sum(1 << b for b in bits) for bits in itertools.combinations(range(23), weight)]


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in words, 12-bit codeword index) for every key of every 23-bit word."""
    errors, count = key_errors()
    s = _syndromes(words)
    n = count[s]
    at = np.repeat(np.arange(len(words)), n)
    rank = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    code = words.astype(np.uint32)[at] ^ errors[s[at], rank]
    return at, code >> np.uint32(11)  # the code is systematic in its upper 12 bits: they name the codeword


def soft_keys(margins: np.ndarray, most: int = 8, flips: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(12-bit codeword indices, costs) of the codewords nearest to each row of 23 signed margins, nearest first.

    A margin's sign is the bit and its size is how sure the bit is; a codeword costs the
    margins of the bits in which it differs. The words that differ from the row in any of
    its flips least sure bits are decoded, and the most cheapest codewords found are taken.
    Where fewer are found, the rest cost infinity.
    """
    sure = np.abs(margins)
    hard = ((margins > 0) << np.arange(23, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)
    weak = np.uint32(1) << np.argpartition(sure, flips, axis=1)[:, :flips].astype(np.uint32)
    words = hard[:, None]
    for k in range(flips):
        words = np.concatenate((words, words ^ weak[:, k : k + 1]), axis=1)
    codes = np.sort(words ^ key_errors()[0][_syndromes(words), 0], axis=1)
    differ = np.unpackbits((codes ^ hard[:, None]).astype("<u4").view(np.uint8).reshape(*codes.shape, 4), axis=2, bitorder="little", count=32)[:, :, :23]
    cost = np.matmul(differ.astype(np.float32), sure.astype(np.float32)[:, :, None])[:, :, 0]
    cost[:, 1:][codes[:, 1:] == codes[:, :-1]] = np.inf
    order = np.argsort(cost, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(codes >> np.uint32(11), order, axis=1), np.take_along_axis(cost, order, axis=1)
