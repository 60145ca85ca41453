"""Hashes of words and word shingles for many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE, _MASK = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1
_LANES = [_U(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(0, _U), np.ones(0, _U))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, one to one."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(max(n, 1 << 16), base, _U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers = (out[0], out[1])
    return _powers


def word_hashes(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of each text, and the number of the text it is in.

    A word is a run of bytes other than white space (UTF-8 keeps other characters clear of it). Its hash is a
    polynomial over its bytes, taken as a difference of running sums, then mixed with its length.
    """
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    if not len(data):
        return np.empty(0, _U), np.empty(0, np.int64)
    if lower:
        data = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(np.concatenate(([False], inside, [False])).view(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * power[: len(data)], out=sums[1:])
    h = mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(_U) * _LANES[4])
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return h, np.searchsorted(bounds, start, side="right")


def shingle_hashes(texts: list[bytes], width: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words, and the number of its text, in order.

    A text of fewer words has one shingle, its whole word sequence; one without words has none.
    """
    h, of = word_hashes(texts, lower)
    count = np.bincount(of, minlength=len(texts))
    n = max(0, len(h) - width + 1)
    whole = of[:n] == of[width - 1 :][:n]
    s = np.zeros(n, _U)
    for k in range(width):
        s = mixed(s + h[k : k + n] * _LANES[k % 4] + _U(k))
    s, of_s = s[whole], of[:n][whole]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        first = np.searchsorted(of, short)
        extra = np.zeros(len(short), _U)
        for k in range(width - 1):
            has = count[short] > k
            extra[has] = mixed(extra[has] + h[first[has] + k] * _LANES[k % 4] + _U(k + 1000))
        place = np.searchsorted(of_s, short)
        s, of_s = np.insert(s, place, extra), np.insert(of_s, place, short)
    return s, of_s


def batches(texts: list[str], size: int = 1 << 20):
    """Index ranges of the texts, each of about ``size`` characters, or of one longer text."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield start, i
            start, held = i, 0
        held += len(t) + 1
    if start < len(texts):
        yield start, len(texts)
