"""Hashes of all words of a batch of texts at once, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are taken together up to this many bytes; a longer one is taken alone.
BATCH_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64, up to n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, BATCH_BYTES + 4096)
        _powers[:] = [np.cumprod(np.append(np.uint64(1), np.full(size, b, np.uint64)), dtype=np.uint64) for b in (_BASE, _INVERSE)]
    return _powers


def grouped(texts: list[bytes] | list[str]) -> Iterator[range]:
    """Ranges of texts of at most BATCH_BYTES together, or of one longer text."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        if k > first and size + len(t) > BATCH_BYTES:
            yield range(first, k)
            first, size = k, 0
        size += len(t) + 1
    if texts:
        yield range(first, len(texts))


def hashed_words(texts: list[bytes], is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words in order, where each text's words begin and the last's end).

    A word is a longest run of bytes b with is_word[b]. The line feed that
    parts the texts must not be one. Its hash is a polynomial of its bytes,
    from differences of running sums.
    """
    joined = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    inside = is_word[joined]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begin, end = edge[0::2], edge[1::2]
    power, inverse = _power(len(joined))
    sums = np.cumsum((joined + np.uint64(1)) * power[: len(joined)], dtype=np.uint64)
    hashes = mix((sums[end - 1] - sums[begin - 1]) * inverse[begin])
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(begin, bounds)


def prefix_hashes(texts: list[bytes], is_word: np.ndarray, lengths: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """([hashes of the first n bytes of every word, 0 where it has no more than these, for n in lengths; of the words], bounds as in hashed_words)."""
    joined = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    inside = is_word[joined]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begin, end = edge[0::2], edge[1::2]
    power, inverse = _power(len(joined))
    sums = np.cumsum((joined + np.uint64(1)) * power[: len(joined)], dtype=np.uint64)
    before, unit, out = sums[begin - 1], inverse[begin], []
    for n in lengths:
        hashes = mix((sums[np.minimum(begin + n, len(joined)) - 1] - before) * unit + np.uint64(n))
        out.append(np.where(end - begin > n, hashes | np.uint64(1), np.uint64(0)))
    out.append(mix((sums[end - 1] - before) * unit) | np.uint64(1))
    return out, np.searchsorted(begin, np.cumsum([0, *(len(t) + 1 for t in texts)]))


def word_table(pattern: str) -> np.ndarray:
    """Which bytes a word may have, from a kind: "alnum" or "nonspace"."""
    b = np.arange(256)
    if pattern == "alnum":
        return (b >= 128) | ((b >= 48) & (b <= 57)) | ((b >= 97) & (b <= 122))
    return ~((b == 32) | ((b >= 9) & (b <= 13)))
