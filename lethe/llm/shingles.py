"""Word shingles of whole texts as 64-bit hashes, by numpy passes over many texts at a time.

A-Z are lower-cased; words are runs of anything but the space and the characters 9 to 13. A text's set holds its
distinct shingles of k words; a text of fewer words has the whole sequence as its only one, an empty or null
text none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes that one pass holds.
PASS_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 16, 1 << (n + 1).bit_length())
    if size not in _powers:
        made = []
        for b in (_BASE, _INVERSE):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            made.append(np.cumprod(x, dtype=np.uint64))
        _powers.clear()
        _powers[size] = made[0], made[1]
    return _powers[size]


def words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte's place of each word."""
    x = np.frombuffer(raw, np.uint8)
    space = (x == 32) | ((x >= 9) & (x <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _power(len(x))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[x] * up[: len(x)], dtype=np.uint64)])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64)), starts


def _long_words(raw: bytes) -> np.ndarray:
    """Words of a text that one pass would not hold."""
    out, part, size = [], [], 0
    for w in raw.split():
        part.append(w)
        size += len(w) + 1
        if size >= PASS_BYTES:
            out.append(words_of(b" ".join(part))[0])
            part, size = [], 0
    if part:
        out.append(words_of(b" ".join(part))[0])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def word_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The hashes of each text's words, in order."""
    part: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        joined = b"\n".join(part)
        h, at = words_of(joined)
        begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in part])])
        cut = np.searchsorted(at, begin)
        for i in range(len(part)):
            yield h[cut[i] : cut[i + 1]]

    for t in texts:
        if len(t) > PASS_BYTES:
            if part:
                yield from flush()
                part, size = [], 0
            yield _long_words(t.lower())
            continue
        part.append(t.lower())
        size += len(t) + 1
        if size >= PASS_BYTES:
            yield from flush()
            part, size = [], 0
    if part:
        yield from flush()


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for w in word_hashes(texts):
        n = min(k, len(w))
        if n == 0:
            yield np.zeros(0, np.uint64)
            continue
        h = np.full(len(w) - n + 1, n, np.uint64)
        for j in range(n):
            h = h * np.uint64(_BASE) + w[j : j + len(h)]
            h ^= h >> np.uint64(32)
        yield np.unique(mix(h))
