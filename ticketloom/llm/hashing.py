"""Vectorised hashes of the words of many texts at once (numpy, inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are hashed in blocks of about this many bytes; a longer text is a block of its own.
BLOCK_BYTES = 2_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all its bits."""
    h = (h ^ (h >> np.uint64(30))) * _MIX_A
    h = (h ^ (h >> np.uint64(27))) * _MIX_B
    return h ^ (h >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1024)
        one = np.ones(1, np.uint64)
        _powers[:] = [np.concatenate([one, np.cumprod(np.full(size - 1, b, np.uint64), dtype=np.uint64)]) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def blocks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts in UTF-8) of consecutive blocks; null counts as empty."""
    at, size, held = 0, 0, []
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if held and size + len(b) > BLOCK_BYTES:
            yield at, held
            at, size, held = i, 0, []
        held.append(b)
        size += len(b) + 1
    if held:
        yield at, held


def word_hashes(block: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of bytes other than 0x20 and 0x09-0x0D, A-Z in lower case) and the texts' bounds among them."""
    raw = np.frombuffer(b"\n".join([*block, b""]), np.uint8)
    gap = _SPACE[raw]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(raw) and not gap[0]:
        edge = np.concatenate([[0], edge])
    begin, end = edge[0::2], edge[1::2]
    power, inverse = _tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
    h = mixed((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    text_end = np.cumsum([len(b) + 1 for b in block])
    return h, np.concatenate([[0], np.searchsorted(begin, text_end)])


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n neighbouring values."""
    if len(h) < n:
        return h[:0]
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * _BASE + mixed(h[k : len(h) - n + 1 + k] + np.uint64(k + 1))
    return mixed(out + np.uint64(n))
