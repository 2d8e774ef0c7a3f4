"""Hashes of all words of many texts at once, in numpy.

A word is a run of bytes without white space. Its hash is a polynomial over
mixed byte values, taken from running sums modulo 2**64, then finalised; two
different words of one text agree with a chance of about 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are hashed in stretches of about so many bytes, which bounds the memory a batch takes.
STRETCH = 2_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


class _Table:
    """Powers of the base and of its inverse, grown on demand."""

    up = _powers(_BASE, 1 << 12)
    down = _powers(pow(_BASE, -1, 1 << 64), 1 << 12)

    @classmethod
    def need(cls, n: int) -> None:
        if n > len(cls.up):
            n = 1 << (n - 1).bit_length()
            cls.up = _powers(_BASE, n)
            cls.down = _powers(pow(_BASE, -1, 1 << 64), n)


def hash_runs(values: np.ndarray, exponent: np.ndarray | None, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of ``values[first:last]`` for each pair; ``exponent`` gives positions where not every byte counts."""
    _Table.need(len(values) + 1)
    weight = _Table.up[: len(values)] if exponent is None else _Table.up[exponent]
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * weight, out=total[1:])
    begin = first if exponent is None else exponent[first]
    return mixed((total[last] - total[first]) * _Table.down[begin])


def bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a byte array."""
    space = _IS_SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts = edge[~space[edge]]
    ends = edge[space[edge]]
    if len(raw) and not space[0]:
        starts = np.concatenate([[0], starts])
    if len(raw) and not space[-1]:
        ends = np.concatenate([ends, [len(raw)]])
    return starts, ends


def stretches(texts: list[bytes], most: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes, by default STRETCH; one longer text is a range of its own."""
    most = most or STRETCH
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield begin, i
            begin, size = i, 0
        size += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts set apart by a space, starts and ends of words, and the first word of each text."""
    joined = b" ".join(texts)
    raw = np.frombuffer(joined, np.uint8)
    starts, ends = bounds(raw)
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.concatenate([[0], np.cumsum(length + 1)])
    return raw, starts, ends, np.searchsorted(starts, begin)


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Hashes of all words in order, the offsets of each text's words, and what ``words`` returned."""
    found = words(texts)
    raw, starts, ends, offsets = found
    return hash_runs(_BYTE[raw], None, starts, ends), offsets, found


def pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of two hashes in order."""
    return mixed(first * np.uint64(0xD6E8FEB86659FD93) + (second ^ np.uint64(0xA5A5A5A55A5A5A5B)))
