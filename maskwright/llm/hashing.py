"""64-bit hashes of all runs (words) in a text at once: polynomials over its characters, from
running sums, so that no word costs a call of its own."""

from __future__ import annotations

from functools import cache

import numpy as np

_ODD = 0x9E3779B97F4A7C15
#: Bytes of a text hashed at a time.
PIECE = 500_000
#: Bytes that are in words, for words between blanks.
INSIDE = np.array([i != 0x20 and not 0x09 <= i <= 0x0D for i in range(256)])
BLANKS = b" \t\n\v\f\r"


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 2**bits
    return tuple(np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n - 1, x, np.uint64)))) for x in (_ODD, pow(_ODD, -1, 2**64)))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of an odd number and of its inverse, modulo 2^64."""
    return _powers(max(19, n.bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(codes: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each run of characters where `inside` (by code) is true."""
    edge = np.flatnonzero(np.diff(inside[codes], prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    up, down = powers(len(codes))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)])))
    return start, end, mix((sums[end] - sums[start]) * down[start])


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the text's words between blanks, in order, A-Z lowered."""
    out, i = [], 0
    while i < len(text):
        j = min(len(text), i + PIECE)
        while j < len(text) and text[j] not in BLANKS:
            j += 1
        out.append(runs(np.frombuffer(text[i:j].lower(), np.uint8), INSIDE)[2])
        i = j
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """Hashes of the text's shingles of `size` words, in order; of all its words if they are fewer."""
    h = word_hashes(text)
    size = min(size, len(h))
    n, up = len(h) - size + 1, powers(0)[0]
    total = np.zeros(n if size else 0, np.uint64)
    for k in range(size):
        total += h[k : k + n] * up[k + 1]
    return mix(total)
