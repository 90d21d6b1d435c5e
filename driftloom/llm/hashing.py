"""Vectorised 64-bit hashes of words, word shingles and byte windows, for whole batches of texts."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 5
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; kept, and grown when a longer run is asked for."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16, 2 * len(have) if have is not None else 0)
        steps = np.full(size, base, dtype=U)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """c with c[0] = 0, from which the hash of data[i:j] is (c[j] - c[i]) * BASE**i, modulo 2**64."""
    out = np.zeros(len(data) + 1, dtype=U)
    np.cumsum((data.astype(U) + U(1)) * powers(INVERSE, len(data)), out=out[1:])
    return out


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of `width` words; a shorter text with words has one, of all
    its words. Words are runs of bytes other than ASCII white space."""
    data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    word = (data != 32) & ((data < 9) | (data > 13))
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    c = prefix_sums(data)
    hashes = mix((c[last] - c[first]) * powers(BASE, len(data) + 1)[first] + (last - first).astype(U))
    counts = np.diff(np.searchsorted(first, ends, "left"), prepend=0)
    place = mix(np.arange(1, width + 1, dtype=U)) | U(1)
    rolled = np.zeros(len(hashes), dtype=U)
    for k in range(width):
        rolled[: len(hashes) - k] += hashes[k:] * place[k]
    rolled, out, at = mix(rolled), [], 0
    for n in counts:
        if n >= width:
            out.append(np.unique(rolled[at : at + n - width + 1]))
        elif n:
            short = np.sum(hashes[at : at + n] * place[:n], dtype=U) + U(n)
            out.append(mix(np.array([short], dtype=U)))
        else:
            out.append(np.zeros(0, dtype=U))
        at += n
    return out
