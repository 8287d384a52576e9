"""Sets of hashed word shingles of many texts at once, in numpy.

Words are runs of bytes other than [\\x20\\x09-\\x0D], with A-Z lower-cased. A text's set has a 64-bit hash of each
distinct run of `width` words; a text with fewer words has one, of all its words. Hashes are polynomials over random byte
values, finished by a mixer: two different shingles agree with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np

from .arrow_text import runs_of_rows

WIDTH = 5
CHUNK = 1 << 17

_RNG = np.random.default_rng(20240229)
_LOWER = np.arange(256)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Values of bytes without and with case.
FOLDED = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER]
EXACT = np.random.default_rng(20240301).integers(1, 1 << 63, 256, dtype=np.uint64)
_GAP = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE = [np.uint64(int(x) | 1) for x in _RNG.integers(1, 1 << 63, 64, dtype=np.uint64)]
_powers: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, from 0 to n - 1. Those of one chunk are held; more, for a long text, are made from them."""
    held = 2 * CHUNK
    if not _powers:
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(held, base, np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps))
    if n <= held:
        return _powers[0][:n], _powers[1][:n]
    out = []
    for small, base in zip(_powers, (_BASE, _BASE_INVERSE), strict=True):
        steps = np.full(-(-n // held), small[-1] * base, np.uint64)
        steps[0] = 1
        out.append((np.cumprod(steps)[:, None] * small[None, :]).reshape(-1)[:n])
    return out[0], out[1]


def word_spans(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer that ends in white space."""
    inside = ~_GAP[buffer]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.concatenate([[0], edges])
    return edges[::2], edges[1::2]


def range_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, byte_values: np.ndarray) -> np.ndarray:
    """Hashes of ranges of a buffer."""
    up, down = powers(len(buffer) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte_values[buffer] * up[: len(buffer)], dtype=np.uint64)])
    return mix64((total[ends] - total[starts]) * down[starts])


def word_hashes(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and hashes, without case, of the words of a buffer that ends in white space."""
    starts, ends = word_spans(buffer)
    return starts, range_hashes(buffer, starts, ends, FOLDED)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` hashed words."""
    n = len(words) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width):
        out += words[k : k + len(out)] * _PLACE[k]
    return mix64(out + np.uint64(width))


def sets_of(raw: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after the other, and the offsets of the texts in them."""
    data, parts, sizes = raw.tobytes(), [], []
    at = offsets.tolist()
    for first, last in runs_of_rows(offsets, CHUNK):
        texts = [data[at[k] : at[k + 1]] for k in range(first, last)]
        values, counts = _sets(texts, width)
        parts.append(values)
        sizes.append(counts)
    counts = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return values, np.concatenate([[0], np.cumsum(counts)])


def _sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    lengths = np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))
    starts, words = word_hashes(buffer)
    edges = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
    grams = shingle_hashes(words, width)
    n_words = np.diff(edges)
    n_grams = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(np.int64))
    ends = np.cumsum(n_grams)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    begins = (ends - n_grams).tolist()
    for k, (a, w, to, n) in enumerate(zip(edges[:-1].tolist(), n_words.tolist(), begins, n_grams.tolist(), strict=True)):
        if w >= width:
            part = out[to : to + n]
            part[:] = grams[a : a + n]
            part.sort()
        elif w:
            out[to] = shingle_hashes(words[a : a + w], w)[0]
    owner = np.repeat(np.arange(len(texts)), n_grams)
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[new], np.bincount(owner[new], minlength=len(texts))


def parities(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each set the parities of how many of its hashes fall into each of as many cells as it has hashes, rounded up to a power of two (64 at least), as words of 64 bits, and the offsets of the sets in them.

    Sets that differ in d hashes differ in d cells at most. The upper half of the words over the lower half, by exclusive or, is the sketch of half as many cells."""
    n = np.diff(offsets)
    cells = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(cells)])
    owner = np.repeat(np.arange(len(n)), n)
    at = (values & (cells[owner] - 1).astype(np.uint64)).astype(np.int64) + ends[owner]
    odd = (np.bincount(at, minlength=int(ends[-1])) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<u8"), ends // 64
