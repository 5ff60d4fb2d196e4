"""Words of a text as 64-bit hashes, with numpy on its UTF-8 bytes.

A word is a longest run of bytes other than space and ``\\x09`` to ``\\x0D``.  These are ASCII, so
runs of bytes are runs of characters.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# For comparisons without punctuation: every ASCII byte but letters and digits ends a word.
MARKS = np.zeros(256, bool)
MARKS[[b for b in range(128) if not chr(b).isalnum()]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Texts above this many bytes are taken in pieces cut at white space, to bound the memory.
PIECE_BYTES = 1 << 22

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = 1 << 16
POWER = np.cumprod(np.full(STEP, 0x9E3779B97F4A7C15, np.uint64))
SLOT = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
EMPTY = np.empty(0, np.uint64)


def each(column):
    """The values of an Arrow string or binary column as bytes; None for NULL."""
    for value in column:
        yield value.as_buffer().to_pybytes() if value.is_valid else None


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(data: bytes, limit: int = PIECE_BYTES, breaks: np.ndarray = SPACE):
    """``data`` in pieces of about ``limit`` bytes that end at a break."""
    start = 0
    while len(data) - start > limit:
        window = breaks[np.frombuffer(data, np.uint8, limit, start)]
        inside = np.flatnonzero(window)
        if len(inside):
            cut = start + int(inside[-1]) + 1
        else:  # one word longer than the limit stays whole
            rest = np.flatnonzero(breaks[np.frombuffer(data, np.uint8, -1, start + limit)])
            cut = start + limit + int(rest[0]) + 1 if len(rest) else len(data)
        yield data[start:cut]
        start = cut
    yield data[start:]


def spans(bytes_: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words."""
    inside = np.concatenate(([False], ~breaks[bytes_], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def _hashes(bytes_: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    starts, ends = spans(bytes_, breaks)
    if not len(starts):
        return EMPTY
    sizes = ends - starts
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    chars = bytes_[~breaks[bytes_]]
    place = np.arange(len(chars)) - np.repeat(first, sizes)
    factor = POWER[place & (STEP - 1)]
    if int(sizes.max()) > STEP:
        factor = factor + (place >> 16).astype(np.uint64) * SLOT[0]
    sums = np.add.reduceat(BYTE_VALUE[chars] * factor, first)
    return mix(sums + sizes.astype(np.uint64) * SLOT[1])


def word_hashes(data: bytes, lower: bool = False, breaks: np.ndarray = SPACE) -> np.ndarray:
    """One hash per word, in order; ``lower`` folds A-Z; words end at the bytes marked in ``breaks``."""
    out = []
    for piece in pieces(data, breaks=breaks):
        bytes_ = np.frombuffer(piece, np.uint8)
        out.append(_hashes(LOWER[bytes_] if lower else bytes_, breaks))
    return out[0] if len(out) == 1 else np.concatenate(out)


def masked_windows(words: np.ndarray, places: tuple[int, ...], salt: int) -> np.ndarray:
    """One hash per window, of its words at ``places`` only; none when there are fewer words."""
    n = len(words) - places[-1]
    if n <= 0:
        return EMPTY
    total = np.full(n, salt, np.uint64)
    for k, p in enumerate(places):
        total = total + mix(words[p : p + n] ^ SLOT[k]) * SLOT[k + 1]
    return mix(total)


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """One hash per window of ``width`` consecutive words (at most 63)."""
    return masked_windows(words, tuple(range(width)), width)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct windows, sorted; a shorter text is one window as a whole; no words, no window."""
    if 0 < len(words) < width:
        return windows(words, len(words))
    return np.unique(windows(words, width))
