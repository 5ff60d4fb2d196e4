"""Random draws that depend only on (seed, replicate, draw, stratum).

``portable`` draws use integer arithmetic that Spark SQL, numpy and any SQL engine compute
alike, so a resampled result can be checked elsewhere and does not change when a task is
run again.  Any task can replay any of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 2147483647


def stratum_number(*cols: Column) -> Column:
    """Number below the modulus from the text of the keys (same text, same number)."""
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % MODULUS).cast("long")


def portable_index(rep: Column, i: Column, stratum: Column, seed: int, n: Column) -> Column:
    """Index in [0, n) of draw ``i`` in replicate ``rep`` (Spark form)."""
    x0 = (rep * 7919 + i * 104729 + stratum * 15485863 + F.lit(seed)) % MODULUS
    x1 = (x0 * x0 + 12345) % MODULUS
    x2 = x1 * 48271 % MODULUS
    x3 = (x2 * x2 + 67891) % MODULUS
    return F.call_function("div", x3 * n.cast("long"), F.lit(MODULUS).cast("long"))


def portable_states(rep: np.ndarray, i: np.ndarray, stratum: int, seed: int) -> np.ndarray:
    """State in [0, modulus) of replicates and draws of any shapes that fit each other (numpy form)."""
    m = np.int64(MODULUS)
    first = np.int64((int(stratum) * 15485863 + int(seed)) % MODULUS)
    x = (rep.astype(np.int64) * 7919 + i.astype(np.int64) * 104729 + first) % m
    x = (x * x + 12345) % m
    x = x * 48271 % m
    return (x * x + 67891) % m


def portable_state(rep: np.ndarray, i: np.ndarray, stratum: int, seed: int) -> np.ndarray:
    """State of every (replicate, draw) pair."""
    return portable_states(rep[:, None], i[None, :], stratum, seed)


def portable_indices(rep: np.ndarray, i: np.ndarray, stratum: int, seed: int, n: int | np.ndarray) -> np.ndarray:
    """Indices in [0, n) for every (replicate, draw) pair."""
    return portable_state(rep, i, stratum, seed) * n // MODULUS


# Numbers that a step of ``Draws`` holds at once, so that they stay in the cache of a core.
TILE = 16_384
_M, _31 = np.uint64(MODULUS), np.uint64(31)
_ADD1, _MUL, _ADD2, _ONE = np.uint64(12345), np.uint64(48271), np.uint64(67891), np.uint64(1)


def _fold(x: np.ndarray, spare: np.ndarray) -> None:
    """A number of the same remainder in place: the modulus is 2^31 - 1, so the bits above the lowest 31 are added to them."""
    np.right_shift(x, _31, out=spare)
    np.bitwise_and(x, _M, out=x)
    np.add(x, spare, out=x)


class Draws:
    """The draws first .. first + count - 1 of a stratum, for many replicates: ``portable_indices`` without divisions.

    With b for the draw's share of the first state and a for the replicate's, the second state is
    48271 * ((a + b)^2 + 12345) = b * (2 * 48271 * a) + 48271 * (b^2 + 12345) + 48271 * a^2, whose parts
    are found once per draw and once per replicate.
    """

    def __init__(self, first: int, count: int, stratum: int, seed: int):
        start = (first * 104729 + int(stratum) * 15485863 + int(seed)) % MODULUS
        b = np.arange(count, dtype=np.uint64)
        b *= np.uint64(104729)
        b += np.uint64(start)
        spare = np.empty_like(b)
        for _ in range(2):
            _fold(b, spare)
        b -= _M * (b >= _M)
        c = b * b
        _fold(c, spare)
        c += _ADD1
        c *= _MUL
        for _ in range(2):
            _fold(c, spare)
        self.count, self.b, self.c = count, b, c

    def indices(self, reps: np.ndarray, n: int, room: np.ndarray | None = None) -> np.ndarray:
        """Indices in [0, n), n below the modulus, of every replicate (rows) and draw; ``room`` may take them."""
        a = reps.astype(np.uint64) * np.uint64(7919) % _M
        k, s = a * np.uint64(2 * 48271) % _M, a * a % _M * _MUL % _M
        size = len(reps) * self.count
        out = (np.empty(size, np.uint64) if room is None else room[:size].view(np.uint64)).reshape(len(reps), self.count)
        rows = max(1, TILE // max(1, self.count))
        spare = np.empty(TILE, np.uint64)
        for r in range(0, len(reps), rows):
            height = min(rows, len(reps) - r)
            for start in range(0, self.count, TILE):
                x = out[r : r + height, start : start + TILE]
                part = slice(start, start + TILE)
                if height == 1:
                    x = x[0]
                    self._fill(x, spare[: x.size], k[r], s[r], n, part)
                else:
                    self._fill(x, spare[: x.size].reshape(x.shape), k[r : r + height, None], s[r : r + height, None], n, part)
        return out.view(np.int64)

    def _fill(self, x: np.ndarray, t: np.ndarray, k, s, n: int, part: slice) -> None:
        np.multiply(self.b[part], k, out=x)
        np.add(x, self.c[part], out=x)
        np.add(x, s, out=x)
        _fold(x, t)  # below 2^32, so its square fits
        np.multiply(x, x, out=x)
        np.add(x, _ADD2, out=x)
        _fold(x, t)
        _fold(x, t)
        # below twice the modulus: the remainder itself
        np.add(x, _ONE, out=t)
        np.right_shift(t, _31, out=t)
        np.add(x, t, out=x)
        np.bitwise_and(x, _M, out=x)
        # x * n // modulus
        np.multiply(x, np.uint64(n), out=x)
        np.right_shift(x, _31, out=t)
        np.add(x, t, out=x)
        np.add(x, _ONE, out=x)
        np.right_shift(x, _31, out=x)


def _log_factorial(x: np.ndarray) -> np.ndarray:
    """log x! of whole numbers."""
    small = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 20)))))
    y = np.maximum(x, 1) + 1.0
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return np.where(x < 20, small[np.clip(x, 0, 19).astype(np.int64)], series)


def binomial_quantile(u: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """The binomial(n, p) number whose distribution function passes ``u``, for arrays of u and n.

    The distribution is summed within ten standard deviations of its mean and ten numbers more, so
    the cost is the root of n.  The same sums in SQL give the same numbers.
    """
    if p <= 0 or p >= 1:
        return n.copy() if p >= 1 else np.zeros_like(n)
    spread = 10 * np.sqrt(n * p * (1 - p)) + 10
    low = np.maximum(0, np.floor(n * p - spread)).astype(np.int64)
    high = np.minimum(n, np.ceil(n * p + spread)).astype(np.int64)
    j = low[:, None] + np.arange(int((high - low).max()) + 1)
    inside = j <= high[:, None]
    j = np.minimum(j, n[:, None])
    log_p = _log_factorial(n)[:, None] - _log_factorial(j) - _log_factorial(n[:, None] - j) + j * np.log(p) + (n[:, None] - j) * np.log1p(-p)
    total = np.cumsum(np.where(inside, np.exp(log_p), 0.0), axis=1)
    return np.minimum(high, low + ((total <= u[:, None] * total[:, -1:]) & inside).sum(axis=1))


def multinomial(counts: np.ndarray, reps: np.ndarray, stratum: int, seed: int) -> np.ndarray:
    """As many draws as all counts, shared over the cells by their counts, per replicate.

    Cell after cell takes its binomial share of the draws that are left, by one portable state.
    """
    left = np.full(len(reps), counts.sum(), np.int64)
    rest = int(counts.sum())
    out = np.zeros((len(reps), len(counts)), np.int64)
    states = portable_state(reps, np.arange(len(counts)), stratum, seed)
    for c, n in enumerate(counts.tolist()):
        step = max(1, 2_000_000 // int(20 * np.sqrt(max(1, rest)) + 21))
        for start in range(0, len(reps), step):
            part = slice(start, start + step)
            out[part, c] = binomial_quantile((states[part, c] + 0.5) / MODULUS, left[part], n / rest)
        left -= out[:, c]
        rest -= n
    return out
