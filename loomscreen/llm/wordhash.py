"""Words of texts and their hashes, in numpy.

Hashes of words and of word sequences are differences of prefix sums of
``value * BASE ** position`` modulo 2**64, moved back to position 0, then mixed.
BASE is odd, so it has an inverse, and any stretch costs the same.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Odd multipliers for the two families of hashes; any large odd numbers do.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BLOCK = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all input bits (in place where it can be)."""
    x = x.astype(_U)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), _U(base), dtype=_U)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def stretches(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """Mixed hashes of values[start:end] for each pair; equal stretches get equal hashes."""
    base = BASES[family]
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, dtype=_U)
        np.cumsum((values.astype(_U) + _U(1)) * _power(base, len(values)), out=sums[1:])
        back = _power(pow(base, -1, 1 << 64), len(values) + 1)
        return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts.

    ``buffer`` holds the texts' bytes, one space between them; word i is
    buffer[starts[i]:ends[i]]; text t has the words first[t] .. first[t + 1].
    """

    def __init__(self, found: list[bytes | None]):
        self.buffer = np.frombuffer(b" ".join([t or b"" for t in found] + [b""]), dtype=np.uint8)
        space = _SPACE[self.buffer]
        edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        lengths = np.fromiter((len(t or b"") + 1 for t in found), dtype=np.int64, count=len(found))
        self.first = np.searchsorted(self.starts, np.concatenate([[0], np.cumsum(lengths)]))
        self.counts = np.diff(self.first)

    def hashes(self, family: int = 0) -> np.ndarray:
        """A hash of each word's bytes, worked out for about BLOCK bytes at a time."""
        out, n = np.empty(len(self.starts), dtype=_U), len(self.starts)
        cuts = np.unique(np.append(np.searchsorted(self.starts, np.arange(0, len(self.buffer), BLOCK)), n)).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            lo, hi = int(self.starts[a]), int(self.ends[b - 1])
            out[a:b] = stretches(self.buffer[lo:hi], self.starts[a:b] - lo, self.ends[a:b] - lo, family)
        return out

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def runs(hashes: np.ndarray, first: np.ndarray, k: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all k consecutive words within a text.

    ``hashes`` are the words' and ``first`` the texts' first words, as in Words.
    """
    n = len(hashes)
    if n < k:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=_U)
    owner_end = np.repeat(first[1:], np.diff(first))
    places = np.flatnonzero(np.arange(n) + k <= owner_end)
    return places, stretches(hashes, places, places + k, family)
