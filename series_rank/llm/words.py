"""Words, their hashes and the hashes of windows of words, as small helpers for tasks.

A word is a longest run of characters other than the six ASCII white-space
characters; bytes.split() cuts exactly there.
"""

from __future__ import annotations

import re

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, hence invertible modulo 2**64
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            for name, base in (("up", BASE), ("down", BASE_INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every window of *width* words, from one running sum.

    With S the running sum of hash[j] * B**j, the window from i on is
    (S[i + width] - S[i]) / B**i: equal sequences give equal numbers wherever
    they stand. Shorter inputs have no window.
    """
    n = len(hashes)
    if n < width:
        return np.empty(0, np.uint64)
    up, down = _POWERS.upto(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], dtype=np.uint64, out=total[1:])
    return mix((total[width:] - total[: n - width + 1]) * down[: n - width + 1])


_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_CUT = re.compile(rb"[ \t\n\r\x0b\x0c]")
_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
PIECE = 1 << 21


def hash_words(text: bytes) -> np.ndarray:
    """Hashes of the words of a text, from one running sum over its bytes."""
    raw = np.frombuffer(text, np.uint8)
    n = len(raw)
    edge = np.flatnonzero(np.diff(_SPACE[raw], prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    up, down = _POWERS.upto(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODES[raw] * up[:n], dtype=np.uint64, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def hash_texts(texts: list[bytes]) -> list[np.ndarray]:
    """hash_words of each text: short ones together, long ones in pieces that end between words."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    load = 0

    def flush() -> None:
        if held:
            hashes = hash_words(b" ".join(held))
            counts = np.cumsum([len(t.split()) for t in held])
            out.extend(np.split(hashes, counts[:-1]))
            held.clear()

    for t in texts:
        if len(t) > PIECE:
            flush()
            load, at, parts = 0, 0, []
            while at < len(t):
                cut = _CUT.search(t, min(at + PIECE, len(t)))
                end = cut.start() if cut else len(t)
                parts.append(hash_words(t[at:end]))
                at = end + 1
            out.append(np.concatenate(parts))
            continue
        held.append(t)
        load += len(t)
        if load > PIECE:
            flush()
            load = 0
    flush()
    return out


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in a window of *width* that begins at one of *starts*."""
    edge = np.zeros(n + 1, np.int64)
    edge[starts] += 1
    np.subtract.at(edge, starts + width, 1)
    return np.cumsum(edge[:n]) > 0
