"""Words of many texts at once, as spans of one byte buffer, with 64-bit hashes; numpy only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Words:
    """``buf`` holds the texts, a line feed after each; word i is ``buf[start[i]:end[i]]`` and belongs to text ``text[i]``."""

    def __init__(self, texts: list, lower: bool):
        parts = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
        self.sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
        raw = np.frombuffer(b"\n".join(parts) + b"\n" + b"\0" * 8, np.uint8)
        self.buf = _LOW[raw] if lower else raw
        word = np.zeros(len(raw) - 6, np.int8)
        word[1:-1] = ~_SPACE[raw[:-8]]
        edge = np.diff(word)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        ends = np.cumsum(self.sizes)
        #: Words of text t are ``first[t]:first[t + 1]``.
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)])

    def hashes(self) -> np.ndarray:
        """A hash of the bytes of each word."""
        size = self.end - self.start
        eights = np.lib.stride_tricks.as_strided(self.buf, (len(self.buf) - 7, 8), (1, 1))
        chunk = np.ascontiguousarray(eights[self.start]).view(np.uint64).ravel() & _MASKS[np.minimum(size, 8)]
        h = mix(chunk + size.astype(np.uint64) * _M2)
        at, todo = 8, np.flatnonzero(size > 8)
        while len(todo):
            s = self.start[todo] + at
            chunk = np.ascontiguousarray(eights[s]).view(np.uint64).ravel() & _MASKS[np.minimum(size[todo] - at, 8)]
            h[todo] = mix(h[todo] * _M1 + chunk)
            at += 8
            todo = todo[size[todo] > at]
        return h

    def of(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def chunks(texts: list, max_bytes: int = 3_000_000) -> Iterator[tuple[int, list]]:
    """Runs of whole texts of about ``max_bytes``, with the number of the first."""
    at, held, first = [], 0, 0
    for i, t in enumerate(texts):
        at.append(t)
        held += len(t) + 1 if isinstance(t, str) else 1
        if held >= max_bytes:
            yield first, at
            at, held, first = [], 0, i + 1
    if at:
        yield first, at


def ragged(values: np.ndarray, first: np.ndarray, size: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate runs ``values[first[p]:first[p]+size[p]]`` for p in ``pick``; also each run's end in the result."""
    n = size[pick]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    index = np.arange(total) + np.repeat(first[pick] - (ends - n), n)
    return values[index], ends


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element the number of its value, and for each number where the value stands first."""
    import pandas as pd

    codes, uniques = pd.factorize(h)
    at = np.empty(len(uniques), np.int64)
    at[codes[::-1]] = np.arange(len(h) - 1, -1, -1)
    return codes, at
