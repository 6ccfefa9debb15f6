"""Hashes of all words of many texts at once.

A word is a run of bytes other than space and U+0009 to U+000D, with A-Z in lower case. Its hash is that of a polynomial
over the values of its bytes, modulo 2**64, read off running sums over the whole buffer; so the work is a few vector
operations, whatever the number of words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes that are worked on at once; a longer text is cut at white space.
BLOCK = 1 << 18

# An odd base with its inverse modulo 2**64, and the multipliers of the final mix.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_BYTES = np.arange(256)
_WHITE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES)


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * MIX[0]
        h = h ^ (h >> np.uint64(27))
        h = h * MIX[1]
        return h ^ (h >> np.uint64(31))


#: What a byte is worth: a 64-bit number of its lower-case form.
_WORTH = mix((_LOWER.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE))


class _Powers:
    """Powers of the base and of its inverse, as many as the longest buffer so far needs."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            def powers(base):
                out = np.full(n, base, np.uint64)
                out[0] = 1
                return np.cumprod(out, dtype=np.uint64)

            self.up, self.down = powers(np.uint64(BASE)), powers(np.uint64(INVERSE))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _block(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a buffer that ends in white space begin, and their hashes."""
    a = np.frombuffer(raw, np.uint8)
    white = _WHITE[a]
    change = np.flatnonzero(np.diff(white, prepend=True))
    start, end = change[::2], change[1::2]
    up, down = _POWERS.get(len(a))
    sums = np.empty(len(a) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_WORTH[a] * up, out=sums[1:])
    return start, mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def _cuts(raw: bytes) -> Iterator[bytes]:
    at = 0
    while len(raw) - at > BLOCK:
        found = _SPACE.search(raw, at + BLOCK)
        end = found.end() if found else len(raw)
        yield raw[at:end]
        at = end
    yield raw[at:]


def hash_words(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, text by text, and each text's number of words."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    counts = np.zeros(len(raws), np.int64)
    found: list[np.ndarray] = []
    held: list[bytes] = []
    first = size = 0

    def flush(last: int) -> None:
        nonlocal held, size, first
        if held:
            start, hashes = _block(b" ".join(held) + b" ")
            bounds = np.cumsum([len(r) + 1 for r in held])
            counts[first:last] = np.diff(np.searchsorted(start, bounds), prepend=0)
            found.append(hashes)
        held, size, first = [], 0, last

    for i, raw in enumerate(raws):
        if size + len(raw) > BLOCK:
            flush(i)
        if len(raw) > BLOCK:
            for part in _cuts(raw):
                hashes = _block(part + b" ")[1]
                counts[i] += len(hashes)
                found.append(hashes)
            first = i + 1
        else:
            held.append(raw)
            size += len(raw)
    flush(len(raws))
    return (np.concatenate(found) if found else np.empty(0, np.uint64)), counts
