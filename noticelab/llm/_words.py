"""Words of many texts at once as numpy arrays of 64-bit hashes.

A text's bytes are summed with powers of an odd base, so that the hash of any
stretch of bytes is a difference of two prefix sums times an inverse power:
no loop over words or bytes is needed.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_codes(lower_ascii: bool) -> np.ndarray:
    """A random 64-bit code for each byte value; A-Z share the codes of a-z if asked."""
    codes = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
    if lower_ascii:
        codes[65:91] = codes[97:123]
    return codes


def white_space() -> np.ndarray:
    """True for the bytes that end a word: blank and 0x09 to 0x0D."""
    found = np.zeros(256, bool)
    found[[9, 10, 11, 12, 13, 32]] = True
    return found


def non_letters() -> np.ndarray:
    """True for the ASCII bytes that are no letters; bytes of other characters count as letters."""
    found = np.ones(256, bool)
    found[65:91] = found[97:123] = found[128:] = False
    return found


class Hasher:
    """Cuts texts into words and hashes stretches of bytes."""

    def __init__(self, breaks: np.ndarray, lower_ascii: bool = True, chunk: int = CHUNK_BYTES):
        self.breaks, self.codes, self.chunk = breaks, byte_codes(lower_ascii), chunk
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, self.chunk + 1)
            inverse = pow(BASE, -1, 1 << 64)
            for name, base in (("up", BASE), ("down", inverse)):
                step = np.full(size, base, np.uint64)
                step[0] = 1
                setattr(self, name, np.multiply.accumulate(step))

    def limits(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words."""
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = ~self.breaks[raw]
        turn = np.diff(inside)
        return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)

    def words(self, data: bytes):
        """Starts and ends of the words in data, and a function that hashes stretches."""
        raw = np.frombuffer(data, np.uint8)
        n = len(raw)
        self._powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.codes[raw] * self.up[:n], out=sums[1:])
        starts, ends = self.limits(raw)

        def stretch(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return mix((sums[b] - sums[a]) * self.down[a])

        return starts, ends, stretch

    def chunks(self, texts):
        """(first text, text lengths in words, starts, ends, stretch) for groups of
        whole texts of about self.chunk bytes; a longer text is a group of its own."""
        at, held, size = 0, [], 0
        for i, text in enumerate(texts):
            data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
            if held and size + len(data) > self.chunk:
                yield self._chunk(at, held)
                at, held, size = i, [], 0
            held.append(data)
            size += len(data) + 1
        if held:
            yield self._chunk(at, held)

    def _chunk(self, first: int, held: list[bytes]):
        limits = np.cumsum([len(x) + 1 for x in held])
        starts, ends, stretch = self.words(b"\n".join(held) + b"\n")
        counts = np.diff(np.searchsorted(starts, np.concatenate([[0], limits])))
        return first, counts, starts, ends, stretch
