"""Words ``[^\\x20\\x09-\\x0D]+`` and five-word windows of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

U = np.uint64
WINDOW = 5
#: Bytes of text that one vectorised step hashes (about 40 bytes of memory each).
STEP_BYTES = 1_500_000

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_RANDOM = np.random.default_rng(20240131)
_BYTE = _RANDOM.integers(1, 2**63, 256, np.uint64)
_PLACE = _RANDOM.integers(1, 2**63, WINDOW, np.uint64) | U(1)
_BASE, _MASK = 0x9E3779B97F4A7C15 | 1, 2**64 - 1
_INVERSE = pow(_BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, STEP_BYTES + 1000), base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


class Words:
    """The words of some texts: where they are in ``data`` (UTF-8, texts end with a newline) and their hashes."""

    def __init__(self, texts: list[str], lower: bool = False):
        raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.data = np.frombuffer(b"\n".join([*raws, b""]), np.uint8)
        self.text_end = np.cumsum([len(r) + 1 for r in raws], dtype=np.int64) if raws else np.empty(0, np.int64)
        if lower:
            self.data = _LOWER[self.data]
        white = _WHITE[self.data]
        change = np.flatnonzero(white[1:] != white[:-1]) + 1
        if len(white) and not white[0]:
            change = np.concatenate([[0], change])
        self.begin, self.end = change[0::2], change[1::2]
        self.first = np.searchsorted(self.begin, np.concatenate([[0], self.text_end]))  # of each text, among the words
        self.n = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        size = len(self.data)
        if not size:
            return np.empty(0, U)
        upto = np.concatenate([[U(0)], np.cumsum(_BYTE[self.data] * _power(_BASE, size), dtype=np.uint64)])
        return mix((upto[self.end] - upto[self.begin]) * _power(_INVERSE, size)[self.begin] + (self.end - self.begin).astype(U))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all five-word windows, and where each text's begin (one more at the end).

        A text with fewer words has one window of them all; one without words has none.
        """
        w = self.hashes()
        count = np.where(self.n >= WINDOW, self.n - WINDOW + 1, np.minimum(self.n, 1))
        at = np.concatenate([[0], np.cumsum(count)])
        owner = np.repeat(np.arange(len(count)), count)
        word = self.first[:-1][owner] + np.arange(at[-1]) - at[:-1][owner]
        out = np.full(len(word), U(WINDOW))
        padded = np.concatenate([w, np.zeros(WINDOW, U)])
        left = self.n[owner]
        for k in range(WINDOW):
            out += np.where(k < left, padded[word + k] * _PLACE[k], U(k + 1))
        return mix(out), at
