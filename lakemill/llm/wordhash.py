"""Vectorised word and window hashing over Arrow string batches.

A word is a maximal run of bytes other than space and 0x09-0x0D, so splitting
works on UTF-8 bytes directly: no separator byte occurs inside a multi-byte
character. All hashes are polynomial (Rabin-Karp) in arithmetic modulo 2**64,
finished by a bit mixer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"

_MASK = (1 << 64) - 1
_BYTE_BASE = 0x9E3779B97F4A7C15 | 1
#: Bases for windows of words; two independent ones give 128-bit identities.
WINDOW_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Bytes hashed at a time; bounds the working memory for very long texts.
_CHUNK = 1 << 20

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in [0, n)."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            out = np.empty(size, np.uint64)
            out[0], done = 1, 1
            while done < size:
                step = np.uint64(pow(b, done, 1 << 64))
                out[done : 2 * done] = out[:done] * step
                done *= 2
            made.append(out)
        have = _powers[base] = (made[0], made[1])
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a batch of texts: byte spans, hashes, and the first word of each text.

    With letters, words are runs of ASCII letters and bytes beyond ASCII
    instead, and Latin-1 capitals are lowered too.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = False, letters: bool = False):
        n = len(raw)
        if letters:
            low = raw | np.uint8(32)
            mark = ((low >= 97) & (low <= 122)) | (raw >= 128)
        else:
            mark = (raw > 32) | ((raw < 9) | ((raw > 13) & (raw < 32)))
        before = np.empty(n + 1, bool)
        before[0] = False
        before[1:] = mark
        before[offsets] = False
        after = np.empty(n + 1, bool)
        after[:n] = mark
        after[offsets] = False
        self.start = np.flatnonzero(mark & ~before[:n])
        self.end = np.flatnonzero(mark & ~after[1:]) + 1
        self.raw = raw
        self.first = np.searchsorted(self.start, offsets)
        if lower or letters:
            raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
        if letters:
            latin = np.flatnonzero(raw[:-1] == 0xC3) + 1
            latin = latin[(raw[latin] >= 0x80) & (raw[latin] <= 0x9E) & (raw[latin] != 0x97)]
            raw[latin] += 0x20
        self._bytes = raw
        self._word_hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._word_hash is None:
            self._word_hash = self.spans(self.start, self.end)
        return self._word_hash

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte spans in ascending order that don't overlap."""
        raw = self._bytes
        out = np.empty(len(start), np.uint64)
        k = 0
        while k < len(start):
            at = start[k]
            stop = max(k + 1, int(np.searchsorted(end, at + _CHUNK, "right")))
            a, b = start[k:stop] - at, end[k:stop] - at
            up, down = powers(_BYTE_BASE, int(b[-1]) + 1)
            total = np.zeros(int(b[-1]) + 1, np.uint64)
            np.cumsum((raw[at : at + b[-1]].astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
            out[k:stop] = (total[b] - total[a]) * down[a]
            k = stop
        return mix(out)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, size: int, base: int = WINDOW_BASES[0]) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of every window of `size` words inside one text."""
        w = len(self.hash)
        if w < size:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        stop = np.repeat(self.first[1:], self.counts())
        at = np.flatnonzero(np.arange(w) + size <= stop)
        up, down = powers(base, w + 1)
        total = np.zeros(w + 1, np.uint64)
        np.cumsum(self.hash * up[:w], out=total[1:])
        return mix((total[at + size] - total[at]) * down[at]), at


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. A text with fewer than
    `size` words has its whole sequence as its one shingle; a text without
    words has none."""
    hashes, at = words.windows(size)
    cut = np.searchsorted(at, words.first)
    out = []
    for d, n in enumerate(words.counts()):
        if n >= size:
            out.append(np.unique(hashes[cut[d] : cut[d + 1]]))
        elif n:
            w = words.hash[words.first[d] : words.first[d + 1]]
            up, _ = powers(WINDOW_BASES[0], size + 1)
            out.append(mix(((w * up[:n]).sum(dtype=np.uint64) + np.uint64(n)) ^ np.uint64(0x5851F42D4C957F2D)).reshape(1))
        else:
            out.append(np.empty(0, np.uint64))
    return out
