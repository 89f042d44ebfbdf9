"""Vectorised words and word-window hashes over whole Arrow text columns.

Everything here works on UTF-8 bytes: the separators of all word definitions in use are ASCII, so a
byte table decides them exactly.  Texts are taken in chunks of a few MB; a chunk always holds whole
texts, and memory is about 60 bytes per byte of the larger of a chunk and one text.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
BLOCK_WORDS = 1 << 15
BASE1 = np.uint64(0x9E3779B97F4A7C15)
BASE2 = np.uint64(0xC2B2AE3D27D4EB4F)
_BYTE = np.random.default_rng(20240917).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW: dict[int, np.ndarray] = {}

#: Bytes that separate words: ASCII white space.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes outside [0-9a-z] and non-ASCII, after lower-casing A-Z.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise a 64-bit hash (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POW.get(int(base))
    if have is None or len(have) < n:
        full = np.full(max(n, 4096), base, np.uint64)
        full[0] = 1
        have = _POW[int(base)] = np.cumprod(full)
    return have[:n]


@dataclass
class Words:
    """Words of consecutive texts: byte spans in ``data``, the text of each and the first word of each text."""
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # n_texts + 1 offsets into the words

    @property
    def n(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def remaining(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(self.n)

    def hashes(self) -> np.ndarray:
        out = np.empty(self.n, np.uint64)
        for lo in range(0, self.n, BLOCK_WORDS):  # in blocks: the byte-wise arrays below are eight times the text
            start, lens = self.start[lo:lo + BLOCK_WORDS], (self.end - self.start)[lo:lo + BLOCK_WORDS]
            at = np.cumsum(lens) - lens
            flat = np.arange(int(lens.sum()))
            inside = flat - np.repeat(at, lens)
            v = _BYTE[self.data[inside + np.repeat(start, lens)]] * powers(BASE1, int(lens.max()))[inside]
            out[lo:lo + BLOCK_WORDS] = mix(np.add.reduceat(v, at) + lens.astype(np.uint64))
        return out

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()


def split_words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> Words:
    word = ~separators[data]
    n = len(data)
    brk = np.zeros(n + 1, bool)
    brk[offsets] = True
    prev = np.empty(n, bool)
    if n:
        prev[0] = False
        prev[1:] = word[:-1]
    start = np.flatnonzero(word & (~prev | brk[:-1]))
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = word[1:]
    end = np.flatnonzero(word & (~after | brk[1:])) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def windows(h: np.ndarray, length: int, base: np.uint64 = BASE1) -> np.ndarray:
    """Hash of the ``length`` words from each word on; the last length-1 entries are missing."""
    n = len(h)
    if n < length:
        return np.zeros(0, np.uint64)
    p = powers(base, n)
    s = np.zeros(n + 1, np.uint64)
    np.cumsum(h * p, out=s[1:])
    back = powers(np.uint64(pow(int(base), -1, 1 << 64)), n - length + 1)  # to the same power everywhere
    return mix((s[length:] - s[:-length]) * back)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    m = x
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[:len(x) - width + 1], m[width - span:][:len(x) - width + 1])


def winnowed(g: np.ndarray, whole: np.ndarray, width: int) -> np.ndarray:
    """Positions of the smallest hash in each run of ``width`` (rightmost on a tie).

    ``whole[i]`` says whether the run that begins at i lies inside one text.
    """
    n = len(g)
    if n < width:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 31) - 1)  # places of the longest text that Spark can hold; the rest is hash
    key = (g & ~low) | (low - np.arange(n, dtype=np.uint64))
    m = sliding_min(key, width)[whole[:n - width + 1]]
    pos = (low - (m & low)).astype(np.int64)
    hit = np.zeros(n, bool)
    hit[pos] = True
    return np.flatnonzero(hit)


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, byte offsets of the rows); a NULL is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    off = np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
