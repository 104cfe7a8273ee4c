"""Vectorised word hashing over Arrow string buffers: no Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .support import mix_py

_R = 0x9E3779B97F4A7C15
_C = 0xD6E8FEB86659FD93
_C2 = 0xA0761D6478BD642F
_MASK = (1 << 64) - 1
_BLOCK = 1 << 17
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            p = np.ones(size, dtype=np.uint64)
            k, step = 1, b
            while k < size:
                p[k : 2 * k] = p[:k] * np.uint64(step)
                step = step * step & _MASK
                k *= 2
            out.append(p)
        have = _powers[base] = (out[0], out[1])
    return have


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text of an Arrow string array, in order. Null texts have none.

    ``first[i]:first[i + 1]`` are the words of row i; ``start`` and ``end`` are byte positions in ``buf``. With ``lower`` A-Z
    become a-z; with ``letters`` all ASCII but letters and digits separates words too.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, letters: bool = False):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if not pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.large_string())
        n = len(texts)
        _, off, data = texts.buffers()
        offsets = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        base = int(offsets[0])
        size = int(offsets[-1]) - base
        buf = np.frombuffer(data, dtype=np.uint8)[base : base + size] if size else np.zeros(0, np.uint8)
        offsets = offsets - base
        valid = np.asarray(texts.is_valid()) if n else np.zeros(0, bool)
        if lower and size:
            buf = np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)
        self.buf, self.offsets, self.n, self.valid = buf, offsets, n, valid
        ink = (buf != 32) & ((buf < 9) | (buf > 13))
        if letters:
            ink = (buf >= 128) | ((buf >= 48) & (buf <= 57)) | ((buf | 32) >= 97) & ((buf | 32) <= 122)
        cut = np.zeros(size + 1, dtype=bool)
        cut[offsets] = True
        cut[-1] = True
        prev = np.empty(size, dtype=bool)
        if size:
            prev[0] = False
            prev[1:] = ink[:-1]
        self.start = np.flatnonzero(ink & (~prev | cut[:-1]))
        nxt = np.empty(size, dtype=bool)
        if size:
            nxt[:-1] = ink[1:]
            nxt[-1] = False
        self.end = np.flatnonzero(ink & (~nxt | cut[1:])) + 1
        self.first = np.searchsorted(self.start, offsets, "left")
        self.doc = np.repeat(np.arange(n), np.diff(self.first))
        self._hash: np.ndarray | None = None

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of the bytes of each span; spans are in order of their ends. Worked out in blocks of ``_BLOCK`` bytes."""
        out = np.empty(len(start), dtype=np.uint64)
        i = 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + _BLOCK, "right")))
            a, b = int(start[i]), int(end[j - 1])
            p, inv = powers(_R, b - a + 1)
            total = np.zeros(b - a + 1, dtype=np.uint64)
            np.cumsum((self.buf[a:b].astype(np.uint64) + np.uint64(1)) * p[: b - a], out=total[1:])
            s, e = start[i:j] - a, end[i:j] - a
            out[i:j] = mix_py((total[e] - total[s]) * inv[s] + (e - s).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
            i = j
        return out

    @property
    def hash(self) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        if self._hash is None:
            self._hash = self.span_hash(self.start, self.end)
        return self._hash

    def joined(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets by text) of the words of each text where ``keep`` is true, joined by one space; copied in blocks of words."""
        at = np.flatnonzero(keep)
        start, size, doc = self.start[at], self.end[at] - self.start[at], self.doc[at]
        space = np.zeros(len(at), dtype=bool)
        space[:-1] = doc[1:] == doc[:-1]
        ends = np.concatenate(([0], np.cumsum(size + space)))
        out = np.empty(int(ends[-1]), dtype=np.uint8)
        i = 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + _BLOCK, "right")) - 1)
            a, b = int(ends[i]), int(ends[j])
            source = np.arange(a, b) + np.repeat(start[i:j] - ends[i:j], np.diff(ends[i : j + 1]))
            out[a:b] = self.buf[np.minimum(source, len(self.buf) - 1)]
            i = j
        out[ends[1:][space] - 1] = 32
        return out, ends[np.searchsorted(doc, np.arange(self.n + 1))]

    def windows(self, k: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(position of the first word, hash) of every k consecutive words of one text."""
        h = self.hash
        n = len(h) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return at, rolled(h, k, _C2 if second else _C)[at]


def rolled(h: np.ndarray, k: int, c: int = _C) -> np.ndarray:
    """Hash of h[i:i+k] for every i, from one running sum (blocks keep the tables of powers small)."""
    n = len(h) - k + 1
    out = np.empty(max(n, 0), dtype=np.uint64)
    for a in range(0, n, _BLOCK):
        b = min(n, a + _BLOCK)
        p, inv = powers(c, b - a + k)
        total = np.zeros(b - a + k, dtype=np.uint64)
        np.cumsum(h[a : b + k - 1] * p[: b - a + k - 1], out=total[1:])
        out[a:b] = mix_py((total[k:] - total[: b - a]) * inv[: b - a] + np.uint64(k))
    return out


def shingle_sets(words: Words, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text; a text of 1 to k-1 words gives its whole sequence as one."""
    at, h = words.windows(k)
    first = np.searchsorted(at, words.first)
    out = []
    for i in range(words.n):
        a, b = first[i], first[i + 1]
        if b > a:
            s = np.sort(h[a:b])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            out.append(s)
        elif m := int(words.first[i + 1] - words.first[i]):
            out.append(rolled(words.hash[words.first[i] : words.first[i + 1]], m, _C))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sliding_min(h: np.ndarray, k: int) -> np.ndarray:
    """Smallest of h[i:i+k] for every i, by doubling."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, h.dtype)
    m, size = h, 1
    while size * 2 <= k:
        m = np.minimum(m[: len(m) - size], m[size:])
        size *= 2
    return np.minimum(m[:n], m[k - size : k - size + n]) if size < k else m[:n]
