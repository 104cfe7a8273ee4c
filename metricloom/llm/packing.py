"""Packing of tokenised documents into sequences of at most ``SEQUENCE`` tokens by non-negative least squares.

1. Every text is tokenised once and its ids are written to the shared folder (two bytes an id where the vocabulary allows). Their
   lengths are counted modulo the sequence in bins of ``BIN`` tokens (whole sequences of a long document fill
   themselves): a histogram of ``SEQUENCE / BIN`` counts, whatever the corpus.
2. Shallow combinations of bins whose upper bounds fill a sequence are enumerated, and non-negative least squares finds how
   often each is to be used so that together they meet the histogram.
3. A pass over the ids packs each partition in groups of about ``GROUP_TOKENS`` tokens: it rounds the counts to the group's share,
   fills sequences with whole documents by them, and greedily cuts the residual documents into the room left. The last rest of
   a group is cut into sequences of a power of two, so there is no padding.

No text is shuffled, and memory is one group's tokens. The result depends on how the ids are split into partitions, but for one
input it is repeatable. Null and empty texts are one token, the end token. Sequence ids are unique: partition, then number.
Repeated rows are packed as often as they occur; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import Words
from .support import map_arrow, stored

SEQUENCE = 4096
BIN = 64
END_ID = 2
GROUP_TOKENS = 4 << 20
#: Words remembered within a partition; past that it starts afresh.
CACHE_WORDS = 1 << 17


class WordTokenizer:
    """Ids of whole texts from a tokenizer that lower-cases and treats white-space separated words on their own, each distinct
    word once. A final point or comma after an ASCII letter or digit is a word of its own to it, and so here."""

    #: Words of plain letters are handed over in lines of so many.
    LINE = 128

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and each thread would keep memory of its own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.small = len(self.ends_word) <= 1 << 16
        self.clear()

    def clear(self) -> None:
        self.at: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0
        self.offset = np.zeros(1 << 16, dtype=np.int64)
        self.length = np.zeros(1 << 16, dtype=np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and how many each has."""
        encoded = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lens = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded))
        return np.fromiter(chain.from_iterable(encoded), dtype=np.uint32, count=int(lens.sum())), lens

    def _learn(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, plain: np.ndarray, hashes: np.ndarray) -> None:
        raw = buf.tobytes()
        word = lambda at: [raw[s:e].decode("utf-8", "replace") for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)]
        easy, hard = np.flatnonzero(plain), np.flatnonzero(~plain)
        texts = word(easy)
        ids, _ = self._encode([" ".join(texts[i : i + self.LINE]) for i in range(0, len(texts), self.LINE)])
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) == len(easy):
            lens = np.diff(ends, prepend=0)
        else:  # a vocabulary that does not mark word ends
            ids, lens = self._encode(texts)
        more, more_lens = self._encode(word(hard))
        ids, lens, hashes = np.concatenate([ids, more]), np.concatenate([lens, more_lens]), hashes[np.concatenate([easy, hard])]
        n = len(self.at)
        if n + len(lens) > len(self.offset):
            grow = max(len(self.offset) * 2, n + len(lens))
            self.offset, self.length = np.resize(self.offset, grow), np.resize(self.length, grow)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, max(len(self.flat) * 2, self.used + len(ids)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.length[n : n + len(lens)] = lens
        self.offset[n : n + len(lens)] = self.used + np.cumsum(lens) - lens
        self.used += len(ids)
        self.at.update(zip(hashes.tolist(), range(n, n + len(lens)), strict=True))

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        # the added tokens' strings are told from others by case, so texts that may hold one are not lower-cased before
        words = Words(texts, lower=not pc.any(pc.match_substring(texts, "<|")).as_py())
        buf, start, end, first = words.buf, words.start, words.end, words.first
        alnum = ((buf >= 48) & (buf <= 57)) | ((buf | 32) >= 97) & ((buf | 32) <= 122)
        if len(start):
            cut = ((buf[end - 1] == 46) | (buf[end - 1] == 44)) & (end - start > 1) & alnum[np.maximum(end - 2, 0)]
            first = first + np.concatenate(([0], np.cumsum(cut)))[first]
            twice = np.repeat(np.arange(len(start)), 1 + cut)
            tail = np.zeros(len(twice), dtype=bool)
            tail[1:] = twice[1:] == twice[:-1]
            head = cut[twice] & ~tail
            start, end = np.where(tail, end[twice] - 1, start[twice]), np.where(head, end[twice] - 1, end[twice])
        h, one, back = np.unique(words.span_hash(start, end), return_index=True, return_inverse=True)
        if len(self.at) > CACHE_WORDS:
            self.clear()
        keys = h.tolist()
        at = np.fromiter(map(self.at.get, keys, repeat(-1)), dtype=np.int64, count=len(keys))
        new = np.flatnonzero(at < 0)
        if len(new):
            # a-z and the letters of U+00C0 to U+00FF only: one word to the tokenizer
            after = np.zeros(len(buf), dtype=bool)
            after[1:] = (buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
            odd = np.concatenate(([0], np.cumsum(~(((buf >= 97) & (buf <= 122)) | (buf == 0xC3) | after))))
            s, e = start[one[new]], end[one[new]]
            self._learn(buf, s, e, odd[e] == odd[s], h[new])
            at[new] = np.fromiter(map(self.at.__getitem__, h[new].tolist()), dtype=np.int64, count=len(new))
        at = at[back]
        lens, offs = self.length[at], self.offset[at]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(offs - (ends - lens), lens) + np.arange(total)]
        cuts = np.concatenate(([0], ends))[first]
        return [ids[cuts[i] : cuts[i + 1]] for i in range(words.n)]


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def combinations(bins: int, depth: int = 3) -> np.ndarray:
    """Matrix of bins x combinations: how often each bin (bin j holds up to j + 1 units) occurs in a combination of ``bins`` units.

    All combinations of up to ``depth`` parts that fill the window, and for short documents one part with equal others.
    """
    found: set[tuple[int, ...]] = set()

    def grow(parts: tuple[int, ...], left: int, most: int) -> None:
        if not left:
            found.add(parts)
        elif len(parts) < depth:
            for p in range(min(left, most), 0, -1):
                grow((*parts, p), left - p, p)

    grow((), bins, bins)
    for small in range(1, bins // depth + 1):
        for k in range(1, bins // small + 1):
            rest = bins - k * small
            found.add((rest,) * bool(rest) + (small,) * k)
    out = np.zeros((bins, len(found)))
    for c, parts in enumerate(sorted(found)):
        for p in parts:
            out[p - 1, c] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 of least squares |a x - b|, by the active-set method."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], dtype=bool)
    for _ in range(4 * a.shape[0]):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        active[j] = True
        while True:
            at = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = (x[at][low] / np.maximum(x[at][low] - s[low], 1e-300)).min()
            x[at] += step * (s - x[at])
            active[at[x[at] <= 1e-12]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def plan(histogram: np.ndarray) -> tuple[list[tuple[np.ndarray, float]], float]:
    """Combinations (bins, with repeats) and how often each is wanted, most wanted first; the number of documents counted."""
    a = combinations(len(histogram))
    x = nnls(a, histogram.astype(float))
    order = [c for c in np.argsort(-x, kind="stable") if x[c] > 0]
    return [(np.repeat(np.arange(len(histogram)), a[:, c].astype(int)), float(x[c])) for c in order], float(histogram.sum())


def pack(lengths: list[int], wanted: list[tuple[np.ndarray, float]], total: float) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document index, start, length) that hold every token of the documents once."""
    out = [[(d, s, SEQUENCE)] for d, n in enumerate(lengths) for s in range(0, n - SEQUENCE + 1, SEQUENCE)]
    bins: list[list[int]] = [[] for _ in range(SEQUENCE // BIN)]
    rest = [n % SEQUENCE for n in lengths]
    for d in sorted(range(len(lengths)), key=lambda d: -rest[d]):
        if rest[d]:
            bins[(rest[d] - 1) // BIN].append(d)
    share = sum(r > 0 for r in rest) / total if total else 0
    filled: list[list[int]] = []
    for parts, count in wanted:
        need = np.bincount(parts, minlength=len(bins))
        some = np.flatnonzero(need)
        for _ in range(min(round(count * share), *(len(bins[j]) // need[j] for j in some))):
            filled.append([bins[j].pop() for j in parts])
    left = [d for b in reversed(bins) for d in b]
    spare = sum(SEQUENCE - sum(rest[d] for d in ds) for ds in filled)
    have = sum(rest[d] for d in left)
    while filled and have < spare:
        ds = filled.pop()
        used = sum(rest[d] for d in ds)
        spare -= SEQUENCE - used
        have += used
        left += ds
    stream = [(d, lengths[d] - rest[d], rest[d]) for d in left]
    stream.reverse()

    def take(n: int) -> list[tuple[int, int, int]]:
        got = []
        while n:
            d, s, k = stream.pop()
            m = min(k, n)
            got.append((d, s, m))
            if k > m:
                stream.append((d, s + m, k - m))
            n -= m
        return got

    for ds in filled:
        out.append([(d, lengths[d] - rest[d], rest[d]) for d in ds] + take(SEQUENCE - sum(rest[d] for d in ds)))
    have -= spare
    while have:
        size = min(SEQUENCE, 1 << (have.bit_length() - 1))
        out.append(take(size))
        have -= size
    return out


def _tokens(path: str):
    def step(batches):
        t = tokenizer(path)
        kind = np.dtype("<u2" if t.small else "<u4")
        for b in batches:
            ids = [np.append(x, np.uint32(END_ID)).astype(kind) for x in t(b.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(np.full(len(ids), kind.itemsize, np.int32)), pa.array([x.tobytes() for x in ids], pa.binary())],
                names=["doc_id", "n", "width", "ids"],
            )
        _loaded.clear()  # a worker that goes on to other work does not keep the vocabulary

    return step


def _pieces(wanted, total: float):
    def step(batches):
        number = TaskContext.get().partitionId() << 32

        def close(docs: list[int], ids: list[np.ndarray]):
            nonlocal number
            rows: list[tuple] = []
            for pieces in pack([len(x) for x in ids], wanted, total):
                offset = 0
                for d, s, n in pieces:
                    rows.append((docs[d], s, n, zlib.crc32(ids[d][s : s + n].astype("<u4").tobytes()), len(ids[d]), number, offset))
                    offset += n
                number += 1
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        docs: list[int] = []
        ids: list[np.ndarray] = []
        held = 0
        for b in batches:
            for doc, width, x in zip(b.column("doc_id").to_pylist(), b.column("width").to_pylist(), b.column("ids").to_pylist(), strict=True):
                docs.append(doc)
                ids.append(np.frombuffer(x, dtype=f"<u{width}"))
                held += len(ids[-1])
                if held >= GROUP_TOKENS:
                    yield close(docs, ids)
                    docs, ids, held = [], [], 0
        if docs:
            yield close(docs, ids)

    return step


def pack_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every document's ids and its end token."""
    tokens = stored(map_arrow(docs.select("doc_id", "text"), _tokens(tokenizer_path), "doc_id long, n long, width int, ids binary"), "tokens")
    rest = F.col("n") % SEQUENCE
    counts = tokens.filter(rest > 0).groupBy(F.expr(f"(n % {SEQUENCE} - 1) div {BIN}").alias("bin")).count().collect()
    histogram = np.zeros(SEQUENCE // BIN, dtype=np.int64)
    for r in counts:
        histogram[r["bin"]] = r["count"]
    wanted, total = plan(histogram)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return map_arrow(tokens.select("doc_id", "width", "ids"), _pieces(wanted, total), schema)
