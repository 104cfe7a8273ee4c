"""Quality by weak labels: heuristic labellers, EM for their accuracies, and a hashed linear scorer of the posterior labels.

Overlapping labellers look at symbols, tables, shouting, exclamations, stuttering, vocabulary, repeated lines, word length, text
length and sentence ends; each says good (1), poor (0) or nothing. Without any given label, expectation-maximisation over the counted
vote patterns of all rows estimates how often each is right, and the posterior labels of a bounded sample of rows (``TRAIN_ROWS``, in
the order of a hash of their ids, one text an id) train a logistic model of hashed features: binned statistics and the shapes of word endings. That
model scores every row.

Null and empty texts count as texts without words and score as poor. Repeated rows score alike; an empty table gives an empty result
(and a model that knows the labellers only through their prior). Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import Words
from .support import hashed_sample, map_arrow, mix_py, stored
from .weak import LabelModel, logistic

#: Bound on the rows the scorer is fitted on; the label model sees the votes of all rows.
TRAIN_ROWS = 20_000
FEATURES_LOG2 = 14
KEEP = 0.5
#: Prior chances of the votes good, poor and none on a poor and on a good text: a labeller rarely calls a good text poor.
BELIEF = ((0.1, 0.5), (0.4, 0.003), (0.5, 0.497))
STATS = ("symbols", "pipes", "upper", "bangs", "stutter", "distinct", "lines", "word_length", "words", "stops")
_CLASS = np.frombuffer(bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256)), dtype=np.uint8)


def _per_row(mask: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row[mask], minlength=n).astype(float)


def statistics(texts: pa.Array) -> tuple[np.ndarray, Words]:
    """Rows x STATS: shares of words (or bytes, or lines) of each kind, mean word length, number of words."""
    w = Words(texts)
    n = w.n
    count = np.maximum(np.diff(w.first), 1).astype(float)
    last, size = w.buf[w.end - 1] if len(w.end) else w.buf[:0], w.end - w.start
    odd = np.isin(last, np.frombuffer(b"%*#$&@^~=_+<>{}[]\\/|`", dtype=np.uint8))
    out = np.zeros((n, len(STATS)))
    out[:, 0] = _per_row(odd & (size > 1), w.doc, n) / count
    out[:, 1] = _per_row((size == 1) & (last == 124), w.doc, n) / count
    ends = np.concatenate(([0], np.cumsum((w.buf >= 65) & (w.buf <= 90))))
    lows = np.concatenate(([0], np.cumsum(((w.buf | 32) >= 97) & ((w.buf | 32) <= 122))))
    out[:, 2] = np.diff(ends[w.offsets]) / np.maximum(np.diff(lows[w.offsets]), 1)
    out[:, 3] = _per_row((last == 33) & (size > 1) & (w.buf[np.maximum(w.end - 2, 0)] == 33), w.doc, n) / count if len(size) else 0
    same = np.zeros(len(size), dtype=bool)
    if len(size) > 1:
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    out[:, 4] = _per_row(same, w.doc, n) / count
    order = np.lexsort((w.hash, w.doc)) if len(size) else np.zeros(0, np.int64)
    h, d = w.hash[order], w.doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    out[:, 5] = _per_row(new, d, n) / count
    out[:, 6] = _repeated_lines(w)
    out[:, 7] = np.bincount(w.doc, size, minlength=n) / count
    out[:, 8] = np.diff(w.first)
    out[:, 9] = _per_row(np.isin(last, np.frombuffer(b".!?", dtype=np.uint8)), w.doc, n) / count
    return out, w


def _repeated_lines(w: Words) -> np.ndarray:
    """Share of the lines with ink of each text that repeat an earlier one."""
    if not len(w.start):
        return np.zeros(w.n)
    newline = np.concatenate(([0], np.cumsum(w.buf == 10)))
    line = newline[w.start]
    first = np.ones(len(line), dtype=bool)
    first[1:] = (line[1:] != line[:-1]) | (w.doc[1:] != w.doc[:-1])
    at = np.flatnonzero(first)
    total = np.add.reduceat(mix_py(w.hash * (np.arange(len(line)) - np.repeat(at, np.diff(np.append(at, len(line)))) + 1).astype(np.uint64)), at)
    doc = w.doc[at]
    order = np.lexsort((total, doc))
    again = np.zeros(len(order), dtype=bool)
    again[1:] = (total[order][1:] == total[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return _per_row(again, doc[order], w.n) / np.maximum(np.bincount(doc, minlength=w.n), 1)


LABELLERS = ("symbols", "tables", "capitals", "exclamations", "stutter", "repeated lines", "short", "word length", "vocabulary", "sentences", "prose")
#: Place of each labeller's vote, as a digit of base three, in the number of a vote pattern.
_PLACES = 3 ** np.arange(len(LABELLERS), dtype=np.int64)


def votes(stats: np.ndarray) -> np.ndarray:
    """Rows x LABELLERS: 1 good, 0 poor, -1 nothing. Each fault has a labeller that only speaks of it; the last three overlap them."""
    s = dict(zip(STATS, stats.T, strict=True))
    out = np.full((len(stats), len(LABELLERS)), -1, dtype=np.int8)
    some, many = s["words"] >= 20, s["words"] >= 100
    poor = (
        s["symbols"] > 0.2, s["pipes"] > 0.2, (s["words"] >= 5) & (s["upper"] > 0.5), s["bangs"] > 0.2, some & (s["stutter"] > 0.2),
        s["lines"] > 0.5, s["words"] < 1, (s["words"] >= 1) & ((s["word_length"] < 1.5) | (s["word_length"] > 20)),
        many & (s["distinct"] < 0.06), many & (s["stops"] == 0),
    )
    for k, bad in enumerate(poor):
        out[bad, k] = 0
    plain = (s["symbols"] < 0.05) & (s["pipes"] < 0.05) & (s["bangs"] < 0.05)
    steady = (s["stutter"] < 0.1) & (s["lines"] < 0.3)
    out[plain & (s["words"] >= 1) & (s["distinct"] > 0.15), 8] = 1
    out[plain & (s["upper"] < 0.4) & (s["stops"] > 0.005), 9] = 1
    out[plain & steady & (s["words"] >= 1) & (s["upper"] < 0.4) & (s["word_length"] <= 15), 10] = 1
    return out


def features(stats: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed feature) pairs, distinct: binned statistics, and binned shares of the shapes of word endings."""
    mask = (1 << FEATURES_LOG2) - 1
    bins = np.floor(np.log2(np.maximum(stats, 2.0**-8)) * 2).astype(np.int64)
    rows = np.repeat(np.arange(len(stats)), stats.shape[1])
    binned = (mix_py((np.tile(np.arange(stats.shape[1]), len(stats)) * 1000 + bins.ravel() + 100).astype(np.uint64)) & np.uint64(mask)).astype(np.int64)
    shape = np.zeros(len(w.start), dtype=np.uint64)
    kind = _CLASS[w.buf] if len(w.buf) else w.buf
    for k in (3, 2, 1):
        at = w.end - k
        shape = shape * np.uint64(256) + np.where(at >= w.start, kind[np.maximum(at, 0)] if len(kind) else 0, 0).astype(np.uint64)
    key, count = np.unique((w.doc.astype(np.uint64) << np.uint64(24)) | shape, return_counts=True)
    doc = (key >> np.uint64(24)).astype(np.int64)
    share = np.floor(np.log2(count / np.maximum(stats[doc, 8], 1) + 2.0**-8)).astype(np.int64) + 9
    ending = (mix_py((key & np.uint64(0xFFFFFF)) * np.uint64(64) + share.astype(np.uint64) + np.uint64(1 << 40)) & np.uint64(mask)).astype(np.int64)
    key = np.unique(np.concatenate([rows, doc]) << FEATURES_LOG2 | np.concatenate([binned, ending]))
    return key >> FEATURES_LOG2, key & mask


class QualityModel:
    def __init__(self, weights: np.ndarray, bias: float, accuracies: np.ndarray):
        self.weights, self.bias, self.accuracies = weights, bias, accuracies

    def score(self, texts: pa.Array) -> np.ndarray:
        stats, w = statistics(texts)
        rows, cols = features(stats, w)
        odds = self.bias + (np.bincount(rows, self.weights[cols], minlength=len(stats)) if len(rows) else 0)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _train_rows(batches):
    for b in batches:
        stats, w = statistics(b.column("text"))
        rows, cols = features(stats, w)
        cut = np.searchsorted(rows, np.arange(len(stats) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in votes(stats)], pa.binary()), pa.ListArray.from_arrays(pa.array(cut), pa.array(cols.astype(np.int32)))], names=["votes", "cols"])


def _count_votes(batches):
    count = np.zeros(3 ** len(LABELLERS), dtype=np.int64)
    for b in batches:
        count += np.bincount((votes(statistics(b.column("text"))[0]).astype(np.int64) + 1) @ _PLACES, minlength=len(count))
    at = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], names=["pattern", "n"])


def vote_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(patterns x LABELLERS votes, rows with each) over all rows: at most 4,608 patterns, as eight labellers have two votes, two three and one two."""
    got = map_arrow(docs.select("text"), _count_votes, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toArrow().sort_by("pattern")
    return (got["pattern"].to_numpy()[:, None] // _PLACES % 3 - 1).astype(np.int8), got["n"].to_numpy()


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> QualityModel:
    """EM over the counted votes of all rows, the scorer over at most ``train_rows``; only votes and hashed features reach the driver."""
    v, counts = vote_counts(docs)
    if not len(v):
        return QualityModel(np.zeros(1 << FEATURES_LOG2), 0.0, np.full(len(LABELLERS), 0.5))
    model = LabelModel(0.8).fit(v, np.where((v == 0).any(1), 0.1, 0.95), belief=BELIEF, strength=0.05, counts=counts)
    chosen = F.broadcast(stored(hashed_sample(docs.filter("doc_id is not null").select("doc_id"), "doc_id", train_rows).distinct(), "chosen"))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    got = map_arrow(rows.select("text"), _train_rows, "votes binary, cols array<int>").toArrow()
    n = got.num_rows
    if not n:
        return QualityModel(np.zeros(1 << FEATURES_LOG2), 0.0, model.accuracies())
    v = np.frombuffer(b"".join(got["votes"].to_pylist()), dtype=np.int8).reshape(n, len(LABELLERS))
    soft = model.posterior(v)
    lists = got["cols"].combine_chunks()
    cols = lists.flatten().to_numpy().astype(np.int64)
    rows = np.repeat(np.arange(n), lists.value_lengths().to_numpy())
    w, bias = logistic(rows, cols, soft, 1 << FEATURES_LOG2)
    return QualityModel(w, bias, model.accuracies())


def _score(model):
    def step(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.value.score(b.column("text")))], names=["doc_id", "score"])

    return step


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score, kept) for every row; score is 0 to 1, higher for better texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), _score(sent), f"doc_id {kind}, score double").withColumn("kept", F.col("score") >= KEEP)
