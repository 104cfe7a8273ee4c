"""Weak supervision: term statistics, a generative label model with correlated voters, and a hashed linear classifier."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import Words
from .support import map_arrow, mix_py

#: Hash buckets of the linear model and the term statistics.
BUCKETS_LOG2 = 20
#: Word beginnings, in bytes, that count as terms beside the whole word.
STEMS = (4, 5, 6, 7)
#: Vote patterns whose sums one task works out.
PATTERN_ROWS = 1 << 12


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    return (mix_py(h + np.uint64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & np.uint64((1 << BUCKETS_LOG2) - 1)).astype(np.int64)


def term_buckets(texts: pa.Array, stems: tuple[int, ...] = STEMS) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, bucket) of every word and word beginning, unsorted and with repeats; the number of rows."""
    w = Words(texts, lower=True, letters=True)
    rows, buckets = [w.doc], [_bucket(w.hash, 0)]
    size = w.end - w.start
    for k in stems:
        at = size > k
        rows.append(w.doc[at])
        buckets.append(_bucket(w.span_hash(w.start[at], w.start[at] + k), k))
    return np.concatenate(rows), np.concatenate(buckets), w.n


def _distinct(rows: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((rows << BUCKETS_LOG2) | buckets)
    return key >> BUCKETS_LOG2, key & ((1 << BUCKETS_LOG2) - 1)


def _count_terms(stems):
    def step(batches):
        count = np.zeros((2, 1 << BUCKETS_LOG2), dtype=np.int32)
        for b in batches:
            rows, buckets = _distinct(*term_buckets(b.column("text"), stems)[:2])
            y = b.column("y").to_numpy(zero_copy_only=False)[rows]
            for c in (0, 1):
                count[c] += np.bincount(buckets[y == c], minlength=count.shape[1]).astype(np.int32)
        at = np.flatnonzero(count[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[1][at].astype(np.int64)), pa.array(count[0][at].astype(np.int64))], names=["bucket", "pos", "neg"])
        at = np.flatnonzero((count[0] > 0) & (count[1] == 0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.zeros(len(at), np.int64)), pa.array(count[0][at].astype(np.int64))], names=["bucket", "pos", "neg"])

    return step


def term_scores(rows: DataFrame, n_pos: int, n_neg: int, limit: int, least: int = 4, stems: tuple[int, ...] = STEMS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the terms that tell rows with y = 1 from y = 0 best, by z of the difference of shares; at most ``limit``."""
    counts = map_arrow(rows.select("text", "y"), _count_terms(stems), "bucket long, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    share = (F.col("pos") + F.col("neg")) / (n_pos + n_neg)
    z = (F.col("pos") / n_pos - F.col("neg") / n_neg) / F.sqrt(share * (1 - share) * (1 / n_pos + 1 / n_neg) + 1e-12)
    got = counts.filter(f"pos + neg >= {least}").select("bucket", z.alias("z")).filter("abs(z) > 4.5").orderBy(F.desc(F.abs("z")), "bucket").limit(limit).toArrow()
    return got["bucket"].to_numpy(), got["z"].to_numpy()


def chosen_terms(texts: pa.Array, table: np.ndarray, stems: tuple[int, ...] = STEMS) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, column) pairs, distinct, of the terms whose bucket has a column in ``table`` (-1: none)."""
    rows, buckets, n = term_buckets(texts, stems)
    col = table[buckets]
    at = col >= 0
    key = np.unique(rows[at] * (int(table.max()) + 1) + col[at]) if at.any() else np.zeros(0, np.int64)
    width = int(table.max()) + 1
    return (key // width, key % width, n) if width else (key, key, n)


def bucket_table(buckets: np.ndarray) -> np.ndarray:
    table = np.full(1 << BUCKETS_LOG2, -1, dtype=np.int32)
    table[buckets] = np.arange(len(buckets), dtype=np.int32)
    return table


class LabelModel:
    """Generative model of voters that say 1, 0 or nothing (-1): per class each voter has its own chances, found by EM.

    Correlations are estimated from what the voters' votes still share once the class is known; a voter's log-likelihood is
    divided by one plus its correlations with the voters that vote alike, so near copies of one voter count about once.
    """

    def __init__(self, prior: float):
        self.prior = prior

    def fit(self, votes: np.ndarray, start: np.ndarray, anchor: np.ndarray | None = None, rounds: int = 30, belief: tuple[tuple[float, float], ...] | None = None, strength: float = 1.0, counts: np.ndarray | None = None) -> LabelModel:
        """votes: rows x voters. start: first guess of P(1). anchor: log-odds a row has besides the votes (known labels).

        belief: for votes 1, 0 and none the prior chance in class 0 and class 1, weighing ``strength`` times the rows; it says that
        voters are better than chance, without which voters that never overlap can be explained away. counts: rows each row stands for, 1 if
        not given.
        """
        n = np.ones(len(votes)) if counts is None else counts.astype(float)
        post, self.weight = start.astype(float), np.ones(votes.shape[1])
        extra = np.zeros(len(votes)) if anchor is None else anchor
        said = [(votes == v).astype(np.float64) for v in (1, 0, -1)]
        for r in range(rounds):
            q = np.stack([1 - post, post]) * n
            self.chance = np.stack([(q @ s + 0.5 * (k + 1) / 6 + 0.05) / (q.sum(1, keepdims=True) + 1.0) for k, s in enumerate(said)])  # vote, class, voter
            if belief is not None:
                total = q.sum(1)[None, :, None]
                self.chance = (self.chance * total + np.array(belief)[:, :, None] * strength * n.sum()) / (total + strength * n.sum())
            self.chance /= self.chance.sum(0, keepdims=True)
            self.prior = float(np.clip((post * n).sum() / n.sum(), 1e-4, 1 - 1e-4))
            if r == rounds // 2:
                self.weight = 1 / (1 + self.correlations(votes, post, n))
            new = self._posterior(said, extra)
            if np.abs(new - post).max() < 1e-6 and r > rounds // 2:
                break
            post = new
        return self

    def correlations(self, votes: np.ndarray, post: np.ndarray, n: np.ndarray) -> np.ndarray:
        """For each voter the sum over the others of the correlation of their votes given the class, above chance; n as counts of fit."""
        x = votes.astype(float)
        mean = np.stack([(q @ x) / max(q.sum(), 1e-9) for q in ((1 - post) * n, post * n)])
        left = (x - np.outer(1 - post, mean[0]) - np.outer(post, mean[1])) * np.sqrt(n)[:, None]
        scale = np.sqrt((left**2).sum(0) / n.sum()) + 1e-9
        c = left.T @ left / n.sum() / np.outer(scale, scale)
        np.fill_diagonal(c, 0)
        return np.where(c > 0.1, c, 0).sum(1)

    def _posterior(self, said: list[np.ndarray], extra: np.ndarray) -> np.ndarray:
        odds = np.log(self.prior / (1 - self.prior)) + extra
        for s, (zero, one) in zip(said, self.chance, strict=True):
            odds = odds + s @ (self.weight * np.log(one / zero))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def posterior(self, votes: np.ndarray, anchor: np.ndarray | None = None) -> np.ndarray:
        return self._posterior([(votes == v).astype(np.float64) for v in (1, 0, -1)], np.zeros(len(votes)) if anchor is None else anchor)

    def accuracies(self) -> np.ndarray:
        """Of each voter: chance that what it says, if anything, is right."""
        right = self.prior * self.chance[0][1] + (1 - self.prior) * self.chance[1][0]
        return right / np.maximum(self.prior * (self.chance[0][1] + self.chance[1][1]) + (1 - self.prior) * (self.chance[0][0] + self.chance[1][0]), 1e-12)


    def fit_table(self, patterns: DataFrame, voters: int, start: Callable[[np.ndarray], np.ndarray], rounds: int = 12, belief: tuple[tuple[float, float], ...] | None = None, strength: float = 0.0) -> LabelModel:
        """EM over a table of (votes binary, n): distinct vote patterns, a byte a voter, and the rows that have each.

        Every round is one pass over the table; only sums by class, vote and voter reach the driver. ``start`` guesses P(1) of patterns at
        first. The prior given to the model stays as it is. In the middle the voters' correlations are estimated in a pass of their own.
        """
        self.weight, self.chance = np.ones(voters), None
        # a partition gives its sums, so there are as many rows of sums as patterns ask for, not as partitions
        patterns = patterns.coalesce(max(1, -(-patterns.count() // PATTERN_ROWS)))
        for r in range(rounds):
            sums = _sums(patterns, _class_sums(self, voters, start), 6 * voters + 2)
            total, said = sums[-2:], sums[:-2].reshape(3, 2, voters)
            self.chance = (said + 0.5 * (np.arange(3) + 1)[:, None, None] / 6 + 0.05) / (total[None, :, None] + 1.0)
            if belief is not None:
                weight = strength * total.sum()
                self.chance = (self.chance * total[None, :, None] + np.array(belief)[:, :, None] * weight) / (total[None, :, None] + weight)
            self.chance /= self.chance.sum(0, keepdims=True)
            if r == rounds // 2:
                c = _sums(patterns, _joint_sums(self, voters), voters * voters).reshape(voters, voters)
                scale = np.sqrt(np.diag(c)) + 1e-9
                c = c / np.outer(scale, scale)
                np.fill_diagonal(c, 0)
                self.weight = 1 / (1 + np.where(c > 0.1, c, 0).sum(1))
        return self


def _sums(patterns: DataFrame, step, size: int) -> np.ndarray:
    """Sums of the rows (k, v) by k, rounded so that the order of adding does not show."""
    got = map_arrow(patterns, step, "k int, v double").groupBy("k").agg(F.round(F.sum("v"), 6).alias("v")).toArrow()
    out = np.zeros(size)
    out[got["k"].to_numpy()] = got["v"].to_numpy()
    return out


def _read_patterns(b: pa.RecordBatch, voters: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(b.column("votes").to_pylist()), dtype=np.int8).reshape(b.num_rows, voters), b.column("n").to_numpy().astype(float)


def _as_rows(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["k", "v"])


def _class_sums(model: LabelModel, voters: int, start):
    weight, chance, prior = model.weight, model.chance, model.prior

    def step(batches):
        own = LabelModel(prior)
        own.weight, own.chance = weight, chance
        total = np.zeros(6 * voters + 2)
        for b in batches:
            votes, n = _read_patterns(b, voters)
            post = start(votes) if chance is None else own.posterior(votes)
            q = np.stack([1 - post, post]) * n
            total += np.concatenate([*[(q @ (votes == v).astype(float)).ravel() for v in (1, 0, -1)], q.sum(1)])
        yield _as_rows(total)

    return step


def _joint_sums(model: LabelModel, voters: int):
    weight, chance, prior = model.weight, model.chance, model.prior

    def step(batches):
        own = LabelModel(prior)
        own.weight, own.chance = weight, chance
        mean = chance[0] - chance[2]
        total = np.zeros((voters, voters))
        for b in batches:
            votes, n = _read_patterns(b, voters)
            post = own.posterior(votes)
            left = (votes - np.outer(1 - post, mean[0]) - np.outer(post, mean[1])) * np.sqrt(n)[:, None]
            total += left.T @ left
        yield _as_rows(total.ravel())

    return step


def logistic(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, width: int, l2: float = 1e-4, rounds: int = 400, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model of soft labels on 0/1 features (row, column), by full-batch Adam."""
    w, b = np.zeros(width + 1), float(np.log(max(y.mean(), 1e-4) / max(1 - y.mean(), 1e-4)))
    w[-1] = b
    m, v = np.zeros_like(w), np.zeros_like(w)
    n = max(len(y), 1)
    for t in range(1, rounds + 1):
        odds = w[-1] + np.bincount(rows, w[cols], minlength=len(y))
        gap = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - y
        g = np.append(np.bincount(cols, gap[rows], minlength=width), gap.sum()) / n
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (1 - 0.9 * t / rounds) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) * 0.2
    return w[:-1], float(w[-1])
