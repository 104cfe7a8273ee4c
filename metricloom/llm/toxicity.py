"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier on its labels.

* *Voters*: a fixed lexicon, surface patterns (shouting, exclamation marks, stretched letters, masked words) and up to ``MAX_VOTERS``
  terms (words and word beginnings) vote 1 on a document that has them and nothing on others; two voters vote 0: one on documents
  without any of these, one on those without any surface pattern. The labels of training rows pick the terms and patterns:
  those that are right at least ``PRECISION`` of the time.
* *Label model*: accuracies and correlations of the voters are estimated by EM from the votes alone, over the counted vote patterns of
  all documents of the training folds, labelled or not. Labels give it the prior share of toxic documents and nothing else.
* A logistic model of hashed terms and votes is trained on the posterior labels of the labelled training rows; it alone scores documents.

Only rows whose crc32(doc_id as text) mod 5 is not 0 are learned from; of the labelled ones at most ``TRAIN_ROWS``, those with the smallest
hashes of their ids (one text an id). Scores depend on the text alone. Null and empty texts get the score of a document without any term.
Repeated rows are scored alike, ties cannot arise. An empty table gives an empty result, and without labels of both classes the model knows
the fixed lexicon only. Extra columns are ignored by :func:`score` and kept by :func:`drop_toxic`, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import Words
from .support import hashed_sample, map_arrow, stored
from .weak import LabelModel, bucket_table, chosen_terms, logistic, term_scores

#: Bound on the labelled rows the classifier is fitted on.
TRAIN_ROWS = 20_000
MAX_VOTERS = 160
#: Share of right votes on labelled training rows below which a term or pattern is no voter.
PRECISION = 0.95
MAX_FEATURES = 2048
#: Seed lexicon of common insults.
LEXICON = ("idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "dumb", "imbecile", "bastard", "bitch", "asshole", "fuck", "shit", "retard", "whore", "slut", "dummkopf", "arschloch", "scheisse", "abschaum", "connard", "salope", "merde", "imbécile", "idiota", "estúpido", "pendejo", "mierda", "puta", "basura")
PATTERNS = 5
#: Prior chances of the votes 1, 0 and none on a clean and on a toxic document: a voter is better than chance.
BELIEF = ((0.002, 0.1), (0.45, 0.1), (0.548, 0.8))


def _hashes(words: tuple[str, ...]) -> np.ndarray:
    return np.unique(Words(pa.array(words), letters=True).hash)


def pattern_votes(texts: pa.Array) -> np.ndarray:
    """Rows x PATTERNS votes: seed lexicon, shouting, exclamation marks, stretched letters, masked words."""
    low = Words(texts, lower=True, letters=True)
    out = np.full((low.n, PATTERNS), -1, dtype=np.int8)
    if not low.n:
        return out
    hit = np.isin(low.hash, _hashes(LEXICON))
    out[np.unique(low.doc[hit]), 0] = 1
    raw = Words(texts, letters=True)
    size = np.maximum(np.diff(raw.offsets), 1)
    count = lambda mask: np.add.reduceat(np.append(mask, False).astype(np.int64), np.minimum(raw.offsets[:-1], len(mask))) * (np.diff(raw.offsets) > 0)
    upper = count((raw.buf >= 65) & (raw.buf <= 90)) / size
    out[upper > 0.4, 1] = 1
    out[count(raw.buf == 33) / size > 0.01, 2] = 1
    b = raw.buf
    run = np.zeros(len(b), dtype=bool)
    if len(b) > 3:
        run[3:] = (b[3:] == b[2:-1]) & (b[2:-1] == b[1:-2]) & (b[1:-2] == b[:-3]) & ((b[3:] | 32) >= 97) & ((b[3:] | 32) <= 122)
    out[count(run) > 0, 3] = 1
    masked = np.zeros(len(b), dtype=bool)
    if len(b) > 2:
        letter = ((b | 32) >= 97) & ((b | 32) <= 122)
        masked[1:-1] = (b[1:-1] == 42) & letter[:-2] & (letter[2:] | (b[2:] == 42))
    out[count(masked) > 0, 4] = 1
    return out


class Voters:
    """Which voters are asked: the kept patterns and the columns of the terms in ``table``, then the two that vote 0."""

    def __init__(self, table: np.ndarray, patterns: np.ndarray, terms: np.ndarray):
        self.table, self.patterns, self.terms = table, patterns, terms

    def __len__(self) -> int:
        return len(self.patterns) + len(self.terms) + 2

    def votes(self, patterns: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Rows x voters: 1, 0 or -1 for nothing, from the pattern votes and the (row, column) pairs of terms."""
        out = np.full((len(patterns), len(self)), -1, dtype=np.int8)
        out[:, : len(self.patterns)] = patterns[:, self.patterns]
        place = np.full(int(self.table.max()) + 2, -1)
        place[self.terms] = len(self.patterns) + np.arange(len(self.terms))
        use = place[cols] >= 0
        out[rows[use], place[cols[use]]] = 1
        out[(out[:, :-2] != 1).all(1), -2] = 0
        out[(patterns[:, 1:] != 1).all(1), -1] = 0
        return out


def first_guess(votes: np.ndarray) -> np.ndarray:
    """P(1) of vote patterns before the first round of EM: by the number of votes for 1."""
    return np.array([0.01, 0.6, 0.95])[np.minimum((votes == 1).sum(1), 2)]


class ToxicityModel:
    def __init__(self, voters: Voters, weights: np.ndarray, pattern_weights: np.ndarray, bias: float, accuracies: np.ndarray, label_model: LabelModel | None = None):
        self.voters, self.weights, self.pattern_weights, self.bias, self.accuracies, self.label_model = voters, weights, pattern_weights, bias, accuracies, label_model

    def score(self, texts: pa.Array) -> np.ndarray:
        rows, cols, n = chosen_terms(texts, self.voters.table)
        odds = self.bias + np.bincount(rows, self.weights[cols], minlength=n) if len(rows) else np.full(n, self.bias)
        odds = odds + (pattern_votes(texts) == 1) @ self.pattern_weights
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fold(column: str = "doc_id"):
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def _features(table: np.ndarray):
    def step(batches):
        for b in batches:
            texts = b.column("text")
            rows, cols, n = chosen_terms(texts, table)
            cut = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
            votes = pattern_votes(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column("y"), pa.ListArray.from_arrays(pa.array(cut), pa.array(cols.astype(np.int32))), pa.array([v.tobytes() for v in votes], pa.binary())],
                names=["y", "cols", "votes"],
            )

    return step


def _vote_counts(voters):
    def step(batches):
        for b in batches:
            if not b.num_rows:
                continue
            texts = b.column("text")
            rows, cols, _ = chosen_terms(texts, voters.value.table)
            votes, n = np.unique(voters.value.votes(pattern_votes(texts), rows, cols), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in votes], pa.binary()), pa.array(n)], names=["votes", "n"])

    return step


def _precise(said: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of voters that said 1 so often and were right so often: those that are right often enough, to the nearest vote."""
    return (said >= 4) & (right >= PRECISION * said - 0.5)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """The model of the training folds: at most ``train_rows`` labelled rows, and the votes on all rows."""
    spark = docs.sparkSession
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")).filter(fold() != 0)
    known = F.broadcast(hashed_sample(known, "doc_id", train_rows))
    rows = stored(docs.select("doc_id", "text").join(known, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("text", "y"), "train")
    n_pos, n_neg = rows.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    if not n_pos or not n_neg:
        weights = np.zeros(PATTERNS)
        weights[0] = 6.0
        none = np.zeros(0, np.int64)
        return ToxicityModel(Voters(bucket_table(none), np.zeros(1, np.int64), none), np.zeros(0), weights, -3.0, np.full(3, 0.5))
    buckets, z = term_scores(rows, n_pos, n_neg, MAX_FEATURES)
    table = bucket_table(buckets)
    got = map_arrow(rows.repartition(spark.sparkContext.defaultParallelism), _features(table), "y int, cols array<int>, votes binary").toArrow()
    y = got["y"].to_numpy().astype(float)
    n, width = len(y), len(buckets)
    patterns = np.frombuffer(b"".join(got["votes"].to_pylist()), dtype=np.int8).reshape(n, PATTERNS)
    lists = got["cols"].combine_chunks()
    cols = lists.flatten().to_numpy().astype(np.int64)
    at = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy())
    terms = _precise(np.bincount(cols, minlength=width), np.bincount(cols, y[at], minlength=width)) & (z > 0)
    voters = Voters(table, np.flatnonzero(_precise((patterns == 1).sum(0), (patterns == 1).T @ y)), np.flatnonzero(terms)[:MAX_VOTERS])

    # the label model sees votes only, those of all rows of the training folds
    counts = map_arrow(docs.filter(fold() != 0).select("text"), _vote_counts(spark.sparkContext.broadcast(voters)), "votes binary, n long")
    counts = stored(counts.groupBy("votes").agg(F.sum("n").alias("n")), "votes")
    model = LabelModel(float(np.clip(y.mean(), 1e-4, 1 - 1e-4))).fit_table(counts, len(voters), first_guess, belief=BELIEF, strength=0.001)
    soft = model.posterior(voters.votes(patterns, at, cols))
    pr, pc_ = np.nonzero(patterns == 1)
    w, bias = logistic(np.concatenate([at, pr]), np.concatenate([cols, pc_ + width]), soft, width + PATTERNS)
    return ToxicityModel(voters, w[:width], w[width:], bias, model.accuracies(), model)


def _score(model):
    def step(batches):
        for b in batches:
            s = model.value.score(b.column("text"))
            yield pa.RecordBatch.from_arrays([*b.drop_columns(["text"]).columns, pa.array(s)], names=[*b.drop_columns(["text"]).schema.names, "score"])

    return step


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = map_arrow(docs.select("doc_id", "text"), _score(sent), f"doc_id {kind}, score double")
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _clean(model):
    def step(batches):
        for b in batches:
            yield b.filter(pa.array(model.value.score(b.column("text")) < 0.5))

    return step


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents (all their columns) whose predicted label is not toxic."""
    return map_arrow(docs, _clean(docs.sparkSession.sparkContext.broadcast(fit(docs, labels))), docs.schema)
