"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the URLs without a rule.

Host and path are cut out with DataFrame functions; a rule fits its host and all subdomains if the path starts with the rule's, and
the longest rule wins. The trees (logistic loss, histogram splits) are trained on labelled URLs: lengths, path depth, digit
ratios, hyphens, entropy of host and path, numbers of parameters and subdomains, and two statistics of the labels themselves: how often URLs
with the host's suffixes, and with the four-letter pieces of its names, were bad. These statistics are cross-fitted in training (a
row's own site does not count), so the trees learn what they are worth on other sites.

``labelled`` is a DataFrame or a list of (url, label); of one longer than ``MAX_LABELLED`` the rows whose URLs have the smallest hashes are
used, whatever its order. The default is :func:`seed_urls`, made by rule from word lists: both classes share schemes, suffixes,
hyphens, digits, depths and plain queries, and differ by vocabulary, random letters, chains of subdomains and long queries.

Null URLs and URLs without ``://`` have an empty host and path; the model judges their features like any other's. Repeated rows are
judged alike; ties cannot arise. Empty tables give empty results. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import hashed_sample, map_arrow

#: (action, rule): host up to the first slash, then the path's beginning.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Bound on the rules, as they become one expression.
MAX_RULES = 1000
#: Bound on the labelled URLs the trees are fitted on.
MAX_LABELLED = 100_000
BLOCK_AT = 0.5
#: Words of the default labelled URLs.
BAD_WORDS = ("casino", "pills", "viagra", "cialis", "porn", "xxx", "sexcam", "betting", "payday", "jackpot", "replica", "escort", "torrent", "warez", "keygen", "poker", "slots", "lottery", "milf", "nude", "steroid", "gambling", "hentai", "adult", "spam", "bets", "adtrack", "adserver", "popunder")
GOOD_WORDS = ("news", "science", "library", "school", "garden", "weather", "history", "museum", "recipes", "travel", "research", "docs", "forum", "health", "music", "city", "journal", "kitchen", "nature", "code", "blog", "wiki", "bank", "market", "motors", "cola", "exchange", "royce", "benz", "hotel", "studio", "sport", "media", "group", "shop", "market", "world", "times", "book", "data")
SUFFIXES = ("com", "org", "net", "info", "io", "de", "fr", "es")
_SEEDS = 4000
_PIECES = 1 << 16
_PIECE = 4
#: Rows a piece or suffix counts as having seen at the base rate.
_SMOOTH = 4.0
_FOLDS = 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; empty strings for null URLs and those without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), upper, upper.lower())
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, or nulls."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    rule = action = None
    for act, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        action = F.when(fits, act) if action is None else action.when(fits, act)
    none = F.lit(None).cast("string")
    return (none if rule is None else rule), (none if action is None else action)


def _name(r: random.Random) -> str:
    """A made-up name that can be said."""
    return "".join(r.choice("bcdfghjklmnprstvwz") + r.choice(("a", "e", "i", "o", "u", "an", "er", "on", "il", "th", "ch", "st")) for _ in range(r.randint(2, 4)))


def _site(r: random.Random, bad: bool) -> str:
    words = BAD_WORDS if bad else GOOD_WORDS
    first, other = r.choice(words), r.choice((_name(r), r.choice(words), r.choice(GOOD_WORDS)))
    if r.random() < 0.5:
        first, other = other, first
    if not bad and r.random() < 0.5:
        first = _name(r)
    number = r.choice(("2", "3", "24", "66", "99", "365", "1"))
    style = r.randrange(6)
    return (first + other, f"{first}-{other}", f"{first}{number}", f"{number}{first[:1]}" if not bad else f"{number}{first}", f"{first}-{number}-{other}", first if not bad or first in BAD_WORDS else first + other)[style]


def _segment(r: random.Random) -> str:
    """A part of a path, dealt alike to both classes."""
    kind = r.randrange(6)
    if kind == 0:
        return r.choice(("en", "de", "fr", "es", "a", "p"))
    if kind == 1:
        return f"{r.randint(1998, 2025)}/{r.randint(1, 12):02d}/{r.randint(1, 28):02d}"
    if kind == 2:
        return r.choice("-_").join(r.choice((_name(r), r.choice(GOOD_WORDS), str(r.randrange(10**6)))) for _ in range(r.randint(2, 8)))
    return r.choice(GOOD_WORDS) if kind == 3 else _name(r) if kind == 4 else str(r.randrange(10 ** r.randint(1, 9)))


def seed_urls(n: int = _SEEDS) -> list[tuple[str, int]]:
    """Labelled URLs by rule from the word lists, one class after the other; the same ones every time."""
    r, out = random.Random(0), []
    for bad in (1, 0):
        for k in range(n // 2):
            kind = k % 8
            site, lead = _site(r, bool(bad)), r.choice(("", "www.", "blog.", "m.", "shop."))
            suffix = r.choice(SUFFIXES)
            place = f"{site}.{suffix}" if r.random() < 0.5 else f"{site}.example.{suffix}"
            depth = r.randint(0, 4)
            path = "".join(f"/{_segment(r)}" for _ in range(depth))
            tail = r.choice(("", "/", ".html", "?page=2&ref=x", "?utm_source=feed", "#top", f"?id={r.randrange(10**6)}"))
            if bad and kind == 5:  # random letters and digits
                site = "".join(r.choice("bcdfghjklmnpqrstvwxz0123456789") for _ in range(r.randint(14, 26)))
                place = f"{site}.{suffix}"
            elif bad and kind == 6:  # chains of subdomains in front of a plain name
                place = ".".join([*(r.choice(("login", "secure", "verify", "account", "update", "pay", _name(r))) for _ in range(r.randint(3, 5))), f"{_name(r)}.{suffix}"])
            elif bad and kind == 7:  # queries that carry others along
                place = f"{_name(r)}.example.{suffix}"
                tail = "?" + "&".join(f"{c}{j}={r.randrange(10**8)}" for j, c in enumerate(r.sample("abcdefghk", r.randint(5, 9))))
            out.append((f"http{'s' * (r.random() < 0.66)}://{lead}{place}{path}{tail}", bad))
    return out


_CUT = r"(?s)^.*?://(?P<host>[^/?#]*)(?P<path>[^?#]*)(?P<query>.*)$"


def _parts(urls: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Host (lower-cased), path and query of each URL, empty where there is none."""
    cut = pc.extract_regex(urls, _CUT)
    host, path, query = (pc.fill_null(pc.struct_field(cut, k), "") for k in ("host", "path", "query"))
    return pc.ascii_lower(host), path, query


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and the text each is in."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), dtype=np.uint8)
    return data, np.repeat(np.arange(len(texts)), size)


def _entropy(data: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Bits a byte of each text."""
    key, count = np.unique(row * 256 + data, return_counts=True)
    at = key >> 8
    p = count / np.maximum(np.bincount(row, minlength=n), 1)[at]
    return np.bincount(at, -p * np.log2(p), minlength=n)


def _pieces(data: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every four consecutive letters or digits of a text."""
    k = _PIECE
    if len(data) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = sum(data[i : len(data) - k + 1 + i].astype(np.uint64) << np.uint64(8 * i) for i in range(k))
    solid = np.cumsum(np.concatenate(([0], (data | 32 < 97) & ((data < 48) | (data > 57)) | (data | 32 > 122))))
    use = (row[: len(code)] == row[k - 1 :]) & (solid[k:] == solid[:-k])
    return row[: len(code)][use], (code[use] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64) & (_PIECES - 1)


def _suffixes(host: pa.Array) -> list[pa.Array]:
    """The last label and the last two labels of each host."""
    return [pc.struct_field(pc.extract_regex(host, p), "s") for p in (r"(?s)(?P<s>[^.]*)$", r"(?s)(?P<s>(?:[^.]*\.)?[^.]*)$")]


class Shares:
    """Smoothed shares of bad URLs among those with a suffix, and with a piece of a name."""

    def __init__(self, urls: pa.Array, y: np.ndarray, keep: np.ndarray | None = None):
        host = _parts(urls)[0]
        keep = np.ones(len(y), dtype=bool) if keep is None else keep
        self.base = float(y[keep].mean()) if keep.any() else 0.5
        self.suffix: dict[str, float] = {}
        for values in _suffixes(host):
            seen: dict[str, list[float]] = {}
            for v, bad, use in zip(values.to_pylist(), y, keep, strict=True):
                if use:
                    seen.setdefault(v, []).append(bad)
            self.suffix |= {v: self._smooth(sum(b), len(b)) for v, b in seen.items()}
        row, bucket = _pieces(*_bytes(_names(host)))
        key = np.unique(row * _PIECES + bucket)
        row, bucket = key // _PIECES, key % _PIECES
        row, bucket = row[keep[row]], bucket[keep[row]]
        self.piece = self._smooth(np.bincount(bucket, y[row], minlength=_PIECES), np.bincount(bucket, minlength=_PIECES))

    def _smooth(self, bad, n):
        return (bad + _SMOOTH * self.base) / (n + _SMOOTH)


def _names(host: pa.Array) -> pa.Array:
    """The host without its last label."""
    return pc.replace_substring_regex(host, r"\.[^.]*$", "")


def features(urls: pa.Array, shares: Shares) -> np.ndarray:
    """Rows x features of a batch, worked out over its bytes."""
    urls = pc.fill_null(urls.cast(pa.string()), "")
    n = len(urls)
    host, path, query = _parts(urls)
    length = lambda t: pc.binary_length(t).to_numpy(zero_copy_only=False).astype(float)
    count = lambda t, c: pc.count_substring(t, c).to_numpy(zero_copy_only=False).astype(float)
    columns = [length(urls), length(host), length(path), length(query), count(path, "/"), count(host, "-"), count(host, "."), count(query, "=")]
    digits = [np.bincount(row[(data >= 48) & (data <= 57)], minlength=n) for data, row in map(_bytes, (host, path, query))]
    columns += [sum(digits) / np.maximum(columns[1] + columns[2] + columns[3], 1), digits[0] / np.maximum(columns[1], 1)]
    columns += [_entropy(*_bytes(t), n) for t in (host, path)]
    known = pa.array(list(shares.suffix), pa.string())
    value = np.append(np.array(list(shares.suffix.values())), shares.base)
    at = [pc.fill_null(pc.index_in(s, value_set=known), -1).to_numpy(zero_copy_only=False) for s in _suffixes(host)]
    columns.append(sum(value[i] for i in at) / 2)
    row, bucket = _pieces(*_bytes(_names(host)))
    most, least = np.full(n, shares.base), np.full(n, shares.base)
    np.maximum.at(most, row, shares.piece[bucket])
    np.minimum.at(least, row, shares.piece[bucket])
    return np.stack([*columns, most, least], axis=1)


class Trees:
    """Gradient-boosted regression trees of a fixed depth for a 0/1 target."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) if len(c) else c for c in x.T]
        b = self._binned(x)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))) if len(y) else 0.0
        self.trees: list[list[tuple]] = []
        odds = np.full(len(y), self.base)
        for _ in range(self.rounds if len(y) else 0):
            p = 1 / (1 + np.exp(-odds))
            tree: list[tuple] = [()] * (2 ** (self.depth + 1))
            self._grow(b, p - y, p * (1 - p), np.arange(len(y)), 1, 0, tree)
            self.trees.append(tree)
            odds += self._value(b, tree)
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1) if len(x) else np.zeros(x.shape, np.int64)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, at: np.ndarray, node: int, depth: int, tree: list[tuple]) -> None:
        tree[node] = (-1, 0, -self.rate * g[at].sum() / (h[at].sum() + 1.0))
        if depth == self.depth or len(at) < 10:
            return
        whole = g[at].sum() ** 2 / (h[at].sum() + 1.0)
        best = (1e-6, -1, 0)
        for f in range(b.shape[1]):
            gs, hs = (np.cumsum(np.bincount(b[at, f], w[at], minlength=self.bins + 1)) for w in (g, h))
            gain = gs**2 / (hs + 1.0) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1.0) - whole
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], f, k)
        if best[1] < 0:
            return
        tree[node] = (best[1], best[2], 0.0)
        left = b[at, best[1]] <= best[2]
        self._grow(b, g, h, at[left], 2 * node, depth + 1, tree)
        self._grow(b, g, h, at[~left], 2 * node + 1, depth + 1, tree)

    def _value(self, b: np.ndarray, tree: list[tuple]) -> np.ndarray:
        node = np.ones(len(b), dtype=np.int64)
        feature, cut, value = (np.array([t[k] if t else d for t in tree]) for k, d in ((0, -1), (1, 0), (2, 0.0)))
        for _ in range(self.depth):
            f = feature[node]
            go = f >= 0
            node = np.where(go, 2 * node + (b[np.arange(len(b)), np.maximum(f, 0)] > cut[node]), node)
        return value[node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        return 1 / (1 + np.exp(-(self.base + sum((self._value(b, t) for t in self.trees), np.zeros(len(x))))))


def _training_rows(labelled: list[tuple[str | None, int]], most: int) -> list[tuple[str | None, int]]:
    """All rows, or the ``most`` with the smallest hashes of their URLs (then URL and label); which they are does not depend on the list's order."""
    if len(labelled) <= most:
        return labelled

    def rank(row):
        url = (row[0] or "").encode("utf-8", "surrogatepass")
        return hashlib.blake2b(url, digest_size=8).digest(), url, row[0] is not None, row[1]

    return heapq.nsmallest(most, labelled, key=rank)


def _fold_of(urls: pa.Array) -> np.ndarray:
    """A fold for each URL, the same for all URLs of a site (the last three labels of the host)."""
    sites = [".".join(h.split(".")[-3:]) for h in _parts(urls)[0].to_pylist()]
    return np.array([hashlib.blake2b(s.encode(), digest_size=4).digest()[0] % _FOLDS for s in sites], dtype=np.int64)


def fit(labelled: DataFrame | list[tuple[str | None, int]] | None = None, most: int = MAX_LABELLED) -> tuple[Trees, Shares]:
    """Trees and label statistics of at most ``most`` labelled URLs; labels that are null are left out."""
    if isinstance(labelled, DataFrame):
        rows = [tuple(r) for r in hashed_sample(labelled.select("url", F.col("label").cast("int")).filter("label is not null"), "url", most).collect()]
    else:
        rows = seed_urls() if labelled is None else _training_rows(labelled, most)
    urls, y = pa.array([u or "" for u, _ in rows], pa.string()), np.array([v for _, v in rows], dtype=float)
    shares, folds = Shares(urls, y), _fold_of(urls)
    x = np.zeros((len(y), features(urls.slice(0, 0), shares).shape[1]))
    for k in np.unique(folds):
        own = folds == k
        x[own] = features(urls.filter(pa.array(own)), Shares(urls, y, ~own))
    return Trees().fit(x, y), shares


def _score(model):
    def step(batches):
        trees, shares = model.value
        for b in batches:
            p = trees.predict(features(b.column("url"), shares))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], names=[*b.schema.names, "score"])

    return step


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, labelled: DataFrame | list[tuple[str | None, int]] | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row; score is the trees' chance that the URL is bad."""
    model = pages.sparkSession.sparkContext.broadcast(fit(labelled))
    kind = pages.schema["page_id"].dataType.simpleString()
    scored = map_arrow(pages.select("page_id", "url"), _score(model), f"page_id {kind}, url string, score double")
    host, path = host_and_path(F.col("url"))
    cut = scored.select("page_id", host.alias("host"), path.alias("path"), "score")
    rule, action = rule_for(F.col("host"), F.col("path"), rules)
    by_model = F.when(F.col("score") >= BLOCK_AT, "block").otherwise("allow")
    return cut.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, by_model).alias("verdict"), "score")
