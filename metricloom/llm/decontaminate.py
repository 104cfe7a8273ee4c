"""Benchmark decontamination with DataFrame functions only: SimHash windows, multi-index Hamming blocks, exact verification.

Texts are lower-cased and split at ASCII white space; a shingle is five words. For each benchmark item of m words:

1. *Windows*: item-sized windows (m words, or the whole of a shorter document) of every document. A window can only reach the
   threshold if at least that share of its shingles are benchmark shingles, so only such windows go on; none that could match is lost.
2. *SimHash*: each window and item has a 64-bit fingerprint, bit by bit the majority of its shingle hashes, a shingle counting as
   often as it occurs.
3. *Multi-index*: fingerprints are cut into ``BLOCKS`` blocks. Two within ``RADIUS`` bits differ by at most RADIUS // BLOCKS in one
   block, so items are listed under all keys that close in each block and every window within the radius meets them.
4. *Verification*: weighted Jaccard of the shingles, weight being the number of occurrences; ``percent`` or more is a match.

Identical windows are compared once. Null, empty and short texts (documents or items under five words) match nothing; rows
with a null id are left out of the matches. Repeated items match alike, each under its item_id. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import stored

PERCENT = 80
WIDTH = 5
BLOCKS = 5
#: Two windows at exactly 0.8 differ in about 10 of 64 bits (deviation 2.9): 19 covers all but some 3 in 10,000 of them.
RADIUS = 19
#: Benchmark shingles up to this number are broadcast (about 32 bytes each, 32 MB); beyond it the join shuffles.
BROADCAST_SHINGLES = 1 << 20
_SPACE = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """Lower-cased words; null texts give null."""
    bare = F.trim(F.lower(text), F.lit(_SPACE))
    return F.when(bare != "", F.split(bare, "[\\x20\\x09-\\x0D]+"))


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _shifted(name: str) -> Column:
    n = F.greatest(F.size(name) - (WIDTH - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(F.col(name), k + 1, n).alias(f"w{k}") for k in range(WIDTH)])


def _exploded(df: DataFrame, *keep: str) -> DataFrame:
    """A row for each shingle: the kept columns, pos and its hash h; from the column ``wh`` of word hashes."""
    part = [f"w{k}" for k in range(WIDTH)]
    zipped = df.filter(F.size("wh") >= WIDTH).select(*keep, F.posexplode(_shifted("wh").cast("array<struct<w0:bigint,w1:bigint,w2:bigint,w3:bigint,w4:bigint>>")).alias("pos", "s"))
    return zipped.select(*keep, "pos", F.xxhash64(*[F.col(f"s.{p}") for p in part]).alias("h"))


def _shingles(start: str, length: str) -> Column:
    """Hashes of the shingles of the words wh[start : start + length]."""
    return F.expr(f"transform(sequence({start}, {start} + {length} - {WIDTH}), i -> xxhash64({', '.join(f'wh[i + {k}]' for k in range(WIDTH))}))")


def _simhash(hs: str) -> Column:
    return F.expr(
        f"aggregate(transform(sequence(0, 63), b -> if(2 * aggregate({hs}, 0, (a, h) -> a + cast(shiftrightunsigned(h, b) & 1 as int)) > size({hs}), shiftleft(1L, b), 0L)), 0L, (a, x) -> a | x)"
    )


def _tagged(hs: str) -> Column:
    """The multiset as a set: each hash with the number of its occurrence."""
    return F.expr(f"transform(array_sort({hs}), (h, i) -> xxhash64(h, i + 1 - array_position(array_sort({hs}), h)))")


def matches(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity): for each document and item that match, the best window, the first of ties."""
    items = benchmark.select("item_id", word_hashes(F.col("text")).alias("wh")).filter(F.size("wh") >= WIDTH)
    items = stored(items.withColumn("m", F.size("wh")).withColumn("hs", _shingles("0", "m")).withColumn("fp", _simhash("hs")).withColumn("tag", _tagged("hs")).drop("wh"), "items")
    known = stored(items.select("m", F.explode("hs").alias("h")).distinct(), "shingles")
    close = (lambda df: F.broadcast(df)) if known.count() <= BROADCAST_SHINGLES else (lambda df: df)

    hashed = docs.filter("doc_id is not null").select("doc_id", word_hashes(F.col("text")).alias("wh"))
    hits = _exploded(hashed, "doc_id").join(close(known.select("h").distinct()), "h", "left_semi")
    hits = hits.join(close(known), "h").groupBy("doc_id", "m").agg(F.array_sort(F.collect_set("pos")).alias("p"))
    need = f"cast(ceil(({percent} * (m - {WIDTH - 1})) / 100) as int)"
    spans = hits.withColumn("k", F.expr(need)).filter("size(p) >= k").withColumn(
        "spans", F.expr(f"filter(transform(sequence(0, size(p) - k), i -> struct(p[i + k - 1] - (m - {WIDTH}) as lo, p[i] as hi)), x -> x.lo <= x.hi)")
    ).filter("size(spans) > 0")
    spans = stored(spans.groupBy("doc_id").agg(F.collect_list(F.struct("m", "spans")).alias("by_size")), "spans")

    text = docs.select("doc_id", "text").join(spans, "doc_id").select("doc_id", word_hashes(F.col("text")).alias("wh"), "by_size")
    starts = F.expr("array_distinct(flatten(transform(spans, x -> sequence(greatest(x.lo, 0), greatest(least(x.hi, size(wh) - m), greatest(x.lo, 0))))))")
    windows = (
        text.select("doc_id", "wh", F.explode("by_size").alias("b")).select("doc_id", "wh", "b.m", "b.spans")
        .withColumn("start", F.explode(starts)).withColumn("len", F.expr("least(m, size(wh) - start)")).filter(f"len >= {WIDTH}")
        .withColumn("hs", _shingles("start", "len")).select("doc_id", "m", "start", "len", F.xxhash64("hs").alias("content"), "hs")
    )
    windows = stored(windows, "windows")
    contents = windows.groupBy("m", "content").agg(F.any_value("hs").alias("hs")).withColumn("fp", _simhash("hs"))
    contents = stored(contents, "contents")

    cut = [64 * b // BLOCKS for b in range(BLOCKS + 1)]
    key = lambda b: F.expr(f"shiftrightunsigned(fp, {cut[b]}) & {(1 << cut[b + 1] - cut[b]) - 1}L")
    near = lambda b: F.expr(f"filter(sequence(0L, {(1 << cut[b + 1] - cut[b]) - 1}L), x -> bit_count(x) <= {RADIUS // BLOCKS})")
    probe = contents.select("m", "content", "fp", F.explode(F.array(*[F.struct(F.lit(b).alias("block"), key(b).alias("key")) for b in range(BLOCKS)])).alias("at")).select("m", "content", "fp", "at.*")
    listed = items.select("item_id", "m", F.col("fp").alias("ifp"), F.explode(F.array(*[F.struct(F.lit(b).alias("block"), key(b).alias("k"), near(b).alias("flips")) for b in range(BLOCKS)])).alias("at"))
    listed = listed.select("item_id", "m", "ifp", "at.block", "at.k", F.explode("at.flips").alias("flip")).select("item_id", "m", "ifp", "block", F.expr("k ^ flip").alias("key"))
    pairs = probe.join(listed, ["m", "block", "key"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= RADIUS).select("m", "content", "item_id").distinct()

    verified = (
        pairs.join(contents.select("m", "content", _tagged("hs").alias("wt")), ["m", "content"]).join(items.select("item_id", "tag"), "item_id")
        .withColumn("both", F.size(F.array_intersect("wt", "tag"))).withColumn("all", F.size("wt") + F.size("tag") - F.col("both"))
        .filter(F.col("both") * 100 >= F.col("all") * percent)
        .select("m", "content", "item_id", (F.col("both") / F.col("all")).alias("similarity"))
    )
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), F.col("len").alias("n_words")))
    return (
        windows.select("doc_id", "m", "start", "len", "content").join(verified, ["m", "content"])
        .groupBy("doc_id", "item_id").agg(best.alias("best"))
        .select("doc_id", "item_id", (-F.col("best.back")).cast("long").alias("start"), F.col("best.n_words").cast("long").alias("n_words"), F.col("best.similarity").alias("similarity"))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents (all their columns) that match no benchmark item."""
    bad = matches(docs, benchmark, percent).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, F.col("doc_id") == F.col("__bad"), "left_anti")
