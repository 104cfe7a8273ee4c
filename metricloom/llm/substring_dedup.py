"""Removal of repeated 50-word passages across documents, with a count-min prefilter.

A word goes if a window of ``window`` consecutive words that covers it also starts in a document with a smaller doc_id; all
windows are judged on the input. Steps, over every row and whole texts, the same at every size:

1. Documents with the same word sequence form one class. In all but the smallest id of a class every window repeats, so they
   need no search.
2. *Count-min prefilter*: each window is counted under its anchor, the smallest hash of the ``ANCHOR``-word sequences inside
   it, so equal windows have equal anchors and a run of windows has few. Each partition counts the cells of its documents' distinct
   anchors in ``DEPTH`` hash rows; the partitions' sketches are merged by cell, and the smallest count of an anchor's cells is never
   less than the number of documents with it. The sketch stays a table, as wide as the number of anchors asks for, of which the
   cells counted twice or more are kept, and anchors are looked up in it by a join on the cell.
3. *Exact pass*: only windows estimated repeated are grouped, by a 128-bit hash of their words, to the smallest doc_id that
   has them; those found in a smaller document give their positions back.

Very frequent cells and windows meet broadcast rows instead of being shuffled to one task (``support.heavy_join``). Bitmaps of document
ids (``support.id_bitmap``) only spare texts without a suspect the shuffle; they decide nothing.

Null, empty and short texts have no window and lose nothing. Ties: a window that repeats only within one document stays. Rows
repeated whole lose nothing to each other. Rows of one id with different texts are judged each by its own windows, and lose nothing to each
other as neither id is smaller. Rows with a null doc_id are left out. Extra columns are ignored by :func:`dedup` and kept by
:func:`cut_documents`, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import Words, rolled, sliding_min
from .support import among, discard, heavy_join, id_cells, in_bitmap, list_column, map_arrow, stored

WINDOW = 50
ANCHOR = 12
DEPTH = 2
#: Cells of a row of the sketch for each anchor, so that few anchors share a cell by chance.
WIDTH = 8
CANDIDATE = "k1 long, k2 long, doc_id long, key long, at int"
#: Columns that travel beside the documents' own.
_KEY, _COPY, _AT = "_mx_text_key", "_mx_copy", "_mx_at"


def _anchors(h: np.ndarray, window: int) -> np.ndarray:
    """The anchor of each window of the word hashes h of one text."""
    size = min(ANCHOR, window)
    return sliding_min(rolled(h, size), window - size + 1)


def _digests(window: int):
    def step(batches):
        for b in batches:
            w = Words(b.column("text"))
            digests, anchors = [], []
            for i in range(w.n):
                h = w.hash[w.first[i] : w.first[i + 1]]
                if len(h) >= window:
                    digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                    anchors.append(np.unique(_anchors(h, window)))
            long_ones = pa.array(np.diff(w.first) >= window)
            flat = np.concatenate(anchors) if anchors else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").filter(long_ones), b.column(_KEY).filter(long_ones), pa.array(digests, pa.binary()), list_column(flat.view(np.int64), np.array([len(a) for a in anchors], dtype=np.int64), pa.int64())],
                names=["doc_id", "key", "digest", "anchors"],
            )

    return step


def _windows(window: int):
    def step(batches):
        for b in batches:
            w = Words(b.column("text"))
            for i, (doc, key, anchors) in enumerate(zip(b.column("doc_id").to_pylist(), b.column(_KEY).to_pylist(), b.column("anchors"), strict=True)):
                h = w.hash[w.first[i] : w.first[i + 1]]
                at = np.flatnonzero(np.isin(_anchors(h, window), np.asarray(anchors.values).view(np.uint64)))
                if len(at):
                    k1, k2 = rolled(h, window), rolled(h, window, 0xA0761D6478BD642F)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k1[at].view(np.int64)), pa.array(k2[at].view(np.int64)), pa.array(np.full(len(at), doc)), pa.array(np.full(len(at), key)), pa.array(at.astype(np.int32))],
                        names=["k1", "k2", "doc_id", "key", "at"],
                    )

    return step


def _gone(w: Words, copies: list[bool], lists: pa.Array, window: int) -> np.ndarray:
    """True for each word of the batch that goes: all words of copies, and those that a window starting at a listed position covers."""
    mark = np.zeros(len(w.start) + 1, dtype=np.int64)
    for i in range(w.n):
        a, z = w.first[i], w.first[i + 1]
        if copies[i] and z - a >= window:
            mark[a] += 1
            mark[z] -= 1
        elif lists[i].is_valid:
            at = a + np.asarray(lists[i].values)
            at = at[at + window <= z]
            np.add.at(mark, at, 1)
            np.add.at(mark, at + window, -1)
    return np.cumsum(mark[:-1]) > 0


def _cut(window: int, shape):
    def step(batches):
        for b in batches:
            w = Words(b.column("text"))
            gone = _gone(w, b.column(_COPY).to_pylist(), b.column(_AT), window)
            data, offsets = w.joined(~gone)
            n_removed = np.bincount(w.doc[gone], minlength=w.n)
            yield shape(b.drop_columns([_COPY, _AT, _KEY]), np.diff(w.first), n_removed, data, offsets)

    return step


def _texts(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    whole = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))
    return whole.cast(pa.string())


def _as_digests(b, n_words, n_removed, data, offsets):
    shas = [hashlib.sha256(data[a:z]).hexdigest() for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
    return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas, pa.string()), _texts(data, offsets)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def _as_documents(b, n_words, n_removed, data, offsets):
    """The rows that keep a word or lost none, with the new text of those that lost some."""
    cut = pa.array(n_removed > 0)
    kept = _texts(data, offsets)
    columns = []
    for name, column in zip(b.schema.names, b.columns, strict=True):
        if name == "text":
            column = pa.compute.if_else(cut, kept, column.cast(pa.string()))
        elif name == "n_chars":
            column = pa.compute.if_else(cut, pa.compute.utf8_length(kept).cast(column.type), column)
        columns.append(column)
    return pa.RecordBatch.from_arrays(columns, names=b.schema.names).filter(pa.array((n_removed == 0) | (n_removed < n_words)))


def _whole(ids, id_log2: int, window: int, shape):
    """The rows of documents that lose nothing, in one worker with :func:`_cut`."""

    def rows(batches):
        for b in batches:
            b = b.filter(pa.array(~in_bitmap(ids.value, id_cells(b.column("doc_id").to_numpy(zero_copy_only=False), id_log2))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([False] * b.num_rows, pa.bool_()), pa.nulls(b.num_rows, pa.list_(pa.int32()))], names=[*b.schema.names, _COPY, _AT])

    return lambda batches: _cut(window, shape)(rows(batches))


def _cell(row: int, log2: int) -> F.Column:
    """Cell of an anchor in a row of the sketch; the row is the last bit."""
    return F.shiftleft(F.xxhash64("anchor", F.lit(row)).bitwiseAND(F.lit((1 << log2) - 1)), 1).bitwiseOR(F.lit(row).cast("long"))


def suspects(pairs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Of the stored rows (doc_id, key, anchor) those whose anchor the count-min sketch estimates to occur twice or more."""
    total = pairs.count()
    log2 = min(60, max(10, int(np.ceil(np.log2(max(total, 1) * width)))))
    cells = pairs.select(F.explode(F.array(*[_cell(r, log2) for r in range(DEPTH)])).alias("cell"))
    sketch = stored(cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1"), "sketch")
    for r in range(DEPTH):
        pairs = heavy_join(pairs.withColumn("cell", _cell(r, log2)), sketch, ["cell"], total).drop("cell", "n")
    return pairs


def _changes(docs: DataFrame, window: int, width: int) -> DataFrame:
    """(doc_id, key, copy, at) of the texts that lose words: all of them (copy), or those under the windows at the positions."""
    docs = docs.select("doc_id", _KEY, "text")
    first = stored(map_arrow(docs, _digests(window), "doc_id long, key long, digest binary, anchors array<long>"), "anchors")
    total = first.count()
    classes = stored(first.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).filter("n > 1"), "classes")
    copies = stored(heavy_join(first.select("doc_id", "key", "digest"), classes, ["digest"], total).filter("doc_id != rep").select("doc_id", "key").distinct(), "copies")
    pairs = stored(first.join(copies, ["doc_id", "key"], "left_anti").select("doc_id", "key", F.explode("anchors").alias("anchor")), "pairs")
    listed = stored(suspects(pairs, width).groupBy("doc_id", F.col("key").alias(_KEY)).agg(F.collect_set("anchor").alias("anchors")), "suspects")
    discard(first, classes, pairs)

    near, _, _ = among(docs, listed, "doc_id")
    candidates = stored(map_arrow(near.join(listed, ["doc_id", _KEY]), _windows(window), CANDIDATE), "windows")
    total = candidates.count()
    owners = stored(candidates.groupBy("k1", "k2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter("owner < last").drop("last"), "owners")
    spots = heavy_join(candidates, owners, ["k1", "k2"], total).filter("owner < doc_id").groupBy("doc_id", "key").agg(F.collect_list("at").alias("at"))
    whole = copies.select("doc_id", "key", F.lit(True).alias("copy"), F.lit(None).cast("array<int>").alias("at"))
    changed = stored(spots.select("doc_id", "key", F.lit(False).alias("copy"), "at").unionByName(whole), "changed")
    discard(listed, candidates, owners, copies)
    return changed


def _applied(docs: DataFrame, window: int, width: int, shape, schema) -> DataFrame:
    docs = docs.filter("doc_id is not null").withColumn(_KEY, F.xxhash64("text"))
    changed = _changes(docs, window, width).select(F.col("doc_id").alias("_mx_id"), F.col("key").alias("_mx_key"), F.col("copy").alias(_COPY), F.col("at").alias(_AT))
    touched, ids, log2 = among(docs, changed.select(F.col("_mx_id").alias("doc_id")), "doc_id")
    moved = touched.join(changed, (F.col("doc_id") == F.col("_mx_id")) & (F.col(_KEY) == F.col("_mx_key")), "left").drop("_mx_id", "_mx_key")
    moved = moved.withColumn(_COPY, F.coalesce(F.col(_COPY), F.lit(False)))
    return map_arrow(docs, _whole(ids, log2, window, shape), schema).unionByName(map_arrow(moved, _cut(window, shape), schema))


def dedup(docs: DataFrame, window: int = WINDOW, text: bool = False, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) for every document; kept words are joined by one space."""
    cut = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    out = _applied(docs.select("doc_id", "text"), window, width, _as_digests, cut)
    return out if text else out.drop("kept_text")


def cut_documents(docs: DataFrame, window: int = WINDOW, width: int = WIDTH) -> DataFrame:
    """The documents, all their columns, with repeated passages cut out of their texts (n_chars follows, counted in characters); documents
    that lose every word go. Rows that lose nothing are as they were."""
    return _applied(docs, window, width, _as_documents, docs.schema)
