"""Self-join of documents on the Jaccard similarity of their word 5-gram sets, with adaptive multi-match prefixes.

A document is the set of its distinct word shingles (64-bit hashes). Steps, all over every row and whole texts, the same at every size:

1. Texts with the same set form one class; one of them goes on.
2. *Survivors*: with the shingles in the order of their hashes, two sets with Jaccard >= t share at least min(l_a, l_b) of their
   ``n - ceil(t n) + l`` first ones; l is a tenth of the set. These heads are counted over all classes, and a class goes out whose head holds fewer
   than l shingles that another head has (l of the smallest set it could link with). Of the classes left all shingles are counted, and one goes
   out of which less than t are in another.
3. *Adaptive prefixes*: within a head the shingles are put in the order of their counts, rare ones first; those no other head has come
   first and need no posting. A document that leaves out the ``l - m`` most frequent ones (l as above) still shares m posted shingles with every
   partner that does so too: what a pair loses is lost by the one of the two that leaves out more. So with each shingle by which its prefix is
   longer a linked pair must share one more, and each document takes the m (1 to ``MAX_MATCH``) of least estimated cost: postings read
   plus, as each candidate takes m of them, that number over m verifications. A pair needs min(m_a, m_b) shared posted shingles
   before its sets are compared.
4. *Stars*: in a posting list only pairs with the list's leader (the document with the smallest unique share) are verified,
   one for each document; members of one component need no comparison with each other. After that, the pairs left are those
   across components of documents that are not in their leader's component. Every pair must have room for enough shared
   shingles before and after the one it meets at, in the order of hashes as in that of counts, and by 256-bit sketches of both sets that
   tell how much they differ at least.

Shingles are counted by their low bits, ``CELLS`` cells a shingle or more: one that shares its cell counts as frequent, none as rare by mistake.
Counting, looking up counts and postings are shuffles on the shingle; very frequent shingles, copies and components meet broadcast rows
instead (``support.heavy_join``). The components are exact, and all pairs of a group are never made by steps 1 to 4; at worst, a list
whose documents all lie in other components than their leader's, and are no links, is compared pair by pair.

Nulls, empty and blank texts have an empty set, link with nothing and form a component of their own. Rows of one id are one node: with equal sets
they give one row, with different sets one row each, in the same component. Rows with a null doc_id are left out. Extra columns are
ignored by :func:`jaccard_components` and kept by :func:`keep_one`, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import Words, shingle_sets
from .support import components, discard, heavy_join, id_bitmap, id_cells, in_bitmap, list_column, map_arrow, stored

MAX_MATCH = 4
STAR_ROUNDS = 3
#: One verification against one posting read, for the cost estimate.
VERIFY_COST = 20.0
PERCENT = 80
WIDTH = 5
#: Columns of the parity sketch. Two sets differ in at least as many members as their sketches differ in bits.
PARITY = ("p0", "p1", "p2", "p3")
#: Cells a shingle, so that few unlike ones share a cell.
CELLS = 1 << 12


def _needed(n, percent: int):
    """ceil(n * percent / 100)."""
    return -(-n * percent // 100)


def _extra(n):
    """Tokens by which the plain prefix of n hashes is longer than needed for one match: so many of it must be shared."""
    return np.maximum(n // 10, 1)


def _heads(percent: int, width: int):
    def step(batches):
        for b in batches:
            sets = shingle_sets(Words(b.column("text"), lower=True), width)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            keep = n - _needed(n, percent) + _extra(n)
            keep[n == 0] = 0
            head = np.concatenate([s[:k] for s, k in zip(sets, keep, strict=True)]) if len(sets) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("key"), pa.array(n), pa.array(_extra(_needed(n, percent))), pa.array(digests, pa.binary()), list_column(head.view(np.int64), keep, pa.int64())],
                names=["doc_id", "key", "n", "spare", "digest", "head"],
            )

    return step


def _parities(sets: list[np.ndarray]) -> np.ndarray:
    """For each set 64 bits a column of ``PARITY``: whether a cell holds an odd number of its members."""
    out = np.empty((len(sets), 64 * len(PARITY)), dtype=np.uint8)
    for i, s in enumerate(sets):
        out[i] = np.bincount((s >> np.uint64(40)).astype(np.int64) % out.shape[1], minlength=out.shape[1]) & 1
    return np.packbits(out, axis=1, bitorder="little").view(np.int64)


def _whole_sets(ids, log2: int, width: int):
    def step(batches):
        for b in batches:
            b = b.filter(pa.array(in_bitmap(ids.value, id_cells(b.column("doc_id").to_numpy(zero_copy_only=False), log2))))
            if b.num_rows:
                sets = shingle_sets(Words(b.column("text"), lower=True), width)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                parity = [pa.array(p) for p in _parities(sets).T]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), list_column(np.concatenate(sets).view(np.int64), n, pa.int64()), *parity], names=["doc_id", "key", "members", *PARITY])

    return step


def _linked(percent: int):
    def step(batches):
        for b in batches:
            xs, ys = b.column("xs"), b.column("ys")
            n, m = b.column("xn").to_numpy(), b.column("yn").to_numpy()
            both = np.array([len(np.intersect1d(np.asarray(x.values), np.asarray(y.values), assume_unique=True)) for x, y in zip(xs, ys, strict=True)], dtype=np.int64)
            yield b.select(["a", "b"]).filter(pa.array(100 * both >= percent * (n + m - both)))

    return step


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose sets reach the threshold, exactly."""
    joined = (
        pairs.join(sets.select(F.col("sid").alias("a"), F.col("n").alias("xn"), F.col("members").alias("xs")), "a")
        .join(sets.select(F.col("sid").alias("b"), F.col("n").alias("yn"), F.col("members").alias("ys")), "b")
        .select("a", "b", "xn", "yn", "xs", "ys")
    )
    return map_arrow(joined, _linked(percent), "a long, b long")


def _classes(first: DataFrame) -> DataFrame:
    """(sid, rep) of the rows whose set an earlier row has too: rep is the smallest sid of the class."""
    full = first.filter("n > 0")
    many = stored(full.groupBy("digest").agg(F.min("sid").alias("rep"), F.count("*").alias("rows")).filter("rows > 1"), "classes")
    return stored(heavy_join(full.select("sid", "digest"), many, ["digest"], full.count(), "rows").filter("sid != rep").select("sid", "rep"), "copies")


def _counts(rows: DataFrame, column: str, ahead: str) -> tuple[DataFrame, F.Column, int]:
    """(cell, df, sid, head) of the shingles in the array ``column`` of rows with a sid, the cell of a shingle t, and the number of shingles.

    df counts the sets with a shingle in the cell; of cells of one set only the sid is kept and whether the shingle is among the
    first ``ahead`` of its set, of the others only the cell.
    """
    total = rows.agg(F.coalesce(F.sum(F.size(column)), F.lit(0))).first()[0]
    mask = (1 << min(62, max(16, int(np.ceil(np.log2(max(total, 1) * CELLS)))))) - 1
    cell = F.col("t").bitwiseAND(F.lit(mask))
    places = rows.select("sid", ahead, F.posexplode(column).alias("pos", "t"))
    # whether it is in the head is the last bit beside the sid
    owner = F.shiftleft("sid", 1).bitwiseOR(F.expr(f"if(pos < {ahead}, 1L, 0L)"))
    counted = places.select(cell.alias("cell"), owner.alias("owner")).groupBy("cell").agg(F.count("*").alias("df"), F.min("owner").alias("owner"))
    kept = counted.select(F.expr("if(df > 1, cell, null) as cell"), "df", F.expr("if(df > 1, null, shiftright(owner, 1)) as sid"), F.expr("if(df > 1, null, owner & 1 = 1) as head"))
    return stored(kept, "counts"), cell, total


def _lone(counted: DataFrame) -> DataFrame:
    """(sid, lone, lone_head): how many of its shingles no other set has, and how many of them are in its head."""
    return counted.filter("df = 1").groupBy("sid").agg(F.count("*").alias("lone"), F.count_if("head").alias("lone_head"))


def _postings(heads: DataFrame, alive: DataFrame, counted: DataFrame, cell: F.Column, total: int) -> DataFrame:
    """Step 3: (t, sid, n, most, u, need, edge, tail, later, before, after) of the posted shingles of the sets (sid, most, tail) alive.

    ``spare`` is the smallest ``_extra`` of any set that a set can link with. most counts the shingles of the whole set that others have, tail
    those of them outside the head, u those of the head that no other head has, later the shared shingles of the head that follow t in the
    order of counts. edge is the last hash of the head, so of two heads the one with the smaller edge lies within the other's range.
    In the order of hashes, before counts the shingles ahead of t that another head has (a partner with t has them in its head, if at all), and
    after all that follow.
    """
    shared = counted.filter("df > 1").select("cell", "df")
    posted = heads.join(alive, "sid").select("sid", "n", "most", "tail", "spare", F.size("head").alias("h"), F.expr("element_at(head, -1) ^ shiftleft(1L, 63)").alias("edge"), F.posexplode("head").alias("pos", "t")).withColumn("cell", cell)
    by_set = heavy_join(posted, shared, ["cell"], total, "df").groupBy("sid", "n", "most", "tail", "spare", "h", "edge").agg(F.sort_array(F.collect_list(F.struct("pos", "df", "t"))).alias("items"))
    # in the order of counts, each with the number of shared shingles ahead of it in the order of hashes
    by_set = by_set.withColumn("items", F.expr("sort_array(transform(items, (x, i) -> struct(x.df as df, x.t as t, x.pos as pos, i as before)))"))
    by_set = by_set.withColumn("common", F.size("items")).withColumn("u", F.expr("h - common"))
    # the prefix for one match: all but the spare - 1 most frequent shingles of the head
    by_set = by_set.withColumn("one", F.expr("h - spare + 1 - u"))
    costs = [
        F.struct((F.expr(f"aggregate(slice(items, 1, greatest(one + {k - 1}, 0)), 0D, (a, x) -> a + x.df - 1)") * (1 + VERIFY_COST / k)).alias("cost"), F.lit(k).alias("need"))
        for k in range(1, MAX_MATCH + 1)
    ]
    # no more matches can be asked for than the partner's smallest head is sure to share
    need = F.array_min(F.filter(F.array(*costs), lambda c: c["need"] <= F.col("spare")))["need"]
    chosen = by_set.withColumn("need", need).filter("one + need - 1 > 0")
    rows = chosen.select("sid", "n", "most", "tail", "edge", "u", "need", "common", F.posexplode(F.expr("slice(items, 1, one + need - 1)")).alias("q", "x"))
    rows = rows.select(F.col("x.t").alias("t"), "sid", "n", "most", "u", "need", "edge", "tail", F.expr("common - q - 1").alias("later"), F.col("x.before").alias("before"), F.expr("n - x.pos - 1").alias("after"))
    return stored(rows, "postings")


def links(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(rows doc_id, n, sid with the class representative's sid, verified edges (a, b) between sids that span the links).

    ``docs`` needs doc_id (long) and text. The edges connect exactly what the links connect; they are not all links.
    """
    docs = docs.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("key"), "text")
    first = map_arrow(docs, _heads(percent, width), "doc_id long, key long, n long, spare long, digest binary, head array<long>")
    first = stored(first.withColumn("sid", F.monotonically_increasing_id()), "sets")
    copies = _classes(first)
    members = first.select("doc_id", "n", "sid").join(copies, "sid", "left").select("doc_id", "n", F.coalesce("rep", "sid").alias("sid")).distinct()
    members = stored(members, "members")
    # rows of one id are one node
    several = members.groupBy("doc_id").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).filter("lo < hi").select("doc_id", "lo")
    edges = stored(members.join(several, "doc_id").filter("sid != lo").select(F.col("lo").alias("a"), F.col("sid").alias("b")), "edges")

    if not first.groupBy("doc_id", "key").count().filter("count > 1").isEmpty():
        docs = docs.dropDuplicates(["doc_id", "key"])
    heads = stored(first.filter("n > 0").join(copies, "sid", "left_anti").drop("digest"), "heads")
    discard(first)
    counted, cell, total = _counts(heads, "head", "n")
    small = heads.select("sid", "doc_id", "key", "n", "spare", F.size("head").alias("h"))
    wanted = small.join(_lone(counted), "sid", "left").filter("h - coalesce(lone, 0) >= spare").select("sid", "doc_id", "key", "n", "h")
    wanted = stored(wanted, "wanted")
    ids, log2, _ = id_bitmap(wanted, "doc_id")
    ids = docs.sparkSession.sparkContext.broadcast(ids)
    sets = map_arrow(docs, _whole_sets(ids, log2, width), f"doc_id long, key long, members array<long>, {', '.join(f'{c} long' for c in PARITY)}")
    sets = stored(sets.join(wanted, ["doc_id", "key"]).select("sid", "n", "h", "members", *PARITY), "wholes")
    every, _, _ = _counts(sets, "members", "h")
    most, tail = F.expr("n - coalesce(lone, 0)"), F.expr("n - h - coalesce(lone - lone_head, 0)")
    alive = sets.select("sid", "n", "h").join(_lone(every), "sid", "left").select("sid", most.alias("most"), tail.alias("tail"), "n").filter(f"100 * most >= {percent} * n").drop("n")
    alive = stored(alive, "alive")
    posting = _postings(heads, alive, counted, cell, total)
    discard(heads, counted, every, wanted)
    if posting.isEmpty():
        return members, edges
    wholes, sets = sets, stored(sets.select("sid", "n", "members", *PARITY).join(alive, "sid", "left_semi"), "alive-sets")
    discard(wholes)

    # 4: stars
    total = posting.count()
    tried = None
    labels = None
    for k in range(STAR_ROUNDS):
        now = _labelled(posting, labels)
        # lists within one component are done with: what is joined is all that later rounds look at
        led = stored(heavy_join(now, stored(_leaders(now).select("t", "rows", "lead.*"), "leaders"), ["t"], total, "rows"), "led")
        discard(posting)
        posting = led.select(posting.columns)
        best = (
            led.filter(f"label != llabel and {_room('', 'l', percent)} and {_reach('', 'l', 'least(need, lneed)', percent)} and {_reach('l', '', 'least(need, lneed)', percent)}")
            .groupBy(F.col("sid").alias("b"), F.col("lsid").alias("a"), F.least("need", "lneed").alias("need")).count().filter("count >= need")
        )
        if tried is not None:
            best = best.join(tried, ["a", "b"], "left_anti")
        pairs = best.groupBy("b").agg(F.max(F.struct("count", F.expr("-a"))).alias("m")).select((-F.col("m.col2")).alias("a"), "b")
        pairs = stored(pairs, "pairs")
        found = stored(_verify(pairs, sets, percent), "edges")
        n = found.count()
        edges = edges.unionByName(found)
        tried = pairs if tried is None else tried.unionByName(pairs)
        if n:
            labels = stored(components(edges).select(F.col("node").alias("sid"), "label"), "labels")
        if not n or k and not n * 20 > pairs.count():
            break

    # the pairs left: across components, of documents that are not in their leader's one
    now = _labelled(posting, labels)
    leaders = stored(_leaders(now).select("t", "rows", F.col("lead.llabel").alias("al")), "leaders")
    sides = heavy_join(now, leaders, ["t"], total, "rows").drop("rows").join(sets.select("sid", *PARITY), "sid")
    fewer = "least(x.need, y.need)"
    left = (
        sides.filter("label != al").alias("x")
        .join(sides.alias("y"), F.expr(f"x.t = y.t and x.label != y.label and {_room('x.', 'y.', percent)} and {_reach('x.', 'y.', fewer, percent)} and {_reach('y.', 'x.', fewer, percent)} and {_alike('x.', 'y.', percent)}"))
        .select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b"), F.expr(f"{fewer} as need"), F.expr("if(y.label != y.al, 1, 2) as w"))
        .groupBy("a", "b", "need").agg(F.sum("w").alias("shared")).filter("shared >= 2 * need").select("a", "b")
    )
    if tried is not None:
        left = left.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    found = stored(_verify(stored(left, "left"), sets, percent), "edges")
    return members, edges.unionByName(found)


def _labelled(posting: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return posting.withColumn("label", F.col("sid"))
    return posting.join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))


def _leaders(now: DataFrame) -> DataFrame:
    """Of each posting list that spans components: the document with the smallest unique share, and the list's length."""
    lead = F.struct((F.col("u") / F.col("n")).alias("share"), *[F.col(c).alias(f"l{c}") for c in ("sid", "label", "n", "most", "need", "edge", "tail", "later", "before", "after")])
    return now.groupBy("t").agg(F.min(lead).alias("lead"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("rows")).filter("lo < hi")


def _room(x: str, y: str, percent: int) -> str:
    """Whether a pair that shares a shingle can share enough: at most what both have before it, it, and what both have after it, and no
    more than either shares with anyone."""
    both = f"least({x}most, {y}most, least({x}before, {y}before) + 1 + least({x}after, {y}after))"
    return f"(100 + {percent}) * ({both}) >= {percent} * ({x}n + {y}n)"


def _reach(x: str, y: str, need: str, percent: int) -> str:
    """Whether a shingle of x can be among the first ``need`` in the order of counts that both heads have.

    Of the o shingles that a linked pair shares, all but the tail of the set whose head ends first lie in both heads, and all of these but
    ``need`` at most follow it there.
    """
    tail = f"if({x}edge < {y}edge, {x}tail, if({x}edge > {y}edge, {y}tail, least({x}tail, {y}tail)))"
    return f"(100 + {percent}) * ({x}later + {need} + {tail}) >= {percent} * ({x}n + {y}n)"


def _alike(x: str, y: str, percent: int) -> str:
    """Whether the parity sketches leave room for enough shared shingles: sets of n and m that differ in d members share (n + m - d) / 2."""
    apart = " + ".join(f"bit_count({x}{c} ^ {y}{c})" for c in PARITY)
    return f"(100 + {percent}) * ({x}n + {y}n - ({apart})) >= 2 * {percent} * ({x}n + {y}n)"


def jaccard_components(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document; component_id is the smallest doc_id reachable by links."""
    members, edges = links(docs, percent, width)
    labels = components(edges).select(F.col("node").alias("sid"), "label")
    members = stored(members.join(labels, "sid", "left").select("doc_id", "n", F.coalesce("label", "sid").alias("label")), "labelled")
    roots = members.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows")).filter("rows > 1")
    joined = heavy_join(members, stored(roots, "roots"), ["label"], members.count(), "rows").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    lone = members.join(stored(roots.select("label"), "several"), "label", "left_anti").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return joined.unionByName(lone)


def keep_one(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """The documents (all their columns) without those that share a component with a smaller doc_id."""
    keep = jaccard_components(docs, percent, width).filter("doc_id = component_id").select(F.col("doc_id").alias("_mx_keep"))
    return docs.join(keep, F.col("doc_id") == F.col("_mx_keep"), "left_semi")
