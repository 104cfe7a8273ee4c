"""Shared-folder tables, bounded bitmaps and connected components used by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch handed to Python; a single longer row still travels whole.
ARROW_BATCH_BYTES = 1 << 20
#: Largest bitmap: 2**27 bits, 16 MB. Past that a bitmap only filters less, it never loses a row.
MAX_BITS_LOG2 = 27
MIN_BITS_LOG2 = 20
#: A key is heavy if it has more than one in so many of all rows, so there are fewer heavy keys than this.
HEAVY = 1 << 16


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share, from ``spark.checkpoint.dir``; where that is unset, a local folder in local mode and an error on a cluster."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="metricloom-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back: cuts lineage and survives a lost executor."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Deletes tables made by :func:`stored` that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.startswith(shared_dir(spark).replace("file:///", "file:/").rstrip("/")) or folder.startswith(shared_dir(spark)):
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def map_arrow(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes; a worker gives freed memory back to the system after each partition."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))

    def run(batches):
        yield from step(batches)
        _give_back()

    return df.mapInArrow(run, schema)


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def bits_log2(n: int, per_item: int = 8) -> int:
    """Bits so that n items fill at most one in ``per_item``, within the fixed bounds."""
    return int(min(MAX_BITS_LOG2, max(MIN_BITS_LOG2, int(np.ceil(np.log2(max(n, 1) * per_item))))))


def bitmap(cells: DataFrame, log2: int) -> np.ndarray:
    """Bitmap of the distinct values of the long column ``cell`` (0 <= cell < 2**log2): at most 2**log2 / 64 words reach the driver."""
    packed = (
        cells.select(F.shiftrightunsigned("cell", 6).alias("w"), F.expr("shiftleft(1L, cast(cell & 63 as int))").alias("b"))
        .groupBy("w").agg(F.bit_or("b").alias("b"))
    )
    got = packed.toArrow()
    out = np.zeros(1 << (log2 - 6), dtype=np.uint64)
    out[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return out


def in_bitmap(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    cells = cells.astype(np.int64, copy=False)
    return (bits[cells >> 6] >> (cells & 63).astype(np.uint64)) & np.uint64(1) == 1


def mix_py(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser on uint64 arrays."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def id_cells(ids: np.ndarray, log2: int) -> np.ndarray:
    """Cell of an integer id: its low bits, so that dense ids do not collide."""
    return ids & ((1 << log2) - 1)


def id_bitmap(ids: DataFrame, column: str) -> tuple[np.ndarray, int, int]:
    """(bitmap, log2, number of ids). Ids that share low bits share a cell, so membership may say yes wrongly, never no wrongly."""
    n = ids.count()
    log2 = bits_log2(n, 16)
    return bitmap(ids.select((F.col(column).bitwiseAND(F.lit((1 << log2) - 1))).alias("cell")), log2), log2, n


def heavy_join(left: DataFrame, right: DataFrame, keys: list[str], total: int, count: str = "n") -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row a key; ``count`` says how many of the ``total`` rows of left have it.

    Rows of heavy keys (fewer than ``HEAVY`` keys, as their counts add up to at most total) meet a broadcast copy where they are; only
    the others are shuffled, at most total / HEAVY of one key to a task. Both sides are read more than once and should be stored.
    """
    heavy = F.broadcast(right.filter(F.col(count) * HEAVY > total))
    light = left.join(heavy.select(*keys), keys, "left_anti").join(right.filter(F.col(count) * HEAVY <= total), keys)
    return left.join(heavy, keys).unionByName(light)


def hashed_sample(df: DataFrame, column: str, most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hashes of ``column`` (about; ties by the column itself).

    A threshold on the hash keeps some 1.2 times as many rows first, so that what is sorted does not grow with the table.
    """
    n = df.count()
    if n > most:
        share = min(1.0, 1.2 * most / n + 64 / n)
        df = df.filter(F.xxhash64(column) <= F.lit(int(-(2**63) + share * (2**64 - 2048))))
    return df.orderBy(F.xxhash64(column), column).limit(most)


def _chosen(ids, log2: int, column: str):
    def step(batches):
        for b in batches:
            yield b.filter(pa.array(in_bitmap(ids.value, id_cells(b.column(column).to_numpy(zero_copy_only=False), log2))))

    return step


def among(df: DataFrame, chosen: DataFrame, column: str) -> tuple[DataFrame, object, int]:
    """The rows of df whose id may be among the chosen ones (a few others may be with them), the broadcast bitmap that says so, its log2."""
    ids, log2, _ = id_bitmap(chosen, column)
    ids = df.sparkSession.sparkContext.broadcast(ids)
    return map_arrow(df, _chosen(ids, log2, column), df.schema), ids, log2


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def components(edges: DataFrame, name: str = "cc", rounds: int = 80) -> DataFrame:
    """(node, label) for every node of the undirected edges (a, b): label is the smallest node reachable.

    Alternates large-star and small-star steps, so each round halves the depth of the trees; every round is written to the
    shared folder. Empty edges give an empty frame. An error is raised if the labels are not stable after ``rounds``.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    e = stored(e, name)
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
            .unionByName(down.select("u", F.col("m").alias("v")))
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        )
        new = stored(small, name)
        after = new.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("cast(u as decimal(20)) + v"))).first()
        discard(e)
        e = new
        if tuple(after) == before:
            break
        before = tuple(after)
    else:
        raise RuntimeError(f"components are not stable after {rounds} rounds")
    labels = e.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct().join(labels.select("node"), "node", "left_anti")
    return labels.unionByName(roots)
