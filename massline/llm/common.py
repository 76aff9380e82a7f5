"""What the corpus operators share: tables, scratch tables in the shared folder, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts, and bytes of text, that are worked on at once; a longer text is alone.
TEXT_BATCH, TEXT_BYTES = 500, 4 << 20


def slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of bounded rows and bytes of the text column ``at``."""
    sizes = np.asarray(pc.binary_length(batch.column(at)).fill_null(0)) if batch.num_rows else np.empty(0, np.int64)
    upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    i = 0
    while i < batch.num_rows:
        j = int(np.searchsorted(upto, upto[i] + TEXT_BYTES, side="right")) - 1
        j = max(i + 1, min(j, i + TEXT_BATCH))
        yield batch.slice(i, j - i)
        i = j


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is set: the warehouse, which a cluster shares too, or on one machine a folder of our own."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if sc.master == "local" or sc.master.startswith("local["):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="massline-"))
        return sc.getCheckpointDir().rstrip("/")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables written to the shared folder, so that losing an executor never recomputes what led to them.

    ``drop`` frees one that no later plan reads; the rest goes when the session's Python ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/massline-{label}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        atexit.register(self.close)

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, df: DataFrame) -> None:
        _delete(self.spark, df._scratch_path)

    def close(self) -> None:
        try:
            _delete(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session may have ended before Python does
            pass


def components_of(linked: np.ndarray) -> np.ndarray:
    """Smallest index that each one reaches, from a symmetric boolean matrix."""
    n = len(linked)
    root = np.arange(n)
    while True:
        low = np.minimum(root, np.where(linked, root[None, :], n).min(1))
        low = low[low]
        if (low == root).all():
            return root
        root = low


#: A node that has more than one in so many of all edges, and more than BUSY, is a hub; there are at most twice as many hubs.
HUBS, BUSY = 1000, 50_000


def _to_least(arcs: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """arcs (a, b) with the m of each a in least (a, m, deg); n is the number of edges.

    Hubs come by a broadcast of at most 2 * HUBS rows, so that no task gathers one's edges.
    """
    if n <= BUSY:
        return arcs.join(least.select("a", "m"), "a")
    busy = max(BUSY, n // HUBS)
    hubs = F.broadcast(least.where(F.col("deg") > busy).select("a", "m"))
    rest = arcs.join(hubs.select("a"), "a", "left_anti").join(least.where(F.col("deg") <= busy).select("a", "m"), "a")
    return arcs.join(hubs, "a").unionByName(rest)


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(a, b) long pairs, in any direction -> (node, component), the smallest node that each one reaches.

    Alternating large-star and small-star steps; every step is an aggregation by key and a join, written
    to the shared folder, and about log(n) of them are needed. Nodes without an edge don't appear.
    """

    def arcs(df: DataFrame) -> DataFrame:
        return df.select("a", "b").unionAll(df.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())

    here = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = mark(here)
    while before[0]:
        both = arcs(here)
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("deg")).select("a", F.least("a", "m").alias("m"), "deg")
        large = _to_least(both, least, before[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("deg"))
        small = _to_least(large, low, before[0]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = scratch.save(small.unionAll(low.select("a", F.col("m").alias("b"))).distinct())
        now = mark(after)
        scratch.drop(here)
        here = after
        if now == before:
            break
        before = now
    return here.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(here.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
