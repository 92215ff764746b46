"""Session helpers of the corpus operators: shared tables, bounded Arrow batches, size-checked broadcasts, connected components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import BATCH_BYTES, bounded, tidy  # noqa: F401

#: Rows and stored bytes up to which a join side is broadcast; above either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20
#: Bytes of what a task that gathers packed blocks is meant to hold.
TASK_BYTES = 16 << 20
_BATCH, _ROWS = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.  Where that is unset: a temporary one on a local master, else an error, as executors share no such folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="hybridspark-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


class Shared:
    """A table written to the shared folder: it cuts the lineage and survives the loss of executors.

    ``drop`` deletes it; one that a result still reads is deleted when the driver ends.  After a large shuffle (``shuffled``)
    the driver's garbage is collected, so that the shuffle's files can go."""

    def __init__(self, df: DataFrame, shuffled: bool = False):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/hs-{uuid.uuid4().hex}"
        schema = df.schema
        df.write.parquet(self.path)
        self._fs().deleteOnExit(self._at())
        del df
        if shuffled:
            for wait in (0.5, 0.0):  # the listeners' queues hold plans for a moment
                gc.collect()
                self.spark.sparkContext._jvm.System.gc()
                time.sleep(wait)
        self.df = self.spark.read.schema(schema).parquet(self.path)

    def _at(self):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)

    def _fs(self):
        return self._at().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def drop(self) -> None:
        self._fs().delete(self._at(), True)


def arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], ddl) -> DataFrame:
    """``df.mapInArrow`` with batches of at most about BATCH_BYTES (a longer row comes alone); workers give memory back after each task.

    The bound is a setting of the session and stays set, unless it was lower."""
    bounded(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            tidy()

    return df.mapInArrow(task, ddl)


def parallel(spark: SparkSession, size: int) -> int:
    """Tasks for ``size`` bytes of packed blocks: as many as the session shuffles with, more if these would hold over TASK_BYTES."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


def labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 .. n - 1 the least node of each one's component under the edges (a, b): minima spread and pointers jump until nothing changes."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        live = x != y
        if not live.any():
            break
        a, b, x, y = a[live], b[live], x[live], y[live]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def forest(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """(a, b): for each node of the edges that isn't the least of its component, an edge from it to that."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = labels(at[: len(a)], at[len(a) :], len(node))
    own = np.flatnonzero(root != np.arange(len(node)))
    return pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[root[own]])], names=["a", "b"])


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if it is stored in few bytes and has at most ``rows`` rows.  Give it stored tables: it counts them."""
    stored = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if stored <= BROADCAST_BYTES and df.limit(rows + 1).count() <= rows else df


#: Edges up to which one task finds the components; more are contracted in rounds of shuffles.
ONE_TASK_EDGES = 1_000_000


def _contracted(edges: DataFrame, by: str | None) -> DataFrame:
    """Edges with the same components, the forest of each partition in its place; partitions by a column, or one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        size = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += len(batch)
            if size > 2 * ONE_TASK_EDGES:  # a forest is no larger than its nodes
                made = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size = [(made.column(0).to_numpy(), made.column(1).to_numpy())], len(made)
        yield forest(*(np.concatenate(x) for x in zip(*held, strict=True)))

    rows = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
    return arrow(rows.coalesce(1) if by is None else rows, run, "a bigint, b bigint").select(F.col("a").alias("u"), F.col("b").alias("v"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of the undirected graph ``edges``; root is the least node of its component.

    Each partition's edges are contracted to a forest where they lie.  While more than ONE_TASK_EDGES are left, large-star and
    small-star steps alternate, a number of rounds logarithmic in the size of a component; a node's least neighbour is
    aggregated before it is joined, so that a node of many edges isn't gathered in one task.  Every round is written to the
    shared folder and the one before dropped.  What is small enough one task finishes."""
    spark = edges.sparkSession
    u, v = F.col("u"), F.col("v")
    now = Shared(_contracted(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(u != v), "u"))

    def least(df: DataFrame) -> DataFrame:
        return df.groupBy("u").agg(F.min("v").alias("m"))

    while now.df.limit(ONE_TASK_EDGES + 1).count() > ONE_TASK_EDGES:
        both = now.df.unionByName(now.df.select(v.alias("u"), u.alias("v")))
        large = both.filter(v > u).join(least(both), "u").select(v.alias("u"), F.least("m", "u").alias("v")).filter(u != v).distinct()
        large = Shared(large, shuffled=True)
        near = large.df.join(least(large.df), "u")
        small = near.select(v.alias("u"), F.col("m").alias("v")).unionByName(near.select(u, F.col("m").alias("v"))).filter(u != v).distinct()
        then = Shared(small, shuffled=True)
        large.drop()
        done = then.df.join(then.df.select(v.alias("u")).distinct(), "u", "left_semi").isEmpty() and then.df.groupBy("u").count().filter("count > 1").isEmpty()  # stars
        now.drop()
        now = then
        if done:
            return now.df.select(u.alias("node"), v.alias("root")).unionByName(now.df.select(v.alias("node"), v.alias("root")).distinct())
    small = Shared(_contracted(now.df, None))
    now.drop()
    return small.df.select(u.alias("node"), v.alias("root")).unionByName(small.df.select(v.alias("node"), v.alias("root")).distinct())
