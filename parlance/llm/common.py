"""Shared plumbing of the training-data operators: table reads, shared-folder materialisation, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of one Arrow batch handed to a Python worker; keeps a worker's memory flat however long the texts are.
ARROW_BATCH_BYTES = 6 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as the cluster has cores, where its scan gives fewer: a small file would else keep one core busy. Large tables are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bound_arrow(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as rows, for the whole session: the setting counts when a plan runs, so it can't be put back here."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; on a local master without one, a temporary folder of this process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not getattr(shared_dir, "own", None):
        shared_dir.own = tempfile.mkdtemp(prefix="parlance-shared-")
    return "file://" + shared_dir.own


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back, so that losing an executor costs no recomputation of what came before.

    All tables of an application lie in one folder of its name, which may be deleted once its results are written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/parlance-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # what was shuffled on the way is not needed once the table is written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    if _kept:
        _kept[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


#: Paths that were written within the open blocks of `passing`.
_kept: list[list[str]] = []


def release(spark: SparkSession, path: str) -> None:
    """Delete a materialised table that nothing reads any more."""
    for paths in _kept:
        if path in paths:
            paths.remove(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """Delete at the end the tables that are materialised within, but for those that are taken off the list."""
    _kept.append([])
    try:
        yield _kept[-1]
    finally:
        for path in _kept.pop():
            release(spark, path)


#: Rows that one task of an exchange takes at most, as far as no single key has more.
TASK_ROWS = 2_000_000


def exchange(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """df by hash of the columns, in more partitions than the session's where its number of rows asks for it."""
    n = -(-rows // TASK_ROWS)
    return df.repartition(n, *columns) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*columns)


def whole_groups(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Tables of whole groups, of at least so many rows where there are more, from batches sorted by their first column; a task holds no more than that and one group."""
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n >= least:
            whole = pa.Table.from_batches(held)
            key = whole.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1], side="left"))
            if cut:
                yield whole.slice(0, cut).combine_chunks()
                held, n = whole.slice(cut).combine_chunks().to_batches(), n - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if t is None else t for t in column.cast(kind).to_pylist()]


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply fn to each Arrow batch; a narrow step that streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)
                pa.default_memory_pool().release_unused()  # idle workers wait for the next task and count as well

    bound_arrow(df.sparkSession)
    return df.mapInArrow(run, schema)


def signed(values: np.ndarray) -> np.ndarray:
    """uint64 to the int64 of the same bits, as Spark's bigint holds it."""
    return np.ascontiguousarray(values, np.uint64).view(np.int64)
