"""File readers. All formats come through Spark's own readers; Arrow IPC through a Python data source."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

FORMATS = {"arrow": "arrow", "csv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet", "txt": "text"}


def extension(path: str) -> str:
    return path.rsplit("/", 1)[-1].rpartition(".")[2].lower()


def list_files(spark: SparkSession, path: str) -> list[str]:
    """A file, or the files of a folder, through the path's own file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise ValueError(f"{path} doesn't exist")
    return sorted(s.getPath().toString() for s in fs.listStatus(at) if s.isFile() and not s.getPath().getName().startswith(("_", ".")))


def read_files(spark: SparkSession, path: str, schema: str | StructType | None = None, multiline: bool | None = None) -> DataFrame:
    """A file or folder of one format. multiline: a .json file that is one array (default for .json; .jsonl has a row per line)."""
    files = list_files(spark, path)
    kinds = {extension(f) for f in files}
    kind = FORMATS.get(extension(files[0])) if files else None
    if kind is None:
        raise ValueError(f"{path}: file type isn't supported")
    if {FORMATS.get(k) for k in kinds} != {kind}:
        raise ValueError(f"{path}: file types differ: {sorted(kinds)}")
    if kind == "arrow":
        spark.dataSource.register(ArrowFiles)
    reader = spark.read.format("arrow_ipc" if kind == "arrow" else kind)
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    if kind == "json":
        reader = reader.option("multiLine", "json" in kinds if multiline is None else multiline)
    if kind == "arrow":
        return reader.option("paths", "\n".join(files)).load()
    found = reader.load(files)
    return found.withColumnRenamed("value", "text") if kind == "text" else found


class ArrowFiles(DataSource):
    """Arrow IPC files and streams, a partition each."""

    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def _open(self, path: str):
        import pyarrow as pa
        from pyarrow import fs

        source, at = fs.FileSystem.from_uri(path)
        handle = source.open_input_file(at)
        try:
            return pa.ipc.open_file(handle)
        except pa.ArrowInvalid:
            handle.seek(0)
            return pa.ipc.open_stream(handle)

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(self._open(self.options["paths"].split("\n")[0]).schema)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ArrowReader(self)


class _ArrowReader(DataSourceReader):
    def __init__(self, source: ArrowFiles):
        self.source = source

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.source.options["paths"].split("\n")]

    def read(self, partition: InputPartition) -> Iterator:
        opened = self.source._open(partition.value)
        batches = (opened.get_batch(i) for i in range(opened.num_record_batches)) if hasattr(opened, "num_record_batches") else opened
        yield from batches


SCRIPTS: dict[str, Callable[..., DataFrame]] = {}


def register_script(name: str, fn: Callable[..., DataFrame]) -> None:
    """A scripted dataset: fn(spark, **options)."""
    SCRIPTS[name] = fn


def cloud_files(paths: list[str]) -> list[str]:
    """Object-store JSON paths, in Hadoop's schemes."""
    for p in paths:
        if not p.startswith(("s3://", "s3a://", "gs://", "gcs://")):
            raise ValueError(f"{p}: not an object-store path")
    swap = {"s3": "s3a", "gcs": "gs"}
    return [swap.get(p.split("://")[0], p.split("://")[0]) + "://" + p.split("://", 1)[1] for p in paths if p.endswith((".json", ".jsonl"))]


def with_order(df: DataFrame, by: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """df with _ord, 0.. in the order of some columns (ties in any order), or in file order for a plain scan; no single-task sort.

    Borders of the whole key are taken from a bounded sample, rows are numbered within the ranges between them, and counts per range give each
    range's offset. File order does the same by partition of the scan, which is the same in every pass.
    """
    kept = df.schema.fieldNames()
    if by is None:
        numbered = df.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    else:
        n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        key = F.struct(*by)
        keys = df.select(*by).dropna()
        sampled = sorted(tuple(r) for r in keys.orderBy(F.xxhash64(*by), *by).limit(20 * n).collect())
        borders = sorted({sampled[len(sampled) * i // n] for i in range(1, n)}) if sampled else []
        array = F.array(*[F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(by, b)]) for b in borders])
        part = F.size(F.filter(array, lambda b: b <= key)) if borders else F.lit(0)
        inside = Window.partitionBy("__part").orderBy(*by)
        numbered = df.withColumn("__part", part).withColumn("__row", F.row_number().over(inside).cast("bigint") - 1)
    counts = {r[0]: r[1] for r in numbered.groupBy("__part").count().collect()}  # a number per range
    if not counts:
        return df.withColumn("_ord", F.lit(0).cast("bigint"))
    offsets, total = [], 0
    for p in sorted(counts):
        offsets += [F.lit(p), F.lit(total).cast("bigint")]
        total += counts[p]
    return numbered.withColumn("_ord", F.col("__row") + F.create_map(*offsets)[F.col("__part")]).select(*kept, "_ord")


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as the cluster has cores, where its scan gives fewer: a small file would else keep one core busy. Large tables are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def page(df: DataFrame, number: int, size: int = 2) -> DataFrame:
    """Rows of one page of an ordered table."""
    return df.where(F.col("_ord").between(size * number, size * number + size - 1))


def first_video(row: str = "messages"):
    """Path of the first video part of a chat manifest row's first message content."""
    content = F.get(F.col(row), F.lit(0))["content"]
    return F.get(F.filter(content, lambda c: c["type"] == "video"), F.lit(0))["video"]


def subjects(mapping: DataFrame) -> DataFrame:
    """subject, name, category of a subject mapping with one struct column per subject."""
    pairs = [F.struct(F.lit(c).alias("subject"), F.col(c)["name"].alias("name"), F.col(c)["category"].alias("category")) for c in mapping.columns]
    return mapping.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")
