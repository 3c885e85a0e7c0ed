"""Structured Streaming wrappers: stateless steps run on the stream, cross-row steps on micro-batches, deduplication under a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from parlance.functions.templates import Template, one_turn
from parlance.operators.align import align
from parlance.operators.validate import usable
from parlance.sources.catalog import SourceSpec
from parlance.sources.readers import FORMATS, with_order


def stream_files(spark: SparkSession, path: str, kind: str, schema: StructType | str, per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(FORMATS[kind]).schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(path)


def check_streaming(max_steps: int, val_size: float, max_samples: int | None) -> None:
    """A stream needs a step limit, a whole-number validation size and no sample limit."""
    if max_steps <= 0:
        raise ValueError("a stream needs max_steps")
    if 1e-6 < val_size < 1:
        raise ValueError("a stream needs a whole-number val_size")
    if max_samples is not None:
        raise ValueError("max_samples doesn't go with a stream")


def stream_rendered(raw: DataFrame, spec: SourceSpec, template: Template, stage: str = "supervised", keep: tuple[str, ...] = ()) -> DataFrame:
    """Aligned, filtered and rendered rows: prompt and response. Stateless, so append mode needs no watermark."""
    rows = align(raw, spec, keep).where(usable(stage))
    return rows.select(*keep, one_turn(template, F.concat("_prompt", "_response"), F.col("_system")).alias("turn")).select(*keep, "turn.*")


def each_batch(df: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Run a cross-row step (packing, rotation, mixing) on every micro-batch, which is its preprocessing batch; a replayed batch overwrites its own folder."""

    def run(batch: DataFrame, number: int) -> None:
        step(with_order(batch)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_stream(df: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """First row of each key within the watermark's delay."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def append_log(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Log rows as JSON lines, null fields left out."""
    return df.writeStream.format("json").option("ignoreNullFields", "true").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
