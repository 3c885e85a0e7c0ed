"""Sinks: predictions, rewards, reports, encoded caches and resumable results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.schema import IGNORE


def restore(ids: Column, pad: int) -> Column:
    """Ignored ids as padding, padding in front moved behind."""
    filled = F.transform(ids, lambda x: F.when(x == IGNORE, F.lit(pad)).otherwise(x))
    start = F.greatest(F.array_position(F.transform(filled, lambda x: x != pad), True).cast("int"), F.lit(1))
    return F.concat(F.slice(filled, start, F.size(filled)), F.array_repeat(F.lit(pad), start - 1))


def write_predictions(df: DataFrame, path: str) -> None:
    """JSON lines of prompt, predict, label."""
    df.select("prompt", "predict", "label").write.mode("overwrite").json(path)


def rewards(df: DataFrame) -> DataFrame:
    """chosen and rejected scores at two decimals, half to even."""
    return df.select(*[F.bround(c, 2).alias(c) for c in ("chosen", "rejected")])


def mean_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of means, columns in name order."""
    return df.agg(*[F.avg(c).alias(c) for c in sorted(columns)])


def throughput(df: DataFrame, seconds: float) -> DataFrame:
    return df.agg(F.lit(seconds).alias("predict_runtime"), (F.count("*") / seconds).alias("predict_samples_per_second"))


def choice_results(df: DataFrame) -> DataFrame:
    """subject with its answers by question number, as one JSON object."""
    text, number = F.col("question").cast("string").alias("question"), F.expr("try_cast(question AS bigint)").alias("number")
    return df.groupBy("subject").agg(F.to_json(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct(number, text, "answer"))), lambda x: F.struct(x["question"], x["answer"])))).alias("answers"))


def save_encoded(splits: dict[str, DataFrame], path: str) -> None:
    """Encoded splits as Parquet, a folder each."""
    for name, df in splits.items():
        df.write.mode("overwrite").parquet(f"{path}/split={name}")


def load_encoded(spark: SparkSession, path: str, streaming: bool = False) -> dict[str, DataFrame] | None:
    """Encoded splits, or None where the folder holds none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at) or not len(fs.listStatus(at)):
        return None
    if streaming:
        raise ValueError("an encoded cache can't be streamed")
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().startswith("split=")]
    return {n.removeprefix("split="): spark.read.parquet(f"{path}/{n}") for n in names}


def append_results(df: DataFrame, path: str, run: str) -> None:
    """Results of one run as a partition of its own; a rerun replaces only that."""
    df.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def log_lines(df: DataFrame) -> DataFrame:
    """Each row as a JSON object without its null fields."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value"))
