"""Batches: padding, masks of packed rows, micro-batches. A batch is a group of consecutive ordinals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.schema import IGNORE

PADDING = {"input_ids": 0, "attention_mask": 0, "labels": IGNORE}


def pad_right(x: Column, n: Column, value: int) -> Column:
    return F.concat(x, F.array_repeat(F.lit(value), F.greatest(n - F.size(x), F.lit(0))))


def pad_left(x: Column, n: Column, value: int) -> Column:
    return F.concat(F.array_repeat(F.lit(value), F.greatest(n - F.size(x), F.lit(0))), x)


def batch_widths(df: DataFrame, length: Column, batch: int, multiple: int = 1) -> DataFrame:
    """df with batch_id and _n, the batch's longest length rounded up to a multiple. Only what df holds moves, so give it keys and lengths, not arrays."""
    numbered = df.withColumn("batch_id", F.floor(F.col("_ord") / batch))
    longest = F.max(length).over(Window.partitionBy("batch_id"))
    return numbered.withColumn("_n", (F.ceil(longest / multiple) * multiple).cast("int"))


def pad_to(df: DataFrame, width: str = "_n", padding: dict[str, int] = PADDING, side: str = "right") -> DataFrame:
    """Arrays padded to the width in a column, which is dropped; narrow."""
    put = pad_right if side == "right" else pad_left
    return df.select(*[put(F.col(c), F.col(width), padding[c]).alias(c) if c in padding else F.col(c) for c in df.columns if c != width])


def pad_batches(df: DataFrame, batch: int, multiple: int = 1, padding: dict[str, int] = PADDING, side: str = "right", by: str = "input_ids") -> DataFrame:
    """df with batch_id, arrays padded to the batch's longest, rounded up to a multiple. Arrays move once, to their batch's task; where texts are shorter than their arrays, use batch_widths and pad_to."""
    return pad_to(batch_widths(df, F.size(by), batch, multiple), "_n", padding, side)


def fit(x: Column, name: str, cutoff: int, longest: Column) -> Column:
    """An array cut and padded to min(longest, cutoff); labels pad with the ignored index, others with 0."""
    n = F.least(longest, F.lit(cutoff))
    return pad_right(F.slice(x, 1, n), n, IGNORE if "label" in name else 0)


def token_type_padding(types: Column, n: Column, side: str = "right") -> Column:
    return (pad_right if side == "right" else pad_left)(types, n, 0)


def block_mask(segments: Column, visible: float = 0.0, hidden: float = -3.4028234663852886e38) -> Column:
    """array<array<double>>: row i sees column j if j <= i and both are of one segment, padding (0) of none."""
    return F.transform(segments, lambda a, i: F.transform(segments, lambda b, j: F.when((j <= i) & (a == b) & (a != 0), F.lit(visible)).otherwise(F.lit(hidden))))


def unpad(ids: Column, mask: Column) -> Column:
    """Ids where the mask isn't 0."""
    return F.transform(F.filter(F.arrays_zip(ids.alias("x"), mask.alias("m")), lambda z: z["m"] != 0), lambda z: z["x"])


def segment_lengths(df: DataFrame, mask: str = "attention_mask", key: str = "_ord") -> DataFrame:
    """(key, segment, n): sizes of the numbered sub-sequences, padding left out."""
    return df.select(key, F.explode(mask).alias("segment")).where("segment > 0").groupBy(key, "segment").agg(F.count("*").alias("n"))


def unpad_data(df: DataFrame, mask: str = "attention_mask", key: str = "_ord", batch: str = "batch_id") -> tuple[DataFrame, DataFrame]:
    """(batch, index) of seen positions and (batch, key, segment, n, cumulative) of segments, a batch's rows end to end."""
    before = Window.partitionBy(batch).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    at = df.select(batch, key, mask).withColumn("base", F.coalesce(F.sum(F.size(mask)).over(before), F.lit(0)))
    indices = at.select(batch, "base", F.posexplode(mask)).where("col > 0").select(batch, (F.col("base") + F.col("pos")).alias("index"))
    lengths = df.select(batch, key, F.explode(mask).alias("segment")).where("segment > 0").groupBy(batch, key, "segment").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(batch).orderBy(key, "segment").rowsBetween(Window.unboundedPreceding, 0)
    return indices, lengths.withColumn("cumulative", F.sum("n").over(upto))


def stack_pairs(df: DataFrame) -> DataFrame:
    """Chosen rows of a batch, then its rejected ones: _ord is the place in the stacked batch order (batch_id, side, _ord)."""
    sides = [F.struct(F.lit(k).alias("side"), *[F.col(f"{name}_{c}").alias(c) for c in PADDING]) for k, name in enumerate(("chosen", "rejected"))]
    rest = [c for c in df.columns if not c.startswith(("chosen_", "rejected_"))]
    return df.select(*rest, F.explode(F.array(*sides)).alias("x")).select(*rest, "x.*")


def stack_feedback(df: DataFrame, batch: int, multiple: int = 1) -> tuple[DataFrame, DataFrame]:
    """Own and neighbour batches, padded apart."""
    own = pad_batches(df.select("_ord", "input_ids", "attention_mask", "labels", "kto_tags"), batch, multiple)
    other = df.select("_ord", *[F.col(f"kl_{c}").alias(c) for c in PADDING]).where(F.col("input_ids").isNotNull())
    return own, pad_batches(other, batch, multiple)


def flatten_media(df: DataFrame, batch: int) -> DataFrame:
    """batch_id with its rows' media end to end and each row's count."""
    rows = df.withColumn("batch_id", F.floor(F.col("_ord") / batch)).groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("_ord", "_images", "_videos", "_audios"))).alias("rows"))
    out = ["batch_id"]
    for kind in ("images", "videos", "audios"):
        field = f"_{kind}"
        lists = F.transform("rows", lambda r: F.coalesce(r[field], F.array()))  # noqa: B023  used at once
        out += [F.flatten(lists).alias(kind), F.transform(lists, F.size).alias(f"{kind}_counts")]
    return rows.select(*out)


def dummy_media(ids: Column, mask: Column, labels: Column, first: Column, no_media: Column, fake: list[int], side: str = "right") -> tuple[Column, Column, Column]:
    """Fake media tokens (mask 0, labels ignored) added to a batch's first row where the batch has no media."""
    add = first & no_media
    token = F.array(*[F.lit(x) for x in fake])
    fill = lambda v: F.array_repeat(F.lit(v), len(fake))
    join = (lambda x, y: F.concat(x, y)) if side == "right" else (lambda x, y: F.concat(y, x))
    return tuple(F.when(add, join(x, y)).otherwise(x) for x, y in ((ids, token), (mask, fill(0)), (labels, fill(IGNORE))))


def slice_media(media: Column, counts: Column, k: Column) -> Column:
    """The k-th row's part of media that lie end to end."""
    before = F.aggregate(F.slice(counts, 1, k), F.lit(0), lambda a, x: a + x)
    return F.slice(media, before + 1, F.get(counts, k))


def micro_batches(df: DataFrame, global_batch: int, micro: int, ranks: int = 1, size: int | None = None) -> DataFrame:
    """df with step, micro, rank; an incomplete last step is dropped."""
    if global_batch % (micro * ranks):
        raise ValueError("the global batch must be a multiple of ranks times micro-batch")
    size = df.agg(F.count("*")).first()[0] if size is None else size
    within = F.pmod("_ord", F.lit(global_batch))
    return df.where(F.col("_ord") < size // global_batch * global_batch).select("*", F.floor(F.col("_ord") / global_batch).alias("step"), F.floor(within / (micro * ranks)).cast("int").alias("micro"), F.pmod(F.floor(within / micro), F.lit(ranks)).cast("int").alias("rank"))


def remaining(df: DataFrame, progress: DataFrame) -> DataFrame:
    """Steps of an epoch that a progress table (epoch, step) doesn't hold."""
    return df.join(progress.select("epoch", "step").distinct(), ["epoch", "step"], "left_anti")


def valid_tokens(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda x: x != IGNORE))


def fixed_slices(df: DataFrame, size: int) -> DataFrame:
    """df with slice: rows in slices of a fixed number, the last one as long as it is."""
    return df.withColumn("slice", F.floor(F.col("_ord") / size))


def resume(df: DataFrame, state: dict, batch: int, size: int | None = None) -> DataFrame:
    """df from a saved state on, with step. state: consumed (rows that were read) and buffered (ordinals read but not yet in a batch, which come first).

    An incomplete last step is dropped.
    """
    buffered = {o: k for k, o in enumerate(state["buffered"])}
    at = F.when(F.col("_ord") >= state["consumed"], F.col("_ord") - state["consumed"] + len(buffered))
    for o, k in buffered.items():
        at = at.when(F.col("_ord") == o, k)
    size = df.agg(F.count("*")).first()[0] if size is None else size
    left = max(size - state["consumed"], 0) + len(buffered)
    placed = df.withColumn("_at", at).where(F.col("_at") < left // batch * batch)
    return placed.withColumn("step", F.floor(F.col("_at") / batch)).drop("_at")


def saved(df: DataFrame, step: int, batch: int, read_ahead: int) -> dict:
    """State behind so many steps when rows are read in groups of read_ahead: what was read, and what of it no batch has taken."""
    taken = step * batch
    consumed = -(-taken // read_ahead) * read_ahead
    return {"consumed": consumed, "buffered": list(range(taken, consumed))}
