"""Sampling, mixing, splitting, merging and distributing ordered tables (all carry _ord, 0..n-1).

Row order is part of the meaning, so it is always explicit. Random choices order rows by a seeded hash, the same for any partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.sources.readers import with_order


def _size(df: DataFrame) -> int:
    return df.agg(F.count("*")).first()[0]


#: Lots are below this.
LOTS = 1 << 60


def lot(seed: int, *keys: str | Column) -> Column:
    """Seeded uniform lot of a row: the first 15 hex digits of the MD5 of "seed:key:...", which any SQL engine can repeat."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def first_n(df: DataFrame, n: int) -> DataFrame:
    """The first n rows."""
    return df.where(F.col("_ord") < n)


def draw(df: DataFrame, n: int, seed: int, size: int | None = None) -> DataFrame:
    """n rows drawn with replacement, with draw_no: row hash(draw_no) mod size."""
    size = _size(df) if size is None else size
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw_no"), F.pmod(lot(seed, "id"), F.lit(max(size, 1))).alias("_ord"))
    return draws.join(df, "_ord")


def permuted(df: DataFrame, seed: int) -> DataFrame:
    """df in a seeded order: _ord is anew, _row the old one. No single-task sort and no large limit."""
    return with_order(df.withColumnRenamed("_ord", "_row").withColumn("_lot", lot(seed, "_row")), ["_lot", "_row"]).drop("_lot")


def sample(df: DataFrame, n: int, seed: int, size: int | None = None) -> DataFrame:
    """n rows: a permutation's first n; beyond the table's size all rows and further draws with replacement. _ord is anew."""
    size = _size(df) if size is None else size
    taken = first_n(permuted(df, seed), n).drop("_row")
    if n > size:
        more = draw(df, n - size, seed + 1, size).withColumn("_ord", F.col("draw_no") + size).drop("draw_no")
        taken = taken.unionByName(more)
    return taken


def resample(df: DataFrame, size: int | None = None, weight: float | None = None, seed: int = 0) -> DataFrame:
    """Second-generation index resampling: size draws with replacement, then int(len * weight) draws."""
    for k, n in enumerate((lambda total: size, lambda total: None if weight is None else int(total * weight))):
        total = _size(df)
        if n(total) is not None:
            df = draw(df, n(total), seed + k, total).drop("_ord").withColumnRenamed("draw_no", "_ord")
    return df


def select_slice(df: DataFrame, start: int | None, stop: int | None, step: int | None = None, size: int | None = None) -> DataFrame:
    """Rows of a Python slice, in its order; _ord is anew."""
    r = range(_size(df) if size is None else size)[slice(start, stop, step)]
    if not len(r):
        return df.where(F.lit(False))
    at = (F.col("_ord") - r.start) / r.step
    return df.where(F.col("_ord").between(min(r[0], r[-1]), max(r[0], r[-1])) & (F.pmod(F.col("_ord") - r.start, F.lit(abs(r.step))) == 0)).withColumn("_ord", at.cast("bigint"))


def select_rows(df: DataFrame, index: list[int], size: int | None = None) -> DataFrame:
    """Rows of an index list, duplicates and order kept."""
    n = _size(df) if any(i < 0 for i in index) and size is None else size
    rows = df.sparkSession.createDataFrame([(k, i + n if i < 0 else i) for k, i in enumerate(index)], "_new bigint, _ord bigint")
    return rows.join(df, "_ord").drop("_ord").withColumnRenamed("_new", "_ord")


def concat(dfs: list[DataFrame]) -> DataFrame:
    """Rows of all tables, in list order."""
    out, offset = None, 0
    for k, df in enumerate(dfs):
        moved = df.withColumn("_ord", F.col("_ord") + offset)
        out = moved if out is None else out.unionByName(moved, allowMissingColumns=True)
        offset += _size(df) if k + 1 < len(dfs) else 0
    return out


def concat_named(named: dict[str, DataFrame]) -> DataFrame:
    """Rows of named datasets end to end, each with its dataset's name in _dataset_name."""
    return concat([df.withColumn("_dataset_name", F.lit(name)) for name, df in named.items()])


def interleave(dfs: list[DataFrame], stop: str = "first_exhausted") -> DataFrame:
    """Round robin. first_exhausted: until the shortest ends; all_exhausted: shorter ones wrap until the longest ends; once: every row once."""
    sizes = [_size(d) for d in dfs]
    out = None
    for k, df in enumerate(dfs):
        if stop == "first_exhausted":
            part = df.where(F.col("_ord") < min(sizes))
        elif stop == "all_exhausted" and 0 < sizes[k] < max(sizes):
            part = df.withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit((max(sizes) - 1) // sizes[k])))).withColumn("_ord", F.col("_ord") + F.col("_round") * sizes[k]).where(F.col("_ord") < max(sizes)).drop("_round")
        else:
            part = df
        part = part.withColumn("_turn", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if stop != "once":
        return out.withColumn("_ord", F.col("_ord") * len(dfs) + F.col("_turn")).drop("_turn")
    # Rows before (ord, turn): those of smaller ord in every table, and of the same ord in earlier ones.
    before = sum((F.least(F.col("_ord"), F.lit(n)) for n in sizes), F.lit(0)) + sum((F.when((F.lit(k) < F.col("_turn")) & (F.col("_ord") < n), 1).otherwise(0) for k, n in enumerate(sizes)), F.lit(0))
    return out.withColumn("_ord", before.cast("bigint")).drop("_turn")


def interleave_weighted(dfs: list[DataFrame], probabilities: list[float], seed: int, stop: str = "first_exhausted") -> DataFrame:
    """Categorical draws of the table that each next row comes from, until one (or every) table is exhausted; shorter ones wrap."""
    if len(dfs) != len(probabilities):
        raise ValueError("as many probabilities as datasets are needed")
    spark, sizes, total = dfs[0].sparkSession, [_size(d) for d in dfs], sum(probabilities)
    edges = [sum(probabilities[: k + 1]) / total for k in range(len(dfs))]
    u = lot(seed, "id") / F.lit(float(LOTS))
    turn = F.coalesce(*[F.when(u < e, F.lit(k)) for k, e in enumerate(edges[:-1])], F.lit(len(dfs) - 1))
    needed = {k for k, (s, p) in enumerate(zip(sizes, probabilities)) if s and p}
    if stop == "first_exhausted" and len(needed) < len(dfs):
        return dfs[0].where(F.lit(False))

    def ranked_draws(n: int) -> DataFrame:
        """Each draw's table and number within it, from per-chunk counts: no single-task window over rows."""
        draws = spark.range(n).select(F.col("id").alias("_new"), turn.alias("_turn"), F.floor(F.col("id") / 65536).alias("_chunk"))
        counts = draws.groupBy("_turn", "_chunk").count()
        offsets = counts.withColumn("_base", F.sum("count").over(Window.partitionBy("_turn").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)))
        ranked = draws.withColumn("_rank", F.row_number().over(Window.partitionBy("_turn", "_chunk").orderBy("_new")))
        return ranked.join(offsets, ["_turn", "_chunk"]).withColumn("_k", F.col("_rank") - 1 + F.coalesce("_base", F.lit(0))).select("_new", "_turn", "_k")

    n, ends = int(max((sizes[k] * total / probabilities[k] for k in needed), default=0) * 1.2) + 64, {}
    while needed:  # draw on until the end is reached, so no mix is short
        ranked = ranked_draws(n)
        last = F.element_at(F.array(*[F.lit(x - 1) for x in sizes]), F.col("_turn") + 1)
        ends = {r[0]: r[1] for r in ranked.where(F.col("_k") == last).select("_turn", "_new").collect()}  # one number a table
        if (stop == "first_exhausted" and ends) or needed <= ends.keys():
            break
        n *= 2
    if not ends:
        return dfs[0].where(F.lit(False))
    end = (min if stop == "first_exhausted" else max)(ends.values())
    out = None
    for k, df in enumerate(dfs):
        picks = ranked.where((F.col("_turn") == k) & (F.col("_new") <= end)).select("_new", F.pmod("_k", F.lit(max(sizes[k], 1))).alias("_ord"))
        part = picks.join(df, "_ord").drop("_ord").withColumnRenamed("_new", "_ord")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def mix(dfs: list[DataFrame], strategy: str = "concat", probabilities: list[float] | None = None, seed: int = 42) -> DataFrame:
    """The configured mix; one table is returned as it is."""
    if len(dfs) == 1:
        return dfs[0]
    if strategy == "concat":
        if probabilities:
            raise ValueError("probabilities don't go with concat")
        return concat(dfs)
    stop = {"interleave_under": "first_exhausted", "interleave_over": "all_exhausted", "interleave_once": "once"}[strategy]
    return interleave_weighted(dfs, probabilities, seed, stop) if probabilities else interleave(dfs, stop)


@dataclass
class Module:
    """Training table and evaluation tables."""

    train: DataFrame | None = None
    eval: dict[str, DataFrame] = field(default_factory=dict)


def holdout(df: DataFrame, val_size: float, seed: int, size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, validation): an integer count above 1, a fraction otherwise (rounded up), by seeded order."""
    size = _size(df) if size is None else size
    n = int(val_size) if val_size > 1 else -int(-size * val_size // 1)
    picked = first_n(permuted(df.select("_ord"), seed), n).select(F.col("_row").alias("_ord"))
    return df.join(picked, "_ord", "left_anti"), df.join(picked, "_ord", "left_semi")


def holdout_stream(df: DataFrame, fraction: float, seed: int, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(train, validation) by a hash threshold of the keys; works on streams."""
    held = F.pmod(lot(seed, *keys), F.lit(1_000_000)) < int(fraction * 1_000_000)
    return df.where(~held), df.where(held)


def split(train: DataFrame | None, evals: dict[str, DataFrame] | DataFrame | None, val_size: float, seed: int) -> Module:
    """Named splits: held-out rows, or separate evaluation tables, not both."""
    if evals is not None and val_size:
        raise ValueError("val_size and evaluation datasets exclude each other")
    if val_size and train is not None:
        train, held = holdout(train, val_size, seed)
        return Module(train, {"validation": held})
    if isinstance(evals, dict):
        return Module(train, {f"validation_{k}": d for k, d in evals.items()})
    return Module(train, {"validation": evals} if evals is not None else {})


def merge_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: its last value in order, at its first position (_ord). Two-phase aggregation, so a hot key is reduced where it lies."""
    rest = [c for c in df.columns if c not in (key, order)]
    got = df.groupBy(key).agg(F.min(order).alias("_ord"), F.max_by(F.struct(*rest), order).alias("_last"))
    return got.select(key, "_ord", *[F.col("_last")[c].alias(c) for c in rest])


def pending(tasks: DataFrame, done: list[DataFrame], key: str) -> DataFrame:
    """Tasks whose key no finished table holds."""
    for d in done:
        tasks = tasks.join(d.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return tasks


def epoch_order(df: DataFrame, seed: int, epoch: int, world: int, drop_last: bool = True, size: int | None = None) -> DataFrame:
    """df with rank and step: a permutation by seed + epoch, dealt to ranks in turn."""
    size = _size(df) if size is None else size
    ordered = permuted(df, seed + epoch)
    kept = ordered.where(F.col("_ord") < (size // world * world if drop_last else size))
    return kept.withColumn("rank", F.pmod("_ord", F.lit(world)).cast("int")).withColumn("step", F.floor(F.col("_ord") / world)).drop("_ord").withColumnRenamed("_row", "_ord")


def balance(tasks: DataFrame, workers: int, key: str = "id", load: str = "load") -> DataFrame:
    """key, load, worker: largest first to the least loaded worker, the lowest number on ties. Loads are ranked once; a group holds keys and loads only."""
    import heapq

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["load", "_ord"], ascending=[False, True], kind="stable")
        heap, out = [(0, w) for w in range(workers)], []
        for x in pdf["load"].tolist():
            total, w = heapq.heappop(heap)
            out.append(w)
            heapq.heappush(heap, (total + x, w))
        return pd.DataFrame({"key": pdf["key"], "load": pdf["load"], "worker": out})

    rows = tasks.select(F.lit(0).alias("all"), F.col(key).alias("key"), F.col(load).cast("bigint").alias("load"), F.col("_ord"))
    kind = dict(tasks.dtypes)[key]
    return rows.groupBy("all").applyInPandas(lambda p: assign(p), f"key {kind}, load bigint, worker int").withColumnRenamed("key", key)


def errors_for_missing(manifest: DataFrame, files: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(runnable tasks, error rows) by whether each task's file is known."""
    known = files.select(F.col(path)).distinct()
    lost = manifest.join(known, path, "left_anti").select("*", F.lit(-1.0).alias("p"), F.lit("ERROR").alias("pred"), F.lit(-1).alias("pred_class"), F.lit("file not found").alias("error"))
    return manifest.join(known, path, "left_semi"), lost


def loaded(df: DataFrame, load: Callable[[dict], dict], fields: str, threads: int = 6, ahead: int = 64) -> DataFrame:
    """df with the fields that load(row) gives and error: a row whose loading fails keeps its place with the error's text and null fields.

    Each task loads ahead in threads, so many rows at a time and no more; rows come out in order.
    """
    names = df.columns
    made = df.sparkSession.createDataFrame([], fields).columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(row: dict) -> tuple[dict, str | None]:
            try:
                return load(row), None
            except Exception as x:  # noqa: BLE001  whatever fails is the row's error
                return {}, f"{type(x).__name__}: {x}"

        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                for at in range(0, len(pdf), ahead):
                    part = pdf.iloc[at : at + ahead].reset_index(drop=True)
                    got = list(pool.map(one, part.to_dict("records")))
                    for c in made:
                        part[c] = pd.Series([g.get(c) for g, _ in got], dtype=object)
                    part["error"] = pd.Series([e for _, e in got], dtype=object)
                    yield part[[*names, *made, "error"]]

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{kinds}, {fields}, error string")


def stem(path: Column) -> Column:
    """File name without folders and without its last extension; a leading dot is no extension."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.when(name.rlike(r"^\.[^.]*$") | name.rlike(r"\.$"), name).otherwise(F.regexp_replace(name, r"(.)\.[^.]*$", "$1"))


def match_truth(predictions: DataFrame, truth: DataFrame, key: str = "stem", order: str = "_ord") -> tuple[DataFrame, DataFrame]:
    """(scored rows, predictions without truth): the truth's last row per key, all predictions."""
    last = truth.groupBy(key).agg(F.max_by("label", order).alias("label"))
    joined = predictions.join(last, key, "left")
    return joined.where(F.col("label").isNotNull()), joined.where(F.col("label").isNull()).drop("label")


def support_set(questions: DataFrame, support: DataFrame, n: int, seed: int) -> DataFrame:
    """question_id with its n support rows in a seeded order: each question takes a run of n places in the subject's shuffled ring."""
    ring = support.withColumn("_place", F.row_number().over(Window.partitionBy("subject").orderBy(lot(seed, "support_id"), "support_id")) - 1)
    sizes = support.groupBy("subject").agg(F.count("*").alias("_n"))
    asks = questions.join(sizes, "subject").withColumn("_k", F.explode(F.sequence(F.lit(0), F.least(F.lit(n), F.col("_n").cast("int")) - 1)))
    asks = asks.withColumn("_place", F.pmod(lot(seed + 1, "question_id") + F.col("_k"), F.col("_n")).cast("int"))
    return asks.select("question_id", "subject", "_k", "_place").join(ring, ["subject", "_place"]).drop("_place").withColumnRenamed("_k", "shot")
