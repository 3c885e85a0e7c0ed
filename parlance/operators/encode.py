"""Encoding of rendered turns to ids and labels: budgets, masks, truncation, packing.

Everything that is per row is a Column expression over token arrays; packing groups by batch, as the batch is part of its meaning.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.schema import IGNORE

INTS = "array<int>"


def _ints() -> Column:
    return F.array().cast(INTS)


def budget(source: Column, target: Column, cutoff) -> tuple[Column, Column]:
    """Lengths kept of a source and a target within a cutoff: a short target is kept, else a short source, else in proportion."""
    cutoff = F.lit(cutoff) if isinstance(cutoff, int) else cutoff
    share = F.when(target * 2 < cutoff, cutoff).when(source * 2 < cutoff, cutoff - source).otherwise((cutoff * (target / F.greatest(source + target, F.lit(1)))).cast("int"))
    kept = F.least(share, target).cast("int")
    return F.least(F.greatest(cutoff - kept, F.lit(0)), source).cast("int"), kept


def _ignored(n: Column) -> Column:
    return F.array_repeat(F.lit(IGNORE), n).cast(INTS)


def supervised(pairs: Column, cutoff: int, train_on_prompt: bool = False, mask_history: bool = False, efficient_eos: bool = False, eos: int = 2) -> Column:
    """struct(input_ids, labels) of array<struct<source, target>> token pairs.

    mask_history: the last pair first, and only it is learned. efficient_eos: later sources begin with an end label, and an end is added.
    """
    ordered = F.reverse(pairs) if mask_history else pairs
    start = F.struct(_ints().alias("ids"), _ints().alias("labels"), F.lit(int(efficient_eos)).alias("used"), F.lit(0).alias("turn"))

    def step(acc: Column, p: Column) -> Column:
        s, t = budget(F.size(p["source"]), F.size(p["target"]), F.lit(cutoff) - acc["used"])
        full = acc["used"] >= cutoff
        source, target = F.slice(p["source"], 1, s).cast(INTS), F.slice(p["target"], 1, t).cast(INTS)
        if train_on_prompt:
            s_label = source
        elif efficient_eos:
            s_label = F.when((acc["turn"] != 0) & (s > 0), F.concat(F.array(F.lit(eos)), _ignored(s - 1))).otherwise(_ignored(s))
        else:
            s_label = _ignored(s)
        t_label = F.when(acc["turn"] != 0, _ignored(t)).otherwise(target) if mask_history else target
        new, label = F.concat(source, target), F.concat(s_label, t_label)
        ids, labels = (F.concat(new, acc["ids"]), F.concat(label, acc["labels"])) if mask_history else (F.concat(acc["ids"], new), F.concat(acc["labels"], label))
        go = F.struct(ids.alias("ids"), labels.alias("labels"), (acc["used"] + s + t).alias("used"), (acc["turn"] + 1).alias("turn"))
        return F.when(full, acc).otherwise(go)

    tail = F.array(F.lit(eos)) if efficient_eos else _ints()
    return F.aggregate(ordered, start, step, lambda acc: F.struct(F.concat(acc["ids"], tail).alias("input_ids"), F.concat(acc["labels"], tail).alias("labels")))


def supervised_lengths(pairs: Column, cutoff: int, mask_history: bool = False, efficient_eos: bool = False) -> Column:
    """struct(total, learned): lengths of supervised() from array<struct<source int, target int>>, without touching tokens."""
    ordered = F.reverse(pairs) if mask_history else pairs
    start = F.struct(F.lit(int(efficient_eos)).alias("total"), F.lit(int(efficient_eos)).alias("learned"), F.lit(0).alias("turn"))

    def step(acc: Column, p: Column) -> Column:
        s, t = budget(p["source"], p["target"], F.lit(cutoff) - acc["total"])
        learned = F.when(acc["turn"] == 0, t).otherwise(0) if mask_history else t
        return F.when(acc["total"] >= cutoff, acc).otherwise(F.struct((acc["total"] + s + t).alias("total"), (acc["learned"] + learned).alias("learned"), (acc["turn"] + 1).alias("turn")))

    return F.aggregate(ordered, start, step, lambda acc: F.struct(acc["total"].alias("total"), acc["learned"].alias("learned")))


def mask(ids: Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(ids))


def pairwise(prompt: Column, chosen: Column, rejected: Column, cutoff: int, eos: int | None = None) -> Column:
    """struct of chosen and rejected input_ids and labels; one prompt, the budget of the longer answer."""
    if eos is not None:
        chosen, rejected = F.concat(chosen, F.array(F.lit(eos))), F.concat(rejected, F.array(F.lit(eos)))
    s, t = budget(F.size(prompt), F.greatest(F.size(chosen), F.size(rejected)), cutoff)
    head = F.slice(prompt, 1, s)
    out = []
    for name, answer in (("chosen", chosen), ("rejected", rejected)):
        cut = F.slice(answer, 1, t)
        out += [F.concat(head, cut).alias(f"{name}_input_ids"), F.concat(_ignored(s), cut).alias(f"{name}_labels")]
    return F.struct(*out)


def feedback(prompt: Column, answer: Column, kl_answer: Column, cutoff: int) -> Column:
    """struct of input_ids and labels for a row's own answer and for its neighbour's (null where there is none)."""
    out = []
    for name, a in (("", answer), ("kl_", kl_answer)):
        s, t = budget(F.size(prompt), F.size(a), cutoff)
        cut = F.slice(a, 1, t)
        out += [F.concat(F.slice(prompt, 1, s), cut).alias(f"{name}input_ids"), F.concat(_ignored(s), cut).alias(f"{name}labels")]
    return F.struct(*out)


def rotate_answers(df: DataFrame, value: str, out: str, batch: int = 1000) -> DataFrame:
    """Each row with the value of the row before it in its batch; the first takes the batch's last."""
    by = Window.partitionBy(F.floor(F.col("_ord") / batch)).orderBy("_ord")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn(out, F.when(F.row_number().over(by) == 1, F.last(value).over(whole)).otherwise(F.lag(value).over(by)))


def desirable(response: Column) -> Column:
    """Whether a tagged row's own answer is the preferred one."""
    return F.get(response, F.lit(0))["content"] != ""


def unsupervised(prompt: Column, response: Column, cutoff: int, eos: int | None = None) -> Column:
    """struct(input_ids, labels): prompt and answer, of different lengths."""
    target = F.concat(response, F.array(F.lit(eos))) if eos is not None else response
    s, t = budget(F.size(prompt), F.size(target), cutoff)
    return F.struct(F.slice(prompt, 1, s).alias("input_ids"), F.slice(target, 1, t).alias("labels"))


def pretrain(ids: Column, cutoff: int, bos: int | None = None) -> Column:
    """Ids of a text (its end included) with an optional begin, cut."""
    return F.slice(F.concat(F.array(F.lit(bos)), ids) if bos is not None else ids, 1, cutoff)


def pretrain_blocks(df: DataFrame, ids: str, block: int, batch: int = 1000, bos: int | None = None) -> DataFrame:
    """(batch_id, block_id, input_ids): a batch's ids end to end, cut in blocks, the rest dropped; bos replaces each block's first id.

    Only pieces move: each row is sliced where blocks begin, and a block's pieces are put together.
    """
    own = df.select(F.floor(F.col("_ord") / batch).alias("batch_id"), "_ord", F.col(ids).alias("ids"), F.size(ids).cast("bigint").alias("n"))
    at = F.sum("n").over(Window.partitionBy("batch_id").orderBy("_ord").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    placed = own.where("n > 0").withColumn("at", at)
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("n") - 1) / block)
    pieces = placed.withColumn("block_id", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("block_id") * block, F.col("at"))
    end = F.least((F.col("block_id") + 1) * block, F.col("at") + F.col("n"))
    pieces = pieces.select("batch_id", "block_id", "_ord", F.slice("ids", (begin - F.col("at") + 1).cast("int"), (end - begin).cast("int")).alias("piece"))
    joined = pieces.groupBy("batch_id", "block_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_ord", "piece"))), lambda x: x["piece"])).alias("input_ids"))
    full = joined.where(F.size("input_ids") == block)
    return full.withColumn("input_ids", F.concat(F.array(F.lit(bos)), F.slice("input_ids", 2, block - 1))) if bos is not None else full


def knapsacks(lengths: list[int], capacity: int) -> list[list[int]]:
    """Greedy packing: each sack takes the longest length that still fits, until none does. Indexes of the lengths; equal ones, last first."""
    places: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        if n > capacity:
            raise ValueError("a length is above the capacity")
        places.setdefault(n, []).append(i)
    open_ = sorted(places)
    out = []
    while open_:
        sack, room = [], capacity
        while (k := bisect_right(open_, room)) > 0:
            n = open_[k - 1]
            sack.append(places[n].pop())
            room -= n
            if not places[n]:
                open_.pop(k - 1)
            if room <= 0 and (not open_ or open_[0] > 0):
                break
        out.append(sack)
    return out


def pack(df: DataFrame, cutoff: int, batch: int = 1000, neat: bool = False, pad: int = 0) -> DataFrame:
    """(batch_id, sack, input_ids, labels, attention_mask, position_ids, boundaries, padding): rows of a batch packed into sequences of cutoff + 1.

    Rows above cutoff are dropped before. neat: the mask numbers the sub-sequences (padding 0), else it is 1.
    """
    rows = df.where((F.size("input_ids") <= cutoff) & (F.size("input_ids") > 0)).select(F.floor(F.col("_ord") / batch).alias("batch_id"), "_ord", "input_ids", "labels")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_ord").reset_index(drop=True)
        out = []
        for k, sack in enumerate(knapsacks([len(x) for x in pdf["input_ids"]], cutoff)):
            ids, labels, seen, positions, bounds = [], [], [], [], [0]
            for j, i in enumerate(sack):
                n = len(pdf["input_ids"][i])
                ids += list(pdf["input_ids"][i])
                labels += list(pdf["labels"][i])
                seen += [j + 1 if neat else 1] * n
                positions += range(n)
                bounds.append(bounds[-1] + n)
            room = cutoff + 1 - len(ids)
            out.append((pdf["batch_id"][0], k, ids + [pad] * room, labels + [IGNORE] * room, seen + [0 if neat else 1] * room, positions + [0] * room, [*bounds, cutoff + 1] if room else bounds, room))
        return pd.DataFrame(out, columns=["batch_id", "sack", "input_ids", "labels", "attention_mask", "position_ids", "boundaries", "padding"])

    schema = "batch_id bigint, sack int, input_ids array<int>, labels array<int>, attention_mask array<int>, position_ids array<int>, boundaries array<int>, padding int"
    return rows.groupBy("batch_id").applyInPandas(one, schema)


def packing_flags(packing: bool | None, neat: bool, cutoff: int, stage: str) -> tuple[bool, bool, int]:
    """(packing, neat, cutoff): neat implies packing, packing costs one of the cutoff, pre-training packs by default at no cost."""
    packing = bool(packing) or neat
    cut = cutoff - 1 if packing else cutoff
    return packing or (stage == "pretrain" and packing is not True), neat, cut


def visible_labels(labels: Column) -> Column:
    return F.filter(labels, lambda x: x != IGNORE)


def one_class(response: Column) -> list[Column]:
    """Counts of desirable and undesirable rows, to warn of a single class."""
    return [F.count_if(desirable(response)).alias("desirable"), F.count_if(~desirable(response)).alias("undesirable")]
