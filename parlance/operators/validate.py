"""Row filters and checks of aligned conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.schema import AUDIO, IMAGE, VIDEO

STAGES = ("supervised", "pairwise", "feedback", "unsupervised")


def usable(stage: str, prompt: Column | None = None, response: Column | None = None) -> Column:
    """Whether a row can be encoded in a stage."""
    prompt = F.col("_prompt") if prompt is None else prompt
    response = F.col("_response") if response is None else response
    odd = F.size(prompt) % 2 == 1
    return {"supervised": odd & (F.size(response) == 1), "pairwise": odd & (F.size(response) >= 2), "feedback": odd & (F.size(response) >= 2), "unsupervised": odd}[stage]


def stage_filter(df: DataFrame, stage: str) -> DataFrame:
    return df.where(usable(stage))


def within_cutoff(df: DataFrame, cutoff: int, ids: str = "input_ids") -> DataFrame:
    """Rows short enough to be packed."""
    return df.where(F.size(ids) <= cutoff)


def check_ranking(stage: str, ranking: bool) -> None:
    if stage == "pairwise" and not ranking:
        raise ValueError("a preference stage needs a ranking dataset")
    if stage not in ("pairwise",) and ranking:
        raise ValueError("this stage can't use a ranking dataset")


def placeholders(messages: Column, mark: str) -> Column:
    """Occurrences of a media mark in all messages."""
    return F.aggregate(messages, F.lit(0), lambda n, m: n + ((F.length(m["content"]) - F.length(F.replace(m["content"], F.lit(mark), F.lit("")))) / len(mark)).cast("int"))


def media_matches(messages: Column, images: Column, videos: Column, audios: Column) -> Column:
    """Whether each kind's marks are as many as its files."""
    count = lambda c: F.coalesce(F.when(F.size(c) >= 0, F.size(c)), F.lit(0))
    return (placeholders(messages, IMAGE) == count(images)) & (placeholders(messages, VIDEO) == count(videos)) & (placeholders(messages, AUDIO) == count(audios))


def check_modalities(df: DataFrame, tokens: dict[str, str]) -> DataFrame:
    """df; a row with media that the template has no token for fails when it is read."""
    bad = F.lit(False)
    for kind in ("image", "video", "audio"):
        if kind not in tokens:
            bad = bad | (F.coalesce(F.size(f"_{kind}s"), F.lit(-1)) > 0)
    return df.where(F.when(bad, F.raise_error(F.lit("this template doesn't support the row's media")).cast("boolean")).otherwise(F.lit(True)))


def prepend_placeholders(messages: Column, images: Column, mark: str = IMAGE) -> Column:
    """Media given without any mark: as many marks before the first message."""
    need = (F.coalesce(F.size(images), F.lit(0)) > 0) & ~F.exists(messages, lambda m: m["content"].contains(mark))
    return F.when(need, F.transform(messages, lambda m, i: F.struct(m["role"].alias("role"), F.when(i == 0, F.concat(F.repeat(F.lit(mark), F.size(images)), m["content"])).otherwise(m["content"]).alias("content")))).otherwise(messages)
