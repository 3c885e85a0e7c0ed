"""Canonical schemas and constants of aligned conversations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE = -100
MESSAGE = "struct<role:string,content:string>"
MESSAGES = f"array<{MESSAGE}>"
USER, ASSISTANT, SYSTEM, OBSERVATION, FUNCTION = "user", "assistant", "system", "observation", "function"
ASKING, ANSWERING = (USER, OBSERVATION), (ASSISTANT, FUNCTION)
IMAGE, VIDEO, AUDIO = "<image>", "<video>", "<audio>"


def message(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.cast("string").alias("content"))


def messages(*items: Column) -> Column:
    return F.array(*items).cast(MESSAGES)
