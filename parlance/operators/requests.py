"""Chat-completion requests to canonical messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.operators.align import alternates, call_text
from parlance.schema import ASSISTANT, FUNCTION, OBSERVATION, USER, message

ROLES = {"user": USER, "assistant": ASSISTANT, "tool": OBSERVATION, "function": FUNCTION}


def request_messages(turns: Column) -> Column:
    """struct(system, messages, valid) of array<struct<role, content>>: a leading system message apart, roles mapped, an odd alternating count required."""
    leads = F.coalesce(F.get(turns, F.lit(0))["role"] == "system", F.lit(False))
    rest = F.when(leads, F.slice(turns, 2, F.greatest(F.size(turns) - 1, F.lit(0)))).otherwise(turns)
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    mapped = F.transform(rest, lambda m: message(F.try_element_at(role, m["role"]), m["content"]))
    return F.struct(F.when(leads, F.get(turns, F.lit(0))["content"]).alias("system"), mapped.alias("messages"), ((F.size(mapped) % 2 == 1) & alternates(mapped)).alias("valid"))


def multimodal_text(parts: Column) -> Column:
    """Text of typed parts with a placeholder for each media part."""
    mark = {"image_url": "<image>", "video_url": "<video>", "audio_url": "<audio>"}
    text = lambda p: F.coalesce(*[F.when(p["type"] == k, F.lit(v)) for k, v in mark.items()], p["text"])
    return F.array_join(F.transform(parts, text), "")


#: Kinds of inline media by their type; others are addresses.
INLINE = r"^data:(image/(png|jpg|jpeg|gif|bmp)|video/(mp4|mkv|avi|mov)|audio/(mpeg|mp3|wav|ogg));base64,(.+)$"


def request_media(parts: Column) -> Column:
    """array<struct<kind, path, data>> of the media parts in order: inline bytes, or the address (a local path or a uri) that a loader reads."""
    found = F.filter(parts, lambda p: p["type"].isin("image_url", "video_url", "audio_url"))

    def one(p: Column) -> Column:
        inline = p["url"].rlike(INLINE)
        return F.struct(
            F.regexp_replace(p["type"], "_url$", "").alias("kind"), F.when(~inline, p["url"]).alias("path"),
            F.when(inline, F.unbase64(F.substring_index(p["url"], ",", -1))).alias("data"),
        )

    return F.transform(found, one)


def call_content(calls: Column) -> Column:
    """An answer's tool calls as the JSON content of a function turn."""
    return F.concat(F.lit("["), F.array_join(F.transform(calls, lambda c: call_text(c["function"])), ", "), F.lit("]"))
