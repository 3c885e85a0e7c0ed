"""The chat format that comes with a bundled model: typed content, numbered media, reasoning, tool calls and replies."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.rendering import last_query
from parlance.functions.toolcalls import QWEN35_PROMPT

_OPEN, _CLOSE = "<|im_start|>", "<|im_end|>\n"
#: A media part's text and its name where parts are numbered.
_MEDIA = {"image": ("<|vision_start|><|image_pad|><|vision_end|>", "Picture"), "video": ("<|vision_start|><|video_pad|><|vision_end|>", "Video")}


class _Content:
    """Texts of message contents; numbers media on where asked to."""

    def __init__(self, numbered: bool):
        self.numbered, self.seen = numbered, dict.fromkeys(_MEDIA, 0)

    def text(self, content, count: bool = True, system: bool = False) -> str:
        if content is None or isinstance(content, str):
            return (content or "").strip()
        return "".join(self._part(p, count, system) for p in content).strip()

    def _part(self, part: dict, count: bool, system: bool) -> str:
        kind = next((k for k in _MEDIA if part.get("type") == k or k in part or f"{k}_url" in part and k == "image"), None)
        if kind is None:
            if "text" not in part:
                raise ValueError("unexpected kind of part")
            return part["text"]
        if system:
            raise ValueError("system messages hold no media")
        self.seen[kind] += count
        mark, name = _MEDIA[kind]
        return (f"{name} {self.seen[kind]}: " if self.numbered else "") + mark


def _scalar(value) -> str:
    return json.dumps(value, ensure_ascii=False) if isinstance(value, dict | list) else str(value)


def _calls(calls: list[dict], behind_text: bool) -> str:
    blocks = []
    for call in calls:
        call = call.get("function", call)
        given = "".join(f"<parameter={k}>\n{_scalar(v)}\n</parameter>\n" for k, v in (call.get("arguments") or {}).items())
        blocks.append(f"<tool_call>\n<function={call['name']}>\n{given}</function>\n</tool_call>")
    return ("\n\n" if behind_text and blocks else "") + "\n".join(blocks)


def _thought(message: dict, text: str) -> tuple[str, str]:
    """(reasoning, answer): a field of its own, or what stands in the text before the last closing word."""
    if isinstance(message.get("reasoning_content"), str):
        return message["reasoning_content"].strip(), text
    before, found, _ = text.partition("</think>")
    if not found:
        return "", text
    return before.rstrip("\n").rpartition("<think>")[2].strip(), text.rpartition("</think>")[2].lstrip("\n")


def chat_text(messages: list[dict], tools: list[dict] | None = None, generate: bool = False, thinking: bool = True, numbered: bool = False) -> str:
    """A dialogue as text. numbered: media parts carry their number. Errors are those of the format: no message, no query, a late system message."""
    if not messages:
        raise ValueError("no messages")
    show, plain = _Content(numbered), _Content(False)
    head = plain.text(messages[0].get("content"), False, True) if messages[0]["role"] == "system" else None
    out = []
    if tools:
        listed = QWEN35_PROMPT.format(tools="".join("\n" + json.dumps(t, ensure_ascii=False) for t in tools)).lstrip("\n")
        out.append(f"{_OPEN}system\n{listed}" + (f"\n\n{head}" if head else "") + _CLOSE)
    elif head is not None:
        out.append(f"{_OPEN}system\n{head}{_CLOSE}")
    flat = [{"role": m["role"], "content": [{"type": "text", "value": plain.text(m.get("content"))}]} for m in messages]
    query = last_query(flat)
    if flat[query]["role"] != "user" or _is_reply(flat[query]):
        raise ValueError("no query among the messages")
    for i, m in enumerate(messages):
        role, text = m["role"], show.text(m.get("content"), system=m["role"] == "system")
        if role == "system" and i:
            raise ValueError("a system message must come first")
        if role == "user":
            out.append(f"{_OPEN}user\n{text}{_CLOSE}")
        elif role == "assistant":
            reasoning, text = _thought(m, text)
            opened = f"<think>\n{reasoning}\n</think>\n\n" if i > query else ""
            out.append(f"{_OPEN}assistant\n{opened}{text}{_calls(m.get('tool_calls') or [], bool(text.strip()))}{_CLOSE}")
        elif role == "tool":
            first, last = i > 0 and messages[i - 1]["role"] != "tool", i == len(messages) - 1 or messages[i + 1]["role"] != "tool"
            out.append((f"{_OPEN}user" if first else "") + f"\n<tool_response>\n{text}\n</tool_response>" + (_CLOSE if last else ""))
        elif role != "system":
            raise ValueError(f"unexpected role {role}")
    if generate:
        out.append(f"{_OPEN}assistant\n" + ("<think>\n" if thinking else "<think>\n\n</think>\n\n"))
    return "".join(out)


def _is_reply(message: dict) -> bool:
    text = message["content"][0]["value"]
    return text.startswith("<tool_response>") and text.endswith("</tool_response>")


def render(messages: Column, tools: Column | None = None, generate: bool = False, thinking: bool = True, numbered: bool = False) -> Column:
    """chat_text over columns: messages as array of structs, tools as JSON text."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for m, t in batches:
            yield pd.Series([chat_text(json.loads(x), json.loads(y) if y else None, generate, thinking, numbered) for x, y in zip(m, t)])

    return run(F.to_json(messages), tools if tools is not None else F.lit(None).cast("string"))
