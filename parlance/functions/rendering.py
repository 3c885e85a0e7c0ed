"""Second-generation rendering: messages of typed parts to text segments with loss weights, and generated text back to parts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.schema import IGNORE

SEGMENTS = "array<struct<text:string,weight:double>>"
PARTS = "array<struct<type:string,value:string>>"
_TOOLS_HEAD = "# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>"
_TOOLS_TAIL = '\n</tools>\n\nFor each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n<tool_call>\n{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call><|im_end|>\n'


def part_text(m: Column) -> Column:
    """A message's text parts joined; another kind of part is an error."""
    bad = F.exists(m["content"], lambda p: p["type"] != "text")
    return F.when(bad, F.raise_error(F.lit("a part isn't text")).cast("string")).otherwise(F.array_join(F.transform(m["content"], lambda p: p["value"]), ""))


def chatml_segments(messages: Column, generate: bool = False) -> Column:
    """One segment per message, its text and weight (1 for answers by default)."""
    weight = lambda m: F.coalesce(m["loss_weight"], F.when(m["role"] == "assistant", 1.0).otherwise(0.0))
    out = F.transform(messages, lambda m: F.struct(F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), part_text(m), F.lit("<|im_end|>\n")).alias("text"), weight(m).alias("weight")))
    return F.concat(out, F.array(F.struct(F.lit("<|im_start|>assistant\n").alias("text"), F.lit(0.0).alias("weight")))) if generate else out


def segment_inputs(segments: Column, encode) -> Column:
    """struct(input_ids, labels, loss_weights, position_ids): segments encoded apart, labels ignored at weight 1e-6 or less; positions begin at 1."""
    coded = F.transform(segments, lambda s: F.struct(encode(s["text"]).alias("ids"), s["weight"].alias("w")))
    ids = F.flatten(F.transform(coded, lambda c: c["ids"]))
    labels = F.flatten(F.transform(coded, lambda c: F.when(c["w"] > 1e-6, c["ids"]).otherwise(F.array_repeat(F.lit(IGNORE), F.size(c["ids"])))))
    weights = F.flatten(F.transform(coded, lambda c: F.array_repeat(c["w"], F.size(c["ids"]))))
    return F.struct(ids.alias("input_ids"), labels.alias("labels"), weights.alias("loss_weights"), F.when(F.size(ids) > 0, F.sequence(F.lit(1), F.size(ids))).otherwise(F.array().cast("array<int>")).alias("position_ids"))


def pair_inputs(chosen: Column, rejected: Column) -> Column:
    """Chosen and rejected inputs end to end, token types 1 and 2."""
    joined = [F.concat(chosen[c], rejected[c]).alias(c) for c in ("input_ids", "labels", "loss_weights", "position_ids")]
    types = F.concat(F.array_repeat(F.lit(1), F.size(chosen["input_ids"])), F.array_repeat(F.lit(2), F.size(rejected["input_ids"])))
    return F.struct(*joined, types.alias("token_type_ids"))


def _plain(message: dict) -> str | None:
    return "".join(p["value"] for p in message["content"]) if all(p["type"] == "text" for p in message["content"]) else None


def last_query(messages: list[dict]) -> int:
    """Place of the last user text that isn't a wrapped tool reply; the last message if there is none."""
    for i in range(len(messages) - 1, -1, -1):
        text = _plain(messages[i]) if messages[i]["role"] == "user" else None
        if text is not None and not (text.startswith("<tool_response>") and text.endswith("</tool_response>")):
            return i
    return len(messages) - 1


def thinking_segments(messages: list[dict], tools: str | None = None, generate: bool = False, thinking: bool = False, words: tuple[str, str] | None = ("<think>", "</think>")) -> list[tuple[str, float]]:
    """Segments of a dialogue with reasoning, tool calls and tool replies. words: marks of the thought block; None renders none."""
    out: list[tuple[str, float]] = []
    weight = lambda m, default: m["loss_weight"] if m.get("loss_weight") is not None else default
    head = messages[0] if messages[0]["role"] == "system" else None

    def text_of(m: dict) -> str:
        text = _plain(m)
        if text is None:
            raise ValueError("a part isn't text")
        return text

    if tools:
        listed = json.loads(tools)
        listed = listed if isinstance(listed, list) else [listed]
        own = text_of(head) + "\n\n" if head else ""
        out.append(("<|im_start|>system\n" + own + _TOOLS_HEAD + "".join("\n" + json.dumps(t, ensure_ascii=False) for t in listed) + _TOOLS_TAIL, weight(head, 0.0) if head else 0.0))
    elif head:
        out.append((f"<|im_start|>system\n{text_of(head)}<|im_end|>\n", weight(head, 0.0)))
    query, last = last_query(messages), len(messages) - 1
    for i, m in enumerate(messages):
        role = m["role"]
        if role == "user" or (role == "system" and i):
            out.append((f"<|im_start|>{role}\n{text_of(m)}<|im_end|>\n", weight(m, 0.0)))
        elif role == "assistant":
            by = lambda kind, m=m: [p["value"] for p in m["content"] if p["type"] == kind]
            text, thought = "".join(by("text")), "".join(by("reasoning"))
            body = text
            if words and i > query and (i == last or thought):
                body = f"{words[0]}\n" + thought.strip("\n") + f"\n{words[1]}\n\n" + text.lstrip("\n")
            for k, call in enumerate(json.loads(c) for c in by("tool_call")):
                given = call.get("arguments")
                body += ("\n" if text or k else "") + '<tool_call>\n{"name": "' + call["name"] + '", "arguments": ' + (given if isinstance(given, str) else json.dumps(given, ensure_ascii=False)) + "}\n</tool_call>"
            out.append((f"<|im_start|>assistant\n{body}<|im_end|>\n", weight(m, 1.0)))
        elif role == "tool":
            opens = i == 0 or messages[i - 1]["role"] != "tool"
            closes = i == last or messages[i + 1]["role"] != "tool"
            out.append((("<|im_start|>user" if opens else "") + f"\n<tool_response>\n{text_of(m)}\n</tool_response>" + ("<|im_end|>\n" if closes else ""), weight(m, 0.0)))
    if generate:
        out.append(("<|im_start|>assistant\n" + (f"{words[0]}\n\n{words[1]}\n\n" if words and not thinking else ""), 0.0))
    return out


def render_thinking(messages: Column, tools: Column, generate: bool = False, words: tuple[str, str] | None = ("<think>", "</think>")) -> Column:
    """thinking_segments over columns; messages as JSON text keeps the nested shape."""

    @F.pandas_udf(SEGMENTS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for m, t in batches:
            yield pd.Series([[{"text": a, "weight": w} for a, w in thinking_segments(json.loads(x), y, generate, False, words)] for x, y in zip(m, t)])

    return run(F.to_json(messages), tools)


def parse_parts(text: str, words: str = "think") -> list[dict[str, str]]:
    """Generated text as text, reasoning and tool-call parts in order; a tool call that isn't JSON is an error."""
    parts, at = [], 0

    def plain(a: int, z: int) -> None:
        if text[a:z].strip():
            parts.append({"type": "text", "value": text[a:z].strip()})

    for m in re.finditer(rf"<({words}|tool_call)>\s*(.*?)\s*</\1>\s*", text, re.S):
        plain(at, m.start())
        if m[1] == "tool_call":
            json.loads(m[2])
        parts.append({"type": "tool_call" if m[1] == "tool_call" else "reasoning", "value": m[2].strip()})
        at = m.end()
    plain(at, len(text))
    return parts


def parse(text: Column, words: str = "think") -> Column:
    @F.pandas_udf(PARTS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: parse_parts(t, words), na_action="ignore")

    return run(text)
