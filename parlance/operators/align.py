"""Alignment of raw rows to canonical conversations, as Column expressions.

A converter maps a SourceSpec to the columns _prompt, _response, _system, _tools, _images, _videos, _audios; ``align`` applies one with its source
label and drops everything else, so that any sources can be united.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.schema import ANSWERING, ASKING, ASSISTANT, FUNCTION, OBSERVATION, SYSTEM, USER, message, messages
from parlance.sources.catalog import SourceSpec

TOOL_JOINT = "\n</tool_response>\n<tool_response>\n"
THINKING_OFF = "detailed thinking off"


def _kind(df: DataFrame, name: str | None):
    return next((f.dataType.typeName() for f in df.schema.fields if f.name == name), None) if name else None


def _text(df: DataFrame, name: str | None) -> Column:
    return F.col(name).cast("string") if _kind(df, name) else F.lit("")


def _media(df: DataFrame, name: str | None) -> Column:
    """A list, a scalar as a list of one, null where empty."""
    kind = _kind(df, name)
    if kind is None:
        return F.lit(None).cast("array<string>")
    value = F.col(name) if kind == "array" else F.when(F.col(name).isNotNull(), F.array(F.col(name)))
    return F.when(F.size(value) > 0, value)


def _tagged(df: DataFrame, spec: SourceSpec, last: Column, normal: Column, pair: Column | None) -> tuple[Column | None, Column]:
    """Whether rows carry a boolean tag, and their (preferred, other) answers."""
    if _kind(df, spec.kto_tag) == "boolean":
        tag, empty = F.col(spec.kto_tag), message(ASSISTANT, F.lit(""))
        out = F.when(tag, messages(last, empty)).when(~tag, messages(empty, last))
        return tag.isNotNull(), out.otherwise(normal if pair is None else F.when(pair.isNotNull(), pair).otherwise(normal))
    return None, normal if pair is None else F.when(pair.isNotNull(), pair).otherwise(normal)


def alpaca(df: DataFrame, spec: SourceSpec) -> dict[str, Column]:
    kinds = {n: _kind(df, n) for n in (spec.prompt, spec.query, spec.response, spec.history, spec.chosen, spec.rejected) if n}
    prompt, query = (F.nullif(_text(df, n), F.lit("")) for n in (spec.prompt, spec.query))
    turns = messages(message(USER, F.concat_ws("\n", prompt, query)))
    if kinds.get(spec.history) == "array":
        pairs = F.transform(F.coalesce(F.col(spec.history), F.array()), lambda h: messages(message(USER, F.get(h, F.lit(0))), message(ASSISTANT, F.get(h, F.lit(1)))))
        turns = F.concat(F.flatten(pairs), turns)
    response = F.col(spec.response) if kinds.get(spec.response) == "string" else F.lit(None).cast("string")
    last = message(ASSISTANT, response)
    normal = F.when(response.isNotNull(), messages(last)).otherwise(messages())
    pair = None
    if spec.ranking and kinds.get(spec.chosen) == kinds.get(spec.rejected) == "string":
        both = F.col(spec.chosen).isNotNull() & F.col(spec.rejected).isNotNull()
        pair = F.when(both, messages(message(ASSISTANT, F.col(spec.chosen)), message(ASSISTANT, F.col(spec.rejected))))
    _, answers = _tagged(df, spec, last, normal, pair)
    return {"_prompt": turns, "_response": answers, "_system": _text(df, spec.system), "_tools": _text(df, spec.tools)}


def roles(spec: SourceSpec) -> Column:
    """Role tag to role."""
    pairs = ((spec.user_tag, USER), (spec.assistant_tag, ASSISTANT), (spec.observation_tag, OBSERVATION), (spec.function_tag, FUNCTION), (spec.system_tag, SYSTEM))
    return F.create_map(*[F.lit(x) for tag, role in pairs if tag for x in (tag, role)])


def split_system(df: DataFrame, spec: SourceSpec) -> tuple[Column, Column]:
    """(turns without a leading system message, system text)."""
    turns = F.col(spec.messages)
    column = _text(df, spec.system)
    if not spec.system_tag:
        return turns, column
    leads = F.coalesce(F.get(turns, F.lit(0))[spec.role_tag] == spec.system_tag, F.lit(False))
    return F.when(leads, F.slice(turns, 2, F.greatest(F.size(turns) - 1, F.lit(0)))).otherwise(turns), F.when(leads, F.get(turns, F.lit(0))[spec.content_tag]).otherwise(column)


def alternates(turns: Column) -> Column:
    """Whether canonical roles stand as asking, answering, asking, ..."""
    return F.forall(F.transform(turns, lambda m, i: F.when(i % 2 == 0, m["role"].isin(*ASKING)).otherwise(m["role"].isin(*ANSWERING))), lambda b: F.coalesce(b, F.lit(False)))


def sharegpt(df: DataFrame, spec: SourceSpec) -> dict[str, Column]:
    raw, system = split_system(df, spec)
    role = roles(spec)
    turns = F.transform(raw, lambda m: message(F.try_element_at(role, m[spec.role_tag]), m[spec.content_tag]))
    return _finish(df, spec, turns, system, role, _text(df, spec.tools))


def _finish(df: DataFrame, spec: SourceSpec, turns: Column, system: Column, role: Column, tools: Column) -> dict[str, Column]:
    n = F.size(turns)
    good = alternates(turns) & (n % 2 == (1 if spec.ranking else 0))
    most, last = F.slice(turns, 1, F.greatest(n - 1, F.lit(0))), F.try_element_at(turns, F.lit(-1))
    ending = F.when(n > 0, messages(last)).otherwise(messages())
    pair = None
    if spec.ranking and _kind(df, spec.chosen) == _kind(df, spec.rejected) == "struct":
        side = lambda c: message(F.element_at(role, F.col(c)[spec.role_tag]), F.col(c)[spec.content_tag])
        pair = F.when(F.col(spec.chosen).isNotNull() & F.col(spec.rejected).isNotNull(), messages(side(spec.chosen), side(spec.rejected)))
    tagged, answers = _tagged(df, spec, last, ending, pair)
    whole = pair.isNotNull() if pair is not None else F.lit(False)
    if tagged is not None:
        whole = whole & ~tagged
    return {
        "_prompt": F.when(~good, messages()).when(whole, turns).otherwise(most), "_response": F.when(good, answers).otherwise(messages()), "_system": system, "_tools": tools,
    }


def merge_tool_runs(turns: Column) -> Column:
    """Runs of observations become one turn; a run at the end is dropped."""
    start = F.struct(messages().alias("out"), F.array().cast("array<string>").alias("run"))

    def step(acc: Column, m: Column) -> Column:
        flushed = F.when(F.size(acc["run"]) > 0, F.concat(acc["out"], messages(message(OBSERVATION, F.array_join(acc["run"], TOOL_JOINT))))).otherwise(acc["out"])
        return F.when(m["role"] == OBSERVATION, F.struct(acc["out"].alias("out"), F.concat(acc["run"], F.array(m["content"])).alias("run"))).otherwise(
            F.struct(F.concat(flushed, messages(m)).alias("out"), F.array().cast("array<string>").alias("run"))
        )

    return F.aggregate(turns, start, step, lambda acc: acc["out"])


def system_suffix(system: Column, tools: Column) -> Column:
    """System text with the marker that turns thinking off where no tools are given."""
    bare_tools = F.coalesce(tools, F.lit("")) == ""
    empty = F.coalesce(system, F.lit("")) == ""
    said = system.contains("detailed thinking on") | system.contains(THINKING_OFF)
    return F.when(empty & bare_tools, F.lit(THINKING_OFF)).when(empty | (bare_tools & said), system).when(bare_tools, F.concat(system, F.lit("\n" + THINKING_OFF))).otherwise(F.concat(system, F.lit("\n")))


def call_text(f: Column) -> Column:
    """A call's name and JSON-text arguments as spaced JSON, other characters kept."""
    return F.concat(F.lit('{"name": '), _json_string(f["name"]), F.lit(', "arguments": '), _json_string(f["arguments"]), F.lit("}"))


def _json_string(text: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


def openai(df: DataFrame, spec: SourceSpec) -> dict[str, Column]:
    """Chat messages; tool calls become function turns where the schema has them."""
    raw, system = split_system(df, spec)
    role = roles(spec)
    fields = {f.name for f in df.schema[spec.messages].dataType.elementType.fields}

    def one(m: Column) -> Column:
        plain = message(F.element_at(role, m[spec.role_tag]), m[spec.content_tag])
        if "tool_calls" not in fields:
            return plain
        calls = F.concat(F.lit("["), F.array_join(F.transform(m["tool_calls"], lambda t: call_text(t["function"])), ", "), F.lit("]"))
        made = (F.size(m["tool_calls"]) > 0) & m[spec.role_tag].isin(*[t for t in (spec.assistant_tag, spec.function_tag) if t])
        return F.when(made, message(FUNCTION, calls)).otherwise(plain)

    turns = merge_tool_runs(F.transform(raw, one))
    tools = _text(df, spec.tools) if _kind(df, spec.tools) in (None, "string") else F.to_json(F.col(spec.tools))
    return _finish(df, spec, turns, system_suffix(system, tools), role, tools)


CONVERTERS: dict[str, Callable[[DataFrame, SourceSpec], dict[str, Column]]] = {"alpaca": alpaca, "sharegpt": sharegpt, "openai": openai}


def register_converter(name: str, fn: Callable[[DataFrame, SourceSpec], dict[str, Column]]) -> None:
    if name in CONVERTERS:
        raise ValueError(f"converter {name} exists")
    CONVERTERS[name] = fn


def align(df: DataFrame, spec: SourceSpec, keep: tuple[str, ...] = ()) -> DataFrame:
    """df as canonical rows with _source; keep: raw columns to carry (ordinals, keys)."""
    if spec.formatting not in CONVERTERS:
        raise ValueError(f"converter {spec.formatting} doesn't exist")
    columns = CONVERTERS[spec.formatting](df, spec) | {f"_{m}": _media(df, getattr(spec, m)) for m in ("images", "videos", "audios")}
    return df.select(*keep, F.lit(spec.name).alias("_source"), *[c.alias(n) for n, c in columns.items()])


def resolve_media(paths: Column, folder: str, existing: Column) -> Column:
    """Each path under folder where that file exists (existing: array of known paths), as it is otherwise."""
    full = lambda p: F.concat(F.lit(folder.rstrip("/") + "/"), p)
    return F.transform(paths, lambda p: F.when(F.array_contains(existing, full(p)), full(p)).otherwise(p))


# Second-generation converters: messages of typed parts with a loss weight.


def weighted(role: str | Column, text: Column, weight: float | Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    weight = F.lit(weight) if isinstance(weight, float) else weight
    return F.struct(role.alias("role"), F.array(F.struct(F.lit("text").alias("type"), text.alias("value"))).alias("content"), weight.alias("loss_weight"))


def alpaca_v1(system: Column, instruction: Column, query: Column, output: Column) -> Column:
    """Messages of an instruction row; instruction and input are joined without a break, only the answer has weight."""
    parts = F.array(
        F.when(F.coalesce(system, F.lit("")) != "", weighted(SYSTEM, system, 0.0)),
        F.when((F.coalesce(instruction, F.lit("")) != "") | (F.coalesce(query, F.lit("")) != ""), weighted(USER, F.concat(F.coalesce(instruction, F.lit("")), F.coalesce(query, F.lit(""))), 0.0)),
        F.when(F.coalesce(output, F.lit("")) != "", weighted(ASSISTANT, output, 1.0)),
    )
    return F.filter(parts, lambda m: m.isNotNull())


V1_ROLES = {"system": "system", "human": "user", "gpt": "assistant", "observation": "tool", "function_call": "assistant"}


def sharegpt_v1(turns: Column) -> Column:
    """Messages of from/value turns; unknown tags are skipped, nothing is checked."""
    role = F.create_map(*[F.lit(x) for pair in V1_ROLES.items() for x in pair])
    known = F.filter(turns, lambda m: F.map_contains_key(role, m["from"]))
    return F.transform(known, lambda m: weighted(role[m["from"]], m["value"], F.when(m["from"].isin("gpt", "function_call"), 1.0).otherwise(0.0)))


def pair_v1(chosen: Column, rejected: Column) -> tuple[Column, Column]:
    """(chosen, rejected) dialogues of role/content turns; answers have weight."""
    one = lambda m: weighted(m["role"], m["content"], F.when(m["role"] == ASSISTANT, 1.0).otherwise(0.0))
    return F.transform(chosen, one), F.transform(rejected, one)


def valid_tools(text: Column) -> Column:
    """Tool JSON, null where it doesn't parse."""

    def good(x):
        try:
            json.loads(x)
            return x
        except ValueError:
            return None

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(good, na_action="ignore")

    return run(text)
