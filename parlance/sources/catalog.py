"""Source registry: what a named dataset is, where it lies, and how its columns and role tags map to the canonical ones.

One table of the registry's keys drives everything: the spec's fields, what a block resets, and the order in which places are looked for.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field, fields, make_dataclass, replace

# The keys of the registry's file format with their defaults, by the block that holds them ("" is the entry itself).
KEYS: dict[str, dict[str, object]] = {
    "": {"formatting": "alpaca", "ranking": False, "subset": None, "split": "train", "folder": None, "num_samples": None},
    "columns": {
        "prompt": "instruction", "query": "input", "response": "output", "history": None, "messages": "conversations", "system": None, "tools": None,
        "images": None, "videos": None, "audios": None, "chosen": None, "rejected": None, "kto_tag": None,
    },
    "tags": {
        "role_tag": "from", "content_tag": "value", "user_tag": "human", "assistant_tag": "gpt", "observation_tag": "observation",
        "function_tag": "function_call", "system_tag": "system",
    },
}
# The keys that say where a dataset lies, and the kind of place.
PLACES = {"hf_hub_url": "hf_hub", "ms_hub_url": "ms_hub", "om_hub_url": "om_hub", "script_url": "script", "cloud_file_name": "cloud", "file_name": "file"}

#: A source: its name, the kind of place it is loaded from, and every key of KEYS.
SourceSpec = make_dataclass("SourceSpec", [("name", str), ("load_from", str, "file"), *[(k, object, v) for block in KEYS.values() for k, v in block.items()]], frozen=True, module=__name__)


def merged(spec: SourceSpec, entry: dict) -> SourceSpec:
    """The spec with a registry entry's settings; a block that is given leaves unset what it doesn't name."""
    stated = {k: entry[k] for k in KEYS[""] if k in entry}
    for block in (b for b in KEYS if b and b in entry):
        stated |= {k: entry[block].get(k) for k in KEYS[block]}
    return replace(spec, **stated)


def load_registry(where: dict | str, fetch: Callable[[str], str] | None = None) -> dict | None:
    """Entries of a dict, of a folder's dataset_info.json, or of the one that fetch(repository) gives the local path of; None where names are hub datasets."""
    if isinstance(where, dict):
        return where
    if where == "ONLINE":
        return None
    head, remote, repository = where.partition("REMOTE:")
    if remote and not head:
        if fetch is None:
            raise ValueError("a remote registry needs a function that fetches its file")
        path = fetch(repository)
    else:
        path = os.path.join(where, "dataset_info.json")
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def resolve(names: list[str], registry: dict | str, prefer: str = "hf_hub_url", fetch: Callable[[str], str] | None = None) -> list[SourceSpec]:
    """Specs of named datasets. prefer: the hub that is looked for first. fetch: how a REMOTE:<repository> registry's file is had."""
    if not names:
        return []
    entries = load_registry(registry, fetch)
    if entries is None:
        return [SourceSpec(n, PLACES[prefer]) for n in names]
    if missing := [n for n in names if n not in entries]:
        raise ValueError(f"undefined datasets {missing}")
    order = sorted(PLACES, key=lambda k: k != prefer)

    def one(entry: dict) -> SourceSpec:
        key = next((k for k in order if k in entry), None)
        if key is None:
            raise ValueError(f"an entry says no place: {entry}")
        return merged(SourceSpec(entry[key], PLACES[key]), entry)

    return [one(entries[n]) for n in names]


@dataclass(frozen=True)
class InfoEntry:
    """One dataset of a second-generation info file."""

    path: str
    source: str = "hf_hub"
    split: str = "train"
    converter: str | None = None
    size: int | None = None
    weight: float | None = None
    streaming: bool = False
    extra: dict = field(default_factory=dict)


def resolve_info(info: dict) -> dict[str, InfoEntry]:
    """name -> entry; all must agree on streaming."""
    known = {f.name for f in fields(InfoEntry)} - {"extra"}
    out = {name: InfoEntry(**{k: v for k, v in e.items() if k in known}, extra={k: v for k, v in e.items() if k not in known}) for name, e in info.items()}
    if len({e.streaming for e in out.values()}) > 1:
        raise ValueError("datasets must agree on streaming")
    return out


def parse_info(text: str) -> dict[str, InfoEntry]:
    """An info file of YAML: nested blocks by indentation, lists of dashes or in brackets, plain and quoted scalars, comments."""
    return resolve_info(_block([line for line in map(_uncommented, text.splitlines()) if line.strip()]) or {})


def _uncommented(line: str) -> str:
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "#" and (not i or line[i - 1].isspace()):
            return line[:i]
    return line


def _scalar(text: str):
    text = text.strip()
    if text[:1] in ("'", '"') and text[-1:] == text[:1]:
        return text[1:-1]
    if text[:1] == "[" and text[-1:] == "]":
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    if text in ("", "~", "null"):
        return None
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def _block(lines: list[str]):
    """The value that lines of one block make; the least indentation is the block's own."""
    if not lines:
        return None
    depth = len(lines[0]) - len(lines[0].lstrip())
    starts = [i for i, x in enumerate(lines) if len(x) - len(x.lstrip()) <= depth] + [len(lines)]
    if lines[0].lstrip().startswith("- "):
        return [_block([" " * (depth + 2) + lines[a].lstrip()[2:], *lines[a + 1 : z]]) if ":" in lines[a] and lines[a].lstrip()[2:3] not in "'\"" else _scalar(lines[a].lstrip()[2:]) for a, z in zip(starts, starts[1:])]
    out = {}
    for a, z in zip(starts, starts[1:]):
        key, _, value = lines[a].strip().partition(":")
        out[key.strip("'\"")] = _scalar(value) if value.strip() else _block(lines[a + 1 : z])
    return out
