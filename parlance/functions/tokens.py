"""Tokenizers as Column functions. ``chars`` is one token per code point and stays in the JVM; others run as Arrow UDFs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Chars:
    """One token per Unicode code point; ids are code points shifted by the special ids."""

    bos, eos, pad, first = 1, 2, 0, 3

    def count(self, text: Column) -> Column:
        return F.length(text)

    def encode(self, text: Column) -> Column:
        return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c) + self.first)

    def decode(self, ids: Column) -> Column:
        points = F.transform(F.filter(ids, lambda x: x >= self.first), lambda x: F.lpad(F.hex(x - self.first), 8, "0"))
        return F.decode(F.unhex(F.array_join(points, "")), "UTF-32")


class Words:
    """One token per run of non-space; ids by hash."""

    bos, eos, pad = 1, 2, 0

    def count(self, text: Column) -> Column:
        return F.size(F.regexp_extract_all(text, F.lit(r"(\S+)"), 1))

    def encode(self, text: Column) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(r"(\S+)"), 1), lambda w: (F.pmod(F.crc32(w), F.lit(1 << 30)) + 3).cast("int"))


class Vocabulary:
    """A tokenizer file, given by a loader that each worker calls once: load() -> (text -> ids)."""

    def __init__(self, load: Callable[[], Callable[[str], list[int]]], bos: int = 1, eos: int = 2, pad: int = 0):
        self.load, self.bos, self.eos, self.pad = load, bos, eos, pad

    def encode(self, text: Column) -> Column:
        load = self.load

        @F.pandas_udf("array<int>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode = load()
            for s in batches:
                yield s.map(encode, na_action="ignore")

        return run(text)

    def count(self, text: Column) -> Column:
        return F.size(self.encode(text))


def from_file(path: str) -> Vocabulary:
    """A tokenizer file of one of the installed libraries, by its extension (.json or .model)."""

    def load():
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            return lambda s: t.encode(s, add_special_tokens=False).ids
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).encode

    return Vocabulary(load)
