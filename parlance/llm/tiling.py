"""Benchmark decontamination by greedy string tiling.

Words are lower-cased runs of letters and digits; of scripts written without spaces each character is one. Every window of MIN_MATCH benchmark
words is a seed; a document's windows are hashed by the same running Karp-Rabin polynomial and joined to the seeds. For each (document, item)
with a shared seed, tiles are laid greedily: the longest match of unmarked words, of MIN_MATCH or more and confirmed word by word, is marked in
both texts until none is left. Coverage is the part of the item's words under tiles, wherever and in whatever order they stand in the document,
so reordered passages are caught. A document is contaminated by an item at COVERAGE or more.

The benchmark is the query set: documents pass it in blocks of at most BLOCK_BYTES of its text, each a narrow step over whole texts without a
shuffle. One block at a time is held by the driver and the tasks; what a block finds is written to the shared folder before the next is read, so
a larger benchmark costs more passes and no more memory.

Null and empty texts have no words and are never contaminated, nor do such items contaminate. An item of fewer than MIN_MATCH words contaminates
only documents that have just its words. Texts that repeat themselves are tiled in near-linear time. Repeated rows are tested each. Empty tables
give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from parlance.llm.common import arrow_map, materialise, utf8

MIN_MATCH, COVERAGE = 5, 0.5
#: Benchmark text that one pass over the documents tests.
BLOCK_BYTES = 16 << 20
#: Scripts that are written without spaces: Thai to Lao, Burmese, Khmer, kana, Han. Each of their characters is a word.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORDS = re.compile(rf"[^\W_{_UNSPACED}]+|[{_UNSPACED}]")
_BASE = 0x9E3779B97F4A7C15


def words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def window_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hash of each window of the given length, modulo 2**64."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(length):
        out *= np.uint64(_BASE)
        out += ids[j : j + n]
    return out


class _Sequence:
    """A word-id sequence with the prefix sums of its running hash, so a window of any length is hashed at once."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.free = ids, np.ones(len(ids), bool)
        mixed = ids * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        self.sums = np.r_[np.uint64(0), np.cumsum(mixed * _powers(len(ids)), dtype=np.uint64)]
        self.room = np.arange(len(ids), 0, -1)  # free words from a place on

    def mark(self, at: int, length: int) -> None:
        self.free[at : at + length] = False

    def measure(self) -> None:
        """Free words from each place on."""
        taken = np.flatnonzero(~self.free)
        places = np.arange(len(self.ids))
        self.room = np.r_[taken, len(self.ids)][np.searchsorted(taken, places)] - places

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the free windows of a length."""
        at = np.flatnonzero(self.room >= length)
        return at, (self.sums[at + length] - self.sums[at]) * _inverses(len(self.ids))[at]


_tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(i: int, base: int, n: int) -> np.ndarray:
    if len(_tables[i]) < n:
        _tables[i] = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, base, np.uint64)], dtype=np.uint64)
    return _tables[i]


def _powers(n: int) -> np.ndarray:
    return _grown(0, _BASE, n)[:n]


def _inverses(n: int) -> np.ndarray:
    return _grown(1, pow(_BASE, -1, 1 << 64), n)[:n]


def _common(item: _Sequence, text: _Sequence, length: int) -> bool:
    a, b = item.windows(length)[1], text.windows(length)[1]
    return bool(len(a) and len(b)) and bool(np.isin(a, b).any())


def tile(item: np.ndarray, text: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word-id sequences: tiles (start in item, start in text, words).

    The longest free match is always marked next, the earliest in the item and then in the text among equals, until none of min_match words is
    left. The greatest length at which free windows of both have an equal running hash is found by bisection; all matches of that length are
    then confirmed word by word and marked in order, each text window being looked at once. Time is near-linear for each length that occurs, and
    memory linear in both sequences, however often they repeat themselves.
    """
    a, b = _Sequence(np.asarray(item, np.uint64)), _Sequence(np.asarray(text, np.uint64))
    tiles, most = [], min(len(item), len(text))
    while most >= min_match and _common(a, b, min_match):
        low, high = min_match, most  # the last common length lies within
        step = 1
        while low + step <= high and _common(a, b, low + step):
            low, step = low + step, step * 2
        high = min(high, low + step - 1)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if _common(a, b, middle) else (low, middle - 1)
        tiles += _mark(a, b, low)
        a.measure()
        b.measure()
        most = low - 1
    return tiles


def _mark(a: _Sequence, b: _Sequence, length: int) -> list[tuple[int, int, int]]:
    """Mark all matches of the greatest common length, earliest first."""
    (p, left), (t, right) = a.windows(length), b.windows(length)
    order = np.argsort(right, kind="stable")
    t, right = t[order], right[order]
    first, end = np.searchsorted(right, left, "left"), np.searchsorted(right, left, "right")
    some = end > first
    tiles, behind = [], 0
    at: dict[int, int] = {}  # how far the places of a hash are used up
    for start, low, high in zip(p[some].tolist(), first[some].tolist(), end[some].tolist()):
        if start < behind:
            continue
        k = at.get(low, low)
        while k < high and not b.free[t[k] : t[k] + length].all():
            k += 1
        at[low] = k
        while k < high:  # equal hashes of unlike words are passed over, and stay for others
            place = int(t[k])
            if b.free[place : place + length].all() and np.array_equal(a.ids[start : start + length], b.ids[place : place + length]):
                a.mark(start, length)
                b.mark(place, length)
                tiles.append((start, place, length))
                behind = start + length
                break
            k += 1
    return tiles


class Bench:
    """Seeds and word ids of one block of the benchmark."""

    def __init__(self, items: list[tuple], min_match: int = MIN_MATCH):
        self.min_match, self.vocabulary = min_match, {}
        self.names, self.items, self.short = [], [], {}
        for name, text in items:
            found = words(text or "")
            if found:
                if len(found) < min_match:
                    self.short.setdefault(tuple(found), []).append(len(self.names))
                self.names.append(name)
                self.items.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found], np.uint64))
        hashes = [window_hashes(x, min_match) for x in self.items]
        owner = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        joined = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(joined, kind="stable")
        self.seeds, self.owner = joined[order], owner[order]

    def hits(self, text: bytes, coverage: float) -> list[tuple[int, float, int]]:
        """(item, coverage, tiles) of the items that cover enough of a document."""
        found = words(text.decode("utf-8", "replace"))
        if len(found) < self.min_match:
            return [(i, 1.0, 1) for i in self.short.get(tuple(found), ())]
        if not len(self.seeds):
            return []
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in found), np.uint64, len(found))
        hashes = window_hashes(ids, self.min_match)
        left, right = np.searchsorted(self.seeds, hashes, "left"), np.searchsorted(self.seeds, hashes, "right")
        at = np.flatnonzero(right > left)
        if not len(at):
            return []
        inside = np.zeros(len(ids), bool)  # only words under a seed can be under a tile
        for j in range(self.min_match):
            inside[at + j] = True
        edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
        parts = [x for a, z in zip(edge[::2], edge[1::2]) for x in (ids[a:z], np.zeros(1, np.uint64))]
        near = np.concatenate(parts)
        candidates = np.unique(np.concatenate([self.owner[a:b] for a, b in {(left[i], right[i]) for i in at.tolist()}]))
        out = []
        for i in candidates.tolist():
            tiles = tile(self.items[i], near, self.min_match)
            part = sum(n for _, _, n in tiles) / len(self.items[i])
            if part >= coverage:
                out.append((i, part, len(tiles)))
        return out


def blocks(benchmark: DataFrame, block_bytes: int | None = None) -> tuple[int, Iterator[Bench]]:
    """The benchmark in blocks of bounded size: their number, and each in turn."""
    items = benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-int(total) // (block_bytes or BLOCK_BYTES)) or 1

    def each() -> Iterator[Bench]:
        for i in range(n):
            part = items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i)
            yield Bench([tuple(r) for r in part.orderBy("id", "text").collect()])

    return n, each()


def _each_block(benchmark: DataFrame, find: Callable[[Bench], DataFrame], label: str) -> DataFrame:
    """What find gives for every block; with several, each one's rows are stored before the next is read."""
    n, benches = blocks(benchmark)
    parts = (find(bench) if n == 1 else materialise(find(bench), label) for bench in benches)
    out = next(parts)
    for part in parts:
        out = out.unionByName(part)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, coverage and tiles of every contaminated document and the items that it holds."""
    id_kind, item_kind = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("text"))
    name_kind = to_arrow_type(benchmark.schema["item_id"].dataType)

    def find(bench: Bench) -> DataFrame:
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            found = [(i, bench.names[x], part, n) for i, t in enumerate(utf8(b.column(1))) for x, part, n in bench.hits(t, coverage)]
            rows, names, parts, n = zip(*found) if found else ((), (), (), ())
            return pa.record_batch([b.column(0).take(pa.array(rows, pa.int64())), pa.array(names, name_kind), pa.array(parts, pa.float64()), pa.array(n, pa.int32())], ["doc_id", "item_id", "coverage", "tiles"])

        return arrow_map(texts, run, f"doc_id {id_kind}, item_id {item_kind}, coverage double, tiles int")

    return _each_block(benchmark, find, "tiling-found")


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs that no item contaminates, all columns.

    With a benchmark of several blocks docs is read once for each and must give the same partitions each time, as a table's scan does.
    """
    names = docs.columns
    at = names.index("text")
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    n, benches = blocks(benchmark)
    if n == 1:
        bench = next(benches)

        def clean(b: pa.RecordBatch) -> pa.RecordBatch:
            return b.filter(pa.array([not bench.hits(t, coverage) for t in utf8(b.column(at))], pa.bool_()))

        return arrow_map(inner, clean, inner.schema).toDF(*names)
    numbered = inner.withColumn("uid", F.monotonically_increasing_id())

    def find(bench: Bench) -> DataFrame:
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.record_batch([b.column(0).filter(pa.array([bool(bench.hits(t, coverage)) for t in utf8(b.column(1))], pa.bool_()))], ["uid"])

        return arrow_map(numbered.select("uid", f"c{at}"), run, "uid bigint")

    found = None
    for bench in benches:
        part = materialise(find(bench), "tiling-found")
        found = part if found is None else found.unionByName(part)
    return numbered.join(found.distinct(), "uid", "left_anti").drop("uid").toDF(*names)
