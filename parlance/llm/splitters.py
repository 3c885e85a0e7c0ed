"""Histogram search for splitters: where, in key order, do running sums of a table pass given targets?

Rows have a group, a key (k, u) of two unsigned 64-bit numbers, and a weight. A search asks for the boundary in its group's key order whose
rows below come nearest to a target number of weight or of rows. Every round counts exact weight and rows below PROBES candidate
boundaries of each open search, in one pass over all partitions (each task returns one histogram), and narrows each search to the interval
that holds its target, until tolerance is met or at most one row is left in it. No row moves. The driver holds a few numbers per search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import bound_arrow

PROBES = 48
_TOP = 1 << 64


@dataclass
class Search:
    """Boundary key of one target. below: (weight, rows) under the boundary, once found."""

    group: int
    target: float
    by_rows: bool = False
    tolerance: float = 0.0
    top_u: int = _TOP  # above every u
    at: tuple[int, int] = (0, 0)
    below: tuple[int, int] = (0, 0)
    low: int = 0
    high: int = _TOP
    under: tuple[int, int] = (0, 0)
    over: tuple[int, int] | None = None
    fixed: int | None = None  # the k that every row of the interval has; then u is searched
    done: bool = False
    probes: list[int] = field(default_factory=list)

    def measure(self, counted: tuple[int, int]) -> int:
        return counted[self.by_rows]

    def settle(self) -> None:
        low, high = self.measure(self.under), self.measure(self.over)
        if abs(low - self.target) <= abs(high - self.target):
            end, self.below = self.low, self.under
        else:
            end, self.below = self.high, self.over
        self.at = (end, 0) if self.fixed is None else (self.fixed, end) if end < self.top_u else (self.fixed + 1, 0)
        self.done = True

    def narrow(self, counts: list[tuple[int, int]]) -> None:
        """counts: (weight, rows) below each probe."""
        for p, c in zip(self.probes, counts):
            if self.measure(c) <= self.target:
                self.low, self.under = p, c
            else:
                self.high, self.over = p, c
                break
        if min(abs(self.measure(x) - self.target) for x in (self.under, self.over)) <= self.tolerance or self.over[1] - self.under[1] <= 1:
            self.settle()
        elif self.high - self.low <= 1:
            if self.fixed is None:
                self.fixed, self.low, self.high = self.low, 0, self.top_u
            else:
                self.settle()

    def plan(self) -> None:
        span = self.high - self.low
        n = min(PROBES, span - 1)
        self.probes = sorted({self.low + span * i // (n + 1) for i in range(1, n + 1)} - {self.low})


def _count(df: DataFrame, searches: list[Search]) -> None:
    """One pass: fill in what lies below every probe of the given searches. df: g int, k bigint, u bigint, w bigint, unsigned keys as signed bits."""
    lanes: dict[tuple[int, int | None], np.ndarray] = {}
    for s in searches:
        lanes.setdefault((s.group, s.fixed), []).extend(s.probes)
    names = list(lanes)
    lanes = {key: np.unique(np.array(p, np.uint64)) for key, p in lanes.items()}
    by_group: dict[int, list[int]] = {}
    for i, (g, _) in enumerate(names):
        by_group.setdefault(g, []).append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((2, len(lanes[x]) + 1), np.int64) for x in names]
        for b in batches:
            g, k, u, w = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            k, u = k.astype(np.int64).view(np.uint64), u.astype(np.int64).view(np.uint64)
            order = np.argsort(g, kind="stable")
            found, starts = np.unique(g[order], return_index=True)
            for group, a, z in zip(found.tolist(), starts, [*starts[1:], len(g)]):
                rows = order[a:z]
                for i in by_group.get(group, ()):
                    fixed, probes = names[i][1], lanes[names[i]]
                    own = rows if fixed is None else rows[k[rows] == np.uint64(fixed)]
                    at = np.searchsorted(probes, (k if fixed is None else u)[own], side="right")
                    total[i][1] += np.bincount(at, minlength=len(probes) + 1)
                    np.add.at(total[i][0], at, w[own])
        lane = np.repeat(np.arange(len(names)), [t.shape[1] for t in total])
        slot = np.concatenate([np.arange(t.shape[1]) for t in total])
        both = np.concatenate(total, axis=1)
        some = both[1] > 0
        yield pa.record_batch([pa.array(lane[some].astype(np.int32)), pa.array(slot[some].astype(np.int32)), pa.array(both[0][some]), pa.array(both[1][some])], ["lane", "slot", "w", "n"])

    got = df.select("g", "k", "u", "w").mapInArrow(run, "lane int, slot int, w bigint, n bigint").groupBy("lane", "slot").agg(F.sum("w"), F.sum("n")).collect()
    sums = [np.zeros((2, len(lanes[x]) + 1), np.int64) for x in names]
    for i, slot, w, n in got:
        sums[i][:, slot] += (w, n)
    sums = [np.cumsum(s, axis=1) for s in sums]  # rows with key < probe j are in slots 0..j
    place = {x: i for i, x in enumerate(names)}
    for s in searches:
        i = place[s.group, s.fixed]
        at = np.searchsorted(lanes[names[i]], np.array(s.probes, np.uint64))
        base = s.floor if s.fixed is not None else (0, 0)
        s.narrow([(int(sums[i][0][j]) + base[0], int(sums[i][1][j]) + base[1]) for j in at])


def find(df: DataFrame, searches: list[Search], totals: dict[int, tuple[int, int]]) -> list[Search]:
    """Settle all searches. totals: (weight, rows) of each group."""
    bound_arrow(df.sparkSession)
    for s in searches:
        s.over = totals.get(s.group, (0, 0))
        if s.target <= 0 or not s.over[1]:
            s.done = True
        elif s.target >= s.measure(s.over):
            s.at, s.below, s.done = (_TOP, 0), s.over, True
        elif s.over[1] <= 1:
            s.settle()
    while open_ := [s for s in searches if not s.done]:
        for s in open_:
            if s.fixed is not None and s.low == 0 and s.high == s.top_u:
                s.floor = s.under  # what lies below the fixed k
            s.plan()
        _count(df, open_)
    return searches


def before(k: np.ndarray, u: np.ndarray, at: tuple[int, int]) -> np.ndarray:
    """Which unsigned keys lie below the boundary."""
    if at[0] >= _TOP:
        return np.ones(len(k), bool)
    return (k < np.uint64(at[0])) | ((k == np.uint64(at[0])) & (u < np.uint64(at[1])))
