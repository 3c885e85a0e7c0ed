"""Mixing sources to target weights by Pareto order sampling.

Targets: sources in code-point order (null last) weigh WEIGHTS in turn and share SHARE of all words; a target stops at MOST times its
source's words, and the excess is shared again by weight until no target is above. A source whose target is r times its words takes floor(r)
certain copies of every document; the rest is a Pareto order sample whose inclusion probabilities p are proportional to size: p = min(1, rate *
size), the source's rate being such that the expected words are what is left of the target (from exact sums over size classes). Documents are
ranked by random odds U/(1-U) divided by inclusion odds p/(1-p), so a long document tends to come before a short one and those of p = 1 come
first, and the first are taken whose words come nearest to what is left. U is a hash of doc_id and size, so reruns and other partitionings
agree. The rank's cut is found by exact counts over all partitions
(parlance.llm.splitters); nothing is sorted or moved, however large a source is. The driver holds one record per source, as the mix's own
configuration does.

Null and empty texts have size 0 and add no words. Repeated rows are drawn as documents of their own; rows that tie in rank have equal id and size.
A null source is one source, the last. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import arrow_map, materialise, signed, utf8
from parlance.llm.splitters import Search, before, find

WEIGHTS, SHARE, MOST, SALT = (5, 2, 1), 1.5, 2, "mix-1"
_UNIT = 1 << 52


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Target words of each source."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_weight = share * sum(sizes.values()), sum(weight.values())
    out = {}
    by_level = sorted(order, key=lambda s: (most * sizes[s] / weight[s]))
    for i, s in enumerate(by_level):
        if left / open_weight * weight[s] <= most * sizes[s]:
            level = left / open_weight
            return out | {x: level * weight[x] for x in by_level[i:]}
        out[s] = float(most * sizes[s])
        left, open_weight = left - most * sizes[s], open_weight - weight[s]
    return out


def _draw(doc_id, size: int) -> int:
    """52-bit uniform number of a document."""
    return int(hashlib.md5(f"{'' if doc_id is None else doc_id}:{size}:{SALT}".encode()).hexdigest()[:13], 16)


def _measure(ids: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter((len(t.split()) for t in utf8(texts)), np.int64, len(texts))
    return size, np.fromiter((_draw(i, s) for i, s in zip(ids.to_pylist(), size.tolist())), np.int64, len(texts))


def rate(rest: float, classes: dict[int, tuple[int, int, int]]) -> float:
    """Inclusion probability per word. classes, in order of size: the least size, the sum of sizes and that of their squares.

    The top classes whose documents are all certain are set apart, the others share what they leave.
    """
    above, found = 0, 0.0
    below = sum(q for _, _, q in classes.values())
    for b in sorted(classes, reverse=True):
        if not below:
            break
        found = (rest - above) / float(below)
        if found * classes[b][0] < 1:
            break
        above, below = above + classes[b][1], below - classes[b][2]
    return max(found, 0.0)


#: Classes of like sizes: the number of bits, then the first five of them.
_CLASS = "length(bin(size)) * 32 + shiftright(size, greatest(length(bin(size)) - 5, 0))"


def _rank(draw: np.ndarray, size: np.ndarray, per_word: np.ndarray) -> np.ndarray:
    """Sort key of the Pareto ranking variable: bits of a double that isn't negative sort as unsigned numbers."""
    u = (draw + 0.5) / _UNIT
    p = np.minimum(1.0, per_word * size)
    with np.errstate(divide="ignore"):
        return ((u * (1 - p)) / ((1 - u) * p)).view(np.uint64)


class Plan:
    """What the mix takes: per source the target, the certain copies and the cut of the Pareto rank."""

    def __init__(self, measured: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST):
        """measured: source, size, draw, u."""
        whole = F.col("size").cast("decimal(20,0)")
        got = measured.groupBy("source", F.expr(_CLASS).alias("class")).agg(F.min("size"), F.sum("size"), F.sum(whole * whole), F.count("*")).collect()
        self.sizes, counts = {}, {}
        classes: dict[str | None, dict[int, tuple[int, int, int]]] = {}
        for source, kind, least, words, squares, n in got:
            self.sizes[source] = self.sizes.get(source, 0) + int(words)
            counts[source] = counts.get(source, 0) + n
            classes.setdefault(source, {})[kind] = least, int(words), int(squares)
        self.targets = targets(self.sizes, weights, share, most)
        self.place = {s: i for i, s in enumerate(self.sizes)}
        certain = {s: floor(self.targets[s] / n) if n else 0 for s, n in self.sizes.items()}
        rest = {s: self.targets[s] - certain[s] * n for s, n in self.sizes.items()}
        self.certain = np.array([certain[s] for s in self.place], np.int64)
        self.rate = np.array([rate(rest[s], classes[s]) for s in self.place], np.float64)
        place, rates = self.place, self.rate

        def keyed(b: pa.RecordBatch) -> pa.RecordBatch:
            g = np.fromiter((place[s] for s in b.column(0).to_pylist()), np.int32, b.num_rows)
            k = _rank(b.column(2).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), rates[g])
            return pa.record_batch([pa.array(g), pa.array(signed(k)), b.column(3), b.column(1)], ["g", "k", "u", "w"])

        keys = arrow_map(measured.select("source", "size", "draw", "u"), keyed, "g int, k bigint, u bigint, w bigint")
        searches = [Search(g, rest[s]) for s, g in place.items()]
        find(keys, searches, {place[s]: (n, counts[s]) for s, n in self.sizes.items()})
        self.cut = [s.at for s in searches]

    def copies(self, sources: list, size: np.ndarray, draw: np.ndarray, u: np.ndarray) -> np.ndarray:
        g = np.fromiter((self.place[s] for s in sources), np.int64, len(sources))
        k = _rank(draw, size, self.rate[g])
        out = self.certain[g]
        for x in np.unique(g):
            own = g == x
            out[own] += before(k[own], u[own], self.cut[x])
        return out


def _measured(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        size, draw = _measure(b.column(0), b.column(2))
        return pa.record_batch([b.column(0), b.column(1), pa.array(size), pa.array(draw), b.column(3)], ["id", "source", "size", "draw", "u"])

    kinds = dict(docs.dtypes)
    inner = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("u"))
    return arrow_map(inner, run, f"id {kinds[id_col]}, source string, size bigint, draw bigint, u bigint")


def mix_report(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, size, source_size, target and taken words of every document."""
    rows = materialise(_measured(docs, id_col, source_col, text_col), "mix-rows")
    plan = Plan(rows)
    kind = dict(rows.dtypes)["id"]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sources, size = b.column(1).to_pylist(), b.column(2).to_numpy(zero_copy_only=False)
        copies = plan.copies(sources, size, b.column(3).to_numpy(zero_copy_only=False), b.column(4).to_numpy(zero_copy_only=False).view(np.uint64))
        return pa.record_batch(
            [b.column(0), b.column(2), pa.array([plan.sizes[s] for s in sources], pa.int64()), pa.array([plan.targets[s] for s in sources], pa.float64()), pa.array(copies * size)],
            ["doc_id", "size", "source_size", "target", "taken"],
        )

    return arrow_map(rows, run, f"doc_id {kind}, size bigint, source_size bigint, target double, taken bigint")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mixed table: every row of docs as often as the mix takes it."""
    plan = Plan(materialise(_measured(docs, id_col, source_col, text_col).drop("id"), "mix-rows"))
    names = docs.columns
    where = [names.index(c) for c in (id_col, source_col, text_col)]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        size, draw = _measure(b.column(where[0]), b.column(where[2]))
        copies = plan.copies(b.column(where[1]).to_pylist(), size, draw, b.column(len(names)).to_numpy(zero_copy_only=False).view(np.uint64))
        return b.select(list(range(len(names)))).take(pa.array(np.repeat(np.arange(b.num_rows), copies)))

    inner = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("u", F.monotonically_increasing_id())
    fields = ", ".join(f"`c{i}` {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    return arrow_map(inner, run, fields).toDF(*names)


#: The same mix over the whole table in DuckDB SQL.
ORACLE = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER before_, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER before_, 0) AS open_weight
  FROM s WINDOW before_ AS (ORDER BY 2.0::DOUBLE * source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), v AS (
  SELECT max(CAST(rest AS DOUBLE) / CAST(open_weight AS DOUBLE)) AS level FROM l
), t AS (
  SELECT source, source_size, CASE WHEN level * weight <= 2 * source_size THEN level * weight ELSE CAST(2 * source_size AS DOUBLE) END AS target FROM s, v
), r AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS certain FROM t
), c AS (
  SELECT source, length(bin(size)) * 32 + (size >> greatest(length(bin(size)) - 5, 0)) AS class, min(size) AS least, sum(size) AS words, sum(CAST(size AS HUGEINT) * size) AS squares FROM d GROUP BY source, class
), e AS (
  SELECT r.source, class, least, (target - certain * source_size - CAST(coalesce(sum(words) OVER above_, 0) AS DOUBLE)) / CAST(sum(squares) OVER below_ AS DOUBLE) AS rate,
         sum(squares) OVER below_ AS total
  FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source
  WINDOW above_ AS (PARTITION BY r.source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), below_ AS (PARTITION BY r.source ORDER BY class ROWS UNBOUNDED PRECEDING)
), f AS (
  SELECT source, greatest(coalesce(arg_max(rate, class) FILTER (rate * least < 1), arg_min(rate, class), 0), 0) AS rate
  FROM e WHERE total > 0 GROUP BY source
), p AS (
  SELECT d.*, r.source_size, r.target, r.certain, r.target - r.certain * r.source_size AS rest, least(1.0::DOUBLE, coalesce(f.rate, 0) * d.size) AS p,
         (CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || d.size || ':mix-1'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN f ON d.source IS NOT DISTINCT FROM f.source
), q AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY CASE WHEN p = 0 THEN 'infinity'::DOUBLE ELSE (u * (1 - p)) / ((1 - u) * p) END, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM p
)
SELECT doc_id, size, source_size, target, CAST(size * (certain + CASE WHEN upto + upto - size < 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM q
"""
