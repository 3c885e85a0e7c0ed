"""Ordinal cumulative-link quality classifier.

P(grade <= j) = logistic(threshold_j - w.x): one hashed-text weight vector shared by all grades, with ordered thresholds, fitted by proximal
AdaGrad on a bounded sample of graded documents. Scoring is one narrow pass that gives the expected grade and the tail probability
P(grade = best); selection keeps documents whose tail probability reaches a cut.

Grades of the labels table: 0 toxic, 1 not toxic but of low quality, 2 neither. Features of a whole text: presence of each lower-cased word,
and, as thermometer levels, how often each token shape occurs, how often a token repeats the one before it, and how few tokens are distinct.
Null and empty texts have the single feature "empty". Labels with a null are not used; repeated labels count each time; documents without a
label are scored like others. With no usable labels, or one grade only, every document gets that prior (kept). An empty table gives an empty
result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import arrow_map, utf8

#: Labelled rows that the fit uses at most, chosen by hash; the bound on what the driver gathers.
FIT_ROWS = 8000
FEATURE_BITS = 22
GRADES = 3
KEEP_TAIL = 0.5
_SHAPES = bytes.maketrans(bytes(range(256)), bytes(0x61 if 0x61 <= c <= 0x7A or c >= 0x80 else 0x41 if 0x41 <= c <= 0x5A else 0x30 if 0x30 <= c <= 0x39 else c for c in range(256)))
_RUNS = re.compile(rb"A[Aa]+|aa+|00+")
_WORDS = re.compile(r"[^\W\d_]+")
_LEVELS = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9)


def features(text: bytes) -> np.ndarray:
    """Sorted distinct hashed features of a whole text."""
    tokens = text.split()
    if not tokens:
        names = {"empty"}
    else:
        n = len(tokens)
        names = set(_WORDS.findall(text.decode("utf-8", "replace").lower()))
        rates = {f"shape {s.decode('latin-1')}": c / n for s, c in Counter(_RUNS.sub(lambda m: m[0][:1], text.translate(_SHAPES)).split()).items() if c >= _LEVELS[0] * n}
        rates["repeat"] = sum(map(bytes.__eq__, tokens, tokens[1:])) / n
        rates["same"] = 1 - len(set(tokens)) / n
        names.update(f"{k} {i}" for k, r in rates.items() for i, level in enumerate(_LEVELS) if r >= level)
    mask = (1 << FEATURE_BITS) - 1
    return np.unique(np.fromiter((zlib.crc32(x.encode()) & mask for x in names), np.int32, len(names)))


@dataclass
class Model:
    ids: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def link(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(rows))
        for i, x in enumerate(rows):
            at = np.searchsorted(self.ids, x)
            at[at == len(self.ids)] = 0
            if len(self.ids):
                out[i] = self.weights[at][self.ids[at] == x].sum()
        return out

    def tails(self, link: np.ndarray) -> np.ndarray:
        """P(grade > j) for each j, one row per document."""
        return 1 - _logistic(self.thresholds[None, :] - link[:, None])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def loss(w: np.ndarray, params: np.ndarray, ids: np.ndarray, column: np.ndarray, owner: np.ndarray, grades: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted negative log-likelihood of the grades, and its gradients by the weights and by params (first threshold, logs of the gaps)."""
    theta = np.cumsum(np.r_[params[0], np.exp(params[1:])])
    s = np.bincount(owner, weights=w[column], minlength=len(grades))
    edges = np.concatenate([[-np.inf], theta, [np.inf]])
    up, low = _logistic(edges[grades + 1] - s), _logistic(edges[grades] - s)
    p = np.maximum(up - low, 1e-9)
    d_up, d_low = up * (1 - up) / p * weight, low * (1 - low) / p * weight
    g_w = np.bincount(column, weights=(d_up - d_low)[owner], minlength=len(ids))
    g_theta = np.array([d_low[grades == j + 1].sum() - d_up[grades == j].sum() for j in range(GRADES - 1)])
    g_p = np.r_[g_theta.sum(), [g_theta[j:].sum() * np.exp(params[j]) for j in range(1, GRADES - 1)]]
    return float(-(weight * np.log(p)).sum()), g_w, g_p


def fit(rows: list[np.ndarray], grades: np.ndarray, rounds: int = 250, step: float = 0.15, l1: float = 2e-4) -> Model:
    """Cumulative-link weights and thresholds of graded feature rows."""
    present = np.unique(grades)
    if len(present) < 2:
        best = int(present[0]) if len(present) else GRADES - 1
        return Model(np.zeros(0, np.int32), np.zeros(0), np.array([-30.0 if best > j else 30.0 for j in range(GRADES - 1)]))
    ids, column = np.unique(np.concatenate(rows), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    share = np.bincount(grades, minlength=GRADES)
    weight = (len(grades) / np.maximum(share, 1))[grades] ** 0.5
    weight /= weight.sum()
    below = np.cumsum(share)[:-1] / len(grades)
    first = np.log(np.clip(below, 1e-4, 1 - 1e-4) / (1 - np.clip(below, 1e-4, 1 - 1e-4)))
    params = np.r_[first[0], np.log(np.maximum(np.diff(first), 0.1))]  # first threshold, then logs of the gaps, so the order holds
    w, sum_w, sum_p = np.zeros(len(ids)), np.full(len(ids), 1e-8), np.full(len(params), 1e-8)
    for _ in range(rounds):
        _, g_w, g_p = loss(w, params, ids, column, owner, grades, weight)
        sum_w += g_w * g_w
        sum_p += g_p * g_p
        rate = step / np.sqrt(sum_w)
        w -= rate * g_w
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
        params -= step / np.sqrt(sum_p) * g_p
    theta = np.cumsum(np.r_[params[0], np.exp(params[1:])])
    some = np.abs(w) > 1e-6
    return Model(ids[some], w[some], theta)


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on at most fit_rows labelled documents; the sample of labels is broadcast since that bounds it."""
    graded = labels.select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2).alias("grade"), "quality", "toxic")
    sample = graded.where("id is not null and quality is not null and toxic is not null").orderBy(F.xxhash64("id"), "id").limit(fit_rows).select("id", "grade")
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("text"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = utf8(b.column(1))
        lots = [xxhash.xxh64_intdigest(t) >> 1 for t in found]
        return pa.record_batch([b.column(0), pa.array(lots, pa.int64()), pa.array([features(t) for t in found], pa.list_(pa.int32()))], ["grade", "lot", "x"])

    # A doc_id that several documents have gives a row for each, so what goes to the driver is bounded once more, by hash of the text.
    made = arrow_map(texts.join(F.broadcast(sample), "id").select("grade", "text"), run, "grade int, lot bigint, x array<int>")
    got = made.orderBy("lot", "grade").limit(fit_rows).toArrow()
    rows = [np.asarray(x.values) for x in got.column("x")] if got.num_rows else []
    return fit(rows, got.column("grade").to_numpy().astype(np.int64))


def score(docs: DataFrame, model: Model, keep_tail: float = KEEP_TAIL, only_kept: bool = False) -> DataFrame:
    """docs with expected_grade, tail_prob and keep, in columns _grade, _tail and _keep; narrow."""
    names = docs.columns
    at = names.index("text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        tails = model.tails(model.link([features(t) for t in utf8(b.column(at))]))
        keep = tails[:, -1] >= keep_tail
        out = pa.record_batch([*b.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(keep)], [*b.schema.names, "_grade", "_tail", "_keep"])
        return out.filter(pa.array(keep)) if only_kept else out

    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    fields = ", ".join(f"`c{i}` {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    return arrow_map(inner, run, f"{fields}, _grade double, _tail double, _keep boolean")


def graded(docs: DataFrame, labels: DataFrame, only_kept: bool = False) -> DataFrame:
    """doc_id, expected_grade, tail_prob and keep of every document, or of the selected ones only."""
    out = score(docs.select("doc_id", "text"), train(docs, labels), only_kept=only_kept)
    return out.select(F.col("c0").alias("doc_id"), F.col("_grade").alias("expected_grade"), F.col("_tail").alias("tail_prob"), F.col("_keep").alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier selects, all columns."""
    out = score(docs, train(docs, labels), only_kept=True)
    return out.drop("_grade", "_tail", "_keep").toDF(*docs.columns)
