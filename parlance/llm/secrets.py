"""Secret scans: patterns, and a character convolutional network over every candidate and its context.

Candidates are all runs of CANDIDATE or more characters of [A-Za-z0-9+/_.=-], each looked at in pieces of PIECE characters with its context.
The labelled findings that train the network are of two kinds. Found: every distinct piece of all documents; those under a pattern's span are positive,
others negative, except those that a short fit on the other half of the pieces takes for secrets. Planted, since patterns know few forms: secrets of the
forms that `planted` draws (base64, prefixed, dotted and grouped keys, upper-case and mixed ones) set into contexts of the corpus are positive, and
names, paths, numbers and rules built from the corpus's own words are negative. The pieces are dealt by hash into blocks of about FIT_POSITIVES +
FIT_NEGATIVES, each with its own FIT_PLANTED + FIT_HARMLESS planted ones, so planted and found keep their proportion however many documents there are.
The network (character embedding, convolution, maxima over candidate and context apart, one logit) is fitted in numpy on the executors: in each epoch
every block is passed through from the same parameters, and the blocks' parameters and moments are averaged. Platt scaling on all labels held out by
hash calibrates it, and the cut is the highest probability that still finds RECALL of all held-out positives, an exact order statistic. Sums are of whole
numbers and blocks depend on the pieces alone, so neither the order nor the partitions of the documents change the network. The driver gets sums of some
5,500 numbers from SUMMED tasks at most, and 65,536 counts twice for the cut. Every piece of every candidate that no pattern covers is scored, the
largest counting. The network adds spans ("net"); pattern spans stay.

Null and empty texts have no spans. Very long texts and candidates are scanned whole. Repeated rows are scanned each. Where the documents hold no
candidate, no span is added. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import arrow_map, bound_arrow, materialise, passing, release, utf8, whole_groups

KINDS = ("assign", "access", "hex", "net")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
CANDIDATE = 12
BEFORE, PIECE, AFTER = 20, 40, 4
#: Of a training block: pieces found (both kinds together, on average), and secrets and harmless candidates that are planted. No bound on the number of blocks.
FIT_POSITIVES, FIT_NEGATIVES, FIT_PLANTED, FIT_HARMLESS = 2000, 6000, 3000, 3000
RECALL = 0.98
#: Pieces scored together.
SCORED = 4096
#: Tasks whose sums the driver takes as they are; those of more tasks are added up before.
SUMMED = 256
_IN_RUN = np.zeros(128, bool)
_IN_RUN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = True


def runs(texts: list[str], least: int) -> list[list[tuple[int, int]]]:
    """Spans of the candidate runs of each text."""
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _IN_RUN[np.minimum(points, 127)] & (points < 128)
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edge = np.r_[0, edge] if inside[0] else edge  # ends in a line break, so runs are closed
    starts, ends = edge[::2], edge[1::2]
    some = ends - starts >= least
    starts, ends = starts[some], ends[some]
    begins = np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)]
    owner = np.searchsorted(begins, starts, side="right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for i, a, z in zip(owner.tolist(), (starts - begins[owner]).tolist(), (ends - begins[owner]).tolist()):
        out[i].append((a, z))
    return out


def patterns(text: str, found: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern findings; found: runs of 12 or more characters, in which all of them must lie."""
    if not found:
        return []
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "apik" in low or "api_" in low:  # the names in ASSIGN
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 12]
    for a, z in found:
        if z - a >= 16:
            part = text[a:z]
            if "AKIA" in part:
                out += [(a + m.start(), 1, a + m.end()) for m in ACCESS.finditer(part) if m.end() - m.start() >= 18]
            out += [(a + m.start(), 2, a + m.end()) for m in HEX.finditer(part) if m.end() - m.start() >= 16]
    return sorted(out)


def pieces(text: str, a: int, z: int) -> list[tuple[str, int, int]]:
    """Fixed windows over a candidate, with the part that each is about: context before, a piece, context after; short pieces are padded behind."""
    if z - a <= PIECE:
        return [(text[max(0, a - BEFORE) : a].rjust(BEFORE, "\0") + text[a:z].ljust(PIECE, "\0") + text[z : z + AFTER].ljust(AFTER, "\0"), a, z)]
    out = []
    for at in range(a, z, PIECE):
        end = min(at + PIECE, z)
        if end - at < PIECE // 2 and at > a:
            at = max(a, end - PIECE)
        out.append((text[max(0, at - BEFORE) : at].rjust(BEFORE, "\0") + text[at:end].ljust(PIECE, "\0") + text[end : end + AFTER].ljust(AFTER, "\0"), at, end))
    return out


_UP, _LOW, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def planted(rng: random.Random) -> str:
    """A made secret of some form."""
    draw = lambda alphabet, a, z: "".join(rng.choices(alphabet, k=rng.randint(a, z)))
    every = _UP + _LOW + _DIGITS
    form = rng.randrange(9)
    if form == 0:
        return draw(every + "+/", 20, 86) + rng.choice(["", "=", "=="])
    if form == 1:
        return draw(every + "-_", 20, 64)
    if form == 2:  # a short name, then the key
        return draw(_LOW, 2, 4) + rng.choice("-_") + draw(every, 20, 48)
    if form == 3:  # three encoded parts
        return "eyJ" + ".".join(draw(every + "-_", 16, 40) for _ in range(3))
    if form == 4:
        return draw(_UP + "234567", 16, 40)
    if form == 5:
        return draw(_DIGITS + "ABCDEF", 16, 64)
    if form == 6:
        return "-".join(draw(_DIGITS + "abcdef", n, n) for n in (8, 4, 4, 4, 12))
    if form == 7:
        return "-".join(draw(_UP + _DIGITS, 5, 5) for _ in range(rng.randint(3, 5)))
    return draw(every, 4, 8) + rng.choice(_DIGITS) + draw(every, 4, 8) + rng.choice(_UP) + draw(every, 2, 6)


def harmless(rng: random.Random, words: list[str]) -> str:
    """A made candidate that is no secret: names, paths, numbers and rules of ordinary words."""
    some = lambda a, z: [rng.choice(words) for _ in range(rng.randint(a, z))]
    form = rng.randrange(9)
    if form == 0:
        return rng.choice("-_.").join(some(3, 5))
    if form == 1:
        return "".join(w.capitalize() for w in some(2, 5))
    if form == 2:
        return rng.choice(["/", ""]) + "/".join(some(2, 5)) + rng.choice(["", ".html", ".txt", ".py", "/"])
    if form == 3:
        return rng.choice("-=_.") * rng.randint(12, 80)
    if form == 4:
        return f"{rng.randint(1900, 2100)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}" + rng.choice(["", "_"]) + rng.choice(some(1, 1))
    if form == 5:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4)) + rng.choice([".", "/24", "-", ""])
    if form == 6:
        return "_".join(some(1, 3)) + rng.choice(["", "_", "-v"]) + str(rng.randint(0, 9999))
    if form == 7:
        return "".join(some(2, 3)).upper() + rng.choice(["", ".", "..."])
    return "".join(some(2, 4)) + rng.choice(["", ".", "-", "..."])


def codes(windows: list[str]) -> np.ndarray:
    """Character numbers of windows: 0 padding, 1 white space, 2 beyond ASCII, then printable ASCII."""
    points = np.frombuffer("".join(windows).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, BEFORE + PIECE + AFTER)
    return np.where(points == 0, 0, np.where(points <= 32, 1, np.where(points > 126, 2, points - 30))).astype(np.uint8)


@dataclass
class Net:
    """Embedding, convolution with pools, logit; scale and shift calibrate, cut selects."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    offset: float
    scale: float = 1.0
    shift: float = 0.0
    cut: float = 2.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        out, length, memory = np.zeros(len(x), np.float32), lengths(x), Memory()
        order = np.argsort(-length, kind="stable")
        for at in range(0, len(x), BATCH):
            rows = order[at : at + BATCH]
            out[rows] = Batch(x[rows], length[rows], memory).pooled(self.embed, self.kernel, self.bias) @ self.out + self.offset
        return out

    def calibrated(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -35, 35)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(self.logits(x))


WIDTH, EMBED, FILTERS = 5, 8, 24
#: Windows of a step.
BATCH = 128
#: Places: of the context, those looked at in every window (the first of them), those that see what follows the piece, and STEPS times STEP that longer pieces reach.
CONTEXT, EVERY, TAIL, STEP, STEPS = BEFORE - WIDTH // 2, 32, 2, 12, 2
#: Characters that places look at.
SEEN = CONTEXT + PIECE + WIDTH - 1


def lengths(x: np.ndarray) -> np.ndarray:
    """Characters of each window's piece."""
    own = x[:, BEFORE : BEFORE + PIECE] != 0
    return np.where(own.any(axis=1), PIECE - own[:, ::-1].argmax(axis=1), 0)


class Memory:
    """Arrays of a batch, used again by the next."""

    def __init__(self) -> None:
        most = BATCH * (EVERY + TAIL + STEP * STEPS) + 1
        self.index, self.cols, self.h = np.empty(most * WIDTH, np.intp), np.empty(most * WIDTH * EMBED, np.float32), np.empty(most * FILTERS, np.float32)
        self.hit, self.some, self.ones = np.empty(most * FILTERS, bool), np.empty(most * FILTERS, np.float32), np.ones(most, np.float32)
        self.d_chars = np.empty(EMBED * SEEN * BATCH, np.float32)


class Batch:
    """At most BATCH windows, those of longer pieces first, laid out by place, then window, then filter: pools are maxima and sums of whole rows.

    Places amid the padding of short pieces are left out, STEP at a time. They see padding alone; the last row is such a place and stands for all of them.
    """

    def __init__(self, x: np.ndarray, length: np.ndarray, memory: Memory) -> None:
        many = len(x)
        reach = [int(np.count_nonzero(length > EVERY - BEFORE + STEP * i)) for i in range(STEPS)]
        #: First row, places, windows and first place of each part; then the parts of pieces' own places.
        self.parts, at = [(0, EVERY, many, 0), (EVERY * many, TAIL, many, SEEN - WIDTH + 1 - TAIL)], (EVERY + TAIL) * many
        for i, w in enumerate(reach):
            if w:
                self.parts.append((at, STEP, w, EVERY + STEP * i))
                at += STEP * w
        self.own = [(CONTEXT * many, EVERY - CONTEXT + TAIL, many), *(part[:3] for part in self.parts[2:])]
        self.many, self.n, self.longest, self.memory = many, at + 1, reach[-1], memory
        self.left = np.full((many, 1), STEP * STEPS, np.float32)  # places left out of each window
        for w in reach:
            self.left[:w] -= STEP
        self.chars = x[:, :SEEN].T.astype(np.intp, order="C")
        self.h = memory.h[: self.n * FILTERS].reshape(self.n, FILTERS)

    def _rows(self, flat: np.ndarray, at: int, places: int, windows: int) -> np.ndarray:
        return flat[at * FILTERS : (at + places * windows) * FILTERS].reshape(places, -1)

    def pooled(self, embed: np.ndarray, kernel: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """By window: maxima over its own places, their means, and maxima over its context. h holds the outputs of the convolution less the bias, own ones -bias at least."""
        index = self.memory.index[: self.n * WIDTH].reshape(self.n, WIDTH)
        for j in range(WIDTH):
            for at, places, w, place in self.parts:
                index[at : at + places * w, j].reshape(places, w)[...] = self.chars[place + j : place + j + places, :w]
        index[-1] = 0
        self.cols = self.memory.cols[: index.size * EMBED].reshape(self.n, WIDTH * EMBED)
        np.take(embed, index.ravel(), axis=0, out=self.cols.reshape(-1, EMBED), mode="clip")
        np.matmul(self.cols, kernel, out=self.h)
        self.least, flat = np.tile(-bias, self.many), self.memory.h
        for at in self.own:
            part = self._rows(flat, *at)
            np.maximum(part, self.least[: part.shape[1]], out=part)
        padding = np.maximum(self.h[-1], -bias, out=self.h[-1])
        first = self._rows(flat, *self.own[0])
        own, total, context = first.max(axis=0), first.sum(axis=0), np.maximum(self._rows(flat, 0, CONTEXT, self.many).max(axis=0), self.least)
        for at in self.own[1:]:
            part, width = self._rows(flat, *at), at[2] * FILTERS
            np.maximum(own[:width], part.max(axis=0), out=own[:width])
            total[:width] += part.sum(axis=0)
        short = own.reshape(-1, FILTERS)[self.longest :]
        np.maximum(short, padding, out=short)
        self.most = own, context
        out = np.empty((self.many, 3, FILTERS), np.float32)
        out[:, 0], out[:, 2] = own.reshape(-1, FILTERS), context.reshape(-1, FILTERS)
        out[:, 1] = (total.reshape(-1, FILTERS) + self.left * padding) / PIECE
        out += bias
        return out.reshape(self.many, -1)

    def gradients(self, d_pooled: np.ndarray, embed: np.ndarray, kernel: np.ndarray, bias: np.ndarray) -> list[np.ndarray]:
        """Of embedding, kernel and bias, given those of what is pooled. That of a maximum goes to the places that have it, in equal parts. h is written over."""
        many, n, memory, flat = self.many, self.n, self.memory, self.memory.h
        (own, context), padding = self.most, self.h[-1].copy()
        d_own, d_mean, d_context = (d.ravel() for d in d_pooled.reshape(many, 3, FILTERS).transpose(1, 0, 2))
        mean = d_mean / PIECE
        part, hit = self._rows(flat, 0, CONTEXT, many), self._rows(memory.hit, 0, CONTEXT, many)
        np.equal(part, context, out=hit)
        np.multiply(hit, d_context * (context > self.least) / np.maximum(_count(hit), 1), out=part)
        in_padding = (own.reshape(-1, FILTERS) == padding) & (self.left > 0)
        have = in_padding.ravel().astype(np.float32)
        for at in self.own:
            hit, width = self._rows(memory.hit, *at), at[2] * FILTERS
            np.equal(self._rows(flat, *at), own[:width], out=hit)
            have[:width] += _count(hit)
        share = d_own * (own > self.least) / have
        for at in self.own:
            part, hit, some, width = self._rows(flat, *at), self._rows(memory.hit, *at), self._rows(memory.some, *at), at[2] * FILTERS
            np.multiply(part > self.least[:width], mean[:width], out=part)
            np.multiply(hit, share[:width], out=some)
            part += some
        self.h[-1] = (padding > -bias) * (self.left.T @ mean.reshape(-1, FILTERS))[0] + (share.reshape(-1, FILTERS) * in_padding).sum(axis=0)
        d_kernel = sum((h.transpose(0, 2, 1) @ cols).sum(axis=0) for h, cols in zip(_chunks(self.h), _chunks(self.cols))).T
        d_bias = memory.ones[:n] @ self.h
        d_cols = memory.cols[: n * WIDTH * EMBED].reshape(WIDTH, EMBED, n)
        np.matmul(kernel, self.h.T, out=d_cols.reshape(-1, n))
        d_chars = memory.d_chars[: EMBED * self.chars.size].reshape(EMBED, SEEN, many)
        d_chars[...] = 0
        for j in range(WIDTH):
            for at, places, w, place in self.parts:
                d_chars[:, place + j : place + j + places, :w] += d_cols[j, :, at : at + places * w].reshape(EMBED, places, w)
        chars, d_embed = self.chars.astype(np.uint8).ravel(), np.zeros_like(embed)
        order, seen = np.argsort(chars, kind="stable"), np.bincount(chars, minlength=len(embed))
        by_char = memory.some[: d_chars.size].reshape(EMBED, -1)
        np.take(d_chars.reshape(EMBED, -1), order, axis=1, out=by_char, mode="clip")
        d_embed[seen > 0] = np.add.reduceat(by_char, (np.cumsum(seen) - seen)[seen > 0], axis=1).T
        d_embed[0] += d_cols[:, :, -1].sum(axis=0)
        return [d_embed, d_kernel, d_bias]


def _chunks(a: np.ndarray) -> Iterator[np.ndarray]:
    """All rows of a matrix, 128 at a time: the library multiplies small matrices without packing them first."""
    whole = len(a) // 128 * 128
    yield a[:whole].reshape(-1, 128, a.shape[1])
    yield a[None, whole:]


def _count(hit: np.ndarray) -> np.ndarray:
    """Rows that are true, by column; of fewer than 256."""
    return np.add.reduce(hit.view(np.uint8), axis=0, dtype=np.uint8)


@dataclass
class Fit:
    """A network in training: its parameters, Adam's moments and the steps taken."""

    params: list[np.ndarray]
    first: list[np.ndarray]
    second: list[np.ndarray]
    t: float = 0.0

    @classmethod
    def start(cls, rng: np.random.Generator) -> Fit:
        params = [rng.normal(0, s, n).astype(np.float32) for s, n in ((0.3, (97, EMBED)), (0.15, (WIDTH * EMBED, FILTERS)), (0.01, FILTERS), (0.1, 3 * FILTERS))]
        params.append(np.zeros(1, np.float32))
        return cls(params, [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params])

    def net(self) -> Net:
        return Net(*self.params[:4], float(self.params[4][0]))

    def epoch(self, tx: np.ndarray, ty: np.ndarray, share: float, rng: np.random.Generator, rate: float = 0.01) -> None:
        """One pass of Adam over the windows; share: of positives among all that are trained on, by which both kinds get the same weight."""
        ty, length, memory = ty.astype(np.float32), lengths(tx), Memory()
        weight = np.where(ty > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        flat, first, second = (np.concatenate([a.ravel() for a in own]) for own in (self.params, self.first, self.second))
        parts = np.split(flat, np.cumsum([a.size for a in self.params])[:-1])
        embed, kernel, bias, out, offset = (part.reshape(a.shape) for part, a in zip(parts, self.params))
        order = rng.permutation(len(tx))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            pick = pick[np.argsort(-length[pick], kind="stable")]
            batch = Batch(tx[pick], length[pick], memory)
            pooled = batch.pooled(embed, kernel, bias)
            p = 1 / (1 + np.exp(-np.clip(pooled @ out + offset, -35, 35)))
            d = ((p - ty[pick]) * weight[pick] / len(pick)).astype(np.float32)
            g = np.concatenate([a.ravel() for a in (*batch.gradients(d[:, None] * out, embed, kernel, bias), d @ pooled, d.sum(keepdims=True))])
            self.t += 1
            first += 0.1 * (g - first)
            second += 0.001 * (g * g - second)
            flat -= rate * (first / (1 - 0.9**self.t)) / (np.sqrt(second / (1 - 0.999**self.t)) + 1e-7)
        for own, row in ((self.params, flat), (self.first, first), (self.second, second)):
            own[:] = [part.reshape(a.shape) for part, a in zip(np.split(row, np.cumsum([a.size for a in own])[:-1]), own)]

    def pack(self) -> np.ndarray:
        """Parameters, moments (the second as roots, which are of one size with the first) and steps in one row."""
        return np.concatenate([a.ravel().astype(np.float64) for a in (*self.params, *self.first, *map(np.sqrt, self.second))] + [np.array([self.t])])

    @classmethod
    def unpack(cls, row: np.ndarray) -> Fit:
        out = cls.start(np.random.default_rng(0))
        at = 0
        for own in (out.params, out.first, out.second):
            for i, a in enumerate(own):
                part = row[at : at + a.size].reshape(a.shape)
                own[i] = (part * part if own is out.second else part).astype(np.float32)
                at += a.size
        out.t = float(row[at])
        return out


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray | None = None, epochs: int = 10, rate: float = 0.01, seed: int = 7) -> Net:
    """Train in memory on the labelled windows, calibrate and cut on those held out (default: every fourth). Adam; numpy only. `train` does so over tables."""
    rng = np.random.default_rng(seed)
    own = Fit.start(rng)
    held = np.arange(len(x)) % 4 == 3 if held is None else held
    if min(y[~held].sum(), (1 - y[~held]).sum(), y[held].sum(), (1 - y[held]).sum()) < 2:
        return own.net()
    for _ in range(epochs):
        own.epoch(x[~held], y[~held], float(y[~held].mean()), rng, rate)
    net = own.net()
    logit, truth = net.logits(x[held]), y[held]
    for _ in range(200):  # Platt scaling by gradient steps
        p = 1 / (1 + np.exp(-np.clip(net.scale * logit + net.shift, -35, 35)))
        net.scale = max(0.05, net.scale - 0.05 * float(((p - truth) * logit).mean()))
        net.shift -= 0.1 * float((p - truth).mean())
    found = np.sort(net.probability(x[held])[truth > 0])
    net.cut = float(found[int((1 - RECALL) * len(found))])
    return net


def labelled(text: str, found: list[tuple[int, int]]) -> Iterator[tuple[str, bool]]:
    """Every piece of every candidate of a text, and whether a pattern's finding lies in it."""
    spans = patterns(text, found)
    for a, z in found:
        for window, at, end in pieces(text, a, z):
            yield window, bool(spans) and any(min(e, end) - max(s, at) >= min(CANDIDATE, end - at) for s, _, e in spans)


def _order(window: str) -> int:
    return xxhash.xxh64_intdigest(window.encode()) >> 1


def sample(docs: DataFrame, text_col: str = "text") -> list[tuple[str, bool]]:
    """For a look at the pieces of a corpus: the distinct ones of lowest hash over all documents, FIT_POSITIVES and FIT_NEGATIVES at most. Nothing is trained on it; `train` takes all."""
    bounds = {True: FIT_POSITIVES, False: FIT_NEGATIVES}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lowest: dict[bool, dict[int, str]] = {True: {}, False: {}}
        limit = {True: 1 << 64, False: 1 << 64}
        for b in batches:
            texts = [t.decode("utf-8", "replace") for t in utf8(b.column(0))]
            for text, found in zip(texts, runs(texts, CANDIDATE)):
                for window, label in labelled(text, found):
                    if (lot := _order(window)) < limit[label]:
                        held = lowest[label]
                        held[lot] = window
                        if len(held) >= 2 * bounds[label]:
                            lowest[label] = {k: held[k] for k in heapq.nsmallest(bounds[label], held)}
                            limit[label] = max(lowest[label])
        rows = [(lot, w, label) for label, held in lowest.items() for lot, w in sorted(held.items())[: bounds[label]]]
        if rows:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.bool_()))], ["lot", "window", "label"])

    bound_arrow(docs.sparkSession)
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "lot bigint, window string, label boolean").distinct()
    take = lambda label: found.where(F.col("label") == label).orderBy("lot", "window").limit(bounds[label])
    return sorted((r["window"], r["label"]) for r in take(True).unionByName(take(False)).collect())


def training_set(found: list[tuple[str, bool]], seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows, labels and which are held out: the pieces found, and planted ones in their contexts."""
    rng = random.Random(seed)
    rows = {w: label for w, label in found}
    plain = [w for w, label in sorted(rows.items()) if not label] or sorted(rows)
    words = sorted({x.lower() for x in set(re.findall(r"[A-Za-z]{3,9}", "\0".join(plain)))}) or ["word"]
    for many, label, make in ((FIT_PLANTED, True, lambda: planted(rng)), (FIT_HARMLESS, False, lambda: harmless(rng, words))) if plain else ():
        for _ in range(many):
            around, made = rng.choice(plain), make()
            if len(made) >= CANDIDATE:
                before, after = around[:BEFORE].lstrip("\0"), around[-AFTER:].rstrip("\0")
                text = before.rstrip("+/_.=-" + _UP + _LOW + _DIGITS) + made + (after if after[:1] not in _UP + _LOW + _DIGITS + "+/_.=-" else " ")
                start = text.index(made, len(text) - len(made) - AFTER if len(text) > len(made) + AFTER else 0)
                for window, _, _ in pieces(text, start, start + len(made)):
                    rows.setdefault(window, label)
    lots = dict(zip(rows, map(_order, rows)))
    windows = sorted(rows, key=lots.__getitem__)
    held = np.array([lots[w] % 4 == 3 for w in windows], bool)
    return codes(windows), np.array([rows[w] for w in windows], np.float64), held


def every_piece(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """lot, window, label: the distinct pieces of all documents; positive where any of a piece's places is."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.decode("utf-8", "replace") for t in utf8(b.column(0))]
        found: dict[str, bool] = {}
        for text, spans in zip(texts, runs(texts, CANDIDATE)):
            for window, label in labelled(text, spans):
                found[window] = found.get(window, False) or label
        return pa.record_batch([pa.array(map(_order, found), pa.int64()), pa.array(found, pa.string()), pa.array(found.values(), pa.bool_())], ["lot", "window", "label"])

    found = arrow_map(docs.select(F.col(text_col).alias("text")), run, "lot bigint, window string, label boolean")
    return found.groupBy("lot", "window").agg(F.max("label").alias("label"))


def blocks(found: DataFrame, nets: dict[int, Net] | None = None) -> DataFrame:
    """Training blocks of all pieces found: fold, codes, labels, held, and counts of each kind of label by held.

    A block holds pieces of one half (a bit of the hash) only. Without nets the halves are the folds. With nets, one by half, there is one fold, and
    negatives which the other half's net takes for secrets are left out: that no pattern covers them doesn't make them harmless.
    """
    half = F.shiftright("lot", 8).bitwiseAND(F.lit(1))
    many = {r["half"]: max(1, round(r["count"] / (FIT_POSITIVES + FIT_NEGATIVES))) for r in found.groupBy(half.alias("half")).count().collect()}
    block = half + F.lit(2) * F.pmod(F.shiftright("lot", 9), F.when(half == 0, F.lit(many.get(0, 1))).otherwise(F.lit(many.get(1, 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, 1):
            keys = rows.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, z in zip(edges, edges[1:]):
                own, windows, labels = int(keys[a]), rows.column(1).slice(a, z - a).to_pylist(), rows.column(2).slice(a, z - a).to_pylist()
                if (other := (nets or {}).get(1 - own % 2)) is not None:
                    kept = [label or x < 0.5 for label, x in zip(labels, other.probability(codes(windows)).tolist())]
                    windows, labels = [w for w, k in zip(windows, kept) if k], [label for label, k in zip(labels, kept) if k]
                x, y, held = training_set(list(zip(windows, labels)), 7 + own)
                y = y > 0
                counts = [int((y & ~held).sum()), int((~y & ~held).sum()), int((y & held).sum()), int((~y & held).sum())]
                row = [own % 2 if nets is None else 0, own, x.tobytes(), y.tobytes(), held.tobytes(), *counts]
                yield pa.record_batch([pa.array([v], k) for v, k in zip(row, (pa.int32(), pa.int64(), *[pa.binary()] * 3, *[pa.int64()] * 4))], ["fold", "block", "codes", "labels", "held", *COUNTS])
            pa.default_memory_pool().release_unused()

    bound_arrow(found.sparkSession)
    parts = min(sum(many.values()) or 1, 20_000)
    dealt = found.select(block.alias("block"), "window", "label", "lot").repartition(parts, "block").sortWithinPartitions("block", "lot", "window").select("block", "window", "label")
    return dealt.mapInArrow(run, "fold int, block bigint, codes binary, labels binary, held binary, " + ", ".join(f"{c} bigint" for c in COUNTS))


COUNTS = ("positive", "negative", "held_positive", "held_negative")
#: Sums over blocks are of whole numbers of this unit, so they come out the same in any order.
UNIT = 1 << 24


def _rows(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for fold, block, x, y, held in zip(*(b.column(i).to_pylist() for i in range(5))):
        yield fold, block, np.frombuffer(x, np.uint8).reshape(-1, BEFORE + PIECE + AFTER), np.frombuffer(y, bool), np.frombuffer(held, bool)


def _epoch(table: DataFrame, many: int, fits: dict[int, Fit], share: dict[int, float], number: int) -> dict[int, Fit]:
    """One epoch over all blocks: each is passed through from the same parameters; the mean of what comes out, by windows trained on, is the next."""

    def added(batches: Iterator[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        sums: dict[int, np.ndarray] = {}
        for fold, row in batches:
            sums[fold] = sums[fold] + row if fold in sums else row
        return pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.int64()))], ["fold", "sums"])

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for b in batches:
            for fold, block, x, y, held in _rows(b):
                if fold in fits and not held.all():
                    own = Fit.unpack(fits[fold].pack())
                    own.epoch(x[~held], y[~held], share[fold], np.random.default_rng((number, block)))
                    n = int((~held).sum())
                    yield fold, np.r_[np.rint(own.pack() * (n * UNIT)).astype(np.int64), n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield added(passed(batches))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield added((f, np.array(s, np.int64)) for b in batches for f, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))

    schema = "fold int, sums array<bigint>"
    sums = table.select("fold", "block", "codes", "labels", "held").mapInArrow(run, schema)
    if many > SUMMED:
        sums = sums.repartition(16).mapInArrow(again, schema)
    total: dict[int, np.ndarray] = {}
    for r in sums.collect():
        row = np.array(r["sums"], np.int64)
        total[r["fold"]] = total[r["fold"]] + row if r["fold"] in total else row
    return {fold: Fit.unpack(s[:-1] / (float(s[-1]) * UNIT)) for fold, s in total.items()}


def _held(table: DataFrame, nets: dict[int, Net]) -> DataFrame:
    """fold, label, logit of every window held out, and the logit's bits as a number that orders like it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for fold, _, x, y, held in _rows(b):
                if fold in nets and held.any():
                    logit = nets[fold].logits(x[held]).astype(np.float32)
                    columns = [pa.array(np.full(len(logit), fold, np.int32)), pa.array(y[held]), pa.array(logit), pa.array(_ordered(logit.view(np.int32)))]
                    yield pa.record_batch(columns, ["fold", "label", "logit", "place"])

    return table.select("fold", "block", "codes", "labels", "held").mapInArrow(run, "fold int, label boolean, logit float, place int")


def _ordered(bits: np.ndarray) -> np.ndarray:
    """Bits of floats to whole numbers of the same order, and back."""
    return bits ^ ((bits >> 31) & 0x7FFFFFFF)


def _calibrate(held: DataFrame, nets: dict[int, Net], counts: dict[int, dict[str, int]]) -> None:
    """Platt scaling over all windows held out: Newton steps, whose sums are taken in whole numbers over the table."""
    by = lambda values: F.element_at(F.create_map(*(F.lit(v) for fold in nets for v in (fold, float(values[fold])))), F.col("fold"))
    for _ in range(30):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), by({f: n.scale for f, n in nets.items()}) * F.col("logit") + by({f: n.shift for f, n in nets.items()})))))
        smooth = F.when(F.col("label"), by({f: (c["held_positive"] + 1) / (c["held_positive"] + 2) for f, c in counts.items()})).otherwise(by({f: 1 / (c["held_negative"] + 2) for f, c in counts.items()}))
        own = held.select("fold", F.col("logit").cast("double").alias("x"), p.alias("p"), smooth.alias("t"))
        off, curve = F.col("p") - F.col("t"), F.col("p") * (1 - F.col("p"))
        terms = [off * F.col("x"), off, curve * F.col("x") * F.col("x"), curve * F.col("x"), curve]
        largest = 0.0
        for r in own.groupBy("fold").agg(*(F.sum(F.round(v * UNIT).cast("bigint")).alias(f"s{i}") for i, v in enumerate(terms))).collect():
            net, (gx, g, hxx, hx, h) = nets[r["fold"]], (r[f"s{i}"] / UNIT for i in range(5))
            step = np.linalg.solve(np.array([[hxx + 1e-3, hx], [hx, h + 1e-3]]), np.array([gx, g]))
            scale = min(max(net.scale - step[0], net.scale / 2, 0.05), net.scale * 2)
            shift = net.shift - float(np.clip(step[1], -2, 2))
            largest = max(largest, abs(scale - net.scale), abs(shift - net.shift))
            net.scale, net.shift = float(scale), shift
        if largest < 1e-4:
            break


def _cut(held: DataFrame, net: Net, positives: int) -> float:
    """The highest probability that still finds RECALL of all positives held out: the logit of that rank, by counts of the upper and then the lower half of its bits."""
    rank, found = int((1 - RECALL) * positives), held.where("label")
    upper, lower = F.shiftright("place", 16), F.col("place").bitwiseAND(F.lit(0xFFFF))
    value = []
    for part in (upper, lower):
        for r in sorted(found.groupBy(part.alias("part")).count().collect(), key=lambda r: r["part"]):
            if rank < r["count"]:
                break
            rank -= r["count"]
        value.append(r["part"])
        found = found.where(part == r["part"])
    place = np.array([value[0] * 65536 + value[1]], np.int32)
    return float(net.calibrated(_ordered(place).view(np.float32))[0])


def _fitted(table: DataFrame, epochs: int, seed: int = 7) -> tuple[dict[int, Net], DataFrame, dict[int, dict[str, int]]]:
    """Calibrated nets by fold, the windows held out with their logits, and counts of labels. No net where a fold has fewer than two windows of a kind."""
    counts = {r["fold"]: r.asDict() for r in table.groupBy("fold").agg(F.count("*").alias("blocks"), *(F.sum(c).alias(c) for c in COUNTS)).collect()}
    counts = {fold: c for fold, c in counts.items() if min(c[k] for k in COUNTS) >= 2}
    many = sum(c["blocks"] for c in counts.values())
    fits = {fold: Fit.start(np.random.default_rng(seed)) for fold in counts}
    share = {fold: c["positive"] / (c["positive"] + c["negative"]) for fold, c in counts.items()}
    for number in range(epochs if fits else 0):
        fits = _epoch(table, many, fits, share, number)
    nets = {fold: own.net() for fold, own in fits.items()}
    held = materialise(_held(table, nets), "op6-held")
    if nets:
        _calibrate(held, nets, counts)
    return nets, held, counts


def train(docs: DataFrame, text_col: str = "text") -> Net:
    """Fit on every distinct piece of all documents and on planted ones, calibrate and cut on all that are held out."""
    spark = docs.sparkSession
    with passing(spark):
        found = materialise(every_piece(docs, text_col), "op6-pieces")
        halves = materialise(blocks(found), "op6-halves")
        vouching = _fitted(halves, 4)[0]
        release(spark, halves.stored_at)
        table = materialise(blocks(found, vouching), "op6-blocks")
        nets, held, counts = _fitted(table, 10)
        if not nets:
            return Fit.start(np.random.default_rng(7)).net()
        nets[0].cut = _cut(held, nets[0], counts[0]["held_positive"])
        return nets[0]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


def find_secrets(docs: DataFrame, net: Net | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of pattern findings, their digest and all spans of every row."""
    net = net or train(docs, text_col)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.decode("utf-8", "replace") for t in utf8(b.column(1))]
        base, windows, owner, place = [], [], [], []
        best = [0.0]  # by candidate

        def score() -> None:
            best.extend([0.0] * (len(place) + 1 - len(best)))
            for at, p in zip(owner, net.probability(codes(windows)).tolist() if windows else ()):
                best[at] = max(best[at], p)
            windows.clear()
            owner.clear()

        for i, (text, found) in enumerate(zip(texts, runs(texts, CANDIDATE))):
            spans = patterns(text, found)
            base.append(spans)
            for a, z in found:
                if not spans or not any(s < z and a < e for s, _, e in spans):
                    for window, _, _ in pieces(text, a, z):
                        windows.append(window)
                        owner.append(len(place))
                        if len(windows) == SCORED:
                            score()
                    place.append((i, a, z))
        score()
        every = [list(s) for s in base]
        for (i, a, z), p in zip(place, best):
            if p >= net.cut:
                every[i].append((a, 3, z))
        count = lambda kind: pa.array([sum(k == kind for _, k, _ in s) for s in base], pa.int64())
        return pa.record_batch(
            [b.column(0), count(0), count(1), count(2), pa.array([hashlib.sha256(joined(s).encode()).hexdigest() for s in base]), pa.array([joined(sorted(s)) for s in every])],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )

    kind = dict(docs.dtypes)[id_col]
    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
